"""Claim matrices, resource composition and relational integrity of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Evidence statuses, claim scopes, and the statuses whose measured claims may stand as history.
STATUSES = ("sourceCandidate", "proposed", "implementedReference", "verifiedMechanism", "verifiedEnvironmentSpecific", "verified")
SCOPES = ("historicalObservation", "transferableTarget")
MEASURED = ("verifiedMechanism", "verifiedEnvironmentSpecific", "verified")
# Statuses of the frozen records.
FROZEN = {"py001": "verifiedMechanism", "inv001": "verifiedMechanism", "lean001": "verifiedEnvironmentSpecific", "par001": "verifiedEnvironmentSpecific", "dsp001": "implementedReference"}


def measured_claim_allowed(status: Column, scope: Column) -> Column:
    """A measured claim stands for verified mechanisms as a historical observation only."""
    return status.isin(*MEASURED) & (scope == "historicalObservation")


def transferable_claim_allowed(status: Column, measured: Column, validated: Column, bound: Column) -> Column:
    """A transferable claim needs the historical one and all three kinds of evidence on the target."""
    return measured_claim_allowed(status, F.lit("historicalObservation")) & measured & validated & bound


def all_of(*flags: Column) -> Column:
    """Admissible when every obligation is met; a missing one counts as not met."""
    out = F.lit(True)
    for flag in flags:
        out = out & F.coalesce(flag, F.lit(False))
    return out


def invariant_reuse(holds: Column, reused: Column, recomputed: Column) -> Column:
    """The reused value where the invariant holds, else the recomputed one."""
    return F.when(F.coalesce(holds, F.lit(False)), reused).otherwise(recomputed)


def trust_claim_supported(evidence: Column, claim: Column) -> Column:
    """Verified reuse supports a claim of reuse, a cold reconstruction one of reconstruction; neither the other's."""
    return ((evidence == "verifiedReuse") & (claim == "dependencyReuse")) | ((evidence == "coldReconstruction") & (claim == "coldReconstruction"))


def claim_matrix(spark: SparkSession) -> DataFrame:
    """(status, scope, allowed) of all statuses and scopes."""
    status = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    scope = spark.createDataFrame([(s,) for s in SCOPES], "scope string")
    return status.crossJoin(scope).withColumn("allowed", measured_claim_allowed(F.col("status"), F.col("scope")))


def _crossed(spark: SparkSession, **columns) -> DataFrame:
    """Every combination of a few constant values."""
    out = spark.range(0, 1, 1, 1).select()
    for name, values in columns.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def transferable_matrix(spark: SparkSession) -> DataFrame:
    """(status, measured, validated, bound, allowed) of all combinations."""
    rows = _crossed(spark, status=STATUSES, measured=(True, False), validated=(True, False), bound=(True, False))
    return rows.withColumn("allowed", transferable_claim_allowed(*map(F.col, ("status", "measured", "validated", "bound"))))


def obligation_matrix(spark: SparkSession) -> DataFrame:
    """(kind, met, of, admissible): a mechanism's seven obligations and an approximation's three, so many of them met and the rest missing."""
    rows = _crossed(spark, kind=("mechanism", "approximation"), met=range(8)).withColumn("of", F.when(F.col("kind") == "mechanism", 7).otherwise(3)).where("met <= of")
    met = lambda k: F.when(F.col("met") >= k, F.lit(True))
    seven, three = all_of(*[met(k) for k in range(1, 8)]), all_of(*[met(k) for k in range(1, 4)])
    return rows.withColumn("admissible", F.when(F.col("kind") == "mechanism", seven).otherwise(three))


def trust_matrix(spark: SparkSession) -> DataFrame:
    """(evidence, claim, supported) of all combinations."""
    rows = _crossed(spark, evidence=("verifiedReuse", "coldReconstruction"), claim=("dependencyReuse", "coldReconstruction"))
    return rows.withColumn("supported", trust_claim_supported(F.col("evidence"), F.col("claim")))


def fits(need: str, capacity: str, resources: tuple[str, ...] = ("cpu", "memory", "io")) -> Column:
    out = F.lit(True)
    for r in resources:
        out = out & (F.col(f"{need}.{r}") <= F.col(f"{capacity}.{r}"))
    return out


def composable_pairs(uses: DataFrame, capacity: dict[str, int], key: str = "id") -> DataFrame:
    """(a, b) with a < b whose resources together fit into the capacity, component by component."""
    a, b = uses.alias("a"), uses.alias("b")
    test = F.col(f"a.{key}") < F.col(f"b.{key}")
    for r, most in capacity.items():
        test = test & (F.col(f"a.{r}") + F.col(f"b.{r}") <= F.lit(most))
    return a.join(b, test).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def not_once(index: DataFrame, key: str) -> DataFrame:
    """(key, times) of keys that don't occur exactly once."""
    return index.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("times")).where("times <> 1")


def unknown_keys(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys of ``rows`` that ``known`` lacks."""
    return rows.select(F.col(key).alias("key")).distinct().join(known.select(F.col(known_key).alias("key")), "key", "left_anti")


def status_disagreements(left: DataFrame, right: DataFrame, key: str, status: str) -> DataFrame:
    """(key, left_status, right_status) where both tables have the key but not the same status."""
    a, b = (x.select(F.col(key).alias("key"), F.col(status).alias(name)) for x, name in ((left, "left_status"), (right, "right_status")))
    return a.join(b, "key").where(~F.col("left_status").eqNullSafe(F.col("right_status")))
