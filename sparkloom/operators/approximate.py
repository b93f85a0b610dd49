"""Approximate aggregates with a declared error, beside their exact twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import SharedTable


def checked_distinct(df: DataFrame, value: str, *by: str, error: float = 0.05) -> DataFrame:
    """(by..., exact, within): distinct values, and whether the sketch's count is within five declared errors."""
    # Apart: beside a distinct count Spark would keep a sketch for each group and value.
    value_of = df.select(*by, F.col(value).alias("_value"))
    exact = value_of.distinct().groupBy(*by).agg(F.count("_value").alias("exact"))
    sketch = value_of.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).agg(F.approx_count_distinct("_value", error).alias("_sketch"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    found = exact.join(sketch, same) if by else exact.crossJoin(sketch)
    return found.select(*by, "exact", (F.abs(F.col("_sketch") - F.col("exact")) <= F.greatest(F.lit(1.0), 5 * error * F.col("exact"))).alias("within"))


def checked_quantile(df: DataFrame, value: str, *by: str, share: float = 0.5, accuracy: int = 1000) -> DataFrame:
    """(by..., n, within): rows, and whether the approximate quantile's rank among non-null values is within two in ``accuracy``."""
    sketch = df.groupBy(*by).agg(F.percentile_approx(value, share, accuracy).alias("_q"))
    joined = df.join(sketch, list(by)) if by else df.crossJoin(F.broadcast(sketch))
    ranks = joined.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("_m"), F.count_if(F.col(value) < F.col("_q")).alias("_below"), F.count_if(F.col(value) <= F.col("_q")).alias("_up_to"))
    goal, slack = share * F.col("_m"), F.greatest(F.lit(2.0), 2 * F.col("_m") / accuracy)
    return ranks.select(*by, "n", ((F.col("_below") <= goal + slack) & (F.col("_up_to") >= goal - slack)).alias("within"))


#: Rows over tracked values, times this, bound a sketch's error: frequent-items sketches keep 3/4 of a table of powers of two.
SKETCH_ERROR = 3.5


def proven_top_k(df: DataFrame, column: str, k: int, tracked: int = 10_000, buckets: int = 1 << 14) -> tuple[DataFrame, bool]:
    """(item, n, estimate, rows) of exactly the ``k`` most frequent non-null values, ties to smaller ones; and whether a bound proved them, or an exact pass was needed.

    A sketch of ``tracked`` values names candidates, whose exact counts are
    taken in a second pass, with the totals of all other values by hash bucket.
    A value outside the candidates has at most its bucket's total; so where
    every total is less than the k-th count, nothing was missed.  Buckets with
    more are counted exactly in a third pass, and no other ones.
    """
    own = df.where(F.col(column).isNotNull()).select(F.col(column).alias("item"))
    sketch = own.agg(F.expr(f"approx_top_k(item, {min(tracked, max(2 * k, 64))}, {tracked})").alias("top"), F.count("*").alias("rows"))
    named = SharedTable(sketch.select(F.explode("top").alias("t"), "rows").select("t.item", F.col("t.count").alias("estimate"), "rows"), "candidates").df
    bucket = F.pmod(F.xxhash64("item"), F.lit(buckets))
    # At most `tracked` candidates; what is shuffled is a row a candidate or bucket and task.
    met = own.join(F.broadcast(named.select("item", F.lit(True).alias("_named"))), "item", "left")
    key = F.when(F.col("_named"), F.col("item"))
    counts = SharedTable(met.groupBy(key.alias("item"), F.when(F.col("_named").isNull(), bucket).alias("bucket")).agg(F.count("*").alias("n")), "counts").df
    exact = counts.where("bucket is null").select("item", "n")
    least = exact.orderBy(F.desc("n"), "item").limit(k).agg(F.min("n"), F.count("*")).first()
    least = least[0] if least[1] == k else 0
    heavy = counts.where((F.col("bucket").isNotNull()) & (F.col("n") >= least)).select("bucket")
    proven = heavy.isEmpty()
    if not proven:
        rest = own.join(F.broadcast(named.select("item")), "item", "left_anti").withColumn("bucket", bucket)
        exact = exact.union(rest.join(F.broadcast(heavy), "bucket", "left_semi").groupBy("item").agg(F.count("*").alias("n")))
    rows = F.broadcast(own.agg(F.count("*").alias("rows")))
    top = exact.orderBy(F.desc("n"), "item").limit(k)
    return top.join(F.broadcast(named.select("item", "estimate")), "item", "left").crossJoin(rows).select("item", "n", F.coalesce("estimate", F.lit(0)).alias("estimate"), "rows"), proven


def checked_top_k(df: DataFrame, column: str, k: int, tracked: int = 10_000) -> DataFrame:
    """(item, n, within) of the ``k`` most frequent values: all of them, with exact counts, and whether the sketch's count is within its error.

    A value that the sketch lacks counts as zero there.
    """
    found, _ = proven_top_k(df, column, k, tracked)
    within = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), SKETCH_ERROR * F.col("rows") / F.lit(tracked))
    return found.select("item", "n", within.alias("within")).orderBy(F.desc("n"), "item")


def merged_distinct(df: DataFrame, column: str, group: str, error: float = 0.05) -> DataFrame:
    """(exact, within): distinct values of the whole table, and whether the merged sketches of the groups are within ``error`` of it."""
    sketches = df.groupBy(group).agg(F.hll_sketch_agg(column, F.lit(14)).alias("sketch"))
    merged = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = df.agg(F.count_distinct(column).alias("exact"))
    return exact.crossJoin(F.broadcast(merged)).select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= error * F.col("exact")).alias("within"))
