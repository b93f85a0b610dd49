import pytest
from pyspark.sql import functions as F

from sparkloom.functions.digest import multiset_digest, ordered_digest
from sparkloom.operators import evidence, sets
from sparkloom.streaming.replay import prefix, windowed_counts


def test_claims(spark):
    found = {(r["status"], r["scope"]) for r in evidence.claim_matrix(spark).where("allowed").collect()}
    assert found == {(s, "historicalObservation") for s in ("verifiedMechanism", "verifiedEnvironmentSpecific", "verified")}


def test_flags(spark):
    row = spark.range(1).select(
        evidence.all_of(F.lit(True), F.lit(None).cast("boolean")).alias("missing"), evidence.all_of(F.lit(True), F.lit(True)).alias("met"),
        evidence.invariant_reuse(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)).alias("value"), evidence.trust_claim_supported(F.lit("verifiedReuse"), F.lit("coldReconstruction")).alias("trust"),
        evidence.transferable_claim_allowed(F.lit("verified"), F.lit(True), F.lit(True), F.lit(False)).alias("transfer"),
    ).first()
    assert row.asDict() == {"missing": False, "met": True, "value": 2, "trust": False, "transfer": False}


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (40000,), (None,)], "v long"), spark.createDataFrame([(40000,), (7,)], "v long")
    x, y = sets.bitmaps(a, "v"), sets.bitmaps(b, "v")
    assert sets.cardinality(sets.union(x, y)).first()[0] == 3 and sets.cardinality(sets.intersection(x, y)).first()[0] == 1
    assert [r[0] for r in sets.difference(a.where("v is not null"), b, "v").collect()] == [1]
    assert [r[0] for r in sets.contains(x, b, "v").collect()] == [40000]


def test_digests(spark):
    df = spark.createDataFrame([(i, str(i % 3)) for i in range(50)], "a long, b string")
    one = ordered_digest(df).first()
    assert one == ordered_digest(df.repartition(7)).first() and multiset_digest(df).first() == multiset_digest(df.repartition(5)).first()
    assert multiset_digest(df).first() != multiset_digest(df.limit(49)).first()


def test_prefix(spark):
    df = spark.range(5)
    assert [tuple(r) for r in prefix(df, 2).collect()] == [(0, False), (1, False)] and all(r["complete"] for r in prefix(df, 5).collect())


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", "abc"[i % 2], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["start"], r["event_type"])
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(df).collect()))


@pytest.mark.parametrize("kind", ["skewed", "flat", "few"])
@pytest.mark.parametrize("tracked", [16, 64])
def test_top_k_is_whole_with_sketches_smaller_than_the_domain(spark, kind, tracked):
    import random
    from collections import Counter

    from sparkloom.operators.approximate import checked_top_k, proven_top_k

    rng = random.Random(tracked)
    values = {"skewed": [int(rng.paretovariate(0.9)) for _ in range(20_000)], "flat": [x % 3000 for x in range(12_000)] + [7], "few": [1, 1, 2]}[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v long").repartition(3)
    want = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:5]
    found, proven = proven_top_k(df, "v", 5, tracked, buckets=512)
    assert sorted(((r["item"], r["n"]) for r in found.collect()), key=lambda x: (-x[1], x[0])) == want
    assert not (kind == "flat" and proven)
    assert [(r["item"], r["n"]) for r in checked_top_k(df, "v", 5, tracked).collect()] == want
