"""Bounded streams: broken off, taken up, branched, and written to several sinks."""

import pytest
from pyspark.sql import functions as F

from sparkloom.contracts import ContractError
from sparkloom.streaming.snapshot import Snapshot


@pytest.fixture(scope="module")
def snapshot(spark):
    return Snapshot(spark.range(95).withColumn("k", (F.col("id") * 37) % 95), ["k"], 20)


def keys(df):
    return sorted(r["k"] for r in df.collect())


def test_interrupted_and_resumed(snapshot):
    branch = snapshot.branch()
    assert not branch.complete and branch.results().count() == 0
    branch.run(most=2)
    assert keys(branch.results()) == list(range(40)) and {r["complete"] for r in branch.results().collect()} == {False}
    other = snapshot.branch(ranges=3)
    other.run(most=1)
    assert keys(other.results()) == list(range(60))  # branches have places of their own
    branch.run()
    assert keys(branch.results()) == list(range(95)) and {r["complete"] for r in branch.results().collect()} == {True}
    branch.run()
    assert branch.results().count() == 95 and not other.complete


def test_a_replayed_batch_changes_nothing(spark, snapshot):
    sinks = {"rows": lambda b: b.select("k"), "sums": lambda b: b.groupBy((F.col("k") % 3).alias("m")).agg(F.sum("k").alias("total"))}
    branch, seen = snapshot.branch(sinks), []

    def fail_once(name, number):
        seen.append((name, number))
        if (name, number) == ("rows", 1) and seen.count((name, number)) == 1:
            raise OSError("lost between two sinks")

    with pytest.raises(Exception, match="lost between"):
        branch.run(after=fail_once)
    assert not branch.complete
    branch.run(after=fail_once)
    assert seen.count(("rows", 1)) == 2 and branch.complete
    assert keys(branch.results("rows")) == list(range(95))
    totals = {r["m"]: r["total"] for r in branch.results("sums").groupBy("m").agg(F.sum("total").alias("total")).collect()}
    assert totals == {m: sum(range(m, 95, 3)) for m in range(3)}


def test_snapshots_keep_what_was(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    frozen = Snapshot(spark.read.parquet(path), ["id"], 4)
    spark.range(99).write.mode("overwrite").parquet(path)
    branch = frozen.branch()
    branch.run()
    assert branch.results().count() == 10 == frozen.df.count()
    empty = Snapshot(spark.range(0), ["id"], 4)
    branch = empty.branch()
    branch.run()
    assert branch.complete and branch.results().count() == 0
    with pytest.raises(ContractError):
        Snapshot(spark.range(1), ["id"], 0)
