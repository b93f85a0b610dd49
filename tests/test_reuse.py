import threading

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sparkloom.contracts import ContractError
from sparkloom.operators.order import budgeted_best, with_ordinal, with_running_sum
from sparkloom.plans.reuse import Materialized, fastest, parity, regressions, signature
from sparkloom.plans.workload import compare
from sparkloom.sources.paths import safe_file, without_sidecars


def test_signatures(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    a = signature(read().where("id > 3"))
    assert a == signature(read().where("id > 3")) != signature(read().where("id > 4"))
    assert a != signature(read().where("id > 3"), mode=1)
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "t"))
    assert a != signature(read().where("id > 3"))


def test_written_once(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").groupBy("o_orderstatus").count()
    store, found = Materialized(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda: found.append(store.get(orders).count())) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.written == 1 and len(set(found)) == 1


def test_choice(spark):
    df = spark.range(1000)
    assert fastest({"a": lambda: df.where("id % 2 = 0"), "b": lambda: df.where("id % 2 = 0").repartition(64)}, "a", repeats=2) == "a"
    with pytest.raises(ContractError):
        fastest({"a": lambda: df, "b": lambda: df.limit(3)}, "a", repeats=1)
    assert regressions({"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.1}) == {"x": 2.0}


def test_ordinals(spark):
    rows = [(i * 7 % 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    found = sorted((r["ordinal"], r["a"], r["b"]) for r in with_ordinal(df, ["a", "b"], rows=50).collect())
    assert found == [(k, a, b) for k, (a, b) in enumerate(sorted(rows))]


def test_paths(tmp_path):
    file = tmp_path / "f.db"
    file.write_text("x")
    assert safe_file(str(file)) == file
    (tmp_path / "link").symlink_to(file)
    for bad in (f"{tmp_path}/../{tmp_path.name}/f.db", str(tmp_path / "link"), str(tmp_path), str(tmp_path / "none"), ""):
        with pytest.raises(ContractError):
            safe_file(bad)
    (tmp_path / "f.db-wal").write_text("")
    with pytest.raises(ContractError):
        without_sidecars(str(file))


def test_running_sums_of_large_groups(spark):
    """A group's rows in many ranges, null groups and ties of order with other groups."""
    rows = [("big" if i % 3 else None if i % 2 else "small", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(5)
    found = sorted((r["i"], r["used"]) for r in with_running_sum(df, ["i"], "n", "used", ["g"], rows=60).collect())
    sums, want = {}, []
    for g, i, n in rows:
        sums[g] = sums.get(g, 0) + n
        want.append((i, sums[g]))
    assert found == want
    assert with_running_sum(df.limit(0), ["i"], "n", "used").count() == 0


def test_budgeted_best(spark):
    trials = spark.createDataFrame([(1, 5, 9.0), (2, 5, 3.0), (3, 5, 3.0), (4, 5, 1.0)], "id long, cost long, score double")
    best = lambda budget: budgeted_best(trials, ["id"], "cost", "score", budget).select("id", "used", "complete").collect()
    assert [tuple(r) for r in best(15)] == [(2, 10, False)] and [tuple(r) for r in best(20)] == [(4, 20, True)] and best(4) == []


def test_parity_and_memory(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    rows = parity(lambda n: df.repartition(n).groupBy("k").count(), (1, 3, 8)).collect()
    assert [(r["tasks"], r["items"], r["same"]) for r in rows] == [(1, 7, True), (3, 7, True), (8, 7, True)]
    found = compare({"a": df.groupBy("k").count(), "b": df.groupBy("k").count()}, 1, "memory")
    assert all(x["median_bytes"] >= 0 for x in found.values())
