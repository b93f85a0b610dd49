import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sparkloom.contracts import ContractError
from sparkloom.operators.coordination import IdLedger, heavy_keys, salted_join


def test_ids_of_batches(spark, tmp_path):
    """No id twice and no gap over batches; a repeated, differently split or half written batch gives the same ids."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey").repartition(5)
    ledger, odd = IdLedger(spark, str(tmp_path)), F.col("o_orderkey") % 2 == 1
    first, none, second = ledger.assign(orders.where(odd), "odd"), ledger.assign(orders.limit(0), "none"), ledger.assign(orders.where(~odd), "even", "id")
    n = orders.count()
    ids = sorted(r["id"] for r in first.union(second).collect())
    assert ids == list(range(n)) and none.count() == 0 and max(r["id"] for r in first.collect()) < min(r["id"] for r in second.collect())
    before = sorted(map(tuple, second.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        again = IdLedger(spark, str(tmp_path)).assign(orders.limit(3), "even")
        assert sorted(map(tuple, again.collect())) == before == sorted(map(tuple, second.repartition(9).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # The driver died between the rows and their ranges, and within the ranges.
    last = max((tmp_path / "ledger").iterdir())
    (last / "_SUCCESS").unlink()
    assert sorted(map(tuple, ledger.assign(orders.where(~odd), "even").collect())) == before
    shutil.rmtree(last)
    (tmp_path / "rows" / "even" / "_SUCCESS").unlink()
    assert sorted(r["id"] for r in first.union(ledger.assign(orders.where(~odd), "even")).collect()) == ids
    assert ledger.ranges().agg({"rows": "sum"}).first()[0] == n
    with pytest.raises(ContractError):
        ledger.assign(orders, "../up")
    with pytest.raises(ContractError):
        ledger.assign(orders, "clash", "o_custkey")


def test_salted_join(spark):
    """Every row of the plain join once, also for repeated rows and nulls; no part of a key is much over its bound."""
    rows = [(i, "hot" if i % 3 else f"k{i % 50}" if i % 4 else None) for i in range(6000)]
    left = spark.createDataFrame(rows + [(1, "hot")] * 3, "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k9", 4), (None, 5), ("absent", 6)], "k string, w int")
    found = salted_join(left, right, "k", 500, F.col("id"))
    plain = left.join(right, "k")
    assert sorted(map(tuple, found.select("k", "id", "w").collect())) == sorted(map(tuple, plain.select("k", "id", "w").collect()))
    assert [tuple(r) for r in heavy_keys(left, "k", 500).collect()] == [("hot", 4003, 9)]
    sizes = [r["count"] for r in found.where("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) == 9 and max(sizes) / 2 < 500 * 1.25
    assert salted_join(left.limit(0), right, "k", 5, F.col("id")).count() == 0
