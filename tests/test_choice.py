import pytest
from pyspark.sql import functions as F

from sparkloom.contracts import ContractError
from sparkloom.plans.choice import Calibrated, Route


def routes(spark):
    plain = lambda n: spark.range(n).agg(F.sum("id").alias("s"))
    return {"scan": Route(plain, lambda n: n), "index": Route(lambda n: plain(n).repartition(2), lambda n: 1)}


def test_choice_flips_with_size(spark, tmp_path):
    own, store = routes(spark), Calibrated(spark, str(tmp_path / "m"))
    own["index"] = Route(own["index"].plan, lambda n: n**0.5)
    store.record([("scan", 100, 1.5), ("scan", 300, 3.5), ("index", 10, 2.1), ("index", 20, 2.2)])
    assert {k: tuple(round(x, 9) for x in v) for k, v in store.lines().items()} == {"scan": (0.5, 0.01), "index": (2.0, 0.01)}
    assert [store.choose(own, n, "scan") for n in (1, 100, 10_000)] == ["scan", "scan", "index"]
    assert store.choose(own, 200, "scan") == "index" and store.choose(own, 200, "scan", 0.5) == "scan"
    # Later measures move the line, in another session of the folder too.
    store.record([("index", 10, 90.0), ("index", 20, 95.0)])
    assert Calibrated(spark, str(tmp_path / "m")).choose(own, 200, "scan") == "scan"


def test_calibration(spark, tmp_path):
    own, store = routes(spark), Calibrated(spark, str(tmp_path / "m"))
    store.calibrate(own, [10, 1000])
    lines = store.lines()
    assert set(lines) == {"scan"} and min(lines["scan"]) >= 0  # the other one's work was always the same
    assert store.choose(own, 10**6, "index") == "index" and store.choose(own, 10**6, "scan") == "scan"
    odd = own | {"index": Route(lambda n: spark.range(n + 1).agg(F.sum("id").alias("s")), lambda n: n)}
    with pytest.raises(ContractError):
        store.calibrate(odd, [50])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    with pytest.raises(ContractError):
        store.choose(own, 1, "none")


def test_lines_below_zero(spark, tmp_path):
    store = Calibrated(spark, str(tmp_path / "m"))
    store.record([("a", 10, 1.0), ("a", 20, 4.0), ("b", 10, 5.0), ("b", 20, 4.0)])
    assert store.lines() == {"a": (0.0, 2.5 / 15), "b": (4.5, 0.0)}
