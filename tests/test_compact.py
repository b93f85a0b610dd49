"""Density-adaptive sets against Python's sets, at all densities and forms."""

import random

import pytest

from sparkloom.operators import compact as C


def drawn(density, seed, size=C.BUCKET, shift=0):
    rng = random.Random(seed)
    return [shift + x for x in range(size) if rng.random() < density]


CASES = {
    "0.001": drawn(0.001, 1), "0.01": drawn(0.01, 2), "0.06": drawn(0.06, 3), "0.07": drawn(0.07, 4), "0.5": drawn(0.5, 5), "1": drawn(1, 6), "none": [],
    "runs": [x for s in range(0, 32000, 1000) for x in range(s, s + 700)], "ends": [0, 63, 64, 32767], "negative": drawn(0.2, 7, shift=-40000), "buckets": drawn(0.01, 8, 100_000) + [2**40, 2**40 + 1, -(2**40)],
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(name, x) for name, xs in CASES.items() for x in xs * 2] + [("null", None)]
    return C.compact(spark.createDataFrame(rows, "name string, x long").repartition(4), "x", "name").cache()


def by_name(df, column="value"):
    out = {}
    for r in df.collect():
        out.setdefault(r["name"], []).append(r[column])
    return out


def test_forms(tables):
    found = by_name(C.members(tables))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in CASES.items() if v}
    kinds = {(r["name"], r["kind"]): (r["containers"], r["numbers"], r["bytes"]) for r in C.sizes(tables, "name").collect()}
    assert kinds["1", "runs"] == (1, 32768, 4) and kinds["runs", "runs"] == (1, 22400, 128)
    assert kinds["0.001", "array"][2] == 2 * len(CASES["0.001"]) and kinds["0.5", "words"][2] == 4096 and kinds["0.06", "array"][2] < 4096 == kinds["0.07", "words"][2]
    assert kinds["ends", "runs" if ("ends", "runs") in kinds else "array"][1] == 4


@pytest.mark.parametrize("op,python", [(C.union, set.union), (C.intersection, set.intersection), (C.difference, set.difference)])
def test_operations_on_mixed_forms(spark, tables, op, python):
    names = list(CASES)
    pairs = spark.createDataFrame([(f"{a}|{b}", a, b) for a in names for b in names], "name string, a string, b string")
    left = pairs.join(tables.withColumnRenamed("name", "a"), "a").select("name", "bucket", "container")
    right = pairs.join(tables.withColumnRenamed("name", "b"), "b").select("name", "bucket", "container")
    done = op(left, right, "name").cache()
    found = by_name(C.members(done))
    for a in names:
        for b in names:
            want = sorted(python(set(CASES[a]), set(CASES[b])))
            assert sorted(found.get(f"{a}|{b}", [])) == want, (a, b)
    # Every result has the form that takes the fewest bytes, and counts itself.
    for r in done.collect():
        c = r["container"]
        size = 2 * len(c["items"]) + 8 * len(c["words"])
        assert size <= min(2 * c["n"], 4096) and (c["kind"] == "words") == (len(c["words"]) == 512)


def test_membership(spark, tables):
    asked = [(x,) for x in [*range(-2, 70), 32767, 32768, -40000, -1, 2**40, 2**40 + 2, 31699, 31700, None, 5, 5]]
    values = spark.createDataFrame(asked, "bucket long")
    for name in CASES:
        found = sorted(r["bucket"] for r in C.contained(values, "bucket", tables.where(C.F.col("name") == name)).collect())
        assert found == sorted(x for (x,) in asked if x is not None and x in set(CASES[name])), name
