import random
from decimal import Decimal

import pytest

from sparkloom.contracts import ContractError
from sparkloom.operators import pareto

DIRECTIONS = {"a": "minimize", "b": "minimize", "c": "maximize"}


def brute(rows, directions):
    signs = [1 if d == "minimize" else -1 for d in directions.values()]
    key = lambda r: [s * v for s, v in zip(signs, r[1:-1])]
    good = [r for r in rows if r[-1]]
    return sorted(r[0] for r in good if not any(all(x <= y for x, y in zip(key(o), key(r))) and key(o) != key(r) for o in good))


def test_known_ledger(spark):
    rows = [("fast", 10.0, 220.0, 4.0, True), ("balanced", 12.0, 180.0, 7.0, True), ("detailed", 16.0, 250.0, 10.0, True), ("inferior", 18.0, 300.0, 3.0, True), ("invalid", 8.0, 160.0, 9.0, False)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, feasible boolean")
    found = pareto.skyline(pareto.validated(df, DIRECTIONS), DIRECTIONS)
    assert sorted(r["id"] for r in found.collect()) == ["balanced", "detailed", "fast"]


@pytest.mark.parametrize("seed", [126051, 7])
def test_random_ledgers(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{i}", rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9), rng.random() < 0.8) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, a long, b long, c long, feasible boolean").repartition(5)
    assert sorted(r["id"] for r in pareto.skyline(df, DIRECTIONS).collect()) == brute(rows, DIRECTIONS)
    assert sorted(r["id"] for r in pareto.skyline(df, DIRECTIONS, local=False).collect()) == brute(rows, DIRECTIONS)
    blocks = pareto.skyline(df.union(df), DIRECTIONS, local=False, most=60)
    assert sorted(r["id"] for r in blocks.collect()) == sorted(brute(rows, DIRECTIONS) * 2)
    two = {"a": "minimize", "b": "maximize"}
    flat = [(r[0], r[1], r[2], r[-1]) for r in rows]
    for kind in ("long", "double"):
        df2 = spark.createDataFrame([(r[0], r[1] if kind == "long" else float(r[1]), r[2] if kind == "long" else float(r[2]), r[3]) for r in flat], f"id string, a {kind}, b {kind}, feasible boolean")
        assert sorted(r["id"] for r in pareto.skyline_two(df2, two, rows=30).collect()) == brute(flat, two)


@pytest.mark.parametrize("k,cells", [(2, 1024), (3, 64), (4, 1), (8, 1024)])
def test_lattice_by_brute_force(spark, k, cells):
    rng = random.Random(k)
    metrics = {f"m{i}": ("minimize" if i % 2 else "maximize") for i in range(k)}
    rows = [(f"r{i}", *(rng.choice([rng.randint(0, 5), rng.randint(0, 100)]) for _ in range(k)), rng.random() < 0.9) for i in range(250)]
    df = spark.createDataFrame(rows, f"id string, {', '.join(f'm{i} long' for i in range(k))}, feasible boolean")
    found = pareto.skyline(df.union(df), metrics, local=False, most=0, piece=7, cells=cells)
    assert sorted(r["id"] for r in found.collect()) == sorted(brute(rows, metrics) * 2)


def test_anticorrelated_points_meet_few_cells(spark):
    # Every point of this plane is on the front.
    df = spark.range(30_000).selectExpr("cast(id as string) id", "cast(xxhash64(id) % 1000000 as double) a", "cast(xxhash64(id, 1) % 1000000 as double) b", "true feasible").selectExpr("id", "a", "b", "a + b as c", "feasible")
    points = pareto.skyline_points(df, DIRECTIONS)
    report = pareto.lattice_copies(points)
    assert report["points"] == 30_000 and report["copies"] < 2 * 0.25 * report["points"] * report["cells"]
    assert pareto.skyline(df, DIRECTIONS).count() == 30_000
    worse = df.selectExpr("id || 'x' id", "a + 5 as a", "b + 5 as b", "c - 5 as c", "feasible")
    assert pareto.skyline(df.union(worse), DIRECTIONS).where("id not like '%x'").count() == 30_000


def test_lattice_of_decimals_and_ties(spark):
    rows = [(f"r{i}", Decimal(10**30 + i % 7), Decimal(10**30 - i % 5), Decimal(i % 3), True) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, a decimal(38,0), b decimal(38,0), c decimal(38,0), feasible boolean")
    assert sorted(r["id"] for r in pareto.skyline(df, DIRECTIONS, most=0).collect()) == brute(rows, DIRECTIONS)
    assert pareto.skyline(df.limit(0), DIRECTIONS, most=-1).count() == 0


def test_refusals(spark):
    good = [("x", 1.0, 2.0, True)]
    schema = "id string, a double, b double, feasible boolean"
    two = {"a": "minimize", "b": "maximize"}
    for rows in ([("x", float("nan"), 2.0, True)], [("x", float("inf"), 2.0, True)], [("x", 1.0, 2.0, None)], [("", 1.0, 2.0, True)], good * 2):
        with pytest.raises(ContractError):
            pareto.validated(spark.createDataFrame(rows, schema), two)
    with pytest.raises(ContractError):
        pareto.validated(spark.createDataFrame(good, schema), {"a": "down", "b": "maximize"})
    with pytest.raises(ContractError):
        pareto.validated(spark.createDataFrame(good, schema), {"a": "minimize"})
