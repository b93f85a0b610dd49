import itertools
import random
from decimal import Decimal

import pytest

from sparkloom.contracts import ContractError
from sparkloom.operators import blocks, pairs


def array(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"idx long, value {kind}")


def brute(a, b):
    return sorted((x + y, i, j) for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_small_arrays_in_one_job(spark):
    """All arrays over -1, 0, 1 of up to two elements, told apart by a case number in the index."""
    cases = list(itertools.product([v for n in range(3) for v in itertools.product((-1, 0, 1), repeat=n)], repeat=2))
    for a, b in random.Random(5).sample(cases, 12):
        found = rows(pairs.ordered(pairs.pair_sums(array(spark, a), array(spark, b))))
        assert found == brute(a, b)


@pytest.mark.parametrize("modulus", [1, 2, 4, 6])
def test_residues_agree(spark, modulus):
    a, b = [-7, -1, 0, 3, 3, 8], [5, -2, 0, 0, 9]
    for residue in (0, 1, modulus - 1, 1 - 2 * modulus):
        want = [p for p in brute(a, b) if p[0] % modulus == residue % modulus]
        by_filter = pairs.pairs_by_filter(array(spark, a), array(spark, b), modulus, residue)
        by_join = pairs.pairs_by_residue(array(spark, a), array(spark, b), modulus, residue)
        assert sorted(rows(by_filter)) == sorted(rows(by_join)) == want
        assert pairs.residue_count(array(spark, a), array(spark, b), modulus, residue).first()[0] == len(want)


def test_prefix_is_the_first_pairs(spark):
    a, b = [5, 1, 1, 9, -3], [2, 2, -8, 0]
    for k in (1, 3, 19, 50):
        assert rows(pairs.pair_prefix(array(spark, a), array(spark, b), k)) == brute(a, b)[:k]
    assert rows(pairs.peek(pairs.pair_sums(array(spark, a), array(spark, b)))) == brute(a, b)[:1]
    assert rows(pairs.peek(pairs.pair_sums(array(spark, []), array(spark, b)))) == []


def test_equal_sums(spark):
    a, b, c, d = [0, 1, 1], [2, 2], [1, 3], [0, 1, 2]
    left, right = brute(a, b), brute(c, d)
    want = sorted((k, i, j, m, n) for k, i, j in left for k2, m, n in right if k == k2)
    arrays = [array(spark, x) for x in (a, b, c, d)]
    for buffer, hint in ((1, None), (5, "merge"), (64, "shuffle_hash")):
        assert sorted(rows(pairs.equal_sum_join(*arrays, buffer=buffer, hint=hint))) == want
    assert rows(pairs.equal_sum_count(*arrays)) == [(len(want), 2)]


def test_ties_are_whole(spark):
    arrays = [array(spark, [0] * n) for n in (7, 5, 6, 4)]
    assert pairs.equal_sum_join(*arrays).count() == 840


def test_wide_numbers(spark):
    big = 10**37
    found = rows(pairs.pair_sums(array(spark, [Decimal(big), Decimal(-big)], "decimal(38,0)"), array(spark, [Decimal(1)], "decimal(38,0)")))
    assert sorted(int(r[0]) for r in found) == [1 - big, 1 + big]


def test_refusals(spark):
    with pytest.raises(ContractError):
        pairs.validated(spark.createDataFrame([(0, 1.5)], "idx long, value double"))
    with pytest.raises(ContractError):
        pairs.validated(spark.createDataFrame([(0, None)], "idx long, value long"))
    with pytest.raises(ContractError):
        pairs.admit(array(spark, [1] * 10), array(spark, [1] * 10), 99)
    for buffer in (0, True, 1.0):
        with pytest.raises(ContractError):
            pairs.equal_sum_join(*[array(spark, [1])] * 4, buffer=buffer)
    with pytest.raises(ContractError):
        pairs.pairs_by_residue(array(spark, [1]), array(spark, [1]), 0, 0)


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="overflow"):
        pairs.pair_sums(array(spark, [2**63 - 1]), array(spark, [1])).collect()


def test_residue_plan_is_an_equal_join(spark):
    df = pairs.pairs_by_residue(array(spark, range(50)), array(spark, range(50)), 7, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_numbers_of_any_length(spark):
    rng = random.Random(20261008)
    draw = lambda: [rng.choice([10**80, -(10**80), 3, -3, 0]) + rng.randint(-5, 5) for _ in range(6)]
    a, b = draw(), draw()
    first, second = (array(spark, list(map(str, x)), "string") for x in (a, b))
    found = [(int(r[0]), r[1], r[2]) for r in pairs.wide_pair_sums(first, second).orderBy(*pairs.wide_order(), "left", "right").collect()]
    assert found == brute(a, b)
    m = 10**81 + 12
    for residue in (0, sum(brute(a, b)[3][:1]) - 2 * m):
        got = sorted((int(r[0]), r[1], r[2]) for r in pairs.wide_pair_sums(first, second, m, residue).collect())
        assert got == [p for p in brute(a, b) if (p[0] - residue) % m == 0]


@pytest.mark.parametrize("size", [3, 100])
def test_blocks_skip_nothing_that_counts(spark, size):
    rng = random.Random(size)
    a, b, c, d = ([rng.choice([rng.randint(-20, 20), rng.randint(-500, 500), 7]) for _ in range(n)] for n in (20, 13, 9, 11))
    A, B, C, D = (array(spark, x) for x in (a, b, c, d))
    for low, high in ((-10, 10), (900, 2000), (-5000, 5000)):
        assert sorted(rows(blocks.sums_between(A, B, low, high, size))) == [x for x in brute(a, b) if low <= x[0] <= high]
    want = sorted((k, i, j, m, n) for k, i, j in brute(a, b) for q, m, n in brute(c, d) if k == q)
    assert sorted(rows(blocks.pruned_equal_sums(A, B, C, D, size).select("key", "l_left", "l_right", "r_left", "r_right"))) == want


def test_blocks_of_other_ranges_are_skipped(spark):
    A, B = array(spark, range(200)), array(spark, range(0, 2000, 10))
    C, D = array(spark, range(1900, 2000)), array(spark, range(100))
    share = {r["side"]: r for r in blocks.pruned_share(A, B, C, D, 10).collect()}
    assert share["left"]["blocks"] == 400 and share["left"]["kept"] < 60 and share["right"]["kept"] == share["right"]["blocks"] == 100
    assert blocks.pruned_equal_sums(A, B, C, D, 10).count() == pairs.equal_sum_join(A, B, C, D).count()
    apart = array(spark, [10**6])
    assert blocks.pruned_share(A, B, apart, D, 10).where("kept > 0").count() == 0 and blocks.pruned_equal_sums(A, B, apart, D, 10).count() == 0
    empty = array(spark, [])
    assert blocks.pruned_equal_sums(A, empty, C, D).count() == 0 and blocks.sums_between(empty, B, 0, 9).count() == 0
    wide = array(spark, [Decimal(10**37), Decimal(-(10**37))], "decimal(38,0)")
    assert blocks.sums_between(wide, array(spark, [Decimal(1)], "decimal(38,0)"), Decimal(0), Decimal(2 * 10**37)).count() == 1
