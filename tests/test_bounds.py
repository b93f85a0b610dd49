from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkloom.contracts import ContractError
from sparkloom.operators import bounds

CASES = [
    # name, numerator, denominator, lower, strict, splits, status, leaves
    ("direct", "1,1", "1", "0", False, 16, "certified", 1),
    ("coarse", "13/50,-1,1", "1", "1/100", False, 0, "inconclusive", 1),
    ("subdivision", "13/50,-1,1", "1", "1/100", False, 16, "certified", 2),
    ("violation", "-1,1", "1", "0", False, 16, "violated", 1),
    ("boundary", "0,0,1", "1", "0", False, 16, "certified", 1),
    ("boundary strict", "0,0,1", "1", "0", True, 16, "violated", 1),
    ("rational", "1", "1,1", "0", False, 16, "certified", 1),
    ("crossing", "1", "-1,2", "0", False, 16, "invalid_domain", 1),
    ("zero", "0", "0,1", "0", False, 16, "invalid_domain", 1),
    ("near zero", "1", "1/1000000,1", "0", False, 16, "certified", 1),
    ("denominator coarse", "1", "13/50,-1,1", "0", False, 0, "inconclusive", 1),
    ("denominator subdivision", "1", "13/50,-1,1", "0", False, 16, "certified", 2),
]


def problem(case):
    return {"numerator": case[1].split(","), "denominator": case[2].split(","), "domain": ["0", "1"], "lower": case[3], "strict": case[4]}


def frame(spark, cases):
    return spark.createDataFrame([(c[0], *problem(c).values()) for c in cases], f"name string, {bounds.PROBLEM}")


@pytest.mark.parametrize("splits", [0, 16])
def test_statuses(spark, splits):
    cases = [c for c in CASES if c[5] == splits]
    rows = bounds.verify_rows(bounds.certify_rows(frame(spark, cases), splits)).collect()
    found = {r["name"]: (r["certificate"]["status"], len(r["certificate"]["leaves"]), r["verified"]) for r in rows}
    assert found == {c[0]: (c[6], c[7], c[6]) for c in cases}


def test_changed_certificates_are_refused(spark):
    good = bounds.certify_rows(frame(spark, [CASES[2]])).first()["certificate"].asDict(recursive=True)
    leaf, other = good["leaves"]
    witness = lambda x, kind: {"witness": {"x": x, "kind": kind}}
    changes = [
        {"status": "violated"}, {"problem_sha256": "0" * 64}, {"problem_sha256": None}, {"max_splits": 0}, {"max_splits": 65}, {"max_splits": None},
        {"leaves": [leaf]}, {"leaves": [other, leaf]}, {"leaves": [leaf | {"path": "1"}, other]}, {"leaves": [leaf | {"residual": ["2", *leaf["residual"][1:]]}, other]},
        {"leaves": [leaf | {"denominator": [*leaf["denominator"], "1"]}, other]}, {"leaves": [leaf | {"residual": None}, other]}, {"leaves": [leaf | {"residual": ["2/4", *leaf["residual"][1:]]}, other]},
        witness("1/2", "violation"), witness("2/4", "violation"), witness("3", "invalid_domain"), witness("1/2", None), {"leaves": []}, {"leaves": None}, {"leaves": [leaf, other | {"path": "2"}]}, {"leaves": [leaf, leaf, other]},
    ]
    rows = [(str(i), *problem(CASES[2]).values(), good | change) for i, change in enumerate([{}, *changes])]
    certified = spark.createDataFrame(rows, f"name string, {bounds.PROBLEM}, certificate {bounds.CERTIFICATE}")
    found = {r["name"]: r["verified"] for r in bounds.verify_rows(certified).collect()}
    assert found == {"0": "certified"} | {str(i): None for i in range(1, len(changes) + 1)}


def test_changed_problems_are_refused(spark):
    certified = bounds.certify_rows(frame(spark, [CASES[2]]))
    for name, value in (("lower", F.lit("1/50")), ("strict", F.lit(True)), ("domain", F.array(F.lit("0"), F.lit("2"))), ("denominator", F.array(F.lit("2"))), ("numerator", F.array(F.lit("1")))):
        assert bounds.verify_rows(certified.withColumn(name, value)).first()["verified"] is None


def test_refused_problems(spark):
    for key, value in (("numerator", []), ("numerator", ["1", "0"]), ("numerator", ["2/4"]), ("numerator", ["1", None]), ("numerator", ["3/1"]), ("numerator", ["-0"]), ("domain", ["1", "0"]), ("lower", "x"), ("lower", str(1 << 200)), ("strict", None), ("numerator", ["1"] * 14)):
        with pytest.raises(Exception) as caught:
            bounds.certify_rows(spark.createDataFrame([tuple((problem(CASES[0]) | {key: value}).values())], bounds.PROBLEM)).collect()
        assert "Contract" in caught.typename or "ContractError" in str(caught.value)
    with pytest.raises(ContractError):
        bounds.certify_rows(frame(spark, CASES[:1]), 65)
    assert bounds.verify_rows(bounds.certify_rows(frame(spark, CASES).limit(0))).count() == 0


def test_coefficients():
    """A quadratic and a cubic on [1, 3]: ends are values, and halves agree with the whole at the middle."""
    for p in ([5, -2, 1], [0, 1, 0, 7]):
        p = [Fraction(x) for x in p]
        at = lambda x, p=p: sum(c * x**k for k, c in enumerate(p))
        b = bounds.on_interval(p, Fraction(1), Fraction(3))
        assert (b[0], b[-1]) == (at(1), at(3))
        whole, scale = bounds.scaled(b)
        first, last = bounds.halves(whole)
        assert first[-1] == last[0] == at(2) * scale * 2 ** (len(p) - 1)
        assert [x / Fraction(scale << (len(p) - 1)) for x in first] == bounds.on_interval(p, Fraction(1), Fraction(2))


def test_replay(spark):
    frozen = spark.createDataFrame([("direct", "certified"), ("violation", "certified"), ("gone", "violated")], "name string, status string")
    found = {r["name"]: (r["status"], r["agrees"]) for r in bounds.replay(frame(spark, [CASES[0], CASES[3], CASES[4]]), frozen).collect()}
    assert found == {"direct": ("certified", True), "violation": ("violated", False), "boundary": ("certified", False), "gone": (None, False)}


TOUCHING = [
    # name, numerator, denominator, lower, strict, status of the certificate, settled
    ("third", "1,-6,9", "1", "0", False, "inconclusive", "certified"), ("third strict", "1,-6,9", "1", "0", True, "inconclusive", "violated"), ("two thirds", "4,-12,9", "1", "0", False, "inconclusive", "certified"),
    ("half", "1,-4,4", "1", "0", False, "certified", "certified"), ("outside", "16,-24,9", "1", "0", True, "certified", "certified"), ("below", "1,-7,9", "1", "0", False, "violated", "violated"),
    ("denominator", "1", "1,-6,9", "0", False, "inconclusive", "invalid_domain"), ("fourth power", "1,-12,54,-108,81", "1", "0", False, "inconclusive", "certified"),
]


def test_bounds_touched_between_halves_are_settled(spark):
    rows = bounds.settle_rows(bounds.verify_rows(bounds.certify_rows(frame(spark, TOUCHING), 64))).collect()
    assert {r["name"]: (r["verified"], r["settled"]) for r in rows} == {c[0]: (c[5], c[6]) for c in TOUCHING}


def test_exact_status_is_that_of_the_factors():
    import random

    rng = random.Random(5)
    for _ in range(400):
        roots = [Fraction(rng.randint(-2, 8), rng.choice([3, 5, 6])) for _ in range(rng.randint(0, 4))]
        lead = Fraction(rng.choice([-2, -1, 1, 3]))
        p = [lead]
        for r in roots:
            p = [(p[k - 1] if k else 0) - r * (p[k] if k < len(p) else 0) for k in range(len(p) + 1)]
        points = sorted({Fraction(0), Fraction(1), *(r for r in roots if 0 <= r <= 1)})
        points += [(a + b) / 2 for a, b in zip(points, points[1:])]
        values = [bounds._value(p, x) for x in points]
        for strict in (False, True):
            expected = "violated" if min(values) < 0 or (strict and min(values) == 0) else "certified"
            assert bounds.exact_status(p, [Fraction(1)], Fraction(0), Fraction(1), strict) == expected, (roots, lead, strict)
        expected = "certified" if min(values) > 0 else "invalid_domain"
        assert bounds.exact_status([Fraction(1)], p, Fraction(0), Fraction(1), False) == expected, (roots, lead)


def test_quadratics_of_all_sizes_have_a_sign(spark, duck, tmp_path):
    from sparkloom.plans.queries import ORACLE_SQL, QUERIES

    path = f"{tmp_path}/part.parquet"
    duck.sql(f"copy (select p_name, p_brand, p_type, p_retailprice, k::bigint as p_partkey, s::int as p_size from (select * from part limit 1), (values (15071, 21), (16992, 24), (15072, 21), (9, 20)) v(k, s)) to '{path}' (format parquet)")
    found = {tuple(r) for r in QUERIES["certified_quadratic"](spark, str(tmp_path)).collect()}
    assert found == set(duck.sql(ORACLE_SQL["certified_quadratic"].replace("FROM part)", f"FROM '{path}')")).fetchall())
