"""Exact lower bounds of rational functions: certificates of Bernstein coefficients, and their check.

A problem asks whether numerator / denominator >= lower (or > lower) on a
closed interval where the denominator must be positive.  Coefficients and
interval ends are canonical rationals as strings, lowest degree first.  An
Arrow-batched function halves the interval and gives each problem's leaves; all
that follows from them (status, coverage, validity) are column expressions over
the array of leaves, so neither step shuffles.

Numbers inside are whole: coefficients are kept times a positive scale, which
changes no sign.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import pairwise
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import require, require_rows

#: Limits of a problem: degree, bits of a rational, splits and depth of the subdivision.
DEGREE, BITS, SPLITS, DEPTH = 12, 128, 64, 32

PROBLEM = "numerator array<string>, denominator array<string>, domain array<string>, lower string, strict boolean"
FIELDS = ("numerator", "denominator", "domain", "lower", "strict")
LEAVES = "array<struct<path:string,residual:array<string>,denominator:array<string>>>"
CERTIFICATE = f"struct<problem_sha256:string,max_splits:int,status:string,leaves:{LEAVES},witness:struct<x:string,kind:string>>"
#: Canonical rationals, but for common factors.
NUMBER = r"^(0|-?[1-9][0-9]*(/([2-9]|[1-9][0-9]+))?)$"


# --- whole numbers with a scale


def number(text: str, bits: int | None = None) -> Fraction:
    """A canonical rational; ``text`` fits NUMBER."""
    top, _, bottom = text.partition("/")
    top, bottom = int(top), int(bottom or 1)
    require(gcd(top, bottom) == 1, "rationals have no common factor")
    require(bits is None or max(top.bit_length(), bottom.bit_length()) <= bits, "too many bits")
    return Fraction(top, bottom)


def scaled(values) -> tuple[list[int], int]:
    """Whole numbers and the scale that they were multiplied by."""
    scale = lcm(*(v.denominator for v in values))
    return [v.numerator * (scale // v.denominator) for v in values], scale


def on_interval(powers: list[Fraction], left: Fraction, right: Fraction) -> list[Fraction]:
    """Bernstein coefficients on an interval, by Horner's rule: times x raises the degree by one, plus c adds c to each."""
    out = [powers[-1]]
    for c in powers[-2::-1]:
        n = len(out)
        out = [c + ((n - i) * left * (out[i] if i < n else 0) + i * right * (out[i - 1] if i else 0)) / n for i in range(n + 1)]
    return out


def halves(b: list[int]) -> tuple[list[int], list[int]]:
    """De Casteljau's triangle at the middle: coefficients of both halves, times 2 to the degree."""
    first, last, n = [], [], len(b) - 1
    for k in range(n + 1):
        first.append(b[0] << (n - k))
        last.append(b[-1] << (n - k))
        b = [x + y for x, y in pairwise(b)]
    return first, last[::-1]


def leaves_of(residual: list[int], denominator: list[int], strict: bool, splits: int) -> tuple[list[tuple[str, list[int], list[int]]], dict[str, Fraction]]:
    """Leaves from left to right, and by kind the leftmost point seen to break the bound or the domain (as a share of the interval).

    The leftmost unresolved leaf is split next, so leaves are taken from a
    stack.  Once the bound is seen broken, only the domain is left to prove.
    """
    seen: dict[str, Fraction] = {}

    def probe(path, at, r, d):
        kind = "invalid_domain" if d <= 0 else "violation" if r < 0 or (strict and r == 0) else None
        if kind:
            x = (int(path or "0", 2) + at) / Fraction(1 << len(path))
            seen[kind] = min(x, seen.get(kind, x))

    out, stack, least = [], [("", residual, denominator, halves(residual), halves(denominator))], 1 if strict else 0
    for at, k in ((Fraction(0), 0), (Fraction(1), -1)):
        probe("", at, residual[k], denominator[k])
    probe("", Fraction(1, 2), halves(residual)[1][0], halves(denominator)[1][0])
    while stack:
        path, r, d, rs, ds = stack.pop()
        proved = min(d) > 0 and ("violation" in seen or min(r) >= least)
        if proved or "invalid_domain" in seen or not splits or len(path) == DEPTH:
            out.append((path, r, d))
            continue
        splits -= 1
        for side in (1, 0):
            own = path + "01"[side], rs[side], ds[side], halves(rs[side]), halves(ds[side])
            probe(own[0], Fraction(1, 2), own[3][1][0], own[4][1][0])
            stack.append(own)
    return out, seen


def _value(p: list[Fraction], x: Fraction) -> Fraction:
    total = Fraction(0)
    for c in reversed(p):
        total = total * x + c
    return total


def _divided(p: list[Fraction], q: list[Fraction]) -> tuple[list[Fraction], list[Fraction]]:
    """Quotient and remainder; zero is the empty list."""
    p, out = list(p), [Fraction(0)] * max(len(p) - len(q) + 1, 0)
    while len(p) >= len(q):
        k, c = len(p) - len(q), p[-1] / q[-1]
        out[k] = c
        p = [a - c * q[i - k] if i >= k else a for i, a in enumerate(p[:-1])]
        while p and not p[-1]:
            p.pop()
    return out, p


def _slope(p: list[Fraction]) -> list[Fraction]:
    return [k * c for k, c in enumerate(p)][1:]


def _common(p: list[Fraction], q: list[Fraction]) -> list[Fraction]:
    while q:
        p, q = q, _divided(p, q)[1]
    return [c / p[-1] for c in p]


def once(p: list[Fraction]) -> list[Fraction]:
    """The polynomial with each of its roots once."""
    return _divided(p, _common(p, _slope(p)))[0]


def odd_part(p: list[Fraction]) -> list[Fraction]:
    """The roots of odd multiplicity, once each, with the polynomial's leading coefficient: what is left out is a square."""
    lead, rest, odd, at = p[-1], p, [Fraction(1)], 1
    while len(rest) > 1:
        common = _common(rest, _slope(rest))
        all_of, deeper = _divided(rest, common)[0], common
        # Roots of exactly this multiplicity: those of the rest that its common factor with the slope lacks.
        own = _divided(all_of, _common(all_of, deeper))[0]
        if at % 2:
            odd = [sum(odd[i] * own[k - i] for i in range(len(odd)) if 0 <= k - i < len(own)) for k in range(len(odd) + len(own) - 1)]
        rest, at = common, at + 1
    return [c * lead / odd[-1] for c in odd]


def roots_within(p: list[Fraction], left: Fraction, right: Fraction) -> int:
    """Roots in (left, right] of a polynomial without multiple roots, by Sturm's chain."""
    chain = [p, _slope(p)]
    while chain[-1]:
        chain.append([-c for c in _divided(chain[-2], chain[-1])[1]])
    changes = []
    for x in (left, right):
        signs = [v > 0 for v in (_value(q, x) for q in chain[:-1]) if v]
        changes.append(sum(a != b for a, b in pairwise(signs)))
    return changes[0] - changes[1]


def exact_status(residual: list[Fraction], denominator: list[Fraction], left: Fraction, right: Fraction, strict: bool) -> str:
    """certified, violated or invalid_domain, from roots instead of leaves: also where the bound is only touched, between all halves."""
    middle = (left + right) / 2
    if _value(denominator, left) <= 0 or roots_within(once(denominator), left, right):
        return "invalid_domain"
    if not any(residual):
        return "violated" if strict else "certified"
    if strict:
        return "certified" if _value(residual, left) > 0 and not roots_within(once(residual), left, right) else "violated"
    h = odd_part(residual)
    inside = roots_within(h, left, right) - (_value(h, right) == 0)
    return "certified" if not inside and _value(h, middle) > 0 else "violated"


class Parsed:
    """A problem's numbers: residual = numerator - lower * denominator, without leading zeros."""

    def __init__(self, numerator, denominator, domain, lower):
        n, self.denominator = ([number(t, BITS) for t in p] for p in (numerator, denominator))
        self.left, self.right = (number(t, BITS) for t in domain)
        require(self.left < self.right, "the interval has a length")
        bound, width = number(lower, BITS), max(len(n), len(self.denominator))
        at = lambda p, k: p[k] if k < len(p) else Fraction(0)
        self.residual = [at(n, k) - bound * at(self.denominator, k) for k in range(width)]
        while len(self.residual) > 1 and not self.residual[-1]:
            self.residual.pop()


def _texts(values: list[int], scale: int) -> list[str]:
    return [str(Fraction(v, scale)) for v in values]


# --- columns


def checked(problems: DataFrame) -> DataFrame:
    """``problems``, after a check of their form; nulls break it."""
    plain = lambda c: F.col(c).rlike(NUMBER) & (F.length(c) <= 80)
    numbers = lambda c: F.forall(c, lambda t: t.rlike(NUMBER) & (F.length(t) <= 80))
    polynomial = lambda c: F.size(c).between(1, DEGREE + 1) & numbers(c) & ((F.size(c) == 1) | (F.element_at(c, -1) != "0"))
    return require_rows(problems, numerator=polynomial("numerator"), denominator=polynomial("denominator"), domain=(F.size("domain") == 2) & numbers("domain"), lower=plain("lower"), strict=F.col("strict").isNotNull())


def identity() -> Column:
    """SHA-256 of a problem's fields as JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(FIELDS))), 256)


def certify_rows(problems: DataFrame, max_splits: int = 16) -> DataFrame:
    """All columns of ``problems`` (with those of PROBLEM) and ``certificate``: certified, violated, invalid_domain or inconclusive, with its leaves."""
    require(isinstance(max_splits, int) and not isinstance(max_splits, bool) and 0 <= max_splits <= SPLITS, "the split budget is out of bounds")

    @F.pandas_udf(f"leaves {LEAVES}, proved boolean, domain boolean, invalid string, violation string")
    def solve(numerator, denominator, domain, lower, strict):
        import pandas as pd

        rows = []
        for *fields, is_strict in zip(numerator, denominator, domain, lower, strict):
            p = Parsed(*fields)
            width = p.right - p.left
            (r, r_scale), (d, d_scale) = (scaled(on_interval(x, p.left, p.right)) for x in (p.residual, p.denominator))
            found, seen = leaves_of(r, d, bool(is_strict), max_splits)
            leaves = [{"path": path, "residual": _texts(x, r_scale << (len(path) * (len(x) - 1))), "denominator": _texts(y, d_scale << (len(path) * (len(y) - 1)))} for path, x, y in found]
            proved, domain_ok = all(min(x) >= bool(is_strict) for _, x, _ in found), all(min(y) > 0 for *_, y in found)
            points = [str(p.left + width * seen[k]) if k in seen else None for k in ("invalid_domain", "violation")]
            rows.append((leaves, proved and domain_ok, domain_ok, *points))
        return pd.DataFrame(rows, columns=["leaves", "proved", "domain", "invalid", "violation"])

    # The work is in the rows, few as their bytes may be: they are dealt out before.
    width = int(problems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = checked(problems).repartition(width).withColumn("_found", solve(*FIELDS))
    f = lambda name: F.col(f"_found.{name}")
    status = F.when(f("invalid").isNotNull(), "invalid_domain").when(f("violation").isNotNull() & f("domain"), "violated").when(f("proved"), "certified").otherwise("inconclusive")
    point = F.when(status == "invalid_domain", f("invalid")).when(status == "violated", f("violation"))
    kind = F.when(status == "invalid_domain", "invalid_domain").otherwise("violation")
    witness = F.when(point.isNotNull(), F.struct(point.alias("x"), kind.alias("kind")))
    certificate = F.struct(identity().alias("problem_sha256"), F.lit(max_splits).alias("max_splits"), status.alias("status"), f("leaves").alias("leaves"), witness.alias("witness"))
    return found.withColumn("certificate", certificate).drop("_found")


def _same(powers: list[Fraction], left: Fraction, width: Fraction, claimed: list[Fraction]) -> bool:
    """Whether claimed Bernstein coefficients are those of a polynomial: both agree at degree + 1 points, in whole numbers."""
    n = len(powers) - 1
    if len(claimed) != n + 1:
        return False
    (b, b_scale), (p, p_scale), ((start, step), unit) = scaled(claimed), scaled(powers), scaled([left, width])
    for t in range(n + 1):
        row = b
        while len(row) > 1:
            row = [(1 - t) * x + t * y for x, y in pairwise(row)]
        x, total, power = start + step * t, 0, 1
        for c in reversed(p):
            total, power = total * x + c * power, power * unit
        if total * b_scale * unit != row[0] * p_scale * power:
            return False
    return True


def verify_rows(certified: DataFrame) -> DataFrame:
    """All columns and ``verified``: the certificate's status if an independent check bears it out, else null.

    Coefficients and the witness are recomputed; that leaves follow each other
    and cover the interval, their number, and what status follows are column
    expressions.
    """

    @F.pandas_udf("ok boolean, proved boolean, domain boolean, shown string")
    def recompute(numerator, denominator, domain, lower, strict, leaves, x):
        import pandas as pd

        rows = []
        for a, b, c, d, is_strict, own, point in zip(numerator, denominator, domain, lower, strict, leaves, x):
            p = Parsed(a, b, c, d)
            try:
                ok, proved, positive = True, True, True
                for leaf in own:
                    path = leaf["path"]
                    width = (p.right - p.left) / (1 << len(path))
                    left = p.left + width * int(path or "0", 2)
                    r, y = ([number(t) for t in leaf[k]] for k in ("residual", "denominator"))
                    ok = ok and _same(p.residual, left, width, r) and _same(p.denominator, left, width, y)
                    proved, positive = proved and min(r) >= 0 and (not is_strict or min(r) > 0), positive and min(y) > 0
                shown = None
                if point is not None:
                    at = number(point)
                    r, y = (sum(v * at**k for k, v in enumerate(q)) for q in (p.residual, p.denominator))
                    inside = p.left <= at <= p.right
                    shown = None if not inside else "invalid_domain" if y <= 0 else "violation" if r < 0 or (is_strict and r == 0) else None
            except ValueError:
                ok, proved, positive, shown = False, False, False, None
            rows.append((ok, proved and positive, positive, shown))
        return pd.DataFrame(rows, columns=["ok", "proved", "domain", "shown"])

    c = lambda name: F.col(f"certificate.{name}")
    numbers = lambda a: (F.size(a) > 0) & F.forall(a, lambda t: t.rlike(NUMBER) & (F.length(t) <= 4096))
    form = F.size(c("leaves")).between(1, c("max_splits") + 1) & c("max_splits").between(0, SPLITS) & (c("problem_sha256") == identity())
    form &= F.forall(c("leaves"), lambda leaf: leaf["path"].rlike(f"^[01]{{0,{DEPTH}}}$") & numbers(leaf["residual"]) & numbers(leaf["denominator"]))
    form &= c("witness").isNull() | (c("witness.x").rlike(NUMBER) & (F.length(c("witness.x")) <= 200) & c("witness.kind").isNotNull())
    # A leaf ends where the next begins, in units of the smallest leaf; -1 once it doesn't.
    start = lambda leaf: F.coalesce(F.conv(F.when(leaf["path"] != "", F.rpad(leaf["path"], DEPTH, "0")), 2, 10).cast("long"), F.lit(0))
    width = lambda leaf: F.expr(f"shiftleft(1L, {DEPTH})") / F.pow(F.lit(2.0), F.length(leaf["path"]))
    end = F.aggregate(c("leaves"), F.lit(0).cast("long"), lambda at, leaf: F.when(at == start(leaf), at + width(leaf).cast("long")).otherwise(F.lit(-1)).cast("long"))
    sound = F.coalesce(form & (end == 1 << DEPTH), F.lit(False))
    rows = checked(certified).withColumn("_sound", sound)
    safe = lambda col: F.when(F.col("_sound"), col)
    rows = rows.withColumn("_again", recompute(*FIELDS, F.coalesce(safe(c("leaves")), F.from_json(F.lit("[]"), LEAVES)), safe(c("witness.x"))))
    again = lambda name: F.col(f"_again.{name}")
    kind = c("witness.kind")
    witnessed = F.when(kind == "invalid_domain", "invalid_domain").when((kind == "violation") & again("domain"), "violated")
    follows = F.when(c("witness").isNull(), F.when(again("proved"), "certified").otherwise("inconclusive")).when(again("shown") == kind, witnessed)
    return rows.withColumn("verified", F.when(F.col("_sound") & again("ok") & (follows == c("status")), c("status"))).drop("_sound", "_again")


def settle_rows(verified: DataFrame) -> DataFrame:
    """All columns of verify_rows() and ``settled``: the verified status, and the exact one where a sound certificate leaves it inconclusive.

    A bound that is touched at a point which no halving meets (a third, say) has
    no certificate of any number of splits.
    """

    @F.pandas_udf("string")
    def exact(numerator, denominator, domain, lower, strict, status):
        import pandas as pd

        out = []
        for *fields, is_strict, known in zip(numerator, denominator, domain, lower, strict, status):
            if known == "inconclusive":
                p = Parsed(*fields)
                known = exact_status(p.residual, p.denominator, p.left, p.right, bool(is_strict))
            out.append(known)
        return pd.Series(out, dtype=object)

    return verified.withColumn("settled", exact(*FIELDS, "verified"))


def replay(problems: DataFrame, frozen: DataFrame, max_splits: int = 16, key: str = "name") -> DataFrame:
    """(key, expected, status, verified, agrees) of every problem and every frozen status, by key, also where one of them lacks."""
    found = verify_rows(certify_rows(problems, max_splits)).select(key, F.col("certificate.status").alias("status"), "verified")
    both = found.join(frozen.select(key, F.col("status").alias("expected")), key, "full")
    return both.select(key, "expected", "status", "verified", F.coalesce((F.col("expected") == F.col("status")) & (F.col("status") == F.col("verified")), F.lit(False)).alias("agrees"))


def quadratic_bound(df: DataFrame, c0: str, c1: str, c2: str) -> DataFrame:
    """All columns and ``certified``: whether c0 + c1 x + c2 x^2 >= 0 on [0, 1] follows from its Bernstein coefficients.

    Whole numbers only: the coefficients times two are 2 c0, 2 c0 + c1 and 2 (c0 + c1 + c2).
    """
    a, b, c = F.col(c0), F.col(c1), F.col(c2)
    return df.withColumn("certified", F.least(2 * a, 2 * a + b, 2 * (a + b + c)) >= 0)
