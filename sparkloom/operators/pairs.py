"""Pair sums of indexed integer arrays, their residue classes, and joins of equal sums.

An indexed array is a DataFrame of ``idx`` (the element's identity) and
``value`` (BIGINT or DECIMAL(38,0)).  Integer overflow raises, as ANSI mode has
it.  Results are sets of rows with a total order over their columns; add
``ordered`` to get them sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import require, require_rows


def indexed(df: DataFrame, idx: str, value: str) -> DataFrame:
    """An indexed array out of two columns; nulls in either are refused when it is validated."""
    return df.select(F.col(idx).alias("idx"), F.col(value).alias("value"))


def validated(array: DataFrame) -> DataFrame:
    """The array, after a check that neither column has nulls and that both are whole numbers."""
    kinds = {f.name: f.dataType.simpleString() for f in array.schema}
    require(set(kinds) == {"idx", "value"}, "an array has the columns idx and value")
    require(all(k in ("tinyint", "smallint", "int", "bigint") or (k.startswith("decimal(") and k.endswith(",0)")) for k in kinds.values()), "idx and value are whole numbers")
    return require_rows(array, idx=F.col("idx").isNotNull(), value=F.col("value").isNotNull())


def _sides(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    return first.select(F.col("idx").alias("left"), F.col("value").alias("a")), second.select(F.col("idx").alias("right"), F.col("value").alias("b"))


def admit(first: DataFrame, second: DataFrame, most_pairs: int) -> None:
    """Refuses inputs whose product has more pairs than allowed, before anything is enumerated."""
    n = first.count() * second.count()
    require(n <= most_pairs, f"{n} pairs; at most {most_pairs} are allowed")


def pair_sums(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, left, right) of every pair: the sum and both indices."""
    left, right = _sides(first, second)
    return left.crossJoin(right).select((F.col("a") + F.col("b")).alias("key"), "left", "right")


def ordered(pairs: DataFrame) -> DataFrame:
    """Sorted by all columns in their order: a range exchange and a sort that can spill."""
    return pairs.orderBy(*pairs.columns)


def pair_prefix(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs by (key, left, right).

    Each side needs only its first k elements by (value, idx): with the same
    partner, every earlier element makes an earlier pair.
    """
    require(k >= 1, "k is positive")
    first, second = (x.orderBy("value", "idx").limit(k) for x in (first, second))
    return pair_sums(first, second).orderBy("key", "left", "right").limit(k)


def peek(pairs: DataFrame) -> DataFrame:
    """The first pair, or none."""
    return pairs.orderBy(*pairs.columns).limit(1)


def pairs_by_filter(first: DataFrame, second: DataFrame, modulus: int, residue: int) -> DataFrame:
    """Pairs whose sum has the residue, by testing every pair."""
    require(modulus >= 1, "the modulus is positive")
    return pair_sums(first, second).where(F.pmod("key", F.lit(modulus)) == residue % modulus)


def pairs_by_residue(first: DataFrame, second: DataFrame, modulus: int, residue: int) -> DataFrame:
    """The same pairs by an equal join: the residue of one element tells that of its partners."""
    require(modulus >= 1, "the modulus is positive")
    left, right = _sides(first, second)
    m = F.lit(modulus)
    left = left.withColumn("want", F.pmod(F.lit(residue % modulus) - F.pmod("a", m), m))
    right = right.withColumn("have", F.pmod("b", m))
    return left.join(right, F.col("want") == F.col("have")).select((F.col("a") + F.col("b")).alias("key"), "left", "right")


def residue_count(first: DataFrame, second: DataFrame, modulus: int, residue: int) -> DataFrame:
    """Number of pairs with the residue, without enumerating them."""
    m = F.lit(modulus)
    left = first.groupBy(F.pmod("value", m).alias("a")).agg(F.count("*").alias("n"))
    right = second.groupBy(F.pmod("value", m).alias("b")).agg(F.count("*").alias("k"))
    both = left.join(right, F.pmod(F.lit(residue % modulus) - F.col("a"), m) == F.col("b"))
    return both.agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).alias("matches"))


def equal_sum_join(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, buffer: int = 64, hint: str | None = None) -> DataFrame:
    """(key, l_left, l_right, r_left, r_right) of all pairs of pairs with equal sums.

    The join's rows of equal keys spill by themselves, so ``buffer`` is checked
    and changes nothing; ``hint`` names a join strategy, such as merge.
    """
    require(isinstance(buffer, int) and not isinstance(buffer, bool) and buffer >= 1, "the buffer is a positive whole number")
    left = pair_sums(a, b).select("key", F.col("left").alias("l_left"), F.col("right").alias("l_right"))
    right = pair_sums(c, d).select("key", F.col("left").alias("r_left"), F.col("right").alias("r_right"))
    return left.join(right.hint(hint) if hint else right, "key")


def sum_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, pairs): how often each sum occurs, from the frequencies of values instead of elements."""
    left = first.groupBy(F.col("value").alias("a")).agg(F.count("*").alias("n"))
    right = second.groupBy(F.col("value").alias("b")).agg(F.count("*").alias("k"))
    return left.crossJoin(right).groupBy((F.col("a") + F.col("b")).alias("key")).agg(F.sum(F.col("n") * F.col("k")).alias("pairs"))


def equal_sum_count(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """One row: number of matches of equal_sum_join() and its largest group of right pairs, without enumerating."""
    left, right = sum_counts(a, b).withColumnRenamed("pairs", "n"), sum_counts(c, d).withColumnRenamed("pairs", "k")
    ties = right.agg(F.coalesce(F.max("k"), F.lit(0)).alias("largest_tie"))
    return left.join(right, "key").agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).alias("matches")).crossJoin(ties)


def wide_pair_sums(first: DataFrame, second: DataFrame, modulus: int | None = None, residue: int = 0) -> DataFrame:
    """(key, left, right) of arrays whose values are whole numbers of any length, as strings; keys are canonical strings.

    With a modulus of any size only sums with the residue stay; each side's
    residues are computed once for each element and joined, not tested pair by
    pair.  Equal keys are equal strings, so sums join as usual.
    """
    require(modulus is None or modulus >= 1, "the modulus is positive")
    left, right = _sides(first, second)

    @F.pandas_udf("string")
    def total(a, b):
        return a.map(int).add(b.map(int)).map(str)

    if modulus is None:
        return left.crossJoin(right).select(total("a", "b").alias("key"), "left", "right")

    @F.pandas_udf("string")
    def have(b):
        return b.map(lambda x: str(int(x) % modulus))

    @F.pandas_udf("string")
    def want(a):
        return a.map(lambda x: str((residue - int(x)) % modulus))

    joined = left.withColumn("want", want("a")).join(right.withColumn("have", have("b")), F.col("want") == F.col("have"))
    return joined.select(total("a", "b").alias("key"), "left", "right")


def wide_order(key: str = "key") -> list:
    """Columns that sort canonical strings of whole numbers by value."""
    k, negative = F.col(key), F.startswith(F.col(key), F.lit("-"))
    size = F.when(negative, -F.length(k)).otherwise(F.length(k))
    # Digits of negative numbers sort the other way round.
    turned = F.when(negative, F.translate(k, "0123456789", "9876543210")).otherwise(k)
    return [size, turned]
