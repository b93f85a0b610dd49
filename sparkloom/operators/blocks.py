"""Pair sums whose blocks are skipped by their bounds.

An array sorted by (value, idx) is cut into blocks of so many elements, each
with its least and largest value.  Sums of two blocks lie between the sums of
these, so most pairs of blocks are decided without looking at their elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import require
from ..shared import SharedTable
from .order import with_ordinal

#: Elements of a block; blocks of a table that may be broadcast (16 to 32 bytes each).
SIZE, BROADCAST = 4096, 1 << 20


class Blocks:
    """An array in blocks: ``rows`` (block, idx, value), and ``bounds`` (block, low, high, n), both written once."""

    def __init__(self, array: DataFrame, size: int = SIZE):
        require(size >= 1, "a block has one element or more")
        numbered = with_ordinal(array, ["value", "idx"], "_at").select(F.expr(f"_at div {size}").alias("block"), "idx", "value")
        self.rows = SharedTable(numbered, "blocks").df
        self.bounds = SharedTable(self.rows.groupBy("block").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")), "bounds").df
        self.n = self.bounds.count()


def _sums(first: Blocks, second: Blocks) -> DataFrame:
    """(i, j, low, high, pairs) of every two blocks.  A side of bounds is broadcast, for there is one row for ``size`` elements."""
    require(min(first.n, second.n) <= BROADCAST, "too many blocks: take larger ones")
    a = first.bounds.select(F.col("block").alias("i"), F.col("low").alias("_al"), F.col("high").alias("_ah"), F.col("n").alias("_an"))
    b = second.bounds.select(F.col("block").alias("j"), F.col("low").alias("_bl"), F.col("high").alias("_bh"), F.col("n").alias("_bn"))
    both = a.crossJoin(F.broadcast(b)) if second.n <= first.n else F.broadcast(a).crossJoin(b)
    return both.select("i", "j", (F.col("_al") + F.col("_bl")).alias("low"), (F.col("_ah") + F.col("_bh")).alias("high"), (F.col("_an") * F.col("_bn")).alias("pairs"))


def _pairs(first: Blocks, second: Blocks, chosen: DataFrame, *keep: str) -> DataFrame:
    """(key, left, right, keep...) of the pairs in the chosen pairs of blocks."""
    a = first.rows.select(F.col("block").alias("i"), F.col("idx").alias("left"), F.col("value").alias("_a"))
    b = second.rows.select(F.col("block").alias("j"), F.col("idx").alias("right"), F.col("value").alias("_b"))
    return chosen.select("i", "j", *keep).join(a, "i").join(b, "j").select((F.col("_a") + F.col("_b")).alias("key"), "left", "right", *keep)


def sums_between(first: DataFrame, second: DataFrame, low, high, size: int = SIZE) -> DataFrame:
    """(key, left, right) of the pairs whose sum lies in [low, high].  Pairs of blocks wholly inside aren't tested, those wholly outside aren't made."""
    a, b = Blocks(first, size), Blocks(second, size)
    near = _sums(a, b).where((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
    near = near.withColumn("inside", (F.col("low") >= F.lit(low)) & (F.col("high") <= F.lit(high)))
    return _pairs(a, b, near, "inside").where(F.col("inside") | F.col("key").between(F.lit(low), F.lit(high))).drop("inside")


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose interval [low, high] meets one of ``right``.

    Intervals are dealt to the cells of a grid of twice their mean length, so there are
    some two and a half cells an interval, however long single ones are.
    """
    both = left.select("low", "high").union(right.select("low", "high"))
    mean = both.agg(F.avg(F.col("high").cast("double") - F.col("low").cast("double"))).first()[0]
    width = max(1, int(2 * (mean or 0)))
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    dealt = lambda df: df.withColumn("_cell", F.explode(F.sequence(cell("low"), cell("high"))))
    others = dealt(right.select("low", "high").distinct()).select("_cell", F.col("low").alias("_low"), F.col("high").alias("_high"))
    own = dealt(left)
    met = own.join(others, (own["_cell"] == others["_cell"]) & (F.col("low") <= F.col("_high")) & (F.col("_low") <= F.col("high")), "left_semi")
    return met.drop("_cell").distinct()


def _kept(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, size: int):
    sides = [Blocks(x, size) for x in (a, b, c, d)]
    left, right = SharedTable(_sums(*sides[:2]), "left-sums").df, SharedTable(_sums(*sides[2:]), "right-sums").df
    return sides, left, right, SharedTable(_meeting(left, right), "left-kept").df, SharedTable(_meeting(right, left), "right-kept").df


def pruned_equal_sums(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, size: int = SIZE) -> DataFrame:
    """equal_sum_join() of four arrays, of pairs only in blocks whose sums some pair of blocks of the other side can have."""
    sides, _, _, left, right = _kept(a, b, c, d, size)
    own = _pairs(*sides[:2], left).select("key", F.col("left").alias("l_left"), F.col("right").alias("l_right"))
    other = _pairs(*sides[2:], right).select("key", F.col("left").alias("r_left"), F.col("right").alias("r_right"))
    return own.join(other, "key")


def pruned_share(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, size: int = SIZE) -> DataFrame:
    """(side, blocks, kept, pairs, kept_pairs): what pruned_equal_sums() looks at, of all pairs of blocks and all pairs."""
    _, left, right, left_kept, right_kept = _kept(a, b, c, d, size)
    count = lambda name, all_of, kept: all_of.agg(F.lit(name).alias("side"), F.count("*").alias("blocks"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).join(
        kept.agg(F.lit(name).alias("side"), F.count("*").alias("kept"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("kept_pairs")), "side"
    )
    return count("left", left, left_kept).union(count("right", right, right_kept)).select("side", "blocks", "kept", "pairs", "kept_pairs")
