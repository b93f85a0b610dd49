"""Ordinals and running sums of whole tables without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import SharedTable

#: Rows of a range, about.
RANGE = 100_000


def in_ranges(df: DataFrame, *order, rows: int = RANGE, name: str = "_range") -> DataFrame:
    """The rows with the number of their range in the order of ``order`` (names or columns), written once.

    There are as many ranges as ``rows`` to each make it; rows of equal order
    are told apart by a hash of all columns, so that they may be split too.
    """
    hashed = F.xxhash64(*df.columns)
    n = max(1, -(-df.count() // rows))
    return SharedTable(df.repartitionByRange(n, *order, hashed).withColumn(name, F.spark_partition_id()), "ranges").df


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal", rows: int = RANGE) -> DataFrame:
    """All columns and the row's place (from 0) in the order of ``order``, nulls first.

    Ranges are numbered by themselves; rows before a range come from the counts
    of ranges.  Rows of equal order are numbered in any order.
    """
    ranged = in_ranges(df, *order, rows=rows)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order, F.xxhash64(*df.columns))) - 1)
    return numbered.join(starts, "_range").select(*df.columns, (F.col("_at") + F.col("_start")).alias(name))


def with_running_sum(df: DataFrame, order: list[str], size: str, name: str, by: list[str] | None = None, rows: int = RANGE) -> DataFrame:
    """All columns and the sum of ``size`` up to and with the row, in order, within each group of ``by``; ``order`` is total within a group.

    A group of any size is summed by ranges; sums before a range come from one
    row a group and range.
    """
    by = by or []
    ranged = in_ranges(df, *by, *order, rows=rows)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_by{i}") for i, c in enumerate(by)] + [F.col(c).isNull().alias(f"_no{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))] + [f"_no{i}" for i in range(len(by))]
    ranged = ranged.select("*", *keys)
    own = Window.partitionBy(*names, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*names, "_range").agg(F.sum(size).alias("_sum")).select(*names, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return ranged.withColumn("_own", F.sum(size).over(own)).join(before, [*names, "_range"]).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def budgeted_best(trials: DataFrame, order: list[str], cost: str, score: str, budget: float) -> DataFrame:
    """The one trial (all columns, ``used`` and ``complete``) of the best, that is smallest, score among those that the budget pays for, in order.

    The search stops before the first trial that the budget doesn't cover;
    ``complete`` tells whether it came to the end.  Ties go to the earlier one.
    """
    spent = with_running_sum(trials, order, cost, "used")
    paid = spent.where(F.col("used") <= budget)
    complete = spent.agg((F.max("used") <= budget).alias("complete"))
    return paid.orderBy(score, *order).limit(1).crossJoin(F.broadcast(complete))
