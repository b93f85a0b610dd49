"""Helpers that the training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import SharedTable, shared_folder  # noqa: F401  for the operators of this package

#: Bytes of a batch of rows that goes to Python, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves remainder 2 by 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def hash_share(col: Column, share: float) -> Column:
    """Keeps about ``share`` of the distinct values of ``col``, the same ones on every run."""
    limit = int(max(0.0, min(1.0, share)) * (2**31))
    return F.pmod(F.xxhash64(col, F.lit("share")), F.lit(2**31)) < F.lit(limit)


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts stay small: lowers the session's bound on bytes, which no result depends on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def parts(n_rows: int, per_part: int, least: int = 1) -> int:
    """Number of blocks of at most about ``per_part`` rows."""
    return max(least, math.ceil(n_rows / per_part))


#: Keys that join_unique() broadcasts, at most.
HOT = 10_000


def join_unique(rows: DataFrame, table: DataFrame, key: str, total: int, n: str = "n", hot: int = HOT, least: int = 64, largest: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in column ``n`` the number of its rows; ``n`` goes.

    ``total`` rows have at most ``hot`` keys of more than ``total / hot`` rows
    each.  What belongs to such keys, if there are any, is broadcast, so that
    none of them is gathered in one task; the other rows are shuffled by key as
    ever.
    """
    most = max(least, total // hot)
    largest = table.agg(F.max(n)).first()[0] or 0 if largest is None else largest
    if largest <= most:
        return rows.join(table.drop(n), key)
    many = F.broadcast(table.where(F.col(n) > most).drop(n))
    few = rows.join(many.select(key), key, "left_anti").join(table.where(F.col(n) <= most).drop(n), key)
    return rows.join(many, key).unionByName(few)
