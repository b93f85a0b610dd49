"""Sets of whole numbers as bitmaps of 32768 bits a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., bucket, bits): the distinct values as one bitmap for each group and bucket."""
    v = F.col(value).cast("long")
    return df.where(v.isNotNull()).groupBy(*by, F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))


def cardinality(maps: DataFrame, *by: str) -> DataFrame:
    """(by..., distinct_values) of bitmaps."""
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("distinct_values"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets that only one side has are empty and go."""
    both = a.select("bucket", "bits", F.lit(0).alias("side")).union(b.select("bucket", "bits", F.lit(1).alias("side")))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.countDistinct("side").alias("sides")).where("sides = 2").select("bucket", "bits")


def difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Distinct values of ``a`` that ``b`` lacks; bitmaps have no and-not, an anti join has."""
    return a.select(value).distinct().join(b.select(value).distinct(), value, "left_anti")


def contains(maps: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Distinct values of a column that the bitmaps hold."""
    v = F.col(value).cast("long")
    own = values.select(value).distinct().withColumns({"_bucket": F.bitmap_bucket_number(v), "_bit": F.bitmap_bit_position(v)})
    joined = own.join(maps, own["_bucket"] == maps["bucket"])
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(value)
