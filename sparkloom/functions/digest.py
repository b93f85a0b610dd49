"""Digests of rows: ordered ones of bounded results, and unordered ones of any."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digest(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row (items, digest): SHA-256 of all rows, sorted by their columns and written as text lines.

    The lines meet in one group, so it is for bounded results: no more than
    ``most`` rows and one are gathered, and more than ``most`` raise.
    """
    df = df.limit(most + 1)
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns])
    both = df.agg(F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in df.columns], row.alias("_line")))).alias("all"))
    bounded = F.when(F.col("items") > most, F.raise_error(F.lit("too many rows for an ordered digest"))).otherwise(F.col("items"))
    return both.select(bounded.cast("long").alias("items"), F.sha2(F.array_join(F.transform("all", lambda x: x["_line"]), "\n"), 256).alias("digest"))


def multiset_digest(df: DataFrame) -> DataFrame:
    """One row (items, digest) that doesn't depend on the rows' order; sums of hashes, combined by tasks."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("items"), F.concat_ws(":", F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)), F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in df.columns)}))"), F.lit(0))).alias("digest"))


def cell(value) -> dict:
    """A value with its type's tag."""
    if value is None:
        return {"type": "null"}
    if isinstance(value, bool):
        return {"type": "integer", "value": str(int(value))}
    if isinstance(value, int):
        return {"type": "integer", "value": str(value)}
    if isinstance(value, float):
        return {"type": "float", "value": value.hex()}
    if isinstance(value, (bytes, bytearray)):
        return {"type": "blob", "value": base64.b64encode(bytes(value)).decode()}
    return {"type": "text", "value": str(value)}


def typed_digest(rows: Iterable[tuple]) -> str:
    """Digest of bounded rows in their order, with typed cells."""
    whole = hashlib.sha256()
    for row in rows:
        whole.update(json.dumps([cell(v) for v in row], sort_keys=True, separators=(",", ":"), allow_nan=False).encode() + b"\n")
    return f"sha256:{whole.hexdigest()}"
