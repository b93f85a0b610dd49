"""Results that are written once and read again while nothing they depend on has changed."""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..contracts import require
from ..functions.digest import multiset_digest
from ..sources.paths import file_stats
from .workload import compare


def signature(df: DataFrame, **settings) -> str:
    """Digest of all a result depends on: the analysed plan, its input files with lengths and times, and settings."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    return hashlib.sha256(json.dumps([plan, file_stats(df), sorted(settings.items())], default=str).encode()).hexdigest()


class Materialized:
    """Tables in a shared folder by signature; calls for one signature at the same time do the work once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.locks: dict[str, threading.Lock] = {}
        self.guard, self.written = threading.Lock(), 0

    def get(self, df: DataFrame, **settings) -> DataFrame:
        key = signature(df, **settings)
        with self.guard:
            lock = self.locks.setdefault(key, threading.Lock())
        path = f"{self.folder}/{key}"
        with lock:
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
                df.write.mode("overwrite").parquet(path)
                self.written += 1
        return self.spark.read.schema(df.schema).parquet(path)


def parity(make: Callable[[int], DataFrame], tasks: tuple[int, ...]) -> DataFrame:
    """(tasks, items, same): the result's rows by number of tasks, and whether they are those of the first."""
    found = []
    for n in tasks:
        df = make(n)
        found.append(multiset_digest(df.select(*sorted(df.columns))).first())
    rows = [(n, row["items"], row == found[0]) for n, row in zip(tasks, found)]
    return df.sparkSession.createDataFrame(rows, "tasks int, items long, same boolean")


def fastest(plans: Mapping[str, Callable[[], DataFrame]], default: str, margin: float = 0.2, repeats: int = 3) -> str:
    """The name of the plan to use: another one than the default only if it gives the same rows and is faster by the margin."""
    require(default in plans, "the default is one of the plans")
    times = compare({name: make() for name, make in plans.items()}, repeats)
    best = min(times, key=lambda n: times[n]["median_s"])
    return best if times[best]["median_s"] < (1 - margin) * times[default]["median_s"] else default


def regressions(before: Mapping[str, float], now: Mapping[str, float], budget: float = 0.25, least: float = 0.2) -> dict[str, float]:
    """Queries that take more than ``budget`` longer than before, with their ratio; differences under ``least`` seconds don't count."""
    return {n: now[n] / before[n] for n in before if n in now and now[n] > before[n] * (1 + budget) and now[n] - before[n] > least}
