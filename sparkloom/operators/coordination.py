"""Work that many tasks share without talking to each other: ranges of ids reserved in a ledger, and heavy keys split by their counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import require
from ..shared import SharedTable

#: Files of a batch whose ranges are broadcast, at most; ranges of more are joined by shuffle.
BROADCAST_FILES = 100_000


class IdLedger:
    """Whole numbers from 0, each given to one row of the batches of a folder.

    A batch is written once.  Each of its files gets a range of ids, as long as it has
    rows, after those of earlier batches; a row's id is the range's start and its
    place in the file.  So tasks need no counter and no order, ids have no gaps, and
    a task that is lost and run again, or split otherwise, gives the same ids.  One driver
    at a time adds batches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _complete(self, path: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def _numbers(self) -> list[int]:
        """Batches with a complete range, in the order of their reservation; as many as there are batches."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit() and self._complete(f"{self.folder}/ledger/{n}"))

    def ranges(self) -> DataFrame:
        """(batch, file, rows, start) of every file of every batch."""
        paths = [f"{self.folder}/ledger/{n}" for n in self._numbers()]
        schema = "batch string, file string, rows long, start long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def assign(self, df: DataFrame, batch: str, name: str = "id") -> DataFrame:
        """The rows of a batch with their ids; a batch that is there already is read back, whatever ``df`` has now.

        What a driver that died had half written is written anew: without its
        ranges no id of it was given out.
        """
        require(re.fullmatch(r"[A-Za-z0-9_.-]+", batch) is not None, "a batch is named by letters, digits, dots, dashes and underscores")
        require(name not in df.columns, f"no column {name} yet")
        path = f"{self.folder}/rows/{batch}"
        own = self.ranges().where(F.col("batch") == batch)
        if own.isEmpty():
            if not self._complete(path):
                df.write.mode("overwrite").parquet(path)
            numbers = self._numbers()
            start = self.ranges().agg(F.coalesce(F.max(F.col("start") + F.col("rows")), F.lit(0))).first()[0]
            # One row a file; an empty batch has one range of no rows.
            counts = self.spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
            counts = counts.union(self.spark.createDataFrame([("", 0)], "file string, rows long"))
            earlier = "sum(rows) over (order by file rows between unbounded preceding and 1 preceding)"
            ranges = counts.select(F.lit(batch).alias("batch"), "file", "rows", F.expr(f"{start} + coalesce({earlier}, 0)").alias("start"))
            ranges.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/{numbers[-1] + 1 if numbers else 0}")
            own = self.ranges().where(F.col("batch") == batch)
        files = own.select(F.col("file").alias("_file"), "start").where("rows > 0")
        files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
        placed = self.spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        return placed.join(files, "_file").select(*df.columns, (F.col("start") + F.col("_at")).alias(name))


def heavy_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, n, parts) of the keys with more than ``most`` rows, counted before the shuffle; parts of about ``most`` rows each."""
    require(most >= 1, "most is positive")
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return counts.withColumn("parts", F.ceil(F.col("n") / most).cast("int"))


def salted_join(left: DataFrame, right: DataFrame, key: str, most: int, spread: Column) -> DataFrame:
    """The rows of the inner join on ``key``, and ``_part``: keys of more than ``most`` left rows are dealt to parts of about ``most``.

    ``spread`` tells rows of a key apart (an id); its hash chooses the part, so a
    repeated task chooses the same.  Right rows of such a key are copied
    to each of its parts.  There are at most rows / most heavy keys; their table is
    written and joined, and AQE broadcasts it where it is small.
    """
    require(not {"_part", "_parts"} & {*left.columns, *right.columns}, "no columns _part and _parts")
    heavy = SharedTable(heavy_keys(left, key, most).select(key, F.col("parts").alias("_parts")), "heavy").df
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(heavy) if heavy.count() <= BROADCAST_FILES else heavy, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    copied = right.join(F.broadcast(heavy) if heavy.count() <= BROADCAST_FILES else heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"])
