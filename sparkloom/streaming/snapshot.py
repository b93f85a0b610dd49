"""Bounded streams that replay: a table is frozen in order, and read in micro-batches that can be broken off and taken up again.

A counting source gives the numbers of the next ranges and keeps its place in
the checkpoint; the frozen table is partitioned by range, so a batch reads the
files of its ranges only.  Each reader has a checkpoint of its own, so any number of
branches read one snapshot, each at its place.  Every batch goes to all sinks, into a
folder named by the batch, so a batch that is run again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import require
from ..operators.order import with_ordinal
from ..shared import SharedTable, shared_folder

Sink = Callable[[DataFrame], DataFrame]


class Snapshot:
    """A table as it is now, in the order of ``order`` (total), in ranges of ``rows`` rows; later changes of its source don't show."""

    def __init__(self, df: DataFrame, order: list[str], rows: int):
        require(rows >= 1, "a range has one row or more")
        self.spark: SparkSession = df.sparkSession
        frozen = SharedTable(with_ordinal(df, order, "ordinal").withColumn("range", F.expr(f"ordinal div {rows}")), "frozen")
        self.schema = frozen.df.schema
        self.path = f"{shared_folder(self.spark)}/snapshot-{uuid.uuid4().hex}"
        frozen.df.repartition("range").write.partitionBy("range").parquet(self.path)
        self.n = frozen.df.select("range").distinct().count()
        self.columns = [*df.columns, "ordinal", "range"]
        frozen.drop()

    @property
    def df(self) -> DataFrame:
        if not self.n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.columns)

    def branch(self, sinks: Mapping[str, Sink] | None = None, ranges: int = 1) -> Branch:
        """A new reader from the first row on."""
        return Branch(self, dict(sinks or {"rows": lambda batch: batch}), ranges, f"{shared_folder(self.spark)}/branch-{uuid.uuid4().hex}")


class _BreakOff(Exception):
    """Ends a run before a batch is written."""


class Branch:
    """A reader of a snapshot: its place is in the folder's checkpoint, its results beside it."""

    def __init__(self, snapshot: Snapshot, sinks: dict[str, Sink], ranges: int, folder: str):
        self.snapshot, self.sinks, self.ranges, self.folder = snapshot, sinks, ranges, folder

    def run(self, most: int | None = None, after: Callable[[str, int], None] | None = None) -> None:
        """Reads on to the end, or for ``most`` batches.  ``after`` is called when a sink has got a batch; what it raises breaks the run off."""
        spark, done = self.snapshot.spark, 0
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", self.ranges).option("numPartitions", 1).option("startTimestamp", 0).load()
        named = ticks.select(F.col("value").alias("range"))

        def write(batch: DataFrame, number: int) -> None:
            nonlocal done
            wanted = [r["range"] for r in batch.collect()]  # as many numbers as ranges in a batch
            inside = [r for r in wanted if r < self.snapshot.n]
            if not inside or (most is not None and done >= most):
                raise _BreakOff
            rows = self.snapshot.df.where(F.col("range").isin(inside))
            for name, sink in self.sinks.items():
                sink(rows).withColumn("ranges", F.lit(len(inside))).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
                if after is not None:
                    after(name, number)
            spark.createDataFrame([(r,) for r in inside], "range long").write.mode("overwrite").parquet(f"{self.folder}/done/batch={number}")
            done += 1

        query = named.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/checkpoint").start()
        try:
            query.awaitTermination()
        except StreamingQueryException as error:
            if "_BreakOff" not in str(error):
                raise
        finally:
            query.stop()

    def _read(self, name: str, schema) -> DataFrame:
        jvm = self.snapshot.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.snapshot.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.snapshot.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.snapshot.spark.createDataFrame([], schema)

    @property
    def complete(self) -> bool:
        """Whether every range has been written to every sink."""
        return self._read("done", "range long").select("range").distinct().count() == self.snapshot.n

    def results(self, name: str = "rows") -> DataFrame:
        """What a sink holds so far, with ``complete``; a prefix of the snapshot is never complete."""
        schema = self.sinks[name](self.snapshot.df).schema
        return self._read(name, schema).select(*schema.names).withColumn("complete", F.lit(self.complete))
