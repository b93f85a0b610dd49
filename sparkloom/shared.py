"""Tables that are written once to a folder which the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(None)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is named, a single machine takes a temporary folder; a cluster can't share one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


class SharedTable:
    """A table written once to the shared folder, so that what follows neither repeats nor depends on its lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
