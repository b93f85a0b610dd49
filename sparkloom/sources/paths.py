"""Checks of local paths before they are read."""

from __future__ import annotations

import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame

from ..contracts import require


def safe_file(path: str) -> Path:
    """The absolute path of a regular file, with no parent traversal and no symbolic link on the way."""
    require(bool(path) and "\0" not in path and ".." not in Path(path).parts, "the path goes up")
    whole = Path(os.path.abspath(path))
    for part in [*reversed(whole.parents), whole]:
        require(not part.is_symlink(), f"{part} is a symbolic link")
    require(whole.exists() and stat.S_ISREG(whole.stat().st_mode), "not a regular file")
    return whole


def without_sidecars(path: str) -> Path:
    """As safe_file(), and no write-ahead log or journal lies beside it: the file is a snapshot."""
    whole = safe_file(path)
    beside = [s for s in ("-wal", "-shm", "-journal") if Path(f"{whole}{s}").exists()]
    require(not beside, f"the database has {', '.join(beside)} beside it")
    return whole


def file_stats(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of the files behind a DataFrame."""
    spark = df.sparkSession
    jvm, hadoop, out = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(hadoop).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out
