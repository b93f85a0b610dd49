from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return db


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with rows of SQL, whatever their order."""

    def plain(v):
        return None if v is None else float(v) if isinstance(v, float) else v

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
        at = [relation.columns.index(c) for c in names]
        theirs = [tuple(plain(r[i]) for i in at) for r in relation.fetchall()]
        assert sorted(ours, key=repr) == sorted(theirs, key=repr)

    return check
