"""SQLite files as a Spark data source, opened read-only."""

from __future__ import annotations

import json
import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..contracts import ContractError, require
from .paths import without_sidecars

#: Column of the cells that don't have their column's type, with ``misfits=collect``.
MISFITS = "_misfits"

#: Bytes of a text or blob, unless the option ``cell_bytes`` says otherwise; a longer one raises.
CELL_BYTES = 65_536


def column_type(declared: str) -> str:
    """Spark's type of a column, by the affinity that SQLite gives its declared type.

    SQLite's rules go by parts of the name, in this order: INT; CHAR, CLOB or
    TEXT; BLOB; REAL, FLOA or DOUB; all else is numeric.  Of the numeric ones
    NUMERIC and DECIMAL are doubles; dates, booleans and columns without a type
    hold what their writers chose, so they are read as text.
    """
    name = declared.upper()
    if "INT" in name:
        return "bigint"
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in name:
        return "binary"
    if any(x in name for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "double"
    return "string"


def fitted(value, kind: str, loose: bool):
    """(value as Spark has it, whether it fits); loose columns render any number as text."""
    if value is None:
        return None, True
    if kind == "bigint":
        return (value, True) if type(value) is int else (None, False)
    if kind == "double":
        if type(value) is int and abs(value) <= 2**53:
            return float(value), True
        return (value, True) if type(value) is float else (None, False)
    if kind == "binary":
        return (value, True) if type(value) is bytes else (None, False)
    if loose and type(value) in (int, float):
        return str(value), True
    return (value, True) if type(value) is str else (None, False)


class SqliteDataSource(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("table", name)``; rowid ranges are partitions.

    SQLite lets any cell hold any type.  A cell that doesn't fit its column
    (text in an INTEGER column, a whole number beyond 2^53 in a DECIMAL one)
    raises, naming the column.  With the option ``misfits=collect`` it is null
    and stands in the column ``_misfits``, a JSON object of column to [type,
    text]; blobs are written in hexadecimal.  ``cell_bytes`` bounds each cell.
    ``pushdown=true`` needs Spark's setting for filters of Python sources.
    """

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        with connect(self.options["path"]) as db:
            columns = [f"`{name.replace('`', '``')}` {column_type(declared)}" for name, declared in declared_types(db, self.options["table"]).items()]
        require(bool(columns), f"a table {self.options['table']} in the file")
        return ", ".join(columns + [f"{MISFITS} string"] * (self.options.get("misfits", "fail") == "collect"))

    def reader(self, schema):
        return (FilteringReader if self.options.get("pushdown", "false") == "true" else SqliteReader)(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.fields = options["path"], options["table"], [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.parts, self.cell_bytes, self.misfits = int(options.get("partitions", "4")), int(options.get("cell_bytes", CELL_BYTES)), options.get("misfits", "fail")
        require(self.parts >= 1 and self.cell_bytes >= 1 and self.misfits in ("fail", "collect"), "partitions and cell_bytes are positive, misfits is fail or collect")
        with connect(self.path) as db:
            self.declared = declared_types(db, self.table)
        own = [n for n, _ in self.fields if n != MISFITS or self.misfits == "fail"]
        require(all(n in self.declared for n in own), "columns of the table")
        self.where: list[tuple[str, tuple]] = []

    def loose(self, name: str) -> bool:
        """Whether the column is text only because its declared type says nothing of use."""
        return column_type(self.declared[name]) == "string" and not any(x in self.declared[name].upper() for x in ("CHAR", "CLOB", "TEXT"))

    def partitions(self):
        with connect(self.path) as db:
            if not has_rowid(db, self.table):
                return [InputPartition(None)]
            low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((at, min(at + step - 1, high))) for at in range(low, high + 1, step)]

    def read(self, partition):
        tests = self.where + ([] if partition.value is None else [("rowid between ? and ?", partition.value)])
        where = f" where {' and '.join(t for t, _ in tests)}" if tests else ""
        names = [n for n, _ in self.fields if n in self.declared]
        kinds = [(n, dict(self.fields)[n], self.loose(n)) for n in names]
        with connect(self.path, self.cell_bytes) as db:
            for row in db.execute(f"select {', '.join(map(quoted, names)) or '1'} from {quoted(self.table)}{where}", [v for _, own in tests for v in own]):
                odd, cells = {}, {}
                for value, (name, kind, loose) in zip(row, kinds):
                    cells[name], fits = fitted(value, kind, loose)
                    if not fits:
                        if self.misfits == "fail":
                            raise ContractError(f"column {name} of {self.table} is {kind} and holds a cell of type {type(value).__name__}; see the option misfits")
                        odd[name] = [type(value).__name__, value.hex() if isinstance(value, bytes) else str(value)]
                if self.misfits == "collect":
                    cells.setdefault(MISFITS, json.dumps(odd, sort_keys=True) if odd else None)
                yield tuple(cells[n] for n, _ in self.fields)


class FilteringReader(SqliteReader):
    """Comparisons of INTEGER, REAL and TEXT columns with constants go into SQLite's own WHERE, where indexes serve them.

    Spark tests them once more, so a filter that goes there can only leave out
    rows that Spark would drop: SQLite orders any text after all numbers, and
    Spark has null for it.
    """

    OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in self.OPERATORS and self._comparable(f.attribute, f.value):
                self.where.append((f"{quoted(f.attribute[0])} {self.OPERATORS[type(f)]} ? collate binary", (f.value,)))
            elif type(f) is ds.In and f.value and len(f.value) <= 500 and all(self._comparable(f.attribute, v) for v in f.value):
                self.where.append((f"{quoted(f.attribute[0])} collate binary in ({', '.join('?' * len(f.value))})", tuple(f.value)))
        return filters

    def _comparable(self, path, value) -> bool:
        name = path[0] if len(path) == 1 else None
        declared = self.declared.get(name)
        if declared is None or dict(self.fields).get(name) != column_type(declared):
            return False
        exact = {"bigint": (int,), "double": (int, float), "string": (str,)}.get(column_type(declared), ())
        return type(value) in exact and value == value and not self.loose(name)


def declared_types(db, table: str) -> dict[str, str]:
    """Columns of a table, hidden ones left out, with their declared types."""
    return {r[1]: r[2] for r in db.execute(f"pragma table_info({quoted(table)})")}


def has_rowid(db, table: str) -> bool:
    """False for tables made WITHOUT ROWID, which one task reads whole."""
    import sqlite3

    try:
        db.execute(f"select rowid from {quoted(table)} limit 0")
    except sqlite3.OperationalError:
        return False
    return True


def read_sqlite(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """A table of a SQLite file on the driver; Spark ships the file to the executors.

    Options are those of SqliteDataSource.  Filters are pushed down, for which a
    setting of the session is turned on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteDataSource)
    spark.sparkContext.addFile(str(without_sidecars(path)))
    return spark.read.format("sqlite").options(path=path, table=table, **{"pushdown": "true", **options}).load()


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, position, column_name, type, collation, descending): columns of tables and of indexes, and the journal mode as a row."""
    rows = []
    with connect(path) as db:
        for (table,) in db.execute("select name from sqlite_schema where type = 'table' order by name").fetchall():
            rows += [("table", table, c[0], c[1], c[2], None, None) for c in db.execute(f"pragma table_info({quoted(table)})")]
            for index in db.execute(f"pragma index_list({quoted(table)})").fetchall():
                rows += [("index", index[1], c[0], c[2], None, c[4], bool(c[3])) for c in db.execute(f"pragma index_xinfo({quoted(index[1])})") if c[5]]
        rows.append(("setting", "journal_mode", 0, None, db.execute("pragma journal_mode").fetchone()[0], None, None))
    return spark.createDataFrame(rows, "kind string, name string, position int, column_name string, type string, collation string, descending boolean")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str, cell_bytes: int | None = None):
    """The file opened read-only and unchanging; cells longer than ``cell_bytes`` raise."""
    import contextlib
    import sqlite3
    from urllib.parse import quote

    if not os.path.exists(path):  # on an executor: the file that the driver shipped
        path = os.path.realpath(SparkFiles.get(os.path.basename(path)))
    db = sqlite3.connect(f"file:{quote(str(without_sidecars(path)))}?mode=ro&immutable=1", uri=True)
    db.execute("pragma query_only = on")
    db.execute("pragma trusted_schema = off")
    if cell_bytes is not None:
        db.setlimit(sqlite3.SQLITE_LIMIT_LENGTH, cell_bytes)
    return contextlib.closing(db)
