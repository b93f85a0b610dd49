import io
import sqlite3
import zipfile

from sparkloom.functions.text import escape_untrusted, keyword_hits
from sparkloom.sources.archives import Limits, archive_members, archive_runs, read_archives, split_archive_members, summary
from sparkloom.sources.sqlite import FilteringReader, SqliteDataSource, column_type, read_sqlite


def archive(files, prefix=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return prefix + out.getvalue()


def members(spark, raw, **limits):
    df = spark.createDataFrame([("a.zip", bytearray(raw))], "path string, content binary")
    return archive_members(df, Limits(**limits)).orderBy("ordinal").collect()


def test_nested_archives_and_hits(spark, tmp_path):
    inner = archive({"deep.md": "no hit\nSIMD here"})
    (tmp_path / "a.zip").write_bytes(archive({"x.txt": "a cache\r\nplain\nzero-copy", "in.zip": inner, "wide.txt": "ſimd".encode("utf-16")}))
    df = read_archives(spark, str(tmp_path)).cache()
    assert summary(df).first().asDict() | {"bytes": 0} == {"members": 4, "deepest": 1, "bytes": 0, "text_members": 3, "problems": 0, "complete": True}
    hits = keyword_hits(df.where("content is not null"), "filename", "content").collect()
    assert sorted((h["key"], h["lineno"], h["match"]) for h in hits) == [("deep.md", 2, "SIMD"), ("wide.txt", 1, "ſimd"), ("x.txt", 1, "cache"), ("x.txt", 3, "zero-copy")]


def test_problems_are_rows(spark):
    raw = archive({"../up.txt": "x", "/abs.txt": "x", "ok.txt": "fine", "bad.txt": b"\xff\xfe\xff"})
    found = {r["filename"]: r["problem"] for r in members(spark, raw)}
    assert found["../up.txt"] == "parent traversal" and found["/abs.txt"] == "absolute path" and found["ok.txt"] is None and "undecodable" in found["bad.txt"]
    assert members(spark, b"no archive")[0]["problem"].startswith("invalid archive")
    assert [r["problem"] for r in members(spark, raw, members=1)][-1] == "member limit"
    assert any(r["problem"] == "byte limit" for r in members(spark, archive({"a.txt": "x" * 100}), member_bytes=10))
    nested = archive({"1.zip": archive({"2.zip": archive({"t.txt": "x"})})})
    assert any(r["problem"] == "depth limit" for r in members(spark, nested, depth=1))


def test_damaged_member(spark):
    raw = bytearray(archive({"a.txt": "hello world " * 50}))
    raw[40] ^= 0xFF
    assert any(r["problem"] for r in members(spark, bytes(raw)))


def test_prefix(spark):
    first = members(spark, archive({"a.txt": "x"}, b"#!/bin/sh\nexit\n"))[0]
    assert first["problem"].startswith("prefix") and "exit" in first["content"]


def test_null_content(spark):
    df = spark.createDataFrame([("a.zip", None)], "path string, content binary")
    assert archive_members(df).count() == 0


def test_escapes(spark):
    df = spark.createDataFrame([("a\x1b[0m‮b",), (None,), ("x" * 1000,)], "t string")
    found = [r[0] for r in df.select(escape_untrusted(df.t, 20).alias("t")).collect()]
    assert found[0] == "a\\x1b[0m\\u202eb" and found[1] is None and len(found[2]) == 20 and "..." in found[2]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    db = sqlite3.connect(path)
    db.execute("create table m (id integer primary key, name text, score real)")
    db.executemany("insert into m values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)])
    db.commit()
    db.close()
    spark.dataSource.register(SqliteDataSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "m").load()
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    assert df.count() == 100 and df.selectExpr("sum(score)").first()[0] == sum(i / 2 for i in range(100))


def made(path, *statements):
    db = sqlite3.connect(str(path))
    for sql, *rows in statements:
        db.executemany(sql, rows) if rows else db.execute(sql)
    db.commit()
    db.close()
    return str(path)


def test_sqlite_affinities(tmp_path):
    """Types are those that SQLite itself gives: what it turns text, numbers and reals into tells the affinity."""
    names = "INT BIGINT INTEGER TINYINT VARCHAR(25) NCHAR(5) CLOB TEXT BLOB REAL DOUBLE FLOAT DECIMAL(12,2) NUMERIC CHARINT".split()
    db = sqlite3.connect(":memory:")
    for name in names:
        db.execute("drop table if exists t")
        db.execute(f"create table t (c {name})")
        db.execute("insert into t values ('7')")
        db.execute("insert into t values (7)")
        a, b = (r[0] for r in db.execute("select typeof(c) from t order by rowid"))
        want = {("integer", "integer"): ("bigint", "double"), ("text", "text"): ("string",), ("real", "real"): ("double",), ("text", "integer"): ("binary",)}[a, b]
        assert column_type(name) in want, name
    assert [column_type(x) for x in ("DATE", "BOOLEAN", "", "INT", "decimal(5,1)")] == ["string", "string", "string", "bigint", "double"]


def test_sqlite_odd_cells(spark, tmp_path):
    rows = [(1, "a", 1.5, b"x", "2020-01-01", 7), (None, None, None, None, None, None), ("seven", b"\x01", "y", "z", 5, "n/a"), (2**62, "", 3, b"", 2.5, 2**60)]
    path = made(tmp_path / "odd.db", ("create table `o d` (i INT, t VARCHAR(9), r REAL, b BLOB, d DATE, n DECIMAL(9,2))",), ("insert into `o d` values (?, ?, ?, ?, ?, ?)", *rows))
    df = read_sqlite(spark, path, "o d", misfits="collect", partitions="3")
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "binary", "string", "double", "string"]
    found = [tuple(r) for r in df.collect()]
    assert found[0] == (1, "a", 1.5, bytearray(b"x"), "2020-01-01", 7.0, None) and found[1] == (None,) * 7
    assert found[2][:6] == (None, None, None, None, "5", None)
    assert found[2][6] == '{"b": ["str", "z"], "i": ["str", "seven"], "n": ["str", "n/a"], "r": ["str", "y"], "t": ["bytes", "01"]}'
    assert found[3][0] == 2**62 and found[3][5] is None and '"n": ["int", "1152921504606846976"]' in found[3][6]
    for columns in ("i", "n"):
        try:
            read_sqlite(spark, path, "o d").select(columns).collect()
            raise AssertionError("a cell that doesn't fit")
        except Exception as error:  # noqa: BLE001  Spark wraps the task's error
            assert "of o d is" in str(error)


def test_sqlite_pushdown(spark, tmp_path):
    """Each filter gives the rows that Spark keeps of the unfiltered scan, with cells of other types among them."""
    rows = [(i if i % 5 else f"t{i}", f"N{i % 7}" if i % 3 else None, i / 4) for i in range(200)]
    path = made(tmp_path / "p.db", ("create table p (i INTEGER, t TEXT COLLATE NOCASE, r REAL)",), ("insert into p values (?, ?, ?)", *rows), ("create index by_i on p (i)",))
    df = read_sqlite(spark, path, "p", misfits="collect")
    whole = spark.createDataFrame(df.collect(), df.schema)
    for test in ("i > 190", "i <= 3", "i = 7", "i in (1, 5, 6)", "t = 'n3'", "t = 'N3'", "t >= 'N5'", "t in ('n1', 'N2')", "r < 2.25", "r = 5", "i is null", "t is not null and i > 100", "not i = 7", "i < 3 or r > 48"):
        assert sorted(map(str, df.where(test).collect())) == sorted(map(str, whole.where(test).collect())), test
    reader = FilteringReader({"path": path, "table": "p", "misfits": "collect"}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = reader.pushFilters([GreaterThan(("i",), 190), EqualTo(("t",), "N3"), EqualTo(("r",), "x")])
    assert len(left) == 3 and [sql for sql, _ in reader.where] == ['"i" > ? collate binary', '"t" = ? collate binary']
    # Of 200 rows SQLite hands on the 8 whole numbers beyond 190 (and text, which it orders after numbers) that have the name.
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert 0 < len(read) < 20


def test_sqlite_cell_bound(spark, tmp_path):
    path = made(tmp_path / "c.db", ("create table c (t TEXT)",), ("insert into c values (?)", ("x" * 70_000,)))
    assert read_sqlite(spark, path, "c", cell_bytes="80000").selectExpr("length(t)").first()[0] == 70_000
    try:
        read_sqlite(spark, path, "c").collect()
        raise AssertionError("a cell beyond the bound")
    except Exception as error:  # noqa: BLE001  Spark wraps the task's error
        assert "too big" in str(error)
    path = made(tmp_path / "w.db", ("create table w (a TEXT, b TEXT)",), ("insert into w values (?, ?)", ("x" * 40_000, "y" * 40_000)))
    assert [len(x) for x in read_sqlite(spark, path, "w").first()] == [40_000, 40_000]


def test_split_archives(spark, tmp_path):
    """Members dealt to tasks give the rows of one walk: nested archives, prefixes, refused names, damage, other files."""
    files = {f"d/{i:04}.txt": f"text {i} " * (i % 9) for i in range(1000)} | {"../up": "x", "in.zip": archive({"deep.md": "a", "er.zip": archive({"t.txt": "b"})}), "last.bin": bytes(range(256))}
    (tmp_path / "large.zip").write_bytes(archive(files, b"#!/bin/sh\nexit\n"))
    damaged = bytearray(archive({f"{i}.txt": "hello world " * 50 for i in range(5)}))
    damaged[40] ^= 0xFF
    (tmp_path / "damaged.zip").write_bytes(damaged)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(archive({}))
    paths = spark.createDataFrame([(str(x),) for x in sorted(tmp_path.iterdir())] + [(str(tmp_path / "large.zip"),), (None,)], "path string")
    runs = archive_runs(paths, run_bytes=4_000)
    assert runs.where("archive like '%large.zip'").count() >= 10 and runs.agg({"bytes": "max"}).first()[0] <= 4_000
    rows = [(str(x), bytearray(x.read_bytes())) for x in tmp_path.iterdir()]
    whole = archive_members(spark.createDataFrame(rows, "path string, content binary"))
    split = split_archive_members(paths, run_bytes=4_000)
    assert split.schema == whole.schema and split.count() > 1000
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_split_archives_keep_limits(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive({f"{i}.txt": "x" * 10 for i in range(20)}))
    paths = spark.createDataFrame([(str(tmp_path / "a.zip"),), (str(tmp_path / "missing.zip"),)], "path string")
    found = lambda **limits: {r["ordinal"]: r["problem"] for r in split_archive_members(paths, Limits(**limits), 30).where("archive like '%a.zip'").collect()}
    assert found(members=7) == {i: None for i in range(7)} | {7: "member limit"}
    assert found(total_bytes=55) == {i: None if i < 5 else "byte limit" for i in range(20)}
    assert set(found(member_bytes=9).values()) == {"byte limit"}
    assert split_archive_members(paths).where("problem like 'invalid archive%'").count() == 1


def test_directories_are_read_once_and_not_by_run(spark, tmp_path):
    """Readers of runs get their entries: names, offsets and sizes are those of the directory, and of each only the run's own."""
    files = {f"{i:03}.txt": f"text {i}" for i in range(200)}
    (tmp_path / "a.zip").write_bytes(archive(files, b"#!/bin/sh\n"))
    paths = spark.createDataFrame([(str(tmp_path / "a.zip"),)], "path string")
    runs = archive_runs(paths, run_bytes=60).orderBy("run").collect()
    assert [n for r in runs for n in r["names"]] == list(files) and all(len(r["names"]) == r["members"] <= 10 for r in runs)
    assert [r["before"] for r in runs] == [sum(map(len, list(files.values())[: r["first"]])) for r in runs] and {r["prefix"] for r in runs} == {10}


def test_archive_split_has_all_members_of_large_archives(spark, duck, tmp_path):
    """More members than archives of strangers may have."""
    from sparkloom.plans.queries import ORACLE_SQL, QUERIES

    path = f"{tmp_path}/part.parquet"
    duck.sql(f"copy (select * replace ('Brand#1' as p_brand, k::bigint as p_partkey) from (select * from part limit 1), range({Limits().members + 5}) r(k)) to '{path}' (format parquet)")
    sql = ORACLE_SQL["archive_split"].replace("FROM part", f"FROM '{path}'")
    found = QUERIES["archive_split"](spark, str(tmp_path)).select("archive", "ordinal", "filename", "content", "problem").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(duck.sql(sql).fetchall(), key=repr)
