import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sparkloom.contracts import ContractError
from sparkloom.plans import workload as w


def raw(*queries):
    return json.dumps({"schema": w.WORKLOAD, "queries": [{"name": f"q{i}", "sql": s, "params": p} for i, (s, p) in enumerate(queries)]}).encode()


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("conversations", "orders")}


def test_reports(spark, tables, tmp_path):
    text = raw(("select role, count(*) as n from conversations where conv_id = ? group by role", [1]), ("with t as (select o_custkey from orders where o_totalprice > ?) select count(*) as n from t", [1000.0]))
    plain = w.observe(spark, text, tables)
    assert [q["complete"] for q in plain["queries"]] == [False, False] and "digest" not in plain["queries"][0]
    full = w.observe(spark, text, tables, samples=2)
    assert full["queries"][1]["rows"] == 1 and full["queries"][1]["digest"].startswith("sha256:")
    assert "select" not in json.dumps(full)
    path = str(tmp_path / "r.json")
    assert w.save_report(full, path).startswith("sha256:")
    with pytest.raises(FileExistsError):
        w.save_report(full, path)


@pytest.mark.parametrize(
    "sql",
    [
        "select * from orders where o_orderstatus like 'F%'", "select random() as r", "select * from other", "select * from parquet.`/tmp/x`", "select reflect('java.lang.Runtime', 'x') as x",
        "with recursive t(n) as (select 1 union all select n + 1 from t where n < 3) select n from t", "select explode(array(1, 2))", "select * from range(5)",
        "select (select rand() as r) as x from orders", "select * from orders where o_orderkey in (select now())", "select row_number() over (order by o_orderkey) as r from orders", "select listagg(role) as x from conversations",
    ],
)
def test_refused_statements(spark, tables, sql):
    with pytest.raises(ContractError):
        w.admit(spark, sql, tables)


@pytest.mark.parametrize(
    "sql",
    [
        "select o_custkey, sum(o_totalprice) as t from orders group by o_custkey having count(*) > 2 order by t desc nulls last limit 5 offset 1", "select a.role from conversations a left join orders b on a.conv_id = b.o_orderkey where b.o_custkey is null or a.turn between 1 and 3",
        "select conv_id from conversations union select o_orderkey from orders", "select count(distinct role) as n, count(*) filter (where turn > 1) as k from conversations", "select sum(turn) over (partition by conv_id order by turn rows between 1 preceding and current row) as s from conversations",
        "select case when turn = 1 then 'a' else role || 'b' end as x, cast(turn as string) as y, turn & 3 as z from conversations where exists (select 1 from orders where o_orderkey = conv_id)", "select o_custkey from orders except select conv_id from conversations where conv_id not in (1, 2)",
    ],
)
def test_admitted_statements(spark, tables, sql):
    w.admit(spark, sql, tables)


@pytest.mark.parametrize(
    "data",
    [b"{", b'{"schema":"x","schema":"y","queries":[]}', raw(), raw(("delete from orders", [])), raw(("select 1; select 2", [])), raw(("select 1 -- x", [])), raw(("select ?", [True])), raw(("select ?", ["x" * 2000])), raw(("select 1 " + "x" * 3000, []))],
)
def test_refused_workloads(data):
    with pytest.raises(ContractError):
        w.read_workload(data)


def test_caps(spark, tables):
    with pytest.raises(ContractError):
        w.observe(spark, raw(("select * from orders", [])), tables, samples=1, rows=5)
    with pytest.raises(ContractError):
        w.observe(spark, raw(("select 1 as x", [])), tables, samples=9)


def test_compare(spark, tables):
    orders = tables["orders"]
    found = w.compare({"a": orders.groupBy("o_custkey").count(), "b": orders.groupBy("o_custkey").agg({"*": "count"}).withColumnRenamed("count(1)", "count")}, 2)
    assert found["a"]["items"] == found["b"]["items"]
    with pytest.raises(ContractError):
        w.compare({"a": orders.select("o_custkey"), "b": orders.select("o_orderkey")}, 1)


@pytest.mark.parametrize(
    "sql, value",
    [
        ("select hex(12) as x", "3132"), ("select upper('é') as x", "é"), ("select substr('abc', 0, 2) as x", "a"), ("select 7 div 2 as x", 3), ("select round(2) as x", 2.0), ("select trim('xaxx', 'x') as x", "a"), ("select 7.0 / 2 as x", 3.5),
        ("select (select upper(lower('Ab')) as y) || '😀' || hex('a') as x", "AB😀61"), ("with t as (select lower('A') as y) select max(y) as x from t where exists (select hex(1) as h)", "a"),
    ],
)
def test_meaning(spark, tables, sql, value):
    assert float(w.run_admitted(spark, sql, tables).first()["x"]) == value if isinstance(value, float) else w.run_admitted(spark, sql, tables).first()["x"] == value


@pytest.mark.parametrize("sql", ["select substring('abc' from 2 for 1) as x", "select typeof(1, 2) as x", "select `max`(1, 2) as x", "select greatest(1, 2) as x"])
def test_other_meanings_are_refused(spark, tables, sql):
    with pytest.raises(Exception):  # noqa: B017  the parser refuses the second
        w.run_admitted(spark, sql, tables).collect()


ROWS = [(1, 7, 2, 2.5, "abc"), (1, 9, 0, -2.5, "Éa b"), (2, -7, 2, None, ""), (2, None, 3, 0.0, None), (3, 5, -2, 1e3, "xyzxyz"), (None, 4, 4, 4.0, "q")]
STATEMENTS = [
    "select a / b as x, a % b as y, r / b as z, (a + 1) / (b + 1) as v, a / b / 2 as u from t",
    "select max(a, b) as x, min(a, b, 3) as y, max(a, max(b, 4)) as z, min(s, 'b') as v from t",
    "select typeof(a) as x, typeof(r) as y, typeof(s) as z, typeof(a + r) as v, typeof(null) as u, typeof(a / b) as q from t",
    "select hex(s) as x, hex(a) as y, hex(null) as z, hex(substr(s, 2)) as v from t",
    "select g, max(a) as x, s from t where a is not null group by g",
    "select g as k, s as held, min(a) as x, b from t where a is not null group by g",
    "select max(a) as x, s, b from t",
    "select g, count(*) as n, sum(a) / count(*) as mean from t group by g",
    "select (select max(a) / 2 from t) as x, upper(s) as y from t where a / 2 > 2",
    "with v as (select a / 2 as h, s from t) select h, max(h, 3) as m, s from v where h <> 1 or h is null",
]


@pytest.mark.parametrize("sql", [*STATEMENTS, "select r / (a / b) as x, a / (b / (g + 1)) as y from t"])
def test_statements_give_the_rows_of_sqlite(spark, sql):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("create table t (g integer, a integer, b integer, r real, s text)")
    db.executemany("insert into t values (?, ?, ?, ?, ?)", ROWS)
    df = spark.createDataFrame(ROWS, "g long, a long, b long, r double, s string")
    assert sorted(map(tuple, w.run_admitted(spark, sql, {"t": df}).collect()), key=repr) == sorted(db.execute(sql).fetchall(), key=repr)


def test_substr_of_all_places(spark):
    import sqlite3

    db, cases = sqlite3.connect(":memory:"), [(s, a, n) for s in ("abcd", "", "é😀z") for a in range(-6, 7) for n in range(-6, 7)]
    df = spark.createDataFrame(cases, "s string, a int, n int")
    found = w.run_admitted(spark, "select s, a, n, substr(s, a, n) as x, substr(s, a) as y, substr(s, null) as z from t", {"t": df}).collect()
    for s, a, n, x, y, z in found:
        assert (x, y, z) == db.execute("select substr(?, ?, ?), substr(?, ?), substr(?, null)", (s, a, n, s, a, s)).fetchone(), (s, a, n)


def test_tables_are_what_was_passed(spark, tables):
    nation = spark.read.parquet(f"{SMALL}/nation.parquet")
    count = lambda df, sql="select count(*) as n from t": w.run_admitted(spark, sql, {"t": df}).first()["n"]
    assert count(nation.where("n_regionkey = 2")) == nation.where("n_regionkey = 2").count() < nation.count()
    assert count(nation.withColumnRenamed("n_name", "called"), "select count(called) as n from t") == nation.count()
    assert count(nation.join(spark.read.parquet(f"{SMALL}/region.parquet"), nation["n_regionkey"] == F.col("r_regionkey")).where("r_regionkey = 1"), "select count(r_name) as n from t") == nation.where("n_regionkey = 1").count()
    report = w.observe(spark, raw(("select count(*) as n from t", [])), {"t": nation.where("n_regionkey = 2")}, samples=1)
    assert report["queries"][0]["rows"] == 1 and not spark.catalog.listTables("global_temp")
    assert not [t for t in spark.catalog.listTables() if t.name == "t"]


def test_replaced_files_are_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    before = w.fingerprint({"t": spark.read.parquet(path)})
    assert w.fingerprint({"t": spark.read.parquet(path)}) == before
    os.utime(next((tmp_path / "t").glob("*.parquet")), (1, 1))
    assert w.fingerprint({"t": spark.read.parquet(path)}) != before


@pytest.mark.parametrize(
    "sql, as_written",
    [
        ("select a / b as x from t", False), ("select r / (a / b) as x from t", False), ("select (select a / 2 as y from t limit 1) as x", False), ("select max(a, 3) as x from t", False), ("select typeof(a) as x from t", False), ("select max(a) as x, s from t", False),
        ("select a div b as x from t", True), ("select r / 2 as x from t", True), ("select max(a) as x from t", True), ("select g, max(a) as x from t group by g", True), ("select hex(s) as x from t", True),
    ],
)
def test_statements_admitted_as_written(spark, sql, as_written):
    tables = {"t": spark.createDataFrame(ROWS, "g long, a long, b long, r double, s string")}
    own = w.session_of(spark, tables)
    w.prepare(own, sql, tables)
    if as_written:
        w.prepare(own, sql, tables, as_written=True)
    else:
        with pytest.raises(ContractError):
            w.prepare(own, sql, tables, as_written=True)
