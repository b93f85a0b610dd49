"""Registered queries of the relational operators and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import hashlib
import json
import sqlite3
import string
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..functions import sqlite
from ..functions.digest import ordered_digest, typed_digest
from ..functions.text import KEYWORDS, STEMS, escape_untrusted, keyword_hits
from ..operators import approximate, blocks, bounds, compact, evidence, pairs, pareto, sets
from ..operators.coordination import IdLedger, salted_join
from ..operators.order import budgeted_best, with_ordinal
from ..operators.search import LEDGER, successive_halving
from ..shared import SharedTable, shared_folder
from ..sources.archives import Limits, archive_members, read_split_archives, within_budget
from ..sources.archives import summary as archive_totals
from ..sources.paths import without_sidecars
from ..sources.sqlite import inventory as sqlite_inventory
from ..sources.sqlite import read_sqlite
from ..streaming.replay import prefix, windowed_counts
from ..streaming.snapshot import Snapshot
from . import workload
from .choice import Calibrated, Route
from .reuse import Materialized, parity, regressions, signature
from .surface import EXTENSIONS, SURFACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _array(spark, sf_dir, table, idx, value):
    return pairs.indexed(read(spark, sf_dir, table), idx, value)


def _customers(spark, d):
    return _array(spark, d, "customer", "c_custkey", "c_nationkey")


def _suppliers(spark, d):
    return _array(spark, d, "supplier", "s_suppkey", "s_nationkey")


def _nations(spark, d):
    return _array(spark, d, "nation", "n_nationkey", "n_regionkey")


def _regions(spark, d):
    return _array(spark, d, "region", "r_regionkey", "r_regionkey")


PAIRS = "SELECT s_nationkey + n_regionkey AS key, s_suppkey AS \"left\", n_nationkey AS \"right\" FROM supplier CROSS JOIN nation"


@query(PAIRS)
def pair_sums(spark, d):
    return pairs.pair_sums(_suppliers(spark, d), _nations(spark, d))


@query(f"SELECT * FROM ({PAIRS}) ORDER BY 1, 2, 3 LIMIT 50")
def pair_topk(spark, d):
    """The report of the first 50 pairs, from the whole enumeration."""
    return pairs.ordered(pairs.pair_sums(_suppliers(spark, d), _nations(spark, d))).limit(50)


@query(f"SELECT * FROM ({PAIRS}) ORDER BY 1, 2, 3 LIMIT 50")
def pair_topk_pruned(spark, d):
    return pairs.pair_prefix(_suppliers(spark, d), _nations(spark, d), 50)


@query(f"SELECT * FROM ({PAIRS}) ORDER BY 1, 2, 3 LIMIT 1")
def pair_peek(spark, d):
    return pairs.peek(pairs.pair_sums(_suppliers(spark, d), _nations(spark, d)))


RESIDUE = f"SELECT * FROM ({PAIRS}) WHERE ((key % 7) + 7) % 7 = 3"


@query(RESIDUE)
def residue_filter(spark, d):
    return pairs.pairs_by_filter(_suppliers(spark, d), _nations(spark, d), 7, 3)


@query(RESIDUE)
def residue_bucketed(spark, d):
    return pairs.pairs_by_residue(_suppliers(spark, d), _nations(spark, d), 7, 3)


@query(f"SELECT count(*)::BIGINT AS matches FROM ({RESIDUE})")
def residue_count(spark, d):
    return pairs.residue_count(_suppliers(spark, d), _nations(spark, d), 7, 3).select(F.col("matches").cast("long"))


def _keys(spark, d):
    """Arrays whose values are the keys themselves, so sums spread widely."""
    return (
        _array(spark, d, "supplier", "s_suppkey", "s_suppkey"),
        _array(spark, d, "nation", "n_nationkey", "n_nationkey"),
        _array(spark, d, "customer", "c_custkey", "c_custkey"),
        _array(spark, d, "region", "r_regionkey", "r_regionkey"),
    )


EQUAL = """
SELECT l.key, l.a AS l_left, l.b AS l_right, r.a AS r_left, r.b AS r_right
FROM (SELECT s_suppkey + n_nationkey AS key, s_suppkey AS a, n_nationkey AS b FROM supplier CROSS JOIN nation) l
JOIN (SELECT c_custkey + r_regionkey AS key, c_custkey AS a, r_regionkey AS b FROM customer CROSS JOIN region) r USING (key)"""


@query(EQUAL)
def equal_sum_join(spark, d):
    return pairs.equal_sum_join(*_keys(spark, d))


@query(EQUAL)
def equal_sum_merge(spark, d):
    return pairs.equal_sum_join(*_keys(spark, d), hint="merge")


@query(f"SELECT (SELECT count(*) FROM ({EQUAL}))::BIGINT AS matches, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer CROSS JOIN region GROUP BY c_custkey + r_regionkey))::BIGINT AS largest_tie")
def equal_sum_count(spark, d):
    return pairs.equal_sum_count(*_keys(spark, d)).select(F.col("matches").cast("long"), F.col("largest_tie").cast("long"))


@query(f"SELECT count(*)::BIGINT AS items, sha256(string_agg(concat_ws(',', key, \"left\", \"right\"), chr(10) ORDER BY key, \"left\", \"right\")) AS digest FROM ({PAIRS})")
def pair_digest(spark, d):
    return ordered_digest(pairs.pair_sums(_suppliers(spark, d), _nations(spark, d)), most=10_000_000)


def _ledger(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), (F.col("p_size") != 13).alias("feasible"))


TWO = {"price": "minimize", "size": "maximize"}
SKYLINE = """
WITH l AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size, p_size <> 13 AS feasible FROM part)
SELECT * FROM l r WHERE feasible AND NOT EXISTS (SELECT 1 FROM l o WHERE o.feasible AND o.price <= r.price AND o.size >= r.size AND (o.price < r.price OR o.size > r.size))"""


@query(SKYLINE)
def pareto_two(spark, d):
    return pareto.skyline(pareto.validated(_ledger(spark, d), TWO), TWO)


@query(SKYLINE)
def pareto_window(spark, d):
    return pareto.skyline_two(_ledger(spark, d), TWO)


THREE = {"price": "minimize", "discount": "maximize", "tax": "minimize"}


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_quantity > 1 AS feasible FROM lineitem),
b AS (SELECT discount, tax, min(price) AS price FROM l WHERE feasible GROUP BY ALL)
SELECT * FROM l r WHERE feasible AND NOT EXISTS (SELECT 1 FROM b o WHERE o.price <= r.price AND o.discount >= r.discount AND o.tax <= r.tax AND (o.price < r.price OR o.discount > r.discount OR o.tax < r.tax))""")
def pareto_three(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_quantity") > 1).alias("feasible"))
    return pareto.skyline(rows, THREE)


FOUR = {"price": "maximize", "quantity": "minimize", "discount": "minimize", "tax": "minimize"}


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag <> 'R' AS feasible FROM lineitem),
b AS (SELECT quantity, discount, tax, max(price) AS price FROM l WHERE feasible GROUP BY ALL)
SELECT * FROM l r WHERE feasible AND NOT EXISTS (SELECT 1 FROM b o WHERE o.price >= r.price AND o.quantity <= r.quantity AND o.discount <= r.discount AND o.tax <= r.tax AND (o.price > r.price OR o.quantity < r.quantity OR o.discount < r.discount OR o.tax < r.tax))""")
def pareto_lattice(spark, d):
    """Prices grow with quantities, so many lines are on the front: all points meet in the lattice."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_returnflag") != "R").alias("feasible"))
    return pareto.skyline(rows, FOUR, most=0)


@query("""
WITH p AS (SELECT p_partkey, (p_size - 20)::BIGINT AS c0, (p_partkey % 41 - 30)::BIGINT AS c1, (p_partkey % 17)::BIGINT AS c2 FROM part)
SELECT *, least(2 * c0, 2 * c0 + c1, 2 * (c0 + c1 + c2)) >= 0 AS certified FROM p""")
def bernstein_quadratic(spark, d):
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k, (F.col("p_size") - 20).cast("long").alias("c0"), (k % 41 - 30).cast("long").alias("c1"), (k % 17).cast("long").alias("c2"))
    return bounds.quadratic_bound(rows, "c0", "c1", "c2")


@query("""
WITH p AS (SELECT p_partkey, (p_size - 20)::BIGINT AS c0, (p_partkey % 41 - 30)::BIGINT AS c1, (p_partkey % 17)::BIGINT AS c2 FROM part),
m AS (SELECT *, CASE WHEN c2 = 0 THEN least(c0, c0 + c1)::DOUBLE WHEN -c1 <= 0 OR -c1 >= 2 * c2 THEN least(c0, c0 + c1 + c2)::DOUBLE ELSE c0 - (c1 * c1)::DOUBLE / (4 * c2) END AS least_value FROM p)
SELECT p_partkey, CASE WHEN least_value < 0 THEN 'negative' ELSE 'nonnegative' END AS sign FROM m""")
def certified_quadratic(spark, d):
    """Sign of the quadratics by certificates of up to 64 splits; those that stay open, touching zero between all halves, by their roots."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k, (F.col("p_size") - 20).alias("c0"), (k % 41 - 30).alias("c1"), (k % 17).alias("c2"))
    text = lambda *cs: F.array(*[F.col(c).cast("string") for c in cs])
    top = F.when(F.col("c2") != 0, text("c0", "c1", "c2")).when(F.col("c1") != 0, text("c0", "c1")).otherwise(text("c0"))
    problem = rows.select("p_partkey", top.alias("numerator"), F.array(F.lit("1")).alias("denominator"), F.array(F.lit("0"), F.lit("1")).alias("domain"), F.lit("0").alias("lower"), F.lit(False).alias("strict"))
    checked = bounds.settle_rows(bounds.verify_rows(bounds.certify_rows(problem, 64)))
    return checked.select("p_partkey", F.when(F.col("settled") == "certified", "nonnegative").when(F.col("settled") == "violated", "negative").otherwise("open").alias("sign"))


# Problems with the status that each must get (name, numerator, denominator, lower, strict, status).
FROZEN_PROBLEMS = (
    ("direct", "1,1", "1", "0", False, "certified"), ("subdivision", "13/50,-1,1", "1", "1/100", False, "certified"), ("violation", "-1,1", "1", "0", False, "violated"),
    ("boundary", "0,0,1", "1", "0", False, "certified"), ("boundary-strict", "0,0,1", "1", "0", True, "violated"), ("rational", "1", "1,1", "0", False, "certified"),
    ("crossing", "1", "-1,2", "0", False, "invalid_domain"), ("zero", "0", "0,1", "0", False, "invalid_domain"), ("near-zero", "1", "1/1000000,1", "0", False, "certified"),
    ("denominator", "1", "13/50,-1,1", "0", False, "certified"),
)


@query(f"SELECT name, status AS expected, status, status AS verified, true AS agrees FROM (VALUES {', '.join(f"('{p[0]}', '{p[-1]}')" for p in FROZEN_PROBLEMS)}) f(name, status)")
def certificate_replay(spark, d):
    """Certificates of the frozen problems, verified and held against their statuses."""
    rows = spark.createDataFrame(list(FROZEN_PROBLEMS), "name string, n string, d string, lower string, strict boolean, status string")
    problems = rows.select("name", F.split("n", ",").alias("numerator"), F.split("d", ",").alias("denominator"), F.array(F.lit("0"), F.lit("1")).alias("domain"), "lower", "strict")
    return bounds.replay(problems, rows)


MEASURED = ", ".join(f"'{s}'" for s in evidence.MEASURED)


@query(f"SELECT status, scope, status IN ({MEASURED}) AND scope = 'historicalObservation' AS allowed FROM (VALUES {', '.join(f"('{s}')" for s in evidence.STATUSES)}) s(status), (VALUES {', '.join(f"('{s}')" for s in evidence.SCOPES)}) c(scope)")
def claim_matrix(spark, d):
    return evidence.claim_matrix(spark)


@query("""
WITH u AS (SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS cpu, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS memory, n_regionkey AS io FROM nation)
SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND a.cpu + b.cpu <= 120 AND a.memory + b.memory <= 9 AND a.io + b.io <= 5""")
def composable_pairs(spark, d):
    customers = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("cpu"))
    suppliers = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("memory"))
    uses = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("io")).join(customers, "id", "left").join(suppliers, "id", "left").fillna(0)
    return evidence.composable_pairs(uses, {"cpu": 120, "memory": 9, "io": 5})


@query("SELECT l_orderkey AS key, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) <> 1")
def integrity_exactly_once(spark, d):
    return evidence.not_once(read(spark, d, "lineitem"), "l_orderkey")


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def integrity_missing(spark, d):
    return evidence.unknown_keys(read(spark, d, "customer"), "c_custkey", _by_status(spark, d, "F"), "o_custkey")


@query("SELECT DISTINCT doc_id AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def integrity_unknown(spark, d):
    return evidence.unknown_keys(read(spark, d, "labels"), "doc_id", read(spark, d, "documents"), "doc_id")


@query("SELECT o_orderkey AS key, o_orderstatus AS left_status, l_linestatus AS right_status FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderstatus IS DISTINCT FROM l_linestatus")
def integrity_status(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return evidence.status_disagreements(read(spark, d, "orders"), lines, "o_orderkey", "o_orderstatus")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS distinct_values FROM orders GROUP BY 1")
def bitmap_distinct(spark, d):
    return sets.cardinality(sets.bitmaps(read(spark, d, "orders"), "o_custkey", "o_orderstatus"), "o_orderstatus")


def _by_status(spark, d, status):
    return read(spark, d, "orders").where(F.col("o_orderstatus") == status)


@query("SELECT count(*) AS common FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def bitmap_intersection(spark, d):
    a, b = (sets.bitmaps(_by_status(spark, d, s), "o_custkey") for s in "OF")
    return sets.cardinality(sets.intersection(a, b)).select(F.coalesce("distinct_values", F.lit(0)).alias("common"))


@query("SELECT count(*) AS either FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def bitmap_union(spark, d):
    a, b = (sets.bitmaps(_by_status(spark, d, s), "o_custkey") for s in "OF")
    return sets.cardinality(sets.union(a, b)).select(F.coalesce("distinct_values", F.lit(0)).alias("either"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    return sets.difference(_by_status(spark, d, "O"), _by_status(spark, d, "F"), "o_custkey")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def bitmap_membership(spark, d):
    return sets.contains(sets.bitmaps(_by_status(spark, d, "O"), "o_custkey"), read(spark, d, "customer"), "c_custkey")


CUST_AND_PART = "(SELECT DISTINCT o_custkey AS value FROM orders) {0} (SELECT DISTINCT l_partkey AS value FROM lineitem)"


def _keysets(spark, d):
    return compact.compact(read(spark, d, "orders"), "o_custkey"), compact.compact(read(spark, d, "lineitem"), "l_partkey")


@query(CUST_AND_PART.format("UNION"))
def compact_union(spark, d):
    return compact.members(compact.union(*_keysets(spark, d)))


@query(CUST_AND_PART.format("INTERSECT"))
def compact_intersection(spark, d):
    return compact.members(compact.intersection(*_keysets(spark, d)))


@query("SELECT DISTINCT l_returnflag, l_partkey AS value FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT DISTINCT l_returnflag, l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 25")
def compact_difference(spark, d):
    """Parts by flag: sparse sets less dense ones."""
    lines = read(spark, d, "lineitem")
    few, many = lines.where("l_quantity > 49"), lines.where("l_linestatus = 'F' and l_quantity < 25")
    return compact.members(compact.difference(*(compact.compact(x, "l_partkey", "l_returnflag") for x in (few, many)), "l_returnflag"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def compact_contains(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return compact.contained(lines, "l_partkey", compact.compact(_by_status(spark, d, "P"), "o_custkey"))


@query("""
WITH v AS (SELECT DISTINCT l_shipdate::DATE AS day, l_partkey // 32768 AS bucket, l_partkey % 32768 AS place FROM lineitem),
r AS (SELECT *, coalesce(place <> lag(place) OVER (PARTITION BY day, bucket ORDER BY place) + 1, true) AS starts FROM v),
c AS (SELECT day, bucket, count(*) AS n, count(*) FILTER (starts) AS runs FROM r GROUP BY 1, 2),
k AS (SELECT n, CASE WHEN 4 * runs < 2 * n AND 4 * runs < 4096 THEN 'runs' WHEN 2 * n < 4096 THEN 'array' ELSE 'words' END AS kind, runs FROM c
  UNION ALL SELECT n, CASE WHEN 4 * runs < 2 * n AND 4 * runs < 4096 THEN 'runs' WHEN 2 * n < 4096 THEN 'array' ELSE 'words' END, runs FROM (
    SELECT count(*) AS n, count(*) FILTER (starts) AS runs FROM (SELECT bucket, place, coalesce(place <> lag(place) OVER (PARTITION BY bucket ORDER BY place) + 1, true) AS starts FROM (SELECT DISTINCT l_orderkey // 32768 AS bucket, l_orderkey % 32768 AS place FROM lineitem)) GROUP BY bucket))
SELECT kind, count(*) AS containers, sum(n)::BIGINT AS numbers, sum(CASE kind WHEN 'runs' THEN 4 * runs WHEN 'array' THEN 2 * n ELSE 4096 END)::BIGINT AS bytes FROM k GROUP BY 1""")
def compact_sizes(spark, d):
    """Bytes by form: the parts of each day, and all orders."""
    lines = read(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return compact.sizes(compact.compact(lines, "l_partkey", "day").drop("day").union(compact.compact(lines, "l_orderkey")))


BETWEEN = "SELECT o_orderkey + c_custkey AS key, o_orderkey AS left, c_custkey AS right FROM orders, customer WHERE o_orderkey + c_custkey BETWEEN 200 AND 320"


@query(BETWEEN)
def pairs_between(spark, d):
    """Orders and customers whose keys add up to little: most blocks of orders are skipped."""
    return blocks.sums_between(_array(spark, d, "orders", "o_orderkey", "o_orderkey"), _array(spark, d, "customer", "c_custkey", "c_custkey"), 200, 320, 64)


APART = "SELECT l.key, l_left, l_right, r_left, r_right FROM (SELECT p_partkey + r_regionkey AS key, p_partkey AS l_left, r_regionkey AS l_right FROM part, region) l JOIN (SELECT s_suppkey + n_nationkey + 150 AS key, s_suppkey AS r_left, n_nationkey AS r_right FROM supplier, nation) r ON l.key = r.key"


def _apart(spark, d):
    nations = pairs.indexed(read(spark, d, "nation").withColumn("v", F.col("n_nationkey") + 150), "n_nationkey", "v")
    return _array(spark, d, "part", "p_partkey", "p_partkey"), _array(spark, d, "region", "r_regionkey", "r_regionkey"), _array(spark, d, "supplier", "s_suppkey", "s_suppkey"), nations


@query(APART)
def pruned_equal_sums(spark, d):
    return blocks.pruned_equal_sums(*_apart(spark, d), size=32)


@query("""
WITH p AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 32 AS i, p_partkey AS v FROM part), s AS (SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 32 AS i, s_suppkey AS v FROM supplier),
l AS (SELECT i, min(v) + (SELECT min(r_regionkey) FROM region) AS low, max(v) + (SELECT max(r_regionkey) FROM region) AS high, count(*) * (SELECT count(*) FROM region) AS pairs FROM p GROUP BY i),
r AS (SELECT i, min(v) + 150 + (SELECT min(n_nationkey) FROM nation) AS low, max(v) + 150 + (SELECT max(n_nationkey) FROM nation) AS high, count(*) * (SELECT count(*) FROM nation) AS pairs FROM s GROUP BY i),
lk AS (SELECT * FROM l WHERE EXISTS (SELECT 1 FROM r WHERE l.low <= r.high AND r.low <= l.high)), rk AS (SELECT * FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.low <= r.high AND r.low <= l.high))
SELECT 'left' AS side, (SELECT count(*) FROM l) AS blocks, (SELECT count(*) FROM lk) AS kept, (SELECT sum(pairs)::BIGINT FROM l) AS pairs, (SELECT coalesce(sum(pairs), 0)::BIGINT FROM lk) AS kept_pairs
UNION ALL SELECT 'right', (SELECT count(*) FROM r), (SELECT count(*) FROM rk), (SELECT sum(pairs)::BIGINT FROM r), (SELECT coalesce(sum(pairs), 0)::BIGINT FROM rk)""")
def pruned_blocks(spark, d):
    """How many blocks and pairs the pruned join looks at."""
    return blocks.pruned_share(*_apart(spark, d), size=32)


#: Besides the performance terms, those of rights notices, which the tables have.
SCANNED = f"{KEYWORDS}|licen[sc]e|all[- ]rights|public[- ]domain"


@query(f"""
WITH l AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS lineno FROM documents),
m AS (SELECT doc_id, lineno, string_split(text, chr(10))[lineno] AS line FROM l)
SELECT doc_id AS key, lineno::INTEGER AS lineno, regexp_extract(line, '(?i){SCANNED}') AS match
FROM m WHERE regexp_matches(line, '(?i){SCANNED}')""")
def keyword_scan(spark, d):
    return keyword_hits(read(spark, d, "documents"), "doc_id", "text", SCANNED, stems=(*STEMS, "licen", "rights", "domain")).select("key", "lineno", "match")


@query("SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 50000 AS \"within\" FROM documents")
def budget_cutoff(spark, d):
    return within_budget(read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["doc_id"], "n_chars", 50_000, ["source"])


@query("""
SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, hex(p_size::VARCHAR) AS hexed, 'integer' AS kind, p_partkey // 7 AS seventh, CASE WHEN p_size = 0 THEN NULL ELSE p_partkey // p_size END AS share, substr(p_brand, 1, 2) AS head, greatest(p_size, 9)::BIGINT AS most FROM part""")
def sqlite_functions(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(k, sqlite.lower(F.col("p_name")).alias("low"), sqlite.hex_text(n).alias("hexed"), sqlite.typeof(n).alias("kind"), sqlite.divide(k, F.lit(7)).alias("seventh"), sqlite.divide(k, n).alias("share"), sqlite.substr(F.col("p_brand"), 0, 3).alias("head"), sqlite.greatest(n.cast("long"), F.lit(9)).cast("long").alias("most"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(read(spark, d, "events"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders")
def global_ordinal(spark, d):
    return with_ordinal(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("ordinal").cast("long"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS \"within\" FROM lineitem GROUP BY 1")
def approx_distinct(spark, d):
    return approximate.checked_distinct(read(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT event_type, count(*) AS n, true AS \"within\" FROM events GROUP BY 1")
def approx_quantile(spark, d):
    return approximate.checked_quantile(read(spark, d, "events"), "value", "event_type")


@query("SELECT o_custkey AS item, count(*) AS n, true AS \"within\" FROM orders GROUP BY 1 ORDER BY n DESC, item LIMIT 5")
def approx_topk(spark, d):
    return approximate.checked_top_k(read(spark, d, "orders"), "o_custkey", 5, 1_000)


@query("SELECT count(DISTINCT l_partkey) AS exact, true AS \"within\" FROM lineitem")
def approx_merged(spark, d):
    return approximate.merged_distinct(read(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query(f"SELECT record, status, status IN ({MEASURED}) AS historical FROM (VALUES {', '.join(f"('{r}', '{s}')" for r, s in evidence.FROZEN.items())}) f(record, status)")
def frozen_records(spark, d):
    df = spark.createDataFrame(list(evidence.FROZEN.items()), "record string, status string")
    return df.withColumn("historical", evidence.measured_claim_allowed(F.col("status"), F.lit("historicalObservation")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 2 END AS price FROM orders")
def invariant_reuse(spark, d):
    """Reuses a value where its invariant holds and recomputes it elsewhere."""
    holds = (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")
    return read(spark, d, "orders").select("o_orderkey", evidence.invariant_reuse(holds, F.col("o_totalprice"), F.col("o_totalprice") * 2).alias("price"))


@query("SELECT sum(n * k)::BIGINT AS matches FROM (SELECT s_nationkey AS key, count(*) AS n FROM supplier GROUP BY 1) JOIN (SELECT c_nationkey AS key, count(*) AS k FROM customer GROUP BY 1) USING (key)")
def frequency_join(spark, d):
    """Number of joined rows from the frequencies of both sides."""
    a = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n"))
    b = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("k"))
    return a.join(b, "key").agg(F.sum(F.col("n") * F.col("k")).alias("matches"))


def _surface(name: str, spark_sql: str):
    tables = sorted({t for _, t, _, _ in string.Formatter().parse(spark_sql) if t})
    if name in EXTENSIONS:
        return lambda spark, d: spark.sql(spark_sql, **{t: read(spark, d, t) for t in tables})
    return lambda spark, d: workload.run_admitted(spark, spark_sql.replace("{", "").replace("}", ""), {t: read(spark, d, t) for t in tables})


for _name, (_spark, _duck) in SURFACE.items():
    QUERIES[_name] = _surface(_name, _spark)
    ORACLE_SQL[_name] = (_duck or _spark).replace("{", "").replace("}", "")


# --- workloads, sources, measurement and evidence


def _values(rows: list[tuple], names: str) -> str:
    """SQL of constant rows."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


def _refused(run) -> bool:
    try:
        run()
    except ContractError:
        return True
    return False


# Statements and whether they are admitted.
STATEMENTS = (
    ("aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 2", True), ("window", "SELECT max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders", True),
    ("cte", "WITH t AS (SELECT o_custkey FROM orders) SELECT count(*) AS n FROM t", True), ("set", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer", True),
    ("like", "SELECT o_custkey FROM orders WHERE o_orderstatus LIKE 'F%'", False), ("random", "SELECT random() AS r", False), ("other table", "SELECT * FROM elsewhere", False), ("file", "SELECT * FROM parquet.`/tmp/x`", False),
    ("recursion", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT n FROM t", False), ("reflection", "SELECT reflect('java.lang.Runtime', 'x') AS x", False),
    ("scalar max", "SELECT max(o_custkey, 3) AS m FROM orders", False), ("division", "SELECT o_custkey / 7 AS s FROM orders", False), ("whole division", "SELECT o_custkey div 7 AS s FROM orders", True), ("real division", "SELECT o_totalprice / 2 AS h FROM orders", True),
)


@query(_values([(n, ok) for n, _, ok in STATEMENTS], "name, admitted"))
def workload_admission(spark, d):
    """Whether statements are admitted as they are written, with none of their operators rewritten."""
    tables = {t: read(spark, d, t) for t in ("orders", "customer")}
    own = workload.session_of(spark, tables)
    return spark.createDataFrame([(n, not _refused(lambda s=s: workload.prepare(own, s, tables, as_written=True))) for n, s, _ in STATEMENTS], "name string, admitted boolean")


def _workload(*queries) -> bytes:
    return json.dumps({"schema": workload.WORKLOAD, "queries": [{"name": n, "sql": s, "params": p} for n, s, p in queries]}).encode()


# Workloads that are refused, but for the first.
_ONE = ("q", "SELECT 1 AS x", [])
FORMS = (
    ("good", _workload(_ONE), False), ("no JSON", b"{", True), ("field twice", b'{"schema":"a","schema":"b","queries":[]}', True), ("no queries", _workload(), True), ("name twice", _workload(_ONE, _ONE), True), ("two statements", _workload(("q", "SELECT 1; SELECT 2", [])), True),
    ("comment", _workload(("q", "SELECT 1 -- x", [])), True), ("no select", _workload(("q", "DELETE FROM orders", [])), True), ("long parameter", _workload(("q", "SELECT ? AS x", ["x" * 2000])), True), ("boolean parameter", _workload(("q", "SELECT ? AS x", [True])), True),
)


@query(_values([(n, bad) for n, _, bad in FORMS], "name, refused"))
def workload_form(spark, d):
    return spark.createDataFrame([(n, _refused(lambda raw=raw: workload.read_workload(raw))) for n, raw, _ in FORMS], "name string, refused boolean")


@query("SELECT p_partkey, hex(p_size::VARCHAR) AS hexed, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, substr(p_name, 1, 2) AS head, substr(p_name, 3) AS tail, round(p_retailprice::DOUBLE, 1) AS price, p_partkey // 7 AS seventh, trim(p_brand, 'B1') AS cut FROM part WHERE upper(p_name) <> 'X'")
def workload_functions(spark, d):
    """Functions in admitted statements have SQLite's meaning."""
    sql = "SELECT p_partkey, hex(p_size) AS hexed, upper(p_name) AS up, lower(p_brand) AS low, substr(p_name, 0, 3) AS head, substr(p_name, 3) AS tail, round(p_retailprice, 1) AS price, p_partkey div 7 AS seventh, trim(p_brand, 'B1') AS cut FROM part WHERE upper(p_name) <> 'X'"
    return workload.run_admitted(spark, sql, {"part": read(spark, d, "part")})


@query("SELECT o_custkey, max(o_orderkey) AS latest, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def workload_bare_columns(spark, d):
    """Columns beside a maximum come from its row."""
    sql = "SELECT o_custkey, max(o_orderkey) AS latest, o_orderstatus, o_totalprice AS price FROM orders GROUP BY o_custkey"
    return workload.run_admitted(spark, sql, {"orders": read(spark, d, "orders")})


@query("SELECT p_partkey, p_partkey // 7 AS seventh, CASE WHEN p_size <> 20 THEN p_partkey // (p_size - 20) END AS share, greatest(p_size, 9) AS most, 'integer' AS kind, CASE WHEN p_size <> 20 THEN 'integer' ELSE 'null' END AS of_share, CASE WHEN length(p_brand) >= 2 THEN substr(p_brand, length(p_brand) - 1, 1) ELSE '' END AS before_last, '' AS none FROM part")
def workload_sqlite_meaning(spark, d):
    """Whole division, division by zero, the larger of two, types and lengths below zero, as SQLite has them."""
    sql = "SELECT p_partkey, p_partkey / 7 AS seventh, p_partkey / (p_size - 20) AS share, max(p_size, 9) AS most, typeof(p_size) AS kind, typeof(p_partkey / (p_size - 20)) AS of_share, substr(p_brand, -1, -1) AS before_last, hex(NULL) AS none FROM part"
    return workload.run_admitted(spark, sql, {"part": read(spark, d, "part")})


@query("SELECT n_regionkey AS region, count(*) AS nations, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey = 2 GROUP BY 1")
def workload_derived_tables(spark, d):
    """Statements read the tables that were passed: filtered, renamed and joined ones."""
    nation = read(spark, d, "nation").where("n_regionkey = 2").withColumnRenamed("n_regionkey", "region")
    joined = nation.join(read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return workload.run_admitted(spark, "SELECT region, count(*) AS nations, count(DISTINCT s_suppkey) AS suppliers FROM t GROUP BY region", {"t": joined})


@query("SELECT 'by_status' AS name, count(DISTINCT o_orderstatus)::BIGINT AS rows, true AS complete, 1::BIGINT AS full_scans, 64::BIGINT AS digest_length FROM orders UNION ALL SELECT 'dear', count(*)::BIGINT, true, 0, 64 FROM nation WHERE n_regionkey = 2")
def workload_observe(spark, d):
    raw = _workload(("by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", []), ("dear", "SELECT n_name FROM nation WHERE n_regionkey = ?", [2]))
    report = workload.observe(spark, raw, {t: read(spark, d, t) for t in ("orders", "nation")}, samples=2, seconds=60.0)
    return spark.createDataFrame([(q["name"], q["rows"], q["complete"], q["full_scans"], len(q["digest"].split(":")[1])) for q in report["queries"]], "name string, rows long, complete boolean, full_scans long, digest_length long")


@query(_values([(24, True), (25, False), (26, False)], "cap, raised") + " WHERE (SELECT count(*) FROM nation) = 25")
def workload_row_cap(spark, d):
    """A cap on rows raises and never cuts."""
    nations = read(spark, d, "nation")
    return spark.createDataFrame([(n, _refused(lambda n=n: workload.bounded_run(spark, nations, n, 60.0))) for n in (24, 25, 26)], "cap int, raised boolean")


@query(_values([("timely", False), ("late", True)], "name, raised"))
def workload_time_limit(spark, d):
    slow = spark.range(1 << 40).agg(F.sum(F.expr("id % 7"))).withColumnRenamed("sum((id % 7))", "s")
    rows = [("timely", _refused(lambda: workload.bounded_run(spark, read(spark, d, "region"), 10, 60.0))), ("late", _refused(lambda: workload.bounded_run(spark, slow, 10, 0.5)))]
    return spark.createDataFrame(rows, "name string, raised boolean")


@query("SELECT '[\"queries\",\"schema\"]' AS keys, true AS same, true AS kept")
def report_sink(spark, d):
    """A report in canonical JSON, written once and never replaced."""
    path = f"{tempfile.mkdtemp(prefix='report-')}/report.json"
    digest = workload.save_report({"schema": "x", "queries": [1, 2]}, path)
    raw = Path(path).read_bytes()
    try:
        workload.save_report({}, path)
        kept = False
    except FileExistsError:
        kept = True
    return spark.createDataFrame([(json.dumps(list(json.loads(raw)), separators=(",", ":")), digest == f"sha256:{hashlib.sha256(raw).hexdigest()}", kept)], "keys string, same boolean, kept boolean")


def _sqlite_file(df: DataFrame, table: str, create: str) -> str:
    """A small table as a SQLite file, which Spark ships to the executors."""
    rows = df.collect()
    path = f"{tempfile.mkdtemp(prefix='sqlite-')}/{table}-{uuid.uuid4().hex}.db"  # Spark ships files by name
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute(create)
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", [tuple(r) for r in rows])
        db.execute(f"CREATE INDEX by_name ON {table} ({rows[0].__fields__[1]} COLLATE NOCASE DESC)")
        db.commit()
    return path


NATION_TABLE = "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)"


def _nation_file(spark, d):
    return _sqlite_file(read(spark, d, "nation"), "nation", NATION_TABLE)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def sqlite_scan(spark, d):
    return read_sqlite(spark, _nation_file(spark, d), "nation")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def sqlite_scan_without_rowid(spark, d):
    return read_sqlite(spark, _sqlite_file(read(spark, d, "region"), "region", "CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT) WITHOUT ROWID"), "region")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_regionkey <> 3 THEN n_regionkey::BIGINT END AS n_regionkey, CASE WHEN n_regionkey = 3 THEN '{\"n_regionkey\": [\"str\", \"' || n_name || '\"]}' END AS _misfits FROM nation WHERE n_nationkey > 4 AND n_name >= 'C'")
def sqlite_scan_filtered(spark, d):
    """Filters go into the file's own scan; cells that don't fit their column are told apart, not lost."""
    create = "CREATE TABLE nation (n_nationkey BIGINT, n_name VARCHAR(25) COLLATE NOCASE, n_regionkey INT)"
    nations = read(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 3, F.col("n_name")).otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey"))
    return read_sqlite(spark, _sqlite_file(nations, "nation", create), "nation", misfits="collect").where("n_nationkey > 4 AND n_name >= 'C'")


@query(_values([("table", "nation", 0, "n_nationkey", None, None), ("table", "nation", 1, "n_name", None, None), ("table", "nation", 2, "n_regionkey", None, None), ("index", "by_name", 0, "n_name", "NOCASE", True)], "kind, name, position, column_name, sorted_by, descending"))
def sqlite_catalog(spark, d):
    return sqlite_inventory(spark, _nation_file(spark, d)).where("name <> 'journal_mode'").select("kind", "name", "position", "column_name", F.col("collation").alias("sorted_by"), "descending")


@query(_values([("plain", True), ("parent", False), ("link", False), ("missing", False), ("sidecar", False)], "name, accepted"))
def snapshot_gate(spark, d):
    """Only regular files without links, parent steps or write-ahead logs beside them are read."""
    folder = Path(tempfile.mkdtemp(prefix="gate-"))
    for name in ("a.db", "b.db", "b.db-wal"):
        (folder / name).write_text("x")
    (folder / "link.db").symlink_to(folder / "a.db")
    paths = {"plain": folder / "a.db", "parent": f"{folder}/../{folder.name}/a.db", "link": folder / "link.db", "missing": folder / "none.db", "sidecar": folder / "b.db"}
    return spark.createDataFrame([(n, not _refused(lambda p=p: without_sidecars(str(p)))) for n, p in paths.items()], "name string, accepted boolean")


@query(_values([("unchanged", False), ("replaced", True)], "name, drift"))
def data_drift(spark, d):
    """Files replaced in place change the fingerprint of the tables."""
    table = SharedTable(read(spark, d, "nation"), "drift")
    prints = [workload.fingerprint({"n": table.df}), workload.fingerprint({"n": table.df})]
    read(spark, d, "nation").limit(3).write.mode("overwrite").parquet(table.path)
    prints.append(workload.fingerprint({"n": spark.read.parquet(table.path)}))
    return spark.createDataFrame([("unchanged", prints[0] != prints[1]), ("replaced", prints[1] != prints[2])], "name string, drift boolean")


def _archives(spark, d):
    """A ZIP archive for each region, with a text member for each of its nations and an archive in it."""

    @F.pandas_udf("binary")
    def zipped(names):
        import io
        import zipfile

        import pandas as pd

        def one(members):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for n in sorted(members):
                    z.writestr(f"{n.replace(' ', '_')}.txt", f"{n} cache line")
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as y:
                    y.writestr("deep.md", "inside")
                z.writestr("in.zip", inner.getvalue())
                z.writestr("../up.txt", "never read")
            return out.getvalue()

        return pd.Series([one(list(x)) for x in names])

    own = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return archive_members(own.select(F.format_string("r%s.zip", F.col("n_regionkey")).alias("path"), zipped("names").alias("content")))


ARCHIVES = "SELECT DISTINCT 'r' || n_regionkey || '.zip' AS archive FROM nation"


@query(f"""
SELECT 'r' || n_regionkey || '.zip' AS archive, replace(n_name, ' ', '_') || '.txt' AS filename, 0 AS depth, n_name || ' cache line' AS content, NULL AS problem FROM nation
UNION ALL SELECT archive, 'in.zip', 0, NULL, NULL FROM ({ARCHIVES}) UNION ALL SELECT archive || '!in.zip', 'deep.md', 1, 'inside', NULL FROM ({ARCHIVES}) UNION ALL SELECT archive, '../up.txt', 0, NULL, 'parent traversal' FROM ({ARCHIVES})""")
def archive_inventory(spark, d):
    return _archives(spark, d).select("archive", "filename", "depth", "content", "problem")


@query(f"SELECT (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM ({ARCHIVES})) AS members, 1 AS deepest, (SELECT count(*) FROM nation) + (SELECT count(*) FROM ({ARCHIVES})) AS text_members, (SELECT count(*) FROM ({ARCHIVES})) AS problems, false AS complete")
def archive_summary(spark, d):
    return archive_totals(_archives(spark, d)).select("members", "deepest", "text_members", "problems", "complete")


def _part_archives(spark, d) -> str:
    """A folder with an archive of each brand's parts, behind a line of script."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    spark.createDataFrame([], "x int").write.parquet(folder)  # makes the folder, whatever its file system

    def write(parts):
        import re
        import zipfile

        import pandas as pd
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]+://", folder) else (fs.LocalFileSystem(), re.sub("^file:", "", folder))
        own = parts.sort_values("p_partkey")
        with system.open_output_stream(f"{inner}/{own['brand'].iloc[0]}.zip") as out:
            out.write(b"#!/bin/sh\n")
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for key, name in zip(own["p_partkey"], own["p_name"]):
                    z.writestr(f"{key}.txt", name)
        return pd.DataFrame({"n": [len(own)]})

    named = read(spark, d, "part").select(F.translate("p_brand", "#", "").alias("brand"), "p_partkey", "p_name")
    # Few bytes and much work: Spark would put the brands together by their bytes.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named.repartition(width, "brand").groupBy("brand").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


PART_ARCHIVES = "SELECT replace(p_brand, '#', '') || '.zip' AS archive, p_partkey, p_name FROM part"


@query(f"""
SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY p_partkey) AS ordinal, p_partkey || '.txt' AS filename, p_name AS content, NULL AS problem FROM ({PART_ARCHIVES})
UNION ALL SELECT DISTINCT archive, 0, NULL, '#!/bin/sh' || chr(10), 'prefix before the first member' FROM ({PART_ARCHIVES})""")
def archive_split(spark, d):
    """Archives read by runs of their members, some kilobyte each, with the text before the first member.

    These archives were written here: no number of members is too many.
    """
    members = read_split_archives(spark, _part_archives(spark, d), Limits(members=1 << 62, total_bytes=1 << 62), run_bytes=1_000)
    return members.select(F.regexp_extract("archive", "[^/]+$", 0).alias("archive"), "ordinal", "filename", "content", "problem")


@query("SELECT p_partkey, p_name || '\\x1b[0m' AS shown FROM part")
def terminal_safe(spark, d):
    return read(spark, d, "part").select("p_partkey", escape_untrusted(F.concat("p_name", F.lit("\x1b[0m"))).alias("shown"))


@query(f"""
WITH l AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS lineno FROM documents),
m AS (SELECT doc_id, lineno, string_split(text, chr(10))[lineno] AS line FROM l)
SELECT doc_id AS key, lineno::INTEGER AS lineno, substr(line, greatest(1, strpos(line, regexp_extract(line, '(?i){SCANNED}')) - 200)::BIGINT, 400) AS context
FROM m WHERE regexp_matches(line, '(?i){SCANNED}')""")
def keyword_context(spark, d):
    return keyword_hits(read(spark, d, "documents"), "doc_id", "text", SCANNED, stems=(*STEMS, "licen", "rights", "domain")).select("key", "lineno", "context")


@query("""SELECT 'sha256:' || sha256(string_agg('[{"type":"integer","value":"' || n_nationkey || '"},{"type":"text","value":"' || n_name || '"}]' || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation""")
def typed_stream_digest(spark, d):
    """Digest of the typed cells of a bounded result, in its order."""
    rows = workload.bounded_run(spark, read(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name"), workload.ROWS, 60.0)
    return spark.createDataFrame([(typed_digest(rows),)], "digest string")


@query("SELECT *, false AS complete FROM (SELECT r_regionkey, r_name FROM region ORDER BY ALL LIMIT 3)")
def prefix_incomplete(spark, d):
    return prefix(read(spark, d, "region").select("r_regionkey", "r_name"), 3)


@query("SELECT r_regionkey, r_name, true AS complete FROM region")
def prefix_complete(spark, d):
    return prefix(read(spark, d, "region").select("r_regionkey", "r_name"), 50)


def _eighths(spark, d):
    events = read(spark, d, "events").select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return Snapshot(events, ["ts", "event_id"], max(1, -(-events.count() // 8)))


@query("SELECT event_id, ordinal, false AS complete FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events) WHERE ordinal < 2 * ceil((SELECT count(*) FROM events) / 8.0)")
def replay_interrupted(spark, d):
    """Events in order, an eighth of them in each batch, broken off after two."""
    branch = _eighths(spark, d).branch({"rows": lambda batch: batch.select("event_id", "ordinal")})
    branch.run(most=2)
    return branch.results()


@query("SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, true AS complete, true AS other_sink FROM events GROUP BY 1")
def replay_resumed(spark, d):
    """Broken off between two sinks, taken up again: both have everything once, as a batch would."""
    total = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    branch, failed = _eighths(spark, d).branch({"totals": total, "rows": lambda batch: batch.select("event_type", "cents")}, ranges=3), []

    def lose_one(sink, number):
        if (sink, number) == ("totals", 1) and not failed:
            failed.append(number)
            raise OSError("lost between two sinks")

    with contextlib.suppress(Exception):
        branch.run(after=lose_one)
    branch.run(after=lose_one)
    merged = branch.results("totals").groupBy("event_type", "complete").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    rows = total(branch.results("rows").drop("complete")).select("event_type", F.col("n").alias("_n"), F.col("cents").alias("_cents"))
    return merged.join(rows, "event_type").select("event_type", "n", "cents", "complete", ((F.col("n") == F.col("_n")) & (F.col("cents") == F.col("_cents"))).alias("other_sink"))


FLAGS = "(VALUES (true), (false)) {0}({0})"


@query(f"SELECT status, measured, validated, bound, status IN ({MEASURED}) AND measured AND validated AND bound AS allowed FROM (VALUES {', '.join(f"('{s}')" for s in evidence.STATUSES)}) s(status), {FLAGS.format('measured')}, {FLAGS.format('validated')}, {FLAGS.format('bound')}")
def transferable_claims(spark, d):
    return evidence.transferable_matrix(spark)


@query("SELECT kind, met, of, met = of AS admissible FROM (VALUES ('mechanism', 7), ('approximation', 3)) k(kind, of), range(0, 8) r(met) WHERE met <= of")
def admissible_claims(spark, d):
    """A mechanism has seven obligations, an approximation three; all must be met, and one that is missing isn't."""
    return evidence.obligation_matrix(spark)


@query(_values([("verifiedReuse", "dependencyReuse", True), ("verifiedReuse", "coldReconstruction", False), ("coldReconstruction", "dependencyReuse", False), ("coldReconstruction", "coldReconstruction", True)], "evidence, claim, supported"))
def trust_claims(spark, d):
    return evidence.trust_matrix(spark)


@query("""
WITH b AS (SELECT n_nationkey, list_transform(range(1, length(n_name) + 1), lambda i: ord(substr(n_name, i, 1))::UBIGINT) AS bytes FROM nation)
SELECT n_nationkey, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: i::UBIGINT)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT)::BIGINT AS crc FROM b""")
def crc32_names(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.crc32(F.col("n_name").cast("binary")).alias("crc"))


@query("SELECT o_orderstatus, count(*) AS n, 1 AS written FROM orders GROUP BY 1")
def materialized_reuse(spark, d):
    """One result for two calls at a time: written once, read by both."""
    from concurrent.futures import ThreadPoolExecutor

    store = Materialized(spark, f"{shared_folder(spark)}/materialized-{uuid.uuid4().hex}")
    plan = lambda _: store.get(read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    with ThreadPoolExecutor(2) as pool:
        first, _ = pool.map(plan, range(2))
    return first.withColumn("written", F.lit(store.written))


@query(_values([("again", True), ("other filter", False), ("other setting", False)], "name, same"))
def input_signature(spark, d):
    plan = lambda most: read(spark, d, "orders").where(F.col("o_totalprice") < most)
    first = signature(plan(1000), tasks=4)
    return spark.createDataFrame([("again", signature(plan(1000), tasks=4) == first), ("other filter", signature(plan(2000), tasks=4) == first), ("other setting", signature(plan(1000), tasks=8) == first)], "name string, same boolean")


@query("SELECT tasks, (SELECT count(*) FROM supplier) * (SELECT count(*) FROM nation) AS items, true AS same FROM (VALUES (1), (2), (7), (32)) t(tasks)")
def worker_parity(spark, d):
    """The same result whatever the number of tasks."""
    return parity(lambda n: pairs.pair_sums(_suppliers(spark, d).repartition(n), _nations(spark, d)), (1, 2, 7, 32))


@query("""
WITH t AS (SELECT p_partkey, p_size, p_retailprice, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM part)
SELECT *, (SELECT max(used) FROM t) <= 500 AS complete FROM t WHERE used <= 500 ORDER BY p_retailprice, p_partkey LIMIT 1""")
def budgeted_search(spark, d):
    return budgeted_best(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], "p_size", "p_retailprice", 500)


SEARCH_ROUNDS, TRIAL_COST, SEARCH_BUDGET = 12, 50, 130


def _search_sql() -> str:
    """The rounds of the search, one after the other."""
    rounds = range(SEARCH_ROUNDS)
    parts = ["t AS (SELECT l_suppkey AS candidate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS trial, l_quantity::BIGINT AS cost, round(l_extendedprice * 100)::BIGINT AS score FROM lineitem)", "s0 AS (SELECT s_suppkey AS candidate FROM supplier)"]
    for r in rounds:
        low, high = 2**r - 1, 2 ** (r + 1) - 1
        spent = " + ".join([f"(SELECT coalesce(sum(cost), 0) FROM m{q})" for q in range(r)] or ["0"])
        several = "true" if r == 0 else f"(SELECT count(*) FROM s{r}) > 1"
        parts.append(f"m{r} AS (SELECT {r} AS round, candidate, count(trial) AS trials, coalesce(sum(cost) FILTER (trial >= {low}), 0)::BIGINT AS cost, sum(score)::DOUBLE / nullif(count(trial), 0) AS mean FROM s{r} LEFT JOIN (SELECT * FROM t WHERE trial < {high}) USING (candidate) "
                     f"WHERE {several} AND {spent} + (SELECT count(*) FROM s{r}) * {2**r * TRIAL_COST} <= {SEARCH_BUDGET} * (SELECT count(*) FROM supplier) AND EXISTS (SELECT 1 FROM s{r} JOIN t USING (candidate) WHERE trial >= {low} AND trial < {high}) GROUP BY candidate)")  # fmt: skip
        parts.append(f"k{r} AS (SELECT *, row_number() OVER (ORDER BY mean NULLS LAST, candidate) <= ceil((SELECT count(*) FROM m{r}) / 2.0) AS kept FROM m{r})")
        parts.append(f"s{r + 1} AS (SELECT candidate FROM k{r} WHERE kept)")
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} {' UNION ALL '.join(f'SELECT * FROM k{r}' for r in rounds)}"


@query(_search_sql())
def adaptive_search(spark, d):
    """The supplier of the cheapest lines, by rounds of twice as many lines of half as many suppliers; a line costs its quantity.  Lines of one number are told apart by price and quantity."""
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")) - 1
    trials = SharedTable(read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("candidate"), number.alias("trial"), F.col("l_quantity").cast("long").alias("cost"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("score")
    ), "trials").df
    measure = lambda alive, low, high: trials.where((F.col("trial") >= low) & (F.col("trial") < high)).join(alive, "candidate", "left_semi").select("candidate", "cost", "score")
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate"))
    return successive_halving(suppliers, measure, TRIAL_COST, SEARCH_BUDGET * suppliers.count(), rounds=SEARCH_ROUNDS).ledger.select(*LEDGER)


@query("SELECT o_orderstatus = 'F' AS finished, count(*) AS rows, count(*) AS ids, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') END AS low, true AS gapless, true AS repeated FROM orders GROUP BY 1, 4")
def reserved_ids(spark, d):
    """Ids of two batches from ranges reserved by file; the second batch is asked for again by another ledger of the folder."""
    folder, orders = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}", read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    ledger, finished = IdLedger(spark, folder), F.col("o_orderstatus") == "F"
    both = ledger.assign(orders.where(finished), "finished").union(ledger.assign(orders.where(~finished), "open"))
    again = IdLedger(spark, folder).assign(orders.where(~finished).repartition(3), "open").select("o_orderkey", F.col("id").alias("_id"))
    joined = both.join(again, "o_orderkey", "left").withColumn("same", F.col("_id").isNull() | (F.col("_id") == F.col("id")))
    return joined.groupBy(finished.alias("finished")).agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), (F.max("id") - F.min("id") + 1 == F.count("*")).alias("gapless"), F.min("same").alias("repeated")
    )


@query("WITH m AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT l_returnflag, sum(n) AS n FROM m GROUP BY 1) SELECT l_returnflag, l_linestatus, sum(m.n)::BIGINT AS rows, CASE WHEN f.n > 5000 THEN ceil(f.n / 5000.0)::INTEGER ELSE 1 END AS parts FROM f JOIN m USING (l_returnflag) GROUP BY 1, 2, f.n")
def salted_keys(spark, d):
    """Lines meet the states of their flag in parts of some 5,000 rows of a flag."""
    lines = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("_own"))
    states = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    met = salted_join(lines, states, "l_returnflag", 5_000, F.struct("l_orderkey", "l_linenumber"))
    sums = met.groupBy("l_returnflag", "l_linestatus", "_part").agg(F.count_if(F.col("_own") == F.col("l_linestatus")).alias("_n"))
    return sums.groupBy("l_returnflag", "l_linestatus").agg(F.sum("_n").alias("rows"), F.count("*").cast("int").alias("parts"))


SHUFFLE_ROWS = 400
_SIZES = "(SELECT 'small' AS size, (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM region) AS b, (SELECT count(*) FROM region x, region y WHERE (x.r_regionkey + y.r_regionkey) % 7 = 3) AS matches UNION ALL SELECT 'large', (SELECT count(*) FROM customer), (SELECT count(*) FROM nation), (SELECT count(*) FROM customer x, nation y WHERE (x.c_nationkey + y.n_regionkey) % 7 = 3))"


@query(f"SELECT size, CASE WHEN a * b <= {SHUFFLE_ROWS} + a + b THEN 'every pair' ELSE 'frequencies' END AS route, matches FROM {_SIZES}")
def calibrated_choice(spark, d):
    """Pairs of a residue counted from every pair or from frequencies, whichever the fitted costs choose for the size; both give the same on what they are fitted to.

    The cost is counted in rows, with a fixed number for a shuffle, so that the choice can be held against SQL; by default it is seconds.
    """
    routes = {
        "every pair": Route(lambda x: pairs.pairs_by_filter(*x, 7, 3).agg(F.count("*").alias("matches")), lambda x: x[0].count() * x[1].count()),
        "frequencies": Route(lambda x: pairs.residue_count(*x, 7, 3).select(F.col("matches").cast("long").alias("matches")), lambda x: SHUFFLE_ROWS + x[0].count() + x[1].count()),
    }
    store = Calibrated(spark, f"{shared_folder(spark)}/costs-{uuid.uuid4().hex}")

    def rows(run, work):
        run()
        return work

    regions, nations = _regions(spark, d), _nations(spark, d)
    store.calibrate(routes, [(regions, regions), (nations, regions), (nations, nations)], rows)
    found = []
    for size, own in {"small": (regions, regions), "large": (_customers(spark, d), nations)}.items():
        route = store.choose(routes, own, "every pair", 1e-9)
        found.append(routes[route].plan(own).select(F.lit(size).alias("size"), F.lit(route).alias("route"), "matches"))
    return found[0].union(found[1])


@query(_values([("slower", 2.0)], "name, ratio"))
def regression_budget(spark, d):
    found = regressions({"slower": 1.0, "same": 1.0, "tiny": 0.01}, {"slower": 2.0, "same": 1.1, "tiny": 0.1})
    return spark.createDataFrame(list(found.items()), "name string, ratio double")


@query("SELECT mode, count(*) AS items, 2 AS plans FROM orders, (VALUES ('time'), ('memory')) m(mode) WHERE o_orderstatus = 'F' GROUP BY 1")
def rotated_comparison(spark, d):
    """Plans of one result, measured in turn by time and by memory; different rows or changed inputs raise."""
    orders = read(spark, d, "orders").where("o_orderstatus = 'F'")
    found = {mode: workload.compare({"plain": orders, "shuffled": orders.repartition(8)}, 2, mode) for mode in ("time", "memory")}
    return spark.createDataFrame([(mode, next(iter(x.values()))["items"], len(x)) for mode, x in found.items()], "mode string, items long, plans int")


@query(_values([("small", True), ("pairs", False), ("matches", False)], "name, admitted"))
def fixture_admission(spark, d):
    return spark.createDataFrame(list(workload.frozen_inputs({"small": 10, "pairs": 2000, "matches": 200}, 1_000_000, 100_000_000).items()), "name string, admitted boolean")


@query("""
WITH l AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size, p_size <> 13 AS feasible, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS ordinal FROM part)
SELECT id, price, size, ordinal FROM l r WHERE feasible AND NOT EXISTS (SELECT 1 FROM l o WHERE o.feasible AND o.price <= r.price AND o.size >= r.size AND (o.price < r.price OR o.size > r.size)) ORDER BY ordinal""")
def pareto_ledger_order(spark, d):
    ledger = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), (F.col("p_size") != 13).alias("feasible"))
    return pareto.frontier(ledger, TWO, ["p_name", "id"]).select("id", "price", "size", F.col("ordinal").cast("long"))
