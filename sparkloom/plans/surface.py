"""SQL constructs that workloads may use, one query each: Spark's text, and DuckDB's where it differs."""

from __future__ import annotations

#: Beyond what workloads may use: these run as plain Spark SQL, the others through admission.
EXTENSIONS = frozenset("sql_max_by sql_median sql_functions sql_sha256 sql_lateral sql_grouping_sets".split())

SURFACE: dict[str, tuple[str, str | None]] = {
    "sql_comparisons": ("SELECT p_partkey FROM {part} WHERE p_size >= 10 AND p_size <= 40 AND p_size <> 13 AND NOT (p_retailprice < 950 OR p_brand = 'Brand#1')", None),
    "sql_between_in": ("SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 5 AND 15 AND p_size NOT IN (7, 9)", None),
    "sql_null_tests": ("SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_orderstatus IS NOT NULL", None),
    "sql_is_distinct": ("SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE o_orderstatus IS DISTINCT FROM 'O'", None),
    "sql_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM {part}", None),
    "sql_row_values": ("SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM {lineitem} GROUP BY l_orderkey)", None),
    "sql_concat_cast": ("SELECT p_partkey, p_brand || ':' || CAST(p_size AS STRING) AS tag FROM {part}", "SELECT p_partkey, p_brand || ':' || CAST(p_size AS VARCHAR) AS tag FROM part"),
    "sql_bitwise": ("SELECT p_partkey, p_size & 12 AS low, p_size | 3 AS high, p_size << 2 AS four, ~p_size AS inverse FROM {part}", "SELECT p_partkey, p_size & 12 AS low, p_size | 3 AS high, (p_size * 4)::INTEGER AS four, ~p_size AS inverse FROM part"),
    "sql_nocase": ("SELECT n_nationkey FROM {nation} WHERE lower(n_name) > 'f'", None),
    "sql_collate": ("SELECT n_nationkey FROM {nation} WHERE n_name COLLATE UTF8_LCASE = 'nation_11' OR n_name COLLATE UTF8_LCASE > 'nation_5'", "SELECT n_nationkey FROM nation WHERE n_name COLLATE NOCASE = 'nation_11' OR n_name COLLATE NOCASE > 'nation_5'"),
    "sql_inner_join": ("SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey", None),
    "sql_left_join": ("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F'", None),
    "sql_right_join": ("SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 0", None),
    "sql_full_join": ("SELECT coalesce(s_suppkey, -1) AS s_suppkey, coalesce(c_custkey, -1) AS c_custkey FROM {supplier} FULL OUTER JOIN {customer} ON s_suppkey = c_custkey", None),
    "sql_cross_join": ("SELECT n_name, r_name FROM {nation} CROSS JOIN {region}", None),
    "sql_theta_join": ("SELECT s.s_suppkey, n.n_nationkey FROM {supplier} s JOIN {nation} n ON s.s_nationkey > n.n_nationkey", None),
    "sql_using": ("SELECT doc_id, lang, quality FROM {documents} JOIN {labels} USING (doc_id)", None),
    "sql_natural": ("SELECT doc_id, source, toxic FROM {documents} NATURAL JOIN {labels}", None),
    "sql_in_subquery": ("SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000)", None),
    "sql_not_in": ("SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')", None),
    "sql_exists": ("SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", None),
    "sql_not_exists": ("SELECT s_suppkey FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_discount > 0.09)", None),
    "sql_scalar_subquery": ("SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n_orders FROM {customer}", None),
    "sql_derived_table": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) t WHERE n > 5", None),
    "sql_cte": ("WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 50000), n AS (SELECT o_custkey, count(*) AS k FROM big GROUP BY o_custkey) SELECT c_name, k FROM n JOIN {customer} ON c_custkey = o_custkey", None),
    "sql_group_having": ("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None),
    "sql_agg_distinct": ("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM {orders} GROUP BY o_orderpriority", None),
    "sql_agg_exact": ("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM {lineitem} GROUP BY l_returnflag", None),
    "sql_avg": ("SELECT p_brand, avg(p_size) AS mean_size FROM {part} GROUP BY p_brand", None),
    "sql_max_by": ("SELECT o_custkey, max(o_orderkey) AS latest, max_by(o_orderstatus, o_orderkey) AS status FROM {orders} GROUP BY o_custkey", None),
    "sql_median": ("SELECT event_type, median(value) AS middle FROM {events} GROUP BY event_type", None),
    "sql_window_running": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seen, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM {events}", None),
    "sql_window_range": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {part}", None),
    "sql_window_exclude": ("SELECT event_id, coalesce(count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) + coalesce(count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS others FROM {events}", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS others FROM events"),
    "sql_order_nulls": ("SELECT * FROM (SELECT c_custkey, max(o_totalprice) AS top FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) t ORDER BY top ASC NULLS FIRST, c_custkey LIMIT 20 OFFSET 5", None),
    "sql_union": ("SELECT s_nationkey AS k FROM {supplier} UNION SELECT c_nationkey FROM {customer}", None),
    "sql_union_all": ("SELECT 's' AS kind, s_nationkey AS k FROM {supplier} UNION ALL SELECT 'c', c_nationkey FROM {customer}", None),
    "sql_intersect": ("SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'", None),
    "sql_except": ("SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'", None),
    "sql_intersect_all": ("SELECT s_nationkey FROM {supplier} INTERSECT ALL SELECT c_nationkey FROM {customer}", None),
    "sql_except_all": ("SELECT c_nationkey FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}", None),
    "sql_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}", None),
    "sql_functions": ("SELECT p_partkey, abs(p_size - 25) AS off, coalesce(nullif(p_size, 1), 0) AS size, length(p_name) AS n, lower(p_brand) AS low, upper(p_type) AS up, substr(p_name, 2, 3) AS part, trim(p_brand) AS trimmed, ifnull(p_size, 0) AS filled, round(p_retailprice, 0) AS price FROM {part}", None),
    "sql_sha256": ("SELECT c_custkey, sha2(c_name, 256) AS digest FROM {customer}", "SELECT c_custkey, sha256(c_name) AS digest FROM customer"),
    "sql_lateral": ("SELECT n_nationkey, t.k FROM {nation}, LATERAL (SELECT count(*) AS k FROM {supplier} WHERE s_nationkey = n_nationkey) t", None),
    "sql_integer_division": ("SELECT p_partkey, p_partkey DIV 7 AS q, p_partkey % 7 AS r FROM {part}", "SELECT p_partkey, p_partkey // 7 AS q, p_partkey % 7 AS r FROM part"),
    "sql_grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", None),
    "session_latest": ("SELECT conv_id, turn, role FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM {conversations}) t WHERE turn > last - 8", None),
    "session_count": ("SELECT conv_id, count(*) AS n FROM {conversations} GROUP BY conv_id", None),
    "recent_sessions": ("SELECT conv_id, max(turn) AS latest FROM {conversations} GROUP BY conv_id ORDER BY latest DESC, conv_id LIMIT 20", None),
    "message_classification": ("SELECT conv_id, role, count(*) AS n FROM {conversations} GROUP BY conv_id, role", None),
}
