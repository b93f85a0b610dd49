"""Admission-controlled read-only SQL workloads: strict reading, allowed constructs, bounded runs, digests and medians.

Spark's own parser decides what a statement is; admission walks its tree before
anything is analysed or run, and refuses whatever it doesn't know.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import statistics
import threading
import time
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..contracts import ContractError, require
from ..functions import sqlite
from ..functions.digest import multiset_digest, typed_digest
from ..sources.paths import file_stats

WORKLOAD, OBSERVATION = "sparkloom.workload.v1", "sparkloom.observation.v1"
#: Limits: bytes of a workload, queries, bytes of a statement, parameters, rows of a result, runs, seconds.
BYTES, QUERIES, SQL_BYTES, PARAMS, ROWS, SAMPLES, SECONDS = 32_768, 16, 2_048, 16, 512, 5, 60.0

# Functions that statements may call.
FUNCTIONS = frozenset("abs avg coalesce count hex ifnull length lower max min round substr sum trim typeof upper".split())
#: Functions whose SQLite meaning differs from Spark's: what stands for them.  round always gives a double.
MEANING = {
    "hex": "x STRING) RETURNS STRING RETURN coalesce(hex(x), '')",
    "lower": f"x STRING) RETURNS STRING RETURN translate(x, '{sqlite._UPPER}', '{sqlite._LOWER}')",
    "upper": f"x STRING) RETURNS STRING RETURN translate(x, '{sqlite._LOWER}', '{sqlite._UPPER}')",
    "round": f"x DOUBLE, n INT DEFAULT 0) RETURNS DOUBLE RETURN CASE greatest(n, 0) {' '.join(f'WHEN {n} THEN round(x, {n})' for n in range(16))} ELSE x END",
    # A negative length takes what stands before the place; places before the text use up length.
    "substr": """x STRING, a BIGINT, n BIGINT DEFAULT 2147483647) RETURNS STRING RETURN CASE WHEN x IS NOT NULL AND a IS NOT NULL AND n IS NOT NULL THEN element_at(transform(array(named_struct(
      'p', CASE WHEN a < 0 THEN greatest(a + length(x), 0) WHEN a > 0 THEN a - 1 ELSE 0 END,
      'm', CASE WHEN a < 0 AND a + length(x) < 0 THEN greatest(abs(n) + a + length(x), 0) WHEN a = 0 AND n <> 0 THEN abs(n) - 1 ELSE abs(n) END)),
      v -> substring(x, cast(least(if(n < 0, greatest(v.p - v.m, 0), v.p) + 1, 2147483647) AS INT), cast(least(if(n < 0, least(v.m, v.p), v.m), 2147483647) AS INT))), 1) END""",
    "trim": "x STRING, chars STRING DEFAULT ' ') RETURNS STRING RETURN btrim(x, chars)",
}
PREFIX = "sqlite_"
_WHOLE, _REAL = "'tinyint', 'smallint', 'int', 'bigint', 'boolean'", "'float', 'double'"
#: Calls that are put into others: what stands in the name's place, and what follows the arguments.
WRAPPED = {
    "max": ("element_at(transform(array(array", "), v -> if(exists(v, e -> e IS NULL), NULL, array_max(v))), 1)"),
    "min": ("element_at(transform(array(array", "), v -> if(exists(v, e -> e IS NULL), NULL, array_min(v))), 1)"),
    "typeof": ("element_at(transform(array(array", f"), v -> CASE WHEN v[0] IS NULL THEN 'null' WHEN typeof(v[0]) IN ({_WHOLE}) THEN 'integer' WHEN typeof(v[0]) IN ({_REAL}) OR substring(typeof(v[0]), 1, 7) = 'decimal' THEN 'real' WHEN typeof(v[0]) = 'binary' THEN 'blob' ELSE 'text' END), 1)"),
}
#: Nodes of a plan that a report has, at most.
PLAN_NODES = 128
#: Operators that the parser writes as functions.
OPERATORS = frozenset(["between"])
#: Parser nodes and expressions that statements may contain.
NODES = frozenset("Project Filter Join Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedRelation OneRowRelation WithWindowDefinition UnresolvedInlineTable".split())
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedAlias Alias Literal UnresolvedFunction PosParameter EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or Not In InSubquery ListQuery Exists ScalarSubquery IsNull IsNotNull CaseWhen If Cast Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat BitwiseAnd BitwiseOr BitwiseNot ShiftLeft ShiftRight SortOrder UnresolvedOrdinal CreateStruct CreateNamedStruct Between UnresolvedBetween UnresolvedWindowExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ StringTrim StringTrimLeft StringTrimRight Collate UnresolvedCollation NamePlaceholder$".split()
)
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,63}\Z")


# --- the form of a workload: a dict has exactly its keys, a list one item form and its least and most items, a test says what it asks for


def _statement(text: str) -> bool:
    return bool(re.match(r"\s*(?:select|with)\b", text, re.IGNORECASE)) and not any(x in text for x in (";", "--", "/*"))


def _parameter(x) -> bool:
    if isinstance(x, str):
        return len(x.encode()) <= 1024
    if isinstance(x, int) and not isinstance(x, bool):
        return -(2**63) <= x < 2**63
    return x is None or (isinstance(x, float) and math.isfinite(x))


FORM = {
    "schema": [("is the workload's schema", lambda x: x == WORKLOAD)],
    "queries": (
        1, QUERIES,
        {
            "name": [("is a plain name", lambda x: isinstance(x, str) and bool(_NAME.match(x)))],
            "sql": [("is a short text", lambda x: isinstance(x, str) and 0 < len(x.encode()) <= SQL_BYTES), ("is one statement that selects, without comments", _statement)],
            "params": (0, PARAMS, [("is null, a 64-bit whole number, a finite number or a short text", _parameter)]),
        },
    ),
}


def conforms(value, form, at: str) -> None:
    """Raises where ``value`` doesn't have the form."""
    if isinstance(form, dict):
        require(isinstance(value, dict) and value.keys() == form.keys(), f"{at} has the fields {', '.join(form)}")
        for key, inner in form.items():
            conforms(value[key], inner, f"{at}.{key}")
    elif isinstance(form, tuple):
        least, most, inner = form
        require(isinstance(value, list) and least <= len(value) <= most, f"{at} has {least} to {most} items")
        for item in value:
            conforms(item, inner, at)
    else:
        for what, holds in form:
            require(holds(value), f"{at} {what}")


class _Fields(dict):
    """A JSON object's fields, which must not come twice."""

    def __init__(self, pairs):
        super().__init__(pairs)
        require(len(self) == len(pairs), "a field comes twice")


def read_workload(raw: bytes) -> list[dict]:
    """Queries of a workload in JSON; what doesn't have its FORM, or is beyond the limits, is refused."""
    require(len(raw) <= BYTES, "the workload is too long")
    try:
        data = json.loads(raw.decode("utf-8"), object_pairs_hook=_Fields, parse_constant=lambda x: require(False, f"{x} is no number"))
    except ValueError as error:
        raise ContractError(f"not a workload: {error}") from error
    conforms(data, FORM, "workload")
    require(len({q["name"] for q in data["queries"]}) == len(data["queries"]), "names are different")
    return data["queries"]


def admit(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]):
    """The parsed tree of a statement; anything in it that isn't known to be allowed is refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # noqa: BLE001  py4j wraps the parser's errors
        raise ContractError("the statement can't be parsed") from error
    names = {t.lower() for t in tables}

    def seq(items):
        return [items.apply(i) for i in range(items.size())]

    def visit(node, ctes: frozenset[str]):
        kind = node.getClass().getSimpleName()
        require(kind in NODES, f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            require(not node.allowRecursion(), "recursion is not allowed")
            relations = seq(node.cteRelations())
            for r in relations:
                ctes = ctes | {r._1().lower()}
            for r in relations:
                visit(r._2(), ctes)
        if kind == "UnresolvedRelation":
            parts = seq(node.multipartIdentifier())
            require(len(parts) == 1 and parts[0].lower() in names | ctes, "only registered tables may be read")
        for e in seq(node.expressions()):
            look(e, ctes)
        for child in seq(node.children()):
            visit(child, ctes)

    def look(e, ctes):
        kind = e.getClass().getSimpleName()
        require(kind in EXPRESSIONS, f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            parts = seq(e.nameParts())
            require(len(parts) == 1 and parts[0].lower() in FUNCTIONS | OPERATORS, f"function {parts[-1]} is not allowed")
        if kind in ("ScalarSubquery", "Exists", "ListQuery"):
            visit(e.plan(), ctes)
        if kind == "InSubquery":
            look(e.query(), ctes)
        for child in seq(e.children()):
            look(child, ctes)

    visit(plan, frozenset())
    return plan


def _nodes(plan) -> list:
    """All nodes and expressions of a plan, those of subqueries too."""
    found = []

    def walk(node):
        kinds = _kinds(node)
        found.append(node)
        for group in (node.expressions() if "LogicalPlan" in kinds else None, node.children()):
            for i in range(group.size() if group is not None else 0):
                walk(group.apply(i))
        if "SubqueryExpression" in kinds or "PlanExpression" in kinds:
            walk(node.plan())
        kind = node.getClass().getSimpleName()
        if kind == "InSubquery":
            walk(node.query())
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                walk(relations.apply(i)._2())

    walk(plan)
    return found


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _span(node) -> tuple[int, int]:
    """First and last place of a node's text."""
    return node.origin().startIndex().get(), node.origin().stopIndex().get()


def _calls(plan) -> list:
    return [n for n in _nodes(plan) if _kind(n) == "UnresolvedFunction"]


def _kinds(node) -> set[str]:
    out, kind = set(), node.getClass()
    while kind is not None:
        out.add(kind.getSimpleName())
        kind = kind.getSuperclass()
    return out


def define_meaning(spark: SparkSession) -> None:
    """Defines the functions of MEANING in the session, under names of their own."""
    for name, body in MEANING.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({body}")


def _items(group) -> list:
    return [group.apply(i) for i in range(group.size())]


def _called(call) -> tuple[str, int]:
    return call.nameParts().apply(0).lower(), call.arguments().size()


def _bare_columns(plan, sql: str) -> list[tuple[int, int, str]]:
    """Edits that give columns beside a single max or min, which are neither grouped nor aggregated, the value of its row."""
    edits = []
    for node in _nodes(plan):
        if _kind(node) not in ("Aggregate", "Project"):
            continue
        outputs = _items(node.aggregateExpressions() if _kind(node) == "Aggregate" else node.projectList())
        grouped = {sql[slice(*_span(g))] + sql[_span(g)[1]] for g in _items(node.groupingExpressions())} if _kind(node) == "Aggregate" else set()
        inner = [n for e in outputs for n in _nodes(e)]
        if any(_kind(n) == "UnresolvedWindowExpression" or _kind(n) == "WindowExpression" for n in inner):
            continue
        extreme = [c for c in inner if _kind(c) == "UnresolvedFunction" and _called(c)[0] in ("max", "min") and _called(c)[1] == 1]
        if len(extreme) != 1:
            continue
        name, (start, stop) = _called(extreme[0])[0], _span(extreme[0].arguments().apply(0))
        for e in outputs:
            named = _kind(e) == "Alias"
            column = e.child() if named or _kind(e) == "UnresolvedAlias" else e
            if _kind(column) != "UnresolvedAttribute":
                continue
            at, end = _span(column)
            text = sql[at : end + 1]
            if text not in grouped and not {p.lower() for p in _items(column.nameParts())} & {g.split(".")[-1].lower() for g in grouped}:
                edits.append((at, end + 1, f"{name}_by({text}, {sql[start : stop + 1]})" + ("" if named else f" AS {text.split('.')[-1]}")))
    return edits


def with_meaning(sql: str, plan) -> str:
    """The admitted statement with SQLite's functions in place of Spark's; the parser tells where calls and columns stand."""
    edits = _bare_columns(plan, sql)
    for call in _calls(plan):
        (name, n), (start, stop) = _called(call), _span(call)
        if name not in FUNCTIONS:
            continue
        require(sql[start : start + len(name)].lower() == name, "a function's name is plain")
        if name in MEANING:
            edits.append((start, start, PREFIX))
        elif name == "typeof" or (name in ("max", "min") and n > 1):
            require(name != "typeof" or n == 1, "typeof has one argument")
            before, after = WRAPPED[name]
            edits += [(start, start + len(name), before), (stop + 1, stop + 1, after)]
    return _edited(sql, edits)


def _edited(sql: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with parts replaced; of two edits at one place the one that ends first is written first."""
    for start, end, text in sorted(dict.fromkeys(edits), key=lambda x: (x[0], x[1]), reverse=True):
        sql = sql[:start] + text + sql[end:]
    return sql


DIVIDING = ("Divide", "Remainder", "IntegralDivide")


def _whole_divisions(analysed) -> set[tuple[int, int]]:
    """Where whole numbers are divided by ``/``; the analysis has turned them into doubles."""
    found = set()
    for node in _nodes(analysed):
        if _kind(node) == "Divide" and node.origin().startIndex().isDefined():
            sides = [x.child() if _kind(x) == "Cast" else x for x in (node.left(), node.right())]
            if all(x.dataType().typeName() in ("byte", "short", "integer", "long") for x in sides):
                found.add(_span(node))
    return found


def with_division(spark: SparkSession, sql: str, args: list | None) -> str:
    """Dividing by zero gives null, and ``/`` of whole numbers becomes ``div``, inner divisions first, for outer ones may become whole by them."""
    tree = lambda text: spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    # Divisors may end at one place, as in a / (b / c); subqueries may be met twice.
    divisors = sorted({_span(n.right()) for n in _nodes(tree(sql)) if _kind(n) in DIVIDING})
    edits = [(start, start, "nullif(") for start, _ in divisors]
    edits += [(end + 1, end + 1, ", 0)" * sum(e == end for _, e in divisors)) for end in {e for _, e in divisors}]
    sql = _edited(sql, edits)
    while edits:
        whole, edits = _whole_divisions(spark.sql(sql, args=args)._jdf.queryExecution().analyzed()), []
        for node in _nodes(tree(sql)):
            if _kind(node) == "Divide" and _span(node) in whole:
                at = sql.index("/", _span(node.left())[1] + 1)
                edits.append((at, at + 1, " div "))
        sql = _edited(sql, edits)
    return sql


def _no_rewriting(plan, sql: str) -> None:
    """Refuses what has another meaning in Spark, where only other constructs in its place would mend it."""
    require(not _bare_columns(plan, sql), "columns beside an extreme are not grouped")
    for name, n in map(_called, _calls(plan)):
        require(name not in WRAPPED or (name != "typeof" and n == 1), f"{name} of {n} values has another meaning")


def prepare(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], params: list | None = None, as_written: bool = False) -> DataFrame:
    """The DataFrame of an admitted statement with SQLite's meaning; the tables are views of the session, define_meaning() has run.

    With ``as_written`` only statements are admitted whose operators Spark reads
    as SQLite does: ``/`` of whole numbers, max and min of several values,
    typeof and bare columns are refused instead of rewritten.  Overflow raises.
    """
    plan, args = admit(spark, sql, tables), params or None
    if as_written:
        _no_rewriting(plan, sql)
    sql = with_meaning(sql, plan)
    if as_written:
        require(not _whole_divisions(spark.sql(sql, args=args)._jdf.queryExecution().analyzed()), "whole numbers divide by div")
    return spark.sql(with_division(spark, sql, args), args=args)


def bounded_run(spark: SparkSession, df: DataFrame, most: int, seconds: float) -> list[tuple]:
    """Rows of a result of at most ``most`` rows; more rows raise, and so does running out of time."""
    group = f"workload-{time.monotonic_ns()}"
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    spark.sparkContext.setJobGroup(group, "bounded run", interruptOnCancel=True)
    timer.start()
    began = time.monotonic()
    try:
        rows = df.limit(most + 1).collect()
    except Exception as error:  # noqa: BLE001
        if time.monotonic() - began >= seconds:
            raise ContractError("the time limit was reached") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    require(len(rows) <= most, "the result has too many rows")
    return [tuple(r) for r in rows]


def inventory(tables: Mapping[str, DataFrame]) -> dict:
    """Columns of each table and a digest of all schemas."""
    found = {name: [list(c) for c in df.dtypes] for name, df in sorted(tables.items())}
    return {"tables": found, "schema_sha256": hashlib.sha256(json.dumps(found, sort_keys=True).encode()).hexdigest()}


def fingerprint(tables: Mapping[str, DataFrame]) -> str:
    """Digest of the files behind the tables with their lengths and times; it changes when data are added or replaced."""
    return hashlib.sha256(json.dumps({n: file_stats(df) for n, df in sorted(tables.items())}).encode()).hexdigest()


def session_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session of its own that has the tables, whatever they are made of, as views and the functions of MEANING."""
    own = spark.newSession()
    for name, df in tables.items():
        # Sessions share global views; the own view keeps the plan, so the shared one can go.
        private = f"workload_{uuid.uuid4().hex}"
        df.createGlobalTempView(private)
        own.table(f"global_temp.{private}").createOrReplaceTempView(name)
        spark.catalog.dropGlobalTempView(private)
    define_meaning(own)
    return own


def run_admitted(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], params: list | None = None) -> DataFrame:
    """The DataFrame of one statement, after admission."""
    return prepare(session_of(spark, tables), sql, tables, params)


def observe(spark: SparkSession, raw: bytes, tables: Mapping[str, DataFrame], samples: int = 0, rows: int = ROWS, seconds: float = 3.0) -> dict:
    """The report of a workload: plans, and with ``samples`` digests, counts and median times; no data and no SQL text."""
    require(0 <= samples <= SAMPLES and 1 <= rows <= ROWS and 0 < seconds <= SECONDS, "limits are out of bounds")
    queries, before, reports = read_workload(raw), fingerprint(tables), []
    own = session_of(spark, tables)
    for q in queries:
        df = prepare(own, q["sql"], tables, q["params"])
        nodes = [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if line.strip()]
        require(len(nodes) <= PLAN_NODES, "the plan is too large for a report")
        scans = [line for line in nodes if "FileScan" in line]
        full = sum("PushedFilters: []" in s and "PartitionFilters: []" in s for s in scans)
        report = {"name": q["name"], "columns": [list(c) for c in df.dtypes], "nodes": len(nodes), "scans": len(scans), "full_scans": full, "complete": samples > 0}
        report |= {"advice": "a table is read whole: a filter on its columns would be pushed down"} if full else {}
        if samples:
            times, digests, counts = [], set(), set()
            for _ in range(samples):
                began = time.perf_counter_ns()
                found = bounded_run(own, df, rows, seconds)
                times.append((time.perf_counter_ns() - began) // 1000)
                # Without a total order Spark may give equal rows in any order: digests are of sorted rows.
                digests.add(typed_digest(sorted(found, key=repr)))
                counts.add(len(found))
            require(len(digests) == 1, "runs gave different rows")
            report |= {"rows": counts.pop(), "digest": digests.pop(), "median_us": statistics.median(times)}
        reports.append(report)
    require(fingerprint(tables) == before, "the tables changed meanwhile")
    return {"schema": OBSERVATION, "workload_sha256": hashlib.sha256(raw).hexdigest(), "inventory": inventory(tables), "data": before, "queries": reports}


def save_report(report: dict, path: str) -> str:
    """Writes canonical JSON to a new file and returns its digest; an existing file is never replaced."""
    import os

    raw = json.dumps(report, sort_keys=True, separators=(",", ":"), allow_nan=False).encode("ascii")
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as out:
        out.write(raw)
        out.flush()
        os.fsync(out.fileno())
    return f"sha256:{hashlib.sha256(raw).hexdigest()}"


def peak_memory(spark: SparkSession, run) -> int:
    """The most execution memory that the tasks of a stage held together while ``run()`` ran, in bytes."""
    group, sc = f"peak-{time.monotonic_ns()}", spark.sparkContext
    sc.setJobGroup(group, "peak memory")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            try:
                most = max(most, store.lastStageAttempt(stage).peakExecutionMemory())
            except Py4JJavaError:  # a stage that was skipped, its output being there
                continue
    return most


def compare(plans: Mapping[str, DataFrame], repeats: int = 3, mode: str = "time") -> dict[str, dict]:
    """Median seconds (or, by ``mode``, bytes of peak memory) of several plans of the same result, run in rotation.

    Different results raise, and so do input files that change meanwhile.
    """
    require(mode in ("time", "memory"), "a comparison is of time or of memory")
    names, taken, digests, rows = list(plans), {n: [] for n in plans}, set(), []
    before = {n: file_stats(df) for n, df in plans.items()}
    for r in range(repeats):
        for k in range(len(names)):
            name = names[(k + r) % len(names)]
            digest = multiset_digest(plans[name].select(*sorted(plans[name].columns)))
            began = time.perf_counter()
            if mode == "memory":
                taken[name].append(peak_memory(digest.sparkSession, lambda digest=digest: rows.append(digest.first())))
            else:
                rows.append(digest.first())
                taken[name].append(time.perf_counter() - began)
            digests.add((rows[-1]["items"], rows[-1]["digest"]))
            require(len(digests) == 1, f"{name} gives other rows")
    require({n: file_stats(df) for n, df in plans.items()} == before, "input files changed meanwhile")
    return {n: {"median_s" if mode == "time" else "median_bytes": statistics.median(t), "items": next(iter(digests))[0]} for n, t in taken.items()}


def frozen_inputs(sizes: Mapping[str, int], most_pairs: int, most_matches: int) -> dict[str, bool]:
    """By name of a case of four arrays of equal size: whether its pairs (size squared) and matches (at most size to the fourth) are within bounds.

    Checked before anything is built.
    """
    return {name: 0 <= n and n**2 <= most_pairs and n**4 <= most_matches for name, n in sizes.items()}
