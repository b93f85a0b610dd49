"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks.  A period has as many slots as
the weights (whole numbers) add up to; block k of a source of weight w gets
release time floor((k - 1) * period / w) and deadline ceil(k * period / w),
and earliest-deadline-first fills the slots.  At every slot each source is
less than one block from its share.  A source of n blocks fills n div w
periods; what it has left is spread over one period more, and then it leaves
and the others' shares grow in proportion.  So the weights of each period are
known beforehand: runs of periods with equal weights (phases) are scheduled by
themselves, each by one task, and make up a table of slots, whatever the number
of sources.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable

#: Documents of a block; slots of a period that default weights add up to, about.
BLOCK, PERIOD = 16, 1024
#: Slots of a schedule that may be broadcast (8 bytes or so each); a larger one is joined by block.
BROADCAST = 1 << 20
#: Documents that are ranked together, and cells whose counts are added up together.
CELL, SPAN = 512, 1024


def pfair_slots(weights: list[int]) -> list[list[int]]:
    """Slots of each source in a period, by earliest deadline first among the blocks released."""
    period = sum(weights)
    jobs = sorted((k * period // w, -((k + 1) * period // -w), i) for i, w in enumerate(weights) for k in range(w))
    slots: list[list[int]] = [[] for _ in weights]
    ready: list[tuple[int, int]] = []
    at = 0
    for t in range(period):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        slots[heapq.heappop(ready)[1]].append(t)
    return slots


def schedule_table(sources: DataFrame) -> DataFrame:
    """(key, first, until, base, period, slots): the runs of equal periods of every source.

    ``sources`` has one row a source: key, blocks (one at least) and weight.
    Block ``first + j`` of a run gets slot ``base + (j div n) * period +
    slots[j mod n]`` where n is the number of the run's slots in a period.
    There are at most as many slots in the table as there are blocks.
    """
    own = sources.withColumns({"full": F.expr("blocks div weight"), "rest": F.col("blocks") % F.col("weight")})
    ends = own.select(F.explode(F.expr("if(rest > 0, array(0L, full, full + 1), array(0L, full))")).alias("start")).distinct()
    # One row for each time when a source leaves.
    order = Window.orderBy("start")
    starts = ends.select("start", (F.row_number().over(order) - 1).alias("phase"), (F.lead("start").over(order) - F.col("start")).alias("times"))
    last = F.expr("if(rest > 0, phase, phase - 1)")
    active = own.join(starts.select(F.col("start").alias("full"), "phase"), "full").withColumn("last", last).withColumn("phase", F.explode(F.sequence(F.lit(0), F.col("last"))))
    runs = active.join(starts, "phase").withColumn("n", F.when(F.col("start") < F.col("full"), F.col("weight")).otherwise(F.col("rest")))
    lengths = runs.groupBy("phase").agg(F.sum("n").alias("period"), F.first("times").alias("times"))
    before = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("phase", "period", F.coalesce(F.sum(F.col("period") * F.col("times")).over(before), F.lit(0)).alias("base"))

    def fill(rows):
        rows = rows.sort_values("key")
        return rows.assign(slots=pfair_slots(rows["n"].tolist()))[["phase", "key", "slots"]]

    filled = runs.select("phase", "key", "n").groupBy("phase").applyInPandas(fill, "phase int, key string, slots array<int>")
    placed = filled.join(runs.select("phase", "key", "start", "times", "weight"), ["phase", "key"]).join(lengths, "phase")
    first = F.col("start") * F.col("weight")
    return placed.select("key", first.alias("first"), (first + F.col("times") * F.size("slots")).alias("until"), "base", "period", "slots")


def source_weights(sizes: DataFrame, weights: Mapping[str | None, int] | None, block: int, period: int = PERIOD) -> DataFrame:
    """(key, blocks, weight) of sources by their rows (key, count): the weights given, or by the square root of rows, so that large sources give way to small ones."""
    own = sizes.withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("long"))
    if weights is not None:
        if weights and min(weights.values()) < 1:
            raise ValueError("weights are positive whole numbers")
        given = sizes.sparkSession.createDataFrame([("null" if s is None else f"s:{s}", int(w)) for s, w in weights.items()], "key string, given long")
        return own.join(given, "key", "left").select("key", "blocks", F.coalesce("given", F.lit(1)).cast("long").alias("weight"))
    total = sizes.agg(F.sum(F.sqrt("count"))).first()[0] or 1.0
    return own.select("key", "blocks", F.greatest(F.lit(1), F.round(F.sqrt("count") * period / total)).cast("long").alias("weight"))


def _free(name: str, taken) -> str:
    while name in taken:
        name = "_" + name
    return name


def _starts(counts: DataFrame, key: str, cell: str, first: str) -> DataFrame:
    """(key, cell, first): rows of the key in the cells before; spans of cells are added up first, so no window is long."""
    span = F.floor(F.col(cell) / SPAN)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("span", span)
    spans = counts.groupBy(key, "span").agg(F.sum("count").alias("n")).select(key, "span", F.coalesce(F.sum("n").over(before(key, "span")), F.lit(0)).alias("base"))
    own = counts.withColumn("own", F.coalesce(F.sum("count").over(before(key, "span", cell)), F.lit(0)))
    return own.join(spans, [key, "span"]).select(key, cell, (F.col("own") + F.col("base")).alias(first))


def hash_of(doc_id: Column) -> Column:
    """60 bits of the MD5 of an id's text; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0))


def schedule(docs: DataFrame, weights: Mapping[str | None, int] | None = None, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source", prefix: str = "mix_", broadcast: int = BROADCAST) -> tuple[DataFrame, list[str]]:
    """All rows and columns of ``docs`` with the block's number within its source, its slot and the row's place in the block; and the names of these three.

    Within a source documents come by a hash of doc_id.  ``weights`` are
    positive whole numbers by source, 1 for sources not named; None gives
    weights by the square root of rows.  Null sources are a source of their
    own; nothing is dropped or repeated.  A schedule of at most ``broadcast``
    slots is broadcast, a longer one is joined by source and block.
    """
    names = [_free(prefix + x, docs.columns) for x in ("key", "cell", "hash", "rank", "first")]
    key, cell, mixed, rank, first = names
    n_block, slot, place = (_free(prefix + x, docs.columns) for x in ("block", "slot", "place"))
    named = F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))
    sizes = docs.groupBy(named.alias("key")).count()
    plan = SharedTable(schedule_table(source_weights(sizes, weights, block)), "schedule").df
    total, slots = docs.count(), plan.agg(F.sum(F.size("slots"))).first()[0] or 0

    cells = max(1, -(-total // CELL))
    dealt = docs.withColumns({key: named, mixed: hash_of(F.col(doc_id))}).withColumn(cell, F.pmod(F.col(mixed), F.lit(cells)))
    starts = _starts(dealt.groupBy(key, cell).count(), key, cell, first)
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(key, cell).orderBy(mixed, doc_id)) - 1).join(starts, [key, cell])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(first)).withColumns({n_block: F.floor(F.col(rank) / block).cast("long"), place: (F.col(rank) % block).cast("int")})
    step, n = "(k - first)", "size(slots)"
    at = f"cast(base + ({step} div {n}) * period + slots[cast({step} % {n} as int)] as long)"
    if slots <= broadcast:
        p = {c: _free(f"{prefix}run_{c}", docs.columns) for c in plan.columns}
        here = (F.col(key) == F.col(p["key"])) & (F.col(n_block) >= F.col(p["first"])) & (F.col(n_block) < F.col(p["until"]))
        joined = ranked.join(F.broadcast(plan.withColumnsRenamed(p)), here)
        fitted = F.expr(re.sub(r"\b(first|base|period|slots|k)\b", lambda m: f"`{n_block if m[0] == 'k' else p[m[0]]}`", at))
        joined = joined.withColumn(slot, fitted)
    else:
        blocks = plan.withColumn("k", F.explode(F.expr("sequence(first, until - 1)"))).select(F.col("key").alias(key), F.col("k").alias(n_block), F.expr(at).alias(slot))
        joined = ranked.join(blocks, [key, n_block])
    return joined.select(*docs.columns, n_block, slot, place), [n_block, slot, place]


def mixing_order(docs: DataFrame, weights: Mapping[str | None, int] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, block, slot, place) of every row: the training order is by slot, then place."""
    found, (n_block, slot, place) = schedule(docs.select("doc_id", "source"), weights, block)
    return found.select("doc_id", "source", F.col(n_block).alias("block"), F.col(slot).alias("slot"), F.col(place).alias("place"))


def mixed(docs: DataFrame, weights: Mapping[str | None, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows and columns of ``docs``, laid out in training order."""
    found, (_, slot, place) = schedule(docs, weights, block)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(width, slot, place).sortWithinPartitions(slot, place).select(*docs.columns)


def mixing_sql(block: int = BLOCK, period: int = PERIOD, cell: int = CELL) -> str:
    """DuckDB SQL of mixing_order() with default weights: earliest deadline first, one slot at a time."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS key, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0) AS h FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h % (SELECT greatest(1, ceil(count(*) / {cell}.0))::BIGINT FROM d), h, doc_id) - 1 AS rank FROM d),
sizes AS (SELECT key, count(*) AS n FROM d GROUP BY key),
sources AS (SELECT key, ceil(n / {block}.0)::BIGINT AS blocks, greatest(1, round(sqrt(n) * {period} / (SELECT sum(sqrt(n)) FROM sizes)))::BIGINT AS weight FROM sizes),
all_sources AS (SELECT list(key ORDER BY key) AS keys, list(blocks ORDER BY key) AS blocks, list(weight ORDER BY key) AS weights FROM sources),
run AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS step, 0::HUGEINT AS period, blocks AS remaining, list_transform(blocks, lambda x: 0::BIGINT) AS had, list_transform(blocks, lambda x: 0::BIGINT) AS own, 0::BIGINT AS pick, 0::BIGINT AS block FROM all_sources WHERE len(keys) > 0
  UNION ALL
  SELECT slot + 1, step + 1, period, remaining, list_transform(had, lambda x, i: x + (i = picked)::BIGINT), own, picked, blocks[picked] - remaining[picked] + had[picked]
  FROM (SELECT *, list_position(due, list_min(due))::BIGINT AS picked FROM (
    SELECT *, list_transform(own, lambda o, i: CASE WHEN o > 0 AND had[i] < o AND had[i] * period // greatest(o, 1) <= step THEN ((had[i] + 1) * period + o - 1) // greatest(o, 1) END) AS due FROM (
      SELECT slot, blocks, CASE WHEN fresh THEN 0 ELSE step END AS step, CASE WHEN fresh THEN list_sum(next_own) ELSE period END AS period, CASE WHEN fresh THEN next_left ELSE remaining END AS remaining,
        CASE WHEN fresh THEN list_transform(had, lambda x: 0::BIGINT) ELSE had END AS had, CASE WHEN fresh THEN next_own ELSE own END AS own FROM (
        SELECT *, list_transform(next_left, lambda x, i: least(x, weights[i])) AS next_own FROM (
          SELECT run.*, blocks, weights, step = period AS fresh, list_transform(remaining, lambda x, i: x - had[i]) AS next_left FROM run, all_sources)))
    WHERE period > 0))
)
SELECT doc_id, source, block, slot, (rank % {block})::INTEGER AS place FROM ranked JOIN (SELECT keys[pick] AS key, block, slot FROM run, all_sources WHERE slot >= 0) USING (key) WHERE block = rank // {block}"""
