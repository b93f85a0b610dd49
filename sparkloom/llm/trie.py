"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns.  It is known by its depth and 120
bits that every turn's hash goes into by exclusive or, so that the keys of all
prefixes of a conversation, however long, are running combinations.  Nodes with
the same smallest member make up a path that goes down without a gap, and every
path but the root's hangs on a node of another one.  In preorder a path comes
first, then what hangs on it, from its deepest node up; so paths are ranked by
their hops (depth, path) from the root, and a node's rank is its path's start and
its place on the path.  With the rank where each subtree ends, every total of a
subtree is a difference of two prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_ordinal
from .common import SharedTable, join_unique

#: Rows that one window adds up; what is longer is added up by cells of so many.
CELL = 1 << 16
#: Ids of one piece of the list that a node's digest is taken of.
PIECE = 1 << 14
SHARED, HEADS = 5, 9


def running(df: DataFrame, keys: list[str], at: str, most: int, values: dict[str, Column], combine: str = "sum", cell: int = CELL) -> DataFrame:
    """``df`` with, for each name of ``values``, the combination ("sum" or "bit_xor") of the value up to and with the row, within ``keys``, by ``at``.

    ``at`` are whole numbers from 0 to ``most``, no two rows of a key having the same.  Cells of
    ``cell`` places are combined by themselves, then the cells before each one
    in the same way, so no window is longer than a cell.
    """
    fold, of = getattr(F, combine), f"{at}_cell"
    out = df.withColumns({f"_{c}": v for c, v in values.items()}).withColumn(of, F.expr(f"`{at}` div {cell}"))
    inside = Window.partitionBy(*keys, of).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = out.withColumns({c: fold(f"_{c}").over(inside) for c in values})
    if most >= cell:
        less, more = (Column.__sub__, Column.__add__) if combine == "sum" else (Column.bitwiseXOR, Column.bitwiseXOR)
        totals = out.groupBy(*keys, of).agg(*[fold(f"_{c}").alias(f"_{c}") for c in values])
        upto = running(totals, keys, of, most // cell, {f"{c}_upto": F.col(f"_{c}") for c in values}, combine, cell)
        before = upto.select(*keys, of, *[less(F.col(f"{c}_upto"), F.col(f"_{c}")).alias(f"{c}_before") for c in values])
        done = done.join(before, [*keys, of]).withColumns({c: more(F.col(c), F.col(f"{c}_before")) for c in values})
    return done.select(*df.columns, *values)


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with each one's place (from 0) in its conversation; equal rows are counted first, so that many of them are one row."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("k2")]
    once = SharedTable(turns.groupBy("c", "turn", "role", "k1", "k2", "nb").agg(F.count("*").alias("times")), "turns").df
    sizes = once.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    by = Window.partitionBy("c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    short, placed = once, []
    if sizes.count():
        # Conversations with more turns than a window takes, less than one for each CELL rows, are cut by ranges of their order.
        many = F.broadcast(sizes.select("c"))
        short = once.join(many, "c", "left_anti")
        ranges = max(1, sizes.agg(F.sum("n")).first()[0] // CELL)
        cut = SharedTable(once.join(many, "c", "left_semi").repartitionByRange(ranges, "c", *order).withColumn("_range", F.spark_partition_id()), "long-turns").df
        inside = Window.partitionBy("c", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = Window.partitionBy("c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = cut.groupBy("c", "_range").agg(F.sum("times").alias("_n")).select("c", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        placed.append(cut.withColumn("_upto", F.sum("times").over(inside)).join(F.broadcast(starts), ["c", "_range"]).withColumn("_upto", F.col("_upto") + F.col("_start")).drop("_range", "_start"))
    placed.append(short.withColumn("_upto", F.sum("times").over(by)))
    found = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    first = F.col("_upto") - F.col("times")
    return found.withColumn("place", F.explode(F.when(F.col("times") == 1, F.array(first)).otherwise(F.sequence(first, F.col("_upto") - 1)))).select("c", "place", "k1", "k2", "nb")


def rebuilt(conversations: DataFrame, shared: int = SHARED, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (c, depth, k1, k2, nb) of the rebuilt conversations, and (c, n): every one and the number of its turns.

    k1 and k2 are 60 bits each of the SHA-256 of role and text, nb the text's
    UTF-8 bytes.  Of conversation c the first h turns (h is the id's CRC-32
    modulo ``heads``) are those of c - c % ``shared``.  Turns come by turn
    (null first), role and hash; rows without an id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), number(1).alias("k1"), number(16).alias("k2"), F.octet_length(text).cast("long").alias("nb"))
    own = SharedTable(_placed(turns), "places").df
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("long")
    sizes = own.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": h, "p": F.col("c") - F.col("c") % shared})
    given = sizes.select(F.col("c").alias("p"), F.col("own").alias("has"))
    sizes = SharedTable(sizes.join(given, "p", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).select("c", "p", "own", "h", "taken"), "sizes").df
    # At most heads - 1 turns of a conversation go to at most 2 * shared - 1 others.
    first = own.where((F.col("place") < heads - 1) & (F.col("c") % shared == 0)).withColumnRenamed("c", "p")
    head = first.join(sizes.select("c", "p", "taken"), "p").where("place < taken").select("c", (F.col("place") + 1).alias("depth"), "k1", "k2", "nb")
    total, largest = sizes.agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.max("own"), F.lit(0))).first()
    rest = join_unique(own, sizes.select("c", "h", "taken", F.col("own").alias("n")), "c", total, largest=largest).where("place >= h").select("c", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "k1", "k2", "nb")
    return head.unionByName(rest), sizes.select("c", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))


def _list_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the ids c of each node, ascending, comma-joined.

    Ids are sorted over ranges, which cut the lists of nodes where many
    conversations end, and leave as joined pieces; a digest has to read its
    list in order, so a node's pieces, a hundredth of its rows or less,
    pass through one task, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        ids: list[int] = []
        rows: list[tuple[int, int, int, str]] = []

        def close():
            if ids:
                rows.append((*held[0], ids[0], ",".join(map(str, ids))))
                ids.clear()

        def out():
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            done = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "first", "piece"])
            rows.clear()
            return done

        for batch in batches:
            for node, depth, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held[:1] != [(node, depth)] or len(ids) >= PIECE:
                    close()
                    held[:] = [(node, depth)]
                ids.append(c)
            if len(rows) >= 1024:
                yield out()
        close()
        yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, rows = None, None, []
        for batch in batches:
            for node, depth, _, piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held != (node, depth):
                    if held is not None:
                        rows.append((*held, state.hexdigest()))
                    held, state = (node, depth), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
        if held is not None:
            rows.append((*held, state.hexdigest()))
        yield batch_of(rows)

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])

    ranged = ends.select("conv_id", "depth", "c").repartitionByRange("conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c")
    joined = ranged.mapInArrow(pieces, "conv_id long, depth long, first long, piece string")
    sorted_pieces = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return sorted_pieces.mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def _paths(members: DataFrame, shared_turns: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """Paths (c, first, length, parent, hops): nodes whose smallest member is c, their depths from ``first`` on; and where each conversation ends.

    ``hops`` are the paths from the root to this one, each with its first depth,
    negative.  A conversation of D hops lies beside D others, of 1 to D turns
    at least, so hops are fewer than the square root of twice all turns.
    """
    top = members.where(F.col("c") != root).select("c", F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    hops = shared_turns.where("conv_id < c").groupBy("c", "conv_id").agg(F.min("depth").alias("at"), F.max("depth").alias("to")).unionByName(top)
    hops = hops.groupBy("c", "conv_id").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    above = hops.groupBy("c").agg(F.max("to").alias("to"), F.array_sort(F.collect_list(F.struct("at", "conv_id"))).alias("up"))
    own = members.join(above, "c", "left").withColumns({"first": F.coalesce(F.col("to") + 1, F.lit(0)), "parent": F.try_element_at("up", F.lit(-1))["conv_id"]})
    up = F.transform(F.coalesce("up", F.array().cast("array<struct<at:bigint,conv_id:bigint>>")), lambda x: F.struct((-x["at"]).alias("at"), x["conv_id"].alias("conv_id")))
    paths = own.where("first <= n").select("c", "first", (F.col("n") - F.col("first") + 1).alias("length"), "parent", F.concat(up, F.array(F.struct((-F.col("first")).alias("at"), F.col("c").alias("conv_id")))).alias("hops"))
    return paths, own.select(F.when(F.col("first") <= F.col("n"), F.col("c")).otherwise(F.col("parent")).alias("conv_id"), F.col("n").alias("depth"), "c")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, rank long, rank_end long"


def prefix_trie(conversations: DataFrame, shared: int = SHARED, heads: int = HEADS) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations (see rebuilt()).

    conv_id (smallest member) and depth name a node; with them parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and ``rank`` and ``rank_end``: the node's place in preorder and that after
    its subtree.  Conversations without turns are members of the root alone; an
    empty table has no nodes.  Two different turns with one key would raise.
    """
    turns, members = rebuilt(conversations, shared, heads)
    root, n_members, longest, n_turns = members.agg(F.min("c"), F.count("*"), F.max("n"), F.sum("n")).first()
    if root is None:
        return conversations.sparkSession.createDataFrame([], NODES)
    turns = running(turns.withColumn("_at", F.col("depth") - 1), ["c"], "_at", longest, {"f1": F.xxhash64("depth", "k1", "k2"), "f2": F.xxhash64("k2", "k1", "depth")}, "bit_xor")
    turns = SharedTable(turns.select("c", F.struct("depth", "f1", "f2").alias("key"), "k1", "k2", "nb"), "prefixes").df

    # Nodes: members, smallest member, bytes of the last text.  All its turns must be one.
    found = turns.groupBy("key").agg(F.min("c").alias("conv_id"), F.count("*").alias("n"), F.max("nb").alias("nb"), ((F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2"))).alias("clash"))
    nodes = SharedTable(found, "nodes").df
    clash, largest = nodes.agg(F.coalesce(F.max("clash"), F.lit(False)), F.coalesce(F.max("n"), F.lit(0))).first()
    if clash:
        raise ValueError("two turns share a key of 120 bits")
    # Turns whose node has other members too; every other one is a node of its own conversation.
    shared_turns = join_unique(turns.select("c", "key"), nodes.where("n > 1").select("key", "conv_id", "n"), "key", n_turns, largest=largest)
    shared_turns = SharedTable(shared_turns.select("c", F.col("key.depth").alias("depth"), "conv_id"), "shared").df

    paths, ends = _paths(members, shared_turns, root)
    paths = SharedTable(with_ordinal(paths, ["hops"]).drop("hops"), "paths").df
    n_paths, n_nodes, longest = paths.agg(F.count("*"), F.sum("length"), F.max("length")).first()
    paths = SharedTable(running(paths, [], "ordinal", n_paths - 1, {"_upto": F.col("length")}), "path-starts").df.withColumn("start", F.col("_upto") - F.col("length"))

    # The last path of each shared subtree, among those of its members.
    last = join_unique(shared_turns, paths.select("c", "ordinal", F.col("length").alias("n")), "c", n_turns, largest=longest).groupBy("conv_id", "depth").agg(F.max("ordinal").alias("last"))
    below = paths.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hanging"))
    at_root = conversations.sparkSession.createDataFrame([(root, 0, n_members, 0, n_paths - 1)], "conv_id long, depth long, n long, nb long, last long")
    own = nodes.select("conv_id", F.col("key.depth").alias("depth"), "n", "nb").join(last, ["conv_id", "depth"], "left").unionByName(at_root)
    named = join_unique(own, paths.select(F.col("c").alias("conv_id"), "first", "parent", "start", "length", "ordinal", F.col("length").alias("n_rows")), "conv_id", n_nodes, n="n_rows", largest=longest)
    named = named.join(below, ["conv_id", "depth"], "left").withColumns({
        "rank": F.col("start") + F.col("depth") - F.col("first"),
        "ends_path": F.col("depth") == F.col("first") + F.col("length") - 1,
        "last": F.coalesce("last", "ordinal"),
        "parent_conv_id": F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")),
    })
    named = named.withColumn("n_children", F.coalesce("hanging", F.lit(0)) + F.when(F.col("ends_path"), 0).otherwise(1))
    values = {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("nb")}
    columns = ["conv_id", "depth", "parent_conv_id", "n", "n_children", "nb", "rank", "ordinal", "last", "ends_path"]
    ranked = SharedTable(running(SharedTable(named.select(columns), "ranks").df, [], "rank", n_nodes - 1, values), "sums").df

    # A subtree's totals: the sums at the end of its last path less those before the node.
    uses = ranked.groupBy(F.col("last").alias("ordinal")).agg(F.count("*").alias("n_rows"))
    stops = ranked.where("ends_path").select("ordinal", (F.col("rank") + 1).alias("rank_end"), F.col("leaves").alias("leaves_end"), F.col("saved").alias("saved_end")).join(uses, "ordinal").withColumnRenamed("ordinal", "last")
    whole = join_unique(ranked, stops, "last", n_nodes, n="n_rows")
    digests = _list_digests(ends)
    return whole.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"), (F.col("leaves_end") - F.col("leaves") + values["leaves"]).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved") + values["saved"]).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "rank", "rank_end",
    )


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The columns of prefix_trie() that don't depend on how siblings are ordered."""
    return prefix_trie(conversations).drop("rank", "rank_end")


def trie_sql(shared: int = SHARED, heads: int = HEADS) -> str:
    """DuckDB SQL of trie_nodes(): every prefix spelled out, subtrees by the prefixes of each node."""
    step = "CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END"
    return f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS own, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::UBIGINT) AS bytes FROM t GROUP BY c),
h AS (SELECT c, own, c - c % {shared} AS p, (xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: i::UBIGINT)), lambda r, i: {step})), 4294967295::UBIGINT) % {heads})::BIGINT AS h FROM ids),
r AS (SELECT h.c, 0 AS part, place, role, text FROM h JOIN t ON t.c = h.p WHERE place < h UNION ALL SELECT h.c, 1, place, role, text FROM h JOIN t ON t.c = h.c WHERE place >= h),
n AS (SELECT c, row_number() OVER w AS depth, text, list(sha256(strlen(role) || ':' || role || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY part, place)),
every AS (SELECT c, depth, strlen(text) AS nb, path FROM n UNION ALL SELECT c, 0, 0, []::VARCHAR[] FROM h),
lengths AS (SELECT c, max(depth) AS len FROM every GROUP BY c),
nodes AS (SELECT path, any_value(depth) AS depth, min(every.c) AS conv_id, count(*) AS n, any_value(nb) AS nb, string_agg(every.c::VARCHAR, ',' ORDER BY every.c) FILTER (WHERE len = depth) AS ends FROM every JOIN lengths ON every.c = lengths.c GROUP BY path),
children AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
totals AS (SELECT path[:k] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n - 1) * nb)::BIGINT AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN totals USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[:-2]"""
