"""Embedding near-duplicates by a pigeonhole join over subspaces.

Unit vectors within cosine c are within squared distance 2 - 2c.  They are
rotated onto the singular directions of all vectors and cut into blocks of a
few coordinates; each block gets a share of the squared distance proportional
to the energy it holds, so near vectors are within the share of some block.
Each block is joined by range: cells twice as wide as its radius over its first
two coordinates, with copies in the cells below where a neighbour may lie.
Cells get the block's coordinates only; of vectors with a neighbour within the
block's share the whole vector is fetched.  Candidates are then verified
exactly, each pair in the first block that finds it and in one cell only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, join_unique
from .components import components
from .topk import rotation

BLOCKS = 8
#: Vectors that one task compares at once; longer runs of a cell are split.
CELL = 4096
TILE = 1024
EPS = 1e-9

KEY = ["lab", "d", "block", "c1", "c2"]
PLACE = "lab long, d int, block int, c1 long, c2 long, low1 int, low2 int, id long"
FOUND = "id long, links long, root long"
#: What rounding to four bytes may take from a squared distance of unit vectors.
ROUNDED = 1e-5


class Subspaces:
    """Blocks of rotated coordinates and their shares of the squared distance."""

    def __init__(self, directions: np.ndarray, values: np.ndarray, budget: float, blocks: int):
        energy, edges = np.maximum(values, 0), np.linspace(0, len(values), min(blocks, len(values)) + 1).astype(int)
        shares = np.array([energy[a:b].sum() for a, b in zip(edges, edges[1:])]) / max(energy.sum(), 1e-300)
        self.directions, self.cuts = directions, [(a, b) for a, b, s in zip(edges, edges[1:], shares) if s > 1e-12] or [(0, len(values))]
        kept = shares[shares > 1e-12]
        self.budgets = budget * (kept / kept.sum() if len(kept) else np.ones(1)) + EPS

    def cells(self, turned: np.ndarray):
        """(row, block, c1, c2, low1, low2, coordinates): home cells, and cells below within the block's radius (low marks the axis)."""
        for k, (a, b) in enumerate(self.cuts):
            radius = np.sqrt(self.budgets[k])
            x = np.stack([turned[:, a], turned[:, a + 1] if b > a + 1 else np.zeros(len(turned))]) / (2 * radius)
            home = np.floor(x)
            near = x - home <= 0.5 + 1e-6
            for low1 in (0, 1):
                for low2 in (0, 1):
                    row = np.flatnonzero((near[0] | (low1 == 0)) & (near[1] | (low2 == 0)))
                    yield row, k, home[0, row].astype(np.int64) - low1, home[1, row].astype(np.int64) - low2, low1, low2, turned[row, a:b].astype(np.float32)


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return unit_rows(flat.reshape(len(column), -1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, initial=0.0, keepdims=True)  # squares of very large or small components would leave doubles
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cell_neighbours(group: pa.Table, spaces: dict[int, Subspaces], crossed: bool = False) -> pa.Table:
    """Rows of a cell that have another one within the block's share; crossed: one of the other side."""
    space, block = spaces[group.column("d")[0].as_py()], group.column("block")[0].as_py()
    low1, low2 = group.column("low1").to_numpy(), group.column("low2").to_numpy()
    side = group.column("side").to_numpy() if crossed else None
    x = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1)
    size, near = np.einsum("ij,ij->i", x, x), np.zeros(len(group), bool)
    for i in range(0, len(group), TILE):
        for j in range(i, len(group), TILE):
            apart = size[i : i + TILE, None] + size[None, j : j + TILE] - 2 * x[i : i + TILE] @ x[j : j + TILE].T
            u, v = np.nonzero(apart <= space.budgets[block] + ROUNDED)
            u, v = u + i, v + j
            ok = (u < v) & (low1[u] & low1[v] == 0) & (low2[u] & low2[v] == 0)
            if crossed:
                ok &= side[u] != side[v]
            near[u[ok]] = near[v[ok]] = True
    return group.filter(pa.array(near))


def cell_links(group: pa.Table, spaces: dict[int, Subspaces], cosine: float, crossed: bool = False) -> pa.Table:
    """Links of a cell: for each vector how many it has there, and the smallest one of its tree; crossed: between sides 0 and 1 only."""
    space, block = spaces[group.column("d")[0].as_py()], group.column("block")[0].as_py()
    ids, many = group.column("id").to_numpy(), group.column("many").to_numpy()
    low1, low2 = group.column("low1").to_numpy(), group.column("low2").to_numpy()
    side = group.column("side").to_numpy() if crossed else None
    x = unit(group.column("embedding"))
    turned = x @ space.directions
    a, b = space.cuts[block]
    own = turned[:, a:b]
    size = np.einsum("ij,ij->i", own, own)
    heads, tails = [], []
    for i in range(0, len(ids), TILE):
        for j in range(i, len(ids), TILE):
            apart = size[i : i + TILE, None] + size[None, j : j + TILE] - 2 * own[i : i + TILE] @ own[j : j + TILE].T
            u, v = np.nonzero(apart <= space.budgets[block] + EPS)
            u, v = u + i, v + j
            # Both copied down the same axis: they meet in the cell above.
            ok = (u < v) & (low1[u] & low1[v] == 0) & (low2[u] & low2[v] == 0)
            if crossed:
                ok &= side[u] != side[v]
            u, v = u[ok], v[ok]
            for k in range(0, len(u), 65536):
                p, q = u[k : k + 65536], v[k : k + 65536]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[near], q[near]
                squares = (turned[p] - turned[q]) ** 2
                first = np.ones(len(p), bool)
                for earlier in range(block):
                    c, d = space.cuts[earlier]
                    first &= squares[:, c:d].sum(axis=1) > space.budgets[earlier]
                first &= squares[:, a:b].sum(axis=1) <= space.budgets[block]
                heads.append(p[first])
                tails.append(q[first])
    u, v = np.concatenate(heads or [np.empty(0, int)]), np.concatenate(tails or [np.empty(0, int)])
    links = np.bincount(u, many[v], len(ids)) + np.bincount(v, many[u], len(ids))
    root = ids.copy()
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, least)
        np.minimum.at(root, v, least)
        if (before == root).all():
            break
    linked = links > 0
    return pa.table({"id": ids[linked], "links": links[linked].astype(np.int64), "root": root[linked]})


def by_cells(rows: DataFrame, work: Callable[..., pa.Table], found: str, most: int) -> DataFrame:
    """What ``work`` makes of the rows of each cell (equal KEY), columns ``found``.

    Cells of more than ``most`` rows leave their task and are cut into pieces by
    a hash of ``id``; every two pieces meet in a task of their own, where work
    gets ``crossed`` and a column side.  The result is read from a written table.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(StructType.fromDDL(found)), to_arrow_type(rows.schema)]

    def both(made: pa.Table | None, left: pa.Table | None) -> pa.RecordBatch:
        """Two struct columns, of which each row has one."""
        n, columns = [0 if t is None else len(t) for t in (made, left)], []
        for k, t in enumerate((made, left)):
            own = pa.StructArray.from_arrays([pa.concat_arrays(t.column(f.name).chunks).cast(f.type) for f in kinds[k]], fields=list(kinds[k])) if n[k] else pa.nulls(0, kinds[k])
            columns.append(pa.concat_arrays([own, pa.nulls(n[1], kinds[k])] if k == 0 else [pa.nulls(n[0], kinds[k]), own]))
        return pa.RecordBatch.from_arrays(columns, ["made", "left"])

    def scan(batches):
        held, long_key = None, None
        keys = lambda table: np.stack([table.column(c).to_numpy() for c in KEY])
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not len(held):
                continue
            k = keys(held)
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            starts = [0, *cuts.tolist()]
            for s, e in zip(starts, starts[1:]):
                if tuple(k[:, s]) == long_key or e - s > most:
                    yield both(None, held.slice(s, e - s))
                elif e - s > 1:
                    yield both(work(held.slice(s, e - s).combine_chunks()), None)
            held, here = held.slice(starts[-1]), tuple(k[:, starts[-1]])
            if here == long_key or len(held) > most:
                long_key = here
                yield both(None, held)
                held = held.slice(len(held))
        if held is not None and len(held):
            if tuple(keys(held)[:, 0]) == long_key:
                yield both(None, held)
            elif len(held) > 1:
                yield both(work(held.combine_chunks()), None)

    struct = lambda schema: f"struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in schema)}>"
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = rows.repartition(width, *KEY).sortWithinPartitions(*KEY).mapInArrow(scan, f"made {struct(StructType.fromDDL(found))}, left {struct(rows.schema)}")
    table = SharedTable(scanned, "cells").df
    made, long = table.where("made is not null").select("made.*"), table.where("left is not null").select("left.*")
    if long.isEmpty():
        return made
    n = long.groupBy(*KEY).agg(F.ceil(F.count("*") / F.lit(most / 2)).cast("int").alias("n"))
    pieces = long.join(n, KEY).withColumn("own", F.expr("cast(pmod(xxhash64(id, 7), n) as int)"))
    pieces = pieces.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
    pieces = pieces.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", F.expr("if(own <= other, 0, 1)"))
    meet = lambda key, group: work(group, crossed=key[-1].as_py() != key[-2].as_py()).select([f.name for f in kinds[0]])
    return made.union(pieces.drop("own", "other", "n").repartition(width, *KEY, "i", "j").groupBy(*KEY, "i", "j").applyInArrow(meet, found))


def _links(reps: DataFrame, cosine: float, blocks: int, most: int) -> DataFrame:
    """(id, links, root) partial counts and trees of the distinct vectors ``reps`` (lab, d, embedding, id, many, key)."""
    turns = rotation(reps.select(F.col("embedding").alias("v")), unit_rows)
    spaces = {d: Subspaces(*t, 2 - 2 * cosine, blocks) for d, t in turns.items()}

    def deal(batches):
        for batch in batches:
            sizes = batch.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == d))
                for row, k, c1, c2, low1, low2, x in spaces[d].cells(unit(own.column("embedding")) @ spaces[d].directions):
                    if len(row):
                        t, fill = own.take(pa.array(row)), lambda v: pa.array(np.full(len(row), v, np.int32))  # noqa: B023
                        coordinates = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                        yield pa.RecordBatch.from_arrays([t.column("lab"), t.column("d"), fill(k), pa.array(c1), pa.array(c2), fill(low1), fill(low2), t.column("id"), coordinates], [*KEY, "low1", "low2", "id", "x"])

    dealt = reps.select("lab", "d", "embedding", "id").mapInArrow(deal, f"{PLACE}, x array<float>")
    near = by_cells(dealt, lambda group, crossed=False: cell_neighbours(group, spaces, crossed), PLACE, most).distinct()
    whole = near.join(reps.select("id", "many", "embedding"), "id").select(*KEY, "low1", "low2", "id", "many", "embedding")
    return by_cells(whole, lambda group, crossed=False: cell_links(group, spaces, cosine, crossed), FOUND, most)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", blocks: int = BLOCKS, most: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link if their labels are equal and not null and their cosine is at
    least ``cosine``.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id or label, link with nothing
    and are their own component.  Equal vectors are compared once and counted
    each.  Repeated ids are separate rows: each has the links and the component
    of its own vector.  Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    whole = vectors.schema[label].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    lab = F.col("label").cast("long") if whole else F.xxhash64("label")
    clean = rows.where(fine).select("vec_id", "embedding", lab.alias("lab"))
    # Equal vectors of a label have one key of 128 bits; a zero's sign doesn't count.
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    keyed = lambda df: df.withColumn("key", F.concat(F.hex(F.xxhash64("lab", plain)), F.lit(":"), F.hex(F.xxhash64(plain, "lab", F.size("embedding")))))
    # A distinct vector is named by a number of its own, for an id may have several vectors.
    grouped = clean.groupBy("lab", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    reps = SharedTable(keyed(grouped).select("lab", F.size("embedding").alias("d"), "embedding", F.monotonically_increasing_id().alias("id"), "least", "many", "key"), "vectors").df
    parts = SharedTable(_links(reps, cosine, blocks, most), "near").df
    counts = parts.groupBy("id").agg(F.sum("links").alias("links"))
    linked = reps.select("id", "least").join(components(parts.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id"), "id")
    linked = SharedTable(linked, "linked").df
    firsts = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    roots = join_unique(linked.select("id", "root"), firsts, "root", linked.count()).select("id", "component_id")
    known = reps.join(counts, "id", "left").join(roots, "id", "left")
    known = known.select("key", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    known = SharedTable(known, "known").df
    total = known.agg(F.sum("many")).first()[0] or 0
    own = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_unique(keyed(clean).select("vec_id", "key"), known, "key", total, n="many").select("vec_id", "n_links", "component_id").union(own)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def near_vectors_sql(cosine: float = 0.98) -> str:
    """DuckDB SQL of near_vectors() on the embeddings, by comparing all vectors of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""
