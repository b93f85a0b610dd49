"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, join_unique


def _least(edges: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """Edges with the smallest v of their u, column m; and their number, a hash of them all and the most that a node has.

    Nodes with very many edges get theirs by broadcast (join_unique), so no
    task gathers a node's edges.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.sum(F.expr("xxhash64(u, v) % 1099511627776")).alias("h"))
    total, mark, most = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first()
    return join_unique(edges, least.drop("h"), "u", total, largest=most), (total, mark, most)


#: Nodes that a task remembers while it drops edges.
REMEMBERED = 500_000


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: each task, as many as run at once, drops those that its earlier ones already imply.

    Where groups are linked through many keys that leaves an edge a node and
    task instead of one a node and key.  A task that has met REMEMBERED nodes
    forgets them, which costs edges and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            kept: tuple[list[int], list[int]] = ([], [])
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    above[max(a, b)] = min(a, b)
                    kept[0].append(u), kept[1].append(v)
                if len(above) > REMEMBERED:
                    above.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept], ["u", "v"])

    known = edges.where("u is not null and v is not null").select("u", "v")
    return known.coalesce(edges.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it reaches.

    ``edges`` has long columns u and v; order, repeats and self-links don't
    matter, rows with nulls are left out.  Two steps alternate, each written to
    the shared folder, until the edges form stars.  Large star: every larger
    neighbour of a node is tied to the smallest node around it.  Small star: a
    node and its smaller neighbours are tied to the smallest of these.  The
    result is read from a written table.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def small(table: SharedTable) -> SharedTable:
        below, _ = _least(table.df)
        tied = below.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        done = SharedTable(tied.distinct(), "components")
        table.drop()
        return done

    # A small star first: it joins each edge once, a large star twice.
    last, seen = small(SharedTable(edges, "edges")), None
    while True:
        around, found = _least(last.df.union(last.df.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        if found == seen or not found[0]:
            return last.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(last.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = found
        large = SharedTable(around.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "components")
        last.drop()
        last = small(large)
