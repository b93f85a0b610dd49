"""Exact top-k inner products, by descending length with rotated partial sums.

The longest candidates (a bounded number) give every query a first lower bound
of its k-th score.  Candidates are dealt into bands by descending length, and
queries into blocks by the least length that can still reach their bound; by
Cauchy-Schwarz a block meets only bands with candidates that long.  Each block
and band is one task's group.  Within it vectors are rotated onto the singular
directions of all candidates, so that the first coordinates hold most of a
product; the rest is bounded by Cauchy-Schwarz.  A query stops at the first
candidates too short to enter its top k, and computes in full only products
whose partial sum plus bound reaches its k-th best.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable, parts

#: Vectors of a block of candidates and of one of queries; candidates that are bounded together.
CANDIDATES, QUERIES, STEP = 16_384, 2_048, 512
#: Share of the squared length that the partial sums should hold.
HEAD = 0.5
#: Longest vectors that all queries meet first.
LONGEST = 2048
#: Whole numbers up to this size are exact as doubles, and so are sums of products that lengths bound by it.
EXACT = 2.0**53


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with null or non-finite components go."""
    x = F.col(embedding).cast("array<double>")
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return vectors.where(fine).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda a: F.when(F.abs(a * scale) < EXACT, F.floor(a * scale).cast("double")).otherwise(a * scale)).alias("v"))


def rotation(vectors: DataFrame, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: singular directions of the rows of ``v`` and the squared singular values, from sums of products that tasks add up; prepare: what is done to rows before."""

    def products(batches):
        total: dict = {}
        for batch in batches:
            for d, _, x in matrices(batch.column(0)):
                x = prepare(x) if prepare else x
                total[d] = x.T @ x + total.get(d, 0)
        for d, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([t.ravel()], pa.list_(pa.float64()))], ["d", "products"])

    sums = vectors.select("v").mapInArrow(products, "d int, products array<double>")
    flat = sums.select("d", F.posexplode("products")).groupBy("d", "pos").agg(F.sum("col").alias("total"))
    whole_sums = flat.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("all")).select("d", F.col("all.total").alias("total"))
    out = {}
    table = whole_sums.toArrow()  # squares of the dimension only, one row a dimension
    for d, total in zip(table.column("d").to_pylist(), table.column("total")):
        m = total.values.to_numpy().reshape(d, d)
        if not np.isfinite(m).all():  # lengths beyond doubles: any directions are right
            m = np.eye(d)
        values, directions = np.linalg.eigh((m + m.T) / 2)
        out[d] = directions[:, ::-1], values[::-1]
    return out


def matrices(column):
    """(dimension, rows, matrix) of the vectors of each dimension in a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edges, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(edges)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[edges[rows][:, None] + np.arange(d)]


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, directions: np.ndarray, head: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best among the vectors, its own id left out, ties to smaller ids.

    Scores below ``least`` (by query) may be left out.
    """
    with np.errstate(over="ignore"):
        length, asked_length = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    if not len(queries) or not len(vectors) or not asked_length.max() * length.max() < EXACT:
        return search_large(queries, query_ids, vectors, ids, k)
    order = np.lexsort((ids, -length))
    vectors, ids, length = vectors[order], ids[order], length[order]
    turned, asked = vectors @ directions, queries @ directions
    rest = np.sqrt(np.einsum("ij,ij->i", turned[:, head:], turned[:, head:]))
    asked_rest = np.sqrt(np.einsum("ij,ij->i", asked[:, head:], asked[:, head:]))
    slack = 1e-9 * (1 + asked_length * length[0])
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.full(len(queries), -np.inf) if least is None else least
    live = np.arange(len(queries))
    for at in range(0, len(vectors), STEP):
        # Products are at most length times length: later vectors are shorter still.
        live = live[asked_length[live] * length[at] + slack[live] >= np.maximum(best[live, -1], floor[live])]
        if not len(live):
            break
        part = slice(at, at + STEP)
        bound = asked[live, :head] @ turned[part, :head].T + np.outer(asked_rest[live], rest[part])
        may = bound + slack[live, None] >= np.maximum(best[live, -1], floor[live])[:, None]
        rows = np.flatnonzero(may.any(axis=1))
        if not len(rows):
            continue
        columns = np.flatnonzero(may.any(axis=0)) + at
        chosen = live[rows]
        score = queries[chosen] @ vectors[columns].T  # whole numbers below EXACT
        score[~may[np.ix_(rows, columns - at)]] = -np.inf
        score[query_ids[chosen, None] == ids[None, columns]] = -np.inf
        all_scores = np.hstack([best[chosen], score])
        all_ids = np.hstack([best_id[chosen], np.broadcast_to(ids[columns], score.shape)])
        if all_scores.shape[1] > 4 * k:  # whatever is below the k-th score can't enter
            kth = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1 : k]
            width = max(k, int((all_scores >= kth).sum(axis=1).max()))
            keep = np.argpartition(-all_scores, width - 1, axis=1)[:, :width] if width < all_scores.shape[1] else None
            if keep is not None:
                all_scores, all_ids = np.take_along_axis(all_scores, keep, 1), np.take_along_axis(all_ids, keep, 1)
        take = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[chosen], best_id[chosen] = np.take_along_axis(all_scores, take, 1), np.take_along_axis(all_ids, take, 1)
    row, rank = np.nonzero(best > -np.inf)
    return row, best_id[row, rank], best[row, rank].astype(np.int64)


def search_large(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search(), for products beyond doubles' whole numbers: doubles choose who may be among the k best, Python's whole numbers decide.

    Scores beyond 64 bits count as the largest or smallest long.
    """
    out, most = [], np.iinfo(np.int64).max
    clip = lambda x: min(max(x, -most - 1), most)
    scale = np.abs(vectors).max(initial=1.0)
    small = vectors / scale
    length = np.linalg.norm(small, axis=1)
    for at, query in enumerate(queries):
        own_scale = np.abs(query).max(initial=1.0)
        own, limit = query / own_scale, float(most) / scale / own_scale
        rough, others = small @ own, np.flatnonzero(ids != query_ids[at])
        if len(others) > k:
            slack = 1e-9 * np.linalg.norm(own) * length
            kth = np.partition((rough - slack)[others], -k)[-k]
            others = others[(rough + slack)[others] >= (-np.inf if kth < -limit else min(kth, limit * (1 - 1e-9)))]
        whole_query = [int(x) for x in query]
        scored = sorted((-clip(sum(a * int(b) for a, b in zip(whole_query, vectors[i]))), int(ids[i])) for i in others)[:k]
        out += [(at, i, -s) for s, i in scored]
    row, found, score = zip(*out) if out else ((), (), ())
    return np.array(row, np.int64), np.array(found, np.int64), np.array(score, np.int64)


def in_ranges(rows: DataFrame, n: int, name: str, *order) -> DataFrame:
    """The rows with the number of their range by ``order``, column ``name``: at most ``n`` ranges of about equal size, however many tasks wrote them."""
    table = SharedTable(rows.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), "ranges").df
    tasks = (table.agg(F.max(name)).first()[0] or 0) + 1
    return table.withColumn(name, F.floor(F.col(name) * min(n, tasks) / F.lit(tasks)).cast("int"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, candidates: int = CANDIDATES, queries: int = QUERIES, longest: int = LONGEST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query, or all where fewer are.

    Queries are the rows whose id is divisible by ``every``; all rows but those
    of the same id are their candidates.  Vectors that are null, empty or hold
    null or non-finite components take no part, nor do rows with null ids;
    vectors of different dimensions don't meet.  Repeated ids count once for
    each row as candidates; of those that are queries the smallest vector asks.
    Scores beyond 64 bits count as the largest or smallest long.  Other columns
    are ignored.
    """
    # A component times the scale may leave doubles; the largest ones stand for it.
    v = F.transform("v", lambda x: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), x)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    table = whole(vectors, vec_id, embedding, scale).where(F.size("v") > 0).withColumn("v", v).withColumns({"d": F.size("v"), "length": length})
    n, n_queries = table.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    turns = {}
    for d, (directions, values) in rotation(table).items():
        share = np.cumsum(np.maximum(values, 0)) / max(values.clip(0).sum(), 1e-300)
        turns[d] = directions, int(min(d, max(1, np.searchsorted(share, HEAD) + 1)))
    first = table.orderBy(F.desc("length"), "vec_id").limit(longest).select("vec_id", "v").toArrow()
    first_ids, firsts = first.column("vec_id").to_numpy(), {d: (rows, x) for d, rows, x in matrices(first.column("v"))}

    def bounded(batches):
        """The k-th best score among the longest vectors, less what rounding may add; null where there are fewer."""
        for batch in batches:
            ids, least = batch.column("vec_id").to_numpy(), np.full(len(batch), np.nan)
            for d, rows, x in matrices(batch.column("v")):
                at, c = firsts.get(d, ((), None))
                for i in range(0, len(rows) if len(at) >= k else 0, 1024):
                    part = rows[i : i + 1024]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = x[i : i + 1024] @ c.T
                        slack = 1e-9 * np.linalg.norm(x[i : i + 1024], axis=1) * np.linalg.norm(c, axis=1).max()
                    score[np.isnan(score) | (ids[part][:, None] == first_ids[at][None, :])] = -np.inf
                    least[part] = np.partition(score, -k, axis=1)[:, -k] - slack
            fine = np.isfinite(least) & (least > -9e18)
            least = np.minimum(least, 9e18)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(fine, least, 0.0), mask=~fine)], ["vec_id", "v", "d", "length", "least"])

    asked = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("d"), length.alias("length"))
    asked = asked.mapInArrow(bounded, "vec_id long, v array<double>, d int, length double, least double")
    # Small tables still make some sixteen tasks.
    n_c, n_q = max(parts(n, candidates), min(16, parts(n, 512))), parts(n_queries, queries)
    reach = F.try_divide("least", "length")
    asks = in_ranges(asked, n_q, "q", "d", reach, "vec_id")
    given = in_ranges(table, n_c, "c", "d", F.desc("length"), "vec_id")
    bands = given.groupBy("d", "c").agg(F.max("length").alias("band"))
    may = F.col("least").isNull() | (F.col("length") * F.col("band") * (1 + 1e-9) >= F.col("least"))
    # One row for each band, that is for some thousands of vectors.
    asking = asks.join(F.broadcast(bands), "d").where(may).select("d", "q", "c", "vec_id", "v", "least", F.lit(True).alias("asks"))
    met = given.join(asking.select("d", "q", "c").distinct(), ["d", "c"]).select("d", "q", "c", "vec_id", "v", F.lit(None).cast("double").alias("least"), F.lit(False).alias("asks"))

    def meet(key, group):
        directions, head = turns[key[0].as_py()]
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("vec_id").to_numpy()
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        least = np.nan_to_num(group.column("least").to_numpy(zero_copy_only=False).astype(float)[asks], nan=-np.inf)
        row, found, score = search(v[asks], ids[asks], v[~asks], ids[~asks], k, directions, head, least)
        return pa.table({"query_id": ids[asks][row], "vec_id": found, "score": score})

    cells = asking.union(met.select(*asking.columns)).groupBy("d", "q", "c").applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL of top_k() on the embeddings, by comparing everything."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
