"""Skylines: feasible rows that no other feasible row dominates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require, require_rows, require_unique
from ..shared import SharedTable
from .order import RANGE, in_ranges, with_ordinal


def validated(ledger: DataFrame, metrics: Mapping[str, str], feasible: str = "feasible", key: str = "id") -> DataFrame:
    """The whole ledger, after its checks: 2 to 8 finite metrics of one type each, unique non-empty ids, explicit feasibility."""
    require(2 <= len(metrics) <= 8, "a ledger has two to eight metrics")
    require(set(metrics.values()) <= {"minimize", "maximize"}, "a direction is minimize or maximize")
    kinds = dict(ledger.dtypes)
    require(all(kinds[m] in ("double", "float", "int", "bigint") or kinds[m].startswith("decimal") for m in metrics), "metrics are numbers")
    finite = {m: F.col(m).isNotNull() & (~F.isnan(m) & (F.abs(m) < float("inf")) if kinds[m] in ("double", "float") else F.lit(True)) for m in metrics}
    require_rows(ledger, **finite, feasible=F.col(feasible).isNotNull(), key=F.col(key).isNotNull() & (F.length(F.col(key).cast("string")) > 0))
    return require_unique(ledger, key)


def _no_worse(a: str, b: str, metrics: Mapping[str, str]) -> tuple[Column, Column]:
    """Whether row ``a`` is nowhere worse than ``b``, and somewhere better."""
    pairs = [(F.col(f"{a}.{m}"), F.col(f"{b}.{m}")) for m in metrics]
    pairs = [(x, y) if d == "minimize" else (y, x) for (x, y), d in zip(pairs, metrics.values())]
    return reduce(Column.__and__, [x <= y for x, y in pairs]), reduce(Column.__or__, [x < y for x, y in pairs])


def _matrix(table, metrics: Mapping[str, str]):
    import numpy as np

    signs = [1 if d == "minimize" else -1 for d in metrics.values()]
    columns = [table.column(m).to_pylist() if str(table.column(m).type).startswith("decimal") else table.column(m).to_numpy() for m in metrics]
    return np.column_stack([s * np.asarray(c) for c, s in zip(columns, signs)])


def undominated(x, others):
    """Whether each row of ``x`` (less is better) is dominated by none of ``others``, of which those that come first are tried first."""
    import numpy as np

    stays, alive = np.ones(len(x), bool), np.arange(len(x))
    for k in range(0, len(others), 64):
        judges = others[None, k : k + 64]
        for c in range(0, len(alive), 1024):
            part = x[alive[c : c + 1024], None]
            stays[alive[c : c + 1024]] = ~((judges <= part).all(2) & (judges < part).any(2)).any(1)
        alive = alive[stays[alive]]
    return stays


def _strength(x, scale):
    return (x.astype(float) / scale).sum(1)


#: Points that a task compares its rows with, and rows that it holds back until it knows the strongest ones.
STRONGEST, HELD = 512, 50_000


def local_skyline(rows: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Rows that none of the strongest rows of the same task dominates; no row of the skyline goes, and no task holds more than a bounded number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best, held, scale = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = _matrix(table, metrics)
            if not len(x):
                continue
            if scale is None:
                scale = np.maximum(np.abs(x.astype(float)).max(0), 1e-300)
            if best is not None:
                stays = undominated(x, best)
                table, x = table.filter(pa.array(stays)), x[stays]
            strong = np.concatenate([x, best]) if best is not None else x
            strong = strong[np.argsort(_strength(strong, scale), kind="stable")[: 2 * STRONGEST]]
            best = strong[undominated(strong, strong)][:STRONGEST]
            held.append(table)
            if sum(map(len, held)) > HELD:
                yield from pa.concat_tables(held).to_batches()
                held = []
        if held:
            table = pa.concat_tables(held)
            yield from table.filter(pa.array(undominated(_matrix(table, metrics), best))).to_batches()

    return rows.mapInArrow(run, rows.schema)


#: Cells of a lattice at most; points that a task compares with as many others.
CELLS, PIECE = 1024, 20_000


def _signed(metric: str, direction: str) -> Column:
    return F.col(metric) if direction == "minimize" else -F.col(metric)


class Lattice:
    """Distinct points (less is better) in the cells of a lattice of quantiles.

    ``points`` (p0..., cell, piece) and ``bounds`` are written or bounded:
    there are at most CELLS cells, whatever the rows.  ``meet`` (of, by) names
    cells of which the second may hold points that dominate some of the first;
    ``gone`` cells are dominated as a whole.
    """

    def __init__(self, points: DataFrame, piece: int = PIECE, cells: int = CELLS):
        import numpy as np

        self.names = points.columns
        side = max(2, int(cells ** (1 / len(self.names)) + 1e-9))
        shares = [i / side for i in range(1, side)]
        cuts = points.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 1000).alias(c) for c in self.names]).first()
        cell = F.lit(0)
        for c in self.names:
            own = sorted(set(cuts[c] or ()))
            cell = cell * side + sum((F.when(F.col(c).cast("double") > q, 1).otherwise(0) for q in own), F.lit(0))
        self.points = SharedTable(points.withColumn("cell", cell.cast("int")), "lattice").df
        found = self.points.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{k}_{c}") for c in self.names for k, f in (("low", F.min), ("high", F.max))]).orderBy("cell").collect()
        self.ids, self.sizes = [r["cell"] for r in found], {r["cell"]: r["n"] for r in found}
        # Bounds become doubles outwards, so that no comparison of wide numbers is lost.
        low = np.nextafter(np.array([[float(r[f"low_{c}"]) for c in self.names] for r in found]).reshape(len(found), len(self.names)), -np.inf)
        high = np.nextafter(np.array([[float(r[f"high_{c}"]) for c in self.names] for r in found]).reshape(len(found), len(self.names)), np.inf)
        gone = np.array([bool((high < x).all(1).any()) for x in low], bool)
        self.gone = [c for c, g in zip(self.ids, gone) if g]
        # A dominated cell needn't judge either: what it dominates is dominated by what dominates it.
        left = np.flatnonzero(~gone)
        self.meet = [(self.ids[b], self.ids[a]) for b in left for a in left[(low[left] <= high[b]).all(1)]]
        self.pieces = {c: -(-n // piece) for c, n in self.sizes.items()}


def lattice_front(points: DataFrame, piece: int = PIECE, cells: int = CELLS) -> DataFrame:
    """The distinct points (less is better in all columns) that none dominates.

    A point meets only the cells that may dominate it; cells of more than
    ``piece`` points are cut, and every two pieces meet in a task of their own.
    """
    import pyarrow as pa

    lattice = Lattice(points, piece, cells)
    names, spark = lattice.names, points.sparkSession
    meets = spark.createDataFrame([(b, a, lattice.pieces[b], lattice.pieces[a]) for b, a in lattice.meet] or [(-1, -1, 1, 1)], "of int, by int, n_of int, n_by int")
    mixed = F.xxhash64(*names)
    own = lattice.points.join(F.broadcast(meets), F.col("cell") == F.col("of"))
    judged = own.select(*names, "of", "by", F.pmod(mixed, F.col("n_of")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_by") - 1)).alias("j"), F.lit(True).alias("judged"))
    own = lattice.points.join(F.broadcast(meets), F.col("cell") == F.col("by"))
    judges = own.select(*names, "of", "by", F.explode(F.sequence(F.lit(0), F.col("n_of") - 1)).alias("i"), F.pmod(mixed, F.col("n_by")).cast("int").alias("j"), F.lit(False).alias("judged"))
    signs = dict.fromkeys(names, "minimize")

    def meet(key, group):
        import numpy as np

        here = group.column("judged").to_numpy(zero_copy_only=False).astype(bool)
        x = _matrix(group, signs)
        x, others = x[here], x[~here]
        scale = np.maximum(np.abs(others.astype(float)).max(0, initial=0), 1e-300)
        stays = undominated(x, others[np.argsort(_strength(others, scale), kind="stable")])
        return group.filter(pa.array(here)).select(names).append_column("stays", pa.array(stays))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lattice.points.select(*names).schema) + ", stays boolean"
    fates = judged.union(judges).groupBy("of", "by", "i", "j").applyInArrow(meet, schema)
    return fates.groupBy(*names).agg(F.bool_and("stays").alias("stays")).where("stays").select(*names)


def lattice_copies(points: DataFrame, piece: int = PIECE, cells: int = CELLS) -> dict[str, int]:
    """Points, cells, cells dominated as a whole, and how many points the tasks read: judged ones and those that judge."""
    found = Lattice(points, piece, cells)
    copies = sum(found.sizes[b] * found.pieces[a] + found.sizes[a] * found.pieces[b] for b, a in found.meet)
    return {"points": sum(found.sizes.values()), "cells": len(found.ids), "gone": len(found.gone), "copies": copies}


def skyline_points(ledger: DataFrame, metrics: Mapping[str, str], feasible: str = "feasible") -> DataFrame:
    """Distinct points of the feasible rows as columns p0, p1..., less being better."""
    return ledger.where(F.col(feasible)).select(*[_signed(m, d).alias(f"p{i}") for i, (m, d) in enumerate(metrics.items())]).distinct()


def skyline(ledger: DataFrame, metrics: Mapping[str, str], feasible: str = "feasible", local: bool = True, most: int = 4096, piece: int = PIECE, cells: int = CELLS) -> DataFrame:
    """Feasible rows that no feasible row dominates: nowhere worse and somewhere better.  Equal rows all stay.

    Each task first reduces its own rows.  What is left is compared by a
    broadcast anti join of at most ``most`` rows; beyond it distinct points
    meet in a lattice of quantiles (lattice_front).
    """
    rows = ledger.where(F.col(feasible))
    small = SharedTable(local_skyline(rows, metrics) if local else rows, "skyline").df
    if small.count() > most:
        points = lattice_front(skyline_points(small, metrics, feasible), piece, cells)
        own = small.withColumns({f"_p{i}": _signed(m, d) for i, (m, d) in enumerate(metrics.items())})
        renamed = points.withColumnsRenamed({f"p{i}": f"_p{i}" for i in range(len(metrics))})
        return own.join(renamed, renamed.columns, "left_semi").select(*ledger.columns)
    at_most, better = _no_worse("o", "r", metrics)
    return small.alias("r").join(small.alias("o"), at_most & better, "left_anti")


def skyline_two(ledger: DataFrame, metrics: Mapping[str, str], feasible: str = "feasible", rows: int = RANGE) -> DataFrame:
    """The skyline for two metrics by sorting: in order of both, the second must beat all before it.  Nulls and NaN are refused.

    Distinct points are dealt into ranges of that order; the best second metric
    of earlier ranges comes from one row a range.  Rows that have a point of the
    skyline stay, equal ones all.
    """
    require(len(metrics) == 2, "two metrics")
    (m1, d1), (m2, d2) = metrics.items()
    kinds = dict(ledger.dtypes)
    require_rows(ledger, **{m: F.col(m).isNotNull() & (~F.isnan(m) if kinds[m] in ("double", "float") else F.lit(True)) for m in metrics}, feasible=F.col(feasible).isNotNull())
    sign = lambda m, d: F.col(m) if d == "minimize" else -F.col(m)
    points = ledger.where(F.col(feasible)).select(sign(m1, d1).alias("_x"), sign(m2, d2).alias("_y")).distinct()
    ranged = in_ranges(points, "_x", "_y", rows=rows)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    best = ranged.groupBy("_range").agg(F.min("_y").alias("_least")).select("_range", F.min("_least").over(before).alias("_before"))
    here = Window.partitionBy("_range").orderBy("_x", "_y").rowsBetween(Window.unboundedPreceding, -1)
    judged = ranged.withColumn("_here", F.min("_y").over(here)).join(best, "_range")
    stays = (F.col("_here").isNull() | (F.col("_y") < F.col("_here"))) & (F.col("_before").isNull() | (F.col("_y") < F.col("_before")))
    front = judged.where(stays).select("_x", "_y")
    own = ledger.where(F.col(feasible)).withColumns({"_x": sign(m1, d1), "_y": sign(m2, d2)})
    return own.join(front, ["_x", "_y"], "left_semi").select(*ledger.columns)


def frontier(ledger: DataFrame, metrics: Mapping[str, str], order: list[str], feasible: str = "feasible") -> DataFrame:
    """The skyline in the order of the ledger, which ``order`` gives: all columns and ``ordinal``, the row's place in the whole ledger."""
    return skyline(with_ordinal(ledger, order), metrics, feasible).orderBy("ordinal")
