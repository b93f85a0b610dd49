"""Choice among plans of one result before any of them runs, by costs fitted to earlier measures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import require
from ..functions.digest import multiset_digest


@dataclass(frozen=True)
class Route:
    """A way to a result: the plan for an input, and its work, a number that is counted from the input and not from the result."""

    plan: Callable[[object], DataFrame]
    work: Callable[[object], float]


def seconds(run: Callable[[], object], work: float) -> float:
    """The cost of a run in seconds of this driver's clock."""
    began = time.monotonic()
    run()
    return time.monotonic() - began


class Calibrated:
    """Measures (route, work, cost) in a folder, and for each route the line base + slope * work that fits them best."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def record(self, measures: list[tuple[str, float, float]]) -> None:
        self.spark.createDataFrame([(r, float(w), float(c)) for r, w, c in measures], "route string, work double, cost double").coalesce(1).write.mode("append").parquet(self.folder)

    def calibrate(self, routes: Mapping[str, Route], inputs: Iterable, cost: Callable[[Callable[[], object], float], float] = seconds) -> None:
        """Runs every route on every input and keeps the costs; routes whose rows differ raise and nothing is kept of that input."""
        for own in inputs:
            found, measures = {}, []
            for name, route in routes.items():
                work = route.work(own)
                run = lambda name=name, route=route: found.setdefault(name, tuple(multiset_digest((df := route.plan(own)).select(*sorted(df.columns))).first()))  # noqa: B023, E731
                measures.append((name, work, cost(run, work)))
                require(name in found, "the cost is that of the run")
            require(len(set(found.values())) == 1, f"routes with the same rows: {sorted(found)}")
            self.record(measures)

    def lines(self) -> dict[str, tuple[float, float]]:
        """(base, slope) by route, neither below zero; a route needs measures of two different works."""
        fits = self.spark.read.schema("route string, work double, cost double").parquet(self.folder).groupBy("route").agg(
            F.regr_slope("cost", "work").alias("slope"), F.avg("work").alias("work"), F.avg("cost").alias("cost"), F.count_distinct("work").alias("works")
        )
        out = {}
        for r in fits.where("works > 1").collect():  # one row a route
            slope = max(0.0, r["slope"])
            base = r["cost"] - slope * r["work"]
            # A line that would start below zero goes through zero and the middle of the measures.
            out[r["route"]] = (base, slope) if base >= 0 else (0.0, r["cost"] / r["work"])
        return out

    def choose(self, routes: Mapping[str, Route], own, default: str, margin: float = 0.0) -> str:
        """The route for an input: another one than the default only if it is fitted, as the default is, and cheaper by the margin; ties go to the default, then by name."""
        require(default in routes and 0 <= margin < 1, "the default is one of the routes, the margin from 0 to below 1")
        lines = self.lines()
        if default not in lines:
            return default
        costs = {n: lines[n][0] + lines[n][1] * r.work(own) for n, r in sorted(routes.items()) if n in lines}
        best = min(costs, key=costs.get)
        return best if costs[best] < (1 - margin) * costs[default] else default
