"""Search for the best of many candidates by rounds of trials, under a budget that is reserved before it is spent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError, require
from ..shared import SharedTable
from .order import RANGE, with_ordinal

LEDGER = ["round", "candidate", "trials", "cost", "mean", "kept"]


@dataclass(frozen=True)
class Search:
    """``ledger`` has a row for each round and candidate in it; ``stopped`` says why there is no further round."""

    ledger: DataFrame
    spent: int
    reserved: int
    stopped: str

    def best(self) -> DataFrame:
        """The ledger's row of the best candidate: that of the last round with the smallest mean, ties to the smaller candidate."""
        last = self.ledger.agg(F.max("round").alias("round"))
        return self.ledger.join(F.broadcast(last), "round").orderBy("mean", "candidate").limit(1).select(*LEDGER)


def successive_halving(candidates: DataFrame, measure: Callable[[DataFrame, int, int], DataFrame], bound: int, budget: int, keep: int = 2, first: int = 1, rounds: int = 64, rows: int = RANGE) -> Search:
    """Rounds of trials, of which each keeps the best 1/``keep`` of its candidates and gives them ``keep`` times as many new trials.

    ``candidates`` has the column candidate, without nulls; repeats count once.
    ``measure(candidates, low, high)`` gives (candidate, cost, score) of the
    trials numbered from ``low`` to below ``high`` of these candidates, cost and
    score as whole numbers, a small score being good; a candidate may have fewer.  Only
    those that are still in are ever measured.

    ``bound`` is the most that a trial may cost.  A round starts only if what was spent and the
    bound of all its trials fit into ``budget``, so the budget is never passed;
    a trial above its bound raises.  Candidates rank by their mean over
    all trials so far, those without any trial last, ties to the smaller candidate.  Each
    round is written to the shared folder; the driver gets counts and sums.
    """
    require(bound >= 0 and budget >= 0 and keep >= 2 and first >= 1 and rounds >= 1, "bound and budget aren't negative, keep is at least 2, first and rounds at least 1")
    known = candidates.where("candidate is not null").select("candidate").distinct()
    alive = SharedTable(known.select("candidate", F.lit(0).cast("long").alias("trials"), F.lit(0).cast("long").alias("total")), "search").df
    n, low, size, spent, reserved, ledger, stopped = alive.count(), 0, first, 0, 0, [], "rounds"
    for number in range(rounds):
        if n == 0 or (n == 1 and number > 0):
            stopped = "one left" if n else "no candidates"
            break
        if spent + n * size * bound > budget:
            stopped = "budget"
            break
        reserved = max(reserved, spent + n * size * bound)
        found = measure(alive.select("candidate"), low, low + size).groupBy("candidate").agg(
            F.count("*").alias("_n"), F.sum("score").alias("_score"), F.sum("cost").alias("_cost"), F.max("cost").alias("_most"), F.min("cost").alias("_least")
        )
        joined = SharedTable(alive.join(found, "candidate", "left").select(
            "candidate", (F.col("trials") + F.coalesce("_n", F.lit(0))).alias("trials"), (F.col("total") + F.coalesce("_score", F.lit(0))).alias("total"),
            F.coalesce("_cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("_n", F.lit(0)).alias("new"), "_most", "_least",
        ), "search").df
        cost, new, widest, most, least = joined.agg(F.sum("cost"), F.sum("new"), F.max("new"), F.max("_most"), F.min("_least")).first()
        if new == 0:
            stopped = "no more trials"
            break
        if widest > size or most is None or least is None or most > bound or least < 0:
            raise ContractError(f"a round of {size} trials of at most {bound} each: a candidate had {widest}, costs were {least} to {most}")
        spent += cost
        mean = F.when(F.col("trials") > 0, F.col("total").cast("double") / F.col("trials"))
        placed = with_ordinal(joined.withColumn("mean", mean).withColumn("none", F.col("trials") == 0), ["none", "mean", "candidate"], "place", rows)
        n = -(-n // keep)
        done = SharedTable(placed.select(F.lit(number).alias("round"), "candidate", "trials", "cost", "mean", (F.col("place") < n).alias("kept"), "total"), "search").df
        ledger.append(done.select(*LEDGER))
        alive = done.where("kept").select("candidate", "trials", "total")
        low, size = low + size, size * keep
    empty = alive.limit(0).select(F.lit(0).alias("round"), "candidate", "trials", F.lit(0).cast("long").alias("cost"), F.lit(0.0).alias("mean"), F.lit(True).alias("kept"))
    return Search(reduce(DataFrame.unionByName, ledger) if ledger else empty, spent, reserved, stopped)
