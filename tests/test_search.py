import random

import pytest
from pyspark.sql import functions as F

from sparkloom.contracts import ContractError
from sparkloom.operators.search import successive_halving


def table(spark, rows):
    trials = spark.createDataFrame(rows, "candidate long, trial long, cost long, score long")
    asked = []

    def measure(alive, low, high):
        asked.append((alive.count(), low, high))
        return trials.where((F.col("trial") >= low) & (F.col("trial") < high)).join(alive, "candidate", "left_semi").select("candidate", "cost", "score")

    return trials.select("candidate"), measure, asked


def by_hand(rows, bound, budget, keep):
    alive, totals, spent, low, size, ledger, number = sorted({r[0] for r in rows}), {}, 0, 0, 1, [], 0
    while alive and (len(alive) > 1 or number == 0) and spent + len(alive) * size * bound <= budget:
        new = [r for r in rows if r[0] in alive and low <= r[1] < low + size]
        if not new:
            break
        cost = dict.fromkeys(alive, 0)
        for c, _, own, score in new:
            n, total = totals.get(c, (0, 0))
            totals[c], cost[c] = (n + 1, total + score), cost[c] + own
        spent += sum(cost.values())
        mean = {c: totals[c][1] / totals[c][0] if c in totals else None for c in alive}
        ranked = sorted(alive, key=lambda c: (mean[c] is None, mean[c] or 0, c))
        kept = ranked[: -(-len(ranked) // keep)]
        ledger += [(number, c, totals.get(c, (0, 0))[0], cost[c], mean[c], c in kept) for c in alive]
        alive, low, size, number = sorted(kept), low + size, size * keep, number + 1
    return ledger, spent


@pytest.mark.parametrize(("keep", "budget"), [(2, 10**6), (2, 260), (3, 10**6), (2, 0)])
def test_rounds_as_by_hand(spark, keep, budget):
    """Ties, candidates with few trials or none in a round, and budgets that end the search early."""
    draw = random.Random(3)
    rows = [(c, t, draw.randint(0, 5), draw.randint(-3, 3)) for c in range(23) for t in range(40 if c % 4 else 2)]
    candidates, measure, asked = table(spark, rows)
    found = successive_halving(candidates, measure, 5, budget, keep, rows=7)
    ledger, spent = by_hand(rows, 5, budget, keep)
    assert sorted(map(tuple, found.ledger.collect())) == sorted(ledger)
    assert found.spent == spent <= found.reserved <= budget if ledger else found.spent == 0
    assert found.stopped == ("budget" if budget < 10**6 else "one left")
    # Candidates that are out are never measured again.
    assert [n for n, _, _ in asked] == [sum(r[0] == k for r in ledger) for k in range(len(asked))]
    if ledger and budget == 10**6:
        last = max(r[0] for r in ledger)
        assert found.best().first()["candidate"] == min((r[4], r[1]) for r in ledger if r[0] == last)[1]


def test_what_ends_a_search(spark):
    candidates, measure, _ = table(spark, [(1, 0, 1, 1), (2, 0, 1, 1), (3, 0, 9, 1)])
    with pytest.raises(ContractError):
        successive_halving(candidates, measure, 5, 1000)
    candidates, measure, _ = table(spark, [(c, 0, 1, c) for c in range(4)])
    found = successive_halving(candidates, measure, 5, 1000)
    assert found.stopped == "no more trials" and found.spent == 4
    assert [r["candidate"] for r in found.ledger.where("kept").orderBy("candidate").collect()] == [0, 1]
    assert successive_halving(candidates.limit(0), measure, 5, 1000).stopped == "no candidates"
    assert successive_halving(candidates.limit(0), measure, 5, 1000).best().count() == 0
    with pytest.raises(ContractError):
        successive_halving(candidates, measure, 5, 1000, keep=1)
