"""Fail-closed checks that run before a plan is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input that an operator must not accept."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ContractError(message)


def require_rows(df: DataFrame, **rules: Column) -> DataFrame:
    """``df``, after one aggregate has found no row that breaks a rule; a rule that is null counts as broken."""
    row = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    broken = {name: n for name, n in row.asDict().items() if n}
    require(not broken, f"rows that break rules: {broken}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    require(not twice, f"{', '.join(keys)} must be unique")
    return df
