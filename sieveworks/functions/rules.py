"""Declarative rules compiled to single columns, so that a whole cascade is one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds, in the given order; a null condition doesn't hold."""
    out = F.lit(otherwise).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def all_hits(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules]))


def weighted(rules: Sequence[tuple[float, Column]]) -> Column:
    """Sum of the weights of the rules that hold."""
    out = F.lit(0.0)
    for weight, holds in rules:
        out = out + F.when(F.coalesce(holds, F.lit(False)), F.lit(float(weight))).otherwise(F.lit(0.0))
    return out


def stepwise(steps: Sequence[tuple[Column, float]], otherwise: float = 0.0) -> Column:
    """Value of the first step whose condition holds."""
    out = F.lit(float(otherwise))
    for holds, value in reversed(steps):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(float(value))).otherwise(out)
    return out


def looked_up(key: Column, table: Mapping[str, float], otherwise: float) -> Column:
    """Value of a small literal table."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(float(otherwise)))


def staged(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``columns`` computed once.

    Projections on top of each other are merged by the optimizer, which repeats
    an expression wherever its column is used; with higher-order functions that
    multiplies the work. A generator of one row ends the merging.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def decision(reason: Column, detail: Column, rules: Column) -> Column:
    """struct(reason, detail, hit_rules) of a row that was decided on; rule ids once each, in order."""
    return F.struct(reason.alias("reason"), F.when(reason.isNotNull(), detail).alias("detail"), F.array_sort(F.array_distinct(F.coalesce(rules, F.array().cast("array<string>")))).alias("hit_rules"))
