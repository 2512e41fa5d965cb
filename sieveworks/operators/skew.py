"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heaviest keys that a lookup broadcasts; any other key has under 1/256 of the rows.
HOT_KEYS = 256


def digest(text: Column) -> Column:
    """16-byte key of a text; stands for the text in joins, so that long texts are not shuffled."""
    return F.unhex(F.md5(text))


def bounded(table: DataFrame, most: int, what: str) -> DataFrame:
    """``table`` as rows held by the driver, for tables that are small by their meaning; more than ``most`` rows are refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return table.sparkSession.createDataFrame(rows, table.schema)


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each ``key``.

    ``weight`` in ``table`` is the number of ``rows`` with the key. The
    ``hot_keys`` heaviest keys go by broadcast (a bounded number of short rows:
    give digests, not texts), all others by a shuffled join in which no key
    holds more than ``1 / hot_keys`` of the rows. Null keys match nothing.
    ``table`` is read twice and should be a cut.
    """
    hot = table.orderBy(F.desc(weight), key).limit(hot_keys)
    named = F.broadcast(hot.select(F.col(key).alias("__hot"), F.struct(*[c for c in table.columns if c != key]).alias("__row")))
    tagged = rows.join(named, rows[key] == F.col("__hot"), "left")
    rest = [c for c in table.columns if c != key]
    by_hot = tagged.where(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col("__row")[c].alias(c) for c in rest])
    cold = tagged.where(F.col("__hot").isNull()).select(*rows.columns)
    return by_hot.unionByName(cold.join(table, key).select(*rows.columns, *rest))


def salted_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, spread: str, salts: int = 64, least: int = 1000, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` and ``table`` on ``key``, both of which may have a key many times.

    ``counts`` has (key, n), the rows of each key in ``rows``; a cut or cheap.
    The ``hot_keys`` heaviest keys with ``least`` rows or more are spread over
    ``salts`` tasks by the column ``spread`` of ``rows``, and ``table`` has its
    rows of those keys once for each task; any other key has under ``1 /
    hot_keys`` of the rows. Null keys match nothing. Broadcast are the hot keys
    only: the two sides are merged whatever size Spark expects of them, which
    leaves out the rows that an ``explode`` makes.
    """
    hot = counts.where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(hot_keys).select(F.col(key).alias("__hot"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")))
    copies = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = table.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(copies))
    return left.drop("__hot").hint("merge").join(right.drop("__hot"), [key, "__salt"]).drop("__salt")


def spread_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], tie: Sequence[str], out: str = "rank", salts: int = 64
) -> DataFrame:
    """Rank from 1 within ``group``, in the order of ``order``; ``tie`` spreads and orders equal rows.

    A window over ``group`` would bring a hot group into one task. Here each
    (group, order value, salt) is counted with map-side aggregation, prefix sums
    run over those counts, and rows are numbered only within their own cell.
    Repeated rows get different ranks. ``df`` is read twice: give a cut or a
    cheap scan. ``order`` should have few distinct values in a group (bins).
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*tie), F.lit(salts)).cast("int"))
    cell = [*group, *order, "__salt"]
    counts = salted.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group).orderBy(*order, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cell)], F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*cell).orderBy(*tie)
    numbered = salted.withColumn("__rn", F.row_number().over(within))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(cell)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return numbered.join(starts, cond).select(*df.columns, (F.col("__start") + F.col("__rn")).alias(out))
