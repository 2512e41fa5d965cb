"""Semi and anti joins: overlap, leakage, exclusion, resume, latest record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys_of(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("k")).where("k is not null").distinct()


def overlap_counts(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """One row: left_rows, left_keys, shared_rows (left rows whose key is in right), shared_keys, right_keys, left_only_keys, right_only_keys."""
    counted = lambda d, name: d.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias(name))
    joined = counted(left, "nl").join(counted(right, "nr"), "k", "full")
    both = F.col("nl").isNotNull() & F.col("nr").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.agg(
        total(F.col("nl")).alias("left_rows"), F.count("nl").alias("left_keys"), total(F.when(both, F.col("nl"))).alias("shared_rows"), F.count_if(both).alias("shared_keys"),
        F.count("nr").alias("right_keys"), F.count_if(F.col("nr").isNull()).alias("left_only_keys"), F.count_if(F.col("nl").isNull()).alias("right_only_keys"),
    )


def blocked(rows: DataFrame, key: Column, lists: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """``rows`` with blocked_by: the first list, in the given order, that has the row's key; null if none has.

    Lists are reduced to distinct keys; Spark broadcasts one if it is small
    when it comes to the join, and shuffles it otherwise.
    """
    out = rows.withColumn("__key", key)
    names = []
    for i, (name, held, held_key) in enumerate(lists):
        marks = held.select(held_key.alias("__key")).where("__key is not null").distinct().withColumn(f"__in{i}", F.lit(True))
        out = out.join(marks, "__key", "left")
        names.append(F.when(F.col(f"__in{i}"), F.lit(name)))
    return out.withColumn("blocked_by", F.coalesce(F.lit(None).cast("string"), *names)).drop("__key", *[f"__in{i}" for i in range(len(lists))])


def excluded(rows: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not held; a null key is never held."""
    return rows.join(held.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def pending(rows: DataFrame, log: DataFrame, on: str, status: str, terminal: tuple[str, ...] | None = None) -> DataFrame:
    """Rows still to do: no record in the log, or none with a terminal status."""
    done = log if terminal is None else log.where(F.col(status).isin(*terminal))
    return excluded(rows, done, on)


def latest(log: DataFrame, on: str, order: list[Column]) -> DataFrame:
    """Last record of each key, by ``max_by`` with map-side aggregation; a hot key is one partial row a task."""
    others = [c for c in log.columns if c != on]
    return log.groupBy(on).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r")).select(on, *[F.col("__r")[c].alias(c) for c in others])


def with_latest(rows: DataFrame, log: DataFrame, on: str, order: list[Column], status: str, ok: str, columns: dict[str, str]) -> DataFrame:
    """Inner join with the last record of each key, kept if its status is ``ok``; ``columns`` renames what is taken."""
    last = latest(log, on, order).where(F.col(status) == ok)
    return rows.join(last.select(on, *[F.col(a).alias(b) for a, b in columns.items()]), on)


def hydrated(rows: DataFrame, raw: DataFrame, on: list[str]) -> DataFrame:
    """Left join with the raw records they came from."""
    return rows.join(raw, on, "left")


def paired_contrast(a: DataFrame, b: DataFrame, on: str, right: str, extra: str, missing: str) -> DataFrame:
    """One row of counts over the items both systems answered: both right, both wrong, only one, and why only one."""
    pick = lambda d, s: d.select(on, *[F.col(c).alias(f"{c}_{s}") for c in (right, extra, missing)])
    j = pick(a, "a").join(pick(b, "b"), on)
    ra, rb = F.col(f"{right}_a"), F.col(f"{right}_b")
    return j.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(ra & rb).alias("both_right"), F.count_if(~ra & ~rb).alias("both_wrong"), F.count_if(ra & ~rb).alias("a_only"),
        F.count_if(~ra & rb).alias("b_only"), F.count_if(ra & ~rb & (F.col(f"{extra}_b") > 0)).alias("a_only_as_b_has_extra"),
        F.count_if(~ra & rb & (F.col(f"{missing}_a") > F.col(f"{missing}_b"))).alias("b_only_as_b_misses_less"),
    )
