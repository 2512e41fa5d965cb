"""Ranks, limits and samples in an order that every run and engine repeats.

Random order is the order of a seeded digest of the id. Per-group ranks use
``row_number`` with a limit that Spark pushes into the window (only the best
rows of a group are kept before the shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions.hashing import unit_hash
from sieveworks.session import cut


def top_k(rows: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows with their rank. The limit comes before the rank, so the window sees k rows."""
    return rows.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def ranked(rows: DataFrame, order: Sequence[Column], id_col: str, score: str, rank: str = "rank", ranges: int = 64) -> DataFrame:
    """Rank of all rows by range partitioning: each range is ranked by itself and shifted by the rows before it.

    A plain window without partitions would bring all rows into one task.
    """
    # range partitioning reads its input twice, for bounds and for rows
    parts = cut(cut(rows).repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, starts = 0, {}
    for part in sorted(sizes):
        starts[part] = start
        start += sizes[part]
    if not starts:
        return rows.withColumn(rank, F.lit(0).cast("long")).limit(0)
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("__part"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn(rank, (shift + within).cast("long")).drop("__part")


def sliced(rows: DataFrame, order: Sequence[Column], keep: Column | None = None, top: int | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filter, then the first ``top``, then ``offset``, then ``limit``, in this order."""
    out = rows if keep is None else rows.where(keep)
    out = out.orderBy(*order)
    if top:
        out = out.limit(top).orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def hash_sample(rows: DataFrame, key: str, size: int, seed: str, forced: Column | None = None) -> DataFrame:
    """``size`` rows: forced ones first, then those with the least hashes."""
    first = F.when(forced, 0).otherwise(1) if forced is not None else F.lit(0)
    u = unit_hash(seed, F.col(key))
    return rows.withColumns({"__f": F.coalesce(first, F.lit(1)), "__u": u}).orderBy("__f", "__u", key).limit(size).drop("__f", "__u")


def shuffled(rows: DataFrame, key: str, seed: str) -> DataFrame:
    return rows.orderBy(unit_hash(seed, F.col(key)), key)


def first_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def quota_sample(rows: DataFrame, bucket: str, key: str, quotas: Mapping[str, int], most: int, seed: str) -> DataFrame:
    """At most its quota from each bucket, and ``most`` in all, buckets filled in the order of the plan.

    Rows of buckets without a quota are left out. The cap over all is a running
    sum over the plan, whose buckets are few, not over rows.
    """
    names = list(quotas)
    listed = cut(rows.where(F.col(bucket).isin(*names)))
    have = {r[bucket]: r["n"] for r in listed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, allowed = most, {}
    for name in names:
        allowed[name] = min(quotas[name], have.get(name, 0), left)
        left -= allowed[name]
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv]), F.col(bucket))
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(unit_hash(seed, F.col(key)), key))
    return listed.withColumn("rn", rn).where((F.col("rn") <= max(allowed.values(), default=0)) & (F.col("rn") <= limit))


def stratified(rows: DataFrame, stratum: str, key: str, size: int, shares: Mapping[str, float], seed: str) -> DataFrame:
    """Strata in the given shares of ``size``; the last one takes the remainder. Each gives at most what it has."""
    names = list(shares)
    rows = cut(rows.where(F.col(stratum).isin(*names)))
    have = {r[stratum]: r["n"] for r in rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken: dict[str, int] = {}
    for name in names[:-1]:
        taken[name] = min(int(size * shares[name] + 1e-9), have.get(name, 0))
    taken[names[-1]] = min(size - sum(taken.values()), have.get(names[-1], 0))
    return quota_sample(rows, stratum, key, taken, size, seed)


def round_robin(rows: DataFrame, route: str, routes: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """One row of each route in turn until ``limit``; position tells the turn."""
    place = F.array_position(F.array(*map(F.lit, routes)), F.col(route))
    turns = rows.where(F.col(route).isin(*routes)).withColumn("rn", F.row_number().over(Window.partitionBy(route).orderBy(*order))).where(F.col("rn") <= limit)
    return top_k(turns.withColumn("__place", place), [F.col("rn"), F.col("__place")], limit, "position").drop("__place")


def split_by_share(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """``rows`` with part: train or validation, by each row's own hash, so no row moves when others come."""
    top = format(int(share * 16**8), "08x")
    return rows.withColumn("part", F.when(F.substring(unit_hash(seed, F.col(key)), 1, 8) < top, "validation").otherwise("train"))


def head_and_tail(rows: DataFrame, order: Sequence[Column], id_col: str, tail_share: float) -> DataFrame:
    """``rows`` with part: the last ``tail_share`` of them in the given order are validation, the rest train."""
    placed = ranked(rows, order, id_col, id_col, "__place")
    total = placed.agg(F.max("__place").alias("n")).first()["n"] or 0
    return placed.withColumn("part", F.when(F.col("__place") > total - int(total * tail_share), "validation").otherwise("train")).drop("__place")


def zipped(units: DataFrame, others: DataFrame, unit_order: Sequence[Column], other_order: Sequence[Column], unit_id: str, other_id: str) -> DataFrame:
    """Units and others paired by their place in their own orders; the sides must be of one length."""
    a, b = ranked(units, unit_order, unit_id, unit_id, "place"), ranked(others, other_order, other_id, other_id, "place")
    if a.count() != b.count():
        raise ValueError("the sides differ in length")
    return a.join(b, "place")


def hold_back(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in the given (reverse) order, held back for evaluation."""
    return rows.orderBy(*order).limit(n)


def positional_ids(rows: DataFrame, order: Sequence[Column], prefix: str, id_col: str, width: int = 6) -> DataFrame:
    """``prefix_000000`` ids in the given order."""
    numbered = ranked(rows, order, id_col, id_col, "__pos")
    return numbered.withColumn("sample_id", F.concat(F.lit(prefix + "_"), F.lpad((F.col("__pos") - 1).cast("string"), width, "0"))).drop("__pos")


def expanded_quotas(quotas: DataFrame, label: str, n: str) -> DataFrame:
    """One row for each unit of a quota: (label, unit)."""
    return quotas.where(F.col(n) > 0).select(label, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("unit"))


def least_frequent(rows: DataFrame, by: str) -> DataFrame:
    """The value with the fewest rows, of equals the least."""
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy("n", by).limit(1)


def random_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, seed: str) -> DataFrame:
    """Rows of the sides paired in random order, one to one, as many as the shorter side has."""
    a = ranked(left.select(F.col(left_id).alias("left_id"), unit_hash(seed + "a", F.col(left_id)).alias("u")), [F.col("u"), F.col("left_id")], "left_id", "u", "pos").drop("u")
    b = ranked(right.select(F.col(right_id).alias("right_id"), unit_hash(seed + "b", F.col(right_id)).alias("u")), [F.col("u"), F.col("right_id")], "right_id", "u", "pos").drop("u")
    return a.join(b, "pos")
