"""Greedy selection in rank order without near duplicates and with a cap per source."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.hashing import hamming
from sieveworks.operators.skew import lookup, salted_join
from sieveworks.session import cut


def _classes(rows: DataFrame, id_col: str, sketch: str) -> tuple[DataFrame, DataFrame]:
    """Cuts of (id, s) and of the distinct sketches (s, first, n)."""
    held = cut(rows.select(F.col(id_col).alias("id"), F.col(sketch).alias("s")))
    return held, cut(held.groupBy("s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))


def _near_classes(distinct: DataFrame, most: int, pieces: int) -> DataFrame:
    """Pairs of distinct sketches that differ in at most ``most`` bits, once for each key they share: (s, first, n) of both, ending in _a and _b.

    64 bits are cut into ``pieces``; two such sketches agree in all but ``most``
    of them, so one of the keys made of ``pieces - most`` pieces each is equal,
    and an equality join on keys finds all pairs. With six pieces and three bits
    a key has about 32 bits and sketches meet by chance once in four thousand
    million, where whole quarters of 16 bits would meet once in 65,536. A key that
    many sketches share is spread over tasks.
    """
    bounds = [round(i * 64 / pieces) for i in range(pieces + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(bounds)]
    chosen = [sum(m) for m in itertools.combinations(masks, pieces - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("s").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])).alias("k")
    keyed = distinct.select("s", "first", "n", keys).select(F.xxhash64("k.t", "k.v").alias("k"), "s", "first", "n")
    counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a, b = (keyed.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("s", "first", "n")]) for x in "ab")
    met = salted_join(a, b, "k", counts, "s_a")
    return met.where((F.col("s_a") < F.col("s_b")) & (hamming(F.col("s_a"), F.col("s_b")) <= most)).drop("k")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def hamming_pairs(rows: DataFrame, id_col: str, sketch: str, most: int = 3, pieces: int = 6) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of sketches that differ in at most ``most`` bits, in short form.

    Equal sketches are put together first and linked to their least id, so copies
    are no pairs of pairs; ``all_hamming_pairs`` has every pair.
    """
    held, distinct = _classes(rows, id_col, sketch)
    near = _near_classes(distinct, most, pieces).select(*_ordered("first_a", "first_b")).where("id_a < id_b")
    copies = lookup(held, distinct, "s", "n").where("first < id").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    return near.distinct().unionByName(copies)


def all_hamming_pairs(rows: DataFrame, id_col: str, sketch: str, most: int = 3, pieces: int = 6) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all rows whose sketches differ in at most ``most`` bits, copies with each other and with all that is near.

    Distinct sketches are compared once and their pairs are spelt out by the rows
    that have them; ids are unique. Of two sketches the one with fewer rows comes
    first: a sketch has at most 43,744 others within three bits, so only one with
    1,000 rows or more can make a key hot, and those rows are spread over tasks.
    The result grows with the square of the copies.
    """
    held, distinct = _classes(rows, id_col, sketch)
    near = cut(_near_classes(distinct, most, pieces).distinct())
    swap = F.col("n_a") > F.col("n_b")
    few, many = (F.struct(*[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(c) for c in ("s", "first", "n")]) for x, y in ("ab", "ba"))
    links = near.select(few.alias("few"), many.alias("many"))
    singles = links.where("many.n = 1").select(*_ordered("few.first", "many.first"))
    # partners: rows to be paired with every row of the sketch s
    of_one = links.where("few.n = 1 and many.n > 1").select(F.col("many.s").alias("s"), F.col("few.first").alias("partner"), F.lit(False).alias("own"))
    to_many = links.where("few.n > 1").select(F.col("few.s").alias("s"), F.col("many.s").alias("to"))
    of_more = salted_join(held, to_many, "s", distinct, "id").select(F.col("to").alias("s"), F.col("id").alias("partner"), F.lit(False).alias("own"))
    of_same = held.select("s", F.col("id").alias("partner"), F.lit(True).alias("own"))
    met = salted_join(held, of_one.unionByName(of_more).unionByName(of_same), "s", distinct, "id")
    return met.where("not own or partner < id").select(*_ordered("partner", "id")).unionByName(singles).where("id_a < id_b")


def greedy_select(rows: DataFrame, id_col: str, rank: str, source: str, sketch: str, size: int, source_share: float = 0.65, most_bits: int = 3, batch: int = 20_000) -> DataFrame:
    """Rows taken in rank order: one is passed over if its source has its cap, or if a taken row is near it; ``size`` in all.

    The order makes each decision depend on earlier ones, so decisions are made
    in one scan in rank order. It holds no texts: a row is its rank, source and
    sketch. Rows come ``batch`` at a time, the next ones in order, and those of a
    source that has its cap are left out where they are read, so a source with a
    third of all rows does not pass the driver. Near sketches are looked up in
    tables of the taken ones, not by comparing with each of them.
    """
    cap = max(int(size * source_share), 1)
    bands = most_bits + 1
    width = 64 // bands
    masks = [((1 << width) - 1) << (i * width) if i < bands - 1 else (1 << 64) - (1 << (i * width)) for i in range(bands)]
    tables: list[dict[int, list[int]]] = [{} for _ in masks]
    counts: dict[str, int] = {}
    taken: list = []
    held = cut(rows.select(F.col(id_col).alias("id"), F.col(rank).alias("rank"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("source"), F.col(sketch).alias("s"))).where("rank is not null and s is not null")
    last = None
    while len(taken) < size:
        capped = [name for name, n in counts.items() if n >= cap]
        rest = held.where(~F.col("source").isin(*capped)) if capped else held
        if last is not None:
            rest = rest.where((F.col("rank") > F.lit(last[0])) | ((F.col("rank") == F.lit(last[0])) & (F.col("id") > F.lit(last[1]))))
        block = rest.orderBy("rank", "id").limit(batch).collect()
        for row in block:
            s = row["s"] & (1 << 64) - 1
            if len(taken) >= size or counts.get(row["source"], 0) >= cap:
                continue
            if any(bin(s ^ t).count("1") <= most_bits for table, m in zip(tables, masks) for t in table.get(s & m, ())):
                continue
            for table, m in zip(tables, masks):
                table.setdefault(s & m, []).append(s)
            counts[row["source"]] = counts.get(row["source"], 0) + 1
            taken.append((row["id"], len(taken) + 1))
        if len(block) < batch:
            break
        last = (block[-1]["rank"], block[-1]["id"])
    kind = dict(rows.dtypes)[id_col]
    return rows.sparkSession.createDataFrame(taken, f"{id_col} {kind}, position int")
