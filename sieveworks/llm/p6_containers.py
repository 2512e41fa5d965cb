"""Filling containers of fixed capacity with texts of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.tokens import DEFAULT_VOCABULARY, token_count
from sieveworks.operators.skew import bounded, spread_rank
from sieveworks.session import cut

#: Items of one length that a single task may number.
ROWS_PER_CELL = 1_000_000


@dataclass
class Plan:
    """For each length, slots in rank order: from rank ``lo`` on, ``per`` items go to each container from ``base`` on."""

    n_containers: int
    slots: dict[int, list[tuple[int, int, int]]]  # length -> [(lo, base, per)]


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts of equal lengths.

    It places items exactly as best-fit decreasing places them one by one, but
    containers with equal room are held as ranges with a count, and a length is
    placed range by range. Its work and the plan's size depend on the number of
    lengths (at most the capacity), not on the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (base, count)
    rooms: list[int] = []
    made = 0
    slots: dict[int, list[tuple[int, int, int]]] = {}

    def put(left: int, base: int, count: int) -> None:
        if count and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((base, count))

    for length in sorted((s for s in histogram if s > 0), reverse=True):
        if length > capacity:
            raise ValueError("items over the capacity are to be cut into pieces first")
        todo, rank, mine = histogram[length], 0, []
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                base, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(i)
            else:
                left, base, count = capacity, made, -(-todo // (capacity // length))
                made += count
            per = left // length
            full, over = divmod(todo, per)
            if full >= count:
                full, over = count, 0
            if full:
                mine.append((rank, base, per))
                put(left - per * length, base, full)
            if over:
                mine.append((rank + full * per, base + full, over))
                put(left - over * length, base + full, 1)
            put(left, base + full + bool(over), count - full - bool(over))
            rank += full * per + over
            todo -= full * per + over
        slots[length] = mine
    if histogram.get(0) and not made:
        made = 1
    return Plan(made, slots)


def _place(plans: dict[int, Plan]):
    tables = {
        (spec, length): tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for spec, plan in plans.items() for length, rows in plan.slots.items()
    }

    def place(spec: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), dtype=np.int64)
        frame = pd.DataFrame({"s": spec.to_numpy(), "l": length.to_numpy(), "r": rank.to_numpy() - 1})
        for (s, n), part in frame.groupby(["s", "l"], sort=False):
            if n > 0:
                lo, base, per = tables[s, n]
                at = np.searchsorted(lo, part["r"].to_numpy(), side="right") - 1
                out[part.index] = base[at] + (part["r"].to_numpy() - lo[at]) // per[at]
        return pd.Series(out)

    place.__annotations__ = {"spec": pd.Series, "length": pd.Series, "rank": pd.Series, "return": pd.Series}
    return F.pandas_udf(place, T.LongType())


#: Container sizes, each of which has a histogram on the driver; more are refused.
MOST_SPECS = 1000


def pieces(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, doc_id, piece, tokens): one row per text, or per piece of a text larger than the capacity."""
    held = {r["spec_id"]: r["capacity_tokens"] for r in specs.collect() if r["spec_id"] is not None and (r["capacity_tokens"] or 0) > 0}
    if not held:
        return sizes.select(F.lit(0).alias("spec_id"), "doc_id", F.lit(0).alias("piece"), "tokens").limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("id"), F.lit(c).cast("long").alias("cap")) for s, c in sorted(held.items())]))
    wide = sizes.select("doc_id", F.col("tokens").alias("__all"), each.alias("__spec")).select("doc_id", "__all", F.col("__spec.id").alias("spec_id"), F.col("__spec.cap").alias("__cap"))
    n = F.greatest(F.ceil(F.col("__all") / F.col("__cap")), F.lit(1)).cast("int")
    cut_up = wide.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    tokens = F.least(F.col("__all") - F.col("piece") * F.col("__cap"), F.col("__cap"))
    return cut_up.select("spec_id", "doc_id", "piece", tokens.alias("tokens"))


def fill(documents: DataFrame, specs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, dict[int, Plan]]:
    """(spec_id, doc_id, piece, tokens, container_id) and the plans, for each capacity in ``specs``.

    The histogram of lengths, at most capacity + 1 numbers for each container
    size, is all that reaches the driver. It is planned by ``best_fit``; each
    item then takes the slot of its rank within its length. Ranks come from
    counts per (length, salt), so a length that a third of all texts have is
    numbered by many tasks.

    A null or empty text has no tokens and goes to container 0. Texts of equal
    id are different items. A text larger than the capacity is cut into full
    pieces and a rest. An empty table fills no container.
    """
    specs = bounded(specs, MOST_SPECS, "container sizes")
    sizes = cut(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens")))
    items = pieces(sizes, specs)
    counted = items.groupBy("spec_id", "tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    capacity = {r["spec_id"]: r["capacity_tokens"] for r in specs.collect()}
    histograms: dict[int, dict[int, int]] = {}
    for r in counted:
        histograms.setdefault(r["spec_id"], {})[r["tokens"]] = r["n"]
    plans = {spec: best_fit(h, capacity[spec]) for spec, h in histograms.items()}
    salts = max(8, max((r["n"] for r in counted), default=0) // ROWS_PER_CELL + 1)
    ranked = spread_rank(items, ["spec_id", "tokens"], [], ["doc_id", "piece"], "rank", salts)
    placed = ranked.withColumn("container_id", _place(plans)("spec_id", "tokens", "rank"))
    return placed.select("spec_id", "doc_id", "piece", "tokens", "container_id"), plans


def fill_report(documents: DataFrame, specs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(spec_id, capacity_tokens, n_items, n_containers, n_tokens, least_possible, fill): how full the containers are."""
    specs = bounded(specs, MOST_SPECS, "container sizes")
    placed, _ = fill(documents, specs, vocabulary)
    sums = placed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("spec_id").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    joined = per.join(F.broadcast(specs), "spec_id")
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    share = F.bround(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)
    return joined.select("spec_id", "capacity_tokens", "n_items", "n_containers", "n_tokens", "fullest", least.alias("least_possible"), share.alias("fill"))
