"""Sources mixed to target shares of the total size."""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.tokens import DEFAULT_VOCABULARY, token_count
from sieveworks.operators.skew import bounded, spread_rank
from sieveworks.session import cut

SEED = "p7"
#: Size classes to a doubling of the size, by which texts are ordered within a source.
BINS = 16
#: Lines of all mixes together, which are broadcast; more are refused.
MOST_LINES = 100_000


@dataclass(frozen=True)
class Line:
    """One source of a mix: expected copies of each of its texts and the random offset of its sample."""

    mix_id: int
    source: str
    target_share: float
    max_repeats: int
    available: int
    copies: float
    offset: float
    feasible: float


def _offset(mix_id: int, source: str) -> float:
    return int(hashlib.sha256(f"{SEED}:{mix_id}:{source}".encode()).hexdigest()[:13], 16) / 16**13


def expected_copies(wanted: dict[str, tuple[float, int]], available: dict[str, int], total: float) -> dict[str, float]:
    """Copies of each text by source, so that the sizes follow the shares and sum to ``total`` as far as caps allow.

    A source that would need more than its cap gives its cap; what it lacks is
    spread over the others in proportion to their shares, which keeps the
    others' sizes in the wanted proportion to each other.
    """
    open_sources = {s for s, (share, _) in wanted.items() if share > 0 and available.get(s)}
    copies = {s: 0.0 for s in wanted}
    rest = total
    while open_sources:
        shares = sum(wanted[s][0] for s in open_sources)
        need = {s: rest * wanted[s][0] / shares / available[s] for s in open_sources}
        over = {s for s in open_sources if need[s] >= wanted[s][1]}
        if not over:
            return copies | need
        for s in over:
            copies[s] = float(wanted[s][1])
            rest -= copies[s] * available[s]
        rest = max(rest, 0.0)
        open_sources -= over
    return copies


def feasible_total(wanted: dict[str, tuple[float, int]], available: dict[str, int]) -> float:
    """The largest total at which every source that is there can give its share (the shares of absent ones spread over the others)."""
    there = {s: (share, cap) for s, (share, cap) in wanted.items() if share > 0 and available.get(s)}
    shares = sum(share for share, _ in there.values())
    return min((available[s] * cap * shares / share for s, (share, cap) in there.items()), default=0.0)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[Line]:
    """The lines of every mix. Sizes are summed by source first; only sources that a mix names reach the driver.

    ``total_tokens`` is the size of each mix; by default as many tokens as its
    sources have, each counted once. At more than ``feasible_total`` some source
    must repeat beyond its cap and is left at it.
    """
    targets = bounded(targets, MOST_LINES, "lines of mixes")
    named = targets.select("source").distinct()
    sums = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(named), "source", "left_semi").collect()
    available = {r["source"]: r["tokens"] for r in sums}
    mixes: dict[int, dict[str, tuple[float, int]]] = {}
    for r in targets.orderBy("mix_id", "source").collect():
        if r["source"] is not None:
            mixes.setdefault(r["mix_id"], {})[r["source"]] = (r["target_share"] or 0.0, r["max_repeats"] or 0)
    lines = []
    for mix_id, wanted in mixes.items():
        total = total_tokens if total_tokens is not None else sum(available.get(s, 0) for s in wanted)
        copies = expected_copies(wanted, available, total)
        lines += [Line(mix_id, s, share, cap, available.get(s, 0), copies[s], _offset(mix_id, s), feasible_total(wanted, available)) for s, (share, cap) in wanted.items()]
    return lines


_LINE = "mix_id int, source string, target_share double, max_repeats int, available long, copies double, offset double, feasible double"


def _measured(documents: DataFrame, vocabulary: str) -> DataFrame:
    return cut(documents.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")))


def _uses(sizes: DataFrame, lines: list[Line]) -> DataFrame:
    spark = sizes.sparkSession
    table = spark.createDataFrame([astuple(x) for x in lines], _LINE)
    named = sizes.where("tokens > 0 and source is not null").withColumn("size_class", F.floor(F.log2("tokens") * BINS).cast("int"))
    ranked = spread_rank(named, ["source"], ["size_class"], ["doc_id"], "rank")
    joined = ranked.join(F.broadcast(table.where("copies > 0").select("mix_id", "source", "copies", "offset", "max_repeats")), "source")
    at = lambda rank: F.floor(F.col("offset") + F.col("copies") * rank)
    crossed = at(F.col("rank")) - at(F.col("rank") - 1)
    return joined.withColumn("uses", F.least(crossed, F.col("max_repeats").cast("long"))).where("uses > 0").select("mix_id", "doc_id", "source", "tokens", "uses")


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(mix_id, doc_id, source, tokens, uses): how often each text is used in each mix, texts not used left out.

    Systematic sampling: texts are ordered within their source, by size class
    and then at random; each adds its expected copies to a prefix sum, which
    starts at one random offset, and is used once for every whole number the
    sum crosses. So each is used its expected copies rounded down or up, never
    more than ``max_repeats``, and large and small texts are used alike, which
    keeps a source's tokens near its target. Prefix sums come from counts by
    (source, size class, salt): a source with a third of all texts is spread.

    Texts without tokens or source are not used. A source that is absent, or
    has a share of zero, gives nothing; repeated rows are texts of their own; an
    empty table gives no uses.
    """
    sizes = _measured(documents, vocabulary)
    return _uses(sizes, plan(sizes, targets, total_tokens))


def actual_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(mix_id, source, target_share, actual_share, available_tokens, used_tokens, texts_used, most_uses, capped, feasible_tokens), absent sources included.

    ``feasible_tokens`` is the largest size of the mix at which no cap binds, so
    that all shares of the sources that are there can be met; give it as
    ``total_tokens`` for a mix that meets them.
    """
    sizes = _measured(documents, vocabulary)
    lines = plan(sizes, targets, total_tokens)
    used = _uses(sizes, lines).groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("texts_used"), F.max("uses").alias("most_uses")
    )
    table = sizes.sparkSession.createDataFrame([astuple(x) for x in lines], _LINE)
    joined = table.join(used, ["mix_id", "source"], "left").fillna(0, ["used_tokens", "texts_used", "most_uses"])
    whole = joined.groupBy("mix_id").agg(F.sum("used_tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.bround(F.col("used_tokens") / F.col("all_tokens"), 6))
    return joined.join(F.broadcast(whole), "mix_id").select(
        "mix_id", "source", "target_share", share.alias("actual_share"), F.col("available").alias("available_tokens"), "used_tokens", "texts_used", "most_uses",
        ((F.col("copies") >= F.col("max_repeats")) | (F.col("available") == 0)).alias("capped"),
        F.floor("feasible").cast("long").alias("feasible_tokens"),
    )
