"""Samples whose categories have wanted shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.operators.skew import bounded
from sieveworks.session import cut

#: Added to every acceptance probability, so that too few accepted rows are rare.
OVERSAMPLING = 0.05
#: Standard deviations of the accepted count by which a probability is raised besides.
MARGIN_SD = 4.0
SEED = "p1"


@dataclass
class Drawn:
    """``lines``: one row per plan line with its counts; ``rows``: the uncut draw (plan_id, line_id, reward_id, u)."""

    lines: DataFrame
    rows: DataFrame


#: Rows of the label table and of the plans, which are broadcast; more are refused.
MOST_LABELS, MOST_LINES = 10_000, 10_000


def category_of(rewards: DataFrame, alias: DataFrame, difficulties: tuple[str, ...] = ("direct", "brief", "cot"), other: str = "brief") -> DataFrame:
    """(reward_id, question_type, difficulty), one row per reward_id that has a category.

    Labels are matched after trimming and ignoring letter case; a row with an
    unknown or null type is left out, a difficulty outside ``difficulties``
    (null included) counts as ``other``. Rows delivered again are one row: the
    first delivery by ``logged_at`` counts, and of equals the least labels.
    """
    clean = lambda c: F.lower(F.trim(F.col(c)))
    known = F.broadcast(alias.select(clean("label_variant").alias("__label"), F.col("question_type").alias("__type")).where("__label is not null").dropDuplicates(["__label"]))
    rows = rewards.select("reward_id", clean("question_type").alias("__label"), clean("difficulty").alias("d"), "logged_at").join(known, "__label")
    difficulty = F.when(F.col("d").isin(*difficulties), F.col("d")).otherwise(other)
    return (
        rows.where("reward_id is not null")
        .groupBy("reward_id")
        .agg(F.min(F.struct(F.col("logged_at").isNull(), "logged_at", F.col("__type").alias("t"), difficulty.alias("d"))).alias("first"))
        .select("reward_id", F.col("first.t").alias("question_type"), F.col("first.d").alias("difficulty"))
    )


def _uniform(key: Column, line: Column) -> Column:
    """64 bits of a hash as a hex string; its order is a random order that is the same in every run and engine."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(SEED), line.cast("string"), key.cast("string"))), 1, 16)


def _as_share(hex16: Column) -> Column:
    return F.conv(F.substring(hex16, 1, 12), 16, 10).cast("double") / float(16**12)


def _expanded(plan: DataFrame, alias: DataFrame, difficulties: tuple[str, ...] = ("direct", "brief", "cot")) -> DataFrame:
    """One row per plan line and category it takes; a null in the plan stands for every type or difficulty.

    The list of types comes from the alias table, which is small and fixed.
    """
    types = sorted(r[0] for r in alias.select("question_type").where("question_type is not null").distinct().collect())
    a_type = F.when(F.col("question_type").isNull(), F.array(*map(F.lit, types)).cast("array<string>")).otherwise(F.array("question_type"))
    wanted = F.lower(F.trim("difficulty"))
    a_difficulty = F.when(wanted.isNull(), F.array(*map(F.lit, difficulties))).otherwise(F.array(wanted))
    lines = plan.select("plan_id", "line_id", "target_pct", "min_rows", "sample_pct", a_type.alias("t"), a_difficulty.alias("d"))
    lines = lines.withColumn("question_type", F.explode("t")).withColumn("difficulty", F.explode("d"))
    return lines.select("plan_id", "line_id", "target_pct", "min_rows", "sample_pct", "question_type", "difficulty")


def draw(rewards: DataFrame, alias: DataFrame, plan: DataFrame) -> Drawn:
    """Draw each line of each plan and count what it asked for, what there was and what it got.

    Categories are counted (map-side) and joined with the plan, a small fixed
    table, for each line's wanted and observed rows. The acceptance probability
    of a line is their ratio, raised a little; every row is then accepted or
    not by its own hash, without a shuffle. Lines are independent draws: a row
    may be in several plans, and in two lines of one plan if both name it. A
    line of an unknown type finds no rows and is short by all it wants; an
    empty table gives every line zero rows.
    """
    alias, plan = bounded(alias, MOST_LABELS, "label variants"), bounded(plan, MOST_LINES, "plan lines")
    cats = cut(category_of(rewards, alias))
    total = cats.count()
    observed = cats.groupBy("question_type", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    lines = _expanded(plan, alias)
    size = F.floor(F.lit(total) * F.col("sample_pct") / 100)
    counted = (
        lines.join(F.broadcast(observed), ["question_type", "difficulty"], "left")
        .groupBy("plan_id", "line_id")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("available"),
            F.first(F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("long"), F.floor(size * F.col("target_pct") / 100))).alias("wanted"),
        )
    )
    ratio = F.col("wanted") / F.greatest(F.col("available"), F.lit(1))
    margin = F.lit(MARGIN_SD) * F.sqrt(F.greatest(F.col("wanted"), F.lit(1))) / F.greatest(F.col("available"), F.lit(1))
    counted = cut(counted.withColumn("accept", F.least(F.lit(1.0), ratio * (1 + OVERSAMPLING) + margin)).coalesce(1))
    named = lines.select("plan_id", "line_id", "question_type", "difficulty").join(F.broadcast(counted), ["plan_id", "line_id"])
    rows = cats.join(F.broadcast(named), ["question_type", "difficulty"]).withColumn("u", _uniform(F.col("reward_id"), F.col("line_id")))
    return Drawn(counted, rows.select("plan_id", "line_id", "reward_id", "u", "wanted", "available", "accept"))


def accepted(rows: DataFrame) -> DataFrame:
    """The rows of a draw that their own hash accepts."""
    return rows.where(_as_share(F.col("u")) <= F.col("accept"))


def deficits(rewards: DataFrame, alias: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_id, line_id, wanted, available, deficit) for each line that has fewer rows than it wants."""
    lines = draw(rewards, alias, plan).lines
    return lines.where("available < wanted").select("plan_id", "line_id", "wanted", "available", (F.col("wanted") - F.col("available")).alias("deficit"))


def sample(rewards: DataFrame, alias: DataFrame, plan: DataFrame, cells: int = 4096) -> DataFrame:
    """(plan_id, line_id, reward_id): the corrected sample, of exactly min(wanted, available) rows for each line.

    The accepted rows with the least hashes stay. Which those are is found
    from counts: hashes fall into ``cells`` cells per line, prefix sums over the
    cells show the one in which the wanted count is reached, and only the rows
    of that cell are ranked. Should a line have been accepted too thinly (the
    margin makes that a matter of one in ten thousand draws), its draw is
    completed from all its rows by the same order, so the count is always exact.
    """
    return _corrected(draw(rewards, alias, plan), cells)


def _corrected(d: Drawn, cells: int = 4096) -> DataFrame:
    drawn = cut(accepted(d.rows))
    got = drawn.groupBy("plan_id", "line_id").agg(F.count(F.lit(1)).alias("got"))
    short = d.lines.join(F.broadcast(got), ["plan_id", "line_id"], "left").where("coalesce(got, 0) < least(wanted, available)").select("plan_id", "line_id")
    if short.take(1):
        again = d.rows.join(F.broadcast(short), ["plan_id", "line_id"], "left_semi").withColumn("accept", F.lit(1.0))
        drawn = cut(drawn.join(F.broadcast(short), ["plan_id", "line_id"], "left_anti").unionByName(again))
    celled = drawn.withColumn("cell", F.floor(_as_share(F.col("u")) / F.col("accept") * cells))
    counts = celled.groupBy("plan_id", "line_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("plan_id", "line_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("plan_id", "line_id", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")
    # at most ``cells`` + 1 rows for each of a bounded number of lines; Spark checks the size before it broadcasts
    placed = celled.join(starts, ["plan_id", "line_id", "cell"])
    whole = placed.where("start + n <= wanted").select("plan_id", "line_id", "reward_id")
    rank = F.row_number().over(Window.partitionBy("plan_id", "line_id", "cell").orderBy("u", "reward_id"))
    part = placed.where("start < wanted and start + n > wanted").withColumn("rn", rank).where("start + rn <= wanted").select("plan_id", "line_id", "reward_id")
    return whole.unionByName(part)


def shares(rewards: DataFrame, alias: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_id, line_id, wanted, available, drawn, share_pct): the sample's own shares."""
    d = draw(rewards, alias, plan)
    drawn = _corrected(d).groupBy("plan_id", "line_id").agg(F.count(F.lit(1)).alias("drawn"))
    lines = d.lines.select("plan_id", "line_id", "wanted", "available")
    joined = lines.join(F.broadcast(drawn), ["plan_id", "line_id"], "left").fillna(0, ["drawn"])
    whole = F.sum("drawn").over(Window.partitionBy("plan_id"))
    return joined.withColumn("share_pct", F.when(whole > 0, F.bround(100.0 * F.col("drawn") / whole, 4)))
