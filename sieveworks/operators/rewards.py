"""Rewards of choice completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import choices, text
from sieveworks.functions.rules import staged, stepwise, weighted

# Labels and words of reasoning.
ANALYSIS_LABEL = r"(?:分析|解析|思路|理由|推理)\s*[:：]"
REASONING_WORDS = (
    "因为|因此|所以|首先|其次|再者|另外|提示|考虑|诊断|鉴别|排除|符合|不符合|机制|病因|治疗|首选|禁忌|表现|症状|体征|检查|选项|可见|可知"
)


def _capped(least: float, start: float, step: float, n: Column, over: int) -> Column:
    return -F.least(F.lit(least), F.lit(start) + F.lit(step) * (n - over))


def _with_parts(rows: DataFrame, completion: str, gold: str, valid: str | None, difficulty: str | None) -> DataFrame:
    v = F.col(valid) if valid else None
    body = F.coalesce(F.col(completion), F.lit(""))
    x = choices.extracted_v2(F.col(completion), v)
    parts = {f"x_{f}": x[f] for f in ("pred", "valid_extract", "label_count", "extra_text")}
    out = staged(rows, {**parts, "gold_letters": choices.sorted_letters(F.col(gold), v)})
    m = choices.set_measures(F.col("x_pred"), F.col("gold_letters"))
    out = staged(
        out,
        {
            **{f"m_{f}": m[f] for f in ("precision", "recall", "f1", "extra", "missing")},
            "level": choices.difficulty_of(F.col(difficulty)) if difficulty else F.lit("brief"),
            "n_chars": F.length(body), "n_han": text.ideographs(body), "reasoning": choices.before_answer(body), "repeats": text.is_repetitive(body),
        },
    )
    return staged(
        out,
        {
            "exact": F.col("x_valid_extract") & (F.col("x_pred") == F.col("gold_letters")),
            "extra": F.when(F.col("x_valid_extract"), F.col("m_extra")).otherwise(0),
            "missing": F.when(F.col("x_valid_extract"), F.col("m_missing")).otherwise(F.length("gold_letters")),
            "han": text.ideographs(F.col("reasoning")), "labelled": F.col("reasoning").rlike(ANALYSIS_LABEL),
            "marks": F.regexp_count("reasoning", F.lit(REASONING_WORDS)),
        },
    )


def reasoning_reward() -> Column:
    """What the reasoning before the answer earns at its level: length, a label, marking words; repetition costs."""
    n, marks, label = F.col("han"), F.col("marks"), F.col("labelled")
    zero = F.lit(0.0)
    direct = (
        F.when(n == 0, F.lit(0.25)).when(n <= 16, F.lit(0.10)).otherwise(_capped(0.60, 0.12, 0.01, n, 16)) + F.when(label, F.lit(-0.20)).otherwise(zero)
        + F.when(marks >= 2, F.lit(-0.15)).otherwise(zero)
    )
    brief = (
        F.when(n.between(8, 80), F.lit(0.35)).when(n == 0, F.lit(-0.20)).when(n > 120, _capped(0.50, 0.10, 0.004, n, 120)).otherwise(zero)
        + F.when(label, F.lit(0.15)).otherwise(zero) + F.when(marks >= 1, F.lit(0.15)).otherwise(zero)
    )
    cot = (
        F.when(n.between(40, 260), F.lit(0.45)).when(n < 20, F.lit(-0.45)).when(n > 360, _capped(0.70, 0.15, 0.002, n, 360)).otherwise(zero)
        + F.when(label, F.lit(0.25)).otherwise(F.lit(-0.10)) + F.least(F.lit(0.30), F.lit(0.10) * marks)
    )
    by_level = F.when(F.col("level") == "direct", direct).when(F.col("level") == "brief", brief).otherwise(cot)
    return by_level + F.when(F.col("repeats"), F.lit(-0.25)).otherwise(zero)


def adaptive_reward(rows: DataFrame, completion: str = "completion", gold: str = "gold", valid: str | None = "valid_options", difficulty: str | None = "difficulty") -> DataFrame:
    """``rows`` with pred, measures and final_reward of the level-aware reward.

    Null completions count as empty (invalid), null valid options as all
    letters, a null or unknown level as brief. All of it is one projection.
    """
    out = staged(_with_parts(rows, completion, gold, valid, difficulty), {"reasoning_reward_v2": reasoning_reward()})
    labels = stepwise([(F.col("x_label_count") == 1, 0.2), (F.col("x_label_count") == 0, -0.3)], -0.5)
    most = {"direct": (40, 80), "brief": (140, 260), "cot": (420, 780)}
    too_long = F.lit(False)
    for level, (han, chars) in most.items():
        too_long = too_long | ((F.col("level") == level) & ((F.col("n_han") > han) | (F.col("n_chars") > chars)))
    reward = (
        weighted([(0.2, F.col("x_valid_extract")), (-1.0, ~F.col("x_valid_extract")), (2.0, F.col("exact")), (-0.3, too_long), (-0.3, F.col("x_extra_text"))])
        + 0.8 * F.col("m_precision") + 0.2 * F.col("m_recall") - 0.7 * F.col("extra") - 0.2 * F.col("missing") + labels + F.col("reasoning_reward_v2")
    )
    return out.withColumns({"pred_letters": F.col("x_pred"), "reward": F.bround(reward, 6)})


def _v1_parts(rows: DataFrame, completion: str, gold: str, valid: str | None) -> DataFrame:
    v = F.col(valid) if valid else None
    body = F.coalesce(F.col(completion), F.lit(""))
    out = staged(rows, {"p1": choices.extracted_v1(body, v), "g1": choices.sorted_letters(F.col(gold), v)})
    m = choices.set_measures(F.col("p1"), F.col("g1"))
    out = staged(out, {**{f"m1_{f}": m[f] for f in ("precision", "recall", "f1", "extra", "missing")}, "ok1": F.col("p1") != ""})
    return staged(
        out,
        {
            "extra1": F.when(F.col("ok1"), F.col("m1_extra")).otherwise(0), "missing1": F.when(F.col("ok1"), F.col("m1_missing")).otherwise(F.length("g1")),
            "labels1": F.size(F.regexp_extract_all(body, F.lit(choices.LETTERS_LINE), F.lit(1))), "exact1": F.col("ok1") & (F.col("p1") == F.col("g1")),
        },
    )


def plain_reward(rows: DataFrame, completion: str = "completion", gold: str = "gold", valid: str | None = "valid_options") -> DataFrame:
    """``rows`` with the first reward: form, exact match, half of F1, less extra and missing options, invalid and wordy answers."""
    out = _v1_parts(rows, completion, gold, valid)
    body = F.coalesce(F.col(completion), F.lit(""))
    wordy = weighted([(-0.1, F.length(body) > 512), (-0.1, F.col("labels1") > 1), (-0.1, F.regexp_count(body, F.lit("答案")) > 2)])
    reward = weighted([(0.2, F.col("ok1")), (-1.0, ~F.col("ok1")), (1.0, F.col("exact1"))]) + 0.5 * F.col("m1_f1") - 0.3 * F.col("extra1") - 0.2 * F.col("missing1") + wordy
    return out.withColumn("reward_v1", F.bround(reward, 6))


def boundary_reward(rows: DataFrame, completion: str = "completion", gold: str = "gold", valid: str | None = "valid_options") -> DataFrame:
    """``rows`` with the reward that weighs extra options more than missing ones and asks for exactly one label and little else."""
    out = _v1_parts(rows, completion, gold, valid)
    body = F.coalesce(F.col(completion), F.lit(""))
    after = F.regexp_replace(body, "(?s)^.*答案\\s*[:：]\\s*[A-Za-z,\\s，、/]+", "")
    trailing = (F.col("labels1") > 0) & after.rlike("[一-鿿A-Za-z0-9]")
    reward = (
        weighted(
            [
                (0.2, F.col("ok1")), (-1.0, ~F.col("ok1")), (2.0, F.col("exact1")), (-0.3, F.col("labels1") == 0), (-0.5, F.col("labels1") > 1), (-0.3, trailing),
                (-0.3, (text.ideographs(body) > 40) | (F.length(text.stripped(body)) > 80)),
            ]
        )
        + 0.8 * F.col("m1_precision") + 0.2 * F.col("m1_recall") - 0.7 * F.col("extra1") - 0.2 * F.col("missing1")
    )
    return out.withColumn("boundary_reward", F.bround(reward, 6))


def micro_measures(rows: DataFrame, by: list[Column], pred: str = "pred_letters", gold: str = "gold_letters") -> DataFrame:
    """Micro-averaged precision, recall and F1 over options, exact-match rate, and shares of rows with extra or missing options."""
    m = choices.set_measures(F.col(pred), F.col(gold))
    hit = F.length(gold) - m["missing"]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("__hit"), F.sum(F.length(pred)).alias("__pred"), F.sum(F.length(gold)).alias("__gold"),
        F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("__em"), F.avg((m["extra"] > 0).cast("double")).alias("__extra"),
        F.avg((m["missing"] > 0).cast("double")).alias("__missing"),
    )
    p, r = F.try_divide(F.col("__hit"), F.col("__pred")), F.try_divide(F.col("__hit"), F.col("__gold"))
    names = [c for c in sums.columns if not c.startswith("__")]
    return sums.select(
        *names, F.bround(p, 6).alias("option_precision"), F.bround(r, 6).alias("option_recall"), F.bround(F.try_divide(2 * p * r, p + r), 6).alias("option_f1"),
        F.bround("__em", 6).alias("exact_rate"), F.bround("__extra", 6).alias("extra_rate"), F.bround("__missing", 6).alias("missing_rate"),
    )
