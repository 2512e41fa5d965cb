"""Candidate pools: one decision per row from duplicates, leakage and review, and holdouts by class and difficulty."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions import text
from sieveworks.functions.hashing import unit_hash
from sieveworks.functions.rules import first_hit
from sieveworks.operators.candidates import repeated_diagnosis
from sieveworks.operators.overlap import blocked
from sieveworks.operators.skew import bounded
from sieveworks.session import cut

# Words of the review.
VAGUE_BASIS = ("根据患者情况", "结合临床", "综合考虑", "情况考虑")
INFORMATIVE = ("检查", "就医", "急诊", "评估", "影像", "心电图", "复查", "转诊", "住院")
URGENT = ("急诊", "立即", "尽快", "急救", "当天")
CERTAIN = ("肯定", "一定", "绝对", "无需检查即可确诊")
GENERIC = ("怎么办", "吃什么药", "严重吗", "要不要紧")


def _filled(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: text.stripped(x) != "")


def review_rule(case: Column, target: Column, risk_level: Column, completeness: Column) -> Column:
    """Ids of the first rule of the review that a candidate breaks, with those that go with it; an empty list if it passes."""
    t = text.stripped(case)
    basis, differentials = _filled(target["diagnostic_basis"]), _filled(target["differential_diagnoses"])
    actions, risks = _filled(target["recommended_actions"]), _filled(target["risk_flags"])
    urgent = F.coalesce(risk_level.isin("urgent", "emergent"), F.lit(False))
    partial = F.coalesce(completeness.isin("partially_missing", "critically_missing"), F.lit(False))
    joined = lambda a: F.array_join(a, " ")
    name = first_hit(
        [
            ("R-QUAL-002", F.length(t) < 18),
            ("R-QUAL-008", text.is_noisy(t)),
            ("R-QUAL-001", target.isNull() | (text.stripped(target["primary_diagnosis"]) == "")),
            ("R-QUAL-005", (F.size(basis) < 2) | F.exists(basis, lambda x: x.isin(*VAGUE_BASIS) | (F.length(x) < 4))),
            ("R-QUAL-006", F.size(differentials) == 0),
            ("R-REVIEW-005", repeated_diagnosis(target)),
            ("R-QUAL-004", urgent & (F.size(risks) == 0)),
            ("R-QUAL-007", (F.size(actions) == 0) | (urgent & ~text.any_hint(joined(actions), INFORMATIVE))),
            ("R-REVIEW-004", urgent & ~text.any_hint(joined(F.concat(actions, risks)), URGENT)),
            ("R-QUAL-009", partial & text.any_hint(target["primary_diagnosis"], CERTAIN)),
            ("R-QUAL-010", (F.length(t) < 32) & text.any_hint(t, GENERIC) & ~text.any_hint(t, ("患者", "病例"))),
        ]
    )
    # a differential that repeats the diagnosis breaks the rule on differentials too
    return F.when(name == "R-REVIEW-005", F.array(F.lit("R-QUAL-006"), name)).when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))


def organised(rows: DataFrame, id_col: str, key: Column, quality: list[Column], lists: list[tuple[str, DataFrame, Column]], rule: Column) -> DataFrame:
    """``rows`` with status, hit_rules (a list) and duplicate_of.

    Duplicates of equal ``key`` are decided first (best quality stays, of equals
    the least id), then leakage into one of ``lists`` in their order, then the
    review. A null key is no duplicate and doesn't leak. The best of a key is a
    map-side aggregate, joined back by the key.
    """
    keyed = cut(rows.withColumn("__k", key).withColumn("__rule", rule))
    best = keyed.where("__k is not null").groupBy("__k").agg(F.max_by(F.col(id_col), F.struct(*quality, -F.col(id_col))).alias("__best"))
    marked = blocked(keyed.join(best, "__k", "left"), F.col("__k"), lists)
    twin = F.col("__best").isNotNull() & (F.col("__best") != F.col(id_col))
    status = first_hit(
        [
            ("rejected_duplicate", twin), ("rejected_leakage", F.col("blocked_by").isNotNull()), ("needs_manual_review", F.exists("__rule", lambda r: F.startswith(r, F.lit("R-REVIEW")))),
            ("rejected_low_quality", F.size("__rule") > 0),
        ],
        "accepted",
    )
    hit = F.when(twin, F.array(F.lit("R-DUP-001"))).when(F.col("blocked_by").isNotNull(), F.array("blocked_by")).otherwise(F.col("__rule"))
    return marked.withColumns({"status": status, "hit_rules": hit, "duplicate_of": F.when(twin, F.col("__best"))}).drop("__k", "__rule", "__best", "blocked_by")


def case_difficulty(case: Column, hard: tuple[str, ...], easy: tuple[str, ...]) -> Column:
    """hard from two hard words on, easy with an easy word and no hard one, else medium."""
    h, e = text.hint_count(case, hard), text.hint_count(case, easy)
    return first_hit([("hard", h >= 2), ("easy", (e >= 1) & (h == 0))], "medium")


def holdout(rows: DataFrame, id_col: str, group: str, level: str, seed: str, per_group: int = 50, quotas: Mapping[str, int] | None = None, supplement: int = 20, enough: int = 300) -> DataFrame:
    """(id, group, level, case_no): of each group so many easy and hard rows, the rest medium, in random order.

    Rows without a group fill up the smallest group, ``supplement`` at most, if
    fewer than ``enough`` were drawn. Groups and levels are few; only their
    counts reach the driver.
    """
    quotas = quotas or {"easy": 10, "hard": 15}
    slim = cut(rows.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(level).alias("l")))
    u = unit_hash(seed, F.col("id"))
    ranked = slim.where("g is not null").withColumn("rn", F.row_number().over(Window.partitionBy("g", "l").orderBy(u, "id"))).where(F.col("rn") <= per_group)
    counts = slim.where("g is not null").groupBy("g").pivot("l", ["easy", "hard", "medium"]).agg(F.count(F.lit(1))).fillna(0)
    wanted = counts.withColumns({k: F.least(F.col(k), F.lit(n)) for k, n in quotas.items()})
    wanted = wanted.withColumn("medium", F.least(F.col("medium"), F.greatest(F.lit(0), F.lit(per_group) - sum((F.col(k) for k in quotas), F.lit(0)))))
    limits = bounded(wanted.unpivot(["g"], [*quotas, "medium"], "l", "n"), 10_000, "groups and levels")
    drawn = cut(ranked.join(F.broadcast(limits), ["g", "l"]).where("rn <= n").select("id", "g", "l"))
    total = drawn.count()
    if total < enough and total:
        least = drawn.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "g").first()["g"]
        extra = slim.where("g is null").orderBy(u, "id").limit(supplement).select("id", F.lit(least).alias("g"), "l")
        drawn = drawn.unionByName(extra)
    number = F.row_number().over(Window.orderBy("g", "l", "id"))  # at most groups x per_group rows
    return drawn.withColumn("case_no", number)


def merged_vocabulary(lists: list[tuple[DataFrame, int | None]], word: str, frequency: str | None = None) -> DataFrame:
    """(word, first_list): words of several lists in order, each once; a list with a number gives its most frequent so many of ideographs."""
    parts = []
    for i, (rows, top) in enumerate(lists):
        held = rows.select(F.col(word).alias("word"), *([F.col(frequency).alias("f")] if top and frequency else []))
        if top:
            held = held.where(F.col("word").rlike("^[一-鿿]+$")).orderBy(F.desc("f") if frequency else "word", "word").limit(top)
        parts.append(held.select("word", F.lit(i).alias("i")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where("word <> ''").groupBy("word").agg(F.min("i").alias("first_list"))


def reasoning_types(system: Column, risk: Column, difficulty: Column, completeness: Column) -> Column:
    """Kinds of reasoning that a case of such dimensions asks for."""
    urgent = F.coalesce(risk.isin("urgent", "emergent"), F.lit(False))
    pick = lambda holds, name: F.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.lit("diagnosis"), pick(difficulty.isin("common_confusable", "atypical_presentation", "noisy_or_incomplete"), "differential"), pick(urgent, "triage"), pick(urgent, "risk_detection"),
                pick(completeness.isin("partially_missing", "critically_missing"), "test_recommendation"), pick(system == "drug_related", "medication_related_reasoning"),
                pick(system == "general_internal_medicine", "comorbidity_reasoning"),
            )
        )
    )


def rationale_rates(rows: DataFrame, rationale: str, gold: str, options: str, by: list[str]) -> DataFrame:
    """Shares of rationales that name every right option, name a wrong one, and are over 200 characters."""
    t = F.coalesce(F.col(rationale), F.lit(""))
    keys = F.coalesce(F.map_keys(options), F.array().cast("array<string>")) if dict(rows.dtypes)[options].startswith("map") else F.coalesce(F.col(options), F.array().cast("array<string>"))
    named = F.filter(keys, lambda k: t.contains(k))
    right = F.filter(keys, lambda k: F.contains(F.coalesce(F.col(gold), F.lit("")), k))
    rate = lambda c: F.bround(F.avg(c.cast("double")), 6)
    return rows.withColumns({"__n": named, "__r": right}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate((F.size("__r") > 0) & (F.size(F.array_except("__r", "__n")) == 0)).alias("names_all_right"),
        rate(F.size(F.array_except("__n", "__r")) > 0).alias("names_wrong"), rate(F.length(t) > 200).alias("long_rate"),
    )
