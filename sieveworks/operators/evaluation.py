"""Measures of structured answers to cases, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import jsonx, text
from sieveworks.functions.rules import all_hits, first_hit, staged

FIELDS = tuple(jsonx.FIELD_NAMES)
# Words that assert, words that hedge, and words of each kind of risk.
ASSERTIVE_WORDS = ("一定", "绝对", "肯定", "100%", "必然", "毫无疑问", "必然导致", "必然是", "必然发生", "必定", "百分百")
ASSERTIVE = r"一定|绝对|肯定|100%|必然|毫无疑问|必定|百分百"
HEDGING = r"可能|建议|疑似|考虑|倾向|需|待|排除|鉴别|进一步|不除外|未见"
RISK_WORDS = {
    "药物风险": ("药物", "用药", "不良反应", "副作用", "过量", "中毒", "配伍", "禁忌", "抗凝", "化疗"),
    "检查风险": ("检查", "造影", "穿刺", "活检", "手术", "麻醉", "辐射", "碘对比剂", "造影剂", "并发症"),
    "病情恶化风险": ("恶化", "进展", "加重", "危象", "昏迷", "休克", "呼吸衰竭", "心力衰竭", "肾衰竭", "肝衰竭", "脑疝", "大出血", "窒息"),
    "并发症风险": ("并发症", "感染", "出血", "穿孔", "梗阻", "栓塞", "血栓", "肺栓塞", "深静脉血栓", "压疮"),
}
OTHER_RISK = "其他风险"
_STRINGS = "array<string>"


def _array(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(_STRINGS))


def diagnosis_words(diagnosis: Column) -> Column:
    """Runs of two or more ideographs, after single hedging characters and brackets are taken out."""
    bare = F.regexp_replace(F.coalesce(diagnosis, F.lit("")), "[可能大小疑似倾向考虑不除外（）()]", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit("([一-鿿]{2,})"), F.lit(1)))


def diagnosis_match(pred: Column, gold: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else the share of gold words found, at least 0.3 if any is; missing sides give 0."""
    p, g = text.diagnosis_form(pred), text.diagnosis_form(gold)
    words = diagnosis_words(gold)
    shared = F.size(F.array_intersect(diagnosis_words(pred), words))
    return (
        F.when((F.coalesce(pred, F.lit("")) == "") | (F.coalesce(gold, F.lit("")) == ""), F.lit(0.0))
        .when(p == g, F.lit(1.0))
        .when(F.contains(p, g) | F.contains(g, p), F.lit(0.8))
        .when(shared > 0, F.greatest(shared / F.size(words), F.lit(0.3)))
        .otherwise(F.lit(0.0))
    )


def differential_names(items: Column) -> Column:
    """Distinct names in a list of differentials, without what explains them."""
    parts = F.flatten(F.transform(_array(items), lambda d: F.split(F.coalesce(d, F.lit("")), r"[，,、\n]")))
    names = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)[：（】\[].*$", ""), r"(?U)[。\s]", ""))
    return F.array_distinct(F.filter(names, lambda n: F.length(n) >= 2))


def differential_coverage(pred: Column, gold: Column) -> Column:
    """struct(correct, total): gold names matched by a shared word or as a part; a name without words counts as matched."""
    names = differential_names(pred)

    def found(g: Column) -> Column:
        words = diagnosis_words(g)
        hit = F.exists(names, lambda p: F.arrays_overlap(diagnosis_words(p), words) | F.contains(text.diagnosis_form(p), text.diagnosis_form(g)))
        return (F.size(words) == 0) | hit

    wanted = differential_names(gold)
    return F.struct(F.size(F.filter(wanted, found)).alias("correct"), F.size(wanted).alias("total"))


def risk_kinds(risk: Column) -> Column:
    hits = F.array_compact(F.array(*[F.when(text.any_hint(risk, words), F.lit(kind)) for kind, words in RISK_WORDS.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(OTHER_RISK)))


def risk_recall(pred: Column, gold: Column) -> Column:
    """struct(relevant, total): kinds of risk counted with repeats, each matched as often as both sides have it."""
    p, g = F.flatten(F.transform(_array(pred), risk_kinds)), F.flatten(F.transform(_array(gold), risk_kinds))
    relevant = F.lit(0)
    for kind in (*RISK_WORDS, OTHER_RISK):
        count = lambda a, k=kind: F.size(F.filter(a, lambda x: x == k))
        relevant = relevant + F.least(count(p), count(g))
    return F.struct(relevant.alias("relevant"), F.size(g).alias("total"))


def is_overconfident(output: Column) -> Column:
    t = F.coalesce(output, F.lit(""))
    return t.rlike(ASSERTIVE) & ~t.rlike(HEDGING)


def overconfidence_signals(output: Column) -> Column:
    """The assertive words in an output, each once, whether or not hedges stand beside them."""
    t = F.coalesce(output, F.lit(""))
    return all_hits([(word, F.contains(t, F.lit(word))) for word in ASSERTIVE_WORDS])


def case_measures(rows: DataFrame, output: str = "raw_output", truth: str = "ground_truth") -> DataFrame:
    """``rows`` with the measures of each output and the first error that applies.

    Outputs that don't parse, or lack a field, have zeros in all later
    measures. All of it is one projection; null outputs are parse errors.
    """
    t = F.col(truth)
    held = {"t_diagnosis": t["primary_diagnosis"], "t_differentials": t["differential_diagnoses"], "t_risks": t["risk_flags"]}
    out = staged(rows, {"v": jsonx.model_json(F.col(output))} | held)
    kinds = {f: "string" if f == "primary_diagnosis" else _STRINGS for f in FIELDS}
    out = staged(out, {f"f_{f}": jsonx.field(F.col("v"), f, k) for f, k in kinds.items()} | {"m_parsed": F.col("v").isNotNull()})
    missing = F.array_compact(F.array(*[F.when(F.col(f"f_{f}").isNull(), F.lit(f)) for f in FIELDS]))
    out = staged(out, {"m_missing": F.when(F.col("m_parsed"), missing)})
    out = staged(out, {"m_compliant": F.coalesce(F.col("m_parsed") & (F.size("m_missing") == 0), F.lit(False))})
    ok = F.col("m_compliant")
    nothing = F.struct(F.lit(0).alias("correct"), F.lit(0).alias("total"))
    none = F.struct(F.lit(0).alias("relevant"), F.lit(0).alias("total"))
    out = staged(
        out,
        {
            "m_diagnosis": F.when(ok, diagnosis_match(F.col("f_primary_diagnosis"), F.col("t_diagnosis"))).otherwise(F.lit(0.0)),
            "m_diff": F.when(ok, differential_coverage(F.col("f_differential_diagnoses"), F.col("t_differentials"))).otherwise(nothing),
            "m_risk": F.when(ok, risk_recall(F.col("f_risk_flags"), F.col("t_risks"))).otherwise(none),
            "m_overconfident": ok & is_overconfident(F.col(output)),
            "m_complete": F.when(ok, sum((F.when(F.length(F.col(f"f_{f}")) > 0, 1).otherwise(0) if k == "string" else F.when(F.size(f"f_{f}") > 0, 1).otherwise(0)) for f, k in kinds.items())).otherwise(0),
        },
    )
    diff_share = F.coalesce(F.try_divide(F.col("m_diff.correct"), F.col("m_diff.total")), F.lit(0.0))
    risk_share = F.coalesce(F.try_divide(F.col("m_risk.relevant"), F.col("m_risk.total")), F.lit(0.0))
    error = first_hit(
        [
            ("parse_error", ~F.col("m_parsed")),
            ("missing_fields", ~ok),
            ("overconfidence", F.col("m_overconfident")),
            ("low_diff_coverage", (diff_share < 0.5) & (F.col("m_diff.total") > 0)),
            ("low_risk_recall", (risk_share < 0.3) & (F.col("m_risk.total") > 0)),
            ("incorrect_primary_diagnosis", (F.col("m_diagnosis") < 0.7) & (F.coalesce("t_diagnosis", F.lit("")) != "")),
        ]
    )
    return out.withColumns({"m_diff_share": diff_share, "m_risk_share": risk_share, "m_error": error, "m_length": F.length(F.coalesce(F.col(output), F.lit("")))}).drop("v", *held)


def aggregated(measures: DataFrame, by: list[str]) -> DataFrame:
    """Overall and by each column of ``by`` in one pass of grouping sets: (level, key, total, rates)."""
    slim = measures.select(*by, "m_compliant", "m_overconfident", "m_diff", "m_risk", "m_diagnosis", "m_complete", "m_length")
    sets = F.explode(F.array(F.struct(F.lit("overall").alias("level"), F.lit("all").alias("key")), *[F.struct(F.lit(c).alias("level"), F.coalesce(F.col(c), F.lit("unknown")).alias("key")) for c in by]))
    rate = lambda c: F.bround(F.avg(c.cast("double")), 6)
    share = lambda a, b: F.bround(F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)), 6)
    return (
        slim.withColumn("s", sets)
        .groupBy("s.level", "s.key")
        .agg(
            F.count(F.lit(1)).alias("total"), rate(F.col("m_compliant")).alias("compliance_rate"), rate(F.col("m_overconfident")).alias("overconfidence_rate"),
            share(F.col("m_diff.correct"), F.col("m_diff.total")).alias("diff_coverage_rate"), share(F.col("m_risk.relevant"), F.col("m_risk.total")).alias("risk_recall_rate"),
            rate(F.col("m_diagnosis") >= 0.7).alias("top1_accuracy"), rate(F.col("m_diagnosis") >= 0.4).alias("top3_accuracy"),
            F.bround(F.avg(F.col("m_complete") / len(FIELDS)), 6).alias("completeness"), F.bround(F.avg("m_length"), 6).alias("avg_length"),
        )
    )


def deltas(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, a, b, delta) for two tables of metrics."""
    long = lambda d, name: d.unpivot(keys, metrics, "metric", name)
    joined = long(a, "a").join(long(b, "b"), [*keys, "metric"])
    return joined.withColumn("delta", F.bround(F.col("b") - F.col("a"), 6))


def first_letters(output: Column) -> Column:
    """The first run of one to five option letters."""
    return F.regexp_extract(F.coalesce(output, F.lit("")), "([A-E]{1,5})", 1)


def best_choice(scores: Column) -> Column:
    """Position from 1 of the greatest score, of equals the first."""
    return F.array_position(scores, F.array_max(scores))
