"""Queries over completions and case outputs: rewards, extraction, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import choices, jsonx, text
from sieveworks.operators import evaluation, overlap, profile, rewards, sampling


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/choice_reward.parquet")


def _evals(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/eval_result.parquet")


def answer_extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = _rewards(spark, d).withColumn("x", choices.extracted_v2(F.col("completion"), F.col("valid_options")))
    v1 = choices.extracted_v1(F.col("completion"), F.col("valid_options"))
    return rows.select(
        "reward_id", v1.alias("pred_v1"), "x.pred", "x.valid_extract", F.col("x.label_count").alias("label_count"), "x.used_fallback", "x.extra_text", "logged_at"
    )


def set_measures(spark: SparkSession, d: str) -> DataFrame:
    m = choices.set_measures(F.col("pred"), F.col("gold"))
    return _rewards(spark, d).withColumn("m", m).select("reward_id", *[F.bround(F.col(f"m.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")], "m.extra", "m.missing", "logged_at")


def adaptive_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = rewards.adaptive_reward(_rewards(spark, d).select("reward_id", "completion", "gold", "valid_options", "difficulty", "logged_at"))
    return rows.select("reward_id", F.col("pred_letters").alias("pred"), "level", F.bround("reasoning_reward_v2", 6).alias("reasoning_reward"), "reward", "logged_at")


def plain_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = rewards.plain_reward(_rewards(spark, d).select("reward_id", "completion", "gold", "valid_options", "logged_at"))
    return rows.select("reward_id", "reward_v1", "logged_at")


def boundary_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = rewards.boundary_reward(_rewards(spark, d).select("reward_id", "completion", "gold", "valid_options", "logged_at"))
    return rows.select("reward_id", "boundary_reward", "logged_at")


def _lettered(spark: SparkSession, d: str) -> DataFrame:
    rows = overlap.latest(_rewards(spark, d), "reward_id", [F.col("logged_at")])
    return rows.withColumns({"pred_letters": choices.sorted_letters(F.col("pred")), "gold_letters": choices.sorted_letters(F.col("gold"))})


def micro_by_source(spark: SparkSession, d: str) -> DataFrame:
    return rewards.micro_measures(_lettered(spark, d), [F.col("source")])


def micro_by_gold_length(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("gold_letters")
    bucket = F.when(n >= 4, "4_or_more").otherwise(n.cast("string"))
    return rewards.micro_measures(_lettered(spark, d), [bucket.alias("gold_length")])


def length_differences(spark: SparkSession, d: str) -> DataFrame:
    return profile.difference_histogram(_lettered(spark, d), F.col("pred_letters"), F.col("gold_letters"))


def paired_systems(spark: SparkSession, d: str) -> DataFrame:
    """Two systems on the items both answered, each by its last answer."""
    rows = _lettered(spark, d)
    m = choices.set_measures(F.col("pred_letters"), F.col("gold_letters"))
    rows = rows.withColumns({"right": F.col("pred_letters") == F.col("gold_letters"), "m": m})
    rows = rows.select("item_id", "source", "right", F.col("m.extra").alias("extra"), F.col("m.missing").alias("missing"), "reward_id")
    one = lambda s: overlap.latest(rows.where(F.col("source") == s), "item_id", [F.col("reward_id")])
    return overlap.paired_contrast(one("sft_direct"), one("sft_mixed"), "item_id", "right", "extra", "missing")


def completion_lengths(spark: SparkSession, d: str) -> DataFrame:
    return profile.quantiles(_rewards(spark, d), F.length("completion"), (0.5, 0.9, 0.95), ["source"])


def reward_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = overlap.latest(_rewards(spark, d).select("reward_id", "item_id", "source", "final_reward", "logged_at"), "reward_id", [F.col("logged_at")])
    return rows.select("reward_id", "item_id", "source", "final_reward", "logged_at")


def reward_errors(spark: SparkSession, d: str) -> DataFrame:
    return profile.errors_of(_rewards(spark, d), F.col("option_precision"), F.col("f1"))


def reward_labels(spark: SparkSession, d: str) -> DataFrame:
    return profile.counts_by_each(_rewards(spark, d), ["question_type", "difficulty", "used_fallback"])


def difficulty_levels(spark: SparkSession, d: str) -> DataFrame:
    return _rewards(spark, d).groupBy(choices.difficulty_of(F.col("difficulty")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def reward_audit_join(spark: SparkSession, d: str) -> DataFrame:
    """Items with the last reward that has a valid extraction, best first."""
    items = spark.read.parquet(f"{d}/exam_item.parquet").select("item_id", "exam_subject")
    log = _rewards(spark, d).select("item_id", "final_reward", "f1", "logged_at", "reward_id", F.when(F.col("valid_extract"), "ok").otherwise("invalid").alias("status"))
    joined = overlap.with_latest(items, log, "item_id", [F.col("logged_at"), F.col("reward_id")], "status", "ok", {"final_reward": "teacher_score", "f1": "worthiness"})
    return sampling.top_k(joined, [F.desc("teacher_score"), F.desc("worthiness"), F.col("item_id")], 200).select("item_id", "teacher_score", "worthiness", "rank")


def reward_pending(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/exam_item.parquet").select("item_id", "source")
    log = _rewards(spark, d).select("item_id", F.when(F.col("valid_extract"), "ok").otherwise("error").alias("status"))
    return overlap.pending(items, log, "item_id", "status", ("ok",))


def reasoning_parts(spark: SparkSession, d: str) -> DataFrame:
    body = choices.before_answer(F.col("completion"))
    return _rewards(spark, d).select("reward_id", F.length(body).alias("n_chars"), text.ideographs(body).alias("n_ideographs"), text.last_line(F.col("completion")).alias("last_line"), "logged_at")


def tagged_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _rewards(spark, d).where(F.contains("completion", F.lit("<answer>")))
    return rows.select("reward_id", jsonx.tagged_answer(F.col("completion")).alias("answer"), jsonx.has_think_answer_form(F.col("completion")).alias("well_formed"), "logged_at")


def first_letters(spark: SparkSession, d: str) -> DataFrame:
    rows = _rewards(spark, d).withColumn("first", evaluation.first_letters(F.col("completion")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg((F.col("first") == F.col("gold")).cast("double")), 6).alias("exact_rate"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    rows = _evals(spark, d).select("eval_id", "case_id", "department", "difficulty", "source", "raw_output", "ground_truth", "logged_at")
    return evaluation.case_measures(overlap.latest(rows, "eval_id", [F.col("logged_at")]))


def case_measures(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select(
        "eval_id", F.col("m_parsed").alias("parsed"), F.array_join("m_missing", ",").alias("missing"), F.col("m_compliant").alias("compliant"), F.bround("m_diagnosis", 6).alias("diagnosis_score"),
        F.col("m_diff.correct").alias("diff_correct"), F.col("m_diff.total").alias("diff_total"), F.col("m_risk.relevant").alias("risk_relevant"), F.col("m_risk.total").alias("risk_total"),
        F.col("m_overconfident").alias("overconfident"), F.col("m_complete").alias("complete_fields"), F.col("m_error").alias("error"),
    )


def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.aggregated(_measured(spark, d), ["department", "difficulty"])


def eval_errors(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).groupBy(F.coalesce("m_error", F.lit("none")).alias("error"), "source").agg(F.count(F.lit(1)).alias("n"))


def eval_error_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d).where("m_error is not null").select("m_error", "eval_id", text.preview(F.col("raw_output"), 300).alias("output"))
    return sampling.first_n(rows, ["m_error"], [F.col("eval_id")], 5).select(F.col("m_error").alias("error"), "eval_id", F.md5(F.coalesce("output", F.lit(""))).alias("digest"), "rn")


def eval_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d)
    one = lambda s: evaluation.aggregated(rows.where(F.col("source") == s), []).select("level", "compliance_rate", "diff_coverage_rate", "top1_accuracy")
    return evaluation.deltas(one("gw_south"), one("gw_north"), ["level"], ["compliance_rate", "diff_coverage_rate", "top1_accuracy"])


def overconfident_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _evals(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(evaluation.is_overconfident(F.col("raw_output"))).alias("n_overconfident"))


def output_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("raw_output", F.lit("")))
    rows = _evals(spark, d).groupBy("source")
    return rows.agg(F.bround(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.bround(F.avg((n == 0).cast("double")), 6).alias("empty_rate"), F.bround(F.avg((n > 400).cast("double")), 6).alias("overlong_rate"))


QUERIES = [v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]
