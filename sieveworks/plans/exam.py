"""Queries over exam items: cleaning, scoring, ranking, sampling, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import choices, hashing, text
from sieveworks.operators import clean, neardup, overlap, profile, sampling, scoring

CLASS_QUOTAS = {"easy": 300, "medium": 300, "hard": 300}


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/exam_item.parquet")


def clean_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return clean.reject_counts(_items(spark, d))


def clean_accepted_share(spark: SparkSession, d: str) -> DataFrame:
    return profile.accepted_share(clean.clean_and_deduplicate(_items(spark, d)), "reject_reason")


def clean_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.element_counts(clean.cleaned(_items(spark, d)).where("reject_reason is null"), "clean_flags")


def char_ratios(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    r = lambda c: F.bround(c, 6)
    return _items(spark, d).select(
        "item_id", r(text.garbled_ratio(q)).alias("garbled"), r(text.special_ratio(q)).alias("special"), r(text.ascii_ratio(q)).alias("ascii"), text.is_noisy(q).alias("noisy"),
        text.ideographs(q).alias("ideographs"), F.length(text.without_space(q)).alias("visible_chars"),
    )


def duplicate_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.cleaned(_items(spark, d)).where("reject_reason is null").withColumn("sig", clean.signature())
    return clean.duplicate_groups(rows, "sig", "item_id").select("first_id", "n")


def duplicate_questions(spark: SparkSession, d: str) -> DataFrame:
    """Groups with equal questions, whatever their options: size and number of different answers."""
    rows = _items(spark, d).withColumn("sig", text.comparison_form(F.col("question")))
    groups = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id"), F.count_distinct(F.upper(text.stripped(F.col("answer")))).alias("n_answers"))
    return groups.where("n > 1").select("first_id", "n", "n_answers")


def best_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("sig", text.comparison_form(F.col("question")))
    quality = [scoring.keeper_quality(None, F.col("question"), F.col("options"), F.col("answer")), F.length(F.coalesce("question", F.lit("")))]
    return clean.best_of_group(rows, "sig", "item_id", quality)


def exam_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", scoring.exam_difficulty(F.col("question"), F.col("question_type")).alias("difficulty"))


def exam_quality(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.exam_quality(F.col("question"), F.col("options"), F.col("question_type"), F.col("exam_type"))
    return _items(spark, d).select("item_id", F.bround(score, 6).alias("quality"))


def keeper_quality(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", F.bround(scoring.keeper_quality(None, F.col("question"), F.col("options"), F.col("answer")), 6).alias("quality"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.reasoning_features(_items(spark, d))


def reasoning_features(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(
        "item_id", "is_multi_choice", "case_info_score", F.array_join("case_info_categories", ",").alias("categories"), "option_length_cv", "option_length_balance_score",
        "option_avg_bigram_jaccard", "option_bigram_overlap_score", "option_confusion_score", "definition_level", "definition_penalty", F.array_join("low_reasoning_flags", ",").alias("low_flags"),
        "low_reasoning_penalty", "reasoning_score",
    )


def reasoning_top(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select("item_id", "reasoning_score", F.length("question").alias("n"))
    return sampling.top_k(rows, [F.desc("reasoning_score"), F.desc("n"), F.col("item_id")], 100)


def reasoning_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select("item_id", "reasoning_score", F.length("question").alias("n"))
    return sampling.ranked(rows, [F.desc("reasoning_score"), F.desc("n"), F.col("item_id")], "item_id", "reasoning_score").select("item_id", "rank")


def reasoning_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return profile.quantiles(_scored(spark, d), F.col("reasoning_score"), (0.25, 0.5, 0.75, 0.9))


def reasoning_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("class", scoring.score_class(F.col("reasoning_score")))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select("item_id", scoring.score_class(F.col("reasoning_score")).alias("class"))
    return sampling.quota_sample(rows, "class", "item_id", CLASS_QUOTAS, 800, "balanced").select("item_id", "class")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("item_id", scoring.exam_difficulty(F.col("question"), F.col("question_type")).alias("difficulty"))
    return sampling.stratified(rows, "difficulty", "item_id", 500, {"hard": 0.30, "medium": 0.50, "easy": 0.20}, "strata").select("item_id", "difficulty")


def answer_bucket_sample(spark: SparkSession, d: str) -> DataFrame:
    keys = F.coalesce(F.map_keys("options"), F.array().cast("array<string>"))
    letters = choices.sorted_letters(F.col("answer"), keys)
    rows = _items(spark, d).select("item_id", letters.alias("letters")).where("letters <> ''").withColumn("bucket", choices.length_bucket(F.col("letters")))
    return sampling.quota_sample(rows, "bucket", "item_id", {"single": 400, "multi_2": 100, "multi_3": 100, "multi_4": 50, "multi_5": 50}, 600, "bucket").select("item_id", "bucket")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("item_id", "exam_type", "split")
    return sampling.hash_sample(rows, "item_id", 400, "sample", F.col("split") == "val").select("item_id")


def unit_floats(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", hashing.unit_hash("day", F.col("item_id")).alias("hash"), F.bround(hashing.unit_float("day", F.col("item_id")), 6).alias("u"))


def first_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("item_id", "source", "exam_type")
    return sampling.first_n(rows, ["source", "exam_type"], [F.col("item_id")], 5).select("item_id", "source", "exam_type", "rn")


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("item_id", "exam_type")
    return sampling.round_robin(rows, "exam_type", ["医师考试", "药师考试", "护理考试", "医技考试"], [F.col("item_id")], 101).select("item_id", "exam_type", "position")


def sliced(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("item_id", F.length("question").alias("n"))
    return sampling.sliced(rows, [F.desc("n"), F.col("item_id")], F.col("n") >= 40, 500, 50, 100)


def positional_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).where(F.size("options") >= 3).select("item_id")
    return sampling.positional_ids(rows, [F.col("item_id")], "item", "item_id")


def split_by_share(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_by_share(_items(spark, d).select("item_id"), "item_id", 0.1, "split")


def least_frequent_subject(spark: SparkSession, d: str) -> DataFrame:
    return sampling.least_frequent(_items(spark, d), "exam_subject")


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    return overlap.overlap_counts(rows.where("split = 'train'"), rows.where("split in ('val', 'test')"), text.comparison_form(F.col("question")))


def leakage_blocked(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    key = text.comparison_form(F.col("question"))
    lists = [("R-LEAK-002", rows.where("split = 'test'"), key), ("R-LEAK-004", rows.where("split = 'val'"), key)]
    return overlap.blocked(rows.where("split = 'train'"), key, lists).where("blocked_by is not null").select("item_id", "blocked_by")


def train_excluded(spark: SparkSession, d: str) -> DataFrame:
    rewarded = spark.read.parquet(f"{d}/choice_reward.parquet").select("item_id")
    return overlap.excluded(_items(spark, d).select("item_id", "source"), rewarded, "item_id")


def options_rendered(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", F.md5(choices.rendered_options(F.col("options"))).alias("digest"), F.size(choices.sorted_entries(F.col("options"))).alias("n_options"))


def lettered_options(spark: SparkSession, d: str) -> DataFrame:
    kept = choices.lettered_options(F.col("options"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return _items(spark, d).select("item_id", joined.alias("options"))


def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    keys = F.transform(F.coalesce(F.map_keys("options"), F.array().cast("array<string>")), lambda k: F.upper(F.trim(k)))
    rows = _items(spark, d).withColumn("k", keys)
    a = F.col("answer")
    return rows.select(
        "item_id", choices.strict_answer(a, F.col("k")).alias("strict"), choices.lenient_answer(a, F.col("k")).alias("lenient"), choices.sorted_letters(a, F.col("k")).alias("letters"),
        choices.is_multi(F.col("question_type"), a).alias("multi"),
    )


def case_categories(spark: SparkSession, d: str) -> DataFrame:
    return profile.element_counts(_items(spark, d).select(scoring.case_categories(F.col("question")).alias("c")), "c")


def term_matches(spark: SparkSession, d: str) -> DataFrame:
    found = text.distinct_matches(F.col("question"), scoring.CASE_PATTERNS["symptom"])
    return _items(spark, d).select("item_id", F.array_join(found, ",").alias("symptoms"), text.pattern_count(F.col("question"), scoring.DENSE_TERMS).alias("dense_terms"))


def subject_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(_items(spark, d), "exam_subject")


def field_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.counts_by_each(_items(spark, d), ["split", "source", "exam_type", "exam_class", "question_type"])


def quality_bins(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.exam_quality(F.col("question"), F.col("options"), F.col("question_type"), F.col("exam_type"))
    return profile.binned(_items(spark, d), F.bround(score, 6), [("high", 0.7), ("medium", 0.4)], "low")


def question_lengths(spark: SparkSession, d: str) -> DataFrame:
    return profile.quantiles(_items(spark, d), F.length("question"), (0.5, 0.9), ["exam_type"])


def median_length(spark: SparkSession, d: str) -> DataFrame:
    return profile.upper_median(_items(spark, d), F.length("question")).select(F.col("v").alias("upper_median"))


def _vector_text(repeat: int = 4):
    q = F.concat(*[F.coalesce("question", F.lit(""))] * repeat)
    options = F.array_join(F.transform(choices.sorted_entries(F.col("options")), lambda e: F.concat(e["key"], F.coalesce(e["value"], F.lit("")))), "")
    return text.comparison_form(F.concat(q, options))


def _near_pairs(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat_ws("|", *[F.coalesce(F.trim(c), F.lit("__missing__")) for c in ("exam_type", "exam_class", "exam_subject")])
    pairs, copies = neardup.tfidf_pairs(_items(spark, d).withColumn("block", block), "block", "item_id", _vector_text())
    near = neardup.among_equals(pairs, copies, _items(spark, d), "item_id", F.upper(text.stripped(F.col("answer"))))
    return near.select("id_a", "id_b", F.bround("similarity", 4).alias("similarity"))


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near texts with equal answers: pairs of the least ids of equal rows, and each other of these rows with its least id."""
    return _near_pairs(spark, d)


def near_duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    quality = scoring.keeper_quality(None, F.col("question"), F.col("options"), F.col("answer"))
    return neardup.elected(neardup.connected_components(_near_pairs(spark, d)), _items(spark, d), "item_id", quality)


QUERIES = [v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]
