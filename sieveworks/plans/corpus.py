"""Queries over documents, training rows and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import hashing, text
from sieveworks.operators import candidates, chunks, dialog, overlap, packing, pool, profile, sampling, scoring, select, similarity, templates
from sieveworks.session import cut
from sieveworks.sources.records import aligned_union
from sieveworks.streaming import events as streams

HARD_CASE_WORDS = ("危重", "复杂", "疑难", "不明原因", "多器官", "衰竭", "急诊", "抢救", "重症", "监护", "急性")
#: What the sources of documents are worth as training data; others have the default.
SOURCE_WORTH = {"guideline_notes": 1.0, "explain_pool": 0.75}
EASY_CASE_WORDS = ("体检", "查体", "无明显", "无特殊", "无显著", "正常", "随访")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _sft(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/sft_row.parquet")


def document_sources(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(_documents(spark, d), "source")


def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return profile.quantiles(_documents(spark, d), F.length("text"), (0.5, 0.9), ["doc_type"])


def document_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("sig"))
    return rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").select("first_id", "n")


def case_scores(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    flags = scoring.quality_flags(t)
    rows = _documents(spark, d).select("doc_id", "text", flags.alias("flags"))
    return rows.select(
        "doc_id", F.array_join("flags", ",").alias("flags"), F.bround(scoring.length_score(t), 6).alias("length_score"), F.bround(scoring.case_richness(t), 6).alias("richness"),
        F.bround(scoring.penalty(F.col("flags"), t), 6).alias("penalty"), candidates.input_style(t).alias("style"),
    )


def departments(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", scoring.top_class(scoring.DEPARTMENT_WORDS, F.col("text")).alias("department"))


def department_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).withColumn("class", scoring.top_class(scoring.DEPARTMENT_WORDS, F.col("text")))
    return rows.groupBy(F.coalesce("class", F.lit("none")).alias("department")).agg(F.count(F.lit(1)).alias("n"))


def spoken_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues as turns: numbers of turns and of answered questions."""
    turns = dialog.spoken_turns(F.col("text"), {"患者": "human", "医生": "gpt"})
    rows = _documents(spark, d).where("doc_type = 'dialogue'").select("doc_id", turns.alias("c"))
    return rows.select("doc_id", F.size("c").alias("n_turns"), F.size(dialog.answered_pairs(F.col("c"))).alias("n_pairs"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks.chunk_rows(_documents(spark, d), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents for every twentieth question."""
    questions = spark.read.parquet(f"{d}/exam_item.parquet").where("item_id % 20 = 0").select("item_id", "question")
    return similarity.bm25(questions, _documents(spark, d), "item_id", "question", "doc_id", "text").select(F.col("q").alias("item_id"), F.col("d").alias("doc_id"), "score", "rank")


def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors to every twentieth one, itself among them."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    found = similarity.top_k_cosine(rows.where("vec_id % 20 = 0"), rows, "vec_id", "vec_id", "embedding", 5, 0.0)
    return found.select(F.col("q").alias("query_id"), F.col("r").alias("vec_id"), F.bround("similarity", 4).alias("similarity"), "rank")


def vector_aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    found = similarity.top_k_cosine(rows.where("vec_id % 20 = 0"), rows, "vec_id", "vec_id", "embedding", 5, 0.0)
    return similarity.aligned(found).select(F.col("r").alias("vec_id"))


def sketches(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.lower(F.hex(hashing.simhash(F.col("text")))).alias("simhash"))


def sketch_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of documents whose sketches differ in at most three bits, equal ones among them."""
    rows = _documents(spark, d).select("doc_id", hashing.simhash(F.col("text")).alias("s"))
    return select.all_hamming_pairs(cut(rows), "doc_id", "s")


def greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", "source", F.bround(scoring.case_richness(F.col("text")), 6).alias("r"), hashing.simhash(F.col("text")).alias("s"))
    ranked = rows.select("doc_id", "source", "s", (-F.col("r")).alias("rank"))
    return select.greedy_select(ranked, "doc_id", "rank", "source", "s", 300)


def sft_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = dialog.exam_conversation(F.col("question"), F.col("options"), F.col("answer"))
    rows = _sft(spark, d).select("row_id", c.alias("c"))
    return rows.select("row_id", F.md5(F.get("c", F.lit(0))["value"]).alias("asked"), F.get("c", F.lit(1))["value"].alias("answered"), dialog.conversation_error(F.col("c")).alias("error"))


def sft_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of each row's text in three of the formats."""
    c = dialog.exam_conversation(F.col("question"), F.col("options"), F.col("answer"))
    rows = _sft(spark, d).select("row_id", dialog.paired(dialog.messages_of(c)).alias("p"))
    out = [F.md5(templates.rendered(F.col("p"), t)["full"]).alias(t) for t in ("vicuna", "qwen", "alpaca")]
    return rows.select("row_id", F.size("p").alias("n_pairs"), *out)


def sft_prefixes(spark: SparkSession, d: str) -> DataFrame:
    turns = dialog.spoken_turns(F.col("text"), {"患者": "human", "医生": "gpt"})
    rows = _documents(spark, d).where("doc_type = 'dialogue'").select("doc_id", dialog.messages_of(turns).alias("m"))
    return dialog.exploded_prefixes(rows, "doc_id", F.col("m")).select("doc_id", "sample", F.size("messages").alias("n_messages"))


def preference_budget(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a right and a wrong completion of an item, those within a budget of characters."""
    r = spark.read.parquet(f"{d}/choice_reward.parquet").select("item_id", "reward_id", "completion", "exact_match", "logged_at")
    r = overlap.latest(r, "reward_id", [F.col("logged_at")])
    best = lambda ok, name: r.where(F.col("exact_match") == ok).groupBy("item_id").agg(F.min_by("completion", "reward_id").alias(name))
    pairs = best(True, "chosen").join(best(False, "rejected"), "item_id")
    kept = pairs.where(dialog.within_budget(F.col("chosen"), 200) & dialog.within_budget(F.col("rejected"), 200))
    return kept.select("item_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


def packed_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", packing.tokenized(F.col("text")).alias("ids"))
    return packing.packed(rows, "doc_id", "ids", 512, 0, 8).select("part", "block", F.size("input_ids").alias("n"))


def exam_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/exam_item.parquet")
    return rows.select("item_id", F.md5(candidates.exam_case_text(F.col("question"), F.col("options"))).alias("case_text"), candidates.exam_answer_text(F.col("answer"), F.col("options")).alias("answer_text"))


def case_target_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/eval_result.parquet")
    t = F.col("ground_truth")
    return rows.select("eval_id", F.array_join(candidates.target_errors(t), ",").alias("errors"), candidates.repeated_diagnosis(t).alias("repeats_diagnosis"), "logged_at")


def case_review(spark: SparkSession, d: str) -> DataFrame:
    """Cases with one decision each: copies of a case, then the review of text and target."""
    rows = overlap.latest(spark.read.parquet(f"{d}/eval_result.parquet").select("eval_id", "case_text", "ground_truth", "logged_at"), "eval_id", [F.col("logged_at")])
    none = F.lit(None).cast("string")
    key = F.concat_ws("\n", text.stripped(F.col("case_text")), F.col("ground_truth.primary_diagnosis"))
    out = pool.organised(rows, "eval_id", key, [F.length("case_text")], [], pool.review_rule(F.col("case_text"), F.col("ground_truth"), none, none))
    return out.select("eval_id", "status", F.array_join("hit_rules", ",").alias("rules"), "duplicate_of")


def holdout_cases(spark: SparkSession, d: str) -> DataFrame:
    level = pool.case_difficulty(F.col("text"), HARD_CASE_WORDS, EASY_CASE_WORDS)
    rows = _documents(spark, d).select("doc_id", scoring.top_class(scoring.DEPARTMENT_WORDS, F.col("text")).alias("department"), level.alias("level"))
    return pool.holdout(rows, "doc_id", "department", "level", "holdout").select(F.col("id").alias("doc_id"), F.col("g").alias("department"), F.col("l").alias("level"), "case_no")


def target_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Documents by likeness to a development set (the cases of one gateway), richness and penalties."""
    targets = overlap.latest(spark.read.parquet(f"{d}/eval_result.parquet").where("source = 'replay'").select("case_id", "case_text"), "case_id", [F.col("case_text")])
    targets = targets.select("case_id", hashing.hashed_vector(F.col("case_text")).alias("v"))
    rows = _documents(spark, d).select("doc_id", "text", "source", "doc_type")
    like = similarity.target_similarity(rows, targets, "doc_id", "case_id", "v", text="text")
    rich, cost = scoring.case_richness(F.col("text")), scoring.penalty(scoring.quality_flags(F.col("text")), F.col("text"))
    worth = scoring.of_table(SOURCE_WORTH, F.col("source"), otherwise=0.45)
    route = scoring.of_table(scoring.ROUTE_PRIORITY, F.when(F.col("doc_type") == "case", "rewrite_candidate"), otherwise=0.0)
    score = scoring.target_score(F.col("mean_top"), worth, rich, route, cost)
    out = rows.join(like, rows["doc_id"] == like["r"]).select("doc_id", F.bround("best", 6).alias("best"), F.bround(score, 6).alias("score"))
    return sampling.ranked(out, [F.desc("score"), F.col("doc_id")], "doc_id", "score")


def rationale_rates(spark: SparkSession, d: str) -> DataFrame:
    from sieveworks.functions.choices import before_answer

    rows = spark.read.parquet(f"{d}/choice_reward.parquet").withColumn("r", before_answer(F.col("completion")))
    return pool.rationale_rates(rows, "r", "gold", "valid_options", ["source"])


def customer_places(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    rows = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    out = overlap.hydrated(overlap.hydrated(rows, t("nation"), ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey"), t("region"), ["r_regionkey"])
    return out.select("c_custkey", "n_name", "r_name")


def party_union(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    customers = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return aligned_union([customers, suppliers])


def order_key_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    left = t("orders").select(F.col("o_custkey").alias("k"))
    right = t("customer").select(F.col("c_custkey").alias("k"))
    return overlap.overlap_counts(left, right, F.col("k"))


def option_sets(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of an order as a set of letters, against those that were returned."""
    from sieveworks.operators.rewards import micro_measures

    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.chr(64 + F.col("l_linenumber")).alias("letter"), "l_returnflag", "l_linestatus")
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("letter")))), "")
    per = rows.groupBy("l_orderkey").agg(sets(F.col("l_linestatus") == "O").alias("pred_letters"), sets(F.col("l_returnflag") == "R").alias("gold_letters"))
    return micro_measures(per.where("gold_letters <> ''"), [F.length("gold_letters").alias("gold_length")])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.file_stream(spark, d, "events.parquet")


def _windows(rows: DataFrame) -> DataFrame:
    return rows.select("start", "end", "event_type", "n", F.bround("total", 4).alias("total"))


def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _windows(streams.tumbling(_events(spark, d), "ts", "event_type", "6 hours"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _windows(streams.sliding(_events(spark, d), "ts", "event_type", "12 hours", "6 hours"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(_events(spark, d), "ts", "user_id", "2 hours").select("start", "end", "user_id", "n", F.bround("total", 4).alias("total"))


def event_latest_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.latest_state(_event_stream(spark, d), "user_id", "ts", ["event_id", "event_type"])
    return streams.run_to_end(stream, "complete")


def event_dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.deduplicated(_event_stream(spark, d).select("user_id", "event_type"), "user_id").select("user_id")
    return streams.run_to_end(stream)


def event_error_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = streams.error_runs(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return streams.tripped(runs, "user_id", 3)


def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return _events(spark, d).groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).cast("long").alias("total"), F.max(k).alias("most"))


def event_daily_top(spark: SparkSession, d: str) -> DataFrame:
    per = _events(spark, d).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.first_n(per, ["day"], [F.desc("n"), F.col("user_id")], 3).select("day", "user_id", "n", "rn")


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the several normal forms of each text."""
    t = F.col("text")
    return _documents(spark, d).select(
        "doc_id", F.md5(text.without_space(t)).alias("no_space"), F.md5(text.collapsed_lower(t)).alias("collapsed"), F.md5(text.diagnosis_form(t)).alias("diagnosis"),
        F.md5(text.without_prefix(t)).alias("no_prefix"), F.md5(text.tag_form(t)).alias("tag"), F.size(text.lines(t)).alias("n_lines"),
    )


QUERIES = [v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]
