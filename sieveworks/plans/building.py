"""Queries over the making of training records: filters, prompts, conversations, replies, tokens, files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import choices, hashing, jsonx, text
from sieveworks.functions.rules import decision, staged
from sieveworks.operators import candidates, chunks, clean, dialog, evaluation, overlap, packing, pool, profile, prompts, react, sampling, scoring, templates
from sieveworks.session import cut, shared_dir
from sieveworks.sources import records, sinks

PROMPT = "你是一名医学考试助手。请根据题目选择正确选项。\n\n题目：{question}\n\n选项：\n{options_text}\n\n请作答："
SYSTEM = "请先思考再回答。"
REWRITE_SUFFIX = "请按要求输出结构化结果。"
SOURCE_ORDER = ("case_digest", "kebei_qa", "teacher_rewrite")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


def _joined(items: Column) -> Column:
    return F.array_join(items, "|")


# -- filters and signatures ---------------------------------------------------------------------------------------------


def raw_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "exam_item").select("item_id", F.md5(clean.raw_signature(F.col("question"), F.col("options"))).alias("signature"))


def duplicate_views(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal rows under three signatures: raw, normalised, question alone."""
    rows = clean.cleaned(_t(spark, d, "exam_item").select("question", "options", "answer"))
    only = text.comparison_form(F.col("q"), False)
    views = {"raw": clean.raw_signature(F.col("question"), F.col("options")), "normalized": F.concat(only, F.lit("||"), clean.options_signature(F.col("opts"), False)), "question_only": only}
    return clean.duplicate_views(staged(rows, views), list(views))


def basic_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "exam_item")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(clean.has_basics(F.col("question"), F.col("options"), F.col("answer"))).alias("kept"))


def filtered_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "exam_item")
    quality = scoring.exam_quality(F.col("question"), F.col("options"), F.col("question_type"), F.col("exam_type"))
    return clean.filtered(rows, quality, scoring.exam_difficulty(F.col("question"), F.col("question_type")), "item_id", 0.4, "medium", 200).select("item_id")


def sample_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "choice_reward").select("reward_id", "item_id", "pred", "logged_at", "extra_count")
    return rows.select("reward_id", "logged_at", clean.sample_id_of(F.nullif("pred", F.lit("")), F.when(F.col("item_id") % 2 == 0, F.col("item_id")), F.col("extra_count").cast("string"), F.col("reward_id")).alias("sample_id"))


def case_risks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select(
        "doc_id", scoring.is_high_risk(t).alias("high_risk"), scoring.needs_differential(t, F.lit(None).cast("array<string>")).alias("needs_differential"),
        F.array_join(scoring.penalty_reasons(scoring.quality_flags(t), t), ";").alias("reasons"),
    )


def prioritised_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text once, from the first source that has it; texts of bad quality skipped."""
    rank = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.coalesce("source", F.lit("")))
    rows = _t(spark, d, "documents").select("doc_id", "text", F.when(rank > 0, rank).otherwise(len(SOURCE_ORDER) + 1).alias("rank"), scoring.quality_flags(F.col("text")).alias("flags"))
    return candidates.first_of_sources(rows.where("text is not null"), "text", "rank", "doc_id", "flags").select("doc_id", "skipped")


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    ids = packing.tokenized(F.col("text"))
    rows = _t(spark, d, "documents").select("source", ids.alias("ids"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(packing.within_token_budget(F.col("ids"), 400)).alias("within"))


# -- prompts and conversations ------------------------------------------------------------------------------------------


def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    out = prompts.prompt_rows(_t(spark, d, "exam_item"), PROMPT, F.col("item_id").cast("string"), "exam_item")
    return out.select("sample_id", F.md5("prompt").alias("prompt"), "answer", "answer_len", "question_type", "source_question_type", "exam_subject", "prompt_version", "reject_reason")


def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    m = prompts.chat_prompt(SYSTEM, F.col("question"))
    return _t(spark, d, "sft_row").select("row_id", F.md5(_joined(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])))).alias("messages"))


def _turns_text(c: Column) -> Column:
    return F.md5(_joined(F.transform(c, lambda t: F.concat(t["from"], F.lit(":"), F.coalesce(t["value"], F.lit(""))))))


def solution_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "sft_row")
    renamed = dialog.conversations_only(rows.select(F.struct("row_id", prompts.solution_conversation(F.col("question"), F.col("answer"), "Think step by step.").alias("c")).alias("items")))
    return renamed.select("conversations.row_id", _turns_text(F.col("conversations.c")).alias("turns"))


def answer_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Direct answers, reasoned answers and instructions made of the same rows."""
    rows = _t(spark, d, "sft_row").withColumn("c", dialog.turns(("human", F.coalesce("question", F.lit(""))), ("gpt", F.lit("?"))))
    keys = F.array_sort(F.map_keys("options"))
    return rows.select(
        "row_id", _turns_text(dialog.with_direct_answer(F.col("c"), F.col("answer"), keys)).alias("direct"),
        _turns_text(dialog.with_reasoning(F.col("c"), F.coalesce("difficulty", F.lit("-")), F.coalesce("answer", F.lit("")), F.lit("?"))).alias("reasoned"),
        _turns_text(dialog.instruction_conversation(F.coalesce("question", F.lit("")), F.coalesce("exam_type", F.lit(" ")), F.coalesce("answer", F.lit("")))).alias("instruction"),
    )


def source_formats(spark: SparkSession, d: str) -> DataFrame:
    c = dialog.turns(("human", F.lit("q")), ("gpt", F.col("completion")))
    given = F.when(F.col("reward_id") % 5 == 0, F.lit("given"))
    rows = staged(_t(spark, d, "choice_reward").select("completion", given.alias("given")), {"c": c})
    rows = staged(rows, {"format": dialog.source_format(F.col("c"), F.col("given")), "last": dialog.assistant_text(F.col("c"))})
    return rows.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("last")).alias("chars"))


def usable_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Messages of dialogues: whether usable, split from a system text, as pairs of three kinds, and their last turns."""
    turns = dialog.spoken_turns(F.col("text"), {"患者": "human", "医生": "gpt"})
    rows = cut(_t(spark, d, "documents").where("doc_type = 'dialogue'").select("doc_id", turns.alias("c")))
    m = dialog.messages_of(F.concat(dialog.turns(("system", F.lit("s"))), F.col("c")))
    split = dialog.system_and_rest(m)
    return rows.select(
        "doc_id", F.coalesce(F.size(dialog.usable_messages(m)), F.lit(-1)).alias("usable"), split["system"].alias("system"), F.size(split["rest"]).alias("rest"),
        F.size(dialog.paired(split["rest"], True)).alias("dangling_pairs"), F.coalesce(F.size(dialog.strictly_paired(F.col("c"))), F.lit(-1)).alias("strict_pairs"),
        _joined(F.transform(dialog.last_turns(F.col("c"), 2), lambda t: t["from"])).alias("last_roles"),
    )


def numbered_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Options as numbered quotations within a budget, and items read back from a numbered list."""
    values = F.transform(choices.sorted_entries(F.col("options")), lambda e: F.coalesce(e["value"], F.lit("")))
    listed = F.array_join(F.transform(values, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n\n")
    rows = _t(spark, d, "sft_row").where("options is not null")
    return rows.select("row_id", F.md5(chunks.numbered_context(values, 60)).alias("context"), F.size(dialog.numbered_items(listed)).alias("n_items"))


def preference_texts(spark: SparkSession, d: str) -> DataFrame:
    p = dialog.preference_texts(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")), F.lit("不知道"))
    echo = templates.without_echo(p["chosen_text"], F.coalesce("question", F.lit("")))
    return _t(spark, d, "sft_row").select("row_id", F.md5(p["chosen_text"]).alias("chosen"), F.md5(p["rejected_text"]).alias("rejected"), echo.alias("reply"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls written in five dialects, and read back from three of them."""
    calls = F.array(F.struct(F.lit("look_up").alias("name"), F.concat(F.lit('{"id": '), F.col("row_id").cast("string"), F.lit("}")).alias("arguments")))
    rows = cut(_t(spark, d, "sft_row").select("row_id", *[templates.call_text(calls, x).alias(x) for x in templates.DIALECTS]))
    read = [templates.extracted_calls(F.col(x), x)[0]["arguments"].alias(f"{x}_read") for x in ("default", "mistral", "qwen")]
    return rows.select("row_id", *templates.DIALECTS, *read, templates.observation_text(F.col("row_id").cast("string"), "qwen").alias("observation"))


# -- replies of teachers ------------------------------------------------------------------------------------------------


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of eval_result: every fourth rejects (half of them without a reason), some hold no text or are no JSON."""
    rows = overlap.latest(_t(spark, d, "eval_result").select("eval_id", "case_text", "ground_truth", "logged_at"), "eval_id", [F.col("logged_at")])
    m = F.col("eval_id") % 8
    reply = F.to_json(
        F.struct(
            F.when(m == 0, "reject").when(m == 4, "reject").when(m == 6, "maybe").otherwise("accept").alias("decision"), F.when(m == 4, "unclear").alias("reject_reason"),
            F.when(m == 2, F.lit(" ")).otherwise(F.col("case_text")).alias("case_text"), F.when(m != 3, F.col("ground_truth")).alias("schema_target"),
        )
    )
    return rows.select("eval_id", F.try_parse_json(F.when(m == 1, F.concat(F.lit("so: "), reply)).otherwise(reply)).alias("v"))


def teacher_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = _replies(spark, d).withColumn("errors", candidates.reply_errors(F.col("v")))
    return rows.select("eval_id", candidates.reply_status(F.col("v"), F.col("errors")).alias("status"), F.array_join("errors", ",").alias("errors"))


def teacher_rewrites(spark: SparkSession, d: str) -> DataFrame:
    made = candidates.rewritten(_replies(spark, d), "v", REWRITE_SUFFIX, ["eval_id"])
    target = F.parse_json(F.get("conversations", F.lit(1))["value"])
    return made.select(
        "eval_id", "sft_reject_reason", F.md5(F.get("conversations", F.lit(0))["value"]).alias("asked"), F.try_variant_get(target, "$.primary_diagnosis", "string").alias("diagnosis"),
        F.coalesce(F.size(F.try_variant_get(target, "$.risk_flags", "array<string>")), F.lit(-1)).alias("n_risks"),
    )


def nested_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _replies(spark, d).withColumn("top", F.when(F.col("eval_id") % 3 == 0, F.parse_json(F.lit('{"primary_diagnosis": "own"}'))).when(F.col("eval_id") % 3 == 1, F.parse_json(F.lit("{}"))))
    return candidates.nested_target(rows, "top", "v").select("eval_id", F.try_variant_get("target", "$.primary_diagnosis", "string").alias("diagnosis"))


def screening_replies(spark: SparkSession, d: str) -> DataFrame:
    """Screening replies made of rewards: scores in and out of range, reasons too short."""
    rows = overlap.latest(_t(spark, d, "choice_reward").select("reward_id", "extra_count", "missing_count", "answer_label_count", "gold", "exact_match", "logged_at"), "reward_id", [F.col("logged_at")])
    reply = F.to_json(
        F.struct(
            F.when(F.col("exact_match"), "keep").otherwise("drop").alias("decision"), (F.col("extra_count") * 4).alias("cot_worthiness_score"), F.col("missing_count").alias("reasoning_need_score"),
            F.lit(1).alias("case_richness_score"), F.col("answer_label_count").alias("option_confusion_score"), F.lit(0).alias("rote_recall_penalty"), F.lit(1).alias("definition_penalty"),
            F.repeat(F.coalesce("gold", F.lit("")), F.lit(5)).alias("reason"), F.array(F.lit("A b"), F.lit("ab")).alias("tags"),
        )
    )
    out = candidates.screening(rows.select("reward_id", reply.alias("reply")), "reply")
    return out.select("reward_id", "status", "decision", "cot_worthiness_score", "derived_score", _joined(F.col("tags")).alias("tags"), F.array_join("errors", ",").alias("errors"))


def reasoning_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = overlap.latest(_t(spark, d, "eval_result").select("eval_id", "department", "is_overconfident", "json_compliant", "logged_at"), "eval_id", [F.col("logged_at")])
    kinds = pool.reasoning_types(
        F.lit("general_internal_medicine"), F.when(F.col("is_overconfident"), "urgent").otherwise("routine"), F.when(F.col("eval_id") % 2 == 0, "atypical_presentation"),
        F.when(~F.col("json_compliant"), "partially_missing"),
    )
    return rows.select("eval_id", F.array_join(kinds, ",").alias("kinds"))


def boxed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers put into a box, a fence and a reply, and taken out again."""
    a = F.coalesce("answer", F.lit(""))
    choice = F.array(F.struct(F.struct(a.alias("content")).alias("message")))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(a.alias("a"))), F.lit("\n```"))
    return _t(spark, d, "sft_row").select(
        "row_id", jsonx.boxed_answer(F.concat(F.lit("so \\boxed{x} or \\boxed{{"), a, F.lit("}} is it"))).alias("boxed"), jsonx.first_choice_content(choice).alias("content"),
        F.try_variant_get(jsonx.teacher_json(fenced), "$.a", "string").alias("read"), F.size(choices.options_of(F.lit(None).cast("map<string,string>"), F.col("options"))).alias("n_options"),
    )


def react_turns(spark: SparkSession, d: str) -> DataFrame:
    """Completions as replies that call a tool, folded with its result into one turn, and the call read back."""
    call = F.when(F.col("reward_id") % 2 == 0, "check")
    m = lambda role, content, name=None: F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast("string") if name is None else name).alias("call_name"), F.col("pred").alias("call_arguments"))
    messages = F.array(m("user", F.lit("q\n")), m("assistant", F.col("completion"), call), m("function", F.col("gold")))
    rows = cut(_t(spark, d, "choice_reward").where("not contains(completion, '\nAction')").select("reward_id", "logged_at", react.folded(messages, True).alias("t")))
    text_of = F.get("t", F.lit(1))["content"]
    rows = staged(rows, {"reply": text_of, "p": react.parsed(text_of)})
    return rows.select("reward_id", "logged_at", F.size("t").alias("n_turns"), F.md5("reply").alias("turn"), "p.call_name", "p.call_arguments")


# -- tokens, ranks and reports ------------------------------------------------------------------------------------------


def token_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with ends kept, padding, and labels of one question and answer, over one id a character."""
    rows = cut(_t(spark, d, "sft_row").select("row_id", packing.tokenized(F.col("question")).alias("q"), packing.tokenized(F.col("answer")).alias("a")))
    turn = F.array(F.struct(F.col("q").alias("source"), F.col("a").alias("target")))
    s, p = packing.supervised(turn, 100, 0), packing.padded(F.col("q"), 64, 0)
    return rows.select(
        "row_id", F.size(packing.with_ends_kept(F.col("q"), 16)).alias("blocks"), F.aggregate(p["attention_mask"], F.lit(0), lambda x, y: x + y).alias("unpadded"), F.size(p["input_ids"]).alias("padded"),
        F.size(s["input_ids"]).alias("ids"), packing.has_trained_labels(s["labels"]).alias("trained"),
    )


def shifted_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "choice_reward").select("source", packing.tokenized(F.col("pred")).alias("p"), packing.tokenized(F.col("gold")).alias("g"))
    s = profile.shifted_accuracy(F.col("p"), F.col("g"), ord("A"))
    return rows.groupBy("source").agg(F.sum(s["right"]).alias("hits"), F.sum(s["counted"]).alias("counted"))


def reward_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return profile.perplexity(_t(spark, d, "choice_reward"), F.abs("final_reward"), F.col("chinese_char_count"))


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").where(F.col("text").rlike("[一-鿿]")).select("doc_id", "text")
    return chunks.chunk_rows(rows, "doc_id", "text").select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


def assertive_words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", _joined(evaluation.overconfidence_signals(F.col("text"))).alias("signals"))


def conversation_totals(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("row_id") % 7 > 0, dialog.turns(("human", F.col("question")), ("gpt", F.when(F.col("row_id") % 5 > 0, F.coalesce("answer", F.lit(""))))))
    return dialog.validity_totals(_t(spark, d, "sft_row").select(c.alias("c")), "c")


def rows_outside(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id, or question where they have none, is not among the even ones."""
    rows = _t(spark, d, "sft_row").select("row_id", dialog.row_key(F.when(F.col("row_id") % 3 > 0, F.col("sample_id")), F.col("question")).alias("k"))
    return rows.join(rows.where("row_id % 2 = 0").select("k").distinct(), "k", "left_anti").select("row_id")


def tail_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head_and_tail(_t(spark, d, "sft_row").select("row_id"), [F.col("row_id")], "row_id", 0.1)


def zipped_slots(spark: SparkSession, d: str) -> DataFrame:
    """Units of the quotas of one mix, each with a document of its own."""
    units = sampling.expanded_quotas(_t(spark, d, "mix_target").where("mix_id = 1"), "source", "max_repeats").withColumn("u", F.concat_ws("#", "source", "unit"))
    n = units.count()
    docs = sampling.top_k(_t(spark, d, "documents").select("doc_id"), [F.col("doc_id")], n).drop("rank")
    return sampling.zipped(units, docs, [F.col("u")], [F.col("doc_id")], "u", "doc_id").select("place", "u", "doc_id")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.length("question") < 30, "short")
    out = decision(bad, F.length("question").cast("string"), F.array(F.lit("R-2"), F.col("exam_type"), F.lit("R-1"), F.lit("R-2")))
    return _t(spark, d, "exam_item").where("exam_type is not null").select("item_id", out["reason"].alias("reason"), out["detail"].alias("detail"), _joined(out["hit_rules"]).alias("hit_rules"))


def shuffled_head(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(_t(spark, d, "documents").select("doc_id"), "doc_id", "shuffle").limit(100)


def held_back(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hold_back(_t(spark, d, "documents").select("doc_id", "source"), [F.desc("doc_id")], 50)


def random_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_pairs(_t(spark, d, "documents"), _t(spark, d, "sft_row"), "doc_id", "row_id", "pair").select("left_id", "right_id")


def quota_units(spark: SparkSession, d: str) -> DataFrame:
    return sampling.expanded_quotas(_t(spark, d, "mix_target").where("mix_id = 1"), "source", "max_repeats")


def merged_words(spark: SparkSession, d: str) -> DataFrame:
    subjects = _t(spark, d, "exam_item").where("exam_subject is not null").groupBy("exam_subject").agg(F.count(F.lit(1)).alias("n"))
    ranked = subjects.select(F.col("exam_subject").alias("w"), F.col("n").alias("f"))
    labels = _t(spark, d, "question_type_alias").select(F.col("label_variant").alias("w"), F.lit(0).cast("long").alias("f"))
    return pool.merged_vocabulary([(labels, None), (ranked, 20)], "w", "f")


def bucket_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "exam_item").select("item_id", scoring.exam_difficulty(F.col("question"), F.col("question_type")).alias("level"))
    plan = spark.createDataFrame([("easy", 50), ("hard", 50), ("none", 10)], "level string, target int")
    return profile.target_report(rows, "level", plan, rows.where("item_id % 10 = 0")).select("level", "target", "available", "selected")


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "exam_item").select("item_id", text.without_space(F.col("question")).alias("q"))
    g = hashing.char_ngrams(F.col("q"), 2, 3, compact=False)
    return q.select("item_id", F.size(g).alias("n"), F.size(F.array_distinct(g)).alias("n_distinct"), hashing.hamming(F.col("item_id"), F.length("q").cast("long")).alias("bits"))


def layout_forms(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return _t(spark, d, "exam_item").select("item_id", F.md5(text.layout_form(q)).alias("two"), F.md5(text.layout_form(q, 1)).alias("one"))


def embedding_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the one with the next id."""
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.bround(hashing.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


# -- files ----------------------------------------------------------------------------------------------------------------

_SMALL = "doc_id long, source string, n_chars long"


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines in two goes and read again."""
    rows, path = _t(spark, d, "documents").select("doc_id", "source", "n_chars"), _folder(spark, "lines")
    sinks.write_lines(rows.where("doc_id % 2 = 0"), path)
    sinks.write_lines(rows.where("doc_id % 2 = 1"), path, append=True)
    return records.read_or_empty(spark, records.first_existing(spark, [path + "-missing", path]), _SMALL)


def file_splits(spark: SparkSession, d: str) -> DataFrame:
    """Items written by split in one pass and read again, each split by its own name."""
    path = _folder(spark, "splits")
    sinks.write_split(_t(spark, d, "exam_item").where("split is not null").select("item_id", "split", "exam_subject"), path, "split")
    return records.read_splits(spark, {s: f"{path}/split={s}" for s in ("train", "val", "test")}, "item_id long, exam_subject string")


def file_tree(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "tree")
    sinks.write_split(_t(spark, d, "documents").where("source is not null").select("doc_id", "source", "n_chars"), path, "source")
    return records.read_tree(spark, path, "*.json", "doc_id long, n_chars long")


def file_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which every fifth is broken, read by a tolerant reader."""
    path = _folder(spark, "tolerant")
    line = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.lit("}")))
    _t(spark, d, "documents").select(line.alias("value")).write.text(path)
    return records.read_records(spark, path, "doc_id long", tolerant=True)


def file_array(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array turned into lines."""
    source, target = _folder(spark, "array"), _folder(spark, "array-lines")
    rows = _t(spark, d, "question_type_alias")
    spark.createDataFrame([(sinks.pretty_json(rows),)], "value string").coalesce(1).write.text(source)
    sinks.array_to_lines(spark, source, target)
    return records.named_sets(spark, [f"alias={target}", f"gone={target}-gone"])["alias"].select("label_variant", "question_type")


def file_tabbed(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "tabbed")
    _t(spark, d, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("value")).write.text(path)
    return records.read_tabbed(spark, path, ["n_nationkey", "n_name"])


def file_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Rows found again by path and line number, with columns of the file joined to them."""
    path = _folder(spark, "numbered")
    sinks.write_lines(_t(spark, d, "question_type_alias").orderBy("label_variant"), path, one_file=True)
    lines = cut(records.read_numbered_lines(spark, path, "label_variant string, question_type string"))
    wanted = lines.where("line_no % 2 = 1").select("path", "line_no")
    return overlap.hydrated(wanted, lines, ["path", "line_no"]).select("line_no", "label_variant", "question_type")


def file_index(spark: SparkSession, d: str) -> DataFrame:
    """A table by department, of which later reads see one folder."""
    path = _folder(spark, "index")
    sinks.write_index(_t(spark, d, "documents").select("doc_id", F.coalesce("dept", F.lit("none")).alias("dept"), "n_chars"), path, ["dept"])
    return spark.read.parquet(path).groupBy("dept").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text files with their line ends kept, and digests of the files' heads."""
    path = _folder(spark, "texts")
    _t(spark, d, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(path)
    lines = records.read_lines(spark, path, keep_linebreaks=True)
    counts = {"files": records.content_digests(spark, f"{path}/*.txt"), "lines": records.read_text_or_lines(spark, [f"{path}/*.txt"])}
    out = lines.select("text", F.lit(1).cast("long").alias("n"))
    for name, rows in counts.items():
        out = out.unionByName(rows.agg(F.lit(name).alias("text"), F.count(F.lit(1)).alias("n")))
    return out


QUERIES = [v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]
