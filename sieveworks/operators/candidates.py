"""Candidate records: building, validation of structured targets and of teachers' replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import jsonx, text
from sieveworks.functions.choices import sorted_entries
from sieveworks.functions.rules import all_hits, first_hit, staged
from sieveworks.operators.dialog import turns
from sieveworks.operators.skew import lookup
from sieveworks.session import cut

LISTS = ("diagnostic_basis", "differential_diagnoses", "recommended_actions", "risk_flags")
# Words that put a question and answer into a block of a case, in order of precedence.
BLOCK_WORDS = {
    "differential": ("鉴别", "相鉴别"),
    "diagnosis": ("诊断", "诊断依据", "诊断要点", "最可能"),
    "treatment_or_action": ("治疗", "处理", "检查", "决策", "原则"),
}
# Fields of a structured target and how many items its lists have at least; the error of one that falls short.
LEAST_ITEMS = {"diagnostic_basis": (2, "too_short"), "differential_diagnoses": (1, "empty"), "recommended_actions": (1, "empty"), "risk_flags": (1, "empty")}


def candidate(sample_id: Column, split: Column, route: Column, case: Column, dataset: Column, flags: Column) -> Column:
    """Record of a case with the digest and length of its layout form."""
    body = text.layout_form(case)
    return F.struct(
        sample_id.alias("sample_id"), split.alias("split"), route.alias("route"), body.alias("case_text"), F.struct(dataset.alias("dataset")).alias("source"), flags.alias("quality_flags"),
        F.struct(F.sha1(body).alias("case_text_hash"), F.length(body).alias("case_text_chars")).alias("audit"),
    )


def exam_case_text(question: Column, options: Column) -> Column:
    lines = F.transform(sorted_entries(options), lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit(""))))
    return text.stripped(F.array_join(F.concat(F.array(F.coalesce(question, F.lit(""))), lines), "\n"))


def exam_answer_text(answer: Column, options: Column) -> Column:
    """``key. value`` if the answer is one key, else the answer."""
    key = text.stripped(answer)
    value = F.try_element_at(options, key)
    return F.when(value.isNotNull(), F.concat(key, F.lit(". "), value)).otherwise(key)


def input_style(case: Column) -> Column:
    t = F.coalesce(case, F.lit(""))
    return first_hit([("semi_structured_case", t.rlike("现病史|体格检查|辅助检查")), ("exam_case", t.rlike("[A-E][.．、]"))], "patient_narrative")


def block_of(question: Column, answer: Column) -> Column:
    joined = F.concat_ws("\n", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
    return first_hit([(name, text.any_hint(joined, words)) for name, words in BLOCK_WORDS.items()], "other")


def target_errors(target: Column) -> Column:
    """What is wrong with a structured target, a struct: no diagnosis, lists too short or with a blank item."""
    blank = lambda x: text.stripped(x) == ""
    checks = [("primary_diagnosis_empty", blank(target["primary_diagnosis"]))]
    for f, (n, error) in LEAST_ITEMS.items():
        items = F.coalesce(target[f], F.array().cast("array<string>"))
        checks.append((f"{f}_{error}", (F.size(items) < n) | F.exists(items, blank)))
    return F.when(target.isNull(), F.array(F.lit("schema_target_not_object"))).otherwise(all_hits(checks))


def _is_text(v: Column, path: str = "$") -> Column:
    """A VARIANT's part is a string with more than white space."""
    return F.coalesce((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING") & (text.stripped(F.try_variant_get(v, path, "string")) != ""), F.lit(False))


def json_target_errors(target: Column, known_only: bool = False) -> Column:
    """``target_errors`` of a VARIANT, where items must be strings; unless ``known_only``, unknown fields are errors too."""
    is_object = F.coalesce(F.startswith(F.schema_of_variant(target), F.lit("OBJECT")), F.lit(False))
    checks = [("primary_diagnosis_empty", ~_is_text(target, "$.primary_diagnosis"))]
    for f, (n, error) in LEAST_ITEMS.items():
        items = F.try_variant_get(target, f"$.{f}", "array<variant>")
        checks.append((f"{f}_{error}", ~F.coalesce((F.size(items) >= n) & F.forall(items, lambda x: _is_text(x)), F.lit(False))))
    found = all_hits(checks)
    if not known_only:
        names = F.coalesce(F.json_object_keys(F.to_json(target)), F.array().cast("array<string>"))
        unknown = F.filter(names, lambda k: ~k.isin("primary_diagnosis", *LISTS))
        found = F.concat(found, F.transform(unknown, lambda k: F.concat(F.lit("unknown_schema_field:"), k)))
    return F.when(is_object, found).otherwise(F.array(F.lit("schema_target_not_object")))


def nested_target(rows: DataFrame, top: str, reply: str) -> DataFrame:
    """``rows`` with target (VARIANT): that of the row if it has a diagnosis, else that of the teacher's reply; rows with neither are left out."""
    has = lambda v: F.coalesce(F.try_variant_get(v, "$.primary_diagnosis", "string"), F.lit("")) != ""
    inner = F.try_variant_get(F.col(reply), "$.schema_target", "variant")
    return rows.withColumn("target", F.when(has(F.col(top)), F.col(top)).when(has(inner), inner)).where("target is not null")


def repeated_diagnosis(target: Column) -> Column:
    """The primary diagnosis, without hedges, is one of the differentials."""
    own = text.without_hedges(target["primary_diagnosis"])
    return (own != "") & F.exists(F.coalesce(target["differential_diagnoses"], F.array().cast("array<string>")), lambda d: text.without_hedges(d) == own)


def joint_text(case: Column, target: Column) -> Column:
    """Case text and target as one text, under which candidates count as the same."""
    return F.concat_ws("\n", text.layout_form(case, 1), F.to_json(target))


def screening(rows: DataFrame, reply: str) -> DataFrame:
    """``rows`` with decision, clamped scores, derived score, tags, errors and status of a screening reply."""
    limits = {"cot_worthiness_score": (0, 10), "reasoning_need_score": (0, 4), "case_richness_score": (0, 2), "option_confusion_score": (0, 2), "rote_recall_penalty": (0, 2), "definition_penalty": (0, 1)}
    v = jsonx.teacher_json(F.col(reply))
    out = rows.withColumn("__v", v)
    get = lambda name, kind: F.try_variant_get(F.col("__v"), f"$.{name}", kind)
    decision = F.lower(F.trim(F.coalesce(get("decision", "string"), F.lit(""))))
    out = out.withColumns({f"__{k}": get(k, "int") for k in limits} | {"__decision": decision, "__reason": F.trim(F.coalesce(get("reason", "string"), F.lit(""))), "__tags": get("tags", "array<string>")})
    errors = [("response is not a JSON object", F.col("__v").isNull()), ("invalid decision", ~F.col("__decision").isin("keep", "drop"))]
    errors += [(f"{k} is not an int", F.col(f"__{k}").isNull()) for k in limits]
    errors += [(f"{k} out of range", ~F.col(f"__{k}").between(*b)) for k, b in limits.items()]
    errors += [("reason too short", F.length("__reason") < 10), ("tags is not a list", F.col("__tags").isNull())]
    clamped = {k: F.greatest(F.least(F.coalesce(F.col(f"__{k}"), F.lit(a)), F.lit(b)), F.lit(a)) for k, (a, b) in limits.items()}
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("__tags", F.array().cast("array<string>")), text.tag_form), lambda x: x != ""))
    out = out.withColumns({**clamped, "decision": F.when(F.col("__decision").isin("keep", "drop"), F.col("__decision")).otherwise("drop"), "tags": tags, "errors": all_hits(errors)})
    derived = F.col("reasoning_need_score") + F.col("case_richness_score") + F.col("option_confusion_score") - F.col("rote_recall_penalty") - F.col("definition_penalty")
    out = out.withColumns({"derived_score": derived, "status": F.when(F.size("errors") == 0, "ok").otherwise("invalid")})
    return out.drop("__v", "__decision", "__reason", "__tags", *[f"__{k}" for k in limits])


def rationale_errors(reply: Column, answer: Column) -> Column:
    """What is wrong with a teacher's rationale, a VARIANT with answer and analysis, for a question with a known answer."""
    analysis = text.stripped(F.try_variant_get(reply, "$.analysis", "string"))
    given = F.upper(text.stripped(F.try_variant_get(reply, "$.answer", "string")))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(reply), F.lit("OBJECT")), F.lit(False))
    changed = F.when(given != F.coalesce(answer, F.lit("")), F.concat(F.lit("teacher answer changed: "), given, F.lit(" != "), F.coalesce(answer, F.lit(""))))
    rest = all_hits([("missing analysis", analysis == ""), ("analysis contains answer label", F.contains(analysis, F.lit("答案：")) | F.contains(analysis, F.lit("标准答案"))), ("analysis too short", F.length(analysis) < 20)])
    return F.when(is_object, F.concat(F.array_compact(F.array(changed)), rest)).otherwise(F.array(F.lit("response is not a JSON object")))


def reply_errors(reply: Column) -> Column:
    """What is wrong with a teacher's reply, a VARIANT: no object, no decision, a rejection without reason, else its text and target."""
    decision = F.try_variant_get(reply, "$.decision", "string")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(reply), F.lit("OBJECT")), F.lit(False))
    one = lambda name: F.array(F.lit(name))
    none = F.array().cast("array<string>")
    target = F.try_variant_get(reply, "$.schema_target", "variant")
    of_target = json_target_errors(target, known_only=True)
    accepted = F.when(of_target == one("schema_target_not_object"), of_target).otherwise(F.concat(F.when(_is_text(reply, "$.case_text"), none).otherwise(one("case_text_empty")), of_target))
    return (
        F.when(~is_object, one("not_json_object"))
        .when(decision == "reject", F.when(_is_text(reply, "$.reject_reason"), none).otherwise(one("reject_missing_reason")))
        .when(F.coalesce(decision, F.lit("")) != "accept", one("decision_not_accept_or_reject"))
        .otherwise(accepted)
    )


def reply_status(reply: Column, errors: Column) -> Column:
    """accepted, rejected_by_teacher or invalid."""
    rejected = F.coalesce(F.try_variant_get(reply, "$.decision", "string") == "reject", F.lit(False))
    return F.when(F.size(errors) > 0, "invalid").when(rejected, "rejected_by_teacher").otherwise("accepted")


def rewritten(rows: DataFrame, reply: str, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a teacher's rewrite as training rows: conversations and sft_reject_reason, of which one is null.

    The reply is a VARIANT. The target is written as JSON with its fields in
    order and items stripped. ``keep`` names columns that training rows carry on;
    without it they are minimal.
    """
    v = F.col(reply)
    decision = F.try_variant_get(v, "$.decision", "string")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    target = F.try_variant_get(v, "$.schema_target", "variant")
    reason = (
        F.when(~is_object, F.lit("teacher_response_not_object"))
        .when(F.coalesce(decision, F.lit("None")) != "accept", F.concat(F.lit("teacher_decision:"), F.coalesce(decision, F.lit("None"))))
        .when(~_is_text(v, "$.case_text"), F.lit("case_text_empty"))
        .otherwise(F.array_join("__errors", ","))
    )
    items = lambda f: F.transform(F.try_variant_get(target, f"$.{f}", "array<string>"), text.stripped)
    written = F.to_json(F.struct(text.stripped(F.try_variant_get(target, "$.primary_diagnosis", "string")).alias("primary_diagnosis"), *[items(f).alias(f) for f in LISTS]), {"pretty": "true"})
    asked = F.concat(text.stripped(F.try_variant_get(v, "$.case_text", "string")), F.lit("\n\n" + suffix))
    out = staged(rows, {"__errors": json_target_errors(target)})
    out = out.withColumn("sft_reject_reason", F.nullif(reason, F.lit("")))
    return out.select(*keep, F.when(F.col("sft_reject_reason").isNull(), turns(("human", asked), ("gpt", written))).alias("conversations"), "sft_reject_reason")


def first_of_sources(rows: DataFrame, text_col: str, source_rank: str, order: str, flags: str) -> DataFrame:
    """``rows`` with skipped: duplicate of an earlier text (sources in the order of their rank), or of a quality that is left out.

    The first row of a text takes its place before its quality is looked at, so
    a bad first row also shadows later ones. Firsts are found by map-side
    aggregation; only digests are shuffled.
    """
    keyed = cut(rows.withColumn("__k", F.sha2(text_col, 256)))
    firsts = keyed.groupBy("__k").agg(F.min(F.struct(source_rank, order)).alias("__first"), F.count(F.lit(1)).alias("__n"))
    marked = lookup(keyed, cut(firsts), "__k", "__n")
    later = F.struct(source_rank, order) != F.col("__first")
    bad = F.exists(flags, lambda f: f.isin("too_short", "has_replacement_character"))
    return marked.withColumn("skipped", first_hit([("duplicate_case_text", later), ("invalid_quality", bad)])).drop("__k", "__first", "__n")


def prompt_record(sample_id: Column, system: str, payload: Column) -> Column:
    return F.struct(
        sample_id.alias("sample_id"), F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), payload.alias("content"))).alias("messages")
    )
