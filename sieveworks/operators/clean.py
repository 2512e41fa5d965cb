"""Validation cascade, flags and exact deduplication of exam items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import choices, text
from sieveworks.functions.rules import all_hits, first_hit, staged
from sieveworks.operators.sampling import hash_sample
from sieveworks.session import cut

DUPLICATE = "duplicate_normalized_question_options"


def options_signature(entries: Column, normal: bool = True) -> Column:
    """``key=value`` in comparison form, in the order of the raw keys, joined by bars."""
    return F.array_join(
        F.transform(entries, lambda e: F.concat(text.comparison_form(e["key"], normal), F.lit("="), text.comparison_form(e["value"], normal))), "|"
    )


def cleaned(items: DataFrame, question: str = "question", options: str = "options", answer: str = "answer") -> DataFrame:
    """``items`` with q, opts (sorted array of key and value), ans, reject_reason before deduplication, and clean_flags.

    Texts get the compatibility form once, as one array per row, so that one
    call to Python serves a row. Reasons are tested in a fixed order and the
    first that holds is kept; null options count as no map. Other columns are
    kept as they are.
    """
    none = F.array().cast("array<string>")
    keys, values = F.coalesce(F.map_keys(options), none), F.coalesce(F.map_values(options), none)
    sep = "␞"
    packed = F.array_join(F.transform(F.concat(F.array(F.col(question), F.col(answer)), keys, values), lambda x: F.coalesce(x, F.lit(""))), sep)
    parts = F.transform(F.split(text.nfkc(packed), sep), text.stripped)
    n = F.when(F.col(options).isNull(), 0).otherwise(F.size(options))
    out = items.withColumn("__p", parts).withColumn("__n", n)
    entries = F.zip_with(
        F.slice("__p", 3, F.col("__n")), F.slice("__p", F.col("__n") + 3, F.col("__n")), lambda k, v: F.struct(F.upper(k).alias("key"), v.alias("value"))
    )
    out = staged(out, {"q": F.col("__p")[0], "raw_ans": F.upper(F.col("__p")[1]), "opts": F.array_sort(entries)})
    option_keys = F.transform("opts", lambda e: e["key"])
    chars = F.when(F.length("raw_ans") > 0, F.split("raw_ans", "")).otherwise(none)
    found = F.filter(chars, lambda c: F.array_contains(option_keys, c))
    ans = F.when(F.array_contains(option_keys, F.col("raw_ans")), F.col("raw_ans")).when(
        (F.size(found) > 0) & (F.size(found) == F.length("raw_ans")), F.array_join(F.array_distinct(found), "")
    )
    out = staged(out, {"ans": F.coalesce(ans, F.lit(""))})
    value_of = lambda k: F.element_at(F.filter("opts", lambda e: e["key"] == k), 1)["value"]
    empty_correct = F.exists(F.when(F.length("ans") > 0, F.split("ans", "")).otherwise(none), lambda c: F.coalesce(value_of(c), F.lit("")) == "")
    special = F.regexp_count("q", F.lit(r"(?U)[^\p{L}\p{N}\s]")) / F.length("q")
    reasons = [
        ("missing_question", F.col("q") == ""),
        ("option_not_dict", F.col(options).isNull()),
        ("options_too_few", F.size("opts") < 3),
        ("missing_answer", F.col("raw_ans") == ""),
        ("invalid_answer", F.col("ans") == ""),
        ("empty_correct_option", empty_correct),
        ("garbled_question", text.garbled_ratio(F.col("q")) > 0.02),
        ("question_too_long", F.length("q") > 800),
        ("special_ratio_too_high", (special > 0.60) & (F.length("q") > 20)),
    ]
    flags = [
        ("short_question_retained", F.length("q") < 5),
        ("empty_non_answer_option_retained", F.exists("opts", lambda e: (e["value"] == "") & ~F.contains(F.col("ans"), e["key"]))),
    ]
    return staged(out, {"reject_reason": first_hit(reasons), "clean_flags": all_hits(flags)}).drop("__p", "__n", "raw_ans")


def signature(normal: bool = False) -> Column:
    """Digest of question and options of a cleaned row, under which rows count as duplicates."""
    return F.sha1(F.concat(text.comparison_form(F.col("q"), normal), F.lit("||"), options_signature(F.col("opts"), normal)))


def clean_and_deduplicate(items: DataFrame, order_by: str = "item_id", **columns: str) -> DataFrame:
    """``cleaned`` with duplicates rejected: of the accepted rows with one signature the first by ``order_by`` stays.

    Only rows that passed all other rules can shadow a later one. The cascade
    runs once, before a cut. Every row has a key of its own, drawn at the cut, so
    rows with equal ``order_by`` (or null, which comes last) are told apart and
    just one stays. The first of each signature is found by aggregation with
    map-side combine and joined by that key, which no signature makes hot.
    """
    return _first_wins(cut(_signed(items, **columns)), order_by).drop("__sig", "__row")


def _signed(items: DataFrame, **columns: str) -> DataFrame:
    return cleaned(items, **columns).withColumns({"__sig": F.when(F.col("reject_reason").isNull(), F.unhex(signature())), "__row": F.monotonically_increasing_id()})


def _first_wins(rows: DataFrame, order_by: str) -> DataFrame:
    firsts = rows.where("__sig is not null").groupBy("__sig").agg(F.min(F.struct(F.col(order_by).isNull(), order_by, "__row")).alias("f")).select(F.col("f.__row").alias("__keep"))
    marked = rows.join(firsts, F.col("__row") == F.col("__keep"), "left")
    duplicate = F.col("reject_reason").isNull() & F.col("__keep").isNull()
    return marked.withColumn("reject_reason", F.when(duplicate, DUPLICATE).otherwise(F.col("reject_reason"))).drop("__keep")


def reject_counts(items: DataFrame, order_by: str = "item_id", **columns: str) -> DataFrame:
    """(reject_reason, n); only reasons and digests of rows are kept on the way, not their texts."""
    slim = cut(_signed(items, **columns).select(order_by, "reject_reason", "__sig", "__row"))
    counts = _first_wins(slim, order_by).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts


def duplicate_groups(keyed: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, n, first_id) of keys with several rows."""
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def best_of_group(rows: DataFrame, key: str, id_col: str, quality: list[Column]) -> DataFrame:
    """(id, kept_id, is_kept): of each key the row with the greatest quality, of equals the one with the least id.

    The best is a map-side aggregate (``max_by`` of a struct), then joined to
    the rows; AQE splits the join where a key is hot.
    """
    rank = F.struct(*quality, (-F.col(id_col)).alias("__neg"))
    best = rows.groupBy(key).agg(F.max_by(F.col(id_col), rank).alias("kept_id"))
    return rows.join(best, rows[key].eqNullSafe(best[key])).select(rows[id_col], "kept_id", (rows[id_col] == F.col("kept_id")).alias("is_kept"))


def rendered(row_options: Column) -> Column:
    return choices.rendered_options(row_options)


def raw_signature(question: Column, options: Column) -> Column:
    """Question and options as JSON with sorted keys, nothing normalised; null options count as none."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    entries = F.transform(choices.sorted_entries(options), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit('{"o": {'), F.array_join(entries, ", "), F.lit('}, "q": '), quoted(F.coalesce(question, F.lit(""))), F.lit("}"))


def duplicate_views(keyed: DataFrame, views: Sequence[str]) -> DataFrame:
    """(view, groups, rows_in_groups, duplicate_rows) of several signatures of the same rows."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.md5(v).alias("key")) for v in views])).alias("s")
    groups = keyed.select(each).groupBy("s.view", "s.key").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    total = lambda c: F.coalesce(F.sum(F.when(many, c)), F.lit(0))
    return groups.groupBy("view").agg(F.count_if(many).alias("groups"), total(F.col("n")).alias("rows_in_groups"), total(F.col("n") - 1).alias("duplicate_rows"))


def has_basics(question: Column, options: Column, answer: Column) -> Column:
    """Question and answer are there, and three options."""
    there = lambda x: F.coalesce(x, F.lit("")) != ""
    return there(question) & there(answer) & (F.coalesce(F.cardinality(options), F.lit(0)) >= 3)


def filtered(items: DataFrame, quality: Column, difficulty: Column, id_col: str, least_quality: float = 0.0, only: str | None = None, most: int | None = None, seed: str = "42") -> DataFrame:
    """Rows with ten characters of question, three options, the least quality and the one difficulty; if more than ``most``, a sample of so many."""
    kept = items.where((F.length("question") >= 10) & (F.coalesce(F.cardinality("options"), F.lit(0)) >= 3) & (quality >= least_quality))
    if only is not None:
        kept = kept.where(difficulty == only)
    return kept if most is None else hash_sample(kept, id_col, most, seed)


def sample_id_of(sample_id: Column, other_id: Column, rank: Column, index: Column) -> Column:
    """The first id that is there: the row's, its other one, its rank less one, its place."""
    return F.coalesce(sample_id.cast("string"), other_id.cast("string"), (rank.try_cast("long") - 1).cast("string"), index.cast("string"))
