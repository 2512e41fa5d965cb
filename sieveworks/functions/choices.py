"""Options, answers and their extraction from completions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.text import clean, last_line, stripped

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A label, then the rest of its line.
ANSWER_LINE = r"答案\s*[:：]\s*([^\n\r]*)"
#: A label, then letters and what separates them.
LETTERS_LINE = r"答案\s*[:：]\s*([A-Za-z,\s，、/]+)"
_NO_MAP = "map<string,string>"


def options_of(options: Column, option: Column | None = None, truthy: bool = False) -> Column:
    """One map of two spellings: the first if it is there, or with ``truthy`` if it has entries, else the second."""
    if option is None:
        return F.coalesce(options, F.create_map().cast(_NO_MAP))
    use = options.isNotNull() if not truthy else options.isNotNull() & (F.size(options) > 0)
    return F.coalesce(F.when(use, options), option, F.create_map().cast(_NO_MAP))


def sorted_entries(options: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(options, F.create_map().cast(_NO_MAP))))


def lettered_options(options: Column) -> Column:
    """Entries with a single letter for a key, letter in upper case, value stripped, in the order of letters; of equal letters the last.

    No such entry gives null.
    """
    entries = F.transform(sorted_entries(options), lambda e: F.struct(F.upper(F.trim(e["key"])).alias("key"), stripped(e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: e["key"].rlike("^[A-Z]$"))
    letters = F.array_sort(F.array_distinct(F.transform(kept, lambda e: e["key"])))
    last = F.transform(letters, lambda k: F.struct(k.alias("key"), F.try_element_at(F.filter(kept, lambda e: e["key"] == k), F.lit(-1))["value"].alias("value")))
    return F.when(F.size(letters) > 0, F.map_from_entries(last))


def rendered_options(options: Column) -> Column:
    """``A. value`` lines in the order of keys."""
    return F.array_join(F.transform(sorted_entries(options), lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))), "\n")


def _chars(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))


def strict_answer(answer: Column, keys: Column) -> Column:
    """The answer if it is a key or made of keys only, each once in their order; else empty."""
    text = F.upper(clean(answer))
    found = F.filter(_chars(text), lambda c: F.array_contains(keys, c))
    whole = F.array_contains(keys, text) & (text != "")
    return F.when(whole, text).when((F.size(found) > 0) & (F.size(found) == F.length(text)), F.array_join(F.array_distinct(found), "")).otherwise("")


def lenient_answer(answer: Column, keys: Column) -> Column:
    """Characters that are keys, each once, in their order."""
    return F.array_join(F.array_distinct(F.filter(_chars(F.upper(stripped(answer))), lambda c: F.array_contains(keys, c))), "")


def sorted_letters(value: Column, valid: Column | None = None) -> Column:
    """Letters among the valid ones (A to Z if null), each once, in the order of the alphabet."""
    every = F.array(*map(F.lit, LETTERS))
    allowed = every if valid is None else F.coalesce(F.when(F.size(valid) > 0, F.transform(valid, lambda v: F.upper(F.trim(v)))), every)
    found = F.filter(_chars(F.upper(F.coalesce(value, F.lit("")))), lambda c: c.rlike("^[A-Z]$") & F.array_contains(allowed, c))
    return F.array_join(F.array_sort(F.array_distinct(found)), "")


def answer_labels(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANSWER_LINE), F.lit(1))


def extracted_v1(text: Column, valid: Column | None = None) -> Column:
    """Letters of the last answer label, else those of a short last line."""
    captures = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTERS_LINE), F.lit(1))
    line = last_line(text)
    return F.when(F.size(captures) > 0, sorted_letters(F.try_element_at(captures, F.lit(-1)), valid)).otherwise(
        F.when((line != "") & (F.length(line) <= 32), sorted_letters(line, valid)).otherwise("")
    )


def extracted_v2(text: Column, valid: Column | None = None) -> Column:
    """struct(pred, valid_extract, label_count, used_fallback, extra_text).

    ``extra_text``: letters, digits or ideographs follow the answer's last
    letter, on its line or on later lines.
    """
    body = stripped(text)
    captures = answer_labels(body)
    n = F.size(captures)
    tail = F.try_element_at(captures, F.lit(-1))
    line = last_line(body)
    labelled = sorted_letters(tail, valid)
    short = (n == 0) & (line != "") & (F.length(line) <= 32)
    pred = F.when(n > 0, labelled).when(short, sorted_letters(line, valid)).otherwise("")
    after_letter = F.regexp_replace(tail, r"^.*[A-Za-z]", "")
    after_line = F.regexp_replace(body, r"(?s)^.*答案\s*[:：]\s*[^\n\r]*", "")
    extra = (n > 0) & F.concat(F.when(tail.rlike("[A-Za-z]"), after_letter).otherwise(tail), after_line).rlike("[一-鿿A-Za-z0-9]")
    return F.struct(
        pred.alias("pred"), (pred != "").alias("valid_extract"), F.when(body == "", 0).otherwise(n).alias("label_count"), short.alias("used_fallback"),
        F.coalesce(extra, F.lit(False)).alias("extra_text"),
    )


def before_answer(text: Column) -> Column:
    """What stands before the last answer label; the whole text if there is none."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(t, r"(?s)^(.*)答案\s*[:：]", 1)
    return stripped(F.when(t.rlike(r"答案\s*[:：]"), found).otherwise(t))


def set_measures(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, extra, missing) of two strings of letters; an empty side has zeros."""
    p, g = F.array_distinct(_chars(pred)), F.array_distinct(_chars(gold))
    hit = F.size(F.array_intersect(p, g))
    usable = (F.size(p) > 0) & (F.size(g) > 0)
    zero = F.lit(0.0)
    precision = F.when(usable, F.try_divide(hit, F.size(p))).otherwise(zero)
    recall = F.when(usable, F.try_divide(hit, F.size(g))).otherwise(zero)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(zero)
    return F.struct(
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.size(F.array_except(p, g)).alias("extra"), F.size(F.array_except(g, p)).alias("missing")
    )


def difficulty_of(value: Column, known: tuple[str, ...] = ("direct", "brief", "cot"), otherwise: str = "brief") -> Column:
    v = F.lower(stripped(value))
    return F.when(v.isin(*known), v).otherwise(otherwise)


def is_multi(question_type: Column, answer: Column) -> Column:
    return F.contains(F.coalesce(question_type, F.lit("")), F.lit("多项选择题")) | (F.length(F.upper(stripped(answer))) > 1)


def length_bucket(answer: Column) -> Column:
    n = F.length(answer)
    return F.when(n == 1, F.lit("single")).otherwise(F.concat(F.lit("multi_"), n.cast("string")))
