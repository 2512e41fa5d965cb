"""Lenient reading of JSON that a model wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions.text import stripped

# Names of the fields of a structured case answer, in the order in which they are looked for.
FIELD_NAMES: Mapping[str, Sequence[str]] = {
    "primary_diagnosis": ("主诊断", "主要诊断", "primary_diagnosis"),
    "diagnostic_basis": ("诊断依据", "diagnostic_basis"),
    "differential_diagnoses": ("鉴别诊断", "differential_diagnoses"),
    "recommended_actions": ("下一步建议", "recommended_actions", "建议", "处理建议"),
    "risk_flags": ("风险提示", "risk_flags", "注意事项"),
}


def without_fences(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"(?m)^```(?:json)?", ""), r"(?m)```$", ""))


def whole_json(text: Column) -> Column:
    """VARIANT of a text that is JSON to its end; the parser by itself would forgive what follows a closed value."""
    opened = text.rlike(r"^[\[{]")
    return F.try_parse_json(F.when(~opened | text.rlike(r"[\]}]$"), text))


def teacher_json(text: Column) -> Column:
    """VARIANT of a reply: without fences, else from the first to the last brace; null if neither parses."""
    body = without_fences(text)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole_json(F.when(body != "", body)), whole_json(F.when(inner != "", inner)))


def model_json(text: Column) -> Column:
    """VARIANT of an output: as it is, else from the first brace on, else without trailing commas; prose after the last brace is not forgiven."""
    whole = stripped(text)
    body = without_fences(text)
    inner = F.regexp_extract(body, r"(?s)(\{.*)$", 1)
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.coalesce(whole_json(F.when(whole != "", whole)), whole_json(F.when(inner != "", inner)), whole_json(F.when(fixed != "", fixed)))


def field(variant: Column, name: str, kind: str, names: Mapping[str, Sequence[str]] = FIELD_NAMES) -> Column:
    """First non-null value of a field under any of its names."""
    return F.coalesce(*[F.try_variant_get(variant, f'$["{n}"]', kind) for n in names[name]])


def tagged_answer(text: Column) -> Column:
    """What the first ``<answer>`` element holds; empty if there is none."""
    return stripped(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)<answer>(.*?)</answer>", 1))


def has_think_answer_form(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^<think>.*?</think><answer>.*?</answer>$")


def first_choice_content(choices: Column) -> Column:
    """``choices[0].message.content`` of a reply; any miss gives empty text."""
    return F.coalesce(F.get(choices, F.lit(0))["message"]["content"], F.lit(""))


def _boxed(text: str | None) -> str | None:
    start = (text or "").rfind("\\boxed{")
    if start < 0:
        return None
    depth, begin = 1, start + 7
    for i in range(begin, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[begin:i]
    return None


@F.pandas_udf(T.StringType())
def boxed_answer(texts: pd.Series) -> pd.Series:
    """Content of the last ``\\boxed{}``, braces matched; null if there is none or it is not closed."""
    return pd.Series([_boxed(t) for t in texts], dtype=object)
