"""Normal forms, ratios and matches of text columns.

Everything but the compatibility normal form is a built-in expression. Text that
has passed ``nfkc`` once should be kept, as it is the only step that leaves the
JVM. Null counts as empty text unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The punctuation that comparison forms leave out.
COMPARISON_PUNCTUATION = "，。、“”‘’：:；;,.!?？！（）()[]【】{}<>《》\"'`~-—_·|/\\"
# Hedges taken out of a diagnosis, in this order.
DIAGNOSIS_HEDGES = ("可能性大", "首先考虑", "倾向于", "倾向", "可能", "待排", "？", "?")

_SPACE = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; null counts as empty."""
    return _nfkc(F.coalesce(text, F.lit("")))


def char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\[]^-&" else c for c in chars) + "]"


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    return stripped(nfkc(text))


def comparison_form(text: Column, normal: bool = True) -> Column:
    """Compatibility form, lower case, no white space, no punctuation; ``normal=False`` if the text has the normal form already."""
    base = nfkc(text) if normal else F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.lower(base), _SPACE, ""), char_class(COMPARISON_PUNCTUATION), "")


def layout_form(text: Column, most_newlines: int = 2) -> Column:
    """Keeps the layout: unix line ends, single blanks, no blanks around line ends, at most ``most_newlines`` in a row."""
    t = F.regexp_replace(F.regexp_replace(nfkc(text), "\r\n?", "\n"), r"[ \t\f\x0B 　]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.regexp_replace(t, "\n{%d,}" % (most_newlines + 1), "\n" * most_newlines)
    return stripped(t)


def collapsed_lower(text: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(text)), _SPACE, " ")


def diagnosis_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s.,，。()（）、]", "")


def without_hedges(text: Column, hedges: Sequence[str] = DIAGNOSIS_HEDGES) -> Column:
    out = F.coalesce(text, F.lit(""))
    for hedge in hedges:
        out = F.replace(out, F.lit(hedge), F.lit(""))
    return without_space(out)


def tag_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z_]", "")


def without_prefix(text: Column, prefixes: Sequence[str] = ("问：", "问:", "答：", "答:", "Q：", "Q:", "A：", "A:")) -> Column:
    """The first matching prefix is removed, and blanks after it."""
    return stripped(F.regexp_replace(stripped(text), "^(?:" + "|".join(prefixes) + ")", ""))


def _ratio(text: Column, pattern: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(F.regexp_count(t, F.lit(pattern)) / F.length(t))


def garbled_ratio(text: Column) -> Column:
    """Share of replacement and control characters."""
    return _ratio(text, "[�\\x00-\\x08\\x0B-\\x1F]")


def special_ratio(text: Column) -> Column:
    """Share of characters that are no ideograph, letter, digit or white space."""
    return _ratio(text, r"(?U)[^\p{L}\p{N}\s]")


def ascii_ratio(text: Column) -> Column:
    return _ratio(text, "[A-Za-z0-9]")


def is_noisy(text: Column, most_ascii: float = 0.6) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit("�")) | (ascii_ratio(text) > most_ascii)


def ideographs(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"))


def hint_count(text: Column, hints: Sequence[str]) -> Column:
    """How many of the hints occur, each counted once."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(0)
    for hint in hints:
        out = out + F.contains(t, F.lit(hint)).cast("int")
    return out


def any_hint(text: Column, hints: Sequence[str]) -> Column:
    return hint_count(text, hints) > 0


def pattern_count(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(0)
    for pattern in patterns:
        out = out + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    return out


def distinct_matches(text: Column, pattern: str) -> Column:
    """Matches in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


def is_repetitive(text: Column) -> Column:
    """A piece of 2 to 12 letters or digits stands three times in a row."""
    return F.coalesce(text, F.lit("")).rlike(r"([一-鿿A-Za-z0-9]{2,12})\1{2,}")


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def lines(text: Column) -> Column:
    """Lines without blanks at their ends, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), stripped), lambda x: x != "")


def last_line(text: Column) -> Column:
    found = lines(text)
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise("")
