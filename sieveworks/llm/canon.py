"""The form of a record under which only typing, not content, is ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms of signs that carry a value, and their plain forms.
WIDE_SIGNS = "．：＋－％／～＜＞＝"
PLAIN_SIGNS = ".:+-%/~<>="

#: Points, colons and range dashes are text only between two digits.
_BETWEEN = r".:．：–—"
#: Punctuation and marks that carry a value wherever they stand.
_VALUE = r"\-－‐‑%％‰‱/／′″°"
#: Joins the parts of a record while they are put into canonical form together; a code point that is no character.
_PART = "\ufdd0"
_DROP = rf"[\s\p{{Z}}\p{{C}}\p{{P}}`^|¨´¸&&[^{_BETWEEN}{_VALUE}{_PART}]]+"
_DROP_BETWEEN = rf"[{_BETWEEN}](?:(?!\p{{Nd}})|(?<!\p{{Nd}}.))"


def canonical_text(text: Column) -> Column:
    """Lower case, no white space, no punctuation; signs that carry a value stay. Null counts as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _DROP, "")
    return F.translate(F.regexp_replace(bare, _DROP_BETWEEN, ""), WIDE_SIGNS, PLAIN_SIGNS)


def canonical_parts(parts: Column) -> Column:
    """Canonical form of each text of an array that has at least one, in one pass over all of them.

    No condition stands around the pass: a conditional expression would be
    evaluated again for each use of its result.
    """
    return F.split(canonical_text(F.array_join(parts, _PART, "")), _PART)


def joined_record(question: Column, options: Column) -> Column:
    """Question, keys and values of a record as one array; null options count as none."""
    none = F.array().cast("array<string>")
    return F.concat(F.array(question), F.coalesce(F.map_keys(options), none), F.coalesce(F.map_values(options), none))


def record_of(parts: Column) -> Column:
    """One text for the canonical parts of a record: the question, then ``key \\u0002 value`` of the options in sorted order.

    They are joined by control characters, which canonical text has not.
    """
    n = F.shiftright(F.size(parts) - 1, 1)
    pairs = F.zip_with(F.slice(parts, F.lit(2), n), F.slice(parts, n + 2, n), lambda k, v: F.concat(k, F.lit("\u0002"), v))
    return F.concat_ws("\u0001", parts[0], F.array_join(F.array_sort(pairs), "\u0001"))


def canonical_record(question: Column, options: Column) -> Column:
    return record_of(canonical_parts(joined_record(question, options)))
