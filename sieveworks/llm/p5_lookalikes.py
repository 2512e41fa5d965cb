"""One form for text that looks the same but is made of different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.operators.skew import digest, lookup, salted_join
from sieveworks.session import cut

# Letters of other scripts, and of the phonetic alphabet, that have the shape of a Latin letter.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹονρϲϳ", "ABEZHIKMNOPTYXCovpcj")
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԚԜѴаеѕіјорсухԁһԛԝӏѵ", "ABESIJKMHOPCTYXQWVaesijopcyxdhqwlv")
ARMENIAN = ("ՕՍԼօսհոցզյ", "OULouhngqj")
COPTIC = ("ⲎⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HKMNOPCTXopc")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ")
LISU = ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ")
PHONETIC = ("ɡɑ", "ga")
# Radicals that have the shape of a whole character but no decomposition in Unicode.
RADICALS = ("⺠⻅⻆⻉⻋⻓⻔⻘⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳", "民见角贝车长门青页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟")
# Single signs that have the shape of others.
SIGNS = {"µ": "μ", "‐": "-", "‑": "-", "℃": "°C", "℉": "°F", " ": "\n", " ": "\n", "\t": " ", "⠀": " "}
# Letters and marks without a shape, besides those of category Cf.
BLANKS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

#: Code points that can be unstable; the rest, the ideographs above all, is not looked at.
_LOOKED_AT = (range(0x0, 0x3400), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0FFF))


def _fold(c: str) -> str:
    """What one character of a decomposed text becomes."""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or c in BLANKS or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    parts = unicodedata.decomposition(c).split()
    if parts and parts[0] in ("<wide>", "<narrow>"):
        return "".join(chr(int(p, 16)) for p in parts[1:])
    if "⼀" <= c <= "⿕" or c in "⺟⻳" or "ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ":
        return unicodedata.normalize("NFKC", c)
    return c


def _build() -> tuple[dict[str, str], re.Pattern[str]]:
    single = {a: b for theirs, ours in (GREEK, CYRILLIC, ARMENIAN, COPTIC, CHEROKEE, LISU, PHONETIC, RADICALS) for a, b in zip(theirs, ours, strict=True)} | SIGNS
    folds, unstable, joining, blank = {}, [], [], []
    for points in _LOOKED_AT:
        for i in points:
            c = chr(i)
            to = single.get(c) or _fold(c)
            if to != c:
                folds[c] = to
            if to == "":
                blank.append(i)
            # quick checks: a character that normalisation changes, that a mark can join, or that is folded
            joins = unicodedata.combining(c) != 0 or 0x1161 <= i <= 0x11C2
            if joins:
                joining.append(i)
            if to != c or joins or not unicodedata.is_normalized("NFC", c) or any(d in single or d in folds for d in unicodedata.normalize("NFD", c)):
                unstable.append(i)

    def ranges(points: list[int]) -> str:
        out, start, last = [], None, None
        for p in [*points, None]:
            if start is not None and (p is None or p != last + 1):
                out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}")
                start = None
            if start is None:
                start = p
            last = p
        return "".join(out)

    u, j, b = ranges(unstable), ranges(joining), ranges(blank)
    return folds, re.compile(f"(?:[^{u}](?=[{b}]*[{j}]))?[{u}]+", re.DOTALL)


FOLDS, UNSTABLE = _build()


def canonical_segment(segment: str) -> str:
    """Canonical form of a segment that has its boundary context with it.

    The segment is decomposed, so that a look-alike under an accent is found;
    each character is folded; what is left is composed again.
    """
    return unicodedata.normalize("NFC", "".join(FOLDS.get(c, c) for c in unicodedata.normalize("NFD", segment)))


def one_form(text: str, known: dict[str, str] | None = None) -> str:
    """``text`` with its unstable segments, and only those, in canonical form.

    A segment is a run of unstable characters with the character before it, if
    a mark in the run can join that. Stable text is spliced in unchanged.
    """
    known = {} if known is None else known

    def by(match: re.Match[str]) -> str:
        segment = match[0]
        if segment not in known:
            if len(known) > 50_000:
                known.clear()
            known[segment] = canonical_segment(segment)
        return known[segment]

    return UNSTABLE.sub(by, text)


@F.pandas_udf(T.StringType())
def one_form_of(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return pd.Series([None if t is None else one_form(t, known) for t in texts], dtype=object)


_ENTRIES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_ENTRIES)
def _entries_in_one_form(maps: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    out = []
    for entries in maps:
        if entries is None:
            out.append(None)
            continue
        held: dict[str, str | None] = {}
        for e in entries:
            held.setdefault(one_form(e["key"], known), None if e["value"] is None else one_form(e["value"], known))
        out.append([{"key": k, "value": v} for k, v in held.items()])
    return pd.Series(out, dtype=object)


def in_one_form(df: DataFrame, columns: Iterable[str], options: str | None = None) -> DataFrame:
    """``df`` with the text ``columns``, and keys and values of the map ``options``, in one form.

    Null stays null, empty text empty; texts are taken whole. Other columns
    stay as they are, repeated rows stay repeated. Of two keys of a map that
    become equal the first stays.
    """
    out = df.withColumns({c: one_form_of(F.col(c)) for c in columns})
    if options is None:
        return out
    return out.withColumn(options, F.map_from_entries(_entries_in_one_form(F.map_entries(F.col(options)))))


def _record(question: str, options: str, answer: str) -> Column:
    """A record's text with its parts marked: question, sorted options, answer."""
    entries = F.coalesce(F.map_entries(F.col(options)), F.array().cast("array<struct<key:string,value:string>>"))
    return F.to_json(F.struct(F.coalesce(F.col(question), F.lit("")).alias("q"), F.array_sort(entries).alias("o"), F.coalesce(F.col(answer), F.lit("")).alias("a")))


@F.pandas_udf(T.StringType())
def _record_form(q: pd.Series, o: pd.Series, a: pd.Series) -> pd.Series:
    """The record in one form; options are sorted after folding, as folding may change their order."""
    known: dict[str, str] = {}
    out = []
    for question, entries, answer in zip(q, o, a):
        pairs = sorted((one_form(e["key"] or "", known), one_form(e["value"] or "", known)) for e in (entries if entries is not None else ()))
        out.append("\u0001".join([one_form(question or "", known), one_form(answer or "", known), *(f"{k}\u0002{v}" for k, v in pairs)]))
    return pd.Series(out, dtype=object)


def record_form(question: str, options: str, answer: str) -> Column:
    return _record_form(F.col(question), F.map_entries(F.col(options)), F.col(answer))


def lookalike_pairs(df: DataFrame, id_col: str = "row_id", question: str = "question", options: str = "options", answer: str = "answer") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows that look the same though their characters differ.

    Rows that are equal in every character are first put together as one form,
    so plain repeats never meet each other; only forms that share a look are
    paired, and pairs of forms are then spread over their members. A look or a form
    that a third of all rows has is spread over tasks. Null question
    and answer count as empty, null options as none; a null id takes no part.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), question, options, answer)
    rows = cut(rows.select("id", digest(_record(question, options, answer)).alias("raw"), digest(record_form(question, options, answer)).alias("look")))
    forms = rows.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = cut(forms.groupBy("look").agg(F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1"))
    forms = cut(lookup(forms, several, "look", "n_forms"))
    one, other = (forms.select("look", F.col("raw").alias(f"raw_{x}")) for x in "ab")
    pairs = cut(salted_join(one, other, "look", several.select("look", F.col("n_forms").alias("n")), "raw_a").where("raw_a <> raw_b").select("raw_a", "raw_b"))
    members = cut(lookup(rows.select("id", "raw"), forms.select("raw", "n"), "raw", "n").select("id", "raw"))
    left, right = (members.select(F.col("raw").alias(f"raw_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    sizes = forms.select(F.col("raw").alias("raw_a"), "n")
    half = salted_join(left, pairs, "raw_a", sizes, "id_a")
    reached = pairs.join(sizes, "raw_a").groupBy("raw_b").agg(F.sum("n").alias("n"))
    return salted_join(half, right, "raw_b", reached, "id_a").where("id_a < id_b").select("id_a", "id_b").distinct()
