"""Texts cut into chunks at the ends of sentences, with an overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.rules import staged
from sieveworks.functions.text import stripped


_HAN = "[一-鿿]"


def _han_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ideographic text: up to the first end of a sentence in the last ``overlap`` characters of ``size``, else of ``size`` characters.

    One expression: the shortest run that is long enough and ends a sentence, or the longest run.
    """
    near = rf".{{{max(size - overlap, 0)},{size - 1}}}?[\n。！？；…]|" if overlap > 0 else ""
    return F.regexp_extract_all(text, F.lit(rf"(?s){near}.{{1,{size}}}"), F.lit(0))


def _sentence_chunks(text: Column, size: int) -> Column:
    """Whole sentences of other text joined by blanks while they fit; a longer sentence stands alone, uncut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["open"] == "") | (F.length(s["open"]) + F.length(p) <= size)
        longer = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit(" "), p))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits, longer).otherwise(p).alias("open"))

    end = F.aggregate(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+"), start, step, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return end


def chunk_arrays(documents: DataFrame, text: str, size: int = 250, overlap: int = 50, out: str = "chunks") -> DataFrame:
    """``documents`` with an array of chunks of about ``size`` characters.

    Ideographic text ends a chunk at the end of a sentence near the size, or at
    the size (by characters, as there is no word list here); other text is
    joined from whole sentences. With an ``overlap`` the first so many characters
    of the next chunk follow each one. Null and empty texts have no chunks; texts
    of any length are cut whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = staged(documents, {"__cut": F.when(t.rlike(_HAN), F.transform(_han_chunks(t, size, overlap), stripped)).otherwise(_sentence_chunks(t, size))})
    following = F.slice("__cut", F.lit(2), F.greatest(F.size("__cut"), F.lit(0)))
    joined = F.zip_with("__cut", following, lambda c, n: F.when(n.isNull(), c).otherwise(stripped(F.concat(c, F.lit(" "), F.substring(n, 1, overlap)))))
    return rows.withColumn(out, joined if overlap else F.col("__cut")).drop("__cut")


def chunk_rows(documents: DataFrame, id_col: str, text: str, size: int = 250, overlap: int = 50) -> DataFrame:
    """(id, chunk_no, chunk)."""
    rows = chunk_arrays(documents.select(id_col, text), text, size, overlap, "__chunks")
    return rows.select(id_col, F.posexplode("__chunks").alias("chunk_no", "chunk"))


def numbered_context(chunks_of: Column, budget: int) -> Column:
    """Chunks as numbered quotations, joined by line ends and cut to the budget."""
    lines = F.transform(chunks_of, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(']\t "'), c, F.lit('"')))
    return F.substring(F.array_join(lines, "\n"), 1, budget)


def glued_lines(text: Column) -> Column:
    """Lines of a page joined until one ends with a closing mark; blank ones left out."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(found, lambda x: F.when(x.rlike(r"""[.!?。！？…;；:：”’）】》」』〕〉〗〞〟»"')\]}]$"""), F.concat(x, F.lit("␞"))).otherwise(x))
    return F.filter(F.split(F.array_join(marked, ""), "␞"), lambda x: x != "")


def html_lines(html: Column) -> Column:
    """Text lines of HTML: scripts, styles and tags removed, entities of the markup resolved, blank lines left out."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n"), r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def markdown_lines(text: Column) -> Column:
    """Text lines of Markdown: marks of headings, lists, quotes, emphasis, code and links removed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s{0,3}(?:#{1,6}|[-*+]|\d+\.|>)\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(\*\*|__|\*|`{1,3}|~~)", "")
    return F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
