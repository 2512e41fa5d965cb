"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.rules import staged
from sieveworks.llm.canon import canonical_parts, record_of
from sieveworks.operators.skew import digest, lookup
from sieveworks.session import cut


@dataclass
class Collapsed:
    """``forms``: distinct raw rows (raw, canon, n, first_id); ``groups``: one row per canonical record."""

    forms: DataFrame
    groups: DataFrame


def _raw(question: str, options: str) -> Column:
    """A text that is equal just for rows that are equal in every byte and in the order of their options."""
    return F.to_json(F.struct(F.col(question).alias("q"), F.map_entries(F.col(options)).alias("o")))


def collapse(items: DataFrame, id_col: str = "item_id", question: str = "question", options: str = "options") -> Collapsed:
    """One record for each canonical text, with the number of its copies.

    Byte-identical raw rows are counted first, so only distinct ones are put
    into canonical form; those are grouped again on the whole canonical text and
    their counts summed. Both groupings pre-aggregate on the map side, so a
    group with a third of all rows is one partial row per task.

    Nulls: a null question counts as empty, null options as no options, a null
    id is counted as a copy but never kept unless its group has no other. Any
    other column, also with clashing names, is not read. An empty table gives no
    groups. Repeated rows (same id) count as copies.
    """
    forms = (
        items.select(F.col(id_col).alias("id"), _raw(question, options).alias("raw"))
        .groupBy("raw")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    )
    held = staged(forms, {"p": F.from_json("raw", "q string, o array<struct<key:string,value:string>>")})
    none = F.array().cast("array<string>")
    texts = F.concat(F.array(F.col("p")["q"]), F.coalesce(F.transform(F.col("p")["o"], lambda e: e["key"]), none), F.coalesce(F.transform(F.col("p")["o"], lambda e: e["value"]), none))
    parts = staged(held.select("raw", "n", "first_id", texts.alias("t")), {"parts": canonical_parts(F.col("t"))})
    forms = parts.select(digest(F.col("raw")).alias("raw"), record_of(F.col("parts")).alias("canon"), "n", "first_id")
    forms = cut(forms)
    groups = forms.groupBy("canon").agg(F.min("first_id").alias("kept_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("n_forms"))
    return Collapsed(forms, groups)


def collapsed_records(items: DataFrame, **columns: str) -> DataFrame:
    """(kept_id, copies, n_forms): one row for each group."""
    return collapse(items, **columns).groups.select("kept_id", "copies", "n_forms")


def copies_of(items: DataFrame, id_col: str = "item_id", question: str = "question", options: str = "options") -> DataFrame:
    """(kept_id, copy_id) for every member of a group but the kept one, without listing a group in one task.

    Rows find their form and forms their group by digests; the heaviest keys of
    either go by a bounded broadcast, so no key is shuffled to one task.
    """
    c = collapse(items, id_col, question, options)
    groups = cut(c.groups.where("copies > 1").select(digest(F.col("canon")).alias("canon"), "kept_id", "n_forms"))
    forms = c.forms.select("raw", digest(F.col("canon")).alias("canon"), "n")
    raw_to_kept = cut(lookup(forms, groups, "canon", "n_forms").select("raw", "kept_id", "n"))
    rows = items.select(F.col(id_col).alias("copy_id"), digest(_raw(question, options)).alias("raw"))
    return lookup(rows, raw_to_kept, "raw", "n").where("copy_id > kept_id").select("kept_id", "copy_id").distinct()
