"""The same or nearly the same records in training and evaluation splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions.rules import staged
from sieveworks.llm.canon import canonical_parts
from sieveworks.llm.p3_verify import MEDICAL_EXAM, Wording, figures, same_question
from sieveworks.operators.skew import digest, lookup, salted_join
from sieveworks.session import cut, free

SHINGLE = 3
#: Two records at the threshold share a bucket with a probability of 0.964.
BANDS = 24
ROWS = 4
MIN_JACCARD = 0.6
#: Parts of a record's text; two of them, so that no shingle spans two parts.
SEP = "\u0001\u0001"


@dataclass
class Overlap:
    """``rows``: (id, side, key); ``classes``: one row per distinct text (cid, key, n_train, n_eval, text); ``links``: verified (train_cid, eval_cid)."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the texts, one after another, and where each text's begin."""
    texts = [t if len(t) >= SHINGLE else t.ljust(SHINGLE, "\u0002") for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    h = np.zeros(len(points) - SHINGLE + 1, dtype=np.uint32)
    for k in range(SHINGLE):
        h = h * np.uint32(0x9E3779B1) + points[k : len(points) - SHINGLE + 1 + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    ends = np.cumsum(lengths)
    inside = np.arange(len(h)) <= np.repeat(ends, lengths)[: len(h)] - SHINGLE
    starts = np.concatenate([[0], np.cumsum(lengths - SHINGLE + 1)[:-1]])
    return h[inside], starts


def band_keys(texts: list[str], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) keys of 40 bits: minwise hashes of the shingles, with the figures of question and options mixed in.

    Figures must be equal for two records to be the same, those of each option
    as well, so they may be part of the key: that loses no true pair and keeps
    records of one template, which differ only in their numbers, and records
    with more or fewer options, out of each other's buckets.
    """
    if not texts:
        return np.zeros((0, bands), dtype=np.int64)
    flat, starts = _codes(texts)
    rng = np.random.default_rng(20240601)
    mul = rng.integers(1, 2**31, size=bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, size=bands * rows, dtype=np.uint32)
    figs = np.fromiter((hash_text(figure_key(t)) for t in texts), dtype=np.uint64, count=len(texts))
    out = np.empty((len(texts), bands), dtype=np.int64)
    for band in range(bands):
        key = figs + np.uint64(band)
        for r in range(rows):
            k = band * rows + r
            least = np.minimum.reduceat(flat * mul[k] + add[k], starts)
            key = (key ^ least.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = (key >> np.uint64(24)).astype(np.int64)
    return out


def figure_key(text: str) -> str:
    """Figures of the question, then those of each option in sorted order."""
    question, *options = text.split(SEP)
    return "|".join(figures(question)) + "\u0003" + "\u0003".join(sorted("|".join(figures(o)) for o in options))


def hash_text(text: str) -> int:
    """FNV-1a over the text's bytes; the same in every process."""
    h = 0xCBF29CE484222325
    for byte in text.encode("utf-8", "surrogatepass"):
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"cid": pdf["cid"], "keys": list(band_keys(pdf["text"].tolist()))})


def shingles(text: str) -> set[str]:
    text = text if len(text) >= SHINGLE else text.ljust(SHINGLE, "\u0002")
    return {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _verified(a: Column, b: Column, wording: Wording) -> Column:
    def one(x: str, y: str) -> bool:
        if jaccard(x, y) < MIN_JACCARD:
            return False
        q, *options = x.split(SEP)
        p, *others = y.split(SEP)
        return same_question(q, options, p, others, wording)

    @F.pandas_udf(T.BooleanType())
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    return verify(a, b)


def cross_split_overlap(
    items: DataFrame,
    id_col: str = "item_id",
    question: str = "question",
    options: str = "options",
    split: str = "split",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("val", "test"),
    wording: Wording = MEDICAL_EXAM,
) -> Overlap:
    """Train and evaluation records that are the same question with the same options.

    Records are put into canonical form without the letters of their options,
    and equal texts become one class, counted by side, before anything is
    compared. Minwise hashes of character shingles (these texts have no words)
    give each class ``BANDS`` bucket keys; only a train class and an evaluation
    class that share a key become a candidate pair. Candidates are verified by
    their exact Jaccard similarity (``MIN_JACCARD``), then by a comparison of
    question and options that a similarity cannot make: figures, signs, drug
    names and opposites. Slips and rewording put true pairs down to about 0.65,
    which is why the threshold is not the 0.8 used for word shingles.

    Nulls: a null split or id takes no part; a null question counts as empty and
    null options as none, and two records with an empty question are only the
    same if the options are. Other columns are not read. An empty table, or one
    without one of the sides, gives no links. Repeated rows are copies.
    """
    values = F.coalesce(F.map_values(F.col(options)), F.array().cast("array<string>"))
    side = F.when(F.col(split).isin(*train), 0).when(F.col(split).isin(*evaluation), 1)
    taking_part = items.select(F.col(id_col).alias("id"), side.alias("side"), F.concat(F.array(question), values).alias("t")).where("side is not null and id is not null")
    rows = staged(taking_part, {"p": canonical_parts(F.col("t"))})
    rows = rows.select("id", "side", F.concat_ws(SEP, F.col("p")[0], F.array_join(F.array_sort(F.slice("p", 2, F.size("p"))), SEP)).alias("text"))
    whole = cut(rows.withColumn("key", digest(F.col("text"))))
    rows = cut(whole.select("id", "side", "key"))
    classes = cut(
        whole.groupBy("text")
        .agg(F.min("id").alias("cid"), F.sum(1 - F.col("side")).alias("n_train"), F.sum("side").alias("n_eval"))
        .select("cid", digest(F.col("text")).alias("key"), "n_train", "n_eval", "text")
    )
    free(whole)

    def bucketed(present: str, name: str) -> DataFrame:
        keys = classes.where(f"{present} > 0").select("cid", "text").mapInPandas(_band_rows, "cid long, keys array<long>")
        return keys.select(F.col("cid").alias(name), F.explode("keys").alias("bucket"))

    asked = cut(bucketed("n_eval", "eval_cid"))
    per_bucket = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(
        salted_join(asked, bucketed("n_train", "train_cid"), "bucket", per_bucket, "eval_cid")
        .where("train_cid <> eval_cid")
        .groupBy("train_cid", "eval_cid")
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )

    def with_text(rows: DataFrame, key: str, name: str, spread: str) -> DataFrame:
        texts = classes.select(F.col("cid").alias(key), F.col("text").alias(name))
        return salted_join(rows, texts, key, pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")), spread)

    links = with_text(with_text(pairs, "train_cid", "a", "eval_cid"), "eval_cid", "b", "train_cid").where(_verified(F.col("a"), F.col("b"), wording)).select("train_cid", "eval_cid")
    same = classes.where("n_train > 0 and n_eval > 0").select(F.col("cid").alias("train_cid"), F.col("cid").alias("eval_cid"))
    return Overlap(rows, classes, cut(links.unionByName(same)))


def _members(o: Overlap) -> DataFrame:
    """(id, side, cid) of the records whose class has a link."""
    linked = o.links.select(F.col("train_cid").alias("cid")).unionByName(o.links.select(F.col("eval_cid").alias("cid"))).distinct()
    keys = cut(o.classes.select("cid", "key", (F.col("n_train") + F.col("n_eval")).alias("n")).join(linked, "cid"))
    return lookup(o.rows, keys, "key", "n").select("id", "side", "cid")


def overlap_pairs(items: DataFrame, **columns: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every confirmed pair of a train and an evaluation record.

    For a list of all pairs only; links and members say the same without
    expanding groups of copies. A class with many members is spread over tasks.
    """
    o = cross_split_overlap(items, **columns)
    members = cut(_members(o))
    sides = o.classes.select(F.col("cid"), "n_train", "n_eval")
    left = members.where("side = 0").select(F.col("cid").alias("train_cid"), F.col("id").alias("train_id"))
    right = members.where("side = 1").select(F.col("cid").alias("eval_cid"), F.col("id").alias("eval_id"))
    half = salted_join(left, o.links, "train_cid", sides.select(F.col("cid").alias("train_cid"), F.col("n_train").alias("n")), "train_id")
    reached = o.links.join(sides.select(F.col("cid").alias("train_cid"), "n_train"), "train_cid").groupBy("eval_cid").agg(F.sum("n_train").alias("n"))
    pairs = salted_join(half, right, "eval_cid", reached, "train_id").where("train_id <> eval_id")
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def overlap_report(items: DataFrame, source: str = "source", split: str = "split", id_col: str = "item_id") -> DataFrame:
    """(split, source, eval_rows, overlapping_rows, exact_rows, pairs) over the evaluation splits.

    Pairs are counted from class sizes and never listed. A null source is a
    source of its own.
    """
    o = cross_split_overlap(items, split=split, id_col=id_col)
    sizes = o.classes.select(F.col("cid").alias("train_cid"), "n_train")
    per_class = (
        o.links.join(sizes, "train_cid")
        .groupBy(F.col("eval_cid").alias("cid"))
        .agg(F.sum("n_train").alias("partners"), F.max(F.col("train_cid") == F.col("eval_cid")).alias("exact"))
    )
    members = _members(o).where("side = 1").join(per_class, "cid").select("id", "partners", "exact")
    rows = items.where(F.col(split).isin("val", "test")).select(F.col(id_col).alias("id"), F.col(split).alias("split"), F.col(source).alias("source"))
    return (
        rows.join(members, "id", "left")
        .groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("eval_rows"),
            F.count("partners").alias("overlapping_rows"),
            F.coalesce(F.sum(F.col("exact").cast("long")), F.lit(0)).cast("long").alias("exact_rows"),
            F.coalesce(F.sum("partners"), F.lit(0)).cast("long").alias("pairs"),
        )
    )
