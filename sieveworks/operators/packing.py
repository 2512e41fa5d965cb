"""Token sequences: blocks, truncation with labels, padding. The tokenizer is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -100
Tokenize = Callable[[list[str]], list[list[int]]]
_IDS = T.ArrayType(T.IntegerType())


def code_points(texts: list[str]) -> list[list[int]]:
    """A tokenizer that needs no vocabulary: one id a character."""
    return [[ord(c) for c in t] for t in texts]


def tokenized(text: Column, tokenize: Tokenize = code_points) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[int(x) for x in ids] for ids in tokenize([t or "" for t in texts])], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, _IDS)(text)


def packed(rows: DataFrame, order: str, ids: str, block: int, eos: int, parts: int = 64, keep_short: bool = True) -> DataFrame:
    """(part, block, input_ids): sequences in order, each ended by ``eos``, cut into blocks; a part's remainder is dropped.

    Parts are hash partitions of ``order``; each is packed by itself in order,
    row by row, holding one block at a time. A part with less than one block
    gives its tokens as one short block if ``keep_short``.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        made, part = 0, None
        for pdf in batches:
            out = []
            for p, seq in zip(pdf["__part"], pdf["__ids"]):
                if p != part:
                    if keep_short and held and not made and part is not None:
                        out.append((part, 0, held))
                    held, made, part = [], 0, p
                held.extend(int(x) for x in seq)
                if not len(seq) or seq[-1] != eos:
                    held.append(eos)
                while len(held) >= block:
                    out.append((part, made, held[:block]))
                    held, made = held[block:], made + 1
            if out:
                yield pd.DataFrame(out, columns=["part", "block", "input_ids"])
        if keep_short and held and not made and part is not None:
            yield pd.DataFrame([(part, 0, held)], columns=["part", "block", "input_ids"])

    keyed = rows.select(F.pmod(F.conv(F.substring(F.md5(F.col(order).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int").alias("__part"), F.col(order).alias("__order"), F.coalesce(ids, F.array().cast("array<int>")).alias("__ids"))
    return keyed.repartition(parts, "__part").sortWithinPartitions("__part", "__order").select("__part", "__ids").mapInPandas(pack, "part int, block int, input_ids array<int>")


def with_ends_kept(ids: Column, block: int) -> Column:
    """Blocks of the inner tokens, each with the first and last token of the sequence around it; a rest is dropped."""
    n = F.size(ids)
    inner = F.slice(ids, 2, F.greatest(n - 2, F.lit(0)))
    room = block - 2
    count = (F.size(inner) / room).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.concat(F.slice(ids, 1, 1), F.slice(inner, k * room + 1, room), F.slice(ids, n, F.lit(1))))


def supervised(turns: Column, most: int, eos: int, train_on_inputs: bool = False) -> Column:
    """struct(input_ids, labels) of turns, an array of struct(source, target) of ids.

    Each turn is cut to the limit in proportion to its sides, one place of the
    target kept for ``eos``; reading stops before the turn that would not fit.
    Labels of sources are ignored unless ``train_on_inputs``.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("ids"), none.alias("labels"), F.lit(False).alias("full"))

    def step(s: Column, t: Column) -> Column:
        ns, nt = F.size(t["source"]), F.size(t["target"])
        total = F.greatest(ns + nt, F.lit(1))
        source = F.slice(t["source"], 1, F.least(ns, (most * (ns / total)).cast("int")))
        target = F.slice(t["target"], 1, F.least(nt, F.greatest((most * (nt / total)).cast("int") - 1, F.lit(0))))
        source = F.when(F.get(source, F.lit(0)) == eos, F.slice(source, F.lit(2), F.size(source))).otherwise(source)
        target = F.when(F.get(target, F.size(target) - 1) == eos, F.slice(target, F.lit(1), F.greatest(F.size(target) - 1, F.lit(0)))).otherwise(target)
        full = s["full"] | (F.size(s["ids"]) + F.size(source) + F.size(target) + 1 > most)
        end = F.array(F.lit(eos))
        labels = source if train_on_inputs else F.transform(source, lambda _: F.lit(IGNORED))
        return F.struct(
            F.when(full, s["ids"]).otherwise(F.concat(s["ids"], source, target, end)).alias("ids"),
            F.when(full, s["labels"]).otherwise(F.concat(s["labels"], labels, target, end)).alias("labels"),
            full.alias("full"),
        )

    done = F.aggregate(turns, start, step)
    return F.struct(done["ids"].alias("input_ids"), done["labels"].alias("labels"))


def padded(ids: Column, block: int, pad: int) -> Column:
    """struct(input_ids, attention_mask, labels) of exactly ``block`` places."""
    kept = F.slice(ids, 1, block)
    short = F.lit(block) - F.size(kept)
    full = F.concat(kept, F.array_repeat(F.lit(pad), short))
    mask = F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), short))
    return F.struct(full.alias("input_ids"), mask.alias("attention_mask"), full.alias("labels"))


def has_trained_labels(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORED)


def within_token_budget(ids: Column, most: int, least: int = 1) -> Column:
    """From ``least`` to ``most`` tokens."""
    return F.size(ids).between(least, most)
