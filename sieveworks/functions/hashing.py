"""Digests, n-grams, sketches and similarities."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions.text import without_space


def unit_hash(seed: str, key: Column) -> Column:
    """First 16 hex digits of a SHA-1; their order is the order of the uniform number they stand for."""
    return F.substring(F.sha1(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 16)


def unit_float(seed: str, key: Column) -> Column:
    """The uniform number in [0, 1] that ``unit_hash`` stands for."""
    return F.conv(unit_hash(seed, key), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(16**16 - 1))


def char_ngrams(text: Column, shortest: int, longest: int, compact: bool = True) -> Column:
    """All character n-grams, shortest first, repeats kept; with ``compact`` white space is left out of the text.

    Each gram evaluates ``text`` anew: give a column that is computed already.
    """
    t = without_space(text) if compact else text

    def of_length(n: int) -> Column:
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))

    return F.concat(*[of_length(n) for n in range(shortest, longest + 1)])


def bigram_set(normal: Column) -> Column:
    """Set of character pairs; a single character is its own set, empty text an empty one."""
    t = F.coalesce(normal, F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets have none in common."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors; a vector of zeros is like nothing."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Digests of n-grams that a task keeps at hand; n-grams of a language repeat, and a look-up costs a tenth of a digest.
KNOWN_GRAMS = 300_000


class Digests(dict):
    """64-bit BLAKE2b digest of a text, computed when it is first asked for."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= KNOWN_GRAMS:
            self.clear()
        self[gram] = h = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def _gram_hashes(text: str, shortest: int, longest: int, known: Digests) -> list[int]:
    return [known[text[i : i + n]] for n in range(shortest, longest + 1) for i in range(len(text) - n + 1)]


def simhash(text: Column, shortest: int = 2, longest: int = 4, head: int | None = None) -> Column:
    """64-bit SimHash as a signed long; a bit is set if its votes are not negative, so empty text has all bits set.

    ``head`` limits the text to its first characters, for results that must
    agree with sketches made so; by default the whole text counts.
    """

    def sketch(texts: pd.Series) -> pd.Series:
        shifts = np.arange(64, dtype=np.uint64)
        out, known = [], Digests()
        for t in texts:
            grams = _gram_hashes("".join(((t or "")[:head] if head else (t or "")).split()), shortest, longest, known)
            if grams:
                # bits of all digests, least first; one row a digest
                bits = np.unpackbits(np.array(grams, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes = 2 * bits.sum(axis=0, dtype=np.int64) - len(grams)
            else:
                votes = np.zeros(64, dtype=np.int64)
            out.append(int(((votes >= 0).astype(np.uint64) << shifts).sum().astype(np.int64)))
        return pd.Series(out, dtype="int64")

    sketch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(sketch, T.LongType())(text)


def hashed_entries(text: str | None, known: Digests, dim: int = 16_384, shortest: int = 2, longest: int = 4, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and weights of a text's vector: signed feature hashing of n-grams to unit length; an empty text has none."""
    hashes = np.array(_gram_hashes("".join(((text or "")[:head] if head else (text or "")).split()), shortest, longest, known), dtype=np.uint64)
    keys, first, place = np.unique(hashes % np.uint64(dim), return_index=True, return_inverse=True)
    counts = np.bincount(place, weights=1.0 - 2.0 * (hashes >> np.uint64(8) & np.uint64(1)), minlength=len(keys))
    # counts are whole numbers, so their sum of squares is exact; in the order in which dimensions appear
    norm, order = float((counts * counts).sum()) ** 0.5, np.argsort(first)
    return keys[order].astype(np.int32)[: len(keys) if norm else 0], (counts[order] / norm if norm else np.zeros(0))


def hashed_vector(text: Column, dim: int = 16_384, shortest: int = 2, longest: int = 4, head: int | None = None) -> Column:
    """``hashed_entries`` as a map from dimension to weight; for small sets, as a vector is larger than its text."""

    def embed(texts: pd.Series) -> pd.DataFrame:
        # two arrays a text: an object for each entry would take gigabytes a batch
        known = Digests()
        entries = [hashed_entries(t, known, dim, shortest, longest, head) for t in texts]
        return pd.DataFrame({"i": pd.Series([i for i, _ in entries], dtype=object), "w": pd.Series([w for _, w in entries], dtype=object)})

    embed.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    arrays = F.pandas_udf(embed, "i array<int>, w array<double>")(text)
    return F.map_from_arrays(arrays["i"], arrays["w"])


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of two unit vectors held as maps."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
