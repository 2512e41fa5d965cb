"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A vocabulary file; its place is a parameter everywhere and must exist on every executor.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pattern that byte-level BPE vocabularies of this kind split words by.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; the file's ending names the library."""
    if vocabulary.endswith(".tiktoken"):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coding = tiktoken.Encoding("given", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coding.encode_ordinary(t)) for t in texts]
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens; null and empty texts have none. Texts are read whole."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = counter(vocabulary)
        for texts in batches:
            yield pd.Series(size([t or "" for t in texts]), dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, T.LongType())(text)
