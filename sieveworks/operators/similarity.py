"""Top-k similarity and ranked retrieval."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions.hashing import Digests, hashed_entries
from sieveworks.functions.text import without_space
from sieveworks.session import cut, cut_of_parts

#: Dimensions of targets that are held as a matrix, 200 MB for a chunk of targets.
COMMON_DIMS = 1024


def _in_blocks(spark: SparkSession, rows: Iterable[Row], size: int, shared: Callable[[list[Row]], object], scored: Callable[[Broadcast], DataFrame], schema: str) -> DataFrame:
    """A cut of what ``scored`` gives for each block of ``size`` rows; what a block broadcasts is removed before the next is taken."""

    def parts() -> Iterator[DataFrame]:
        left = iter(rows)
        while block := list(itertools.islice(left, size)):
            sent = spark.sparkContext.broadcast(shared(block))
            yield scored(sent)
            sent.destroy()

    return cut_of_parts(spark, parts(), schema)


def top_k_cosine(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, k: int = 5, least: float = -1.0, chunk: int = 512) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k most similar rows of each query, of equals the greater id first.

    Queries are taken in chunks of bounded size, each broadcast in turn to all
    rows; every partition keeps its own k best per query by one matrix product
    a batch, and only those k reach the shuffle. A chunk's size is fixed, so
    what is broadcast never grows with the data. Vectors of zeros match nothing.
    """
    held = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).alias("v")).orderBy("q").toLocalIterator(prefetchPartitions=True)
    kind = dict(rows.dtypes)[row_id]
    schema = f"q {kind}, r {kind}, similarity double"
    source = rows.select(F.col(row_id).alias("r"), F.col(vector).alias("v"))

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1)[:, None]
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def shared(block: list[Row]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["q"] for r in block]), unit(np.array([r["v"] for r in block], dtype=np.float64))

    def scored(sent: Broadcast) -> DataFrame:
        def best(batches):
            qs, m = sent.value
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if pdf.empty:
                    continue
                sims, ids = (m @ unit(np.stack(pdf["v"].to_numpy()).astype(np.float64)).T).T, pdf["r"].to_numpy()
                own = np.argsort(ids, kind="stable")[::-1]
                order = own[np.argsort(-sims[own], axis=0, kind="stable")[:k]]
                kept = np.take_along_axis(sims, order, axis=0)
                row, column = np.nonzero(kept >= least)
                yield pd.DataFrame({"q": qs[column], "r": ids[order[row, column]], "similarity": kept[row, column]})

        return _best_of(source.mapInPandas(best, schema), [F.desc("similarity"), F.desc("r")], k)

    return _in_blocks(rows.sparkSession, held, chunk, shared, scored, schema + ", rank int")


def _evenly(rows: DataFrame) -> DataFrame:
    """``rows`` in parts of equal size, for work that takes long for each row; files hold them as they came."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _best_of(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def aligned(neighbours: DataFrame) -> DataFrame:
    """Ids that are a neighbour of some query, each once."""
    return neighbours.select("r").distinct()


def target_similarity(
    rows: DataFrame, targets: DataFrame, row_id: str, target_id: str, vector: str, k: int = 3, dim: int = 16_384, chunk: int = 24_576, text: str | None = None
) -> DataFrame:
    """(r, matched, best, mean_top): of each row the k most similar of all targets, of equals the greater id first, its best and the mean of the k.

    Vectors are maps from dimension to weight of unit length; row ids are
    unique. Targets go out in chunks of a fixed number, each a small inverted
    list from dimension to targets, so what is broadcast never grows with the
    data. Against each chunk a row keeps its k best, and the k best of these
    remain; no pair is written. Every chunk reads a cut of ``rows``, in even
    parts. A row without a vector has similarity 0. With ``text`` rows have
    texts instead, whose vectors are made where they are scored and never held,
    once a chunk: a vector takes many times the memory of its text.
    """
    kind, target_kind = dict(rows.dtypes)[row_id], dict(targets.dtypes)[target_id]
    held = [F.map_keys(vector).alias("i"), F.map_values(vector).alias("w")] if text is None else [F.col(text).alias("x")]
    slim = cut(_evenly(rows.select(F.col(row_id).alias("r"), *held)))

    def shared(block: list[tuple]) -> tuple:
        at, weight = (np.concatenate([r[c] for r in block]) for c in (1, 2))
        order = np.argsort(at, kind="stable")
        own = np.repeat(np.arange(len(block)), [len(r[1]) for r in block])
        return [r[0] for r in block], np.searchsorted(at[order], np.arange(dim + 1)), own[order], weight[order]

    def scored(sent: Broadcast) -> DataFrame:
        def best(batches):
            names, starts, own, weight = sent.value
            owners, weights_of, counts = np.split(own, starts[1:-1]), np.split(weight, starts[1:-1]), np.diff(starts)
            # the commonest dimensions as a matrix, as a product of matrices costs less than many entries; the others by their lists
            common = np.argsort(-counts, kind="stable")[:COMMON_DIMS]
            place, matrix = np.full(dim, -1), np.zeros((len(common), len(names)))
            place[common] = np.arange(len(common))
            for n, x in enumerate(common.tolist()):
                matrix[n, owners[x]] = weights_of[x]
            known = Digests()
            for pdf in batches:
                out, ids = [], pdf["r"].tolist()
                vectors = zip(pdf["i"], pdf["w"]) if text is None else (hashed_entries(x, known, dim) for x in pdf["x"])
                vectors = ((np.asarray(() if i is None else i, dtype=np.int64), np.asarray(() if w is None else w, dtype=float)) for i, w in vectors)
                for low in range(0, len(ids), 64):
                    part = list(itertools.islice(vectors, 64))
                    held = np.zeros((len(part), len(common)))
                    for n, (keys, weights) in enumerate(part):
                        at = place[keys]
                        held[n, at[at >= 0]] = weights[at >= 0]
                        part[n] = keys[at < 0], weights[at < 0]
                    sims = held @ matrix
                    for n, (keys, weights) in enumerate(part):
                        if len(keys):
                            each = keys.tolist()
                            products = np.concatenate([weights_of[x] for x in each])
                            products *= np.repeat(weights, counts[keys])
                            sims[n] += np.bincount(np.concatenate([owners[x] for x in each]), weights=products, minlength=len(names))
                        one = np.round(sims[n], 9) + 0.0
                        order, found = [], []
                        for _ in range(min(k, len(names))):  # of equals the first, as names descend
                            order.append(int(one.argmax()))
                            found.append(float(one[order[-1]]))
                            one[order[-1]] = -np.inf
                        out.append((ids[low + n], [names[x] for x in order], found))
                yield pd.DataFrame(out, columns=["r", "t", "s"])

        return slim.mapInPandas(best, schema)

    schema = f"r {kind}, t array<{target_kind}>, s array<double>"
    sent = targets.select(F.col(target_id).alias("t"), F.map_keys(vector).alias("i"), F.map_values(vector).alias("w")).orderBy(F.desc("t")).toLocalIterator(prefetchPartitions=True)
    # as arrays: an object for each entry would take gigabytes a chunk
    ordered = ((r["t"], np.array(r["i"] or (), dtype=np.int64), np.array(r["w"] or (), dtype=np.float64)) for r in sent)
    every = _in_blocks(rows.sparkSession, ordered, chunk, shared, scored, schema)
    every = every.unionByName(slim.select("r", F.array().cast(f"array<{target_kind}>").alias("t"), F.array().cast("array<double>").alias("s")))
    found = every.groupBy("r").agg(F.flatten(F.collect_list(F.arrays_zip("s", "t"))).alias("x"))
    top = found.select("r", F.slice(F.sort_array("x", asc=False), 1, k).alias("x"))
    total = F.aggregate("x.s", F.lit(0.0), lambda a, s: a + s)
    return top.select("r", F.col("x.t").alias("matched"), F.coalesce(F.get("x.s", F.lit(0)), F.lit(0.0)).alias("best"), F.when(F.size("x") > 0, total / F.size("x")).otherwise(0.0).alias("mean_top"))


def terms(text: Column) -> Column:
    """Words of letters or digits, and pairs of neighbouring ideographs, in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(without_space(t), F.lit("([一-鿿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def bm25(
    queries: DataFrame, documents: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75, chunk: int = 32_768
) -> DataFrame:
    """(q, d, score, rank): the k best documents of each query that share a term with it, of equals the least id.

    A document is its terms as hashes with counts, in a cut. Queries go out in
    chunks of a fixed number, each an inverted list from term to queries. A
    document adds its weight for a term to all queries of the chunk that have
    it, and is kept for those whose k best so far in its part it reaches; what is
    shuffled are the k best of each query and part, not all pairs with a term
    in common. Texts without terms match nothing and count as documents of length 0.
    """
    spark = documents.sparkSession
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    asked = cut(queries.select(F.col(query_id).alias("q"), F.array_distinct(hashed(terms(F.col(query_text)))).alias("ts")))
    sized = _evenly(documents.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("x"))).select("d", hashed(terms(F.col("x"))).alias("ts"))
    postings = cut(sized.select("d", F.size("ts").alias("len"), _counted("ts").alias("x")).select("d", "len", "x.t", "x.tf"))
    stats = postings.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    df = postings.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = cut(df.select("t", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    known = asked.select("q", F.explode("ts").alias("t")).join(idf, "t").groupBy("q").agg(F.collect_list(F.struct("t", "idf")).alias("x")).select("q", F.col("x.t").alias("t"), F.col("x.idf").alias("idf"))
    kinds = (dict(asked.dtypes)["q"], dict(postings.dtypes)["d"])

    schema = f"q {kinds[0]}, d {kinds[1]}, score double"
    # as arrays: an object for each term would take gigabytes a chunk
    held = ((r["q"], np.array(r["t"], dtype=np.int64), np.array(r["idf"])) for r in known.orderBy("q").toLocalIterator(prefetchPartitions=True))

    def shared(block: list[tuple]) -> tuple:
        t, weight = (np.concatenate([r[c] for r in block]) for c in (1, 2))
        order = np.argsort(t, kind="stable")
        vocabulary, first = np.unique(t[order], return_index=True)
        return [r[0] for r in block], vocabulary, np.append(first, len(t)), np.repeat(np.arange(len(block)), [len(r[1]) for r in block])[order], weight[order][first]

    def scored(sent: Broadcast) -> DataFrame:
        def best(batches):
            names, vocabulary, starts, q, idf_of = sent.value
            asking = np.split(q, starts[1:-1])
            counts = np.diff(starts)
            least = np.zeros(len(names))
            kept, pending, waiting = None, [], 0

            def merged(parts: list[tuple]) -> tuple:
                x, scores, ids = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -scores, x))
                x, scores, ids = x[order], scores[order], ids[order]
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
                full = rank == k - 1
                # scores count to six decimals
                least[x[full]] = np.maximum(scores[full] - 1e-6, 0.0)
                return x[rank < k], scores[rank < k], ids[rank < k]

            for pdf in batches:
                ids = pdf["d"].to_numpy()
                for i, (length, t, tf) in enumerate(zip(pdf["len"], pdf["t"], pdf["tf"])):
                    at = np.searchsorted(vocabulary, t)
                    hit = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == t)
                    if not len(hit):
                        continue
                    at, tf = at[hit], tf[hit]
                    weights = idf_of[at] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))
                    scores = np.bincount(np.concatenate([asking[j] for j in at]), weights=np.repeat(weights, counts[at]), minlength=len(names))
                    x = np.flatnonzero(scores > least)
                    if not len(x):
                        continue
                    rounded = np.round(scores[x], 6)
                    x, rounded = x[rounded > 0], rounded[rounded > 0]
                    pending.append((x, rounded, np.repeat(ids[i : i + 1], len(x))))
                    waiting += len(x)
                    if waiting > 8 * len(names):
                        kept = merged([*([kept] if kept else []), *pending])
                        pending, waiting = [], 0
            if pending:
                kept = merged([*([kept] if kept else []), *pending])
            if kept:
                yield pd.DataFrame({"q": [names[j] for j in kept[0]], "d": kept[2], "score": kept[1]})

        return _best_of(postings.mapInPandas(best, schema), [F.desc("score"), F.col("d")], k)

    return _in_blocks(spark, held, chunk, shared, scored, schema + ", rank int")


@F.pandas_udf(T.StructType([T.StructField("t", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]))
def _counted(terms: pd.Series) -> pd.DataFrame:
    """Distinct terms and how often each is there."""
    found = [np.unique(t, return_counts=True) for t in terms]
    return pd.DataFrame({"t": pd.Series([t for t, _ in found], dtype=object), "tf": pd.Series([n.astype(np.int32) for _, n in found], dtype=object)})


def blended(a: DataFrame, b: DataFrame, keys: list[str], weight: float = 0.5) -> DataFrame:
    """Weighted sum of two tables of scores; a missing side counts as zero."""
    joined = a.select(*keys, F.col("score").alias("sa")).join(b.select(*keys, F.col("score").alias("sb")), keys, "full")
    return joined.select(*keys, (F.coalesce("sa", F.lit(0.0)) * weight + F.coalesce("sb", F.lit(0.0)) * (1 - weight)).alias("score"))
