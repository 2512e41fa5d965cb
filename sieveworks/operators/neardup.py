"""Near duplicates within blocks: TF-IDF of character n-grams, components, election of a keeper."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.operators.skew import digest, lookup, salted_join
from sieveworks.session import cut, free

#: Rows and characters of a block that one task takes whole (about 300 MB); larger blocks are spread over tasks.
BLOCK_ROWS, BLOCK_CHARS = 10_000, 2_000_000
#: Pairs of postings that are held at once while candidates of a block are gathered.
PAIRS_AT_ONCE = 250_000


def _counted_grams(shortest: int, longest: int):
    """Distinct hashed character n-grams of each text and how often it has them."""

    def count(texts: pd.Series) -> pd.DataFrame:
        grams, counts = [], []
        for t in texts:
            points = np.frombuffer("".join((t or "").split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            found = []
            h = np.zeros(len(points), dtype=np.uint64)
            for n in range(1, longest + 1):
                if len(points) < n:
                    break
                h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                if n >= shortest:
                    found.append(h ^ np.uint64(n))
            values, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            grams.append(values.astype(np.int64))
            counts.append(times.astype(np.int32))
        return pd.DataFrame({"grams": grams, "counts": counts})

    count.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    kind = T.StructType([T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return F.pandas_udf(count, kind)


def text_classes(rows: DataFrame, block: str, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(block, cid, n, text) for each distinct text of a block, by its least id, and (id, cid) of the rows that are not their class's own.

    Both are cuts. A text that a third of all rows has is one class, found by map-side aggregation.
    """
    rows = rows.select(F.col(block).alias("block"), F.col(id_col).alias("id"), text.alias("text"))
    keyed = cut(rows.withColumn("key", digest(F.concat_ws("\u0001", F.coalesce(F.col("block").cast("string"), F.lit("\u0002")), F.coalesce("text", F.lit(""))))))
    firsts = cut(keyed.groupBy("key").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n")))
    own = lookup(keyed, firsts, "key", "n")
    classes = cut(own.where("id = cid").select("block", "cid", "n", "text"))
    copies = cut(lookup(keyed.select("id", "key"), firsts.where("n > 1"), "key", "n").where("id <> cid").select("id", "cid"))
    return classes, copies


def tfidf_vectors(classes: DataFrame, threshold: float, shortest: int = 2, longest: int = 5) -> DataFrame:
    """(id, grams, ws, prefix) of classes (block, cid, n, text): unit vectors of smooth TF-IDF, rarest grams first.

    Document frequencies are those of the rows of a block: a class counts as
    often as it has rows. Grams that only one row of a block has are dropped if
    the block has four rows or more, as they can't be shared. A gram of a block
    is one 64-bit hash and grams are counted within their row, so that what is
    shuffled are distinct grams of rows, as numbers. ``prefix`` is the number of
    grams that must be joined to find all pairs of ``threshold``.
    """
    counted = cut(classes.select(F.coalesce(F.col("block").cast("string"), F.lit("\u0002")).alias("block"), "cid", "n", _counted_grams(shortest, longest)(F.col("text")).alias("c")))
    sizes = cut(counted.groupBy("block").agg(F.sum("n").alias("in_block"), F.count(F.lit(1)).alias("rows")))
    sized = lookup(counted, sizes, "block", "rows")
    grams = sized.select("block", F.col("cid").alias("id"), "n", "in_block", F.explode(F.arrays_zip("c.grams", "c.counts")).alias("g"))
    grams = grams.select(F.xxhash64("block", "g.grams").alias("gram"), "id", "n", "in_block", F.col("g.counts").alias("tf"))
    df = grams.groupBy("gram").agg(F.sum("n").alias("df"), F.max("in_block").alias("of")).where("df >= 2 or of < 4")
    idf = df.select("gram", "df", (F.log((1 + F.col("of")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = grams.select("gram", "id", "tf").join(idf, "gram").select("id", F.struct("df", "gram", (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    held = raw.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("v"))
    held = held.select("id", F.transform("v", lambda x: x["gram"]).alias("grams"), F.transform("v", lambda x: x["w"]).alias("raw"))
    return held.withColumn("u", _unit(threshold)("raw")).select("id", "grams", F.col("u.ws").alias("ws"), F.col("u.prefix").alias("prefix"))


def tfidf_pairs(
    rows: DataFrame, block: str, id_col: str, text: Column, threshold: float = 0.95, shortest: int = 2, longest: int = 5, most_rows: int = BLOCK_ROWS, most_chars: int = BLOCK_CHARS
) -> tuple[DataFrame, DataFrame]:
    """Pairs (id_a, id_b, similarity), id_a < id_b, of distinct texts of equal block with cosine of at least ``threshold``, and copies (id, cid).

    Each distinct text stands once, by its least id; ``copies`` names the rows
    that have the text of another, whose similarity is 1, so groups of copies
    are never expanded into pairs. A block of at most ``most_rows`` and
    ``most_chars`` is brought into one task, which makes its vectors and pairs
    in memory: what is shuffled are the columns of ``text``, once, and no gram.
    Only the rows of larger blocks have their grams spread over tasks, with the
    same result. A null block is a block of its own; a text without grams is
    like nothing.
    """
    kind = dict(rows.dtypes)[id_col]
    named = rows.withColumn("__block", F.coalesce(F.col(block).cast("string"), F.lit("\u0002")))
    large = cut(named.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select("__block"))
    small = named if large.isEmpty() else named.join(large, "__block", "left_anti")
    # the text is made after the shuffle, from columns that are shorter than it
    together = small.repartition("__block").sortWithinPartitions("__block").select("__block", F.col(id_col).alias("id"), text.alias("text"))
    found = cut(together.mapInPandas(_pairs_of_blocks(threshold, shortest, longest, most_chars), f"block string, id_a {kind}, id_b {kind}, similarity double"))
    pairs = found.where("similarity is not null").select("id_a", "id_b", "similarity")
    copies = found.where("similarity is null and id_b is not null").select(F.col("id_b").alias("id"), F.col("id_a").alias("cid"))
    large = large.unionByName(found.where("id_b is null").select(F.col("block").alias("__block")))
    if large.isEmpty():
        return pairs, copies
    more, more_copies = _spread_pairs(named.join(large, "__block", "left_semi"), "__block", id_col, text, threshold, shortest, longest)
    return pairs.unionByName(more), copies.unionByName(more_copies)


def _pairs_of_blocks(threshold: float, shortest: int, longest: int, most_chars: int):
    """For rows (__block, id, text) in order of blocks: rows (block, id_a, id_b, similarity) of pairs; without similarity of copies; without ids of blocks that are too large."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, texts, chars = None, [], [], 0

        def ended() -> Iterator[pd.DataFrame]:
            if chars > most_chars:
                yield pd.DataFrame({"block": [block], "id_a": pd.Series([None], dtype=object), "id_b": pd.Series([None], dtype=object), "similarity": [np.nan]})
            elif len(ids) > 1:
                cids, members, pairs = _block_pairs(ids, texts, threshold, shortest, longest)
                out = [(cids[a], cids[b], s) for a, b, s in pairs] + [(cids[c], i, None) for c, i in members]
                if out:
                    a, b, s = zip(*out)
                    yield pd.DataFrame({"block": None, "id_a": a, "id_b": b, "similarity": pd.Series(s, dtype="float64")})

        for pdf in batches:
            for name, i, t in zip(pdf["__block"], pdf["id"], pdf["text"]):
                if name != block:
                    yield from ended()
                    block, ids, texts, chars = name, [], [], 0
                chars += len(t or "")
                if chars > most_chars:
                    ids, texts = [], []
                else:
                    ids.append(i)
                    texts.append(t or "")
        yield from ended()

    return found


def _block_pairs(ids: list, texts: list[str], threshold: float, shortest: int, longest: int) -> tuple[list, list[tuple], list[tuple]]:
    """Ids of the distinct texts, least first; (class, id) of other rows; (class, class, cosine) of the pairs of classes.

    The vectors and the prefix filter are those of ``tfidf_vectors`` and
    ``_spread_pairs``. Candidates are left out, too, if their prefixes' product
    and the lengths of what is behind the shorter prefix can't reach the threshold.
    """
    classes: dict[str, int] = {}
    cids, copies = [], []
    for k in sorted(range(len(ids)), key=ids.__getitem__):
        c = classes.setdefault(texts[k], len(cids))
        if c == len(cids):
            cids.append(ids[k])
        else:
            copies.append((c, ids[k]))
    size = len(cids)
    if size < 2:
        return cids, copies, []
    n = np.ones(size)
    np.add.at(n, [c for c, _ in copies], 1)
    row, gram, tf = _grams_of_rows(list(classes), shortest, longest)
    classes.clear()
    # vocabulary in one order, rarest first; what can't be shared is left out
    order = np.argsort(gram)
    gram = gram[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    if not len(first):
        return cids, copies, []
    times = np.diff(np.append(first, len(gram)))
    df = np.add.reduceat(n[row[order]], first)
    kept = (df >= 2) | (len(ids) < 4)
    order, df, times = order[np.repeat(kept, times)], df[kept], times[kept]
    del gram
    place = np.empty(len(df), dtype=np.int64)
    place[np.argsort(df, kind="stable")] = np.arange(len(df))
    idf = np.log((1 + len(ids)) / (1 + df)) + 1
    width = max(len(df), 1)
    key, w = row[order] * np.int64(width) + np.repeat(place, times), tf[order] * np.repeat(idf, times)
    del row, tf, order
    by_row = np.argsort(key)
    key, w = key[by_row], w[by_row]
    row, gram = np.divmod(key, width)
    del by_row
    w = w / np.sqrt(np.bincount(row, w * w, size))[row]
    start = np.searchsorted(row, np.arange(size + 1))
    upto = np.append(0.0, np.cumsum(w * w))
    prefix = np.flatnonzero(upto[start[row + 1]] - upto[:-1] >= threshold * threshold - 1e-9)
    # postings of prefixes: in each gram's the rows ascend, and an entry meets those behind it
    posted = prefix[np.argsort(gram[prefix], kind="stable")]
    held = gram[posted]
    behind = np.searchsorted(held, held, side="right") - np.arange(len(held)) - 1
    last = np.full(size, -1, dtype=np.int64)
    last[row[prefix]] = gram[prefix]
    mine = np.argsort(row[posted], kind="stable")
    mine = mine[behind[mine] > 0]
    ends = np.flatnonzero(np.append(np.diff(row[posted[mine]]) != 0, True)) + 1 if len(mine) else np.zeros(0, dtype=np.int64)
    total = np.append(0, np.cumsum(behind[mine]))
    pairs, at = [], 0
    while at < len(mine):
        # whole rows, at least one
        upper = ends[max(np.searchsorted(total[ends], total[at] + PAIRS_AT_ONCE, side="right") - 1, np.searchsorted(ends, at, side="right"))]
        own = mine[at:upper]
        at = upper
        reps = behind[own]
        x = np.repeat(own, reps)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(reps) - reps, reps)
        x, y = posted[x], posted[y]
        both = row[x] * np.int64(size) + row[y]
        order = np.argsort(both)
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        shared = np.add.reduceat((w[x] * w[y])[order], first)
        a, b = np.divmod(both[first], size)
        end = np.minimum(last[a], last[b])
        left = [np.maximum(upto[start[r + 1]] - upto[np.searchsorted(key, r * np.int64(width) + end, side="right")], 0.0) for r in (a, b)]
        for k in np.flatnonzero(shared + np.sqrt(left[0] * left[1]) >= threshold - 1e-9):
            u, v = slice(start[a[k]], start[a[k] + 1]), slice(start[b[k]], start[b[k] + 1])
            _, i, j = np.intersect1d(gram[u], gram[v], assume_unique=True, return_indices=True)
            if (s := float(np.dot(w[u][i], w[v][j]))) >= threshold:
                pairs.append((int(a[k]), int(b[k]), s))
    return cids, copies, pairs


def _grams_of_rows(texts: list[str], shortest: int, longest: int, chars: int = 250_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the distinct hashed n-grams of each text, as ``_counted_grams`` has them."""
    plain = ["".join(t.split()) for t in texts]
    lengths = np.array([len(t) for t in plain])
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]]
    low = 0
    while low < len(plain):
        high = low + max(int(np.searchsorted(np.cumsum(lengths[low : low + chars]), chars, side="right")), 1)
        points = np.frombuffer("".join(plain[low:high]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        size = lengths[low:high]
        row = np.repeat(np.arange(high - low), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
        h = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, longest + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            if n < shortest:
                continue
            whole = left[: len(h)] >= n
            grams, own = h[whole] ^ np.uint64(n), row[: len(h)][whole]
            if not len(own):
                continue
            ends = np.cumsum(np.maximum(size - n + 1, 0)).tolist()
            for x, y in zip([0, *ends], ends):
                grams[x:y].sort()
            first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])))
            for column, part in zip(out, ((own[first] + low).astype(np.int32), grams[first], np.diff(np.append(first, len(own))).astype(np.int32))):
                column.append(part)
        low = high
    row, gram, tf = (np.concatenate(x) for x in out)
    return row, gram, tf


def _spread_pairs(rows: DataFrame, block: str, id_col: str, text: Column, threshold: float, shortest: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``tfidf_pairs`` for blocks of any size.

    Candidates come from a prefix filter: with each vector's grams in one global
    order, rarest first, two unit vectors can reach the threshold only if their
    prefixes share a gram, where a prefix ends once the weight left over is
    under the threshold. So only rare grams are joined, no pair is lost, and a
    gram that many rows have is in hardly any prefix; where it is, it is spread
    over tasks. Candidates are then scored exactly.
    """
    classes, copies = text_classes(rows, block, id_col, text)
    vectors = cut(tfidf_vectors(classes, threshold, shortest, longest))
    free(classes)
    keys = cut(vectors.select("id", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("key")))
    counts = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    left, right = (keys.select("key", F.col("id").alias(f"id_{x}")) for x in "ab")
    candidates = cut(salted_join(left, right, "key", counts, "id_a").where("id_a < id_b").select("id_a", "id_b").distinct())

    def with_vector(pairs: DataFrame, key: str, other: str, names: tuple[str, str]) -> DataFrame:
        own = vectors.select(F.col("id").alias(key), F.col("grams").alias(names[0]), F.col("ws").alias(names[1]))
        return salted_join(pairs, own, key, candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n")), other)

    scored = with_vector(with_vector(candidates, "id_a", "id_b", ("ga", "wa")), "id_b", "id_a", ("gb", "wb"))
    scored = scored.select("id_a", "id_b", _dot("ga", "wa", "gb", "wb").alias("similarity"))
    return scored.where(F.col("similarity") >= threshold), copies


def among_equals(pairs: DataFrame, copies: DataFrame, rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs of ``tfidf_pairs`` whose rows also have equal ``key``.

    Rows of one text and one key are a group, which stands by its least id:
    groups of near texts and equal keys are paired by their least ids, and every
    other row of a group is paired with that alone. Null keys are equal to none.
    """
    members = rows.select(F.col(id_col).alias("id"), key.cast("string").alias("k")).where("k is not null").join(copies, "id", "left").select("id", F.coalesce("cid", "id").alias("cid"), "k")
    members = cut(members.withColumn("g", digest(F.concat_ws("\u0001", F.col("cid").cast("string"), "k"))))
    groups = cut(members.groupBy("g", "cid", "k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    side = lambda x: groups.select(F.col("cid").alias(f"id_{x}"), "k", F.col("rep").alias(f"rep_{x}"))
    near = pairs.join(side("a"), "id_a").join(side("b"), ["id_b", "k"]).select(F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b"), "similarity")
    own = lookup(members.select("id", "g"), groups.select("g", "rep", "n"), "g", "n").where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(own)


def _unit(threshold: float):
    def scale(weights: pd.Series) -> pd.DataFrame:
        ws, prefix = [], []
        for w in weights:
            w = np.asarray(w, dtype=float)
            norm = float(np.sqrt((w * w).sum()))
            w = w / norm if norm else w
            left = (w * w)[::-1].cumsum()[::-1]
            ws.append(w)
            prefix.append(int((left >= threshold * threshold - 1e-9).sum()))
        return pd.DataFrame({"ws": ws, "prefix": pd.Series(prefix, dtype="int32")})

    scale.__annotations__ = {"weights": pd.Series, "return": pd.DataFrame}
    kind = T.StructType([T.StructField("ws", T.ArrayType(T.DoubleType())), T.StructField("prefix", T.IntegerType())])
    return F.pandas_udf(scale, kind)


@F.pandas_udf(T.DoubleType())
def _dot(ga: pd.Series, wa: pd.Series, gb: pd.Series, wb: pd.Series) -> pd.Series:
    """Product of two sparse vectors, each as its dimensions and weights."""
    out = []
    for x, u, y, v in zip(ga, wa, gb, wb):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        out.append(float(np.dot(np.asarray(u)[i], np.asarray(v)[j])))
    return pd.Series(out, dtype="float64")


def connected_components(pairs: DataFrame, a: str = "id_a", b: str = "id_b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id that each id of a pair is connected with.

    Alternating large-star and small-star steps: every round links each node's
    neighbours to the least of them, which ends in stars after about log^2 of
    the longest path. Rounds are written to the shared folder; ids never reach
    the driver, only the number of edges that changed does.
    """
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = around.join(least, "u")
        if large:
            return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = least.where("u <> m").select("u", F.col("m").alias("v"))
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(own).distinct()

    for _ in range(most_rounds):
        after = cut(star(star(edges, True), False))
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()


def elected(components: DataFrame, rows: DataFrame, id_col: str, quality: Column) -> DataFrame:
    """(id, component, kept_id, members): of each component the row of best quality, of equals the one with the least id."""
    scored = components.join(rows.select(F.col(id_col).alias("id"), quality.alias("q")), "id")
    best = scored.groupBy("component").agg(F.max_by("id", F.struct("q", -F.col("id"))).alias("kept_id"), F.count(F.lit(1)).alias("members"))
    return components.join(best, "component").select("id", "component", "kept_id", "members")
