"""Texts that were cut off by a field's limit or on their way."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.operators.skew import digest, lookup
from sieveworks.session import cut as written

# Marks with which a whole text may end.
TERMINALS = "。！？!?.…）)】」』”\"'》>]}`*；;"
#: An answer as the last thing of a completion; bare letters only if they are all of it.
ANSWER_END = r"(?:答案(?:为|是)?[:：]?\s*[A-Z]+|故选\s*[A-Z]+|选\s*[A-Z]+|<answer>\s*[A-Z]+\s*</answer>|[A-Z]\s*项|^\W*[A-Z]+)[\s*。.）)]*$"
#: A completion that begins so is to end with an answer.
ANSWER_LAYOUT = r"^\s*(?:分析[:：]|<think>|1[.、]\s)"
LIST_END = r"\n\s*[-•·*]\s*[^\n]+$"
#: A cut that something was put after: an ellipsis, then a new block.
PUT_AFTER = r"([^\n])(?:\.{3}|…+)\s*\n+\s*(?:\*\*)?(?:答案|故选|最终答案)"
#: White space that a length may count and the stored text may have lost.
LENGTH_SLACK = 3
#: From the most exact to the least: a limit in one unit makes spikes in those after it.
UNITS = ("chars", "escaped", "bytes")

#: A spike of lengths holds so many values, so many times what is expected, and one as full arises by chance in so few of all sources.
MIN_SPIKE, MIN_EXCESS, CHANCE = 5, 4.0, 0.01
#: Lengths on either side by which a spike is measured, and the least limit of a field of free text (20 ideographs).
AROUND, LEAST_LIMIT = 40, {"chars": 20, "bytes": 60, "escaped": 120}

#: Share of texts cut away from limits before anything is seen of a source, in as many pseudo-texts as the source has texts.
PRIOR_CUT = 0.05
#: Pseudo-texts by which the length posterior of a window speaks against the endings in it: a share of its texts, and at least so many.
WINDOW_STRENGTH, LEAST_STRENGTH = 0.5, 5.0
#: Endings of whole texts by form before anything is seen of a source, and in how many pseudo-texts: a share of the source's texts
#: of that form, and at least so many. So a layout ends with an answer and a text with a mark, unless those of a source do not.
WHOLE_ENDINGS = {
    "layout": {"answered": 0.986, "terminal": 0.01, "list": 0.002, "none": 0.002},
    "plain": {"answered": 0.40, "terminal": 0.49, "list": 0.10, "none": 0.01},
}
WHOLE_STRENGTH, LEAST_WHOLE = 0.02, 20.0
#: Cut texts that an ending must have been expected in before what was seen outweighs what the places say.
PLACES_STRENGTH = 2.0
#: P(seen | cut) / P(seen | whole) of what is not learned: a structure left open, an ellipsis with a block put after it, a damaged
#: character as the last one, and a recorded length that is larger.
OPEN_STRUCTURE, PUT_AFTER_RATIO, DAMAGED_RATIO, LOST_RATIO = 400.0, 400.0, 100.0, 20.0

_STRUCTURAL = re.compile(r"\\.|[\"'{}\[\]]", re.DOTALL)


def _structure(text: str | None) -> int:
    """0: no structure; 1: a structure that is closed; 2: one that is still open at the end."""
    if not text:
        return 0
    if text.count("<think>") > text.count("</think>") or text.count("<answer>") > text.count("</answer>"):
        return 2
    start = text.find("{")
    if start < 0:
        return 2 if text.count("```") % 2 else 0
    depth, quote = 0, ""
    for m in _STRUCTURAL.finditer(text, start):
        c = m[0]
        if quote:
            if c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return 1
        elif c[1] in "\"'":
            quote = c[1]  # outside a text a backslash escapes nothing
    return 2


@F.pandas_udf(T.IntegerType())
def structure_state(text: pd.Series) -> pd.Series:
    return pd.Series([_structure(t) for t in text], dtype="int32")


def _lengths(text: Column) -> dict[str, Column]:
    wide = F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))
    return {
        "chars": F.char_length(text),
        "bytes": F.octet_length(text),
        "escaped": F.char_length(text) + 5 * wide + F.regexp_count(text, F.lit(r'["\\\n\r\t]')),
    }


# -- lengths ----------------------------------------------------------------------------------------------------------


def fit_censored(lengths: np.ndarray, counts: np.ndarray, low: float, high: float | None = None) -> tuple[float, float]:
    """(mean, deviation) of log length by maximum likelihood, values from ``low`` to ``high`` counting as "at least low".

    The expectation-maximisation steps of the right-censored normal
    distribution over a histogram: a censored value is replaced by its expected
    value and square. Values over ``high`` are seen as they are: a limit may
    hold for a part of a source only.
    """
    x = np.log(np.maximum(lengths, 1) + 0.0)
    cens = (lengths >= low) & (lengths <= (np.inf if high is None else high))
    c = math.log(low)
    n, n_cens = counts.sum(), counts[cens].sum()
    xs, ws = x[~cens], counts[~cens]
    if n - n_cens < 2:
        return c, 1.0
    mu, sd = float(np.average(xs, weights=ws)), max(0.05, float(np.sqrt(np.average((xs - np.average(xs, weights=ws)) ** 2, weights=ws))))
    s1, s2 = float((xs * ws).sum()), float((xs * xs * ws).sum())
    for _ in range(60):
        z = (c - mu) / sd
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        mills = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * mills
        e2 = mu * mu + sd * sd + sd * mills * (c + mu)
        new = (s1 + n_cens * e1) / n
        var = max((s2 + n_cens * e2) / n - new * new, 0.0025)
        if abs(new - mu) < 1e-6 and abs(math.sqrt(var) - sd) < 1e-6:
            break
        mu, sd = new, math.sqrt(var)
    return mu, sd


def candidate_limits(lengths: np.ndarray, counts: np.ndarray, unit: str) -> list[tuple[int, int, float]]:
    """(lowest, highest, posterior) length of each candidate limit, all of them.

    A candidate is a spike: a window with several times the values that the
    lengths on both sides of it and the censored fit lead to expect, wherever it
    stands; longer values may lie above, as a limit may have been raised. In
    bytes a cut falls up to three bytes short of the limit, and a broken
    character makes up to two more, so the spike is a window there. The
    posterior of a value in the spike is the share of its count that the fitted
    distribution leaves unexplained. Work grows with the distinct lengths of a
    source, not with the longest of them.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(float)
    sums = np.concatenate([[0.0], np.cumsum(counts)])
    total, reach = float(sums[-1]), 5 if unit == "bytes" else 1

    def held(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.searchsorted(lengths, low, "left"), np.searchsorted(lengths, high, "right")
        return sums[j] - sums[i], j - i

    end = lengths[lengths >= LEAST_LIMIT[unit]]
    low = end - reach + 1
    here, n_here = held(low, end)
    # a length that occurs, not any number: texts of one script have lengths in steps of six units
    near = np.maximum(*(h / np.maximum(n, 1) for h, n in (held(low - AROUND, low - 1), held(end + 1, end + AROUND)))) * n_here
    near = np.maximum(near, 0.02 * reach)
    surprise = math.log(max(len(end), 1) / CHANCE)

    def stands_out(held: np.ndarray | float, expected: np.ndarray | float) -> np.ndarray | bool:
        # the Chernoff bound of a Poisson count, over as many windows as there are
        lam = np.maximum(expected, 1e-9)
        return (held >= MIN_SPIKE) & (held >= MIN_EXCESS * lam) & (held * np.log(np.maximum(held, 1e-9) / lam) - held + lam >= surprise)

    spikes = np.flatnonzero(stands_out(here, near))
    kept: list[tuple[int, int, float]] = []
    # windows overlap in bytes: the fullest is taken, what it covers is left out
    taken: set[int] = set()
    for i in spikes[np.argsort(-here[spikes], kind="stable")]:
        a, b = int(low[i]), int(end[i])
        if any(v in taken for v in range(a, b + 1)):
            continue
        mu, sd = fit_censored(lengths, counts, a, b)
        cdf = lambda v: 0.5 * math.erfc(-(math.log(v) - mu) / (sd * math.sqrt(2)))  # noqa: E731, B023
        expected = max(total * max(cdf(b + 0.5) - cdf(a - 0.5), 0.0), float(near[i]))
        if stands_out(float(here[i]), expected):
            taken.update(range(a, b + 1))
            kept.append((a, b, 1 - expected / float(here[i])))
    return kept


_LIMITS = "kind string, source string, limits array<struct<unit:string,low:int,high:int,posterior:double>>"


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    found = []
    for unit in UNITS:
        part = pdf[pdf["unit"] == unit]
        for low, high, p in candidate_limits(part["length"].to_numpy(), part["n"].to_numpy(dtype=float), unit):
            found.append({"unit": unit, "low": low, "high": high, "posterior": p})
    source = pdf["source"].iloc[0]
    return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "source": [source], "limits": [found]})


def limits_of(rows: DataFrame) -> DataFrame:
    """(kind, source, limits): candidate limits with posteriors, from the length histograms of each source.

    Only counts by length reach the fit, so its task sees as many rows as a
    source has distinct lengths, not texts.
    """
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS])).alias("u")
    hist = rows.select("kind", "source", units).groupBy("kind", "source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("kind", "source").applyInPandas(_fit_source, _LIMITS)


# -- endings ----------------------------------------------------------------------------------------------------------


def _endings(text: Column, state: Column) -> dict[str, Column]:
    """Form and ending of a text, and the shares of its places at which a cut would leave it with such an ending."""
    tail = F.rtrim(F.regexp_replace(text, r"\s+$", ""))
    answer = F.regexp_extract(tail, ANSWER_END, 0)
    last = F.substring(tail, -1, 1)
    before = F.regexp_extract(text, PUT_AFTER, 1)
    n = F.greatest(F.char_length(tail), F.lit(1))
    share = lambda places: F.least(places / n, F.lit(1.0))
    ending = (
        F.when((before != "") & ~F.contains(F.lit(TERMINALS), before), "put_after").when(state == 2, "open").when(state == 1, "closed").when(answer != "", "answered")
        .when(F.contains(F.lit(TERMINALS), last), "terminal").when(last == "�", "damaged").when(tail.rlike(LIST_END), "list").otherwise("none")
    )
    lists = F.aggregate(F.regexp_extract_all(text, F.lit(r"\n\s*[-•·*]\s*[^\n]+"), F.lit(0)), F.lit(0), lambda s, x: s + F.char_length(x))
    return {
        "form": F.when(state > 0, "structured").when(tail.rlike(ANSWER_LAYOUT), "layout").otherwise("plain"),
        "ending": ending,
        # an answer that nothing closes may go on; a closed one ends the text
        "at_answer": F.when(answer.rlike("[A-Z]$"), 1 / n).otherwise(0.1 / n),
        "at_terminal": share(F.regexp_count(tail, F.lit("[" + re.escape(TERMINALS) + "]"))),
        "at_list": share(lists),
        "at_end": 1 / n,
    }


def measured(texts: DataFrame) -> DataFrame:
    """Lengths, form and ending of ``texts`` (kind, id, source, text, recorded, at), once per id; empty and null texts are left out.

    All that is needed of a text is taken from it where it is read: no text is shuffled.
    """
    rows = texts.where("id is not null and text is not null and text <> ''").withColumn("state", structure_state("text"))
    seen = rows.select("kind", "id", "at", F.coalesce("source", F.lit("")).alias("source"), "recorded", *[c.alias(k) for k, c in (_lengths(F.col("text")) | _endings(F.col("text"), F.col("state"))).items()])
    first = seen.groupBy("kind", "id").agg(F.min(F.struct(*[c for c in seen.columns if c not in ("kind", "id")])).alias("r"))
    return first.select("kind", "id", "r.*").drop("at")


# -- both -------------------------------------------------------------------------------------------------------------

_CELL = ("spikes", "form", "ending", "lost")
_MODEL = "cell binary, n long, posterior double, score double"


#: Endings and the share of a text's places at which a cut would leave them.
PLACES = {"answered": "at_answer", "terminal": "at_terminal", "list": "at_list"}


def own_spikes(spikes: pd.Series, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, posterior) of each cell: the spike that its lengths belong to, -1 and 0 for none.

    A limit in one unit makes spikes in the others too, and their windows hold texts
    that stand at no limit. Spikes come in the order of their units, and one whose
    texts beyond those of earlier spikes are no more than it would hold by chance is none.
    """
    held = [dict((int(i), float(p)) for i, p in (h.split("=") for h in s.split(","))) if s else {} for s in spikes]
    known = {i: p for h in held for i, p in h.items()}
    full = {i: sum(c for c, h in zip(n, held) if i in h) for i in known}
    window, posterior = np.full(len(n), -1), np.zeros(len(n))
    for i in sorted(known):
        free = np.array([i in h for h in held]) & (window < 0)
        if n[free].sum() >= MIN_EXCESS * full[i] * (1 - known[i]) and n[free].sum() >= MIN_SPIKE:
            window[free], posterior[free] = i, known[i]
    return window, posterior


def fit_endings(cells: pd.DataFrame) -> pd.DataFrame:
    """Log-odds of being cut for each cell (spikes, form, ending, lost) of one source, by expectation-maximisation.

    ``cells`` has n, the spikes that lengths stand in, with their posteriors, and
    mean shares of places. Estimated are the share of cut texts away from limits and in each
    window, where the length posterior is the prior; the endings of whole texts,
    from texts away from limits; and by how much cut texts have an ending more
    or less often than a cut at any place of the texts would leave it.
    """
    n = cells["n"].to_numpy(dtype=float)
    form, ending = (cells[c].to_numpy() for c in ("form", "ending"))
    window, posterior = own_spikes(cells["spikes"], n)
    off, lost = window < 0, np.where(cells["lost"].to_numpy(dtype=bool), LOST_RATIO, 1.0)
    learned = {(f, e): (form == f) & (ending == e) for f, prior in WHOLE_ENDINGS.items() for e in prior}
    places = {e: np.clip(cells[c].to_numpy(dtype=float), 1e-4, 0.9) for e, c in PLACES.items()}
    places["none"] = np.clip(1 - sum(places.values()), 0.1, 1.0)
    open_ended = (form != "structured") & ~np.isin(ending, ("put_after", "damaged"))
    held_to = {f: max(WHOLE_STRENGTH * n[form == f].sum(), LEAST_WHOLE) for f in WHOLE_ENDINGS}
    ended = np.clip(cells["at_end"].to_numpy(dtype=float), 1e-6, 1.0)
    fixed = np.select([ending == "put_after", ending == "damaged", ending == "open", ending == "closed"], [PUT_AFTER_RATIO, DAMAGED_RATIO, OPEN_STRUCTURE, ended], 1.0)
    windows = {int(w): float(p) for w, p in zip(window, posterior) if w >= 0}
    inside = {w: window == w for w in windows}
    strength = {w: max(WINDOW_STRENGTH * n[own].sum(), LEAST_STRENGTH) for w, own in inside.items()}
    away, at = PRIOR_CUT, dict(windows)
    whole, more = {f: dict(p) for f, p in WHOLE_ENDINGS.items()}, dict.fromkeys(PLACES, 1.0)
    for _ in range(60):
        ratio = fixed.copy()
        for (f, e), own in learned.items():
            ratio[own] = (places[e] * more.get(e, 1.0))[own] / whole[f][e]
        prior = np.array([away if w < 0 else at[int(w)] for w in window])
        odds = np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6)) * ratio * lost
        cut = n * odds / (1 + odds)
        away = (cut[off].sum() + PRIOR_CUT * n.sum()) / (n[off].sum() + n.sum())
        at = {w: (cut[own].sum() + strength[w] * windows[w]) / (n[own].sum() + strength[w]) for w, own in inside.items()}
        for f, prior_endings in WHOLE_ENDINGS.items():
            mass = {e: held_to[f] * p + (n - cut)[learned[f, e] & off].sum() for e, p in prior_endings.items()}
            whole[f] = {e: m / sum(mass.values()) for e, m in mass.items()}
        for e in PLACES:
            seen, expected = cut[open_ended & (ending == e)].sum(), (cut * places[e])[open_ended].sum()
            more[e] = (PLACES_STRENGTH + seen) / (PLACES_STRENGTH + expected)
    return cells[["cell", "n"]].assign(posterior=posterior, score=np.log(odds))


def _cell_key(*extra: str) -> Column:
    return digest(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in ("kind", "source", *extra)]))


def evidence(texts: DataFrame) -> DataFrame:
    """Each distinct record (kind, id, source, cell) with the spikes its lengths stand in and its form and ending."""
    rows = written(measured(texts).withColumn("of", _cell_key()))
    limits = limits_of(rows)
    sizes = rows.groupBy("kind", "source", "of").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col("recorded") == F.col(u)).cast("double")).alias(f"as_{u}") for u in ("chars", "bytes")]
    )
    known = written(sizes.join(limits, ["kind", "source"], "left").select("of", "n", "limits", "as_chars", "as_bytes"))
    length = lambda l: F.when(l["unit"] == "chars", F.col("chars")).when(l["unit"] == "bytes", F.col("bytes")).otherwise(F.col("escaped"))
    stands_in = F.transform(
        F.coalesce("limits", F.array()), lambda l, i: F.when(length(l).between(l["low"], l["high"]), F.concat(i.cast("string"), F.lit("="), l["posterior"].cast("string")))
    )
    own = F.when((F.col("as_bytes") > F.col("as_chars")) & (F.col("as_bytes") >= 0.5), F.col("bytes")).when(F.col("as_chars") >= 0.5, F.col("chars"))
    seen = lookup(rows, known, "of", "n").withColumns(
        {"spikes": F.array_join(F.array_compact(stands_in), ","), "lost": F.coalesce(F.col("recorded") - own > LENGTH_SLACK, F.lit(False))}
    )
    return written(seen.select("kind", "id", "source", *_CELL, *PLACES.values(), "at_end", _cell_key(*_CELL).alias("cell")))


def _scores(seen: DataFrame) -> DataFrame:
    """(cell, n, posterior, score): log-odds of every cell, from counts per cell; a task sees the cells of one source."""
    shares = [F.avg(c).alias(c) for c in (*PLACES.values(), "at_end")]
    cells = seen.groupBy("kind", "source", *_CELL, "cell").agg(F.count(F.lit(1)).alias("n"), *shares)
    return cells.groupBy("kind", "source").applyInPandas(fit_endings, _MODEL)


def judged(texts: DataFrame) -> DataFrame:
    """Each distinct record with its evidence: (kind, id, source, at_limit, lost, score, cut).

    ``texts`` has kind, id, source, text, recorded (a length noted elsewhere,
    may be null) and at (delivery time). Lengths of each source are fitted as
    right-censored at every spike; ``at_limit`` is the posterior that a length
    in a spike is a censored one. Endings are weighed by how often whole texts of
    the source have them and how often a cut would leave them, and both together
    give ``score``, the log-odds; ``cut`` is a score over 0. So a sentence's end
    speaks against a cut, but not at a limit where more texts stand than the
    source's whole texts explain, and a missing full stop speaks for one, but
    not in a source whose texts have none.

    A row delivered again counts once, by its first delivery. Null or empty
    texts are not judged and never a case; a null source is one source; very
    long texts are read whole. An empty table gives no rows.
    """
    seen = evidence(texts)
    scores = written(_scores(seen))
    out = lookup(seen.select("kind", "id", "source", "lost", "cell"), scores, "cell", "n")
    return out.select("kind", "id", "source", F.col("posterior").alias("at_limit"), "lost", "score", (F.col("score") > 0).alias("cut"))


def reward_and_eval_texts(rewards: DataFrame, evals: DataFrame) -> DataFrame:
    """The texts of both tables in one shape."""
    a = rewards.select(
        F.lit("choice_reward").alias("kind"), F.col("reward_id").alias("id"), "source", F.col("completion").alias("text"),
        F.col("completion_length").cast("long").alias("recorded"), F.col("logged_at").alias("at"),
    )
    b = evals.select(
        F.lit("eval_result").alias("kind"), F.col("eval_id").alias("id"), "source", F.col("raw_output").alias("text"),
        F.col("response_length").cast("long").alias("recorded"), F.col("logged_at").alias("at"),
    )
    return a.unionByName(b)


def cut_rates(texts: DataFrame) -> DataFrame:
    """(record_kind, source, n_texts, n_cut, cut_rate, n_at_limit) per source."""
    return (
        judged(texts)
        .groupBy(F.col("kind").alias("record_kind"), "source")
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.count_if("cut").alias("n_cut"),
            F.bround(F.avg(F.col("cut").cast("double")), 6).alias("cut_rate"),
            F.count_if(F.col("at_limit") > 0.5).alias("n_at_limit"),
        )
    )
