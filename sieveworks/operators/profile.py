"""Counts, distributions and quantiles for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, column: str, top: int = 12, unknown: str = "unknown") -> DataFrame:
    """(value, n, pct) of the ``top`` most frequent values, of equals the least; null is ``unknown``."""
    counts = rows.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.lit(rows.count())
    return counts.orderBy(F.desc("n"), "value").limit(top).select("value", "n", F.bround(100.0 * F.col("n") / total, 4).alias("pct"))


def counts_by_each(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])).alias("s")
    return rows.select(each).groupBy("s.field", "s.value").agg(F.count(F.lit(1)).alias("n"))


def element_counts(rows: DataFrame, array: str) -> DataFrame:
    """(value, n) of the elements of an array column."""
    return rows.select(F.explode(array).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def accepted_share(rows: DataFrame, reject: str) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col(reject).isNull())
    return rows.agg(n.alias("total"), ok.alias("accepted"), (n - ok).alias("rejected"), F.bround(100.0 * ok / n, 4).alias("accepted_pct"))


def quantiles(rows: DataFrame, value: Column, points: Sequence[float] = (0.5, 0.75, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """Count, least, greatest, mean and interpolated quantiles; nulls are left out."""
    v = rows.withColumn("__v", value).where("__v is not null").groupBy(*by)
    return v.agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("greatest"), F.bround(F.avg("__v"), 6).alias("mean"),
        *[F.bround(F.percentile("__v", F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in points],
    )


def upper_median(rows: DataFrame, value: Column) -> DataFrame:
    """The value at place n // 2 of the ordered values."""
    counts = rows.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # a running sum over the distinct values; equal ones are counted before they are moved
    upto = counts.withColumns({"upto": F.sum("n").over(Window.orderBy("v")), "total": F.sum("n").over(Window.partitionBy())})
    return upto.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("v")).where("v is not null")


def binned(rows: DataFrame, value: Column, bins: Sequence[tuple[str, float]], lowest: str) -> DataFrame:
    """(bin, n): the first bin whose lower bound the value reaches."""
    name = F.lit(lowest)
    for label, bound in reversed(bins):
        name = F.when(value >= bound, F.lit(label)).otherwise(name)
    return rows.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def difference_histogram(rows: DataFrame, pred: Column, gold: Column, end: int = 3) -> DataFrame:
    """(difference, n) of lengths, with open bins at ``-end`` and ``+end``."""
    d = F.length(pred) - F.length(gold)
    label = F.when(d >= end, F.lit(f"+{end}_or_more")).when(d <= -end, F.lit(f"-{end}_or_less")).when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string"))
    return rows.groupBy(label.alias("difference")).agg(F.count(F.lit(1)).alias("n"))


def target_report(rows: DataFrame, bucket: str, plan: DataFrame, selected: DataFrame) -> DataFrame:
    """(bucket, target, available, selected) for each bucket of the plan."""
    count = lambda d, name: d.groupBy(bucket).agg(F.count(F.lit(1)).alias(name))
    out = plan.join(count(rows, "available"), bucket, "left").join(count(selected, "selected"), bucket, "left")
    return out.fillna(0, ["available", "selected"])


def errors_of(rows: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """Mean squared and mean absolute error of paired scores."""
    d = pred - gold
    return rows.agg(F.count(d).alias("n"), F.bround(F.avg(d * d), 6).alias("mse"), F.bround(F.avg(F.abs(d)), 6).alias("mae"))


def shifted_accuracy(pred: Column, labels: Column, ignored: int = -100) -> Column:
    """struct(right, counted): predictions against the next label, ignored labels left out."""
    heads, tails = F.slice(pred, F.lit(1), F.greatest(F.size(pred) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(heads, tails, lambda p, l: F.struct(p.alias("p"), l.alias("l"))), lambda x: x["l"] != ignored)
    return F.struct(F.size(F.filter(pairs, lambda x: x["p"] == x["l"])).alias("right"), F.size(pairs).alias("counted"))


def perplexity(rows: DataFrame, nll: Column, length: Column) -> DataFrame:
    return rows.agg(F.bround(F.exp(F.sum(nll) / F.sum(length)), 6).alias("perplexity"))


def observed(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``rows`` whose number, and number of rows with no null, are counted as they pass; read them from the observation after an action."""
    seen = Observation(name)
    whole = F.lit(True)
    for c in rows.columns:
        whole = whole & F.col(c).isNotNull()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("whole_rows")), seen
