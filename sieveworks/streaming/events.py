"""Windows, deduplication and latest records over streams.

``run_to_end`` drives a file stream until all input is read; the same functions
take batch frames, so results can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveworks.session import shared_dir


def file_stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of the first."""
    batch = spark.read.option("pathGlobFilter", pattern).parquet(path) if pattern else spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def tumbling(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) of each window."""
    return windowed(events, ts, by, F.window(ts, width), late)


def sliding(events: DataFrame, ts: str, by: str, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return windowed(events, ts, by, F.window(ts, width, step), late)


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return windowed(events, ts, by, F.session_window(ts, gap), late)


def windowed(events: DataFrame, ts: str, by: str, window: Column, late: str) -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(window.alias("w"), F.col(by))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def deduplicated(events: DataFrame, key: str, ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """First event of each key; with ``ts`` the state is dropped once the watermark has passed."""
    if ts is None:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest_state(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Last values of each key so far, kept as aggregation state."""
    last = F.max_by(F.struct(*columns), F.struct(order, *columns))
    return events.groupBy(key).agg(last.alias("r")).select(key, *[F.col("r")[c].alias(c) for c in columns])


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame until its input is read, and give what it put out."""
    spark = stream.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", home + "/state").option("path", home + "/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(home + "/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/{number:08d}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", home + "/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max((p["batchId"] for p in query.recentProgress), default=0)
    return spark.read.schema(stream.schema).parquet(f"{home}/out/{last:08d}")


def upserted(stream: DataFrame, merge: Callable[[DataFrame, int], None]) -> None:
    """Each micro-batch to ``merge``, exactly once for each batch number if merge overwrites by number."""
    home = f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", home).trigger(availableNow=True).start().awaitTermination()


def error_runs(events: DataFrame, by: str, order: list[str], failed: Column, span: str = "1 day") -> DataFrame:
    """(by, run, n, first, last): unbroken runs of failed events within each ``by``, as gaps and islands.

    A run's number is that of the good events before it. These are counted in
    cells of ``span`` of the first order column, a time, and summed up over the
    cells of a ``by``, so that a ``by`` with a third of all events is numbered by
    many tasks. A null failure is a good event; a null time comes first.
    """
    rows = events.withColumns({"__bad": F.coalesce(failed, F.lit(False)), "__cell": F.coalesce(F.window(order[0], span)["start"], F.lit("0001-01-01").cast("timestamp"))})
    good = F.when(F.col("__bad"), 0).otherwise(1)
    cells = rows.groupBy(F.col(by).alias("__by"), F.col("__cell").alias("__of")).agg(F.sum(good).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("__by", "__of", F.coalesce(upto, F.lit(0)).alias("__start"))
    within = rows.withColumn("__good", F.sum(good).over(Window.partitionBy(by, "__cell").orderBy(*order)))
    bad = within.where("__bad").join(starts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__cell") == F.col("__of")))
    runs = bad.groupBy(by, (F.col("__start") + F.col("__good")).alias("run"))
    return runs.agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def tripped(runs: DataFrame, by: str, most: int) -> DataFrame:
    """First time at which each ``by`` has ``most`` failures in a row; null where it never has."""
    return runs.groupBy(by).agg(F.min(F.when(F.col("n") >= most, F.col("first"))).alias("tripped_run_start"), F.max("n").alias("longest"))
