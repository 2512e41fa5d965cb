"""Session set-up and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, app: str = "sieveworks") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    n = shuffle_partitions or (cores if isinstance(cores, int) else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIEVEWORKS_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the session is a single process is a temporary folder used; a cluster
    without the setting is refused, as a machine-local folder is lost with its
    machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="sieveworks-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This ends the lineage as ``checkpoint()`` does, but columnar and
    compressed, so that later reads take only the columns they need. The table
    outlives lost executors and is removed when the driver's process ends.
    """
    return cut_of_parts(df.sparkSession, [df], df.schema)


def cut_of_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: StructType | str) -> DataFrame:
    """One cut of several tables, each written before the next is taken, so that neither plans nor what they broadcast add up."""
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_cuts)
    _written.append((spark, path))
    some = False
    for part in parts:
        part.write.mode("append").parquet(path)
        some = True
    if not some:
        spark.createDataFrame([], schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def free(table: DataFrame) -> None:
    """Remove the files of a cut from which nothing will be read any more."""
    path = getattr(table, "_cut_path", None)
    for entry in [e for e in _written if e[1] == path]:
        _written.remove(entry)
        _delete(*entry)


@contextmanager
def freeing() -> Iterator[None]:
    """Cuts that are made within are removed at the end; results must be stored or fetched by then."""
    before = {path for _, path in _written}
    try:
        yield
    finally:
        for entry in [e for e in _written if e[1] not in before]:
            _written.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_cuts() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
