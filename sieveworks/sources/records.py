"""Readers of JSON, text and table files. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is no white space is an opening bracket; a few bytes are read."""
    head = spark.read.format("text").load(path).select(F.trim("value").alias("v")).where("v <> ''").limit(1).collect()
    return bool(head) and head[0]["v"].startswith("[")


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None, tolerant: bool = False) -> DataFrame:
    """A JSON array or JSON lines. Bad lines raise, or with ``tolerant`` are left out; blank lines are skipped.

    Give a schema for large inputs; without one Spark reads them twice.
    """
    reader = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").option("multiLine", is_json_array(spark, path))
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, or an empty table if there is no such path."""
    return read_records(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_numbered_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines with path and line_no (from 1, blank lines counted), checked to be objects.

    Line numbers need the lines in the order of the file: parts of files are
    counted first, and each part's numbers are shifted by the parts before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    tagged = lines.withColumn("__m", F.monotonically_increasing_id())
    within = F.row_number().over(Window.partitionBy("path", "start").orderBy("__m"))
    counts = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("path", "start", before.alias("shift"))
    numbered = tagged.withColumn("rn", within).join(shifts, ["path", "start"]).withColumn("line_no", (F.col("rn") + F.col("shift")).cast("long"))
    rows = numbered.where(F.trim("value") != "").withColumn("r", F.from_json("value", schema))
    bad = F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(" is not a JSON object")))
    ok = rows.select("path", "line_no", F.when(F.col("value").rlike(r"^\s*\{") & F.col("r").isNotNull(), F.col("r")).otherwise(bad).alias("r")).select("path", "line_no", "r.*")
    return ok.orderBy("path", "line_no").limit(limit) if limit else ok


def aligned_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there; columns in the order in which they come first."""
    if not frames:
        raise ValueError("no frames")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.jsonl", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return (reader.schema(schema) if schema else reader).json(root)


def read_lines(spark: SparkSession, path: str, keep_linebreaks: bool = False) -> DataFrame:
    rows = spark.read.text(path).withColumnRenamed("value", "text")
    return rows.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else rows


def read_text_or_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One column of texts from text files or JSON lines; both kinds together are refused."""
    kinds = {"json" if p.endswith((".json", ".jsonl")) else "text" for p in paths}
    if len(kinds) != 1:
        raise ValueError("text files and JSON files can't be mixed")
    return spark.read.schema("text string").json(list(paths)) if kinds == {"json"} else spark.read.text(list(paths)).withColumnRenamed("value", "text")


def read_tabbed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path, sep="\t")


def named_sets(spark: SparkSession, specs: Sequence[str]) -> dict[str, DataFrame]:
    """``name=path`` specs to frames; paths that don't exist are skipped."""
    pairs = [spec.split("=", 1) for spec in specs]
    return {name: read_records(spark, path) for name, path in pairs if exists(spark, path)}


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: str | None = None) -> DataFrame:
    """Files of several splits as one frame with a split column."""
    return aligned_union([read_records(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items()])


def content_digests(spark: SparkSession, path: str, head: int = 1 << 20) -> DataFrame:
    """(path, digest) of the first bytes of each file; files are read by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5(F.substring("content", 1, head)).alias("digest"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(ArrayType(StringType()))
def _docx_lines(contents: pd.Series) -> pd.Series:
    """Paragraphs of word-processor files, stripped, blank ones left out; null for what is no such file."""

    def read(content: bytes | None) -> list[str] | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        found = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
        return [x for x in found if x]

    return pd.Series([read(c) for c in contents], dtype=object)


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines) of text, Markdown, HTML and DOCX files, by their endings. There is no reader of PDF here."""
    from sieveworks.operators.chunks import html_lines, markdown_lines

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.decode(F.when(~F.col("path").rlike(r"(?i)\.docx$"), F.col("content")), "UTF-8").alias("t"))
    plain = F.filter(F.transform(F.split("t", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines: Column = F.when(F.col("path").rlike(r"(?i)\.html?$"), html_lines(F.col("t"))).when(F.col("path").rlike(r"(?i)\.md$"), markdown_lines(F.col("t"))).otherwise(plain)
    lines = F.when(F.col("path").rlike(r"(?i)\.docx$"), _docx_lines("content")).otherwise(lines)
    return files.select("path", lines.alias("lines"))
