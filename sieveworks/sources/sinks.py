"""Writers of JSON lines, splits, logs and small reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_lines(rows: DataFrame, path: str, one_file: bool = False, append: bool = False) -> None:
    """JSON lines in UTF-8. ``one_file`` is for small results only: it takes one task."""
    (rows.coalesce(1) if one_file else rows).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_split(rows: DataFrame, path: str, by: str) -> None:
    """One pass to a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).option("ignoreNullFields", "false").json(path)


def write_index(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A table for later reads."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def array_to_lines(spark, source: str, target: str) -> None:
    write_lines(spark.read.option("multiLine", True).json(source), target)


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A table of a small aggregate; more than ``most`` rows are refused, so no data reach the driver by mistake."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in held)])


def report(title: str, sections: Mapping[str, DataFrame]) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown_table(rows)}" for name, rows in sections.items()) + "\n"


def pretty_json(rows: DataFrame, most: int = 200) -> str:
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a report has at most {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in held], ensure_ascii=False, indent=2, default=str)
