import json

import pytest
from pyspark.sql import functions as F

from sieveworks.sources import records, sinks
from sieveworks.streaming import events


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"x": 1, "y": "甲"}\n\n{"x": 2}\n', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"x": 3, "z": 5}]', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\nnope\n', encoding="utf-8")
    a, b = records.read_records(spark, str(tmp_path / "a.jsonl")), records.read_records(spark, str(tmp_path / "b.json"))
    union = records.aligned_union([a, b])
    assert union.columns == ["x", "y", "z"] and sorted(r["x"] for r in union.collect()) == [1, 2, 3]
    assert records.read_records(spark, str(tmp_path / "bad.jsonl"), "x int", tolerant=True).count() == 1
    with pytest.raises(Exception, match=".*"):
        records.read_records(spark, str(tmp_path / "bad.jsonl"), "x int").collect()
    assert records.read_or_empty(spark, str(tmp_path / "none.jsonl"), "x int").count() == 0
    lines = records.read_numbered_lines(spark, str(tmp_path / "a.jsonl"), "x int, y string").orderBy("line_no").collect()
    assert [(r["line_no"], r["x"]) for r in lines] == [(2, 1), (4, 2)]
    assert records.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "a.jsonl")]).endswith("a.jsonl")
    with pytest.raises(FileNotFoundError):
        records.first_existing(spark, [str(tmp_path / "none")])
    (tmp_path / "t.tsv").write_text("q\ta\n", encoding="utf-8")
    assert records.read_tabbed(spark, str(tmp_path / "t.tsv"), ["input", "output"]).first()["output"] == "a"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# Title\n\n- **bold** [link](u)\n", encoding="utf-8")
    assert records.document_lines(spark, str(tmp_path / "d")).first()["lines"] == ["Title", "bold link"]
    assert records.content_digests(spark, str(tmp_path / "d")).count() == 1
    assert set(records.named_sets(spark, [f"a={tmp_path / 'a.jsonl'}", f"n={tmp_path / 'none'}"])) == {"a"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x", "甲"), ("y", None)], "s string, v string")
    sinks.write_lines(rows, str(tmp_path / "o"), one_file=True)
    sinks.write_lines(rows, str(tmp_path / "o"), append=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 4
    sinks.write_split(rows, str(tmp_path / "s"), "s")
    assert (tmp_path / "s" / "s=x").exists()
    assert "| x | 甲 |" in sinks.report("T", {"a": rows}) and json.loads(sinks.pretty_json(rows))[1]["v"] is None
    with pytest.raises(ValueError, match="at most"):
        sinks.markdown_table(spark.range(300))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("t").alias("event_type"), F.col("id").cast("double").alias("value")
    )
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    got = events.run_to_end(events.deduplicated(stream.select("user_id"), "user_id"))
    assert got.count() == 7
    last = events.run_to_end(events.latest_state(events.file_stream(spark, str(tmp_path / "in"), files_per_batch=2), "user_id", "ts", ["event_id"]), "complete")
    assert {r["user_id"]: r["event_id"] for r in last.collect()} == {u: max(i for i in range(300) if i % 7 == u) for u in range(7)}
    windows = events.run_to_end(events.tumbling(events.file_stream(spark, str(tmp_path / "in")), "ts", "event_type", "1 hour"))
    batch = {(r["start"], r["n"]) for r in events.tumbling(rows, "ts", "event_type", "1 hour").collect()}
    assert {(r["start"], r["n"]) for r in windows.collect()} <= batch
    runs = events.error_runs(rows.withColumn("bad", F.col("event_id").between(10, 40)), "event_type", ["ts", "event_id"], F.col("bad"))
    assert [r["n"] for r in runs.collect()] == [31] and events.tripped(runs, "event_type", 40).first()["tripped_run_start"] is None


def test_core_stands_without_the_subpackage():
    from pathlib import Path

    import sieveworks

    root = Path(sieveworks.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "sieveworks.llm" not in file.read_text(encoding="utf-8"), file


def test_word_processor_files(spark, tmp_path):
    import zipfile

    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t> 第一</w:t></w:r><w:r><w:t>段 </w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_text("no archive")
    (tmp_path / "c.txt").write_text("x\n\n y ")
    got = {r["path"].rsplit("/", 1)[1]: r["lines"] for r in records.document_lines(spark, f"{tmp_path}/*").collect()}
    assert got == {"a.docx": ["第一段", "two"], "b.docx": None, "c.txt": ["x", "y"]}


def test_error_runs_across_cells(spark):
    import datetime
    import itertools
    import random

    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot"] * 3 + ["a", None]), start + datetime.timedelta(minutes=rng.randrange(5000)), i, rng.choice([True, True, False, None])) for i in range(400)]
    table = spark.createDataFrame(rows, "who string, ts timestamp, id long, bad boolean")
    want = []
    for who in ("hot", "a", None):
        own = sorted((r[1], r[2], bool(r[3])) for r in rows if r[0] == who)
        want += [(who, len(g), g[0][0], g[-1][0]) for bad, g in ((k, list(v)) for k, v in itertools.groupby(own, key=lambda r: r[2])) if bad]
    for span in ("1 hour", "3 days"):
        got = events.error_runs(table, "who", ["ts", "id"], F.col("bad"), span).collect()
        assert sorted(map(repr, ((r["who"], r["n"], r["first"], r["last"]) for r in got))) == sorted(map(repr, want))
