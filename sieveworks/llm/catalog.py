"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import p1_proportions as p1
from sieveworks.llm import p2_truncation as p2
from sieveworks.llm import p3_cross_split as p3
from sieveworks.llm import p4_formatting as p4
from sieveworks.llm import p5_lookalikes as p5
from sieveworks.llm import p6_containers as p6
from sieveworks.llm import p7_mixing as p7
from sieveworks.llm import p8_personal as p8

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _p1_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _t(spark, d, "choice_reward"), _t(spark, d, "question_type_alias"), _t(spark, d, "sample_plan")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1.deficits(*_p1_inputs(spark, d)).select("plan_id", "line_id")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return p1.sample(*_p1_inputs(spark, d))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return p1.shares(*_p1_inputs(spark, d))


def _p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return p2.reward_and_eval_texts(_t(spark, d, "choice_reward"), _t(spark, d, "eval_result"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2.judged(_p2_texts(spark, d)).where("cut").select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return p2.cut_rates(_p2_texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p3.overlap_pairs(_t(spark, d, "exam_item"))
    return pairs.select(F.col("id_a").alias("item_id_a"), F.col("id_b").alias("item_id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3.overlap_report(_t(spark, d, "exam_item"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    copies = p4.copies_of(_t(spark, d, "exam_item"))
    return copies.select(F.col("kept_id").alias("kept_item_id"), F.col("copy_id").alias("copy_item_id"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return p4.collapsed_records(_t(spark, d, "exam_item")).select(F.col("kept_id").alias("kept_item_id"), "copies", "n_forms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p5.lookalike_pairs(_t(spark, d, "sft_row"))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p5_one_form(spark: SparkSession, d: str) -> DataFrame:
    """Every row's texts in one form; options as text in the order of their keys."""
    rows = p5.in_one_form(_t(spark, d, "sft_row"), ["question", "answer"], "options")
    entries = F.array_sort(F.map_entries("options"))
    return rows.select("row_id", "question", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("options"), "answer")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return p6.fill(_t(spark, d, "documents"), _t(spark, d, "container_spec"))[0]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return p6.fill_report(_t(spark, d, "documents"), _t(spark, d, "container_spec"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return p7.mixed(_t(spark, d, "documents"), _t(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return p7.actual_shares(_t(spark, d, "documents"), _t(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = p8.find(_t(spark, d, "documents")).where(F.col("kind").isin("name", "email", "phone", "id_number", "address"))
    return found.select(F.col("id").alias("doc_id"), "kind", "found_text")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", p8.redacted(F.col("text")).alias("text"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_sample, p1_shares, p2_found, p2_rates, p3_found, p3_report, p4_found, p4_collapsed, p5_found, p5_one_form, p6_containers, p6_report, p7_uses, p7_shares, p8_found, p8_redacted)}


_P1_LINES = """
WITH alias AS (SELECT lower(trim(label_variant)) AS label, min(question_type) AS question_type FROM question_type_alias GROUP BY 1),
cats AS (
  SELECT reward_id, arg_min(question_type, logged_at) AS question_type, arg_min(difficulty, logged_at) AS difficulty
  FROM (SELECT r.reward_id, r.logged_at, a.question_type,
          CASE WHEN lower(trim(r.difficulty)) IN ('direct', 'brief', 'cot') THEN lower(trim(r.difficulty)) ELSE 'brief' END AS difficulty
        FROM choice_reward r JOIN alias a ON lower(trim(r.question_type)) = a.label)
  GROUP BY reward_id),
size AS (SELECT count(*) AS n FROM cats),
members AS (
  SELECT p.plan_id, p.line_id, c.reward_id FROM sample_plan p JOIN cats c
    ON (p.question_type IS NULL OR p.question_type = c.question_type) AND (p.difficulty IS NULL OR p.difficulty = c.difficulty)),
have AS (SELECT plan_id, line_id, count(*) AS available FROM members GROUP BY ALL),
lines AS (
  SELECT p.plan_id, p.line_id, greatest(CAST(p.min_rows AS BIGINT), CAST((size.n * p.sample_pct // 100) * p.target_pct // 100 AS BIGINT)) AS wanted,
         CAST(coalesce(have.available, 0) AS BIGINT) AS available
  FROM sample_plan p CROSS JOIN size LEFT JOIN have USING (plan_id, line_id)),
ranked AS (
  SELECT plan_id, line_id, reward_id,
    row_number() OVER (PARTITION BY plan_id, line_id ORDER BY substr(md5('p1:' || line_id || ':' || reward_id), 1, 16), reward_id) AS rn
  FROM members),
drawn AS (SELECT plan_id, line_id, reward_id FROM ranked JOIN lines USING (plan_id, line_id) WHERE rn <= wanted)
"""

_CANON_MACRO = {
    # signs that may stay are private characters while punctuation goes; twice, as matches do not overlap
    "hide": (".．:：-－‐‑%％/／", "\ue000\ue000\ue001\ue001\ue002\ue002\ue005\ue006\ue003\ue003\ue004\ue004"),
    "steps": (
        (r"[\s\x{00A0}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}\x{1680}\x{180E}\x00-\x1F\x7F-\x9F]+", ""),
        (r"[\p{P}`^|¨´¸]", ""),
        ("([0-9])\ue000([0-9])", "\\1\ue007\\2"),
        ("([0-9])\ue000([0-9])", "\\1\ue007\\2"),
        ("([0-9])\ue001([0-9])", "\\1\ue008\\2"),
        ("([0-9])\ue001([0-9])", "\\1\ue008\\2"),
        ("[\ue000\ue001]", ""),
    ),
    "back": ("\ue007\ue008\ue002\ue005\ue006\ue003\ue004＋～＜＞＝", ".:-‐‑%/+~<>="),
}


def _canon_sql(expr: str) -> str:
    out = f"translate(lower(coalesce({expr}, '')), '{_CANON_MACRO['hide'][0]}', '{_CANON_MACRO['hide'][1]}')"
    for pattern, by in _CANON_MACRO["steps"]:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"translate({out}, '{_CANON_MACRO['back'][0]}', '{_CANON_MACRO['back'][1]}')"


_P4_GROUPS = f"""
WITH canon AS (
  SELECT item_id, CAST(question AS VARCHAR) || chr(1) || CAST(options AS VARCHAR) AS raw,
    {_canon_sql("question")} || chr(1) || coalesce(array_to_string(list_sort(list_transform(map_entries(options), lambda e: {_canon_sql("e.key")} || chr(2) || {_canon_sql("e.value")})), chr(1)), '') AS c,
    to_json({{'q': question, 'o': map_entries(options)}}) AS form
  FROM exam_item),
groups AS (SELECT c, min(item_id) AS kept_item_id, count(*) AS copies, count(DISTINCT form) AS n_forms FROM canon GROUP BY c)
"""


# What looks alike, said again for the SQL: a wrong entry of the operator's tables shows as a difference.
_ALIKE = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο": "ABEZHIKMNOPTYXo", "АВЕЅІЈКМНОРСТУХаеѕіјорсух": "ABESIJKMHOPCTYXaesijopcyx",
    "⺠⻅⻆⻉⻋⻓⻔⻘⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳": "民见角贝车长门青页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟", "µ‐‑": "μ--",
}
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_SHAPELESS = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}"


def _look_sql(expr: str, null: str = "''") -> str:
    """The one form by whole-text steps: characters one for one, then shapeless ones, then composition."""
    pairs = {a: b for theirs, ours in _ALIKE.items() for a, b in zip(theirs, ours)} | dict.fromkeys(_SPACES, " ")
    pairs |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0) != "'"}
    # half-width and full-width forms and the radicals, by their compatibility form
    pairs |= {chr(c): f for c in (*range(0xFF61, 0xFFA0), *range(0xFFE0, 0xFFE7), *range(0x2F00, 0x2FD6)) if len(f := unicodedata.normalize("NFKC", chr(c))) == 1}
    out = f"translate(regexp_replace(coalesce({expr}, {null}), '[{_SHAPELESS}]', '', 'g'), '{''.join(pairs)}', '{''.join(pairs.values())}')"
    for a, b in (("℃", "°C"), ("℉", "°F")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def _p5_entries(key: str, value: str, between: str = "chr(2)") -> str:
    return f"list_transform(map_entries(options), lambda e: {key} || {between} || {value})"


_P5_RAW = f"coalesce(question, '') || chr(1) || coalesce(answer, '') || chr(1) || coalesce(array_to_string(list_sort({_p5_entries('e.key', 'e.value')}), chr(1)), '')"
_P5_LOOK = (
    f"{_look_sql('question')} || chr(1) || {_look_sql('answer')} || chr(1) || "
    f"coalesce(array_to_string(list_sort({_p5_entries(_look_sql('e.key'), _look_sql('e.value'))}), chr(1)), '')"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_LINES + "SELECT plan_id, line_id FROM lines WHERE available < wanted",
        "p1_sample": _P1_LINES + "SELECT plan_id, line_id, reward_id FROM drawn",
        "p1_shares": _P1_LINES
        + """SELECT plan_id, line_id, wanted, available, drawn,
          round_even(100.0 * drawn / nullif(CAST(sum(drawn) OVER (PARTITION BY plan_id) AS DOUBLE), 0), 4) AS share_pct
        FROM (SELECT lines.*, (SELECT count(*) FROM drawn d WHERE d.line_id = lines.line_id AND d.plan_id = lines.plan_id) AS drawn FROM lines)""",
        "p4_found": _P4_GROUPS + "SELECT kept_item_id, item_id AS copy_item_id FROM canon JOIN groups USING (c) WHERE item_id > kept_item_id",
        "p5_found": f"""WITH looks AS (SELECT row_id, {_P5_RAW} AS raw, {_P5_LOOK} AS look FROM sft_row)
        SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM looks a JOIN looks b USING (look) WHERE a.row_id < b.row_id AND a.raw <> b.raw""",
        "p5_one_form": f"""SELECT row_id, {_look_sql('question', 'NULL')} AS question,
          coalesce(array_to_string(list_transform(list_sort(list_transform(map_entries(options), lambda e: {{'k': {_look_sql('e.key', 'NULL')}, 'v': {_look_sql('e.value', 'NULL')}}})), lambda e: e.k || '=' || e.v), '|'), CASE WHEN options IS NULL THEN NULL ELSE '' END) AS options,
          {_look_sql('answer', 'NULL')} AS answer FROM sft_row""",
        "p4_collapsed": _P4_GROUPS + "SELECT kept_item_id, copies, n_forms FROM groups",
    }
