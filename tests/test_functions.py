import math

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import choices, hashing, jsonx, rules, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (lambda: text.comparison_form(F.col("x")), "Ａ，b 。Ｃ（1）", "abc1"),
        (lambda: text.comparison_form(F.col("x")), None, ""),
        (lambda: text.clean(F.col("x")), "　ab　", "ab"),
        (lambda: text.layout_form(F.col("x")), "a  b \r\n\r\n\r\n\r\n c", "a b\n\nc"),
        (lambda: text.layout_form(F.col("x"), 1), "a\n\n\nb", "a\nb"),
        (lambda: text.without_hedges(F.col("x")), "可能性大 肺炎待排?", "肺炎"),
        (lambda: text.tag_form(F.col("x")), "Multi-Step_A 1", "multistep_a"),
        (lambda: text.without_prefix(F.col("x")), "问： 怎么办", "怎么办"),
        (lambda: text.last_line(F.col("x")), "a\n b \n\n", "b"),
        (lambda: text.last_line(F.col("x")), None, ""),
        (lambda: text.garbled_ratio(F.col("x")), "a�b\x01", 0.5),
        (lambda: text.garbled_ratio(F.col("x")), "", 0.0),
        (lambda: text.special_ratio(F.col("x")), "中a1 ★", 0.2),
        (lambda: text.is_repetitive(F.col("x")), "abcabcabc", True),
        (lambda: text.is_repetitive(F.col("x")), "abcabc", False),
        (lambda: hashing.bigram_set(F.col("x")), "a", ["a"]),
        (lambda: hashing.bigram_set(F.col("x")), "", []),
        (lambda: hashing.bigram_set(F.col("x")), "abab", ["ab", "ba"]),
        (lambda: hashing.char_ngrams(F.col("x"), 2, 3), "ab c", ["ab", "bc", "abc"]),
        (lambda: hashing.simhash(F.col("x")), "", -1),
        (lambda: choices.sorted_letters(F.col("x")), "b, A和b", "AB"),
        (lambda: choices.extracted_v1(F.col("x")), "答案：A\n修正，答案：BD", "BD"),
        (lambda: choices.before_answer(F.col("x")), "分析：x\n答案：A\n答案：B", "分析：x\n答案：A"),
        (lambda: jsonx.boxed_answer(F.col("x")), r"so \boxed{\frac{1}{2}} and", r"\frac{1}{2}"),
        (lambda: jsonx.boxed_answer(F.col("x")), r"\boxed{1", None),
        (lambda: jsonx.tagged_answer(F.col("x")), "<answer> B \n</answer>", "B"),
    ],
)
def test_text_functions(spark, column, value, expected):
    got = one(spark, column(), value)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_extraction_fields(spark):
    got = lambda t: one(spark, choices.extracted_v2(F.col("x")), t).asDict()
    assert got("答案：AB") == {"pred": "AB", "valid_extract": True, "label_count": 1, "used_fallback": False, "extra_text": False}
    assert got("答案：A\n另外")["extra_text"]
    assert got("选C。") == {"pred": "C", "valid_extract": True, "label_count": 0, "used_fallback": True, "extra_text": False}
    assert got(None) == {"pred": "", "valid_extract": False, "label_count": 0, "used_fallback": False, "extra_text": False}


def test_three_answer_forms_differ(spark):
    row = spark.createDataFrame([("BAxB", ["A", "B", "C"])], "a string, k array<string>")
    got = row.select(choices.strict_answer(F.col("a"), F.col("k")), choices.lenient_answer(F.col("a"), F.col("k")), choices.sorted_letters(F.col("a"), F.col("k"))).first()
    assert tuple(got) == ("", "BA", "AB")


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(hashing.cosine(F.col("a"), F.col("b")), hashing.cosine(F.col("a"), F.col("z"))).first()
    assert got[0] == pytest.approx(0.96) and got[1] == 0.0
    same = spark.createDataFrame([("患者发热三天", "患者发热三天", "完全不同的话")], "a string, b string, c string")
    same = same.select(*[hashing.hashed_vector(F.col(c)).alias(c) for c in "abc"])
    got = rules.staged(same, {f"v{c}": F.col(c) for c in "abc"}).select(hashing.sparse_cosine(F.col("va"), F.col("vb")), hashing.sparse_cosine(F.col("va"), F.col("vc"))).first()
    assert got[0] == pytest.approx(1.0) and abs(got[1]) < 0.5


def test_unit_hash_orders_like_its_number(spark):
    rows = spark.range(200).select(hashing.unit_hash("s", F.col("id")).alias("h"), hashing.unit_float("s", F.col("id")).alias("u")).collect()
    assert [r["u"] for r in sorted(rows, key=lambda r: r["h"])] == sorted(r["u"] for r in rows)
    assert all(0 <= r["u"] <= 1 for r in rows)


def test_json_is_read_to_its_end(spark):
    parse = lambda t, f: one(spark, F.to_json(f(F.col("x"))), t)
    assert parse('```json\n{"a": 1}\n```', jsonx.model_json) == '{"a":1}'
    assert parse('text {"a": 1}', jsonx.model_json) == '{"a":1}'
    assert parse('{"a": [1,],}', jsonx.model_json) == '{"a":[1]}'
    assert parse('{"a": 1} and so on', jsonx.model_json) is None
    assert parse('see {"a": 1} and so on', jsonx.teacher_json) == '{"a":1}'
    assert parse("", jsonx.model_json) is None and parse(None, jsonx.model_json) is None


def test_rules(spark):
    row = spark.createDataFrame([(5, None)], "n int, m int")
    hit = [("a", F.col("m") > 0), ("b", F.col("n") > 3), ("c", F.col("n") > 4)]
    got = row.select(rules.first_hit(hit), rules.all_hits(hit), rules.weighted([(0.5, F.col("n") > 3), (9.0, F.col("m") > 0)])).first()
    assert got[0] == "b" and got[1] == ["b", "c"] and math.isclose(got[2], 0.5)
    assert rules.staged(row, {"x": F.col("n") + 1}).first()["x"] == 6
