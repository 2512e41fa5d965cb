import itertools
import json
import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveworks import session
from sieveworks.functions import jsonx
from sieveworks.operators import candidates, chunks, clean, dialog, evaluation, neardup, overlap, packing, profile, prompts, react, rewards, sampling, scoring, select, similarity, skew, templates
from sieveworks.plans import corpus

ITEM = "item_id long, question string, options map<string,string>, answer string, question_type string, exam_type string, junk string"
OPTIONS = {"A": "甲选项", "B": "乙选项", "C": "丙选项"}


def items(spark, *rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows, 1)], ITEM)


def test_clean_cascade_and_first_wins(spark):
    rows = items(
        spark,
        ("患者发热三天，应如何处理", OPTIONS, "A", None, None),
        ("患者发热三天 应如何处理。", dict(reversed(OPTIONS.items())), "a", None, None),
        (None, OPTIONS, "A", None, None),
        ("没有选项的题目", None, "A", None, None),
        ("选项太少的题目", {"A": "x"}, "A", None, None),
        ("没有答案的题目", OPTIONS, None, None, None),
        ("答案不对的题目", OPTIONS, "Z", None, None),
        ("正确选项是空的", {**OPTIONS, "A": " "}, "A", None, None),
        ("��有乱码的题目", OPTIONS, "A", None, None),
        ("长" * 801, OPTIONS, "A", None, None),
        ("★" * 21, OPTIONS, "A", None, None),
        ("短题", OPTIONS, "AB", None, None),
    )
    got = {r["item_id"]: r for r in clean.clean_and_deduplicate(rows).collect()}
    reasons = [None, clean.DUPLICATE, "missing_question", "option_not_dict", "options_too_few", "missing_answer", "invalid_answer", "empty_correct_option", "garbled_question", "question_too_long", "special_ratio_too_high", None]
    assert [got[i]["reject_reason"] for i in range(1, 13)] == reasons
    assert got[12]["clean_flags"] == ["short_question_retained"] and got[12]["ans"] == "AB" and got[1]["junk"] == "x"
    assert clean.clean_and_deduplicate(rows.limit(0)).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    rows = items(spark, *[(f"题目{i % 7}内容，患者{i % 3}岁", OPTIONS, "A", "单选题", "医师考试") for i in range(40)])
    runs = [sorted(map(tuple, clean.clean_and_deduplicate(rows.repartition(n)).select("item_id", "reject_reason").collect())) for n in (1, 7, 50)]
    assert runs[0] == runs[1] == runs[2]


def test_best_of_group(spark):
    rows = spark.createDataFrame([(1, "k", 1), (2, "k", 3), (3, "k", 3), (4, None, 1), (5, None, 2)], "id long, k string, q int")
    got = {r["id"]: r["kept_id"] for r in clean.best_of_group(rows, "k", "id", [F.col("q")]).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 5, 5: 5}


def test_reasoning_score(spark):
    rows = items(spark, ("患者男，45岁，发热3天，查体：体温39℃", OPTIONS, "AB", "多项选择题", None), ("什么是药物的定义", {}, "A", None, None), (None, None, None, None, None))
    got = {r["item_id"]: r for r in scoring.reasoning_features(rows).collect()}
    assert got[1]["case_info_score"] == 1.5 and got[1]["is_multi_choice"] and got[1]["option_length_cv"] == 0.0
    assert got[1]["reasoning_score"] == pytest.approx(2 + 1.5 + 0.8 + 0.8)
    assert got[2]["definition_level"] == "strong" and got[2]["low_reasoning_flags"] == ["short_question", "no_case_info"]
    assert got[3]["option_confusion_score"] == 0.0


def reward(spark, fn, column, **cases):
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], "case string, completion string, gold string, valid_options array<string>, difficulty string")
    return {r["case"]: r[column] for r in fn(rows).collect()}


def test_rewards_keep_their_order(spark):
    abcd = list("ABCD")
    case = lambda c, d="brief", g="BD": (c, g, abcd, d)
    got = reward(spark, rewards.boundary_reward, "boundary_reward", exact=case("答案：BD"), extra=case("答案：BCD"), missing=case("答案：B"), tail=case("答案：BD\n因此如此"), none=case("BD"), invalid=case("不知道"), null=case(None))
    assert got["exact"] > got["missing"] > got["extra"] and got["exact"] > got["tail"] and got["exact"] > got["none"] and got["invalid"] < 0 and got["null"] < 0
    got = reward(spark, rewards.adaptive_reward, "reward", short=case("答案：BD", "direct"), long=case("分析：" + "因为患者发热所以考虑感染" * 4 + "\n答案：BD", "direct"))
    assert got["short"] > got["long"]
    got = reward(spark, rewards.adaptive_reward, "reward", reasoned=case("分析：" + "患者持续发热并且咳嗽提示肺部感染需要鉴别诊断与治疗方案" * 3 + "\n答案：BD", "cot"), bare=case("答案：BD", "cot"), unknown=case("答案：BD", "odd"), invalid=case("", "cot"))
    assert got["reasoned"] > got["bare"] and got["invalid"] < 0
    got = reward(spark, rewards.plain_reward, "reward_v1", exact=case("答案：BD"), extra=case("答案：BCD"))
    assert got["exact"] == pytest.approx(1.7) and got["exact"] > got["extra"]


TARGET = "primary_diagnosis string, diagnostic_basis array<string>, differential_diagnoses array<string>, recommended_actions array<string>, risk_flags array<string>"


def test_case_measures(spark):
    truth = ("肺炎", ["咳嗽"], ["肺结核", "肺癌"], ["检查"], ["病情加重", "药物过敏"])
    full = '{"primary_diagnosis": "肺炎", "诊断依据": ["咳嗽"], "differential_diagnoses": ["肺结核：需鉴别"], "recommended_actions": ["查血"], "risk_flags": ["病情恶化"]}'
    rows = spark.createDataFrame([(1, full, truth), (2, "oops", truth), (3, '{"primary_diagnosis": "x"}', truth), (4, None, truth)], f"id long, raw_output string, ground_truth struct<{','.join(c.replace(' ', ':', 1) for c in TARGET.split(', '))}>")
    got = {r["id"]: r for r in evaluation.case_measures(rows).collect()}
    assert got[1]["m_diagnosis"] == 1.0 and got[1]["m_diff"].asDict() == {"correct": 1, "total": 2} and got[1]["m_risk"]["relevant"] == 1 and got[1]["m_compliant"]
    assert [got[i]["m_error"] for i in (2, 3, 4)] == ["parse_error", "missing_fields", "parse_error"]
    total = {r["level"]: r["total"] for r in evaluation.aggregated(evaluation.case_measures(rows.withColumn("d", F.lit(None).cast("string"))), ["d"]).collect()}
    assert total == {"overall": 4, "d": 4}


def brute_tfidf(texts, n_min=2, n_max=5):
    grams = {i: Counter(t[k : k + n] for n in range(n_min, n_max + 1) for k in range(len(t) - n + 1)) for i, t in texts.items()}
    df = Counter(g for c in grams.values() for g in c)
    n = len(texts)
    out = {}
    for i, c in grams.items():
        w = {g: f * (math.log((1 + n) / (1 + df[g])) + 1) for g, f in c.items() if df[g] >= 2 or n < 4}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {g: x / norm for g, x in w.items()} if norm else {}
    return out


def test_tfidf_pairs_against_brute_force(spark):
    base = ["患者男发热咳嗽三天伴胸痛", "患者男发热咳嗽三天伴胸闷", "患者女头痛呕吐一周", "完全不同的文本内容", "患者男发热咳嗽三天伴胸痛", "", "a"]
    texts = dict(enumerate(base * 2, 1))
    rows = spark.createDataFrame([("b", i, t) for i, t in texts.items()] + [("other", 99, base[0])], "block string, id long, t string")
    for threshold in (0.5, 0.95):
        pairs, copies = neardup.tfidf_pairs(rows, "block", "id", F.col("t"), threshold)
        of = {r["id"]: r["cid"] for r in copies.collect()}
        firsts = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}
        assert of == {i: firsts[t] for i, t in texts.items() if i != firsts[t]}
        got = {(r[0], r[1]): r[2] for r in pairs.collect()}
        v = brute_tfidf(texts)
        want = {}
        for a, b in itertools.combinations(sorted(firsts.values()), 2):
            s = sum(x * v[b].get(g, 0) for g, x in v[a].items())
            if s >= threshold + 1e-9:
                want[a, b] = s
        assert set(got) >= set(want) and all(got[p] == pytest.approx(s) for p, s in want.items())
        assert all(s >= threshold - 1e-9 for s in got.values())


def test_blocks_of_one_task_and_spread_blocks_give_the_same_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("患者男女发热咳嗽胸痛头呕吐周天三两", k=60)) for _ in range(30)]
    texts = base + [t[:-1] + "乙" for t in base[:20]] + base[:10] + ["", None, "a"]
    rows = spark.createDataFrame([(b if b != "z" else None, i * 3 + k, t) for k, b in enumerate("xyz") for i, t in enumerate(texts)], "block string, id long, t string")
    rows = rows.unionByName(spark.createDataFrame([("wide", 1000 + i, t * 9) for i, t in enumerate(base[:4] + base[:2])], rows.schema))
    results = []
    for most in ({}, {"most_rows": 1}, {"most_chars": 1}, {"most_rows": 7}, {"most_chars": 2000}):
        pairs, copies = neardup.tfidf_pairs(rows, "block", "id", F.col("t"), 0.8, **most)
        results.append(({(r[0], r[1]): round(r[2], 9) for r in pairs.collect()}, sorted(map(tuple, copies.collect()))))
    assert all(r == results[0] for r in results) and len(results[0][0]) >= 60 and len(results[0][1]) == 35


def test_near_duplicates_write_no_grams(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, "".join(rng.choices("患者男女发热咳嗽胸痛头呕吐周天三两", k=80))) for i in range(1500)], "id long, t string").withColumn("b", F.lit("b"))
    before = {path for _, path in session._written}
    neardup.tfidf_pairs(rows, "b", "id", F.col("t"))
    written = [f for _, path in session._written if path not in before for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    assert sum(f.stat().st_size for f in written) < 30_000  # vectors of these rows would be megabytes


def test_clusters_of_the_query_write_no_grams(spark, tmp_path):
    from sieveworks.plans import exam

    rng = random.Random(7)
    texts = ["".join(rng.choices("患者男女发热咳嗽胸痛头呕吐周天三两", k=80)) for _ in range(1500)]
    items = [(i, "t", "c", "s", t, OPTIONS, "A") for i, t in enumerate([*texts, texts[3][:-1] + "乙", texts[3], texts[9]], 1)]
    spark.createDataFrame(items, "item_id long, exam_type string, exam_class string, exam_subject string, question string, options map<string,string>, answer string").write.parquet(f"{tmp_path}/exam_item.parquet")
    before = {path for _, path in session._written}
    found = {r["id"]: (r["component"], r["members"]) for r in exam.near_duplicate_clusters(spark, str(tmp_path)).collect()}
    assert found == {4: (4, 3), 1501: (4, 3), 1502: (4, 3), 10: (10, 2), 1503: (10, 2)}
    written = [f for _, path in session._written if path not in before for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    assert sum(f.stat().st_size for f in written) < 400_000  # vectors of these rows would be megabytes


def test_pairs_among_equals(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "A"), (5, "B"), (6, None), (7, "A")], "id long, k string")
    pairs = spark.createDataFrame([(1, 4, 0.97)], "id_a long, id_b long, similarity double")
    copies = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (6, 4), (7, 4)], "id long, cid long")
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in neardup.among_equals(pairs, copies, rows, "id", F.col("k")).collect()}
    assert got == {(1, 4): 0.97, (3, 5): 0.97, (1, 2): 1.0, (4, 7): 1.0}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 150)]
    pairs = spark.createDataFrame(edges, "id_a long, id_b long")
    got = dict(map(tuple, neardup.connected_components(pairs).collect()))
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100} and got[200] == got[150] == 150 and len(got) == 72
    assert neardup.connected_components(pairs.limit(0)).count() == 0


def test_lookup_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "id long, key string")
    table = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("key"))
    got = skew.lookup(rows, table, "key", "n", 2)
    assert got.count() == 60 and got.where("key = 'hot'").count() == 40


def test_a_freed_cut_is_gone_and_others_stay(spark):
    one, other = session.cut(spark.range(10)), session.cut(spark.range(5))
    assert one.count() == 10
    session.free(one)
    session.free(spark.range(3))
    assert other.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(one._cut_path).count()


def test_salted_join_with_a_hot_key_on_both_sides(spark):
    left = [(i, None if i == 0 else 7 if i % 3 else i % 11) for i in range(300)]
    right = [(i, 7 if i % 4 == 0 else i) for i in range(40)] + [(99, None)]
    rows, table = spark.createDataFrame(left, "a long, k long"), spark.createDataFrame(right, "b long, k long")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = Counter((a, b) for a, k in left for b, j in right if k is not None and k == j)
    for least in (2, 10**6):
        got = skew.salted_join(rows, table, "k", counts, "a", salts=5, least=least, hot_keys=3)
        assert Counter((r["a"], r["b"]) for r in got.collect()) == want and set(got.columns) == {"a", "k", "b"}
    spread = skew.salted_join(rows, table, "k", counts, "a", salts=5, least=2, hot_keys=3).where("k = 7").select("a", F.pmod(F.xxhash64("a"), F.lit(5)).alias("s")).distinct()
    assert max(r["count"] for r in spread.groupBy("s").count().collect()) < 100
    with pytest.raises(ValueError, match="more than 5"):
        skew.bounded(rows, 5, "rows")


def test_spread_rank_is_a_rank(spark):
    rows = spark.createDataFrame([(i % 2, i % 5, i // 3) for i in range(300)], "g int, o int, t int")
    got = skew.spread_rank(rows, ["g"], ["o"], ["t"], "r", 4).collect()
    for g in (0, 1):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])
        assert [r["r"] for r in mine] == list(range(1, 151)) and [r["o"] for r in mine] == sorted(r["o"] for r in mine)
    assert skew.spread_rank(rows.limit(0), ["g"], [], ["t"]).count() == 0


def test_sampling_quotas_and_robin(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "id long, b string")
    got = Counter(r["b"] for r in sampling.quota_sample(rows, "b", "id", {"a": 5, "c": 50, "x": 3}, 12, "s").collect())
    assert got == {"a": 5, "c": 7}
    assert Counter(r["b"] for r in sampling.stratified(rows, "b", "id", 20, {"a": 0.3, "b": 0.5, "c": 0.2}, "s").collect()) == {"a": 6, "b": 10, "c": 4}
    turns = spark.createDataFrame([(i, r) for i, r in enumerate("SSSEEERRR")], "id long, r string")
    got = sampling.round_robin(turns, "r", ["S", "E", "R"], [F.col("id")], 7).orderBy("position").collect()
    assert "".join(r["r"] for r in got) == "SERSERS"
    assert [r["rank"] for r in sampling.ranked(rows, [F.desc("id")], "id", "b").orderBy("rank").collect()] == list(range(1, 61))
    assert sampling.hash_sample(rows, "id", 10, "s", F.col("b") == "a").where("b = 'a'").count() == 10
    assert sampling.ranked(rows.limit(0), [F.col("id")], "id", "b").count() == 0


def test_hamming_pairs_and_greedy(spark):
    sketches = [0, 1, 3, 7, 15, -1, -2, 1 << 62, (1 << 63) - 1, 0]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sketches)], "id long, s long")
    got = {tuple(r) for r in select.hamming_pairs(rows, "id", "s").collect()}
    m = (1 << 64) - 1
    firsts = {s: i for i, s in reversed(list(enumerate(sketches)))}
    want = {(a, b) for a, b in itertools.combinations(sorted(firsts.values()), 2) if bin((sketches[a] ^ sketches[b]) & m).count("1") <= 3} | {(0, 9)}
    assert got == want
    ranked = rows.withColumns({"rank": F.col("id"), "src": F.lit("x")})
    taken = [r["id"] for r in select.greedy_select(ranked, "id", "rank", "src", "s", 5, 1.0).orderBy("position").collect()]
    assert taken == [0, 4, 5]
    # the same in small batches, with a source that fills its cap early and a row that lacks its sketch
    rng = random.Random(2)
    held = [(i, rng.choice("aaab"), rng.getrandbits(63)) for i in range(60)] + [(60, None, None)]
    table = spark.createDataFrame(held, "id long, src string, s long").withColumn("rank", F.col("id") % 7)
    runs = [[tuple(r) for r in select.greedy_select(table, "id", "rank", "src", "s", 20, 0.5, batch=b).orderBy("position").collect()] for b in (5, 1000)]
    assert runs[0] == runs[1] and len(runs[0]) == 20


def test_keys_of_sketches_are_not_broadcast(spark):
    # 20 keys a sketch are far more than Spark expects, so a size under its threshold says nothing
    rows = spark.createDataFrame([(i, i * 7919) for i in range(300)], "id long, s long")
    plan = select.hamming_pairs(rows, "id", "s")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k" in plan and plan.count("BroadcastHashJoin [k") == 2  # the hot keys, once for each side


def test_all_hamming_pairs(spark, tmp_path):
    sketches = [0, 1, 3, 7, 15, -1, -2, 1 << 62, (1 << 63) - 1, 0, 0, 1, -1, 7, None, None, 1 << 40]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sketches)], "id long, s long").repartition(3)
    m = (1 << 64) - 1
    want = [(a, b) for a, b in itertools.combinations([i for i, s in enumerate(sketches) if s is not None], 2) if bin((sketches[a] ^ sketches[b]) & m).count("1") <= 3]
    assert sorted(tuple(r) for r in select.all_hamming_pairs(rows, "id", "s").collect()) == want
    # the hot sketch has its rows spread, whichever side of a pair it is
    many = spark.range(1100).select("id", F.when(F.col("id") < 1050, 8).when(F.col("id") < 1052, 9).when(F.col("id") < 1053, 0).otherwise(F.col("id") * 7_919_777_777_777).alias("s"))
    got = select.all_hamming_pairs(many, "id", "s").where("id_b < 1053")
    assert got.count() == got.distinct().count() == 1053 * 1052 // 2
    # the query pairs copies with each other and with what is near them
    texts = ["发热三天，伴咳嗽。", "发热三天，伴咳嗽。", "发热三天， 伴咳嗽。", "", None, "腹痛一周。"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in corpus.sketch_pairs(spark, str(tmp_path)).collect()) == [(0, 1), (0, 2), (1, 2), (3, 4)]


def test_overlap_operators(spark):
    log = spark.createDataFrame([(1, 1, "error"), (1, 2, "ok"), (2, 3, "ok"), (2, 4, "error"), (None, 5, "ok")], "id long, seq long, status string")
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    assert {(r["id"], r["status"]) for r in overlap.latest(log, "id", [F.col("seq")]).collect()} == {(1, "ok"), (2, "error"), (None, "ok")}
    assert {r["id"] for r in overlap.pending(rows, log, "id", "status", ("ok",)).collect()} == {3, None}
    assert {r["id"] for r in overlap.with_latest(rows, log, "id", [F.col("seq")], "status", "ok", {"seq": "n"}).collect()} == {1}
    blocked = overlap.blocked(rows, F.col("id"), [("first", rows.where("id = 1"), F.col("id")), ("second", rows.where("id < 3"), F.col("id"))])
    assert {r["id"]: r["blocked_by"] for r in blocked.collect()} == {1: "first", 2: "second", 3: None, None: None}


CONV = "array<struct<from:string,value:string>>"


def test_dialog(spark):
    conv = [("system", "s"), ("human", "a"), ("human", "b"), ("gpt", "c"), ("gpt", "d"), ("observation", "o"), ("assistant", "e"), ("odd", "z")]
    row = spark.createDataFrame([(conv,)], f"c {CONV}").withColumn("m", dialog.messages_of(F.col("c")))
    got = row.select(dialog.paired(F.col("m")).alias("p"), dialog.prefixes(F.col("m")).alias("x"), dialog.conversation_error(F.col("c")).alias("e"), dialog.answered_pairs(F.col("c")).alias("q")).first()
    assert got["p"] == [["a\nb", "c"], ["Observation: o", "e"]]
    assert [len(x) for x in got["x"]] == [4, 5, 7] and got["x"][0][0]["role"] == "system" and got["e"] == "unknown_role"
    assert [(x["question"], x["answer"]) for x in got["q"]] == [("b", "c"), ("b", "d")]
    strict = spark.createDataFrame([([("gpt", "x"), ("human", "a"), ("gpt", "b"), ("tool", "t"), ("human", "c")],), ([("human", "a")],)], f"c {CONV}")
    assert [r[0] for r in strict.select(dialog.strictly_paired(F.col("c"))).collect()] == [[["a", "b"]], None]
    direct = spark.createDataFrame([([("human", "q"), ("gpt", "long")], "b a")], f"c {CONV}, a string")
    assert direct.select(dialog.with_direct_answer(F.col("c"), F.col("a"), F.array(F.lit("A"), F.lit("B")))).first()[0][-1]["value"] == "答案：BA"
    items_of = spark.createDataFrame([("1. one\n\n2. two\n\n\n\n",)], "t string").select(dialog.numbered_items(F.col("t"))).first()[0]
    assert items_of == ["one", "two"]


def test_templates_and_tools(spark):
    row = spark.createDataFrame([([["q1", "a1"], ["q2", "a2"]],)], "p array<array<string>>")
    got = row.select(templates.dialog(F.col("p"), "vicuna", F.lit("S")).alias("d"), templates.rendered(F.col("p"), "base", None, "<s>", "</s>").alias("r")).first()
    assert got["d"] == ["S</s>USER: q1 ASSISTANT:", "a1", "</s>USER: q2 ASSISTANT:", "a2"] and got["r"]["full"] == "<s>q1a1</s>q2a2</s>"
    assert all(t.count("{query}") == 1 for _, t, _ in templates.TEMPLATES.values()) and len(templates.TEMPLATES) == 33
    calls = spark.createDataFrame([([("f", '{"x": 1}')],)], "c array<struct<name:string,arguments:string>>")
    for dialect in templates.DIALECTS:
        back = calls.withColumn("t", templates.call_text(F.col("c"), dialect)).select(templates.extracted_calls(F.col("t"), dialect).alias("c")).first()["c"]
        assert [tuple(c) for c in back] == [("f", '{"x": 1}')]
        none = spark.createDataFrame([("just text",), (None,)], "t string").select(templates.extracted_calls(F.col("t"), dialect).alias("c")).collect()
        assert all(r["c"] is None for r in none)
        schema = '[{"name": "f", "description": "d", "parameters": {"properties": {"x": {"type": "int", "description": "n", "enum": ["1"]}}, "required": ["x"]}}]'
        text = spark.createDataFrame([(schema,)], "t string").select(templates.tool_schema(F.col("t"), dialect)).first()[0]
        assert '"f"' in text or "Tool Name: f" in text


def test_packing(spark):
    rows = spark.createDataFrame([(i, "ab" * i) for i in range(1, 9)], "id long, t string").withColumn("ids", packing.tokenized(F.col("t")))
    got = packing.packed(rows, "id", "ids", 8, 0, 1).orderBy("block").collect()
    stream = [x for i in range(1, 9) for x in [97, 98] * i + [0]]
    assert [x for r in got for x in r["input_ids"]] == stream[: len(stream) // 8 * 8]
    kept = spark.createDataFrame([(list(range(10)),)], "i array<int>").select(packing.with_ends_kept(F.col("i"), 5)).first()[0]
    assert kept == [[0, 1, 2, 3, 9], [0, 4, 5, 6, 9]]
    turn = spark.createDataFrame([([([1] * 6, [2] * 6)],)], "t array<struct<source:array<int>,target:array<int>>>")
    ids, labels = turn.select(packing.supervised(F.col("t"), 10, 0)).first()[0]
    assert ids == [1] * 5 + [2] * 4 + [0] and labels == [-100] * 5 + [2] * 4 + [0]
    pad = turn.select(packing.padded(F.array(F.lit(1), F.lit(2)), 4, 9)).first()[0]
    assert pad["input_ids"] == [1, 2, 9, 9] and pad["attention_mask"] == [1, 1, 0, 0]


def test_chunks(spark):
    rows = spark.createDataFrame([(1, "一二三。四五六。七八九。"), (2, "One two. Three four. " * 3), (3, ""), (4, None), (5, "长" * 25)], "id long, t string")
    got = {}
    for r in chunks.chunk_rows(rows, "id", "t", 10, 0).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    # sentences of ideographs end a chunk only within the overlap before the size; other sentences are whole, however long
    assert got[1] == ["一二三。四五六。七八", "九。"] and set(got) == {1, 2, 5} and [len(c) for c in got[5]] == [10, 10, 5]
    assert got[2] == ["One two.", "Three four."] * 3
    overlapped = [r["chunk"] for r in chunks.chunk_rows(rows.where("id = 1"), "id", "t", 10, 3).orderBy("chunk_no").collect()]
    assert overlapped == ["一二三。四五六。 七八九", "七八九。"]
    html = spark.createDataFrame([("<h1>T</h1><script>x</script><p>a &lt; b</p>",)], "t string").select(chunks.html_lines(F.col("t"))).first()[0]
    assert html == ["T", "a < b"]


def test_top_k_and_bm25(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)] + [(90, [0.0, 0.0]), (91, None)], "id long, v array<double>")
    got = similarity.top_k_cosine(vectors.where("id = 9"), vectors, "id", "id", "v", 3, 0.0).orderBy("rank").collect()
    assert [r["r"] for r in got] == [9, 8, 7]
    docs = spark.createDataFrame([(1, "发热 咳嗽"), (2, "头痛"), (3, None)], "d long, t string")
    hits = similarity.bm25(docs.where("d = 1"), docs, "d", "t", "d", "t").collect()
    assert [(r["q"], r["d"]) for r in hits] == [(1, 1)]


def test_bm25_takes_a_thousand_queries_in_one_reading(spark, monkeypatch):
    rng = random.Random(8)
    texts = {i: "".join(rng.choices("发热咳嗽头痛胸", k=rng.randint(0, 30))) for i in range(1100)} | {1: None, 2: "发热 fever"}
    rows = spark.createDataFrame(list(texts.items()), "d long, t string")
    docs = rows.where("d < 60").unionByName(spark.createDataFrame([(100, texts[5]), (101, texts[7])], rows.schema))
    parts = []
    whole = similarity.cut_of_parts
    monkeypatch.setattr(similarity, "cut_of_parts", lambda s, p, kind: whole(s, (x for x in p if not parts.append(1)), kind))
    got = Counter(map(tuple, similarity.bm25(rows, docs, "d", "t", "d", "t", 4).collect()))
    assert len(parts) == 1
    assert Counter(map(tuple, similarity.bm25(rows, docs, "d", "t", "d", "t", 4, chunk=150).collect())) == got

    pairs = lambda t: Counter(w for w in [(t or "")[i : i + 2] for i in range(len(t or "") - 1)] if " " not in w and not w.isascii()) + Counter((t or "").split()[1:])
    held = {r["d"]: pairs(r["t"]) for r in docs.collect()}
    mean, df = sum(sum(c.values()) for c in held.values()) / len(held), Counter(w for c in held.values() for w in c)
    idf = {w: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for q in (2, 5, 7, 600, 1099):
        score = {d: round(sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in pairs(texts[q]) if w in c), 6) for d, c in held.items()}
        want = sorted((-s, d) for d, s in score.items() if s > 0)[:4]
        mine = sorted((r[3], r[1], r[2]) for r in got if r[0] == q)
        assert [d for _, d, _ in mine] == [d for _, d in want] and [s for *_, s in mine] == pytest.approx([-s for s, _ in want], abs=2e-6)
    assert not any(r[0] == 1 for r in got)


def test_react_texts(spark):
    kind = "m array<struct<role:string,content:string,call_name:string,call_arguments:string>>"
    talk = [("system", "s", None, None), ("user", "\n问 ", None, None), ("assistant", "look", "find", '{"x": 1}'), ("function", "seen", None, None), ("assistant", "done", None, None), ("user", "more", None, None), ("assistant", None, "find", None), ("function", "again", None, None)]
    rows = spark.createDataFrame([(talk,), ([],)], kind)
    got = [[tuple(t) for t in r[0]] for r in rows.select(react.folded(F.col("m"), True)).collect()]
    assert got[0] == [
        ("user", "问"), ("assistant", 'Thought: look\nAction: find\nAction Input: {"x": 1}\nObservation: seen\nThought: I now know the final answer.\nFinal Answer: done'), ("user", "more"),
        ("assistant", "Thought: \nAction: find\nAction Input: \nObservation: again\nThought:"),
    ] and got[1] == []
    replies = ['Thought: I look\nAction: find\nAction Input: {"x": 1}\nObservation: seen', "Thought: x\nAction: f\nAction Input: 1 ", "Thought: I know.\nFinal Answer: 42", "plain", None, "\nAction Input: 1\nAction: f"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in replies], "t string").select(react.parsed(F.col("t"))).collect()]
    assert got == [("I look", "find", '{"x": 1}'), ("x", "f", "1"), ("42", None, None), ("plain", None, None), ("", None, None), ("\nAction Input: 1\nAction: f", None, None)]
    tools = spark.createDataFrame([([("find", "finds", "{}")],), ([],)], "t array<struct<name:string,description:string,parameters:string>>")
    text, none = [r[0] for r in tools.select(react.instruction(F.col("t"))).collect()]
    assert "find: Call this tool to interact with the find API. What is the find API useful for? finds Parameters: {}" in text and "one of [find]" in text and none == ""
    assert spark.range(1).select(react.without_stops(F.lit("a\nObs b"), ("\nObs", "z"))).first()[0] == "a"


def test_candidates(spark):
    reply = '{"decision": "keep", "cot_worthiness_score": 12, "reasoning_need_score": 3, "case_richness_score": 1, "option_confusion_score": 1, "rote_recall_penalty": 0, "definition_penalty": 0, "reason": "long enough reason", "tags": ["A b", "ab"]}'
    rows = spark.createDataFrame([(1, reply), (2, reply.replace("12", "9")), (3, "no")], "id long, r string")
    got = {r["id"]: r for r in candidates.screening(rows, "r").collect()}
    assert got[1]["status"] == "invalid" and got[1]["errors"] == ["cot_worthiness_score out of range"] and got[1]["cot_worthiness_score"] == 10 and got[1]["tags"] == ["ab"]
    assert got[2]["status"] == "ok" and got[2]["derived_score"] == 5 and got[3]["decision"] == "drop"


def test_flags_and_blocks_use_the_fixed_words(spark):
    texts = ["请看报告单和片子，患者发热", "病人说不想活了，已住院治疗多日", "感冒怎么办", "这句话与病情无关且足够长足够长", "最可能的是什么", "用药方案怎样"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r["id"]: r for r in rows.select("id", scoring.quality_flags(F.col("t")).alias("f"), candidates.block_of(F.col("t"), F.lit(None)).alias("b")).collect()}
    assert got[0]["f"] == ["may_depend_on_image_or_attachment"] and got[1]["f"] == ["safety_boundary_signal"]
    assert got[2]["f"] == ["too_short", "generic_medical_qa", "weak_case_context"] and got[3]["f"] == ["weak_case_context"]
    assert got[4]["b"] == "diagnosis" and got[5]["b"] == "other"
    both = spark.range(1).select(jsonx.field(F.parse_json(F.lit('{"primary_diagnosis": "flu", "主诊断": "流感"}')), "primary_diagnosis", "string").alias("d"))
    assert both.first()["d"] == "流感"


def test_replies_of_teachers(spark):
    good = '{"decision": "accept", "case_text": "患者发热", "schema_target": {"primary_diagnosis": " 肺炎 ", "diagnostic_basis": ["发热", "咳嗽"], "differential_diagnoses": ["肺结核"], "recommended_actions": ["胸片"], "risk_flags": ["加重"]}}'
    replies = {
        "good": good, "prose": "no", "list": "[1]", "reject": '{"decision": "reject", "reject_reason": "unclear"}', "bare reject": '{"decision": "reject", "reject_reason": " "}', "maybe": '{"decision": "maybe"}',
        "no target": '{"decision": "accept", "schema_target": []}', "thin": good.replace('["发热", "咳嗽"]', '["发热"]').replace('["胸片"]', "[1]").replace('"患者发热"', '" "'), "extra": good.replace('"risk_flags"', '"note": "x", "risk_flags"'),
    }
    rows = spark.createDataFrame(list(replies.items()), "k string, r string").withColumn("v", F.try_parse_json("r"))
    got = {r["k"]: (r["s"], r["e"]) for r in rows.withColumn("e", candidates.reply_errors(F.col("v"))).withColumn("s", candidates.reply_status(F.col("v"), F.col("e"))).collect()}
    assert got["good"] == ("accepted", []) and got["prose"] == ("invalid", ["not_json_object"]) == got["list"]
    assert got["reject"] == ("rejected_by_teacher", []) and got["bare reject"] == ("invalid", ["reject_missing_reason"]) and got["maybe"] == ("invalid", ["decision_not_accept_or_reject"])
    assert got["no target"] == ("invalid", ["schema_target_not_object"]) and got["extra"] == ("accepted", [])
    assert got["thin"] == ("invalid", ["case_text_empty", "diagnostic_basis_too_short", "recommended_actions_empty"])
    made = {r["k"]: r for r in candidates.rewritten(rows, "v", "请回答", ["k"]).collect()}
    assert made["good"]["sft_reject_reason"] is None and made["good"]["conversations"][0]["value"] == "患者发热\n\n请回答"
    assert json.loads(made["good"]["conversations"][1]["value"])["primary_diagnosis"] == "肺炎" and list(json.loads(made["good"]["conversations"][1]["value"]))[0] == "primary_diagnosis"
    reasons = {k: r["sft_reject_reason"] for k, r in made.items()}
    assert reasons["prose"] == "teacher_response_not_object" and reasons["reject"] == "teacher_decision:reject" and reasons["extra"] == "unknown_schema_field:note" and reasons["no target"] == "case_text_empty"
    analyses = {"ok": '{"answer": "a", "analysis": "因为患者发热三天并伴有咳嗽咳痰而考虑肺炎"}', "other": '{"answer": "B", "analysis": "标准答案如此"}', "none": "{}"}
    errors = spark.createDataFrame(list(analyses.items()), "k string, r string").select("k", candidates.rationale_errors(F.try_parse_json("r"), F.lit("A")).alias("e"))
    got = {r["k"]: r["e"] for r in errors.collect()}
    assert got["ok"] == [] and got["other"] == ["teacher answer changed: B != A", "analysis contains answer label", "analysis too short"]
    assert got["none"] == ["teacher answer changed:  != A", "missing analysis", "analysis too short"]


def test_prompts_sources_and_views(spark):
    rows = items(spark, ("问题一问题一问题一", {"a": " x ", "B": "y", "AB": "z"}, "b，A", "单选", None), (" ", OPTIONS, "A", None, None), ("q", {"1": "x"}, "A", None, None), ("q", OPTIONS, "Z", None, None), (None, None, None, None, None))
    got = {r["sample_id"]: r for r in prompts.prompt_rows(rows, "<{question}>\n{options_text}!", F.col("item_id").cast("string"), "src").collect()}
    assert got["1"]["prompt"] == "<问题一问题一问题一>\nA. x\nB. y!" and got["1"]["answer"] == "AB" and got["1"]["question_type"] == "multi" and got["1"]["source_question_type"] == "单选"
    assert [got[str(i)]["reject_reason"] for i in range(1, 6)] == [None, "empty_question", "invalid_options", "invalid_answer", "empty_question"]
    raw = rows.select("item_id", clean.raw_signature(F.col("question"), F.col("options")).alias("s")).collect()
    assert raw[2]["s"] == json.dumps({"q": "q", "o": {"1": "x"}}, ensure_ascii=False, sort_keys=True) and raw[4]["s"] == '{"o": {}, "q": ""}'
    texts = spark.createDataFrame([(1, 0, "甲" * 20), (1, 1, "甲" * 20), (0, 5, "甲" * 20), (0, 6, "短"), (2, 7, "短"), (2, 8, None)], "rank int, ord int, t string")
    flags = texts.withColumn("f", F.when(F.length("t") < 12, F.array(F.lit("too_short"))).otherwise(F.array().cast("array<string>")))
    kept = {(r["rank"], r["ord"]): r["skipped"] for r in candidates.first_of_sources(flags, "t", "rank", "ord", "f").collect()}
    assert kept[0, 5] is None and kept[1, 0] == kept[1, 1] == "duplicate_case_text" and kept[0, 6] == "invalid_quality" and kept[2, 7] == "duplicate_case_text"
    passed, seen = profile.observed(texts)
    assert passed.count() == 6 and seen.get == {"rows": 6, "whole_rows": 5}
    ids = spark.createDataFrame([("s", "o", "3", 7), (None, "o", "3", 7), (None, None, "3", 7), (None, None, "x", 7)], "a string, b string, c string, d int")
    assert [r[0] for r in ids.select(clean.sample_id_of(*map(F.col, "abcd"))).collect()] == ["s", "o", "2", "7"]


def test_profile(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, None)], "v double")
    got = profile.quantiles(rows, F.col("v")).first()
    assert (got["n"], got["p50"], got["p75"]) == (4, 2.5, 3.25) and profile.upper_median(rows, F.col("v")).first()["v"] == 3.0
    acc = spark.createDataFrame([([1, 2, 3], [0, 1, -100])], "p array<int>, l array<int>").select(profile.shifted_accuracy(F.col("p"), F.col("l"))).first()[0]
    assert (acc["right"], acc["counted"]) == (1, 1)


def test_target_similarity_against_brute_force(spark):
    from sieveworks.functions import hashing

    docs = spark.createDataFrame([(1, "患者发热三天伴咳嗽"), (2, "头痛一周"), (3, ""), (4, None)], "d long, t string").withColumn("v", hashing.hashed_vector(F.col("t")))
    targets = spark.createDataFrame([("a", "发热三天"), ("b", "头痛一周"), ("c", "头痛一周")], "d string, t string").withColumn("v", hashing.hashed_vector(F.col("t")))
    got = {r["r"]: r for r in similarity.target_similarity(docs, targets, "d", "d", "v", 2).collect()}
    left, right = {r["d"]: r["v"] for r in docs.collect()}, {r["d"]: r["v"] for r in targets.collect()}
    dot = lambda x, y: sum(w * y.get(k, 0.0) for k, w in (x or {}).items())
    for d in (1, 2, 3, 4):
        want = sorted(((round(dot(left[d], right[t]), 9), t) for t in right), reverse=True)[:2]
        assert got[d]["matched"] == [t for _, t in want] and got[d]["best"] == pytest.approx(want[0][0], abs=1e-8)
    assert {r["r"]: r for r in similarity.target_similarity(docs.drop("v"), targets, "d", "d", "v", 2, text="t").collect()} == got


def test_all_targets_count_however_many(spark):
    from sieveworks.functions import hashing

    docs = spark.createDataFrame([(1, "患者发热三天伴咳嗽"), (2, "头痛一周"), (3, "")], "d long, t string").withColumn("v", hashing.hashed_vector(F.col("t")))
    texts = {i: f"病例{i}腹痛" for i in range(2100)} | {1: "头痛一周余", 2098: "发热三天", 2099: "头痛一周"}
    targets = spark.createDataFrame(list(texts.items()), "d long, t string").withColumn("v", hashing.hashed_vector(F.col("t")))
    left, right = {r["d"]: r["v"] for r in docs.collect()}, {r["d"]: r["v"] for r in targets.collect()}
    got = {r["r"]: r for r in similarity.target_similarity(docs, targets, "d", "d", "v").collect()}
    for d, v in left.items():
        want = sorted(((round(sum(w * x.get(k, 0.0) for k, w in v.items()), 9), t) for t, x in right.items()), reverse=True)[:3]
        assert got[d]["matched"] == [t for _, t in want] and got[d]["best"] == pytest.approx(want[0][0], abs=1e-8)
        assert got[d]["mean_top"] == pytest.approx(sum(s for s, _ in want) / 3, abs=1e-8)
    assert got[2]["matched"][:2] == [2099, 1] and got[2]["best"] == pytest.approx(1.0)
    none = similarity.target_similarity(docs, targets.limit(0), "d", "d", "v").first()
    assert (none["matched"], none["best"], none["mean_top"]) == ([], 0.0, 0.0)


def test_target_query_scores_against_every_case(spark, tmp_path):
    from sieveworks.plans import corpus

    spark.createDataFrame([(1, "右侧腰腹部绞痛三小时", None, None)], "doc_id long, text string, source string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    cases = [(f"c{i:04d}", "右侧腰腹部绞痛三小时" if i == 299 else f"头痛{i}周", "replay") for i in range(300)]
    spark.createDataFrame(cases, "case_id string, case_text string, source string").write.parquet(f"{tmp_path}/eval_result.parquet")
    assert corpus.target_ranked(spark, str(tmp_path)).first()["best"] == 1.0


def test_target_query_makes_a_vector_once(spark, tmp_path, monkeypatch):
    from sieveworks.plans import corpus

    spark.createDataFrame([(1, "右侧腰腹部绞痛三小时", None, None), (2, "", None, None), (3, None, None, None)], "doc_id long, text string, source string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    cases = [(f"c{i:04d}", "右侧腰腹部绞痛三小时" if i in (1, 4099) else f"头痛{i}周", "replay") for i in range(4100)]
    spark.createDataFrame(cases, "case_id string, case_text string, source string").write.parquet(f"{tmp_path}/eval_result.parquet")
    parts = []
    whole = similarity.cut_of_parts
    monkeypatch.setattr(similarity, "cut_of_parts", lambda s, p, kind: whole(s, (x for x in p if not parts.append(1)), kind))
    assert {r["doc_id"]: r["best"] for r in corpus.target_ranked(spark, str(tmp_path)).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert len(parts) == 1  # each part makes every document's vector again


def test_pool_decisions_and_holdout(spark):
    from sieveworks.operators import pool

    ok = ("肺炎", ["咳嗽咳痰三天", "肺部湿啰音"], ["肺结核"], ["胸片检查"], ["加重"])
    case = "患者男45岁，发热咳嗽三天，伴咳黄痰，体温39度"
    rows = spark.createDataFrame(
        [(1, case, ok), (2, case, ok), (3, "短", ok), (4, case + "一", ("肺炎", ["少"], ["x"], ["y"], [])), (5, case + "二", ("肺炎可能", ok[1], ["肺炎"], ok[3], ok[4])), (6, case + "三", ok), (7, None, None)],
        f"id long, c string, t struct<{','.join(x.replace(' ', ':', 1) for x in TARGET.split(', '))}>",
    )
    none = F.lit(None).cast("string")
    leak = rows.where("id = 6")
    got = {r["id"]: (r["status"], ",".join(r["hit_rules"]), r["duplicate_of"]) for r in pool.organised(rows, "id", F.col("c"), [F.length("c")], [("R-LEAK-002", leak, F.col("c"))], pool.review_rule(F.col("c"), F.col("t"), none, none)).collect()}
    assert got == {
        1: ("accepted", "", None), 2: ("rejected_duplicate", "R-DUP-001", 1), 3: ("rejected_low_quality", "R-QUAL-002", None), 4: ("rejected_low_quality", "R-QUAL-005", None),
        5: ("needs_manual_review", "R-QUAL-006,R-REVIEW-005", None), 6: ("rejected_leakage", "R-LEAK-002", None), 7: ("rejected_low_quality", "R-QUAL-002", None),
    }
    people = spark.createDataFrame([(i, "ab"[i % 2] if i < 200 else None, ["easy", "hard", "medium"][i % 3]) for i in range(230)], "id long, g string, l string")
    drawn = Counter((r["g"], r["l"]) for r in pool.holdout(people, "id", "g", "l", "s").collect())
    assert sum(drawn.values()) == 120 and drawn["b", "easy"] == 10 and drawn["b", "hard"] == 15
    words = [(spark.createDataFrame([("x", 1), ("y", 1)], "w string, f int"), None), (spark.createDataFrame([("甲", 5), ("乙", 9), ("y", 99)], "w string, f int"), 1)]
    assert {tuple(r) for r in pool.merged_vocabulary(words, "w", "f").collect()} == {("x", 0), ("y", 0), ("乙", 1)}
