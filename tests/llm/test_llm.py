import datetime
import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import p1_proportions as p1
from sieveworks.llm import p2_truncation as p2
from sieveworks.llm import p3_cross_split as p3
from sieveworks.llm import p3_verify as verify
from sieveworks.llm import p4_formatting as p4
from sieveworks.llm import p5_lookalikes as p5
from sieveworks.llm import p6_containers as p6
from sieveworks.llm import p7_mixing as p7
from sieveworks.llm import p8_personal as p8
from sieveworks.llm.canon import canonical_record, canonical_text

ITEM = "item_id long, split string, source string, question string, options map<string,string>, raw string, canon string"
OPTIONS = {"A": "经验性营养支持", "B": "定期皮肤护理", "C": "分次激素冲击"}
Q = "患者男，35岁，理发师。剧烈运动后出现乏力、多饮11小时，伴冷汗。查体：T37.9℃，扁桃体肿大，移动性浊音(-)。予以孚匹丙瑞卡缓释片7.4mg，隔日1次后出现失眠。下一步最恰当的处理是？"


def items(spark, *rows):
    """(split, question, options); with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, s, "src", q, o, "x", "y") for i, (s, q, o) in enumerate(rows, 1)], ITEM)


# -- canonical form, p4 -------------------------------------------------------------------------------------------------


def canon(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_text(F.col("t"))).collect()]


def test_canonical_text_keeps_what_carries_a_value(spark):
    got = canon(spark, " Ａb，C。", "pH 7.40", "pH 740", "(+)", "(-)", "1：2", "a:b", "5％", "5%", "1/2", "10⁹", None, "", "39 .\n5", "~3°", "87MG，每日")
    assert got == ["ａbc", "ph7.40", "ph740", "+", "-", "1:2", "ab", "5%", "5%", "1/2", "10⁹", "", "", "39.5", "~3°", "87mg每日"]


def test_record_ignores_the_order_of_options(spark):
    rows = items(spark, ("train", "q", {"A": "x", "B": "y"}), ("train", "Q。", {"b.": "y", "A、": " x"}), ("train", "q", {"A": "y", "B": "x"}), ("train", "q", None), ("train", "q", {}))
    a, b, c, d, e = [r[0] for r in rows.orderBy("item_id").select(canonical_record(F.col("question"), F.col("options"))).collect()]
    assert a == b != c and d == e == "q\u0001"


def brute_copies(rows):
    groups = defaultdict(list)
    for r, key in rows:
        groups[key].append(r)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_copies_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("train", f"题目{i}？", OPTIONS) for i in range(20)]
    rows += [("val", rng.choice([" ", "", "\n"]).join("同一道题目"), dict(rng.sample(list(OPTIONS.items()), 3))) for _ in range(30)]
    rows += [(None, None, None), (None, " ", None), ("test", "", {})] + rows[:3]
    table = items(spark, *rows)
    keys = [(r["item_id"], r["k"]) for r in table.select("item_id", canonical_record(F.col("question"), F.col("options")).alias("k")).collect()]
    assert {tuple(r) for r in p4.copies_of(table).collect()} == brute_copies(keys)
    total = p4.collapsed_records(table).agg(F.sum("copies"), F.max("copies"), F.count(F.lit(1))).first()
    assert tuple(total) == (len(rows), 30, len({k for _, k in keys}))
    assert p4.copies_of(table.limit(0)).count() == 0 and p4.collapsed_records(table.limit(0)).count() == 0


# -- p1 -----------------------------------------------------------------------------------------------------------------


def p1_tables(spark, n=3000):
    rng = random.Random(3)
    types = ["单选", " SINGLE ", "multi", "odd", None]
    levels = ["direct", " COT", None, "x", "brief"]
    rows = [(i, rng.choices(types, [6, 2, 1, 1, 1])[0], rng.choice(levels), datetime.datetime(2024, 1, 1)) for i in range(n)]
    rows += [(i, t, d, datetime.datetime(2024, 2, 1)) for i, t, d, _ in rows[:50]] + [(None, "single", "cot", None)]
    rewards = spark.createDataFrame(rows, "reward_id long, question_type string, difficulty string, logged_at timestamp")
    alias = spark.createDataFrame([("单选", "S"), ("single", "S"), ("Multi", "M")], "label_variant string, question_type string")
    plan = spark.createDataFrame(
        [(1, 1, "S", None, 70, 2, 40), (1, 2, "M", None, 30, 2, 40), (2, 3, "M", "cot", 90, 1, 90), (2, 4, None, "direct", 10, 5, 90), (3, 5, "none", None, 1, 1, 1), (3, 6, "S", "brief", 0, 0, 10)],
        "plan_id int, line_id int, question_type string, difficulty string, target_pct int, min_rows int, sample_pct int",
    )
    return rewards, alias, plan, rows


def test_sample_is_exact_and_reports_deficits(spark):
    rewards, alias, plan, rows = p1_tables(spark)
    kind = {"单选": "S", "single": "S", "multi": "M"}
    cats = {}
    for i, t, d, _ in rows:
        if i is not None and (t or "").strip().lower() in kind:
            level = (d or "").strip().lower()
            cats.setdefault(i, (kind[t.strip().lower()], level if level in ("direct", "brief", "cot") else "brief"))
    want = {}
    for p in plan.collect():
        size = len(cats) * p["sample_pct"] // 100
        have = sum((p["question_type"] in (None, t)) and (p["difficulty"] in (None, d)) for t, d in cats.values())
        want[p["line_id"]] = (max(p["min_rows"], size * p["target_pct"] // 100), have)
    got = {r["line_id"]: r["deficit"] for r in p1.deficits(rewards, alias, plan).collect()}
    assert got == {k: w - h for k, (w, h) in want.items() if h < w} and got
    drawn = Counter(r["line_id"] for r in p1.sample(rewards, alias, plan, 16).distinct().collect())
    assert drawn == Counter({k: min(w, h) for k, (w, h) in want.items() if min(w, h)})
    empty = rewards.limit(0)
    assert p1.sample(empty, alias, plan).count() == 0 and p1.shares(empty, alias, plan).count() == 6


def test_correction_completes_a_thin_draw(spark, monkeypatch):
    monkeypatch.setattr(p1, "OVERSAMPLING", -0.5)
    monkeypatch.setattr(p1, "MARGIN_SD", 0.0)
    rewards, alias, plan, _ = p1_tables(spark, 400)
    for r in p1.shares(rewards, alias, plan).collect():
        assert r["drawn"] == min(r["wanted"], r["available"])


# -- p2 -----------------------------------------------------------------------------------------------------------------


def test_censored_fit_recovers_its_parameters():
    rng = random.Random(5)
    lengths = [min(int(math.exp(rng.gauss(4.5, 0.5))), 150) for _ in range(20_000)]
    values, counts = zip(*sorted(Counter(lengths).items()))
    import numpy as np

    mu, sd = p2.fit_censored(np.array(values), np.array(counts, dtype=float), 150)
    assert mu == pytest.approx(4.5, abs=0.03) and sd == pytest.approx(0.5, abs=0.03)
    limits = p2.candidate_limits(np.array(values), np.array(counts, dtype=float), "chars")
    assert [(a, b) for a, b, _ in limits] == [(150, 150)] and limits[0][2] > 0.9
    free = Counter(int(math.exp(rng.gauss(4.5, 0.5))) for _ in range(20_000))
    assert p2.candidate_limits(np.array(list(free)), np.array(list(free.values()), dtype=float), "chars") == []


def test_cut_texts(spark):
    rng = random.Random(7)
    rows, cut = [], set()
    for i in range(600):
        body = "分析：" + "".join(rng.choice(["患者发热三天。", "查体见肺部湿啰音。", "考虑感染可能。"]) for _ in range(rng.randint(1, 25)))
        text = body + "\n答案：A"
        if len(text) > 90:
            text = text[:90]
            if not text.endswith("。"):
                cut.add(i)
        rows.append(("k", i, "limited", text, len(text), i))
    whole = ["", None, "B", "选C。", "破损�的文字。", '{"a": [1, 2],}', "{'a': 'b'}\n以上供参考。", "建议检查：\n- 血培养\n- 肌电图", "诊断：肺炎。（完）", "分析：患者好转。...\n\n答案：B"]
    lost = ['{"a": ["b", "c', "```json\n{\"a\": 1,", "<think>患者", "分析：患者发热...\n\n答案：B", "1. 患者发热\n2. 查体", "诊断：肺炎。依据：咳"]
    rows += [("k", 1000 + i, "free", t, None, i) for i, t in enumerate(whole)] + [("k", 2000 + i, None, t, None, i) for i, t in enumerate(lost)] + [("k", 2000, None, lost[0], None, 99)]
    table = spark.createDataFrame(rows, "kind string, id long, source string, text string, recorded long, at long")
    got = {r["id"] for r in p2.judged(table).where("cut").collect()}
    assert not got & set(range(1000, 2000)) and got >= {2000 + i for i in range(len(lost))}
    assert cut <= got and len({g for g in got if g < 600} - cut) <= sum(len(t or "") == 90 for *_, t, _, _ in rows)
    rates = {r["source"]: r for r in p2.cut_rates(table).collect()}
    assert rates["limited"]["n_texts"] == 600 and rates["limited"]["n_at_limit"] > 100
    assert p2.judged(table.limit(0)).count() == 0


P2 = "kind string, id long, source string, text string, recorded long, at long"


def sentences(rng, n, end="。"):
    return end.join(rng.choice(["患者发热三天", "查体见湿啰音", "考虑感染", "建议复查", "予以补液"]) for _ in range(n)) + end


def test_a_limit_decides_where_endings_cannot(spark):
    """Texts cut at a sentence's end at the limit, and texts whose source puts no mark at the end."""
    rng = random.Random(17)
    rows, at_end, bare_cut = [], set(), set()
    for i in range(1500):
        text = sentences(rng, rng.randint(2, 40))
        if len(text) > 100:
            text = text[:100]
            if text.endswith("。"):
                at_end.add(i)
        rows.append(("k", i, "limited", text, None, 1))
    for i in range(2000, 3000):
        text = sentences(rng, rng.randint(2, 40))[:-1]
        if len(text) > 120:
            text, _ = text[:120], bare_cut.add(i)
        rows.append(("k", i, "bare", text, None, 1))
    got = {r["id"]: r for r in p2.judged(spark.createDataFrame(rows, P2)).collect()}
    assert len(at_end) > 20 and all(got[i]["cut"] for i in at_end | bare_cut)
    other = [i for i, r in got.items() if r["cut"] and r["at_limit"] == 0]
    assert not other and sum(r["cut"] for r in got.values()) <= sum(len(t) in (100, 120) for *_, t, _, _ in rows)


def test_every_limit_of_a_source_is_a_candidate():
    import numpy as np

    rng = random.Random(19)
    free = Counter(int(math.exp(rng.gauss(4.6, 0.5))) for _ in range(20_000))
    limits = [90, 130, 170, 210, 260, 330]
    for i in limits:
        free[i] += 1500
    free[10**8] += 1  # one value of 100 million characters
    values, counts = (np.array(x) for x in zip(*sorted(free.items())))
    found = p2.candidate_limits(values, counts.astype(float), "chars")
    assert sorted(a for a, _, _ in found) == limits and all(p > 0.5 for *_, p in found)


# -- p3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("other", "options", "same"),
    [
        (Q.replace("，", ", ").replace("。", ". "), OPTIONS, True),
        ("【例题】" + Q, OPTIONS, True),
        (Q.replace("患者男", "病人男").replace("出现", "发生"), OPTIONS, True),
        (Q.replace("剧烈", "剧列烈").replace("冷汗", "汗冷"), OPTIONS, True),
        (Q, {"A": "定期皮肤护理", "B": "分次激素冲击", "C": "考虑经验性营养支持"}, True),
        (Q.replace("7.4", "74"), OPTIONS, False),
        (Q.replace("(-)", "(+)"), OPTIONS, False),
        (Q.replace("孚匹丙瑞卡", "达坦昔莫司"), OPTIONS, False),
        (Q.replace("最恰当", "最不恰当"), OPTIONS, False),
        (Q, {**OPTIONS, "C": "联合抗凝治疗"}, False),
        (Q, None, False),
    ],
)
def test_cross_split_pairs(spark, other, options, same):
    rows = items(spark, ("train", Q, OPTIONS), ("test", other, options), (None, Q, OPTIONS), ("val", "别的题目与此无关", OPTIONS), ("train", None, None))
    got = {tuple(r) for r in p3.overlap_pairs(rows).collect()}
    assert got == ({(1, 2)} if same else set())


def test_bands_find_what_jaccard_confirms(spark):
    rng = random.Random(11)
    words = "患者发热咳嗽胸痛头晕乏力恶心呕吐腹泻皮疹水肿黄疸眩晕抽搐失眠便秘口干多饮尿频"
    base = ["".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    rows = [("train", b, None) for b in base]
    for b in base:
        k = rng.randrange(5, 50)
        rows.append(("val", b[:k] + b[k + 1 :], None))
    table = items(spark, *rows)
    got = {tuple(r) for r in p3.overlap_pairs(table).collect()}
    texts = [q for _, q, _ in rows]
    want = {(a + 1, b + 1) for a in range(60) for b in range(60, 120) if p3.jaccard(texts[a], texts[b]) >= p3.MIN_JACCARD and verify.same_question(texts[a], [], texts[b], [])}
    assert got == want and len(got) >= 55
    report = p3.overlap_report(table).collect()
    assert sum(r["pairs"] for r in report) == len(got) and sum(r["overlapping_rows"] for r in report) == len({b for _, b in got})
    assert p3.overlap_pairs(table.limit(0)).count() == 0


def test_hot_copies_on_both_sides(spark):
    rows = items(spark, *[("train", Q, OPTIONS)] * 6, *[("test", Q + " ", OPTIONS)] * 3)
    assert {tuple(r) for r in p3.overlap_pairs(rows).collect()} == set(itertools.product(range(1, 7), range(7, 10)))
    assert p3.overlap_report(rows).first()["pairs"] == 18


def test_hot_keys_are_spread_without_changing_results(spark, monkeypatch):
    """A third of all rows in one class and one look, with the threshold for hot keys lowered so that they are spread."""
    from functools import partial

    rng = random.Random(23)
    words = "患者发热咳嗽胸痛头晕乏力恶心呕吐腹泻皮疹水肿黄疸眩晕抽搐失眠便秘口干多饮尿频"
    other = ["".join(rng.choice(words) for _ in range(40)) for _ in range(20)]
    rows = [(("train", "val", "test")[i % 3], Q + " " * (i % 4), OPTIONS) for i in range(24)]
    rows += [("train", t, None) for t in other] + [("val", t[:30] + t[31:], None) for t in other] + [("test", Q.replace("剧烈", "剧列烈"), OPTIONS)]
    table = items(spark, *rows)
    looks = [(i, "Ａ题" if i % 2 else "A题", None, "B") for i in range(20)] + [(30 + i, f"题{i}", None, "B") for i in range(30)] + [(99, "Α题", None, "B")]
    sft = spark.createDataFrame(looks, "row_id long, question string, options map<string,string>, answer string")
    plain = {tuple(r) for r in p3.overlap_pairs(table).collect()}, {tuple(r) for r in p5.lookalike_pairs(sft).collect()}
    for module in (p3, p5):
        monkeypatch.setattr(module, "salted_join", partial(module.salted_join, least=2, salts=4))
    spread = {tuple(r) for r in p3.overlap_pairs(table).collect()}, {tuple(r) for r in p5.lookalike_pairs(sft).collect()}
    assert plain == spread and len(plain[0]) == 8 * 16 + 8 + 20 and len(plain[1]) == 100 + 20


# -- p5 -----------------------------------------------------------------------------------------------------------------

_LIKELY = st.text(alphabet=st.sampled_from("aAéé̈oоКKＫ１1⼥女者者​ 　 ，,①⁹µμ️각가"), max_size=12)


@given(_LIKELY | st.text(max_size=20))
@settings(max_examples=400, deadline=None)
def test_segments_give_what_the_whole_text_gives(text):
    whole = p5.canonical_segment(text)
    assert p5.one_form(text) == whole and p5.one_form(whole) == whole


def test_what_looks_the_same_and_what_does_not():
    same = [("Kösner", "Ko​̈sner"), ("Кöѕner", "Kösner"), ("⽣物", "生物"), ("１２．５ｍｇ", "12.5mg"), ("a b", "a b"), ("a　b", "a b"), ("更者", "更者"), ("（＋）", "(+)"), ("ｶﾞ", "ガ"), ("x­", "x"), ("µ", "μ")]
    differ = [("⁹", "9"), ("①", "1"), ("é", "e"), ("A", "a"), ("療", "疗"), ("，", "、"), ("a b", "ab"), ("。", ".")]
    assert all(p5.one_form(a) == p5.one_form(b) for a, b in same) and all(p5.one_form(a) != p5.one_form(b) for a, b in differ)


SFT = "row_id long, question string, options map<string,string>, answer string, look string"


def test_lookalike_pairs(spark):
    rows = [(1, "题Ａ", {"A": "x"}, "A"), (2, "题A", {"A": "x"}, "A"), (3, "题A", {"A": "x"}, "A"), (4, "题a", {"A": "x"}, "A"), (5, "题A", {"Ａ": "x"}, "A"), (6, None, None, None), (7, "", {}, ""), (8, "​", None, None), (None, "题Ａ", {"A": "x"}, "A")]
    table = spark.createDataFrame([(*r, "z") for r in rows], SFT)
    assert {tuple(r) for r in p5.lookalike_pairs(table).collect()} == {(1, 2), (1, 3), (1, 5), (2, 5), (3, 5), (6, 8), (7, 8)}
    out = {r["row_id"]: r for r in p5.in_one_form(table, ["question", "answer"], "options").collect()}
    assert out[1]["question"] == "题A" and out[5]["options"] == {"A": "x"} and out[6]["question"] is None and out[1]["look"] == "z"
    assert p5.lookalike_pairs(table.limit(0)).count() == 0


# -- p6 -----------------------------------------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms), sorted(rooms)


@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
@settings(max_examples=200, deadline=None)
def test_counted_best_fit_equals_the_plain_one(sizes, capacity):
    plan = p6.best_fit(dict(Counter(sizes)), capacity)
    held = Counter()
    for length, n in Counter(sizes).items():
        for rank in range(n):
            lo, base, per = [s for s in plan.slots[length] if s[0] <= rank][-1]
            held[base + (rank - lo) // per] += length
    n, rooms = plain_best_fit(sizes, capacity)
    assert plan.n_containers == n == len(held) and sorted(capacity - h for h in held.values()) == rooms


def test_fill_places_every_piece(spark):
    rng = random.Random(2)
    docs = [(i, "词 " * rng.randint(0, 60)) for i in range(200)] + [(300, None), (301, ""), (302, "a b c " * 200)] + [(i, "x y z") for i in range(400, 500)] + [(0, "twice")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tokens int")
    specs = spark.createDataFrame([(1, 64), (2, 50)], "spec_id int, capacity_tokens int")
    placed, plans = p6.fill(table, specs)
    rows = placed.collect()
    for spec, cap in ((1, 64), (2, 50)):
        mine = [r for r in rows if r["spec_id"] == spec]
        held = Counter()
        for r in mine:
            held[r["container_id"]] += r["tokens"]
        assert max(held.values()) <= cap and len(held) == plans[spec].n_containers and Counter(r["doc_id"] for r in mine).keys() == {d[0] for d in docs}
        total = Counter()
        for r in mine:
            total[r["doc_id"]] += r["tokens"]
        assert all(n == max(1, -(-total[d] // cap)) for d, n in Counter(r["doc_id"] for r in mine).items() if d)
    report = {r["spec_id"]: r for r in p6.fill_report(table, specs).collect()}
    assert report[1]["fill"] > 0.9 and report[1]["fullest"] <= 64
    assert p6.fill(table.limit(0), specs)[0].count() == 0


# -- p7 -----------------------------------------------------------------------------------------------------------------


def test_mix_follows_targets_and_caps(spark):
    rng = random.Random(4)
    docs = [(i, f"s{min(i % 10, 3)}", "word " * max(1, int(rng.lognormvariate(3, 1)))) for i in range(3000)] + [(9001, "tiny", "one two three")] + [(9002, None, "x"), (9003, "s0", None), (9004, "s0", "")]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([(1, "s0", 0.5, 4), (1, "s1", 0.2, 4), (1, "tiny", 0.2, 3), (1, "gone", 0.1, 2), (2, "s3", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = {(r["mix_id"], r["source"]): r for r in p7.actual_shares(table, targets).collect()}
    assert got[1, "tiny"]["most_uses"] == 3 and got[1, "tiny"]["capped"] and got[1, "gone"]["used_tokens"] == 0 and got[1, "gone"]["capped"]
    ratio = got[1, "s0"]["used_tokens"] / got[1, "s1"]["used_tokens"]
    assert ratio == pytest.approx(2.5, rel=0.03) and got[2, "s3"]["used_tokens"] == got[2, "s3"]["available_tokens"]
    uses = p7.mixed(table, targets).collect()
    for key, part in itertools.groupby(sorted(uses, key=lambda r: (r["mix_id"], r["source"])), key=lambda r: (r["mix_id"], r["source"])):
        n = [r["uses"] for r in part]
        assert max(n) - min(n) <= 1 and max(n) <= 4
    small = p7.actual_shares(table, targets, 500).where("mix_id = 1").agg(F.sum("used_tokens")).first()[0]
    assert 300 <= small <= 700
    # at the feasible size every share is met, those of absent sources spread over the others
    targets = targets.where("source <> 'tiny'").unionByName(spark.createDataFrame([(3, "s0", 0.3, 1), (3, "s2", 0.7, 2)], targets.schema))
    total = p7.actual_shares(table, targets).where("mix_id = 3").first()["feasible_tokens"]
    met = {r["source"]: r for r in p7.actual_shares(table, targets, total).where("mix_id = 3").collect()}
    assert met["s0"]["actual_share"] == pytest.approx(0.3, abs=0.01)
    assert sum(r["used_tokens"] for r in met.values()) == pytest.approx(total, rel=0.02)
    assert p7.mixed(table.limit(0), targets).count() == 0


def test_expected_copies():
    got = p7.expected_copies({"a": (0.5, 2), "b": (0.5, 10)}, {"a": 10, "b": 100}, 110)
    assert got["a"] == 2.0 and got["b"] == pytest.approx(0.9)
    assert p7.expected_copies({"a": (1.0, 2)}, {}, 10) == {"a": 0.0}


# -- p8 -----------------------------------------------------------------------------------------------------------------


def details(text):
    return [(s.kind, text[s.start : s.end]) for s in p8.personal_details(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("联系人：柳榕淮（其女）。", [("name", "柳榕淮")]),
        ("参加讨论：韩樾栩、Gu Qilan、巴合提·萨比提、诸葛黎。", [("name", "韩樾栩"), ("name", "Gu Qilan"), ("name", "巴合提·萨比提"), ("name", "诸葛黎")]),
        ("昨夜由范栩护送入院。周医生认为可以观察。魏某某，48岁，姓名已隐去。", [("name", "范栩")]),
        ("Dr. Tamsin Q. Wexcombe reviewed the film. Dr. Vashti left.", [("name", "Tamsin Q. Wexcombe")]),
        ("请写信到 WEN.SHUYAO[at]ruihe-clinic[dot]example 与病房联系，请@护士站。See option 9@14 mg.", [("email", "WEN.SHUYAO[at]ruihe-clinic[dot]example")]),
        ("发送至tangli+ward6＠wardnine.test，谢谢", [("email", "tangli+ward6＠wardnine.test")]),
        ("家属电话(+86)163-6526-2637，Tel：一六一二二七六三一七六，复诊请拨 （0600）5555439 。", [("phone", "(+86)163-6526-2637"), ("phone", "一六一二二七六三一七六"), ("phone", "（0600）5555439")]),
        ("Tel +44 20 7946 0673 . Call 303.555.0170 after 5 pm.", [("phone", "+44 20 7946 0673"), ("phone", "303.555.0170")]),
        ("标本号15480093783已送检。家属电话154****6205已脱敏。急救请拨120，院内分机9207。Specimen 2029-555-3851 was rejected.", []),
        ("身份证号11010519491231002X。影像流水号110105194912310021已归档。", [("id_number", "11010519491231002X")]),
        ("SSN 000-66-7122 is on the form.", [("id_number", "000-66-7122")]),
        ("现住云泽市清和区归雁路360号15栋1847室。病房位于9号楼12层10床。", [("address", "云泽市清和区归雁路360号15栋1847室")]),
        ("救护车从青岚县星桥镇芦荻村12组78号接到患者。", [("address", "青岚县星桥镇芦荻村12组78号")]),
        ("搬到北渡区落霞里37弄14号786室后症状加重。", [("address", "北渡区落霞里37弄14号786室")]),
        ("The patient lives at 848 Old Quay Rd., Apt 14C.", [("address", "848 Old Quay Rd., Apt 14C")]),
        ("", []),
    ],
)
def test_details(text, found):
    assert details(text) == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("电话138·1234·5678。", "138·1234·5678"), ("电话+12345。", "+12345"), ("电话+٩٦٦ ٥٠ ١٢٣ ٤٥٦٧。", "+٩٦٦ ٥٠ ١٢٣ ٤٥٦٧"), ("账号DE39ABCDEFGHIJKL。", "DE39ABCDEFGHIJKL"),
        ("家住阳光小区院3-2-1，", "阳光小区院3-2-1"), ("家住阳光小区国际大厦A座5层。", "阳光小区国际大厦A座5层"), ("家住人民路百号院3-2-1。", "人民路百号院3-2-1"),
        ("家住人民路" + "1" * 80 + "号院3-2-1。", "人民路" + "1" * 80 + "号院3-2-1"),
    ],
)
def test_filters_drop_nothing_that_the_patterns_accept(text, found, monkeypatch):
    filtered = p8.personal_details(text)
    monkeypatch.setattr(p8, "_DIGIT_ANCHOR", re.compile(""))
    monkeypatch.setattr(p8, "_windows", lambda t: [(0, len(t))])
    assert filtered == p8.personal_details(text) and found in [text[s.start : s.end] for s in filtered]


HELD_OUT = [
    ("患者张伟明入院。", "张伟明"), ("张伟明说他不舒服", "张伟明"), ("护士王丽华今天值班。", "王丽华"), ("请联系李雷（主任）", "李雷"), ("病人陈志强昨日出院，带药两种。", "陈志强"),
    ("刘洋表示愿意手术。", "刘洋"), ("联系赵雪梅，电话稍后补。", "赵雪梅"), ("欧阳菲菲女士来电。", "欧阳菲菲"), ("家属孙晓燕签字。", "孙晓燕"), ("陪护吴鑫，住在附近。", "吴鑫"),
    ("患者周杰今日复查。", "周杰"), ("医生何建国查房后更改医嘱。", "何建国"), ("杨明哲自述头晕三天。", "杨明哲"), ("通知胡静来院。", "胡静"), ("郭文斌的妻子陪同就诊。", "郭文斌"),
    ("同事林浩然告诉我们经过。", "林浩然"), ("教授徐春华会诊。", "徐春华"), ("患者马玉兰目前平稳。", "马玉兰"), ("其父郑凯已到。", "郑凯"), ("父亲钱学森住院。", "钱学森"),
]
NO_NAME = [
    "患者高热，伴寒战。", "患者安静，神志清。", "病人黄疸明显。", "家属白天陪护。", "患者平安，无不适。", "患者方便时来院。", "医生和护士说明病情。", "患者金黄色葡萄球菌感染。", "张力高，注意减压。", "江苏今天下雨。",
    "患者万古霉素过敏。", "请联系护士站。", "通知家属，今日手术。", "任何人说的都要记录。", "时间：今天。",
]


def test_names_by_make_and_context_on_held_out_sentences():
    """Sentences written without looking at the test tables; README gives the share found."""
    hits = [("name", name) in details(text) for text, name in HELD_OUT]
    assert sum(hits) >= 17, [t for (t, _), h in zip(HELD_OUT, hits) if not h]
    assert [t for t in NO_NAME if any(k == "name" for k, _ in details(t))] == []


@pytest.mark.parametrize(("text", "kind"), [("Call 212-555-0187 today", "phone"), ("SSN 219-09-9999 on file", "id_number"), ("电话0571-87654321转护士站", "phone")])
def test_context_decides_what_digits_alone_do_not(text, kind):
    number = re.search(r"[\d-]{11,}", text)[0]
    assert details(text) == [(kind, number)] and details(f"The ratio {number} was recorded") == []


def test_details_beside_a_number_speak_for_it():
    assert details("联系人：王丽华，0571-87654321。") == [("name", "王丽华"), ("phone", "0571-87654321")]
    assert details("数值0571-87654321见表。") == []


def test_validators():
    assert p8.resident_id("11010519491231002X") and not p8.resident_id("110105194912310021") and not p8.resident_id("110105194913310020")
    assert p8.resident_id("110105491231002") and not p8.resident_id("110105491331002")
    assert p8.luhn("4539578763621486") and not p8.luhn("4539578763621487")
    assert p8.mod97("GB82WEST12345698765432") and not p8.mod97("GB82WEST12345698765433")
    assert details("卡号4539578763621486。") == [("account", "4539578763621486")] and details("卡号4539578763621487。") == []


def test_replacing_keeps_the_rest(spark):
    text = "我叫赵沐翎，电话16409750097，住现住云泽市银杏区碧梧街494号。谢谢。"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "没有信息" * 5000), (5, text + text)], "doc_id long, text string")
    out = {r["doc_id"]: r["t"] for r in rows.select("doc_id", p8.redacted(F.col("text")).alias("t")).collect()}
    assert out[1].startswith("我叫[NAME]，电话[PHONE]，") and out[1].endswith("[ADDRESS]。谢谢。") and out[2] is None and out[3] == "" and out[4] == "没有信息" * 5000
    found = Counter(r["id"] for r in p8.find(rows).collect())
    assert found == {1: 3, 5: 3} and p8.find(rows.limit(0)).count() == 0
    assert not re.search(r"\d{11}", out[5]) and unicodedata.is_normalized("NFC", out[1])


# -- long texts, clashing names ------------------------------------------------------------------------------------------


def test_long_questions_are_compared_in_one_walk():
    rng = random.Random(9)
    long = "".join(rng.choice("患者发热咳嗽胸痛头晕乏力恶心呕吐皮疹") for _ in range(200_000))
    slip = long[:1000] + long[1001:150_000] + "疹疹" + long[150_000:]
    other = long[:1000] + "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(60)) + long[1060:]
    assert verify.same_question(long, [], slip, []) and not verify.same_question(long, [], other, [])


def test_close_slips_count_alike_in_short_and_long_questions():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("患者发热咳嗽胸痛头晕乏力恶心呕吐皮疹") for _ in range(n))
    for gap in (20, 1_500, 20_000):
        start, middle, end = text(30), text(gap), text(30)
        # two characters mistaken three apart, and one left out far on
        assert verify.same_question(start + "钙铁锌钾" + middle + "钠" + end, [], start + "镁铁锌铜" + middle + end, [])
        # slips in a row of which no six characters between agree
        assert verify.same_question(start + "钙铁锌钾钠镁" + middle + "钠" + end, [], start + "钙铁铁锌钾钠钠镁" + middle + end, [])
        assert not verify.same_question(start + "钙铁锌钾" + middle + "钠" + end, [], start + "镁铁锌铜" + middle + "银" + end, [])
        assert not verify.same_question(start + "钠" + middle + end, [], start + middle + text(40) + end, [])


def test_very_long_texts_and_clashing_columns(spark):
    long = "患者发热三天。" * 40_000
    names = ["text", "tokens", "rank", "source", "n", "key", "id", "kind", "u", "cell"]
    schema = "doc_id long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, *["x"] * 9) for i, t in enumerate([long, "我叫赵沐翎，想问一下用药的事。" + long, "", None])], schema)
    assert p8.find(docs).count() == 1
    assert docs.select(p8.redacted(F.col("text")).alias("t")).where("t like '%[NAME]%'").count() == 1
    specs = spark.createDataFrame([(1, 256)], "spec_id int, capacity_tokens int")
    assert p6.fill(docs, specs)[0].select("doc_id").distinct().count() == 4
    targets = spark.createDataFrame([(1, "x", 1.0, 2)], "mix_id int, source string, target_share double, max_repeats int")
    assert p7.mixed(docs, targets).count() == 2
    rows = items(spark, ("train", long, OPTIONS), ("val", long + "。", OPTIONS), ("val", long[7:], OPTIONS))
    assert p4.copies_of(rows).count() == 1 and p3.overlap_pairs(rows).where("id_b = 2").count() == 1
    texts = spark.createDataFrame([("k", 1, "s", '{"a": "' + long, None, 1), ("k", 2, "s", long, None, 1)], "kind string, id long, source string, text string, recorded long, at long")
    assert [r["id"] for r in p2.judged(texts).where("cut").collect()] == [1]
    sft = spark.createDataFrame([(1, long + "Ａ", None, None, "z"), (2, long + "A", {}, "", "z")], SFT)
    assert p5.lookalike_pairs(sft).count() == 1
    rewards, alias, plan, _ = p1_tables(spark, 300)
    more = rewards.withColumns({c: F.lit("x") for c in ("accept", "u", "wanted", "line_id", "plan_id", "difficulty_x", "t", "d")})
    assert p1.deficits(more, alias, plan).count() == p1.deficits(rewards, alias, plan).count()
