"""Scores, classes and flags of exam items and case texts, as declarative rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import hashing, text
from sieveworks.functions.choices import is_multi
from sieveworks.functions.rules import all_hits, first_hit, looked_up, staged, stepwise, weighted

# Words that make an exam question hard or easy, and patterns of dense terms.
HARD_WORDS = ("鉴别诊断", "鉴别", "不属于", "错误的是", "不包括", "急性", "慢性", "并发症", "手术指征", "首选", "禁忌", "最常见", "最少见", "首先", "原则")
EASY_WORDS = ("体检", "正常", "标准", "定义", "概念")
DENSE_TERMS = (r"[A-Z][αβγδεμμ]+", r"\d+[.]\d+", r"[+-]?\d+/\d+", r"\d+mg", r"\d+ml")
# What a case text tells, by category.
CASE_PATTERNS = {
    "person": r"患者|病人|患儿|男性|女性|男[，,。]?\d+岁|女[，,。]?\d+岁|孕妇|孕\d+月|老年|儿童|婴儿|婴幼儿|新生儿|产妇",
    "symptom": r"发热|疼痛|腹痛|胸痛|头痛|咳嗽|咳痰|气促|呼吸困难|呕吐|恶心|腹泻|便血|咯血|浮肿|乏力|眩晕|抽搐|心悸|黄疸|瘙痒|排尿困难|吞咽困难",
    "exam": r"查体|体检|血压|脉搏|体温|呼吸|X线|CT|MRI|B超|超声|彩超|心电图|ECG|实验室|血常规|尿常规|病理|造影|镜检|活检|阳性|阴性|抗体|血清|片示",
    "timeline": r"\d+(?:小时|天|周|月|年)|反复|突发|进行性|加重|缓解|既往|病史|起病|来诊|入院|余",
}
STRONG_DEFINITIONS = r"什么是|什么指|概念|定义|含义"
WEAK_DEFINITIONS = r"特点|特征"
RECALL_TEMPLATES = r"最常见|最常用|首选|适应证|禁忌证|作用|机制|第一部|主要用于"
# Patterns and weights of the score of case texts.
CASE_INDICATORS = (
    r"(患者|病人|主诉|现病史|体格检查|辅助检查)",
    r"([男女].{0,4}\d{1,3}岁|\d{1,3}岁|男性|女性|男|女)",
    r"\d+(\.\d+)?\s*(小时|天|日|周|月|年|分钟)",
    r"(查体|体格检查|辅助检查|血常规|尿常规|CT|MRI|超声|心电图|胸片|影像|WBC|BP|血氧|体温|℃|°C)",
    r"(发热|疼痛|胸痛|腹痛|咳|咳痰|呕吐|头痛|气短|气促|水肿|乏力|出血|黄疸|尿频|腹泻)",
)
# Words by which a case text is flagged.
SYMPTOM_HINTS = ("患者", "病人", "主诉", "现病史", "体格检查", "辅助检查", "发热", "疼痛", "咳", "呕吐", "腹", "胸", "头痛")
GENERIC_QUESTION_HINTS = ("怎么办", "严重吗", "吃什么药", "用法用量", "简介", "是什么")
IMAGE_HINTS = ("图片", "照片", "片子", "报告单", "上传")
SAFETY_HINTS = ("自杀", "去死", "不想活", "生不如死")
# Words of the departments, of high risk and of a need for differential diagnoses, of hard and easy cases.
DEPARTMENT_WORDS = {
    "呼吸": "肺炎 支气管 肺 呼吸道 咳嗽 咳痰 咯血 哮喘 COPD 慢阻肺 气胸 胸腔 肺栓塞 胸水 胸痛 呼吸 肺结核 肺癌 肺脓肿 ARDS 肺水肿 脓胸 流感".split(),
    "消化": "胃 肠 肝 胆 胰腺 食管 消化道 胃肠 肝功能 黄疸 腹水 腹胀 腹痛 恶心 呕吐 呕血 黑便 消化性溃疡 胃炎 肝炎 肝硬化 胆囊炎 阑尾 结肠 痢疾 胃肠炎 胰腺炎 胃潴留 幽门 肠梗阻 短肠 肠易激".split(),
    "心血管": "心 血压 冠心病 心肌 心电图 心律 心衰 心梗 主动脉 心脏 心包 瓣膜 高血压 低血压 胸闷 心悸 动脉 血管 夹层 心绞痛 心源性 嗜铬细胞瘤 心肌炎 心包炎 肺动脉 先心病".split(),
    "神经": "脑 神经 意识 头痛 头晕 癫痫 脑卒中 脑血管 偏瘫 肢体 麻木 语言 面瘫 帕金森 痴呆 脑炎 脑梗 脑出血 颅内 眩晕 晕厥 谵妄 昏迷 脊髓".split(),
    "内分泌": "糖尿病 甲亢 甲减 甲状腺 内分泌 血糖 胰岛素 皮质醇 肾上腺 垂体 尿糖 酮症 高血糖 低血糖 骨质 肥胖 代谢 激素 醛固酮 肾素 多囊 痛风".split(),
    "急诊": "休克 昏迷 中毒 创伤 急腹症 大出血 呼吸困难 心肺复苏 急诊 急性 危象 脓毒症 多器官 DIC 急性冠脉 急性胰腺 急性阑尾 宫外孕".split(),
}
HIGH_RISK_WORDS = (
    "休克 昏迷 意识障碍 大出血 心肺 呼吸衰竭 急性 危象 中毒 脓毒症 多器官 心肌梗死 主动脉夹层 脑出血 脑疝 肺栓塞 急性肝衰竭 急性肾损伤 高血钾 低血钾 心律失常 失血性休克 感染性休克 过敏性休克 DIC"
).split()
DIFFERENTIAL_WORDS = "胸痛 腹痛 发热待查 不明原因 鉴别 考虑 可能 类似 需要排除 需排除 不明".split()
# What flags, patterns and routes are worth.
ROUTE_PRIORITY = {"structured_block_candidate": 1.00, "exam_rewrite_candidate": 0.75, "rewrite_candidate": 0.50}
FLAG_PENALTIES = {
    "generic_medical_qa": 0.15, "weak_case_context": 0.20, "may_depend_on_image_or_attachment": 0.30, "safety_boundary_signal": 0.05, "too_short": 1.00,
    "has_replacement_character": 1.00,
}
PATTERN_PENALTIES = (
    (r"(用法用量|注意事项|说明书|副作用|不良反应)", 0.10),
    (r"(简介是|是什么|什么是|发病原因|病因是什么|预防.*是什么)", 0.08),
    (r"^(.*)(严重吗|怎么办|吃什么药)[?？]?$", 0.05),
)


def _q(question: Column) -> Column:
    return F.coalesce(question, F.lit(""))


def exam_difficulty(question: Column, question_type: Column, multi_word: str = "多选") -> Column:
    """hard, medium or easy from words, dense terms and length."""
    q = _q(question)
    hard = text.hint_count(q, HARD_WORDS) + F.contains(F.coalesce(question_type, F.lit("")), F.lit(multi_word)).cast("int") + (F.length(q) > 80).cast("int")
    easy = text.hint_count(q, EASY_WORDS) + (F.length(q) < 30).cast("int")
    dense = text.pattern_count(q, DENSE_TERMS)
    return first_hit([("hard", (hard >= 3) | (dense >= 3)), ("easy", (easy >= 2) & (hard == 0))], "medium")


def _values(options: Column) -> Column:
    return F.transform(F.coalesce(F.map_values(options), F.array().cast("array<string>")), text.stripped)


def exam_quality(question: Column, options: Column, question_type: Column, exam_type: Column) -> Column:
    """Additive score up to 1 from lengths, options, terms and type."""
    q, n = F.length(_q(question)), F.coalesce(F.when(options.isNotNull(), F.size(options)), F.lit(0))
    lengths = F.transform(_values(options), F.length)
    total = F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    mean = F.try_divide(total, F.size(lengths))
    all_long = (F.size(lengths) > 0) & F.forall(lengths, lambda x: x > 2)
    terms = F.regexp_count(_q(question), F.lit("[一-鿿]{2,}"))
    return F.least(
        F.lit(1.0),
        stepwise([(q.between(30, 200), 0.20), ((q >= 15) & (q < 30), 0.10), (q > 10, 0.05)])
        + stepwise([(n == 5, 0.20), (n == 4, 0.15), (n >= 3, 0.05)])
        + F.when(all_long, stepwise([(mean.between(5, 30), 0.20), (mean > 2, 0.10)])).otherwise(F.lit(0.0))
        + stepwise([(terms >= 4, 0.20), (terms >= 2, 0.10)])
        + weighted([(0.05, F.contains(F.coalesce(question_type, F.lit("")), F.lit("多选"))), (0.15, F.contains(F.coalesce(exam_type, F.lit("")), F.lit("医师考试")))]),
    )


def keeper_quality(given: Column | None, question: Column, options: Column, answer: Column) -> Column:
    """Score by which the row to keep is chosen: a given one, else from length, options and answer."""
    q = F.length(_q(question))
    filled = F.size(F.filter(_values(options), lambda v: v != ""))
    own = (
        stepwise([(q.between(10, 200), 0.4), (q.between(5, 400), 0.2)])
        + F.least(filled, F.lit(5)) / 5 * 0.4
        + F.when(text.stripped(answer) != "", F.lit(0.2)).otherwise(F.lit(0.0))
    )
    return own if given is None else F.coalesce(given, own)


def case_categories(question: Column) -> Column:
    return F.array_sort(all_hits([(name, _q(question).rlike(pattern)) for name, pattern in CASE_PATTERNS.items()]))


def reasoning_features(items: DataFrame, question: str = "question", options: str = "options", answer: str = "answer", question_type: str = "question_type", short: int = 20) -> DataFrame:
    """``items`` with the features and the score of worthiness for reasoning.

    score = 2 if several answers + case information + confusable options
    - definition - low reasoning, rounded half to even at six places. Options
    are compared by the variation of their lengths and the mean Jaccard
    similarity of their bigram sets over all pairs, within the row.
    """
    none = F.array().cast("array<string>")
    sep = "␞"
    packed = F.concat(F.array(F.coalesce(F.col(question), F.lit(""))), F.coalesce(F.map_values(options), none))
    out = items.withColumn("__p", F.split(text.nfkc(F.array_join(packed, sep, "")), sep))
    out = staged(
        out,
        {"__q": text.stripped(F.col("__p")[0]), "__o": F.filter(F.transform(F.slice("__p", F.lit(2), F.size("__p")), lambda v: text.comparison_form(v, False)), lambda v: v != "")},
    )
    lengths = F.transform("__o", F.length)
    n = F.size("__o")
    mean = F.try_divide(F.aggregate(lengths, F.lit(0), lambda s, x: s + x), n)
    spread = F.sqrt(F.try_divide(F.aggregate(lengths, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n))
    out = staged(out, {"__cv": F.when(n > 1, spread / mean).otherwise(F.lit(0.0)), "__sets": F.transform("__o", hashing.bigram_set)})
    indexed = F.sequence(F.lit(1), F.greatest(F.size("__sets"), F.lit(1)))
    pairs = F.flatten(
        F.transform(indexed, lambda i: F.transform(F.filter(indexed, lambda j: j > i), lambda j: hashing.jaccard(F.get("__sets", i - 1), F.get("__sets", j - 1))))
    )
    out = staged(out, {"__pairs": F.when(F.size("__sets") > 1, pairs).otherwise(F.array().cast("array<double>"))})
    overlap = F.coalesce(F.try_divide(F.aggregate("__pairs", F.lit(0.0), lambda s, x: s + x), F.size("__pairs")), F.lit(0.0))
    categories = case_categories(F.col("__q"))
    out = staged(out, {"case_info_categories": categories, "option_length_cv": F.bround("__cv", 6), "option_avg_bigram_jaccard": F.bround(overlap, 6), "__overlap": overlap})
    has_options = F.size("__o") > 0
    balance = F.when(has_options, stepwise([(F.col("__cv") <= 0.15, 0.8), (F.col("__cv") <= 0.30, 0.4)])).otherwise(F.lit(0.0))
    alike = stepwise([(F.col("__overlap") >= 0.30, 0.8), (F.col("__overlap") >= 0.15, 0.4)])
    coverage = F.size("case_info_categories")
    case_score = stepwise([(coverage >= 3, 1.5), (coverage == 2, 1.0), (coverage == 1, 0.5)])
    definition = first_hit([("strong", F.col("__q").rlike(STRONG_DEFINITIONS)), ("weak", F.col("__q").rlike(WEAK_DEFINITIONS))], "none")
    out = staged(
        out,
        {
            "is_multi_choice": is_multi(F.col(question_type), F.col(answer)), "case_info_score": case_score, "option_length_balance_score": balance,
            "option_bigram_overlap_score": alike, "definition_level": definition,
        },
    )
    flags = all_hits(
        [
            ("short_question", F.length(text.comparison_form(F.col("__q"), False)) < short),
            ("no_case_info", F.col("case_info_score") == 0),
            ("recall_template", F.col("__q").rlike(RECALL_TEMPLATES)),
        ]
    )
    out = staged(out, {"low_reasoning_flags": flags})
    out = staged(
        out,
        {
            "definition_penalty": stepwise([(F.col("definition_level") == "strong", 1.0), (F.col("definition_level") == "weak", 0.3)]),
            "low_reasoning_penalty": stepwise([(F.size("low_reasoning_flags") >= 3, 1.0), (F.size("low_reasoning_flags") == 2, 0.5)]),
            "option_confusion_score": F.bround(F.col("option_length_balance_score") + F.col("option_bigram_overlap_score"), 6),
        },
    )
    score = (
        F.when(F.col("is_multi_choice"), F.lit(2.0)).otherwise(F.lit(0.0)) + F.col("case_info_score") + F.col("option_confusion_score")
        - F.col("definition_penalty") - F.col("low_reasoning_penalty")
    )
    out = staged(out, {"reasoning_score": F.bround(score, 6)})
    return out.drop("__p", "__q", "__o", "__cv", "__sets", "__pairs", "__overlap")


def score_class(score: Column, easy: float = -0.1, medium: float = 0.9) -> Column:
    return first_hit([("easy", score <= easy), ("medium", score <= medium), ("hard", score.isNotNull())])


def length_score(case: Column) -> Column:
    n = F.length(_q(case))
    return F.when(n <= 0, F.lit(0.0)).when(n < 40, n / 80.0).when(n <= 1200, F.lit(1.0)).when(n <= 2500, F.lit(0.85)).otherwise(F.lit(0.65))


def case_richness(case: Column) -> Column:
    return (weighted([(1.0, _q(case).rlike(p)) for p in CASE_INDICATORS]) + length_score(case)) / 6


def penalty(flags: Column, case: Column) -> Column:
    """Sum of the penalties of a row's flags, of patterns in its text and of great length."""
    of_flags = F.aggregate(F.coalesce(flags, F.array().cast("array<string>")), F.lit(0.0), lambda s, f: s + looked_up(f, FLAG_PENALTIES, 0.0))
    return of_flags + weighted([(w, _q(case).rlike(p)) for p, w in PATTERN_PENALTIES] + [(0.05, F.length(_q(case)) > 3000)])


def quality_flags(case: Column) -> Column:
    """Flags of a case text: short, damaged, dependent on an image, near safety limits, a generic question, little context."""
    t = _q(case)
    return all_hits(
        [
            ("too_short", F.length(t) < 12),
            ("has_replacement_character", F.contains(t, F.lit("�"))),
            ("may_depend_on_image_or_attachment", text.any_hint(t, IMAGE_HINTS)),
            ("safety_boundary_signal", text.any_hint(t, SAFETY_HINTS)),
            ("generic_medical_qa", (F.length(t) < 40) & text.any_hint(t, GENERIC_QUESTION_HINTS)),
            ("weak_case_context", ~text.any_hint(t, SYMPTOM_HINTS)),
        ]
    )


def penalty_reasons(flags: Column, case: Column) -> Column:
    """Names of what ``penalty`` counts: flags that cost something, ``pattern:`` and the pattern, great length."""
    costly = F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.isin(*FLAG_PENALTIES))
    more = all_hits([(f"pattern:{p}", _q(case).rlike(p)) for p, _ in PATTERN_PENALTIES] + [("very_long_text", F.length(_q(case)) > 3000)])
    return F.concat(costly, more)


def is_high_risk(case: Column) -> Column:
    return text.any_hint(case, HIGH_RISK_WORDS)


def needs_differential(case: Column, differentials: Column) -> Column:
    """A word that asks for a differential diagnosis, or a target that has one."""
    return text.any_hint(case, DIFFERENTIAL_WORDS) | (F.coalesce(F.size(differentials), F.lit(0)) > 0)


def of_table(table: Mapping[str, float], *key: Column, otherwise: float) -> Column:
    """Value of a small table by a key of one or more parts, joined by bars; a missing part counts as empty."""
    return looked_up(F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in key]), table, otherwise)


def target_score(likeness: Column, source: Column, richness: Column, route: Column, cost: Column) -> Column:
    """Score by which candidates are chosen: likeness to the targets, source, richness, route, less the penalties."""
    return 0.55 * likeness + 0.25 * source + 0.15 * richness + 0.05 * route - cost


def top_class(words: Mapping[str, Sequence[str]], case: Column) -> Column:
    """Class with most of its words in the text, of equals the first; null if none has any."""
    scored = F.array(*[F.struct(text.hint_count(case, w).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, w) in enumerate(words.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"])
