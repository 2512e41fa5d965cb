"""SQL for DuckDB with the rows of the core queries.

Written from the definition of each result, not from the Spark code. White
space beyond ASCII is spelled out, as the engine's ``\\s`` is ASCII only;
the compatibility form is replaced by the substitutions that occur in exam
items. Queries without an entry can't be said in SQL: sketches by BLAKE2,
greedy selection, packing and the iterated components.
"""

from __future__ import annotations

from sieveworks.functions.text import COMPARISON_PUNCTUATION, DIAGNOSIS_HEDGES
from sieveworks.operators import evaluation, rewards, scoring
from sieveworks.plans import corpus, exam

_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "")
_PLAIN = "".join(chr(0x21 + i) for i in range(94))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nf(x: str) -> str:
    """Compatibility form as far as exam items need it."""
    out = f"translate({x}, {_q(_WIDE + '⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉⁺⁻　')}, {_q(_PLAIN + '01234567890123456789+-')} || ' ')"
    return f"replace(replace(replace({out}, '℃', '°C'), '…', '...'), chr(160), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def no_space(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}+', '', 'g')"


def comparison(x: str, normal: bool = True) -> str:
    base = nf(f"coalesce({x}, '')") if normal else f"coalesce({x}, '')"
    return f"translate({no_space(f'lower({base})')}, {_q(COMPARISON_PUNCTUATION)}, '')"


def hits(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {_q(w)})::INT" for w in words) + ")"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(pattern)}))"


def case(*steps: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {otherwise} END"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


QUESTION = "coalesce(question, '')"
_HAN = "[一-鿿]"
SPECIAL = r"[^\p{L}\p{N}\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"


def _ratio(pattern: str) -> str:
    return f"CASE WHEN length({QUESTION}) = 0 THEN 0.0 ELSE {count(QUESTION, pattern)} / length({QUESTION})::DOUBLE END"


_CLEAN = f"""
WITH base AS (
  SELECT item_id, {strip(nf(QUESTION))} AS q, options IS NULL AS no_map, upper({strip(nf("coalesce(answer, '')"))}) AS raw,
    list_sort(list_transform(coalesce(map_entries(options), []), lambda e: {{'key': upper({strip(nf('e.key'))}), 'value': {strip(nf("coalesce(e.value, '')"))}}})) AS opts
  FROM exam_item),
keyed AS (SELECT *, list_transform(opts, lambda e: e.key) AS ks, CASE WHEN raw = '' THEN [] ELSE string_split(raw, '') END AS cs FROM base),
answered AS (
  SELECT *, CASE WHEN list_contains(ks, raw) THEN raw
    WHEN len(cs) > 0 AND len(list_filter(cs, lambda c: list_contains(ks, c))) = len(cs)
      THEN array_to_string(list_filter(cs, lambda c, i: list_position(cs, c) = i), '') ELSE '' END AS ans FROM keyed),
judged AS (
  SELECT *, CASE WHEN q = '' THEN 'missing_question' WHEN no_map THEN 'option_not_dict' WHEN len(opts) < 3 THEN 'options_too_few' WHEN raw = '' THEN 'missing_answer'
    WHEN ans = '' THEN 'invalid_answer'
    WHEN len(list_filter(string_split(ans, ''), lambda c: coalesce(list_filter(opts, lambda e: e.key = c)[1].value, '') = '')) > 0 THEN 'empty_correct_option'
    WHEN {count('q', '[�' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B-' + chr(92) + 'x1F]')} / length(q)::DOUBLE > 0.02 THEN 'garbled_question' WHEN length(q) > 800 THEN 'question_too_long'
    WHEN {count('q', SPECIAL)} / length(q)::DOUBLE > 0.60 AND length(q) > 20 THEN 'special_ratio_too_high' END AS reason,
    sha1({comparison('q', False)} || '||' || array_to_string(list_transform(opts, lambda e: {comparison('e.key', False)} || '=' || {comparison('e.value', False)}), '|')) AS sig
  FROM answered),
firsts AS (SELECT sig, min(item_id) AS keep FROM judged WHERE reason IS NULL GROUP BY sig),
final AS (SELECT j.*, CASE WHEN reason IS NULL AND item_id <> keep THEN 'duplicate_normalized_question_options' ELSE reason END AS reject_reason FROM judged j LEFT JOIN firsts USING (sig))
"""

_DIFFICULTY = f"""
SELECT item_id, CASE WHEN hard >= 3 OR dense >= 3 THEN 'hard' WHEN easy >= 2 AND hard = 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM (
  SELECT item_id, {hits(QUESTION, scoring.HARD_WORDS)} + contains(coalesce(question_type, ''), '多选')::INT + (length({QUESTION}) > 80)::INT AS hard,
    {hits(QUESTION, scoring.EASY_WORDS)} + (length({QUESTION}) < 30)::INT AS easy, {' + '.join(count(QUESTION, p) for p in scoring.DENSE_TERMS)} AS dense
  FROM exam_item)
"""

_LENGTHS = f"list_transform(coalesce(map_values(options), []), lambda v: length({strip('v')}))"
_QUALITY = f"""
SELECT item_id, round_even(least(1.0,
  CASE WHEN n BETWEEN 30 AND 200 THEN 0.2 WHEN n >= 15 AND n < 30 THEN 0.1 WHEN n > 10 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN k = 5 THEN 0.2 WHEN k = 4 THEN 0.15 WHEN k >= 3 THEN 0.05 ELSE 0 END::DOUBLE
  + CASE WHEN len(ls) > 0 AND list_min(ls) > 2 THEN CASE WHEN list_avg(ls) BETWEEN 5 AND 30 THEN 0.2 WHEN list_avg(ls) > 2 THEN 0.1 ELSE 0 END ELSE 0 END::DOUBLE
  + CASE WHEN terms >= 4 THEN 0.2 WHEN terms >= 2 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN multi THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN doctor THEN 0.15 ELSE 0 END::DOUBLE), 6) AS quality
FROM (SELECT item_id, length({QUESTION}) AS n, coalesce(cardinality(options), 0) AS k, {_LENGTHS} AS ls, {count(QUESTION, '[一-鿿]{2,}')} AS terms,
  contains(coalesce(question_type, ''), '多选') AS multi, contains(coalesce(exam_type, ''), '医师考试') AS doctor FROM exam_item)
"""

_KEEPER = f"""
SELECT item_id, round_even(CASE WHEN n BETWEEN 10 AND 200 THEN 0.4 WHEN n BETWEEN 5 AND 400 THEN 0.2 ELSE 0 END::DOUBLE + least(k, 5) / 5.0::DOUBLE * 0.4 + CASE WHEN a <> '' THEN 0.2 ELSE 0 END::DOUBLE, 6) AS quality
FROM (SELECT item_id, length({QUESTION}) AS n, len(list_filter({_LENGTHS}, lambda x: x > 0)) AS k, {strip("coalesce(answer, '')")} AS a FROM exam_item)
"""

_PAIRS = "list_distinct(list_transform(range(1, greatest(length(o), 2)), lambda i: substr(o, i, 2)))"
_REASONING = f"""
WITH base AS (
  SELECT item_id, length(question) AS n_raw, question_type, answer, {strip(nf(QUESTION))} AS q,
    list_filter(list_transform(coalesce(map_values(options), []), lambda v: {comparison('v')}), lambda v: v <> '') AS os FROM exam_item),
sets AS (SELECT *, list_transform(os, lambda o: length(o)) AS ls, list_transform(os, lambda o: {_PAIRS}) AS bs FROM base),
pairs AS (
  SELECT *, flatten(list_transform(range(1, len(bs) + 1), lambda i: list_transform(range(i + 1, len(bs) + 1), lambda j: len(list_intersect(bs[i], bs[j])) / len(list_distinct(list_concat(bs[i], bs[j])))::DOUBLE))) AS js,
    CASE WHEN len(ls) > 1 THEN sqrt(list_avg(list_transform(ls, lambda x: (x - list_avg(ls)) ** 2))) / list_avg(ls) ELSE 0.0 END AS cv FROM sets),
feats AS (
  SELECT *, coalesce(list_avg(js), 0.0) AS overlap, list_sort(list_filter([{', '.join(f"CASE WHEN {matches('q', p)} THEN {_q(n)} END" for n, p in scoring.CASE_PATTERNS.items())}], lambda x: x IS NOT NULL)) AS cats,
    CASE WHEN {matches('q', scoring.STRONG_DEFINITIONS)} THEN 'strong' WHEN {matches('q', scoring.WEAK_DEFINITIONS)} THEN 'weak' ELSE 'none' END AS definition_level,
    contains(coalesce(question_type, ''), '多项选择题') OR length(upper({strip("coalesce(answer, '')")})) > 1 AS is_multi_choice FROM pairs),
more AS (
  SELECT *, CASE len(cats) WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END::DOUBLE AS case_info_score,
    CASE WHEN len(os) = 0 THEN 0.0 WHEN cv <= 0.15 THEN 0.8 WHEN cv <= 0.30 THEN 0.4 ELSE 0.0 END::DOUBLE AS balance, CASE WHEN overlap >= 0.30 THEN 0.8 WHEN overlap >= 0.15 THEN 0.4 ELSE 0.0 END::DOUBLE AS alike FROM feats),
flagged AS (
  SELECT *, list_filter([CASE WHEN length({comparison('q', False)}) < 20 THEN 'short_question' END, CASE WHEN case_info_score = 0 THEN 'no_case_info' END,
    CASE WHEN {matches('q', scoring.RECALL_TEMPLATES)} THEN 'recall_template' END], lambda x: x IS NOT NULL) AS flags FROM more),
scored AS (
  SELECT *, round_even(balance + alike, 6) AS confusion, CASE definition_level WHEN 'strong' THEN 1.0 WHEN 'weak' THEN 0.3 ELSE 0.0 END::DOUBLE AS definition_penalty,
    CASE WHEN len(flags) >= 3 THEN 1.0 WHEN len(flags) = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS low_reasoning_penalty FROM flagged),
final AS (SELECT *, round_even(CASE WHEN is_multi_choice THEN 2.0 ELSE 0.0 END::DOUBLE + case_info_score + confusion - definition_penalty - low_reasoning_penalty, 6) AS reasoning_score FROM scored)
"""
_CLASSED = _REASONING + ", classed AS (SELECT item_id, CASE WHEN reasoning_score <= -0.1 THEN 'easy' WHEN reasoning_score <= 0.9 THEN 'medium' ELSE 'hard' END AS class FROM final)"


def _hash(seed: str, key: str) -> str:
    return f"substr(sha1('{seed}:' || {key}), 1, 16)"


def quota(source: str, bucket: str, quotas: dict[str, int], most: int, seed: str) -> str:
    plan = ", ".join(f"({i}, {_q(b)}, {n})" for i, (b, n) in enumerate(quotas.items()))
    return f"""
    , plan(o, b, n) AS (VALUES {plan}),
    have AS (SELECT o, b, least(n, coalesce((SELECT count(*) FROM {source} s WHERE s.{bucket} = plan.b), 0)) AS n FROM plan),
    capped AS (SELECT b, greatest(0, least(n, {most} - coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM have),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {bucket} ORDER BY {_hash(seed, 'item_id')}, item_id) AS rn FROM {source})
    SELECT item_id, {bucket} FROM ranked JOIN capped ON b = {bucket} WHERE rn <= n
    """


_VALID = "CASE WHEN len(valid_options) > 0 THEN list_transform(valid_options, lambda v: upper(trim(v))) ELSE string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ', '') END"


def letters(x: str, valid: str | None = _VALID) -> str:
    allowed = "" if valid is None else f" AND list_contains({valid}, c)"
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split(upper(coalesce({x}, '')), ''), lambda c: c BETWEEN 'A' AND 'Z' AND length(c) = 1{allowed}))), '')"


_BODY = "coalesce(completion, '')"
_LABELLED = r"答案\s*[:：]\s*([^\n\r]*)"
_LETTERS_LABEL = r"答案\s*[:：]\s*([A-Za-z,\s，、/]+)"
_LINES = f"list_filter(list_transform(regexp_split_to_array(body, '\\r\\n|\\r|\\n'), lambda x: {strip('x')}), lambda x: x <> '')"
_EXTRACT = f"""
WITH base AS (SELECT *, {strip(_BODY)} AS body FROM choice_reward),
found AS (SELECT *, regexp_extract_all(body, {_q(_LABELLED)}, 1) AS caps, coalesce({_LINES}[-1], '') AS last FROM base),
x AS (
  SELECT *, CASE WHEN body = '' THEN 0 ELSE len(caps) END AS label_count, len(caps) = 0 AND last <> '' AND length(last) <= 32 AS fallback_x,
    CASE WHEN len(caps) > 0 THEN {letters('caps[-1]')} WHEN last <> '' AND length(last) <= 32 THEN {letters('last')} ELSE '' END AS pred_x,
    CASE WHEN len(caps) = 0 THEN false ELSE {matches("CASE WHEN regexp_matches(caps[-1], '[A-Za-z]') THEN regexp_replace(caps[-1], '^.*[A-Za-z]', '') ELSE caps[-1] END || regexp_replace(body, '(?s)^.*答案\\s*[:：]\\s*[^\\n\\r]*', '')", "[一-鿿A-Za-z0-9]")} END AS extra_x,
    {letters('gold')} AS gold_x FROM found)
"""
_SETS = """(SELECT *, CASE WHEN p = '' THEN [] ELSE list_distinct(string_split(p, '')) END AS ps, CASE WHEN g = '' THEN [] ELSE list_distinct(string_split(g, '')) END AS gs FROM ({0}))"""


def measured(inner: str) -> str:
    """Measures of p against g, both strings of letters."""
    return f"""(SELECT *, CASE WHEN len(ps) > 0 AND len(gs) > 0 THEN len(list_intersect(ps, gs)) / len(ps)::DOUBLE ELSE 0.0 END AS prec,
      CASE WHEN len(ps) > 0 AND len(gs) > 0 THEN len(list_intersect(ps, gs)) / len(gs)::DOUBLE ELSE 0.0 END AS rec,
      len(list_filter(ps, lambda c: NOT list_contains(gs, c))) AS extra_n, len(list_filter(gs, lambda c: NOT list_contains(ps, c))) AS missing_n FROM {_SETS.format(inner)})"""


_BEFORE = strip(f"CASE WHEN regexp_matches({_BODY}, '答案\\s*[:：]') THEN regexp_extract({_BODY}, '(?s)^(.*)答案\\s*[:：]', 1) ELSE {_BODY} END")
_REPEATS = f"""len(list_filter(range(1, length({_BODY}) + 1), lambda i: len(list_filter(range(2, 13), lambda n: length(substr({_BODY}, i, n)) = n AND substr({_BODY}, i, n) = substr({_BODY}, i + n, n)
  AND substr({_BODY}, i, n) = substr({_BODY}, i + 2 * n, n) AND regexp_full_match(substr({_BODY}, i, n), '[一-鿿A-Za-z0-9]+'))) > 0)) > 0"""
_LEVEL = f"CASE WHEN lower({strip(chr(99) + 'oalesce(difficulty, ' + chr(39) * 2 + ')')}) IN ('direct', 'brief', 'cot') THEN lower({strip(chr(99) + 'oalesce(difficulty, ' + chr(39) * 2 + ')')}) ELSE 'brief' END"
_ADAPTIVE = f"""{_EXTRACT},
parts AS (SELECT *, pred_x <> '' AS ok, pred_x <> '' AND pred_x = gold_x AS exact, {_LEVEL} AS level, length({_BODY}) AS n_chars, {count(_BODY, _HAN)} AS n_han, {_BEFORE} AS r, {_REPEATS} AS reps
  FROM {measured('SELECT *, pred_x AS p, gold_x AS g FROM x')}),
seen AS (SELECT *, {count('r', _HAN)} AS h, {matches('r', rewards.ANALYSIS_LABEL)} AS lab, {count('r', rewards.REASONING_WORDS)} AS marks,
  CASE WHEN ok THEN extra_n ELSE 0 END AS ex, CASE WHEN ok THEN missing_n ELSE length(gold_x) END AS mi FROM parts),
reasoned AS (SELECT *, CASE level
  WHEN 'direct' THEN CASE WHEN h = 0 THEN 0.25 WHEN h <= 16 THEN 0.10 ELSE -least(0.60, 0.12::DOUBLE + 0.01::DOUBLE * (h - 16)) END::DOUBLE + CASE WHEN lab THEN -0.20 ELSE 0 END::DOUBLE + CASE WHEN marks >= 2 THEN -0.15 ELSE 0 END::DOUBLE
  WHEN 'brief' THEN CASE WHEN h BETWEEN 8 AND 80 THEN 0.35 WHEN h = 0 THEN -0.20 WHEN h > 120 THEN -least(0.50, 0.10::DOUBLE + 0.004::DOUBLE * (h - 120)) ELSE 0 END::DOUBLE + CASE WHEN lab THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN marks >= 1 THEN 0.15 ELSE 0 END::DOUBLE
  ELSE CASE WHEN h BETWEEN 40 AND 260 THEN 0.45 WHEN h < 20 THEN -0.45 WHEN h > 360 THEN -least(0.70, 0.15::DOUBLE + 0.002::DOUBLE * (h - 360)) ELSE 0 END::DOUBLE + CASE WHEN lab THEN 0.25 ELSE -0.10 END::DOUBLE + least(0.30, 0.10::DOUBLE * marks) END
  + CASE WHEN reps THEN -0.25 ELSE 0 END::DOUBLE AS rr FROM seen)
SELECT reward_id, pred_x AS pred, level, round_even(rr, 6) AS reasoning_reward, round_even(CASE WHEN ok THEN 0.2 ELSE -1.0 END::DOUBLE + CASE WHEN exact THEN 2.0 ELSE 0 END::DOUBLE
  + CASE WHEN (level = 'direct' AND (n_han > 40 OR n_chars > 80)) OR (level = 'brief' AND (n_han > 140 OR n_chars > 260)) OR (level = 'cot' AND (n_han > 420 OR n_chars > 780)) THEN -0.3 ELSE 0 END::DOUBLE
  + CASE WHEN extra_x THEN -0.3 ELSE 0 END::DOUBLE + 0.8::DOUBLE * prec + 0.2::DOUBLE * rec - 0.7::DOUBLE * ex - 0.2::DOUBLE * mi
  + CASE label_count WHEN 1 THEN 0.2 WHEN 0 THEN -0.3 ELSE -0.5 END::DOUBLE + rr, 6) AS reward, logged_at FROM reasoned
"""
_V1 = f"""{_EXTRACT},
v1 AS (SELECT *, regexp_extract_all({_BODY}, {_q(_LETTERS_LABEL)}, 1) AS c1 FROM x),
p1 AS (SELECT *, CASE WHEN len(c1) > 0 THEN {letters('c1[-1]')} WHEN last <> '' AND length(last) <= 32 THEN {letters('last')} ELSE '' END AS p, gold_x AS g FROM v1),
m1 AS (SELECT *, p <> '' AS ok, p <> '' AND p = g AS exact, CASE WHEN p <> '' THEN extra_n ELSE 0 END AS ex, CASE WHEN p <> '' THEN missing_n ELSE length(g) END AS mi FROM {measured('SELECT * FROM p1')})
"""

_LAST_REWARD = f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY reward_id ORDER BY logged_at DESC) AS rn FROM choice_reward) WHERE rn = 1)"
_LETTERED = f"(SELECT *, {letters('pred', None)} AS p, {letters('gold', None)} AS g FROM {_LAST_REWARD})"


def micro(by: str, name: str, source: str) -> str:
    return f"""SELECT {name}, n, round_even(h / nullif(np, 0)::DOUBLE, 6) AS option_precision, round_even(h / nullif(ng, 0)::DOUBLE, 6) AS option_recall,
      round_even(2 * (h / nullif(np, 0)::DOUBLE) * (h / nullif(ng, 0)::DOUBLE) / nullif(h / nullif(np, 0)::DOUBLE + h / nullif(ng, 0)::DOUBLE, 0), 6) AS option_f1,
      round_even(em, 6) AS exact_rate, round_even(er, 6) AS extra_rate, round_even(mr, 6) AS missing_rate
    FROM (SELECT {by} AS {name}, count(*) AS n, sum(length(g) - missing_n) AS h, sum(length(p)) AS np, sum(length(g)) AS ng, avg((p = g)::INT) AS em, avg((extra_n > 0)::INT) AS er, avg((missing_n > 0)::INT) AS mr
      FROM {measured(f'SELECT * FROM {source}')} GROUP BY 1)"""


def quantiles(source: str, value: str, points, by: str = "") -> str:
    ps = ", ".join(f"round_even(quantile_cont(v::DOUBLE, {p}), 6) AS p{round(p * 100)}" for p in points)
    head, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {head}count(*) AS n, min(v) AS least, max(v) AS greatest, round_even(avg(v::DOUBLE), 6) AS mean, {ps} FROM (SELECT *, {value} AS v FROM {source}) WHERE v IS NOT NULL{group}"


def field_counts(table: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(CAST({c} AS VARCHAR), 'unknown') AS value, count(*) AS n FROM {table} GROUP BY 2" for c in columns)


_LAST_EVAL = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY logged_at DESC) AS rn FROM eval_result) WHERE rn = 1)"
_WORDS = "list_distinct(regexp_extract_all(regexp_replace(coalesce({0}, ''), '[可能大小疑似倾向考虑不除外（）()]', '', 'g'), '[一-鿿]{{2,}}'))"


def words(x: str) -> str:
    return _WORDS.format(x)


def diag(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{_WS[:-1]}.,，。()（）、]', '', 'g')"


def names(x: str) -> str:
    parts = f"flatten(list_transform(coalesce({x}, []), lambda d: regexp_split_to_array(coalesce(d, ''), '[，,、\\n]')))"
    cut = f"list_transform({parts}, lambda p: regexp_replace(regexp_replace(p, '(?s)[：（】\\[].*$', ''), '{_WS[:-1]}。]', '', 'g'))"
    return f"list_distinct(list_filter({cut}, lambda n: length(n) >= 2))"


def risks(x: str) -> str:
    hit = ", ".join(f"CASE WHEN {hits('r', w)} > 0 THEN {_q(k)} END" for k, w in evaluation.RISK_WORDS.items())
    return f"flatten(list_transform(coalesce({x}, []), lambda r: CASE WHEN len(list_filter([{hit}], lambda k: k IS NOT NULL)) > 0 THEN list_filter([{hit}], lambda k: k IS NOT NULL) ELSE [{_q(evaluation.OTHER_RISK)}] END))"


def _field(name: str, aliases, kind: str) -> str:
    def one(a: str) -> str:
        at = f"json_extract(j, '$.\"{a}\"')"
        if kind == "string":
            return f"CASE WHEN json_type({at}) IN ('VARCHAR') THEN j->>'$.\"{a}\"' WHEN json_type({at}) IS NOT NULL AND json_type({at}) <> 'NULL' THEN CAST({at} AS VARCHAR) END"
        return f"CASE WHEN json_type({at}) = 'ARRAY' THEN CAST({at} AS VARCHAR[]) END"

    return "coalesce(" + ", ".join(one(a) for a in aliases) + f") AS f_{name}"


FIELD_NAMES = {
    "primary_diagnosis": "主诊断 主要诊断 primary_diagnosis".split(), "diagnostic_basis": "诊断依据 diagnostic_basis".split(), "differential_diagnoses": "鉴别诊断 differential_diagnoses".split(),
    "recommended_actions": "下一步建议 recommended_actions 建议 处理建议".split(), "risk_flags": "风险提示 risk_flags 注意事项".split(),
}

_UNFENCED = strip(f"regexp_replace(regexp_replace({strip(chr(99) + 'oalesce(raw_output, ' + chr(39) * 2 + ')')}, '(?m)^```(?:json)?', '', 'g'), '(?m)```$', '', 'g')")


def _valid(x: str) -> str:
    """Strict JSON: this engine would forgive a comma before a closing bracket."""
    return f"(json_valid({x}) AND NOT regexp_matches({x}, ',{chr(92)}s*[}}{chr(92)}]]'))"


_COUNT_KIND = "len(list_filter({0}, lambda x: x = {1}))"
_EVAL = f"""
WITH texts AS (SELECT *, {strip(chr(99) + 'oalesce(raw_output, ' + chr(39) * 2 + ')')} AS whole, {_UNFENCED} AS body FROM {_LAST_EVAL}),
tries AS (SELECT *, CASE WHEN whole <> '' AND {_valid('whole')} THEN whole WHEN contains(body, '{{') AND {_valid("substr(body, strpos(body, '{'))").replace('{', '{')} THEN substr(body, strpos(body, '{{'))
   WHEN body <> '' AND json_valid(regexp_replace(body, ',\\s*([}}\\]])', '\\1', 'g')) THEN regexp_replace(body, ',\\s*([}}\\]])', '\\1', 'g') END AS jt FROM texts),
parsed AS (SELECT *, CAST(jt AS JSON) AS j FROM tries),
fields AS (SELECT *, {', '.join(_field(n, a, 'string' if n == 'primary_diagnosis' else 'list') for n, a in FIELD_NAMES.items())} FROM parsed),
m AS (SELECT *, jt IS NOT NULL AS parsed_ok, list_filter([{', '.join(f"CASE WHEN f_{n} IS NULL THEN '{n}' END" for n in FIELD_NAMES)}], lambda x: x IS NOT NULL) AS miss FROM fields),
n AS (SELECT *, parsed_ok AND len(miss) = 0 AS ok, {diag('f_primary_diagnosis')} AS pd, {diag('ground_truth.primary_diagnosis')} AS gd, {words('f_primary_diagnosis')} AS pw, {words('ground_truth.primary_diagnosis')} AS gw,
   {names('f_differential_diagnoses')} AS pn, {names('ground_truth.differential_diagnoses')} AS gn, {risks('f_risk_flags')} AS pr, {risks('ground_truth.risk_flags')} AS gr FROM m),
scored AS (SELECT *,
   CASE WHEN NOT ok OR coalesce(f_primary_diagnosis, '') = '' OR coalesce(ground_truth.primary_diagnosis, '') = '' THEN 0.0 WHEN pd = gd THEN 1.0 WHEN contains(pd, gd) OR contains(gd, pd) THEN 0.8
     WHEN len(list_intersect(pw, gw)) > 0 THEN greatest(len(list_intersect(pw, gw)) / len(gw)::DOUBLE, 0.3) ELSE 0.0 END::DOUBLE AS ds,
   CASE WHEN ok THEN len(list_filter(gn, lambda g: len({words('g')}) = 0 OR len(list_filter(pn, lambda p: len(list_intersect({words('p')}, {words('g')})) > 0 OR contains({diag('p')}, {diag('g')}))) > 0)) ELSE 0 END AS dc, CASE WHEN ok THEN len(gn) ELSE 0 END AS dt,
   CASE WHEN ok THEN {' + '.join(f"least({_COUNT_KIND.format('pr', _q(k))}, {_COUNT_KIND.format('gr', _q(k))})" for k in (*evaluation.RISK_WORDS, evaluation.OTHER_RISK))} ELSE 0 END AS rc, CASE WHEN ok THEN len(gr) ELSE 0 END AS rt,
   ok AND {matches("coalesce(raw_output, '')", evaluation.ASSERTIVE)} AND NOT {matches("coalesce(raw_output, '')", evaluation.HEDGING)} AS oc,
   CASE WHEN ok THEN (length(f_primary_diagnosis) > 0)::INT + {' + '.join(f"(len(f_{n}) > 0)::INT" for n in list(FIELD_NAMES)[1:])} ELSE 0 END AS cf FROM n),
final AS (SELECT *, CASE WHEN NOT parsed_ok THEN 'parse_error' WHEN NOT ok THEN 'missing_fields' WHEN oc THEN 'overconfidence' WHEN dt > 0 AND dc / dt::DOUBLE < 0.5 THEN 'low_diff_coverage'
   WHEN rt > 0 AND rc / rt::DOUBLE < 0.3 THEN 'low_risk_recall' WHEN ds < 0.7 AND coalesce(ground_truth.primary_diagnosis, '') <> '' THEN 'incorrect_primary_diagnosis' END AS error FROM scored)
"""


def eval_rates(level: str, key: str, source: str = "final", group: str = "") -> str:
    return f"""SELECT {level} AS level, {key} AS key, count(*) AS total, round_even(avg(ok::INT), 6) AS compliance_rate, round_even(avg(oc::INT), 6) AS overconfidence_rate,
      round_even(coalesce(sum(dc) / nullif(sum(dt), 0)::DOUBLE, 0.0), 6) AS diff_coverage_rate, round_even(coalesce(sum(rc) / nullif(sum(rt), 0)::DOUBLE, 0.0), 6) AS risk_recall_rate,
      round_even(avg((ds >= 0.7)::INT), 6) AS top1_accuracy, round_even(avg((ds >= 0.4)::INT), 6) AS top3_accuracy, round_even(avg(cf / 5.0::DOUBLE), 6) AS completeness,
      round_even(avg(length(coalesce(raw_output, ''))), 6) AS avg_length FROM {source} {group}"""


TEXT = "coalesce(text, '')"
_FLAGS = f"""list_filter([CASE WHEN length({TEXT}) < 12 THEN 'too_short' END, CASE WHEN contains({TEXT}, '�') THEN 'has_replacement_character' END,
  CASE WHEN {matches(TEXT, '图片|照片|片子|报告单|上传')} THEN 'may_depend_on_image_or_attachment' END, CASE WHEN {matches(TEXT, '自杀|去死|不想活|生不如死')} THEN 'safety_boundary_signal' END,
  CASE WHEN length({TEXT}) < 40 AND {matches(TEXT, '怎么办|严重吗|吃什么药|用法用量|简介|是什么')} THEN 'generic_medical_qa' END,
  CASE WHEN NOT {matches(TEXT, '患者|病人|主诉|现病史|体格检查|辅助检查|发热|疼痛|咳|呕吐|腹|胸|头痛')} THEN 'weak_case_context' END], lambda x: x IS NOT NULL)"""
_LENGTH_SCORE = f"CASE WHEN length({TEXT}) <= 0 THEN 0.0 WHEN length({TEXT}) < 40 THEN length({TEXT}) / 80.0 WHEN length({TEXT}) <= 1200 THEN 1.0 WHEN length({TEXT}) <= 2500 THEN 0.85 ELSE 0.65 END::DOUBLE"
_FLAG_SUM = " + ".join(f"CASE WHEN list_contains(fl, '{k}') THEN {v} ELSE 0 END::DOUBLE" for k, v in scoring.FLAG_PENALTIES.items())
_DEPARTMENT_WORDS = """呼吸 肺炎,支气管,肺,呼吸道,咳嗽,咳痰,咯血,哮喘,COPD,慢阻肺,气胸,胸腔,肺栓塞,胸水,胸痛,呼吸,肺结核,肺癌,肺脓肿,ARDS,肺水肿,脓胸,流感
消化 胃,肠,肝,胆,胰腺,食管,消化道,胃肠,肝功能,黄疸,腹水,腹胀,腹痛,恶心,呕吐,呕血,黑便,消化性溃疡,胃炎,肝炎,肝硬化,胆囊炎,阑尾,结肠,痢疾,胃肠炎,胰腺炎,胃潴留,幽门,肠梗阻,短肠,肠易激
心血管 心,血压,冠心病,心肌,心电图,心律,心衰,心梗,主动脉,心脏,心包,瓣膜,高血压,低血压,胸闷,心悸,动脉,血管,夹层,心绞痛,心源性,嗜铬细胞瘤,心肌炎,心包炎,肺动脉,先心病
神经 脑,神经,意识,头痛,头晕,癫痫,脑卒中,脑血管,偏瘫,肢体,麻木,语言,面瘫,帕金森,痴呆,脑炎,脑梗,脑出血,颅内,眩晕,晕厥,谵妄,昏迷,脊髓
内分泌 糖尿病,甲亢,甲减,甲状腺,内分泌,血糖,胰岛素,皮质醇,肾上腺,垂体,尿糖,酮症,高血糖,低血糖,骨质,肥胖,代谢,激素,醛固酮,肾素,多囊,痛风
急诊 休克,昏迷,中毒,创伤,急腹症,大出血,呼吸困难,心肺复苏,急诊,急性,危象,脓毒症,多器官,DIC,急性冠脉,急性胰腺,急性阑尾,宫外孕"""
_DEPARTMENT = (
    "(SELECT doc_id, CASE WHEN best.n > 0 THEN best.name END AS department FROM (SELECT doc_id, list_reverse_sort(["
    + ", ".join(f"{{'n': {hits(TEXT, line.split()[1].split(','))}, 'o': {-i}, 'name': '{line.split()[0]}'}}" for i, line in enumerate(_DEPARTMENT_WORDS.splitlines()))
    + "])[1] AS best FROM documents))"
)
_TURNS = f"list_filter(string_split({TEXT}, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:患者|医生)\\s*[:：]'))"
_SPOKEN = f"(SELECT doc_id, list_transform({_TURNS}, lambda x: CASE WHEN regexp_matches(x, '^\\s*患者') THEN 'human' ELSE 'gpt' END) AS r FROM documents WHERE doc_type = 'dialogue')"

_ASKED = """'请回答以下医学考试题，直接给出答案选项，不需要解释。' || chr(10) || chr(10) || '题目：' || coalesce(question, '') || chr(10) || chr(10) || '选项：' || chr(10) || """
_RENDERED = "coalesce(array_to_string(list_transform(list_sort(map_entries(options)), lambda e: e.key || '. ' || coalesce(e.value, '')), chr(10)), '')"
_TERMS = """list_concat(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '{1}+', '', 'g'), '[一-鿿]{{2,}}'),
  lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"""
_KEYS = "list_transform(coalesce(map_keys(options), []), lambda k: upper(trim(k)))"


def without_hedges(x: str) -> str:
    out = f"coalesce({x}, '')"
    for hedge in DIAGNOSIS_HEDGES:
        out = f"replace({out}, '{hedge}', '')"
    return no_space(out)


_TARGET_CHECKS = (("diagnostic_basis", 2, "too_short"), ("differential_diagnoses", 1, "empty"), ("recommended_actions", 1, "empty"), ("risk_flags", 1, "empty"))


def _target_errors(target: str) -> str:
    checks = [f"CASE WHEN {strip(f"coalesce({target}.primary_diagnosis, '')")} = '' THEN 'primary_diagnosis_empty' END"]
    for f, n, error in _TARGET_CHECKS:
        items = f"coalesce({target}.{f}, [])"
        checks.append(f"CASE WHEN len({items}) < {n} OR len(list_filter({items}, lambda x: {strip("coalesce(x, '')")} = '')) > 0 THEN '{f}_{error}' END")
    return f"CASE WHEN {target} IS NULL THEN 'schema_target_not_object' ELSE array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), ',') END"


_TARGET_ERRORS = f"""SELECT eval_id, {_target_errors('ground_truth')} AS errors,
  {without_hedges('ground_truth.primary_diagnosis')} <> '' AND list_contains(list_transform(coalesce(ground_truth.differential_diagnoses, []), lambda d: {without_hedges('d')}), {without_hedges('ground_truth.primary_diagnosis')}) AS repeats_diagnosis, logged_at FROM eval_result"""


def _windows(width: str, step: str, by: str) -> str:
    return f"""SELECT w AS "start", w + INTERVAL {width} AS "end", {by}, count(*) AS n, round_even(sum(value), 4) AS total FROM (
      SELECT *, unnest(range(time_bucket(INTERVAL {step}, ts, TIMESTAMP '1970-01-01') - INTERVAL {width} + INTERVAL {step}, time_bucket(INTERVAL {step}, ts, TIMESTAMP '1970-01-01') + INTERVAL {step}, INTERVAL {step})) AS w FROM events)
      GROUP BY 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    cmp_q = comparison("question")
    return {
        "clean_reject_reasons": _CLEAN + "SELECT coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS n FROM final GROUP BY 1",
        "clean_accepted_share": _CLEAN + "SELECT count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason IS NOT NULL) AS rejected, round_even(100.0::DOUBLE * count(*) FILTER (reject_reason IS NULL) / count(*), 4) AS accepted_pct FROM final",
        "clean_flag_counts": _CLEAN + """SELECT value, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(q) < 5 THEN 'short_question_retained' END,
          CASE WHEN len(list_filter(opts, lambda e: e.value = '' AND NOT contains(ans, e.key))) > 0 THEN 'empty_non_answer_option_retained' END], lambda x: x IS NOT NULL)) AS value FROM judged WHERE reason IS NULL) GROUP BY 1""",
        "duplicate_signatures": _CLEAN + "SELECT min(item_id) AS first_id, count(*) AS n FROM judged WHERE reason IS NULL GROUP BY sig HAVING count(*) > 1",
        "char_ratios": f"""SELECT item_id, round_even({_ratio('[�' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B-' + chr(92) + 'x1F]')}, 6) AS garbled, round_even({_ratio(SPECIAL)}, 6) AS special, round_even({_ratio('[A-Za-z0-9]')}, 6) AS ascii,
          contains({QUESTION}, '�') OR {_ratio('[A-Za-z0-9]')} > 0.6 AS noisy, {count(QUESTION, _HAN)}::INT AS ideographs, length({no_space(QUESTION)})::INT AS visible_chars FROM exam_item""",
        "duplicate_questions": f"SELECT min(item_id) AS first_id, count(*) AS n, count(DISTINCT upper({strip(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')})) AS n_answers FROM (SELECT *, {cmp_q} AS sig FROM exam_item) GROUP BY sig HAVING count(*) > 1",
        "best_of_duplicates": f"""WITH k AS (SELECT item_id, {cmp_q} AS sig, length({QUESTION}) AS n FROM exam_item), s AS ({_KEEPER}),
          r AS (SELECT item_id, first_value(item_id) OVER (PARTITION BY sig ORDER BY quality DESC, n DESC, item_id) AS kept_id FROM k JOIN s USING (item_id)) SELECT item_id, kept_id, item_id = kept_id AS is_kept FROM r""",
        "exam_difficulty": _DIFFICULTY,
        "exam_quality": _QUALITY,
        "keeper_quality": _KEEPER,
        "quality_bins": f"SELECT CASE WHEN quality >= 0.7 THEN 'high' WHEN quality >= 0.4 THEN 'medium' ELSE 'low' END AS bin, count(*) AS n FROM ({_QUALITY}) GROUP BY 1",
        "reasoning_features": _REASONING + """SELECT item_id, is_multi_choice, case_info_score, array_to_string(cats, ',') AS categories, round_even(cv, 6) AS option_length_cv, balance AS option_length_balance_score,
          round_even(overlap, 6) AS option_avg_bigram_jaccard, alike AS option_bigram_overlap_score, confusion AS option_confusion_score, definition_level, definition_penalty, array_to_string(flags, ',') AS low_flags, low_reasoning_penalty, reasoning_score FROM final""",
        "reasoning_top": _REASONING + "SELECT item_id, reasoning_score, n_raw::INT AS n, (row_number() OVER (ORDER BY reasoning_score DESC, n_raw DESC, item_id))::INT AS rank FROM final QUALIFY rank <= 100",
        "reasoning_ranked": _REASONING + "SELECT item_id, row_number() OVER (ORDER BY reasoning_score DESC, n_raw DESC, item_id) AS rank FROM final",
        "reasoning_percentiles": _REASONING + quantiles("final", "reasoning_score", (0.25, 0.5, 0.75, 0.9)),
        "reasoning_classes": _CLASSED + "SELECT class, count(*) AS n FROM classed GROUP BY 1",
        "balanced_sample": _CLASSED + quota("classed", "class", exam.CLASS_QUOTAS, 800, "balanced"),
        "stratified_sample": f"WITH d AS ({_DIFFICULTY}), got AS (SELECT count(*) FILTER (difficulty = 'hard') AS h, count(*) FILTER (difficulty = 'medium') AS m, count(*) FILTER (difficulty = 'easy') AS e FROM d), want AS (SELECT least(150, h) AS h, least(250, m) AS m, least(500 - least(150, h) - least(250, m), e) AS e FROM got), "
        + f"r AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY {_hash('strata', 'item_id')}, item_id) AS rn FROM d) SELECT item_id, difficulty FROM r, want WHERE rn <= CASE difficulty WHEN 'hard' THEN h WHEN 'medium' THEN m ELSE e END",
        "answer_bucket_sample": f"WITH a AS (SELECT item_id, {letters('answer', _KEYS)} AS l FROM exam_item WHERE len(coalesce(map_keys(options), [])) > 0 UNION ALL SELECT item_id, {letters('answer', None)} FROM exam_item WHERE len(coalesce(map_keys(options), [])) = 0), b AS (SELECT item_id, CASE WHEN length(l) = 1 THEN 'single' ELSE 'multi_' || length(l) END AS bucket FROM a WHERE l <> '')"
        + quota("b", "bucket", {"single": 400, "multi_2": 100, "multi_3": 100, "multi_4": 50, "multi_5": 50}, 600, "bucket"),
        "hash_sample": f"SELECT item_id FROM exam_item ORDER BY CASE WHEN split = 'val' THEN 0 ELSE 1 END, {_hash('sample', 'item_id')}, item_id LIMIT 400",
        "first_per_source": "SELECT item_id, source, exam_type, (row_number() OVER (PARTITION BY source, exam_type ORDER BY item_id))::INT AS rn FROM exam_item QUALIFY rn <= 5",
        "round_robin": "SELECT item_id, exam_type, (row_number() OVER (ORDER BY rn, place))::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY exam_type ORDER BY item_id) AS rn, list_position(['医师考试', '药师考试', '护理考试', '医技考试'], exam_type) AS place FROM exam_item WHERE exam_type IN ('医师考试', '药师考试', '护理考试', '医技考试')) QUALIFY position <= 101",
        "sliced": "SELECT * FROM (SELECT * FROM (SELECT item_id, length(question)::INT AS n FROM exam_item WHERE length(question) >= 40 ORDER BY n DESC, item_id LIMIT 500) ORDER BY n DESC, item_id OFFSET 50) ORDER BY n DESC, item_id LIMIT 100",
        "positional_ids": "SELECT item_id, 'item_' || lpad((row_number() OVER (ORDER BY item_id) - 1)::VARCHAR, 6, '0') AS sample_id FROM exam_item WHERE cardinality(options) >= 3",
        "split_by_share": f"SELECT item_id, CASE WHEN substr({_hash('split', 'item_id')}, 1, 8) < '{int(0.1 * 16**8):08x}' THEN 'validation' ELSE 'train' END AS part FROM exam_item",
        "least_frequent_subject": "SELECT exam_subject, count(*) AS n FROM exam_item WHERE exam_subject IS NOT NULL GROUP BY 1 ORDER BY n, exam_subject LIMIT 1",
        "split_overlap": f"WITH k AS (SELECT split, {cmp_q} AS k FROM exam_item), l AS (SELECT k, count(*) AS nl FROM k WHERE split = 'train' GROUP BY 1), r AS (SELECT k, count(*) AS nr FROM k WHERE split IN ('val', 'test') GROUP BY 1) "
        "SELECT sum(nl)::BIGINT AS left_rows, count(nl) AS left_keys, sum(nl) FILTER (nr IS NOT NULL)::BIGINT AS shared_rows, count(*) FILTER (nl IS NOT NULL AND nr IS NOT NULL) AS shared_keys, count(nr) AS right_keys, count(*) FILTER (nr IS NULL) AS left_only_keys, count(*) FILTER (nl IS NULL) AS right_only_keys FROM l FULL JOIN r USING (k)",
        "leakage_blocked": f"WITH k AS (SELECT item_id, split, {cmp_q} AS k FROM exam_item) SELECT item_id, CASE WHEN k IN (SELECT k FROM k WHERE split = 'test') THEN 'R-LEAK-002' ELSE 'R-LEAK-004' END AS blocked_by FROM k WHERE split = 'train' AND k IN (SELECT k FROM k WHERE split IN ('val', 'test'))",
        "train_excluded": "SELECT item_id, source FROM exam_item WHERE item_id NOT IN (SELECT item_id FROM choice_reward WHERE item_id IS NOT NULL)",
        "options_rendered": f"SELECT item_id, md5({_RENDERED}) AS digest, coalesce(cardinality(options), 0)::INT AS n_options FROM exam_item",
        "unit_floats": "SELECT item_id, substr(sha1('day:' || item_id), 1, 16) AS hash, round_even(CAST('0x' || substr(sha1('day:' || item_id), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE, 6) AS u FROM exam_item",
        "lettered_options": f"""SELECT item_id, CASE WHEN len(es) > 0 THEN array_to_string(list_transform(list_sort(list_distinct(list_transform(es, lambda e: e.key))), lambda k: k || '=' || list_filter(es, lambda e: e.key = k)[-1].value), '|') END AS options
          FROM (SELECT item_id, list_filter(list_transform(list_sort(map_entries(options)), lambda e: {{'key': upper(trim(e.key)), 'value': {strip("coalesce(e.value, '')")}}}), lambda e: regexp_full_match(e.key, '[A-Z]')) AS es FROM exam_item)""",
        "answer_forms": f"""SELECT item_id, CASE WHEN list_contains(ks, a) AND a <> '' THEN a WHEN len(cs) > 0 AND len(list_filter(cs, lambda c: list_contains(ks, c))) = len(cs) THEN array_to_string(list_filter(cs, lambda c, i: list_position(cs, c) = i), '') ELSE '' END AS strict,
          array_to_string(list_filter(list_filter(cs, lambda c: list_contains(ks, c)), lambda c, i: list_position(list_filter(cs, lambda c: list_contains(ks, c)), c) = i), '') AS lenient,
          CASE WHEN len(ks) > 0 THEN {letters('answer', 'ks')} ELSE {letters('answer', None)} END AS letters, contains(coalesce(question_type, ''), '多项选择题') OR length(a) > 1 AS multi
          FROM (SELECT *, {_KEYS} AS ks, upper({strip("coalesce(answer, '')")}) AS a, CASE WHEN {strip("coalesce(answer, '')")} = '' THEN [] ELSE string_split(upper({strip("coalesce(answer, '')")}), '') END AS cs FROM exam_item)""",
        "case_categories": f"SELECT value, count(*) AS n FROM (SELECT unnest(list_filter([{', '.join(f'CASE WHEN {matches(QUESTION, p)} THEN {_q(n)} END' for n, p in scoring.CASE_PATTERNS.items())}], lambda x: x IS NOT NULL)) AS value FROM exam_item) GROUP BY 1",
        "term_matches": f"SELECT item_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS symptoms, ({' + '.join(count(QUESTION, p) for p in scoring.DENSE_TERMS)})::INT AS dense_terms FROM (SELECT *, regexp_extract_all({QUESTION}, {_q(scoring.CASE_PATTERNS['symptom'])}) AS m FROM exam_item)",
        "subject_distribution": "SELECT coalesce(exam_subject, 'unknown') AS value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM exam_item), 4) AS pct FROM exam_item GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
        "document_sources": "SELECT coalesce(source, 'unknown') AS value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 4) AS pct FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
        "field_counts": field_counts("exam_item", ("split", "source", "exam_type", "exam_class", "question_type")),
        "reward_labels": field_counts("choice_reward", ("question_type", "difficulty", "used_fallback")),
        "question_lengths": quantiles("exam_item", "length(question)::INT", (0.5, 0.9), "exam_type"),
        "document_lengths": quantiles("documents", "length(text)::INT", (0.5, 0.9), "doc_type"),
        "completion_lengths": quantiles("choice_reward", "length(completion)::INT", (0.5, 0.9, 0.95), "source"),
        "median_length": "SELECT length(question)::INT AS upper_median FROM exam_item WHERE question IS NOT NULL ORDER BY 1 LIMIT 1 OFFSET (SELECT count(question) // 2 FROM exam_item)",
        "answer_extraction": _EXTRACT + f""", v AS (SELECT *, regexp_extract_all({_BODY}, {_q(_LETTERS_LABEL)}, 1) AS c1 FROM x)
          SELECT reward_id, CASE WHEN len(c1) > 0 THEN {letters('c1[-1]')} WHEN last <> '' AND length(last) <= 32 THEN {letters('last')} ELSE '' END AS pred_v1, pred_x AS pred, pred_x <> '' AS valid_extract, label_count::INT AS label_count, fallback_x AS used_fallback, extra_x AS extra_text, logged_at FROM v""",
        "set_measures": f"SELECT reward_id, round_even(prec, 6) AS precision, round_even(rec, 6) AS recall, round_even(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1, extra_n::INT AS extra, missing_n::INT AS missing, logged_at FROM {measured(chr(83) + 'ELECT *, coalesce(pred, ' + chr(39) * 2 + ') AS p, coalesce(gold, ' + chr(39) * 2 + ') AS g FROM choice_reward')}",
        "adaptive_reward": _ADAPTIVE,
        "plain_reward": _V1 + f"""SELECT reward_id, round_even(CASE WHEN ok THEN 0.2 ELSE -1.0 END::DOUBLE + CASE WHEN exact THEN 1.0 ELSE 0 END::DOUBLE + 0.5::DOUBLE * CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END - 0.3::DOUBLE * ex - 0.2::DOUBLE * mi
          + CASE WHEN length({_BODY}) > 512 THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN len(c1) > 1 THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN {count(_BODY, '答案')} > 2 THEN -0.1 ELSE 0 END::DOUBLE, 6) AS reward_v1, logged_at FROM m1""",
        "boundary_reward": _V1 + f"""SELECT reward_id, round_even(CASE WHEN ok THEN 0.2 ELSE -1.0 END::DOUBLE + CASE WHEN exact THEN 2.0 ELSE 0 END::DOUBLE + CASE WHEN len(c1) = 0 THEN -0.3 WHEN len(c1) > 1 THEN -0.5 ELSE 0 END::DOUBLE
          + CASE WHEN len(c1) > 0 AND {matches(f"regexp_replace({_BODY}, '(?s)^.*答案{chr(92)}s*[:：]{chr(92)}s*[A-Za-z,{chr(92)}s，、/]+', '')", '[一-鿿A-Za-z0-9]')} THEN -0.3 ELSE 0 END::DOUBLE
          + CASE WHEN {count(_BODY, _HAN)} > 40 OR length(body) > 80 THEN -0.3 ELSE 0 END::DOUBLE + 0.8::DOUBLE * prec + 0.2::DOUBLE * rec - 0.7::DOUBLE * ex - 0.2::DOUBLE * mi, 6) AS boundary_reward, logged_at FROM m1""",
        "micro_by_source": micro("source", "source", _LETTERED),
        "micro_by_gold_length": micro("CASE WHEN length(g) >= 4 THEN '4_or_more' ELSE length(g)::VARCHAR END", "gold_length", _LETTERED),
        "option_sets": micro("length(g)::INT", "gold_length", "(SELECT l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT chr(64 + l_linenumber)) FILTER (l_linestatus = 'O')), ''), '') AS p, coalesce(array_to_string(list_sort(list(DISTINCT chr(64 + l_linenumber)) FILTER (l_returnflag = 'R')), ''), '') AS g FROM lineitem GROUP BY 1 HAVING g <> '')"),
        "length_differences": f"SELECT CASE WHEN d >= 3 THEN '+3_or_more' WHEN d <= -3 THEN '-3_or_less' WHEN d > 0 THEN '+' || d ELSE d::VARCHAR END AS difference, count(*) AS n FROM (SELECT length(p) - length(g) AS d FROM {_LETTERED}) GROUP BY 1",
        "paired_systems": f"""WITH m AS (SELECT item_id, source, reward_id, p = g AS ok, extra_n, missing_n FROM {measured(f'SELECT * FROM {_LETTERED}')}), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY reward_id DESC) = 1),
          j AS (SELECT a.ok AS ra, b.ok AS rb, a.missing_n AS ma, b.missing_n AS mb, b.extra_n AS eb FROM l a JOIN l b USING (item_id) WHERE a.source = 'sft_direct' AND b.source = 'sft_mixed')
          SELECT count(*) AS n_items, count(*) FILTER (ra AND rb) AS both_right, count(*) FILTER (NOT ra AND NOT rb) AS both_wrong, count(*) FILTER (ra AND NOT rb) AS a_only, count(*) FILTER (NOT ra AND rb) AS b_only,
          count(*) FILTER (ra AND NOT rb AND eb > 0) AS a_only_as_b_has_extra, count(*) FILTER (NOT ra AND rb AND ma > mb) AS b_only_as_b_misses_less FROM j""",
        "reward_latest": f"SELECT reward_id, item_id, source, final_reward, logged_at FROM {_LAST_REWARD}",
        "reward_errors": "SELECT count(option_precision - f1) AS n, round_even(avg((option_precision - f1) ** 2), 6) AS mse, round_even(avg(abs(option_precision - f1)), 6) AS mae FROM choice_reward",
        "difficulty_levels": f"SELECT {_LEVEL} AS level, count(*) AS n FROM choice_reward GROUP BY 1",
        "reward_audit_join": "WITH l AS (SELECT * FROM choice_reward QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY logged_at DESC, reward_id DESC) = 1) SELECT item_id, final_reward AS teacher_score, f1 AS worthiness, (row_number() OVER (ORDER BY final_reward DESC, f1 DESC, item_id))::INT AS rank FROM exam_item JOIN l USING (item_id) WHERE valid_extract QUALIFY rank <= 200",
        "reward_pending": "SELECT item_id, source FROM exam_item WHERE item_id NOT IN (SELECT item_id FROM choice_reward WHERE valid_extract)",
        "reasoning_parts": f"SELECT reward_id, length(b)::INT AS n_chars, {count('b', _HAN)}::INT AS n_ideographs, coalesce({_LINES}[-1], '') AS last_line, logged_at FROM (SELECT *, {_BEFORE} AS b, {_BODY} AS body FROM choice_reward)",
        "tagged_answers": f"SELECT reward_id, {strip(f'regexp_extract({_BODY}, {_q(chr(40) + chr(63) + chr(115) + chr(41) + chr(60) + chr(97) + chr(110) + chr(115) + chr(119) + chr(101) + chr(114) + chr(62) + chr(40) + chr(46) + chr(42) + chr(63) + chr(41) + chr(60) + chr(47) + chr(97) + chr(110) + chr(115) + chr(119) + chr(101) + chr(114) + chr(62))}, 1)')} AS answer, regexp_matches({_BODY}, '^<think>.*?</think><answer>.*?</answer>$') AS well_formed, logged_at FROM choice_reward WHERE contains(completion, '<answer>')",
        "first_letters": f"SELECT source, count(*) AS n, round_even(avg((regexp_extract({_BODY}, '[A-E]{{1,5}}') = gold)::INT), 6) AS exact_rate FROM choice_reward GROUP BY 1",
        "case_measures": _EVAL + "SELECT eval_id, parsed_ok AS parsed, CASE WHEN parsed_ok THEN array_to_string(miss, ',') END AS missing, ok AS compliant, round_even(ds, 6) AS diagnosis_score, dc::INT AS diff_correct, dt::INT AS diff_total, rc::INT AS risk_relevant, rt::INT AS risk_total, oc AS overconfident, cf::INT AS complete_fields, error FROM final",
        "eval_aggregate": _EVAL + eval_rates("'overall'", "'all'") + " UNION ALL " + eval_rates("'department'", "coalesce(department, 'unknown')", group="GROUP BY 2") + " UNION ALL " + eval_rates("'difficulty'", "coalesce(difficulty, 'unknown')", group="GROUP BY 2"),
        "eval_errors": _EVAL + "SELECT coalesce(error, 'none') AS error, source, count(*) AS n FROM final GROUP BY 1, 2",
        "eval_error_examples": _EVAL + "SELECT error, eval_id, md5(substr(coalesce(raw_output, ''), 1, 300)) AS digest, (row_number() OVER (PARTITION BY error ORDER BY eval_id))::INT AS rn FROM final WHERE error IS NOT NULL QUALIFY rn <= 5",
        "eval_deltas": _EVAL + ", a AS (" + eval_rates("'overall'", "'all'", "(SELECT * FROM final WHERE source = 'gw_south')") + "), b AS (" + eval_rates("'overall'", "'all'", "(SELECT * FROM final WHERE source = 'gw_north')") + ") "
        + " UNION ALL ".join(f"SELECT 'overall' AS level, '{m}' AS metric, a.{m} AS a, b.{m} AS b, round_even(b.{m} - a.{m}, 6) AS delta FROM a, b" for m in ("compliance_rate", "diff_coverage_rate", "top1_accuracy")),
        "overconfident_outputs": f"SELECT source, count(*) AS n, count(*) FILTER ({matches(chr(99) + 'oalesce(raw_output, ' + chr(39) * 2 + ')', evaluation.ASSERTIVE)} AND NOT {matches(chr(99) + 'oalesce(raw_output, ' + chr(39) * 2 + ')', evaluation.HEDGING)}) AS n_overconfident FROM eval_result GROUP BY 1",
        "output_lengths": "SELECT source, round_even(avg(n), 6) AS mean, max(n)::INT AS longest, round_even(avg((n = 0)::INT), 6) AS empty_rate, round_even(avg((n > 400)::INT), 6) AS overlong_rate FROM (SELECT *, length(coalesce(raw_output, '')) AS n FROM eval_result) GROUP BY 1",
        "document_exact_copies": f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {TEXT} HAVING count(*) > 1",
        "case_scores": f"""SELECT doc_id, array_to_string(fl, ',') AS flags, round_even({_LENGTH_SCORE}, 6) AS length_score, round_even(({' + '.join(f'{matches(TEXT, p)}::INT::DOUBLE' for p in scoring.CASE_INDICATORS)} + {_LENGTH_SCORE}) / 6, 6) AS richness,
          round_even({_FLAG_SUM} + {' + '.join(f'CASE WHEN {matches(TEXT, p)} THEN {w} ELSE 0 END::DOUBLE' for p, w in scoring.PATTERN_PENALTIES)} + CASE WHEN length({TEXT}) > 3000 THEN 0.05 ELSE 0 END::DOUBLE, 6) AS penalty,
          CASE WHEN {matches(TEXT, '现病史|体格检查|辅助检查')} THEN 'semi_structured_case' WHEN {matches(TEXT, '[A-E][.．、]')} THEN 'exam_case' ELSE 'patient_narrative' END AS style FROM (SELECT *, {_FLAGS} AS fl FROM documents)""",
        "departments": f"SELECT doc_id, department FROM {_DEPARTMENT}",
        "department_counts": f"SELECT coalesce(department, 'none') AS department, count(*) AS n FROM {_DEPARTMENT} GROUP BY 1",
        "spoken_pairs": f"SELECT doc_id, len(r)::INT AS n_turns, len(list_filter(r, lambda x, i: x = 'gpt' AND list_contains(r[1:i], 'human')))::INT AS n_pairs FROM {_SPOKEN}",
        "sft_prefixes": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS sample, i::INT AS n_messages FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM {_SPOKEN}) WHERE r[i] = 'gpt' AND list_contains(r[1:i], 'human')",
        "bm25_documents": f"""WITH q AS (SELECT item_id, unnest(list_distinct({_TERMS.format('question', _WS)})) AS t FROM exam_item WHERE item_id % 20 = 0), d AS (SELECT doc_id, {_TERMS.format('text', _WS)} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
          tf AS (SELECT doc_id, len(ts) AS l, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3), idf AS (SELECT t, ln(1 + (s.n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, s GROUP BY t, s.n),
          sc AS (SELECT item_id, doc_id, round_even(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / s.mean))), 6) AS score FROM q JOIN idf USING (t) JOIN tf USING (t), s GROUP BY 1, 2)
          SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM sc QUALIFY rank <= 5""",
        "vector_neighbours": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id, round_even(list_cosine_similarity(a.e, b.e), 4) AS similarity, (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id DESC))::INT AS rank FROM v a, v b WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.e, b.e) >= 0 QUALIFY rank <= 5",
        "vector_aligned": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id DESC) AS rank FROM v a, v b WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.e, b.e) >= 0 QUALIFY rank <= 5) SELECT DISTINCT vec_id FROM n",
        "sft_conversations": f"SELECT row_id, md5({_ASKED}{_RENDERED}) AS asked, '答案：' || coalesce(answer, '') AS answered, CAST(NULL AS VARCHAR) AS error FROM sft_row",
        "sft_rendered": f"""SELECT row_id, 1 AS n_pairs, md5('A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user''s questions.</s>USER: ' || a || ' ASSISTANT:' || b) AS vicuna,
          md5('<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || chr(10) || '<|im_start|>user' || chr(10) || a || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || b) AS qwen,
          md5('Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || a || chr(10) || chr(10) || '### Response:' || chr(10) || b) AS alpaca
          FROM (SELECT row_id, {_ASKED}{_RENDERED} AS a, '答案：' || coalesce(answer, '') AS b FROM sft_row)""",
        "preference_budget": f"WITH l AS {_LAST_REWARD}, c AS (SELECT item_id, arg_min(completion, reward_id) FILTER (exact_match) AS chosen, arg_min(completion, reward_id) FILTER (NOT exact_match) AS rejected FROM l GROUP BY 1) SELECT item_id, md5(chosen) AS chosen, md5(rejected) AS rejected FROM c WHERE length(chosen) BETWEEN 1 AND 200 AND length(rejected) BETWEEN 1 AND 200",
        "exam_candidates": f"SELECT item_id, md5({strip(f'array_to_string(list_concat([{QUESTION}], list_transform(list_sort(coalesce(map_entries(options), [])), lambda e: e.key || {_q(chr(46) + chr(32))} || coalesce(e.value, {_q(str())}))), chr(10))')}) AS case_text, CASE WHEN options[k] IS NOT NULL THEN k || '. ' || options[k] ELSE k END AS answer_text FROM (SELECT *, {strip(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')} AS k FROM exam_item)",
        "holdout_cases": f"""WITH b AS (SELECT doc_id, department, CASE WHEN {hits(TEXT, corpus.HARD_CASE_WORDS)} >= 2 THEN 'hard' WHEN {hits(TEXT, corpus.EASY_CASE_WORDS)} >= 1 AND {hits(TEXT, corpus.HARD_CASE_WORDS)} = 0 THEN 'easy' ELSE 'medium' END AS level FROM documents JOIN {_DEPARTMENT} USING (doc_id)),
          c AS (SELECT department, least(10, count(*) FILTER (level = 'easy')) AS e, least(15, count(*) FILTER (level = 'hard')) AS h, count(*) FILTER (level = 'medium') AS m FROM b WHERE department IS NOT NULL GROUP BY 1),
          r AS (SELECT *, row_number() OVER (PARTITION BY department, level ORDER BY {_hash('holdout', 'doc_id')}, doc_id) AS rn FROM b WHERE department IS NOT NULL),
          d AS (SELECT doc_id, department, level FROM r JOIN c USING (department) WHERE rn <= CASE level WHEN 'easy' THEN e WHEN 'hard' THEN h ELSE least(m, greatest(0, 50 - e - h)) END),
          x AS (SELECT doc_id, (SELECT department FROM d GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS department, level FROM b WHERE department IS NULL AND (SELECT count(*) FROM d) BETWEEN 1 AND 299 ORDER BY {_hash('holdout', 'doc_id')}, doc_id LIMIT 20)
          SELECT *, (row_number() OVER (ORDER BY department, level, doc_id))::INT AS case_no FROM (SELECT * FROM d UNION ALL SELECT * FROM x)""",
        "rationale_rates": f"""SELECT source, count(*) AS n, round_even(avg((len(r) > 0 AND len(list_filter(r, lambda k: NOT contains(b, k))) = 0)::INT), 6) AS names_all_right,
          round_even(avg((len(list_filter(valid_options, lambda k: contains(b, k) AND NOT contains(coalesce(gold, ''), k))) > 0)::INT), 6) AS names_wrong, round_even(avg((length(b) > 200)::INT), 6) AS long_rate
          FROM (SELECT *, {_BEFORE} AS b, list_filter(valid_options, lambda k: contains(coalesce(gold, ''), k)) AS r FROM choice_reward) GROUP BY 1""",
        "case_target_errors": _TARGET_ERRORS,
        "customer_places": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
        "party_union": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
        "order_key_overlap": "WITH l AS (SELECT o_custkey AS k, count(*) AS nl FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS nr FROM customer GROUP BY 1) SELECT coalesce(sum(nl), 0)::BIGINT AS left_rows, count(nl) AS left_keys, coalesce(sum(nl) FILTER (nr IS NOT NULL), 0)::BIGINT AS shared_rows, count(*) FILTER (nl IS NOT NULL AND nr IS NOT NULL) AS shared_keys, count(nr) AS right_keys, count(*) FILTER (nr IS NULL) AS left_only_keys, count(*) FILTER (nl IS NULL) AS right_only_keys FROM l FULL JOIN r USING (k)",
        "event_tumbling": _windows("6 HOURS", "6 HOURS", "event_type"),
        "event_sliding": _windows("12 HOURS", "6 HOURS", "event_type"),
        "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS \"start\", max(ts) + INTERVAL 2 HOURS AS \"end\", user_id, count(*) AS n, round_even(sum(value), 4) AS total FROM s GROUP BY user_id, k",
        "event_latest_stream": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "event_dedup_stream": "SELECT DISTINCT user_id FROM events",
        "event_error_runs": "WITH g AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, k, count(*) AS n, min(ts) AS first FROM g WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, min(first) FILTER (n >= 3) AS tripped_run_start, max(n) AS longest FROM r GROUP BY 1",
        "event_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY 1",
        "event_daily_top": "SELECT day, user_id, n, (row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id))::INT AS rn FROM (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY rn <= 3",
        "normal_forms": f"""SELECT doc_id, md5({no_space(TEXT)}) AS no_space, md5(regexp_replace(lower({strip(TEXT)}), '{_WS}+', ' ', 'g')) AS collapsed, md5({diag('text')}) AS diagnosis,
          md5({strip(f"regexp_replace({strip(TEXT)}, '^(?:问：|问:|答：|答:|Q：|Q:|A：|A:)', '')")}) AS no_prefix, md5(regexp_replace(lower({TEXT}), '[^a-z_]', '', 'g')) AS tag,
          len(list_filter(list_transform(regexp_split_to_array({TEXT}, '\\r\\n|\\r|\\n'), lambda x: {strip('x')}), lambda x: x <> ''))::INT AS n_lines FROM documents""",
    }
