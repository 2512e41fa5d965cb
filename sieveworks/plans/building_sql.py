"""SQL for DuckDB with the rows of the queries in ``building``. Word lists are said again here, none is taken from an operator."""

from __future__ import annotations

from sieveworks.plans.sql import _DIFFICULTY, _KEEPER, _QUALITY, _SPOKEN, QUESTION, TEXT, _FLAGS, _hash, _LAST_EVAL, _LAST_REWARD, _target_errors, comparison, hits, matches, nf, strip, without_hedges

_OPTION_SIG = f"coalesce(array_to_string(list_transform(list_sort(list_transform(map_entries(options), lambda e: {{'key': upper({strip(nf('e.key'))}), 'value': {strip(nf("coalesce(e.value, '')"))}}})), lambda e: {comparison('e.key', False)} || '=' || {comparison('e.value', False)}), '|'), '')"
_RAW_SIG = "'{\"o\": {' || coalesce(array_to_string(list_transform(list_sort(map_entries(options)), lambda e: to_json(e.key) || ': ' || coalesce(to_json(e.value), 'null')), ', '), '') || '}, \"q\": ' || to_json(coalesce(question, '')) || '}'"
_RISK = "休克 昏迷 意识障碍 大出血 心肺 呼吸衰竭 急性 危象 中毒 脓毒症 多器官 心肌梗死 主动脉夹层 脑出血 脑疝 肺栓塞 急性肝衰竭 急性肾损伤 高血钾 低血钾 心律失常 失血性休克 感染性休克 过敏性休克 DIC".split()
_DIFFERENTIAL = "胸痛 腹痛 发热待查 不明原因 鉴别 考虑 可能 类似 需要排除 需排除 不明".split()
_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"
_PATTERNS = ("(用法用量|注意事项|说明书|副作用|不良反应)", "(简介是|是什么|什么是|发病原因|病因是什么|预防.*是什么)", "^(.*)(严重吗|怎么办|吃什么药)[?？]?$")
_COSTLY = "generic_medical_qa weak_case_context may_depend_on_image_or_attachment safety_boundary_signal too_short has_replacement_character".split()

_ENTRIES = f"list_filter(list_transform(list_sort(map_entries(options)), lambda e: {{'key': upper(trim(e.key)), 'value': {strip("coalesce(e.value, '')")}}}), lambda e: regexp_full_match(e.key, '[A-Z]'))"
_PROMPTS = f"""
WITH es AS (SELECT *, {strip(QUESTION)} AS q, coalesce({_ENTRIES}, []) AS es FROM exam_item),
ks AS (SELECT *, list_sort(list_distinct(list_transform(es, lambda e: e.key))) AS ks FROM es),
a AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(upper(coalesce(answer, '')), ''), lambda c: list_contains(ks, c)))), '') AS ans,
  array_to_string(list_transform(ks, lambda k: k || '. ' || list_filter(es, lambda e: e.key = k)[-1].value), chr(10)) AS body FROM ks)
SELECT item_id::VARCHAR AS sample_id, ans AS answer, length(ans)::INT AS answer_len, CASE WHEN length(ans) = 1 THEN 'single' ELSE 'multi' END AS question_type, question_type AS source_question_type, exam_subject, 'v2' AS prompt_version,
  md5('你是一名医学考试助手。请根据题目选择正确选项。' || chr(10) || chr(10) || '题目：' || q || chr(10) || chr(10) || '选项：' || chr(10) || body || chr(10) || chr(10) || '请作答：') AS prompt,
  CASE WHEN q = '' THEN 'empty_question' WHEN len(ks) = 0 THEN 'invalid_options' WHEN ans = '' THEN 'invalid_answer' END AS reject_reason FROM a
"""

_REPLY_KIND = "CASE eval_id % 8 WHEN 0 THEN 'reject' WHEN 4 THEN 'reject' WHEN 6 THEN 'maybe' ELSE 'accept' END"
_REPLY_ERRORS = f"""(SELECT *, CASE eval_id % 8 WHEN 1 THEN 'not_json_object' WHEN 0 THEN 'reject_missing_reason' WHEN 4 THEN '' WHEN 6 THEN 'decision_not_accept_or_reject' WHEN 3 THEN 'schema_target_not_object'
  ELSE concat_ws(',', nullif(CASE WHEN eval_id % 8 = 2 OR {strip("coalesce(case_text, '')")} = '' THEN 'case_text_empty' ELSE '' END, ''), nullif({_target_errors('ground_truth')}, '')) END AS e FROM {_LAST_EVAL})"""
_REWRITE_REASON = f"""CASE WHEN eval_id % 8 = 1 THEN 'teacher_response_not_object' WHEN {_REPLY_KIND} <> 'accept' THEN 'teacher_decision:' || {_REPLY_KIND} WHEN eval_id % 8 = 2 OR {strip("coalesce(case_text, '')")} = '' THEN 'case_text_empty'
  WHEN eval_id % 8 = 3 THEN 'schema_target_not_object' ELSE nullif({_target_errors('ground_truth')}, '') END"""

_LAYOUT = f"regexp_replace(regexp_replace(regexp_replace({nf(QUESTION)}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0B ]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
_VALUES = "list_transform(list_sort(map_entries(options)), lambda e: coalesce(e.value, ''))"


def _pairs(q: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({q}) - {n - 2}, 1)), lambda i: substr({q}, i, {n}))"


_SCORES = {"cot_worthiness_score": ("extra_count * 4", 10), "reasoning_need_score": ("missing_count", 4), "case_richness_score": ("1", 2), "option_confusion_score": ("answer_label_count", 2), "rote_recall_penalty": ("0", 2), "definition_penalty": ("1", 1)}


def _clamped(name: str) -> str:
    value, most = _SCORES[name]
    return f"greatest(least(coalesce({value}, 0), {most}), 0)"


_SCREEN_ERRORS = ", ".join(
    ["CASE WHEN false THEN '' END"] + [f"CASE WHEN ({v}) IS NULL THEN '{k} is not an int' END" for k, (v, _) in _SCORES.items()]
    + [f"CASE WHEN ({v}) NOT BETWEEN 0 AND {m} THEN '{k} out of range' END" for k, (v, m) in _SCORES.items()] + ["CASE WHEN length(trim(repeat(coalesce(gold, ''), 5))) < 10 THEN 'reason too short' END"]
)


# Exact cosines of all pairs of a block that share a gram; then rows of equal text and answer stand by their least id.
_NEAR = f"""
WITH t AS (SELECT item_id AS id, coalesce(trim(exam_type), '__missing__') || '|' || coalesce(trim(exam_class), '__missing__') || '|' || coalesce(trim(exam_subject), '__missing__') AS b, upper({strip("coalesce(answer, '')")}) AS a,
  {comparison("concat(repeat(coalesce(question, ''), 4), coalesce(array_to_string(list_transform(list_sort(map_entries(options)), lambda e: e.key || coalesce(e.value, '')), ''), ''))")} AS v FROM exam_item),
r AS (SELECT *, min(id) OVER (PARTITION BY b, v, a) AS rep, min(id) OVER (PARTITION BY b, v) AS cid, count(*) OVER (PARTITION BY b) AS n FROM t),
c AS (SELECT b, v, cid, n, count(*) AS m FROM r GROUP BY ALL),
g AS (SELECT b, cid, m, n, gram, count(*) AS tf FROM (SELECT b, cid, m, n, unnest(flatten(list_transform([2, 3, 4, 5], lambda k: list_transform(range(1, greatest(length(v) - k + 2, 1)), lambda i: substr(v, i, k))))) AS gram FROM c) GROUP BY ALL),
d AS (SELECT b, gram, sum(m) AS df FROM g GROUP BY ALL),
w AS (SELECT g.b, cid, gram, df, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM g JOIN d USING (b, gram) WHERE df >= 2 OR n < 4),
u AS (SELECT b, cid, gram, df, w / sqrt(sum(w * w) OVER (PARTITION BY b, cid)) AS w FROM w),
-- two vectors of a cosine of 0.95 share one of each one's rarest grams, those before which less than 0.95 squared is left
p AS (SELECT *, sum(w * w) OVER (PARTITION BY b, cid ORDER BY df DESC, gram DESC ROWS UNBOUNDED PRECEDING) AS upto FROM u),
k AS (SELECT DISTINCT x.cid AS ca, y.cid AS cb FROM p x JOIN p y ON x.b = y.b AND x.gram = y.gram AND x.cid < y.cid WHERE x.upto >= 0.9 AND y.upto >= 0.9),
s AS (SELECT ca, cb, sum(x.w * y.w) AS sim FROM k JOIN u x ON x.cid = ca JOIN u y ON y.cid = cb AND y.gram = x.gram GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.95),
o AS (SELECT DISTINCT cid, a, rep FROM r)
SELECT least(x.rep, y.rep) AS id_a, greatest(x.rep, y.rep) AS id_b, round_even(sim, 4) AS similarity FROM s JOIN o x ON x.cid = ca JOIN o y ON y.cid = cb AND y.a = x.a
UNION ALL SELECT rep, id, 1.0 FROM r WHERE id <> rep
"""


_CLUSTERS = f"""
WITH RECURSIVE near AS ({_NEAR}), e AS (SELECT id_a AS u, id_b AS v FROM near UNION SELECT id_b, id_a FROM near),
reach(u, r) AS (SELECT u, u FROM e UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.u),
comp AS (SELECT u AS id, min(r) AS component FROM reach GROUP BY 1), q AS ({_KEEPER})
SELECT id, component, first_value(id) OVER (PARTITION BY component ORDER BY quality DESC, id) AS kept_id, count(*) OVER (PARTITION BY component) AS members FROM comp JOIN q ON q.item_id = id
"""


def _list(name: str) -> str:
    return f"list_filter(coalesce(ground_truth.{name}, []), lambda x: {strip("coalesce(x, '')")} <> '')"


_CASE = strip("coalesce(case_text, '')")
_OWN = without_hedges("ground_truth.primary_diagnosis")
_REVIEW = f"""
WITH k AS (SELECT *, {_CASE} AS t, concat_ws(chr(10), {_CASE}, ground_truth.primary_diagnosis) AS k FROM {_LAST_EVAL}),
r AS (SELECT *, first_value(eval_id) OVER (PARTITION BY k ORDER BY length(case_text) DESC NULLS LAST, eval_id) AS best,
  CASE WHEN length(t) < 18 THEN 'R-QUAL-002' WHEN contains(t, '�') OR len(regexp_extract_all(t, '[A-Za-z0-9]')) / greatest(length(t), 1)::DOUBLE > 0.6 THEN 'R-QUAL-008'
    WHEN ground_truth IS NULL OR {strip("coalesce(ground_truth.primary_diagnosis, '')")} = '' THEN 'R-QUAL-001'
    WHEN len({_list('diagnostic_basis')}) < 2 OR len(list_filter({_list('diagnostic_basis')}, lambda x: x IN ('根据患者情况', '结合临床', '综合考虑', '情况考虑') OR length(x) < 4)) > 0 THEN 'R-QUAL-005'
    WHEN len({_list('differential_diagnoses')}) = 0 THEN 'R-QUAL-006'
    WHEN {_OWN} <> '' AND list_contains(list_transform(coalesce(ground_truth.differential_diagnoses, []), lambda d: {without_hedges('d')}), {_OWN}) THEN 'R-QUAL-006,R-REVIEW-005'
    WHEN len({_list('recommended_actions')}) = 0 THEN 'R-QUAL-007'
    WHEN length(t) < 32 AND regexp_matches(t, '怎么办|吃什么药|严重吗|要不要紧') AND NOT regexp_matches(t, '患者|病例') THEN 'R-QUAL-010' ELSE '' END AS rules FROM k)
SELECT eval_id, CASE WHEN best <> eval_id THEN 'rejected_duplicate' WHEN contains(rules, 'R-REVIEW') THEN 'needs_manual_review' WHEN rules <> '' THEN 'rejected_low_quality' ELSE 'accepted' END AS status,
  CASE WHEN best <> eval_id THEN 'R-DUP-001' ELSE rules END AS rules, CASE WHEN best <> eval_id THEN best END AS duplicate_of FROM r
"""
_PACKED = f"""
WITH p AS (SELECT (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT % 8)::INT AS part, sum(length({TEXT}) + 1)::BIGINT AS n FROM documents GROUP BY 1)
SELECT part, b::INT AS block, 512::INT AS n FROM (SELECT part, unnest(range(0, n // 512)) AS b FROM p) UNION ALL SELECT part, 0, n::INT FROM p WHERE n < 512
"""


# Sentences joined one by one into a text whose chunks are parted by a control character.
_LATIN = "list_filter(string_split(list_reduce(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda acc, x: CASE WHEN string_split(acc, chr(30))[-1] = '' THEN acc || x WHEN length(string_split(acc, chr(30))[-1]) + length(x) <= 250 THEN acc || ' ' || x ELSE acc || chr(30) || x END), chr(30)), lambda c: c <> '')"
_CHUNKS = f"""
WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN list_transform(regexp_extract_all(text, '(?s).{{200,249}}?[\n。！？；…]|.{{1,250}}'), lambda x: {strip('x')}) ELSE {_LATIN} END AS cs FROM documents WHERE text <> ''),
o AS (SELECT doc_id, list_transform(cs, lambda c, i: CASE WHEN i < len(cs) THEN {strip("c || ' ' || substr(cs[i + 1], 1, 50)")} ELSE c END) AS cs FROM c)
SELECT doc_id, len(cs) AS n_chunks, list_max(list_transform(cs, lambda c: length(c)))::INT AS longest FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {
        "chunk_counts": _CHUNKS,
        "near_duplicate_clusters": _CLUSTERS,
        "case_review": _REVIEW,
        "packed_blocks": _PACKED,
        "near_duplicate_pairs": _NEAR,
        "raw_signatures": f"SELECT item_id, md5({_RAW_SIG}) AS signature FROM exam_item",
        "duplicate_views": f"""WITH v AS (SELECT {_RAW_SIG} AS raw, {comparison('question')} || '||' || {_OPTION_SIG} AS normalized, {comparison('question')} AS question_only FROM exam_item),
          g AS ({' UNION ALL '.join(f"SELECT '{x}' AS view, {x} AS k, count(*) AS n FROM v GROUP BY 2" for x in ('raw', 'normalized', 'question_only'))})
          SELECT view, count(*) FILTER (n > 1) AS groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicate_rows FROM g GROUP BY 1""",
        "basic_filter": "SELECT source, count(*) AS n, count(*) FILTER (coalesce(question, '') <> '' AND coalesce(answer, '') <> '' AND coalesce(cardinality(options), 0) >= 3) AS kept FROM exam_item GROUP BY 1",
        "filtered_sample": f"""SELECT item_id FROM exam_item JOIN ({_QUALITY}) USING (item_id) JOIN ({_DIFFICULTY}) d USING (item_id)
          WHERE length(question) >= 10 AND coalesce(cardinality(options), 0) >= 3 AND quality >= 0.4 AND d.difficulty = 'medium' ORDER BY {_hash('42', 'item_id')}, item_id LIMIT 200""",
        "sample_ids": "SELECT reward_id, logged_at, coalesce(nullif(pred, ''), CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR END, (extra_count - 1)::VARCHAR, reward_id::VARCHAR) AS sample_id FROM choice_reward",
        "case_risks": f"""SELECT doc_id, {hits(TEXT, _RISK)} > 0 AS high_risk, {hits(TEXT, _DIFFERENTIAL)} > 0 AS needs_differential, array_to_string(list_concat(list_filter({_FLAGS}, lambda f: f IN ({', '.join(f"'{x}'" for x in _COSTLY)})),
          list_filter([{', '.join(f"CASE WHEN {matches(TEXT, p)} THEN 'pattern:{p}' END" for p in _PATTERNS)}, CASE WHEN length({TEXT}) > 3000 THEN 'very_long_text' END], lambda x: x IS NOT NULL)), ';') AS reasons FROM documents""",
        "prioritised_sources": f"""SELECT doc_id, CASE WHEN rn > 1 THEN 'duplicate_case_text' WHEN length(text) < 12 OR contains(text, '�') THEN 'invalid_quality' END AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY text
          ORDER BY CASE source WHEN 'case_digest' THEN 1 WHEN 'kebei_qa' THEN 2 WHEN 'teacher_rewrite' THEN 3 ELSE 4 END, doc_id) AS rn FROM documents WHERE text IS NOT NULL)""",
        "token_budget": f"SELECT source, count(*) AS n, count(*) FILTER (length({TEXT}) BETWEEN 1 AND 400) AS within FROM documents GROUP BY 1",
        "prompt_rows": _PROMPTS,
        "chat_prompts": "SELECT row_id, md5('system:请先思考再回答。|user:' || coalesce(question, '')) AS messages FROM sft_row",
        "solution_conversations": "SELECT row_id, md5('human:' || coalesce(question, '') || ' Think step by step.|gpt:' || CASE WHEN coalesce(answer, '') <> '' THEN answer ELSE 'No solution available.' END) AS turns FROM sft_row",
        "answer_conversations": f"""WITH r AS (SELECT *, list_sort(map_keys(options)) AS ks, upper({strip("coalesce(answer, '')")}) AS a, coalesce(question, '') AS q FROM sft_row),
          l AS (SELECT *, list_filter(string_split(a, ''), lambda c: coalesce(list_contains(ks, c), false)) AS cs FROM r),
          m AS (SELECT *, array_to_string(list_filter(cs, lambda c, i: list_position(cs, c) = i), '') AS ls FROM l)
          SELECT row_id, CASE WHEN ls <> '' THEN md5('human:' || q || '|gpt:答案：' || ls) END AS direct, md5('human:' || q || '|gpt:分析：' || coalesce(difficulty, '-') || chr(10) || chr(10) || '答案：' || coalesce(answer, '')) AS reasoned,
          md5('human:' || q || CASE WHEN {strip("coalesce(exam_type, ' ')")} <> '' THEN chr(10) || chr(10) || exam_type ELSE '' END || '|gpt:' || coalesce(answer, '')) AS instruction FROM m""",
        "source_formats": """SELECT CASE WHEN reward_id % 5 = 0 THEN 'given' WHEN contains(t, '分析：') AND contains(t, '答案：') THEN 'cot_teacher_deepseek' WHEN starts_with(t, '答案：') THEN 'direct_answer' ELSE 'unknown' END AS format,
          count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT *, coalesce(completion, '') AS t FROM choice_reward) GROUP BY 1""",
        "usable_dialogues": f"""WITH r AS (SELECT doc_id, coalesce(r, []) AS r FROM {_SPOKEN}),
          p AS (SELECT *, len(list_filter(r, lambda x, i: x = 'gpt' AND i > 1 AND r[i - 1] = 'human')) AS answered FROM r),
          s AS (SELECT *, CASE WHEN len(r) > 0 AND r[1] <> 'human' THEN r[2:] ELSE r END AS b FROM p),
          k AS (SELECT *, len(list_filter(b, lambda x, i: x = CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END)) AS placed FROM s)
          SELECT doc_id, CASE WHEN len(r) > 0 AND r[-1] = 'gpt' THEN len(r) + 1 WHEN len(r) > 0 THEN -1 ELSE -1 END::INT AS usable, 's' AS system, len(r)::INT AS rest,
          (answered + CASE WHEN len(r) > 0 AND r[-1] = 'human' THEN 1 ELSE 0 END)::INT AS dangling_pairs, CASE WHEN placed >= 2 AND placed % 2 = 0 THEN placed // 2 ELSE -1 END::INT AS strict_pairs, array_to_string(r[-2:], '|') AS last_roles FROM k""",
        "numbered_contexts": f"""SELECT row_id, md5(substr(array_to_string(list_transform({_VALUES}, lambda v, i: '[' || i || ']' || chr(9) || ' "' || v || '"'), chr(10)), 1, 60)) AS context,
          len(list_filter({_VALUES}, lambda v: {strip('v')} <> ''))::INT AS n_items FROM sft_row WHERE options IS NOT NULL""",
        "preference_texts": "SELECT row_id, md5(coalesce(question, '') || coalesce(answer, '')) AS chosen, md5(coalesce(question, '') || '不知道') AS rejected, trim(coalesce(answer, '')) AS reply FROM sft_row",
        "tool_calls": """SELECT row_id, 'Action: look_up' || chr(10) || 'Action Input: ' || a || chr(10) AS "default", 'look_up' || chr(10) || a AS glm4, '{"name": "look_up", "parameters": ' || a || '}' AS llama3, '[{"name": "look_up", "arguments": ' || a || '}]' AS mistral,
          '<tool_call>' || chr(10) || '{"name": "look_up", "arguments": ' || a || '}' || chr(10) || '</tool_call>' AS qwen, a AS default_read, a AS mistral_read, a AS qwen_read, '<tool_response>' || chr(10) || row_id || chr(10) || '</tool_response>' AS observation
          FROM (SELECT row_id, '{"id": ' || row_id || '}' AS a FROM sft_row)""",
        "teacher_replies": f"SELECT eval_id, CASE WHEN eval_id % 8 = 4 THEN 'rejected_by_teacher' WHEN e = '' THEN 'accepted' ELSE 'invalid' END AS status, e AS errors FROM {_REPLY_ERRORS}",
        "teacher_rewrites": f"""SELECT eval_id, r AS sft_reject_reason, CASE WHEN r IS NULL THEN md5({strip('case_text')} || chr(10) || chr(10) || '请按要求输出结构化结果。') END AS asked, CASE WHEN r IS NULL THEN {strip('ground_truth.primary_diagnosis')} END AS diagnosis,
          CASE WHEN r IS NULL THEN len(ground_truth.risk_flags) ELSE -1 END::INT AS n_risks FROM (SELECT *, {_REWRITE_REASON} AS r FROM {_LAST_EVAL})""",
        "nested_targets": f"""SELECT eval_id, d AS diagnosis FROM (SELECT eval_id, CASE WHEN eval_id % 3 = 0 THEN 'own' WHEN eval_id % 8 NOT IN (1, 3) THEN nullif(ground_truth.primary_diagnosis, '') END AS d FROM {_LAST_EVAL}) WHERE d IS NOT NULL""",
        "screening_replies": f"""WITH e AS (SELECT *, list_filter([{_SCREEN_ERRORS}], lambda x: x IS NOT NULL) AS errs FROM {_LAST_REWARD})
          SELECT reward_id, CASE WHEN len(errs) = 0 THEN 'ok' ELSE 'invalid' END AS status, CASE WHEN exact_match THEN 'keep' ELSE 'drop' END AS decision, {_clamped('cot_worthiness_score')}::INT AS cot_worthiness_score,
          ({_clamped('reasoning_need_score')} + 1 + {_clamped('option_confusion_score')} - 0 - 1)::INT AS derived_score, 'ab' AS tags, array_to_string(errs, ',') AS errors FROM e""",
        "reasoning_kinds": f"""SELECT eval_id, array_to_string(list_filter(['diagnosis', CASE WHEN eval_id % 2 = 0 THEN 'differential' END, CASE WHEN is_overconfident THEN 'triage' END, CASE WHEN is_overconfident THEN 'risk_detection' END,
          CASE WHEN NOT json_compliant THEN 'test_recommendation' END, 'comorbidity_reasoning'], lambda x: x IS NOT NULL), ',') AS kinds FROM {_LAST_EVAL}""",
        "boxed_answers": "SELECT row_id, '{' || coalesce(answer, '') || '}' AS boxed, coalesce(answer, '') AS content, coalesce(answer, '') AS read, coalesce(cardinality(options), 0)::INT AS n_options FROM sft_row",
        "token_blocks": """WITH n AS (SELECT row_id, length(coalesce(question, '')) AS q, length(coalesce(answer, '')) AS a FROM sft_row),
          s AS (SELECT *, least(q, CAST(floor(100 * (q / greatest(q + a, 1)::DOUBLE)) AS INT)) AS ns, least(a, greatest(CAST(floor(100 * (a / greatest(q + a, 1)::DOUBLE)) AS INT) - 1, 0)) AS nt FROM n)
          SELECT row_id, (greatest(q - 2, 0) // 14)::INT AS blocks, least(q, 64)::INT AS unpadded, 64::INT AS padded, CASE WHEN ns + nt + 1 > 100 THEN 0 ELSE ns + nt + 1 END::INT AS ids, ns + nt + 1 <= 100 AS trained FROM s""",
        "shifted_hits": """WITH a AS (SELECT source, CASE WHEN coalesce(pred, '') = '' THEN [] ELSE string_split(pred, '') END AS p, CASE WHEN coalesce(gold, '') = '' THEN [] ELSE string_split(gold, '') END AS g FROM choice_reward),
          z AS (SELECT source, list_filter(list_transform(range(1, greatest(len(p) - 1, len(g) - 1) + 1), lambda i: {'p': CASE WHEN i < len(p) THEN p[i] END, 'l': g[i + 1]}), lambda x: x.l <> 'A') AS z FROM a)
          SELECT source, sum(len(list_filter(z, lambda x: x.p = x.l)))::BIGINT AS hits, sum(len(z))::BIGINT AS counted FROM z GROUP BY 1""",
        "reward_perplexity": "SELECT round_even(exp(sum(abs(final_reward)) / sum(chinese_char_count)), 6) AS perplexity FROM choice_reward",
        "shuffled_head": f"SELECT doc_id FROM documents ORDER BY {_hash('shuffle', 'doc_id')}, doc_id LIMIT 100",
        "held_back": "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 50",
        "random_pairs": f"SELECT left_id, right_id FROM (SELECT doc_id AS left_id, row_number() OVER (ORDER BY {_hash('paira', 'doc_id')}, doc_id) AS pos FROM documents) JOIN (SELECT row_id AS right_id, row_number() OVER (ORDER BY {_hash('pairb', 'row_id')}, row_id) AS pos FROM sft_row) USING (pos)",
        "quota_units": "SELECT source, unnest(range(1, max_repeats + 1))::INT AS unit FROM mix_target WHERE mix_id = 1 AND max_repeats > 0",
        "merged_words": "WITH s AS (SELECT exam_subject AS word FROM exam_item WHERE regexp_full_match(exam_subject, '[一-鿿]+') GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 20) SELECT word, min(i)::INT AS first_list FROM (SELECT label_variant AS word, 0 AS i FROM question_type_alias UNION ALL SELECT word, 1 FROM s) WHERE word <> '' GROUP BY 1",
        "bucket_targets": f"""WITH d AS ({_DIFFICULTY}) SELECT level, target, count(item_id) AS available, count(*) FILTER (item_id % 10 = 0) AS selected FROM (VALUES ('easy', 50), ('hard', 50), ('none', 10)) p(level, target) LEFT JOIN d ON d.difficulty = level GROUP BY 1, 2""",
        "ngram_counts": f"""SELECT item_id, (len(g2) + len(g3))::INT AS n, len(list_distinct(list_concat(g2, g3)))::INT AS n_distinct, bit_count(xor(item_id, length(q)))::INT AS bits FROM (SELECT item_id, q, {_pairs('q', 2)} AS g2, {_pairs('q', 3)} AS g3
          FROM (SELECT item_id, regexp_replace(coalesce(question, ''), '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B\\x1C-\\x1F]+', '', 'g') AS q FROM exam_item))""",
        "layout_forms": f"SELECT item_id, md5({strip(f"regexp_replace({_LAYOUT}, '\\n{{3,}}', chr(10) || chr(10), 'g')")}) AS two, md5({strip(f"regexp_replace({_LAYOUT}, '\\n{{2,}}', chr(10), 'g')")}) AS one FROM exam_item",
        "embedding_cosines": """SELECT a.vec_id, round_even(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
          / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "react_turns": f"""WITH r AS (SELECT reward_id, logged_at, pred, gold, regexp_replace(regexp_replace(coalesce(completion, ''), '^\\n+', ''), '{_SPACE}+$', '') AS c FROM choice_reward WHERE NOT contains(completion, chr(10) || 'Action')),
          w AS (SELECT *, CASE WHEN reward_id % 2 = 0 THEN CASE WHEN starts_with(c, 'Thought:') THEN c ELSE 'Thought: ' || c END || chr(10) || 'Action: check' || chr(10) || 'Action Input: ' || coalesce(pred, '')
            ELSE 'Thought: I now know the final answer.' || chr(10) || 'Final Answer: ' || c END || chr(10) || 'Observation: ' || coalesce(gold, '') || chr(10) || 'Thought:' AS t FROM r)
          SELECT reward_id, logged_at, 2::INT AS n_turns, md5(t) AS turn, CASE WHEN reward_id % 2 = 0 THEN 'check' END AS call_name, CASE WHEN reward_id % 2 = 0 THEN coalesce(pred, '') END AS call_arguments FROM w""",
        "chunk_texts": f"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).{{200,249}}?[\n。！？；…]|.{{1,250}}'), lambda x: {strip('x')}) AS cs FROM documents WHERE regexp_matches(text, '[一-鿿]')),
          o AS (SELECT doc_id, list_transform(cs, lambda c, i: CASE WHEN i < len(cs) THEN {strip("c || ' ' || substr(cs[i + 1], 1, 50)")} ELSE c END) AS cs FROM c)
          SELECT doc_id, (unnest(range(1, len(cs) + 1)) - 1)::INT AS chunk_no, md5(unnest(cs)) AS chunk FROM o""",
        "assertive_words": f"SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains({TEXT}, '{w}') THEN '{w}' END" for w in '一定 绝对 肯定 100% 必然 毫无疑问 必然导致 必然是 必然发生 必定 百分百'.split())}], lambda x: x IS NOT NULL), '|') AS signals FROM documents",
        "conversation_totals": "SELECT count(*) AS total, count(*) FILTER (v) AS valid, count(*) FILTER (NOT v) AS invalid FROM (SELECT row_id % 7 > 0 AND row_id % 5 > 0 AND question IS NOT NULL AS v FROM sft_row)",
        "rows_outside": "WITH k AS (SELECT row_id, CASE WHEN row_id % 3 > 0 AND coalesce(sample_id, '') <> '' THEN sample_id ELSE coalesce(question, '') END AS k FROM sft_row) SELECT row_id FROM k WHERE k NOT IN (SELECT k FROM k WHERE row_id % 2 = 0)",
        "tail_split": "SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id) > count(*) OVER () - count(*) OVER () // 10 THEN 'validation' ELSE 'train' END AS part FROM sft_row",
        "zipped_slots": "WITH u AS (SELECT source || '#' || unnest(range(1, max_repeats + 1)) AS u FROM mix_target WHERE mix_id = 1 AND max_repeats > 0) SELECT place, u, doc_id FROM (SELECT u, row_number() OVER (ORDER BY u) AS place FROM u) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) USING (place)",
        "decisions": "SELECT item_id, CASE WHEN length(question) < 30 THEN 'short' END AS reason, CASE WHEN length(question) < 30 THEN length(question)::VARCHAR END AS detail, array_to_string(list_sort(list_distinct(['R-2', exam_type, 'R-1'])), '|') AS hit_rules FROM exam_item WHERE exam_type IS NOT NULL",
        "file_lines": "SELECT doc_id, source, n_chars FROM documents",
        "file_splits": "SELECT item_id, exam_subject, split FROM exam_item WHERE split IN ('train', 'val', 'test')",
        "file_tree": "SELECT doc_id, n_chars FROM documents WHERE source IS NOT NULL",
        "file_tolerant": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0",
        "file_array": "SELECT label_variant, question_type FROM question_type_alias",
        "file_tabbed": "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation",
        "file_numbered": "SELECT rn AS line_no, label_variant, question_type FROM (SELECT *, row_number() OVER (ORDER BY label_variant) AS rn FROM question_type_alias) WHERE rn % 2 = 1",
        "file_index": "SELECT coalesce(dept, 'none') AS dept, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
        "file_texts": "SELECT r_name || chr(10) AS text, 1::BIGINT AS n FROM region UNION ALL SELECT 'files', 1 UNION ALL SELECT 'lines', count(*) FROM region",
    }
