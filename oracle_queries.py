"""DuckDB statements for the registered queries.

Verdicts come from the formulas the puzzle tables are derived with, not from
parsing the responses again.
"""

from __future__ import annotations

from abacist.functions.prompts import SYSTEM_TEXT, USER_TEXT
from abacist.functions.text import BLANK

BASE = """
WITH o AS (
  SELECT o_orderkey AS idx, o_custkey AS ck, 1 + o_custkey % 50 AS a, 1 + o_orderkey % 11 AS b,
         1 + o_orderkey % 7 AS c, o_orderkey % 13 AS kind
  FROM orders),
x AS (
  SELECT *, CAST(a AS VARCHAR) AS sa, CAST(b AS VARCHAR) AS sb, CAST(c AS VARCHAR) AS sc,
         a + b * c AS t, CASE WHEN kind = 8 THEN a + b * c + 1 ELSE a + b * c END AS target,
         20 + (idx * 37) % 600 AS response_n_tokens, idx // 1000 AS chunk
  FROM o),
y AS (
  SELECT *, sa || ' + ' || sb || ' * ' || sc AS e, '[' || sa || ', ' || sb || ', ' || sc || ']' AS nums,
         CASE WHEN ck % 2 = 1 THEN sa || '  +  ' || sb || ' * ' || sc
              ELSE sa || ' + ' || sb || ' * ' || sc END AS wide
  FROM x),
z AS (
  SELECT *, CASE kind
      WHEN 0 THEN '<answer>' || e || '</answer>'
      WHEN 1 THEN '<think>try 9 - 9 = 0</think>' || chr(10) || '<answer>' || chr(10) || e || ' = ' || t || chr(10) || '</answer>'
      WHEN 2 THEN '<answer>' || sa || ' - ' || sb || ' - ' || sc || '</answer> <answer>' || e || '</answer>'
      WHEN 3 THEN 'Answer: ' || wide || ' = ' || t
      WHEN 4 THEN 'Here is it' || chr(10) || chr(10) || e || chr(10)
      WHEN 5 THEN '<think>' || e || '</think>'
      WHEN 6 THEN '<answer>' || (a + 1) || ' + ' || sb || ' * ' || sc || '</answer>'
      WHEN 7 THEN '<answer>' || sa || ' + ' || sb || '</answer>'
      WHEN 8 THEN '<answer>' || e || ' = ' || t || '</answer>'
      WHEN 9 THEN '<answer>' || sa || ' / (' || sb || ' - ' || sb || ') + ' || sc || '</answer>'
      WHEN 10 THEN 'I could not find it.'
      WHEN 11 THEN '<answer>' || sa || ' ** ' || sb || ' * ' || sc || '</answer>'
      ELSE '<think>maybe' || chr(10) || 'Answer: ' || e END AS response,
    CASE kind
      WHEN 2 THEN sa || ' - ' || sb || ' - ' || sc
      WHEN 3 THEN wide
      WHEN 5 THEN NULL
      WHEN 6 THEN (a + 1) || ' + ' || sb || ' * ' || sc
      WHEN 7 THEN sa || ' + ' || sb
      WHEN 9 THEN sa || ' / (' || sb || ' - ' || sb || ') + ' || sc
      WHEN 10 THEN NULL
      WHEN 11 THEN sa || ' ** ' || sb || ' * ' || sc
      ELSE e END AS equation,
    CASE WHEN kind IN (5, 10) THEN 'not_extracted' WHEN kind IN (2, 8) THEN 'value'
         WHEN kind IN (6, 7) THEN 'numbers' WHEN kind IN (9, 11) THEN 'processing' ELSE 'ok' END AS reason_code,
    CASE WHEN kind = 2 THEN CAST(a - b - c AS DOUBLE)
         WHEN kind IN (0, 1, 3, 4, 8, 12) THEN CAST(t AS DOUBLE) END AS result
  FROM y),
r AS (
  SELECT *, reason_code = 'ok' AS correct,
    CASE reason_code WHEN 'ok' THEN 'All good'
      WHEN 'not_extracted' THEN 'Failed to extract equation from response'
      WHEN 'value' THEN 'Equation ' || equation || ' != ' || target
      WHEN 'numbers' THEN 'Numbers in equation do not match nums list'
      ELSE 'While ast processing raised Error=' || CASE kind WHEN 9 THEN 'Division by zero'
        ELSE 'Unsupported operator <class ''ast.Pow''>' END END AS reason
  FROM z)
"""

WS = "'" + BLANK + "'"
WS_CLASS = "[" + "".join(rf"\x{{{ord(ch):x}}}" for ch in BLANK) + "]"

CURATED = (
    BASE
    + r""", k AS (
  SELECT *, regexp_replace(equation, '\s+', ' ', 'g') AS equation_norm FROM r WHERE correct),
f AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY list_sort([a, b, c]), target, equation_norm ORDER BY idx) AS rn FROM k)
  WHERE rn = 1)
"""
)

_USER = "'" + USER_TEXT.replace("%s", "' || nums || '", 1).replace("%s", "' || target || '", 1) + "'"
_PROMPT = (
    f"'<|im_start|>system' || chr(10) || '{SYSTEM_TEXT}' || '<|im_end|>' || chr(10) || "
    f"'<|im_start|>user' || chr(10) || {_USER} || '<|im_end|>' || chr(10) || "
    "'<|im_start|>assistant' || chr(10)"
)
_WORDS = (
    r"CAST(len(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}\x{{85}}]')) AS BIGINT)"
)

SFT = (
    CURATED
    + f""", s AS (
  SELECT idx AS train_idx, nums, target, equation_norm, {_USER} AS user_text, {_PROMPT} AS prompt,
         '<answer> ' || equation_norm || ' </answer>' AS completion FROM f),
w AS (
  SELECT *, {_WORDS.format("prompt")} AS prompt_tokens, {_WORDS.format("completion")} AS completion_tokens
  FROM s)
"""
)

_SPLIT = (
    "CASE WHEN row_number() OVER (ORDER BY md5('42:' || idx), idx) <= 200 "
    "THEN 'dev' ELSE 'train' END AS split"
)


def _stats(source: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std,
        CAST(min({m}) AS BIGINT) AS "min", CAST(floor(quantile_cont({m}, 0.5)) AS BIGINT) AS p50,
        CAST(floor(quantile_cont({m}, 0.95)) AS BIGINT) AS p95, CAST(max({m}) AS BIGINT) AS "max"
        FROM {source}"""
        for m in metrics
    )


_SHARES = """CAST(count(equation) AS DOUBLE) / count(*) AS extracted_rate,
  CAST(count_if(correct) AS DOUBLE) / count(*) AS accuracy"""
_COUNTS = """CAST(count(equation) AS BIGINT) AS equation_extracted,
  CAST(count_if(correct) AS BIGINT) AS equation_correct"""
_TOKENS = f"""CAST(count(*) AS BIGINT) AS n_examples, {_COUNTS}, {_SHARES},
  CAST(sum(response_n_tokens) AS DOUBLE) / count(*) AS avg_response_tokens"""
_DEV = """CAST(count_if(correct) AS DOUBLE) / count(*) AS dev_accuracy,
  CAST(count(equation) AS DOUBLE) / count(*) AS dev_extracted_rate,
  CAST(count(*) AS BIGINT) AS n_dev"""

SUBMISSION = (
    BASE
    + """, l AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY idx DESC) AS rn FROM r)
  WHERE rn = 1),
t AS (
  SELECT p_partkey AS id, '  part "' || p_partkey || '", so ' AS note, p_partkey AS pos FROM part UNION ALL
  SELECT s_suppkey, '  supplier "' || s_suppkey || '", so ', s_suppkey + 1000000000000 FROM supplier),
b AS (
  SELECT t.id, t.note, t.pos, coalesce(l.equation, '0') AS equation, l.ck IS NOT NULL AS matched,
         l.equation IS NOT NULL AS extracted, coalesce(l.correct, FALSE) AS valid
  FROM t LEFT JOIN l ON t.id = l.ck)
"""
)

_VERDICT = "SELECT idx, {code} AS reason_code, {ok} AS ok, {reason} AS reason, result FROM r"
_VERIFIED = BASE + _VERDICT.format(
    code="CASE WHEN equation IS NULL THEN 'invalid' ELSE reason_code END",
    ok="correct",
    reason="CASE WHEN equation IS NULL THEN 'Invalid equation' ELSE reason END",
)


# Verdicts by kind of the equations that parsing and rounding make hard.
_HARD = """
WITH o AS (
  SELECT o_orderkey AS idx, o_orderkey % 19 AS kind, 1 + o_custkey % 50 AS a, 1 + o_orderkey % 11 AS b,
         1 + o_orderkey % 7 AS c FROM orders),
v AS (
  SELECT *, CASE kind WHEN 0 THEN a::DOUBLE / b / c WHEN 1 THEN a::DOUBLE / b * b WHEN 2 THEN 2.0 * a
      WHEN 4 THEN b - a - c WHEN 5 THEN a + c WHEN 9 THEN a::DOUBLE / 3 WHEN 10 THEN a + 1
      WHEN 13 THEN a + 1 / 2000000.0::DOUBLE WHEN 14 THEN a + 1 / 500000.0::DOUBLE
      WHEN 15 THEN (12345678901234567 * a + b)::DOUBLE WHEN 16 THEN (12345678901234567 * a + b)::DOUBLE
      WHEN 17 THEN 1e54::DOUBLE WHEN 18 THEN 900719925474099300::DOUBLE / a * b END AS value,
    CASE kind WHEN 0 THEN a // (b * c) WHEN 1 THEN a WHEN 2 THEN 2 * a WHEN 4 THEN b - a - c WHEN 5 THEN a + c
      WHEN 9 THEN a // 3 WHEN 10 THEN a + 1 WHEN 15 THEN 12345678901234567 * a + b
      WHEN 16 THEN 12345678901234567 * a + b + 1 WHEN 17 THEN 0 WHEN 18 THEN 0 ELSE a END AS target,
    CASE kind WHEN 0 THEN a || ' / ' || b || ' / ' || c WHEN 9 THEN a || ' / 3'
      WHEN 14 THEN a || ' + 1 / 500000' WHEN 16 THEN '12345678901234567 * ' || a || ' + ' || b
      WHEN 17 THEN '999999999999999999 * 999999999999999999 * 999999999999999999 - ' || a
      WHEN 18 THEN '900719925474099300 / ' || a || ' * ' || b END AS equation
  FROM o),
w AS (
  SELECT *, CASE WHEN kind IN (3, 6, 11) THEN 'processing' WHEN kind IN (7, 8, 12) THEN 'syntax'
      WHEN kind <> 16 AND abs(value - target) <= 1e-6 THEN 'ok' ELSE 'value' END AS reason_code FROM v)
SELECT idx, reason_code, reason_code = 'ok' AS ok,
  CASE reason_code WHEN 'ok' THEN 'All good' WHEN 'syntax' THEN 'SyntaxError=invalid syntax'
    WHEN 'value' THEN 'Equation ' || equation || ' != ' || target
    ELSE 'While ast processing raised Error=' || CASE kind WHEN 3 THEN 'Invalid constant type (float) 2.5'
      WHEN 6 THEN 'Unsupported ast node <class ''ast.Name''>'
      ELSE 'Unsupported operator <class ''ast.FloorDiv''>' END END AS reason,
  round(value, 9) AS result
FROM w
"""


def statements() -> dict[str, str]:
    problems = BASE + "SELECT idx, nums, target FROM r"
    splits = BASE + f"SELECT idx, nums, target, {_SPLIT} FROM r"
    scored = BASE + "SELECT idx, equation, correct, reason FROM r"
    tokens = BASE + f"SELECT {_TOKENS} FROM r"
    stored_sft = SFT + (
        "SELECT train_idx, '{0}' AS system_text, user_text, completion, nums, target, "
        "prompt_tokens, completion_tokens FROM w".format(SYSTEM_TEXT)
    )
    template = SUBMISSION + "SELECT 'test_' || id AS id, '1 + 1' AS equation, note FROM t"
    job = """, j AS (
      SELECT 'c' || t.id AS id, t.note, l.ck IS NOT NULL AND l.idx % 17 <> 0 AS answered, l.*
      FROM t LEFT JOIN l ON t.id = l.ck)
    """
    return {
        # sources and sinks
        "scan_problems": problems,
        "scan_splits": splits,
        "scan_chunks": BASE + "SELECT idx AS position, idx, response FROM r",
        "scan_test_csv": BASE
        + """SELECT 'test_' || idx AS id, nums, target, ' say "' || idx || '", then, ' AS note FROM r""",
        "scan_template": template,
        "roundtrip_splits": splits,
        "roundtrip_results": scored,
        "results_json": scored,
        "summary_json": tokens,
        "roundtrip_submission": SUBMISSION
        + "SELECT row_number() OVER (ORDER BY pos) - 1 AS position, id, equation, note FROM b",
        "sft_full": stored_sft,
        "sft_small": stored_sft + " ORDER BY md5('42:' || train_idx), train_idx LIMIT 2000",
        # projections and filters
        "build_prompt": BASE
        + f"SELECT idx, '{SYSTEM_TEXT}' AS system_text, {_USER} AS user_text FROM r",
        "prompt_passthrough": f"""{BASE}
            SELECT r.idx, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE {_USER} END AS user_text,
                   CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS n_messages
            FROM r JOIN orders ON o_orderkey = r.idx""",
        "render_chat": """SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text ||
            '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS rendered
            FROM conversations GROUP BY conv_id""",
        "render_chat_folded": """WITH s AS (
              SELECT conv_id, coalesce(string_agg(text || chr(10) || chr(10), '' ORDER BY turn)
                FILTER (WHERE role = 'system'), '') AS opening,
                min(turn) FILTER (WHERE role = 'user') AS first_user FROM conversations GROUP BY conv_id)
            SELECT conv_id, '<bos>' || coalesce(string_agg('<start_of_turn>' ||
              CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) ||
              CASE WHEN turn = first_user THEN opening ELSE '' END || text || '<end_of_turn>' || chr(10),
              '' ORDER BY turn) FILTER (WHERE role <> 'system'), '') || '<start_of_turn>model' || chr(10) AS rendered
            FROM conversations JOIN s USING (conv_id) GROUP BY conv_id""",
        "build_sft_rows": SFT
        + "SELECT train_idx, equation_norm, completion, prompt_tokens, completion_tokens FROM w",
        "render_sft": SFT + "SELECT prompt, completion || '<eos>' AS completion FROM w",
        "score_responses": BASE
        + "SELECT idx, nums, target, equation, correct, reason_code, reason, result FROM r",
        "filter_correct": BASE + "SELECT idx, equation FROM r WHERE correct",
        "chunk_slice": BASE + "SELECT idx, nums, target FROM r WHERE idx >= 1000",
        "global_index": BASE
        + "SELECT idx, 999 + row_number() OVER (ORDER BY target, idx) AS position FROM r",
        "dev_samples": BASE
        + "SELECT idx, nums, target, left(response, 300) AS response, equation FROM r ORDER BY idx LIMIT 10",
        "response_preview": f"""{BASE} SELECT idx, CASE WHEN contains(response, '</think>')
            THEN left(trim(substr(response, strpos(response, '</think>') + 8), {WS}), 400)
            ELSE left(response, 400) END AS preview FROM r""",
        "budget_flags": SFT
        + """SELECT train_idx, prompt_tokens + completion_tokens <= 150 AS fits_budget,
             prompt_tokens > 138 AS was_truncated FROM w""",
        # joins
        "join_responses": BASE + "SELECT idx, nums, target, response FROM r",
        "build_submission": SUBMISSION + "SELECT * FROM b",
        "matched_ids": SUBMISSION + "SELECT id, note FROM t WHERE id IN (SELECT ck FROM r)",
        "missing_ids": SUBMISSION + "SELECT id, note FROM t WHERE id NOT IN (SELECT ck FROM r)",
        "make_splits": BASE + f"SELECT idx, {_SPLIT} FROM r",
        # summaries
        "eval_summary_chars": BASE
        + f"""SELECT CAST(count(*) AS BIGINT) AS dataset_len, {_COUNTS}, {_SHARES},
              CAST(sum(length(response)) AS DOUBLE) / count(*) AS avg_response_chars FROM r""",
        "eval_summary_tokens": tokens,
        "dev_metrics": BASE + f"SELECT {_DEV} FROM r",
        "submission_stats": SUBMISSION
        + """SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count_if(extracted) AS BIGINT) AS n_extracted,
             CAST(count_if(NOT extracted) AS BIGINT) AS n_fallback,
             CAST(count_if(extracted) AS DOUBLE) / count(*) AS extracted_rate,
             CAST(count_if(valid) AS BIGINT) AS n_valid_by_local_validator,
             CAST(count_if(valid) AS DOUBLE) / count(*) AS expected_accuracy FROM b""",
        "length_stats": "WITH d AS (SELECT length(text) AS chars, "
        + _WORDS.format("text")
        + " AS words FROM documents) "
        + _stats("d", ["chars", "words"]),
        "curation_funnel": CURATED
        + """SELECT n_raw, n_correct, n_after_dedup, CAST(n_correct AS DOUBLE) / n_raw AS correct_share,
             n_correct - n_after_dedup AS n_removed FROM (SELECT
             (SELECT count(*) FROM r) AS n_raw, (SELECT count(*) FROM k) AS n_correct,
             (SELECT count(*) FROM f) AS n_after_dedup)""",
        "throughput": BASE
        + """SELECT run, n_examples, total_tokens, elapsed_s, total_tokens / elapsed_s AS tokens_per_s,
             elapsed_s / n_examples AS s_per_example, target_examples,
             elapsed_s / n_examples * target_examples / 3600 AS projected_hours
             FROM (SELECT chunk AS run, CAST(count(*) AS BIGINT) AS n_examples,
                     CAST(sum(response_n_tokens) AS BIGINT) AS total_tokens,
                     CAST(60 + chunk % 7 AS DOUBLE) AS elapsed_s FROM r GROUP BY chunk),
                  (SELECT CAST(unnest([1000, 5000, 10000, 20000]) AS BIGINT) AS target_examples)""",
        "chunk_rollup": BASE
        + f"""SELECT chunk, {_TOKENS}, min(idx) AS start_idx, max(idx) + 1 AS end_idx,
              CAST(grouping(chunk) AS BIGINT) AS is_total FROM r GROUP BY ROLLUP (chunk)""",
        "metrics_by_step": BASE
        + f""", d AS (SELECT * FROM (SELECT *, {_SPLIT} FROM r) WHERE split = 'dev' ORDER BY idx LIMIT 100)
              SELECT step, {_DEV} FROM (SELECT *, 25 * (idx % 5) AS step FROM d)
              WHERE step IN (50, 100) GROUP BY step""",
        "metrics_history": BASE
        + f""", d AS (SELECT *, 25 * (idx % 5) AS step FROM (SELECT *, {_SPLIT} FROM r) WHERE split = 'dev')
              SELECT step, {_DEV}, CAST(CASE WHEN step <= 50 THEN 1 ELSE 2 END AS BIGINT) AS run
              FROM d WHERE step > 0 GROUP BY step""",
        "samples_by_step": BASE
        + """SELECT 25 * (idx % 5) AS step, idx, nums, target, left(response, 300) AS response, equation FROM r
             QUALIFY row_number() OVER (PARTITION BY idx % 5 ORDER BY idx) <= 5""",
        "lengths_by_chunk": BASE
        + """SELECT 'response_n_tokens' AS metric, CAST(count(*) AS BIGINT) AS n, round(avg(response_n_tokens), 6) AS mean,
             round(stddev_samp(response_n_tokens), 6) AS std, min(response_n_tokens) AS "min",
             max(response_n_tokens) AS "max", TRUE AS p50_near, TRUE AS p95_near FROM r""",
        "funnel_by_chunk": BASE
        + """SELECT CAST(count(*) AS BIGINT) AS n_raw, CAST(count_if(correct) AS BIGINT) AS n_correct,
             CAST(count_if(correct) AS DOUBLE) / count(*) AS correct_share, TRUE AS kept_near FROM r""",
        "reason_histogram": BASE
        + """SELECT reason_code, CAST(count(*) AS BIGINT) AS n,
             CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM r) AS share FROM r GROUP BY reason_code""",
        "token_histogram": BASE
        + """SELECT response_n_tokens // 100 * 100 AS bucket_from, correct, CAST(count(*) AS BIGINT) AS n
             FROM r GROUP BY ALL""",
        "cap_share": BASE
        + """SELECT CAST(count(*) AS BIGINT) AS n,
             CAST(count_if(response_n_tokens >= 600) AS BIGINT) AS n_capped,
             CAST(count_if(response_n_tokens >= 600) AS DOUBLE) / count(*) AS capped_share,
             CAST(count_if(correct AND response_n_tokens < 300) AS BIGINT) AS n_correct_short,
             CAST(count_if(correct AND response_n_tokens < 300) AS DOUBLE) / count_if(correct)
               AS correct_short_share FROM r""",
        "contract_checks": BASE
        + """SELECT CAST(count(*) AS BIGINT) AS n_results, CAST(count(*) - count(ck) AS BIGINT) AS n_missing_id,
             CAST(count(*) - count(equation) AS BIGINT) AS n_missing_equation FROM r""",
        # dedup, order, sampling, union
        "dedup_keep_first": CURATED + "SELECT idx, nums, target, equation_norm FROM f",
        "last_wins": SUBMISSION + "SELECT ck AS id, idx, equation FROM l",
        "seeded_shuffle": BASE
        + "SELECT idx, row_number() OVER (ORDER BY md5('42:' || idx), idx) - 1 AS position FROM r",
        "sample_exact_n": BASE
        + "SELECT idx, nums, target FROM r ORDER BY md5('42:' || idx), idx LIMIT 2000",
        "union_chunks": BASE
        + """SELECT idx, equation, correct FROM r UNION ALL
             SELECT idx, equation, CAST(NULL AS BOOLEAN) FROM r""",
        # text
        "extract_equation": BASE + "SELECT idx, equation FROM r",
        "strip_think": f"""{BASE} SELECT idx, list_last(string_split(response, '</think>')) AS stripped,
            coalesce(nullif(trim(list_last(string_split(response, '</think>')), {WS}), ''),
                     trim(response, {WS})) AS space FROM r""",
        "tag_candidates": BASE
        + r"""SELECT idx, array_to_string(regexp_extract_all(response,
              '(?s)<(?:answer|Answer)>\s*(.*?)\s*</(?:answer|Answer)>', 1), '|') AS found FROM r""",
        "label_candidates": BASE
        + r"""SELECT idx, array_to_string(regexp_extract_all(response,
              '(?:answer|Answer)\s*:\s*([^\n]+)', 1), '|') AS found FROM r""",
        "last_line": f"""SELECT doc_id, list_last(list_filter(list_transform(
            string_split(text, chr(10)), lambda s: trim(s, {WS})), lambda s: s <> '')) AS line FROM documents""",
        "lhs_of_equals": f"SELECT doc_id, trim(string_split(text, '=')[1], {WS}) AS lhs FROM documents",
        "candidate_filter": r"""SELECT doc_id, regexp_matches(text, '[*/+\-]') AND
            regexp_matches(text, '\p{Nd}') AS is_candidate FROM documents""",
        "normalize_equation": f"""SELECT doc_id, CASE WHEN text <> '' THEN regexp_replace(
            trim(string_split(text, '=')[1], {WS}), '{WS_CLASS}+', ' ', 'g') END AS norm FROM documents""",
        "fallback_equation": BASE + "SELECT idx, coalesce(equation, '0') AS emitted FROM r",
        "token_counts": "SELECT doc_id, length(text) AS chars, "
        + _WORDS.format("text")
        + " AS words FROM documents",
        # verification
        "verify_equations": _VERIFIED,
        "verify_residual": _VERIFIED + " WHERE kind = 11",
        "verify_hard": _HARD,
        "extract_documents": "SELECT doc_id, doc_id || ' + 7' AS equation FROM documents",
        "sql_verify": BASE
        + """SELECT idx, CASE WHEN equation IS NULL THEN 'invalid' ELSE reason_code END AS code,
             correct AS ok, result FROM r""",
        "sql_view": BASE
        + """SELECT idx, CASE WHEN equation IS NULL THEN 'invalid' ELSE reason_code END AS code,
             correct AS ok, result FROM r""",
        # Left to the host grammar: floats, nesting beyond eight, names, blanks beyond ASCII, long texts, // and 01, long integers.
        "sql_verify_plain": _HARD.rsplit("SELECT idx", 1)[0]
        + """SELECT idx, CASE WHEN kind IN (2, 3, 5, 6, 7, 8, 10, 11, 12, 15, 16, 17, 18) THEN 'other' ELSE reason_code END AS code,
             kind NOT IN (2, 3, 5, 6, 7, 8, 10, 11, 12, 15, 16, 17, 18) AND reason_code = 'ok' AS ok,
             CASE WHEN kind NOT IN (2, 3, 5, 6, 7, 8, 10, 11, 12, 15, 16, 17, 18) THEN round(value, 9) END AS result FROM w""",
        "sql_function": BASE
        + "SELECT idx, reason_code AS code, correct AS ok, result FROM r WHERE kind = 11",
        "parse_status": BASE + "SELECT idx, kind NOT IN (1, 4, 5, 10, 12) AS parses FROM r",
        "equation_numbers": BASE
        + """SELECT idx, '[' || array_to_string(regexp_extract_all(equation, '[0-9]+'), ', ') || ']'
             AS numbers FROM r WHERE equation IS NOT NULL""",
        "evaluate_native": BASE
        + """SELECT idx, CASE kind WHEN 2 THEN a - b - c WHEN 6 THEN a + 1 + b * c WHEN 7 THEN a + b
             WHEN 9 THEN NULL ELSE t END::DOUBLE AS value, kind = 9 AS zero_division
             FROM r WHERE kind NOT IN (5, 10, 11)""",
        "number_match": BASE
        + """SELECT idx, kind NOT IN (6, 7, 9) AS same FROM r WHERE equation IS NOT NULL""",
        "tolerance_check": BASE
        + """SELECT idx, abs(CASE kind WHEN 2 THEN a - b - c WHEN 6 THEN a + 1 + b * c WHEN 7 THEN a + b
             ELSE t END - target) <= 1e-6 AS within FROM r
             WHERE kind NOT IN (5, 9, 10, 11)""",
        # jobs
        "score_chunk": BASE
        + """SELECT idx - 1000 AS idx, idx AS train_idx, equation, correct, reason FROM r
             WHERE idx >= 1000""",
        "score_chunk_summary": BASE
        + f"""SELECT {_TOKENS}, 1000 AS start_idx, 1000000000001000 AS end_idx, CAST(12.5 AS DOUBLE) AS elapsed_s,
              'teacher' AS model_id FROM r WHERE idx >= 1000""",
        "results_by_chunk": BASE
        + "SELECT chunk, idx % 1000 AS idx, idx AS train_idx, response, equation, correct, reason FROM r",
        "summaries_by_chunk": BASE
        + f"""SELECT chunk, {_TOKENS}, min(idx) AS start_idx, max(idx) + 1 AS end_idx FROM r GROUP BY chunk""",
        "results_document": scored,
        "generate_chunk": BASE
        + """SELECT idx - 1000 AS idx, idx AS train_idx, '<answer>' || sa || ' + ' || sa || '</answer>' AS response,
             sa || ' + ' || sa AS equation, FALSE AS correct,
             'Numbers in equation do not match nums list' AS reason FROM r WHERE idx >= 1000""",
        "curate_summary": SFT
        + """SELECT n_raw, n_correct, n_after_dedup, CAST(n_correct AS DOUBLE) / n_raw AS correct_share,
             n_correct - n_after_dedup AS n_removed, 'words' AS tokenizer,
             (SELECT completion FROM w ORDER BY train_idx, completion LIMIT 1) AS example_completion FROM (SELECT
             (SELECT count(*) FROM r) AS n_raw, (SELECT count(*) FROM k) AS n_correct,
             (SELECT count(*) FROM f) AS n_after_dedup)""",
        "render_training_set": SFT
        + f"""SELECT '<bos><start_of_turn>user' || chr(10) || '{SYSTEM_TEXT}' || chr(10) || chr(10) || user_text
             || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt,
             completion || '<eos>' AS completion FROM w""",
        "make_submission": SUBMISSION
        + job
        + "SELECT id, note, CASE WHEN answered THEN coalesce(equation, '0') ELSE '0' END AS equation FROM j",
        "make_submission_stats": SUBMISSION
        + job
        + """, k AS (SELECT *, answered AND equation IS NOT NULL AS found, answered AND correct AS good FROM j)
             SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count_if(found) AS BIGINT) AS n_extracted,
             CAST(count_if(NOT found) AS BIGINT) AS n_fallback,
             CAST(count_if(found) AS DOUBLE) / count(*) AS extracted_rate,
             CAST(count_if(good) AS BIGINT) AS n_valid_by_local_validator,
             CAST(count_if(good) AS DOUBLE) / count(*) AS expected_accuracy, 'student' AS model_path FROM k""",
        "curate_sft": SFT
        + ", v AS (SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM w) "
        + _stats("v", ["prompt_tokens", "completion_tokens", "total_tokens"]),
        "evaluate_responses": BASE
        + """SELECT idx AS iteration, nums, target, response AS model_output, equation, correct, reason
             FROM r""",
        "stream_score": BASE + "SELECT idx, equation, correct, reason FROM r",
        "stream_counters": BASE
        + f"SELECT chunk, CAST(count(*) AS BIGINT) AS n_examples, {_COUNTS} FROM r GROUP BY chunk",
        "map_batches": BASE + f"SELECT idx, CAST(length({_PROMPT}) AS VARCHAR) AS response FROM r",
        "map_by_length": BASE + f"SELECT idx, CAST(length({_PROMPT}) AS VARCHAR) AS response FROM r",
    }
