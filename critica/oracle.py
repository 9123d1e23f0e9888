"""DuckDB SQL oracles, one per registered query (same column names as the Spark side).

These re-state each operator's semantics in plain SQL over the driver tables; they are the
correctness gate, not part of the library. Regex classes are spelled out so Java regex and
RE2 agree (see functions.common / functions.text). DuckDB lambdas use ``lambda x: ...``.
"""

from __future__ import annotations

from critica import oracle_texts as pr

# The operators' fixed values, written out again: a wrong one in the library shows as a difference.
_WS = r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CLASS, NON_WS_CLASS = f"[{_WS}]", f"[^{_WS}]"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_SPLIT = "[.!?]+"
STRUCTURE = (f"(?m)(^{WS_CLASS}*[-*•]{WS_CLASS}|^{WS_CLASS}*" + r"\p{Nd}+[.)]" + f"{WS_CLASS}|^#+{WS_CLASS}" + r"|\*\*[^\n]+?\*\*)")
SCRIPT_STYLE, TAG = "(?is)<(script|style)[^>]*>.*?</(script|style)>", "<[^>]+>"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
FENCE = "(?s)```(?:json)?" + WS_CLASS + "*(.*?)```"
JSON_OBJECT = r"(?s)\{.*\}"
FALLBACK_ACTION = "Critic failed to parse structured feedback — rewrite answer with clearer, more precise language."


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def RND(x: str, d: int) -> str:
    return f"(floor(({x}) * {D(float(10 ** d))} + {D(0.5)}) / {D(float(10 ** d))})"


def WORDS(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {_q(WORD)})"


def SENTS(x: str) -> str:
    return (f"list_filter(regexp_split_to_array({x}, {_q(SENTENCE_SPLIT)}), "
            f"lambda s: regexp_matches(s, {_q(NON_WS_CLASS)}))")


def USTRIP(x: str) -> str:
    return f"regexp_replace({x}, {_q('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def STRUCT(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {_q(STRUCTURE)}) THEN {D(1.0)} ELSE {D(0.0)} END)"


def KEYWORDS(q: str) -> str:
    return f"list_distinct(list_filter({WORDS(q)}, lambda t: length(t) >= 4))"


def COVERAGE(words: str, q: str) -> str:
    kw = KEYWORDS(q)
    return (f"(CASE WHEN {q} IS NULL OR {q} = '' THEN {D(0.5)} "
            f"WHEN len({kw}) = 0 THEN {D(0.5)} "
            f"ELSE len(list_filter({kw}, lambda k: list_contains({words}, k))) / len({kw}) END)")


def LEX(words: str) -> str:
    return f"(CASE WHEN len({words}) > 0 THEN len(list_distinct({words})) / len({words}) ELSE {D(0.0)} END)"


def COMPOSITE(nw: str, st: str, lex: str, cov: str, asl: str, mn=30, mx=300) -> str:
    length = f"least({nw} / {D(float(mx))}, {D(1.0)})"
    length = f"(CASE WHEN {nw} < {mn} THEN {length} * ({nw} / {D(float(mn))}) ELSE {length} END)"
    density = f"({D(1.0)} - least(abs({asl} - {D(15.0)}) / {D(15.0)}, {D(1.0)}))"
    raw = (f"(({D(0.25)} * {length} + {D(0.25)} * {lex} + {D(0.3)} * {cov} + {D(0.2)} * {st}) "
           f"* {density})")
    return f"({raw} * {D(10.0)})"


def METRICS_CTE(src: str, answer: str, query: str | None, keep: str) -> str:
    """A CTE chain computing the eight M9 columns for table ``src``; yields ``m_final``."""
    q = query if query else "CAST(NULL AS VARCHAR)"
    return f"""
m_s1 AS (SELECT {keep}, {answer} AS __a, {WORDS(answer)} AS __w,
                len({SENTS(answer)}) AS __ns, {STRUCT(answer)} AS __st, {q} AS __q FROM {src}),
m_s2 AS (SELECT *, len(__w) AS __nw, greatest(__ns, 1) AS __nsent FROM m_s1),
m_s3 AS (SELECT *, __nw / __nsent AS __asl, {LEX('__w')} AS __lex, {COVERAGE('__w', '__q')} AS __cov FROM m_s2),
m_final AS (SELECT {keep},
    CAST(length(__a) AS BIGINT) AS char_count,
    CAST(__nw AS BIGINT) AS word_count,
    CAST(__nsent AS BIGINT) AS sentence_count,
    __st AS has_structure,
    {RND('__asl', 2)} AS avg_sentence_length,
    {RND('__lex', 3)} AS lexical_diversity,
    {RND('__cov', 3)} AS coverage_score,
    {RND(RND(COMPOSITE('__nw', '__st', '__lex', '__cov', '__asl'), 2), 2)} AS composite_score
  FROM m_s3)"""


METRICS = ["char_count", "word_count", "sentence_count", "has_structure", "avg_sentence_length", "lexical_diversity",
           "coverage_score", "composite_score"]

QA_PAIRS = """qa AS (
  SELECT conv_id, turn, text AS query, next_text AS answer FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
  WHERE role = 'user' AND next_role = 'assistant')"""


def metrics_sql() -> dict[str, str]:
    m_qa = METRICS_CTE("qa", "answer", "query", "conv_id, turn")
    m_doc = METRICS_CTE("documents", "text", None, "doc_id")
    m10 = f"""
WITH its AS (SELECT conv_id AS run_id, turn AS iteration, text AS answer FROM conversations WHERE role = 'assistant'),
qs AS (SELECT conv_id AS run_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
src AS (SELECT its.run_id, its.iteration, its.answer, qs.query FROM its JOIN qs ON its.run_id = qs.run_id),
{METRICS_CTE('src', 'answer', 'query', 'run_id, iteration')}"""
    out = {
        "s1_read_queries": f"""
WITH lines AS (SELECT doc_id, unnest(p) AS value, generate_subscripts(p, 1) - 1 AS line_no
               FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
SELECT doc_id, line_no, {USTRIP('value')} AS query FROM lines
WHERE regexp_matches(value, {_q(NON_WS_CLASS)})""",
        "s1_read_queries_file": f"""WITH {QA_PAIRS}, l AS (SELECT {USTRIP('unnest(string_split(query, chr(10)))')} AS query FROM qa)
SELECT query, count(*) AS n FROM l WHERE query <> '' GROUP BY query""",
        "s3_cap_samples": "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER () AS r FROM documents) WHERE r <= 100",
        "s6_qa_pairs": f"WITH {QA_PAIRS} SELECT conv_id, turn, query, answer FROM qa",
        "m1_tokens": f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
       array_to_string(w, ' ') AS tokens
FROM (SELECT doc_id, {WORDS('text')} AS w FROM documents)""",
        "m2_sentences": f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences,
       array_to_string(list_transform(s, lambda x: {USTRIP('x')}), '|') AS sentences
FROM (SELECT doc_id, {SENTS('text')} AS s FROM documents)""",
        "m3_counts": f"WITH {m_doc} SELECT doc_id, char_count, word_count, sentence_count FROM m_final",
        "m4_has_structure": f"SELECT doc_id, {STRUCT('text')} AS has_structure FROM documents",
        "m5_avg_sentence_length": f"WITH {m_doc} SELECT doc_id, avg_sentence_length FROM m_final",
        "m6_lexical_diversity": f"WITH {m_doc} SELECT doc_id, lexical_diversity FROM m_final",
        "m7_coverage": f"WITH {QA_PAIRS}, {m_qa} SELECT conv_id, turn, coverage_score FROM m_final",
        "m8_composite": f"WITH {QA_PAIRS}, {m_qa} SELECT conv_id, turn, composite_score FROM m_final",
        "m9_evaluate_answer": f"WITH {QA_PAIRS}, {m_qa} SELECT * FROM m_final",
        "m10_iteration_scores": f"""{m10} SELECT run_id, iteration, composite_score FROM m_final""",
        "m10_evaluate_pipeline": f"""{m10},
agg AS (SELECT run_id, {", ".join(f"arg_min({m}, iteration) AS initial_{m}, arg_max({m}, iteration) AS final_{m}" for m in METRICS)},
               count(*) AS iterations_run FROM m_final GROUP BY run_id),
fin AS (SELECT conv_id AS run_id, arg_max(role, turn) = 'assistant' AS converged FROM conversations GROUP BY conv_id)
SELECT agg.*, {RND('final_composite_score - initial_composite_score', 2)} AS score_delta, fin.converged
FROM agg JOIN fin USING (run_id)""",
        "flagship_composite_by_turn": f"""
WITH {QA_PAIRS}, {m_qa}
SELECT turn, count(*) AS n_pairs,
       CAST(sum(CAST(composite_score AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_composite,
       max(composite_score) AS max_composite FROM m_final GROUP BY turn""",
    }
    return out


# ---------------------------------------------------------------- critic fixture
def _band(x: str) -> str:
    return (f"(CASE WHEN {x} >= 8.5 THEN 'excellent' WHEN {x} >= 6.5 THEN 'good' "
            f"WHEN {x} >= 4.0 THEN 'acceptable' ELSE 'poor' END)")


def _rank(x: str) -> str:
    return f"(CASE {x} WHEN 'poor' THEN 0 WHEN 'acceptable' THEN 1 WHEN 'good' THEN 2 WHEN 'excellent' THEN 3 END)"


def _joined(prefix: str, n: str) -> str:
    return f"array_to_string(list_transform(range(1, {n} + 1), lambda k: '{prefix} ' || k || ' of doc ' || doc_id), '|')"


def critic_expected_cte() -> str:
    """Expected parse of every fixture reply, computed from doc_id (no parser)."""
    from critica.sources.fixtures import (N_ACTIONS, N_FACTUAL, N_HALLUCINATIONS, N_LOGICAL,
                                          N_MISSING)
    fb = _q(FALLBACK_ACTION)
    return f"""
cx_base AS (
  SELECT doc_id, n_chars, {N_HALLUCINATIONS} AS h, {N_FACTUAL} AS f, {N_LOGICAL} AS l,
         {N_MISSING} AS m, {N_ACTIONS} AS na, doc_id % 5 = 4 AS bad,
         (n_chars % 101) / {D(10.0)} AS raw,
         CASE WHEN doc_id % 3 = 0 THEN {D(0.5)} ELSE least((doc_id % 13) / {D(10.0)}, {D(1.0)}) END AS conf,
         CASE doc_id % 8 WHEN 0 THEN 'poor' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'good'
              WHEN 3 THEN 'excellent' WHEN 4 THEN 'poor' WHEN 5 THEN 'good' ELSE NULL END AS v_in
  FROM documents),
cx_pen AS (
  SELECT *, greatest({D(0.0)}, raw - ({D(0.0)} + least(h * {D(2.0)}, {D(5.0)}) + least(f * {D(1.5)}, {D(4.0)})
         + least(l * {D(1.0)}, {D(3.0)}) + least(m * {D(0.5)}, {D(2.0)}))) AS p FROM cx_base),
cx_v AS (
  SELECT *, CASE WHEN v_in IS NULL THEN {_band('p')}
                 WHEN abs({_rank('v_in')} - {_rank(_band('p'))}) > 1 THEN {_band('p')}
                 ELSE v_in END AS v_out FROM cx_pen),
cx AS (
  SELECT doc_id,
    CASE WHEN bad THEN {D(3.0)} ELSE {RND('p', 2)} END AS score,
    CASE WHEN bad THEN {D(3.0)} ELSE {RND('raw', 2)} END AS raw_llm_score,
    CASE WHEN bad THEN {D(0.2)} ELSE {RND('conf', 3)} END AS confidence,
    CASE WHEN bad THEN 'poor' ELSE v_out END AS verdict,
    NOT bad AS parse_ok,
    CASE WHEN bad THEN 0 ELSE f END AS n_factual_errors,
    CASE WHEN bad THEN 0 ELSE h END AS n_hallucinations,
    CASE WHEN bad THEN 0 ELSE m END AS n_missing_concepts,
    CASE WHEN bad THEN 0 ELSE l END AS n_logical_flaws,
    CASE WHEN bad THEN 1 ELSE na + 1 END AS n_improvement_actions,
    CASE WHEN bad THEN '' ELSE {_joined('factual error', 'f')} END AS factual_errors,
    CASE WHEN bad THEN '' ELSE {_joined('hallucination', 'h')} END AS hallucinations,
    CASE WHEN bad THEN '' ELSE {_joined('missing concept', 'm')} END AS missing_concepts,
    CASE WHEN bad THEN '' ELSE {_joined('logical flaw', 'l')} END AS logical_flaws,
    CASE WHEN bad THEN {fb}
         ELSE array_to_string(list_append(list_transform(range(1, na + 1),
              lambda k: 'action ' || k || ' of doc ' || doc_id), '42'), '|') END AS improvement_actions
  FROM cx_v)"""


def critic_sql() -> dict[str, str]:
    from critica.sources.fixtures import critic_replies_sql
    raw = f"WITH r AS ({critic_replies_sql()})"
    strip = USTRIP(f"regexp_replace(raw_response, {_q(FENCE)}, '\\1', 'g')")
    cte = "WITH " + critic_expected_cte()
    fb = _q(FALLBACK_ACTION)
    issues = f"""{cte},
cats AS (
  SELECT doc_id, 'hallucinations' AS category, '[!]' AS marker, h AS n, 'hallucination' AS prefix, bad FROM cx_base
  UNION ALL SELECT doc_id, 'factual_errors', '[x]', f, 'factual error', bad FROM cx_base
  UNION ALL SELECT doc_id, 'logical_flaws', '[~]', l, 'logical flaw', bad FROM cx_base
  UNION ALL SELECT doc_id, 'missing_concepts', '[ ]', m, 'missing concept', bad FROM cx_base
  UNION ALL SELECT doc_id, 'improvement_actions', '>>', na, 'action', bad FROM cx_base),
il AS (
  SELECT doc_id, category, CAST(k AS BIGINT) AS position, marker, prefix || ' ' || k || ' of doc ' || doc_id AS item
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM cats WHERE NOT bad)
  UNION ALL SELECT doc_id, 'improvement_actions', na + 1, '>>', '42' FROM cx_base WHERE NOT bad
  UNION ALL SELECT doc_id, 'improvement_actions', 1, '>>', {fb} FROM cx_base WHERE bad)"""
    return {
        "c1_strip_fences": f"{raw} SELECT doc_id, {strip} AS stripped FROM r",
        "c2_extract_json_object": f"""{raw}, s AS (SELECT doc_id, {strip} AS t FROM r)
SELECT doc_id, coalesce(nullif(regexp_extract(t, {_q(JSON_OBJECT)}, 0), ''), t) AS extracted FROM s""",
        "c3_parse_feedback": f"""{cte} SELECT doc_id, score, raw_llm_score, confidence, verdict, parse_ok,
  CAST(n_factual_errors AS BIGINT) AS n_factual_errors, CAST(n_hallucinations AS BIGINT) AS n_hallucinations,
  CAST(n_missing_concepts AS BIGINT) AS n_missing_concepts, CAST(n_logical_flaws AS BIGINT) AS n_logical_flaws,
  CAST(n_improvement_actions AS BIGINT) AS n_improvement_actions FROM cx""",
        "c4_safe_list": f"""{cte} SELECT doc_id, factual_errors, hallucinations, missing_concepts, logical_flaws,
  improvement_actions FROM cx""",
        "c5_safe_float": f"{cte} SELECT doc_id, raw_llm_score, confidence FROM cx",
        "c6_apply_penalties": f"{cte} SELECT doc_id, score FROM cx",
        "c7_normalize_verdict": f"{cte} SELECT doc_id, verdict FROM cx",
        "c8_fallback_feedback": f"""{cte} SELECT doc_id, score, confidence, verdict, improvement_actions
FROM cx WHERE NOT parse_ok""",
        "c9_verdict_from_score": f"{cte} SELECT doc_id, {_band('score')} AS score_band FROM cx",
        "c10_issue_flags": f"""{cte} SELECT doc_id, n_hallucinations > 0 AS has_hallucinations,
  (n_hallucinations > 0 OR n_factual_errors > 0) AS has_critical_issues,
  CAST(n_factual_errors + n_hallucinations + n_logical_flaws + n_missing_concepts AS BIGINT) AS total_issue_count FROM cx""",
        "c11_issues_long": f"{issues} SELECT doc_id, category, position, marker, item FROM il",
        "c12_judge_parse": f"""
WITH j AS (SELECT doc_id, n_chars, doc_id % 3 = 2 OR doc_id % 7 = 5 AS bad FROM documents)
SELECT doc_id,
  CASE WHEN bad THEN {D(5.0)} ELSE least((n_chars % 121) / {D(10.0)}, {D(10.0)}) END AS factual_accuracy,
  CASE WHEN bad THEN false ELSE doc_id % 4 IN (0, 2) END AS hallucinations_detected,
  NOT bad AS parse_ok FROM j""",
        "c13_critique_json_parse_raw": """
SELECT doc_id, doc_id % 5 = 4 AS is_raw,
  CAST(CASE WHEN doc_id % 5 = 4 THEN 1 WHEN doc_id % 3 = 0 THEN 7 ELSE 8 END AS BIGINT) AS n_keys FROM documents""",
        "f1_quality_met": f"""{cte} SELECT doc_id, (n_hallucinations = 0 AND n_factual_errors = 0
  AND score >= 7.0 AND verdict IN ('good', 'excellent')) AS quality_met FROM cx""",
        "f2_needs_grounding": f"""{cte} SELECT doc_id, (n_hallucinations > 0 OR n_factual_errors > 0) AS needs_grounding FROM cx""",
        "a5_verdict_histogram": f"{cte} SELECT verdict, count(*) AS n_replies FROM cx GROUP BY verdict",
        "a5_issue_distribution": f"""{issues} SELECT category, count(*) AS n_issues, count(DISTINCT doc_id) AS n_replies
FROM il GROUP BY category""",
    }


# ---------------------------------------------------------------- trajectories
def traj_cte(max_iter: int = 3, p: int = 2, min_delta: float = 0.3, by_day: bool = True, cut: bool = True) -> str:
    """Trajectory fixture + W1-W7 in DuckDB; yields ``ann`` (all rows) and ``traj`` (truncated)."""
    run = "user_id * 100 + day(ts)" if by_day else "user_id"
    return f"""
ev AS (SELECT {run} AS run_id, ts, event_id, event_type, value FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS iteration FROM ev),
it AS (SELECT run_id, iteration, event_id, value, least(value / {D(10.0)}, {D(10.0)}) AS score,
              event_type = 'error' AS has_hallucination, event_type = 'signup' AS has_factual_error,
              'answer ' || CAST(event_id AS VARCHAR) AS answer
       FROM rk{f" WHERE iteration <= {max_iter}" if cut else ""}),
it2 AS (SELECT *, {_band('score')} AS verdict,
               {RND('score - lag(score) OVER (PARTITION BY run_id ORDER BY iteration)', 3)} AS recorded_delta
        FROM it),
st AS (SELECT *, coalesce(recorded_delta, {D(0.0)}) AS improvement_delta,
         (count(recorded_delta) OVER w >= {p} AND max(recorded_delta) OVER w < {min_delta}) AS is_stagnated,
         list(recorded_delta) OVER w AS recent_deltas
       FROM it2 WINDOW w AS (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)),
ann AS (SELECT *,
          CASE WHEN NOT has_hallucination AND NOT has_factual_error AND score >= 7.0
                    AND verdict IN ('good', 'excellent') THEN 'converged'
               WHEN is_stagnated THEN 'stagnated'
               WHEN iteration >= {max_iter} THEN 'exhausted' END AS exit_reason,
          CASE WHEN improvement_delta >= 0.3 THEN 'improving'
               WHEN improvement_delta < 0.3 AND iteration > 1 THEN 'stagnant' ELSE 'first' END AS progress
        FROM st),
fx AS (SELECT *, min(CASE WHEN exit_reason IS NOT NULL THEN iteration END) OVER (PARTITION BY run_id) AS first_exit FROM ann),
kept AS (SELECT * FROM fx WHERE first_exit IS NULL OR iteration <= first_exit),
traj AS (SELECT *, has_hallucination
                 AND coalesce(lag(has_hallucination) OVER (PARTITION BY run_id ORDER BY iteration), false)
                 AND exit_reason IS NULL AS strict_mode FROM kept),
rollup AS (SELECT run_id, max(iteration) AS total_iterations,
             coalesce(arg_max(exit_reason, iteration), 'pending') AS exit_reason,
             arg_max(answer, iteration) AS final_answer, arg_max(score, iteration) AS final_score,
             arg_min(score, iteration) AS first_score,
             arg_max(has_hallucination, iteration) AS final_has_hallucination,
             CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS latency_s,
             array_to_string(list_transform(list(score ORDER BY iteration), lambda x: printf('%.3f', x)), ',') AS score_history
           FROM traj GROUP BY run_id)"""


def trajectory_sql() -> dict[str, str]:
    t = "WITH " + traj_cte()
    t10 = "WITH " + traj_cte(max_iter=10, by_day=False)
    every = "WITH " + traj_cte(cut=False)
    roll = """SELECT run_id, CAST(total_iterations AS BIGINT) AS total_iterations, exit_reason,
  exit_reason = 'converged' AS converged, final_answer, final_score, score_history FROM rollup"""
    return {
        "w1_improvement_delta": f"{every} SELECT run_id, iteration, improvement_delta FROM ann",
        "w2_is_stagnated": f"{every} SELECT run_id, iteration, is_stagnated FROM ann",
        "w3_recent_deltas": f"""{every} SELECT run_id, iteration, CAST(len(list_filter(recent_deltas, lambda x: x IS NOT NULL)) AS BIGINT) AS n_recent,
  array_to_string(list_transform(list_filter(recent_deltas, lambda x: x IS NOT NULL), lambda x: printf('%.3f', x)), ',') AS recent_deltas FROM ann""",
        "w4_exit_reason_at": f"{every} SELECT run_id, iteration, exit_reason FROM ann",
        "w5_truncate_at_exit": f"{t} SELECT run_id, iteration, score, exit_reason FROM traj",
        "w6_strict_mode": f"{t} SELECT run_id, iteration, strict_mode FROM traj",
        "w7_progress_label": f"{every} SELECT run_id, iteration, progress FROM ann",
        "a1_run_rollup": f"{t} {roll}",
        "a1_run_rollup_user10": f"{t10} {roll}",
        "a2_total_gain": f"{t} SELECT run_id, {RND('final_score - first_score', 2)} AS total_gain FROM rollup",
        "j6_active_runs": f"""{t} SELECT run_id, CAST(max(iteration) AS BIGINT) AS iterations_so_far,
  CAST(max(iteration) + 1 AS BIGINT) AS next_iteration FROM traj GROUP BY run_id
  HAVING count(exit_reason) = 0""",
        "x1_non_monotonic_runs": f"""{t} SELECT run_id, CAST(sum(CASE WHEN recorded_delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_drops,
  min(recorded_delta) AS worst_drop FROM traj GROUP BY run_id HAVING bool_or(recorded_delta < 0)""",
        "x2_persistent_hallucination": f"""{t},
isl AS (SELECT *, sum(CASE WHEN has_hallucination THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY iteration
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM traj),
s AS (SELECT run_id, grp, count(*) AS n FROM isl WHERE has_hallucination GROUP BY run_id, grp)
SELECT run_id, max(n) AS longest_streak, count(*) AS n_streaks FROM s GROUP BY run_id HAVING max(n) >= 2""",
        "x2_persistent_hallucination_whole": f"""{every},
isl AS (SELECT *, sum(CASE WHEN has_hallucination THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY iteration
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM ann),
s AS (SELECT run_id, grp, count(*) AS n FROM isl WHERE has_hallucination GROUP BY run_id, grp)
SELECT run_id, max(n) AS longest_streak, count(*) AS n_streaks FROM s GROUP BY run_id HAVING max(n) >= 2""",
        "x5_stagnation_rate": f"""{t} SELECT count(*) AS n_runs,
  CAST(sum(CASE WHEN exit_reason = 'stagnated' THEN 1 ELSE 0 END) AS BIGINT) AS n_stagnated,
  avg(CASE WHEN exit_reason = 'stagnated' THEN 1.0 ELSE 0.0 END) AS stagnation_rate,
  avg(CASE WHEN exit_reason = 'stagnated' THEN 3 - total_iterations END) AS mean_iterations_saved FROM rollup""",
    }


# ---------------------------------------------------------------- benchmark results
def results_cte() -> str:
    sys_case = ("CASE CAST(floor(run_id / 100) AS BIGINT) % 4 WHEN 0 THEN 'A_Baseline' "
                "WHEN 1 THEN 'B_LLM_Critic' WHEN 2 THEN 'C_Learned_Critic' ELSE 'D_Browser_Augmented' END")
    return traj_cte() + f""",
rr AS (SELECT *, {sys_case} AS system_name, 'day ' || CAST(run_id % 100 AS VARCHAR) AS query FROM rollup),
results AS (
  SELECT system_name, query, run_id, CAST(0 AS BIGINT) AS iterations_used, latency_s,
         final_score AS pipeline_critic_score,
         CAST(CASE WHEN final_has_hallucination THEN 1 ELSE 0 END AS BIGINT) AS hallucination_count,
         final_score AS factual_accuracy, 'baseline' AS exit_reason FROM rr WHERE system_name = 'A_Baseline'
  UNION ALL
  SELECT system_name, query, run_id, CAST(total_iterations AS BIGINT), latency_s, final_score,
         CAST(CASE WHEN final_has_hallucination THEN 1 ELSE 0 END AS BIGINT), final_score, exit_reason
  FROM rr WHERE system_name <> 'A_Baseline'),
summ AS (
  SELECT system_name, count(*) AS query_count,
    {RND('CAST(sum(CAST(factual_accuracy AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 3)} AS avg_factual_accuracy,
    {RND('avg(CASE WHEN hallucination_count > 0 THEN 1.0 ELSE 0.0 END)', 3)} AS hallucination_rate,
    {RND('CAST(sum(CAST(pipeline_critic_score AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 3)} AS avg_critic_score,
    {RND('CAST(sum(CAST(iterations_used AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 2)} AS avg_iterations,
    {RND('CAST(sum(CAST(latency_s AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 3)} AS avg_latency_s,
    {RND("avg(CASE WHEN exit_reason = 'converged' THEN 1.0 ELSE 0.0 END)", 3)} AS convergence_rate
  FROM results GROUP BY system_name),
lng AS (
  SELECT system_name, 'avg_factual_accuracy' AS metric, avg_factual_accuracy AS value, true AS hb FROM summ
  UNION ALL SELECT system_name, 'hallucination_rate', hallucination_rate, false FROM summ
  UNION ALL SELECT system_name, 'avg_critic_score', avg_critic_score, true FROM summ
  UNION ALL SELECT system_name, 'avg_iterations', avg_iterations, false FROM summ
  UNION ALL SELECT system_name, 'avg_latency_s', avg_latency_s, false FROM summ
  UNION ALL SELECT system_name, 'convergence_rate', convergence_rate, true FROM summ)"""


def benchmark_sql() -> dict[str, str]:
    r = "WITH " + results_cte()
    keys = ("CASE metric WHEN 'avg_factual_accuracy' THEN 'factual_accuracy_pct' "
            "WHEN 'hallucination_rate' THEN 'hallucination_rate_pct' WHEN 'avg_critic_score' THEN 'critic_score_pct' "
            "WHEN 'avg_iterations' THEN 'iterations_pct' WHEN 'avg_latency_s' THEN 'latency_pct' "
            "ELSE 'convergence_rate_pct' END")
    summ_cols = """system_name, query_count, avg_factual_accuracy, hallucination_rate, avg_critic_score,
  avg_iterations, avg_latency_s, convergence_rate"""
    return {
        "j1_plan_runs": f"""WITH {QA_PAIRS} SELECT conv_id, turn, s.system_name FROM qa CROSS JOIN
  (VALUES ('A_Baseline'), ('B_LLM_Critic'), ('C_Learned_Critic'), ('D_Browser_Augmented')) AS s(system_name)""",
        "u1_stack_results": f"""{r} SELECT system_name, query, run_id, iterations_used, latency_s, pipeline_critic_score,
  hallucination_count, factual_accuracy, exit_reason FROM results""",
        "a3_system_summary": f"{r} SELECT {summ_cols} FROM summ",
        "s5_write_report": f"""{r}, b AS (SELECT metric, value AS base_value FROM lng WHERE system_name = 'A_Baseline')
SELECT 'results' AS part, system_name, concat_ws(':', CAST(run_id AS VARCHAR), query, exit_reason) AS item, factual_accuracy AS value FROM results
UNION ALL SELECT 'summaries', system_name, metric, value FROM lng
UNION ALL SELECT 'improvements', l.system_name, {keys.replace('metric', 'l.metric')},
  {RND("(CASE WHEN l.hb THEN l.value - b.base_value ELSE b.base_value - l.value END) / greatest(abs(b.base_value), 0.01) * 100.0", 1)}
FROM lng l JOIN b ON l.metric = b.metric WHERE l.system_name <> 'A_Baseline'""",
        "a4_exit_distribution": f"""{r}, c AS (SELECT system_name, exit_reason, count(*) AS n_runs FROM results GROUP BY 1, 2)
SELECT system_name, exit_reason, n_runs, n_runs / sum(n_runs) OVER (PARTITION BY system_name) AS share FROM c""",
        "j2_improvement_vs_baseline": f"""{r}, b AS (SELECT metric, value AS base_value FROM lng WHERE system_name = 'A_Baseline')
SELECT l.system_name || '_vs_A_Baseline' AS comparison, l.system_name, {keys.replace('metric', 'l.metric')} AS improvement,
  {RND("(CASE WHEN l.hb THEN l.value - b.base_value ELSE b.base_value - l.value END) / greatest(abs(b.base_value), 0.01) * 100.0", 1)} AS pct
FROM lng l JOIN b ON l.metric = b.metric WHERE l.system_name <> 'A_Baseline'""",
        "w8_best_marker": f"""{r} SELECT system_name, metric, value,
  (abs(value - CASE WHEN hb THEN max(value) OVER (PARTITION BY metric) ELSE min(value) OVER (PARTITION BY metric) END) < 1e-9
   AND count(*) OVER (PARTITION BY metric) > 1) AS is_best FROM lng""",
    }


# ---------------------------------------------------------------- evidence
def HTML_TEXT(x: str) -> str:
    t = f"regexp_replace({x}, {_q(SCRIPT_STYLE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {_q(TAG)}, ' ', 'g')"
    for ent, rep in ENTITIES:
        t = f"replace({t}, {_q(ent)}, {_q(rep)})"
    t = f"regexp_replace({t}, {_q(WS_CLASS + '+')}, ' ', 'g')"
    return USTRIP(t)


def TRUNC(x: str, n: int = 1800) -> str:
    return (f"(CASE WHEN length({USTRIP(x)}) > {n} THEN substring({USTRIP(x)}, 1, {n}) || chr(10) || "
            f"'[... truncated ...]' ELSE {USTRIP(x)} END)")


def evidence_sql() -> dict[str, str]:
    base = f"""WITH {QA_PAIRS},
cp0 AS (SELECT page_id, url, {HTML_TEXT('html')} AS text FROM pages),
cp AS (SELECT page_id, url, text, {TRUNC('text')} AS content FROM cp0),
pp AS (SELECT DISTINCT page_id, unnest({KEYWORDS('text')}) AS kw FROM cp),
qp AS (SELECT DISTINCT conv_id, turn, unnest({KEYWORDS('query')}) AS kw FROM qa),
sc AS (SELECT conv_id, turn, page_id, count(*) AS shared FROM qp JOIN pp USING (kw)
       GROUP BY ALL HAVING count(*) >= 2),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, page_id) AS rank FROM sc)
           WHERE rank <= 2),
rk AS (SELECT ranked.*, cp.url, cp.content FROM ranked JOIN cp USING (page_id)),
evid AS (SELECT qa.conv_id, qa.turn, count(rk.page_id) AS n_pages,
           coalesce(string_agg(rk.url, '|' ORDER BY rk.rank), '') AS urls,
           coalesce(sum(length(rk.content)), 0) AS content_chars
         FROM qa LEFT JOIN rk ON qa.conv_id = rk.conv_id AND qa.turn = rk.turn GROUP BY qa.conv_id, qa.turn)"""
    j4 = f"""WITH ip AS (SELECT DISTINCT item_id, unnest({KEYWORDS('text')}) AS kw FROM benchmark),
dp AS (SELECT DISTINCT doc_id, unnest({KEYWORDS('text')}) AS kw FROM documents),
sizes AS (SELECT item_id, count(*) AS n_item_keywords FROM ip GROUP BY item_id),
sc AS (SELECT item_id, doc_id, count(*) AS shared FROM ip JOIN dp USING (kw) GROUP BY ALL)
SELECT item_id, doc_id, shared, n_item_keywords, shared / n_item_keywords AS containment
FROM sc JOIN sizes USING (item_id) WHERE shared / n_item_keywords >= 0.8"""
    return {
        "t1_html_to_text": f"SELECT page_id, {HTML_TEXT('html')} AS text FROM pages",
        "k2_truncate_text": f"SELECT page_id, {TRUNC(HTML_TEXT('html'))} AS content FROM pages",
        "k1_top_k_per_query": f"{base} SELECT conv_id, turn, page_id, shared, CAST(rank AS BIGINT) AS rank FROM ranked",
        "j3_retrieve_evidence": f"""{base} SELECT conv_id, turn, CAST(n_pages AS BIGINT) AS n_pages, urls,
  CAST(content_chars AS BIGINT) AS content_chars FROM evid""",
        "x3_retrieval_failure_rate": f"""{base} SELECT count(*) AS n_triggered,
  CAST(sum(CASE WHEN n_pages = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failures,
  avg(CASE WHEN n_pages = 0 THEN 1.0 ELSE 0.0 END) AS failure_rate FROM evid""",
        "x3_retrieval_failure_triggered": f"""{base}, {critic_expected_cte()},
w AS (SELECT conv_id, turn, conv_id * 31 + turn AS n FROM qa),
g AS (SELECT w.* FROM w JOIN cx ON cx.doc_id = (n + 17) % {N_DOCS} WHERE (n + 1) % 17 <> 3 AND (n_hallucinations > 0 OR n_factual_errors > 0))
SELECT count(*) AS n_triggered, CAST(sum(CASE WHEN e.n_pages = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failures,
  avg(CASE WHEN e.n_pages = 0 THEN 1.0 ELSE 0.0 END) AS failure_rate FROM evid e JOIN g ON g.conv_id = e.conv_id AND g.turn = e.turn""",
        "j4_heldout_overlap": j4,
    }


# ---------------------------------------------------------------- prompts / training
def PHASH(*parts: str) -> str:
    s = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT)"


def first_rows(order: str) -> str:
    return f"""SELECT doc_id, row_index, CASE WHEN row_index < greatest(1, floor((SELECT count(*) FROM documents) * {D(0.9)}))
  THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS row_index
      FROM (SELECT *, row_number() OVER () AS r FROM documents))"""


def FIRST_LINE(x: str) -> str:
    return USTRIP(f"split_part({x}, chr(10), 1)")


def prompts_sql() -> dict[str, str]:
    cte = "WITH " + critic_expected_cte()
    gen = f"'Question: ' || query || chr(10) || chr(10) || 'Answer:'"
    critic = (f"{_q(pr.CRITIC_RULES + chr(10) * 2 + pr.CRITIC_SCORING_GUIDE + chr(10) * 2 + 'QUERY TO ANSWER:' + chr(10))} "
              f"|| query || {_q(chr(10) * 2 + 'ANSWER UNDER REVIEW:' + chr(10))} || answer || {_q(chr(10) * 2 + pr.CRITIC_SCHEMA)}")
    judge = f"{_q(pr.JUDGE_HEAD)} || query || {_q(pr.JUDGE_MID)} || answer || {_q(pr.JUDGE_TAIL)}"

    def sec(title, n, prefix, marker):
        items = f"array_to_string(list_transform(range(1, {n} + 1), lambda k: '  {marker} {prefix} ' || k || ' of doc ' || doc_id), chr(10))"
        return f"(CASE WHEN {n} > 0 THEN {_q(title + ':' + chr(10))} || {items} ELSE {_q(title + ': (none)')} END)"

    titles = {f: t for t, f, _ in pr.REFINE_SECTIONS}
    act_title = titles["improvement_actions"]
    actions = (f"(CASE WHEN bad THEN {_q(act_title + ':' + chr(10) + '  >> ' + FALLBACK_ACTION)} "
               f"ELSE {_q(act_title + ':' + chr(10))} || array_to_string(list_append(list_transform(range(1, na + 1), "
               f"lambda k: '  >> action ' || k || ' of doc ' || doc_id), '  >> 42'), chr(10)) END)")
    nn = lambda v: f"(CASE WHEN bad THEN 0 ELSE {v} END)"
    sections = " || chr(10) || chr(10) || ".join([
        "'ORIGINAL QUESTION:' || chr(10) || query",
        "'CURRENT ANSWER  [critic score: ' || CAST(score AS VARCHAR) || '/10  verdict: ' || verdict || ']:' || chr(10) || answer",
        sec(titles["hallucinations"], nn("h"), "hallucination", "[!]"),
        sec(titles["factual_errors"], nn("f"), "factual error", "[x]"),
        sec(titles["logical_flaws"], nn("l"), "logical flaw", "[~]"),
        sec(titles["missing_concepts"], nn("m"), "missing concept", "[ ]"),
        actions,
    ])
    refine = (f"(CASE WHEN doc_id % 2 = 1 THEN {_q(pr.REFINE_STRICT_HEADER)} ELSE '' END) || "
              f"{_q(pr.REFINE_INTRO)} || {sections}")
    tmpl = "CASE idx " + " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(pr.CORRUPTION_TEMPLATES)) + " END"
    sft_prompt = (f"{_q(pr.SFT_HEAD + pr.SFT_INSTRUCTION + pr.SFT_INPUT)} || query || {_q(pr.SFT_ANSWER)} || answer "
                  f"|| {_q(pr.SFT_RESPONSE)}")

    def jlist(n, prefix):
        return (f"'[' || array_to_string(list_transform(range(1, {n} + 1), lambda k: '\"{prefix} ' || k || ' of doc ' || doc_id || '\"'), ',') || ']'")

    resp = ("'{\"hallucinations\":' || " + jlist(nn("h"), "hallucination") + " || ',\"factual_errors\":' || "
            + jlist(nn("f"), "factual error") + " || ',\"missing_concepts\":' || " + jlist(nn("m"), "missing concept")
            + " || ',\"logical_flaws\":' || " + jlist(nn("l"), "logical flaw")
            + " || ',\"score\":' || CAST(score AS VARCHAR) || ',\"verdict\":\"' || verdict || '\"}'")
    recs = f"""{cte}, cxb AS (SELECT cx.*, b.h, b.f, b.l, b.m, b.na, b.bad FROM cx JOIN cx_base b USING (doc_id)),
recs AS (SELECT d.doc_id, {FIRST_LINE('d.text')} AS query, d.text AS answer, cxb.* EXCLUDE (doc_id)
         FROM documents d JOIN labels USING (doc_id) JOIN cxb ON cxb.doc_id = d.doc_id)"""
    def tok(x):
        return f"list_transform(regexp_extract_all({x}, {_q(NON_WS_CLASS + '+')}), lambda x: ({PHASH('x')} % 32000) + 3)"
    return {
        "t2_generation_prompt": f"WITH {QA_PAIRS} SELECT conv_id, turn, {gen} AS prompt FROM qa",
        "t3_critic_prompt": f"WITH {QA_PAIRS} SELECT conv_id, turn, {critic} AS prompt FROM qa",
        "t5_judge_prompt": f"WITH {QA_PAIRS} SELECT conv_id, turn, {judge} AS prompt FROM qa",
        "t7_pair_text": f"WITH {QA_PAIRS} SELECT conv_id, turn, 'Query: ' || query || ' [SEP] Answer: ' || answer AS text FROM qa",
        "t4_refine_prompt": f"""{cte}, cxb AS (SELECT cx.*, b.h, b.f, b.l, b.m, b.na, b.bad FROM cx JOIN cx_base b USING (doc_id)),
src AS (SELECT d.doc_id, {FIRST_LINE('d.text')} AS query, d.text AS answer, cxb.* EXCLUDE (doc_id)
        FROM documents d JOIN cxb ON cxb.doc_id = d.doc_id)
SELECT doc_id, {refine} AS prompt FROM src""",
        "t4_refine_prompt_evidence": f"""{cte}, cxb AS (SELECT cx.*, b.h, b.f, b.l, b.m, b.na, b.bad FROM cx JOIN cx_base b USING (doc_id)),
src AS (SELECT d.doc_id, {FIRST_LINE('d.text')} AS query, d.text AS answer, cxb.* EXCLUDE (doc_id),
        p.page_id, p.url, {TRUNC(HTML_TEXT('p.html'))} AS content
        FROM documents d JOIN cxb ON cxb.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)
SELECT doc_id, {_q(pr.REFINE_INTRO)} || {sections} || (CASE WHEN page_id IS NULL THEN '' ELSE
  {_q(pr.EVIDENCE_HEADER)} || '[Source 1] ' || url || chr(10) || content || {_q(pr.EVIDENCE_FOOTER)} END) AS prompt FROM src""",
        "t6_corruption_prompt": f"""WITH s AS (SELECT doc_id, text, {PHASH('doc_id', '1', '42')} % 4 AS idx FROM documents)
SELECT doc_id, idx AS template_index, ({tmpl}) || text AS prompt FROM s""",
        "t8_sft_text": f"""{recs} SELECT doc_id, {sft_prompt} AS prompt,
  'hallucinations,factual_errors,missing_concepts,logical_flaws,score,verdict' AS keys, score, verdict,
  CAST((CASE WHEN bad THEN 0 ELSE h END) AS BIGINT) AS n_hallucinations FROM recs""",
        "t9_mask_labels": f"""{recs}, tx AS (SELECT doc_id, {sft_prompt} AS p, {sft_prompt} || {resp} AS text FROM recs),
ids AS (SELECT doc_id, {tok('text')}[1:512] AS ids, len({tok('p')}[1:512]) AS np FROM tx),
lab AS (SELECT doc_id, ids, np, len(ids) AS n, len(ids) < 512 AS add_eos FROM ids)
SELECT doc_id, CAST(n + CASE WHEN add_eos THEN 1 ELSE 0 END AS BIGINT) AS n_input_ids,
  CAST(np AS BIGINT) AS n_masked, add_eos AS ends_with_eos,
  CAST(coalesce(list_sum(ids[np + 1:]), 0) + CASE WHEN add_eos THEN 2 ELSE 0 END AS BIGINT) AS label_sum FROM lab""",
        "d1_expand_corruptions": f"""SELECT doc_id, CAST(v AS BIGINT) AS variant, v > 0 AS is_corrupted,
  CAST(CASE WHEN v > 0 THEN {PHASH('doc_id', 'v', '42')} % 4 ELSE -1 END AS BIGINT) AS template_index,
  CAST(CASE WHEN v = 0 THEN 0 ELSE length(text) + length(CASE {PHASH('doc_id', 'v', '42')} % 4 """
        + " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(pr.CORRUPTION_TEMPLATES))
        + """ END) END AS BIGINT) AS prompt_chars
FROM documents, (SELECT unnest([0, 1]) AS v)""",
        "d3_verdict_index": f"""{recs} SELECT doc_id, verdict, CAST({_rank('verdict')} AS BIGINT) AS verdict_index,
  verdict AS verdict_back FROM recs""",
        "d4_split_prefix": f"{first_rows('r')}",
        "d4_split_prefix_ordered": f"{first_rows('lang NULLS FIRST, r')}",
        "d5_split_hash": f"""SELECT doc_id, CASE WHEN {PHASH(FIRST_LINE('text'), '42')} % 100 < 90 THEN 'train' ELSE 'val' END AS split
FROM documents""",
        "s4_write_training": f"""{recs} SELECT query, CAST(length(answer) AS BIGINT) AS answer_chars, verdict,
  CAST((CASE WHEN bad THEN 0 ELSE f END) AS BIGINT) AS n_factual_errors FROM recs""",
        "s2_read_training_array": f"""{recs} SELECT query, CAST(length(answer) AS BIGINT) AS answer_chars, score, verdict,
  CAST((CASE WHEN bad THEN 0 ELSE h END) AS BIGINT) AS n_hallucinations FROM recs""",
        "s2_read_training": f"""{recs} SELECT query, CAST(length(answer) AS BIGINT) AS answer_chars, score, verdict,
  CAST((CASE WHEN bad THEN 0 ELSE h END) AS BIGINT) AS n_hallucinations FROM recs""",
    }


# ---------------------------------------------------------------- learned critic: training and scoring, epoch by epoch
UNITS, CLASSES, EPOCHS, RATE, FEATURES = 4, 4, 36, 0.05, 4096
# Places in the list of the heads' numbers: biases of units, verdict weights, verdict biases, score weights, score bias.
P_B, P_V, P_C, P_U, P_D = 1, 1 + UNITS, 1 + UNITS + UNITS * CLASSES, 1 + UNITS + UNITS * CLASSES + CLASSES, 1 + 2 * UNITS + UNITS * CLASSES + CLASSES


def _each(n: int, make) -> str:
    return ", ".join(make(i) for i in range(n))


def _plus(n: int, make) -> str:
    return " + ".join(make(i) for i in range(n))


def _start(*name: str) -> str:
    return f"(({PHASH(*name)} / {D(2.0 ** 32)} - {D(0.5)}) * {D(0.5)})"


def _words_cte(name: str, src: str) -> str:
    return f"""{name}w AS (SELECT id, unnest({WORDS("('Query: ' || coalesce(query, '') || ' [SEP] Answer: ' || coalesce(answer, ''))")}) AS w FROM ({src})),
{name}f AS MATERIALIZED (SELECT id, {PHASH('w', '1')} % {FEATURES} AS f, ln(1 + count(*)) AS tf FROM {name}w GROUP BY 1, 2)"""


def _forward(z: str, name: str, heads: str) -> str:
    """Units, verdict exponentials and score of rows with sums z0, z1, ... and the heads' list p."""
    a = f"{name}a AS (SELECT z.*, h.p, {_each(UNITS, lambda h: f'tanh(z{h} + h.p[{P_B + h}]) AS a{h}')} FROM {z} z, {heads} h)"
    logit = lambda c: "exp(" + _plus(UNITS, lambda h: f"a{h} * p[{P_V + h * CLASSES + c}]") + f" + p[{P_C + c}])"
    score = "10 / (1 + exp(-(" + _plus(UNITS, lambda h: f"a{h} * p[{P_U + h}]") + f" + p[{P_D}])))"
    return f"""{a},
{name}b AS (SELECT *, {_each(CLASSES, lambda c: f'{logit(c)} AS e{c}')}, {score} AS s FROM {name}a),
{name} AS MATERIALIZED (SELECT *, {_each(CLASSES, lambda c: f'e{c} / (e0 + e1 + e2 + e3) AS q{c}')} FROM {name}b)"""


def model_cte() -> str:
    """Training restated: ``mhist`` (epoch, losses), ``mbest`` (epoch kept), ``mmodel`` (feature, idf, weights), ``mheads`` (list)."""
    lab = f"""mlab AS MATERIALIZED (SELECT doc_id AS id, {FIRST_LINE('text')} AS query, text AS answer,
  CASE WHEN {PHASH('text', '42')} % 100 < 80 THEN 0 WHEN {PHASH('text', '42')} % 100 < 90 THEN 1 ELSE 2 END AS split,
  CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 1 ELSE 0 END AS label,
  CASE WHEN quality = 1 AND toxic = 0 THEN {D(9.5)} WHEN quality = 1 THEN {D(5.0)} ELSE {D(2.0)} END AS target
  FROM documents JOIN labels USING (doc_id))"""
    n = UNITS + UNITS * CLASSES + CLASSES + UNITS + 1
    starts = ([D(0.0)] * UNITS + [_start("'v'", f"'{h}'", f"'{c}'") for h in range(UNITS) for c in range(CLASSES)] + [D(0.0)] * CLASSES
              + [_start("'u'", f"'{h}'") for h in range(UNITS)] + [D(0.0)])
    zeros = "list_transform(range(" + str(n) + f"), lambda x: {D(0.0)})"
    out = [lab, _words_cte("m", "SELECT id, query, answer FROM mlab"),
           "mn AS (SELECT count(*) AS n FROM mlab WHERE split = 0)",
           "midf AS MATERIALIZED (SELECT f, ln((any_value(mn.n) + 1) / (count(*) + 1)) AS idf FROM mf JOIN mlab USING (id), mn WHERE split = 0 GROUP BY f)",
           "mnorm AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM mf JOIN midf USING (f) GROUP BY id)",
           "mx AS MATERIALIZED (SELECT id, f, tf * idf / norm AS x FROM mf JOIN midf USING (f) JOIN mnorm USING (id) WHERE norm > 0)",
           f"mw0 AS MATERIALIZED (SELECT f, {_each(UNITS, lambda h: _start(chr(39) + 'w' + chr(39), 'f', str(h)) + f' AS w{h}')}, "
           f"{_each(UNITS, lambda h: f'{D(0.0)} AS m{h}, {D(0.0)} AS s{h}')} FROM midf)",
           f"mh0 AS MATERIALIZED (SELECT [{', '.join(starts)}] AS p, {zeros} AS m, {zeros} AS s)"]
    for e in range(EPOCHS + 1):
        z = f"mz{e}"
        out.append(f"""{z} AS (SELECT l.id, l.label, l.target, l.split, {_each(UNITS, lambda h: f'coalesce(sum(x * w{h}), 0) AS z{h}')}
  FROM mlab l LEFT JOIN (mx JOIN mw{e} USING (f)) ON mx.id = l.id GROUP BY ALL)""")
        out.append(_forward(z, f"mo{e}", f"mh{e}"))
        true_p = "CASE label " + " ".join(f"WHEN {c} THEN q{c}" for c in range(CLASSES)) + " END"
        loss = f"-ln(greatest({true_p}, 1e-7)) + 0.5 * (s - target) * (s - target)"
        out.append(f"""ml{e} AS (SELECT {e} AS e, avg({loss}) FILTER (split = 0) AS train, avg({loss}) FILTER (split = 1) AS val,
  avg({loss}) FILTER (split = 2) AS test FROM mo{e})""")
        if e == EPOCHS:
            break
        dv = [f"(q{c} - CASE WHEN label = {c} THEN 1 ELSE 0 END)" for c in range(CLASSES)]
        du = "((s - target) * s * (1 - s / 10))"
        dz = [f"({_plus(CLASSES, lambda c: f'{dv[c]} * p[{P_V + h * CLASSES + c}]')} + {du} * p[{P_U + h}]) * (1 - a{h} * a{h})" for h in range(UNITS)]
        out.append(f"md{e} AS MATERIALIZED (SELECT *, {_each(UNITS, lambda h: f'{dz[h]} AS d{h}')} FROM mo{e} WHERE split = 0)")
        grads = ([f"sum(d{h})" for h in range(UNITS)] + [f"sum(a{h} * {dv[c]})" for h in range(UNITS) for c in range(CLASSES)]
                 + [f"sum({dv[c]})" for c in range(CLASSES)] + [f"sum(a{h} * {du})" for h in range(UNITS)] + [f"sum({du})"])
        out.append(f"mg{e} AS MATERIALIZED (SELECT [{', '.join(f'{g} / count(*)' for g in grads)}] AS g FROM md{e})")
        out.append(f"""mk{e} AS (SELECT f, {_each(UNITS, lambda h: f'sum(x * d{h}) / any_value(mn.n) AS g{h}')}
  FROM mx JOIN md{e} USING (id), mn GROUP BY f)""")
        step = lambda w, m, s: f"{w} - {D(RATE)} * ({m} / {D(1 - 0.9 ** (e + 1))}) / (sqrt({s} / {D(1 - 0.99 ** (e + 1))}) + {D(1e-6)})"
        out.append(f"""mu{e} AS (SELECT w.f, {_each(UNITS, lambda h: f'w{h}, {D(0.9)} * m{h} + {D(1 - 0.9)} * coalesce(g{h}, 0) AS m{h}, '
                   f'{D(0.99)} * s{h} + {D(1 - 0.99)} * coalesce(g{h}, 0) * coalesce(g{h}, 0) AS s{h}')} FROM mw{e} w LEFT JOIN mk{e} USING (f))""")
        out.append(f"mw{e + 1} AS MATERIALIZED (SELECT f, {_each(UNITS, lambda h: step(f'w{h}', f'm{h}', f's{h}') + f' AS w{h}, m{h}, s{h}')} FROM mu{e})")
        ms = f"list_transform(range(1, {n + 1}), lambda i: "
        out.append(f"mv{e} AS (SELECT p, {ms}{D(0.9)} * m[i] + {D(1 - 0.9)} * g[i]) AS m, {ms}{D(0.99)} * s[i] + {D(1 - 0.99)} * g[i] * g[i]) AS s "
                   f"FROM mh{e}, mg{e})")
        out.append(f"mh{e + 1} AS MATERIALIZED (SELECT {ms}{step('p[i]', 'm[i]', 's[i]')}) AS p, m, s FROM mv{e})")
    out.append("mhist AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM ml{e}" for e in range(EPOCHS + 1)) + ")")
    out.append("mbest AS (SELECT arg_min(e, val) AS e FROM mhist)")
    out.append("mmodel AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT f, idf, {_each(UNITS, lambda h: f'w{h}')} FROM mw{e} JOIN midf USING (f), mbest WHERE mbest.e = {e}" for e in range(EPOCHS + 1)) + ")")
    out.append("mheads AS (" + " UNION ALL ".join(f"SELECT p FROM mh{e}, mbest WHERE mbest.e = {e}" for e in range(EPOCHS + 1)) + ")")
    return ",\n".join(out)


def model_score_cte(src: str) -> str:
    """``mscore`` (id, score, verdict, confidence) of ``src`` (id, query, answer) under the model of ``model_cte``."""
    names = ["poor", "acceptable", "good", "excellent"]
    top = "greatest(q0, q1, q2, q3)"
    return f"""{_words_cte('t', src)},
tz AS (SELECT i.id, {_each(UNITS, lambda h: f'CASE WHEN n > 0 THEN y{h} / n ELSE 0 END AS z{h}')} FROM (SELECT id FROM ({src})) i LEFT JOIN
  (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS n, {_each(UNITS, lambda h: f'sum(tf * idf * w{h}) AS y{h}')} FROM tf JOIN mmodel USING (f) GROUP BY id) t
  ON t.id = i.id),
{_forward('tz', 'to_', 'mheads')},
mscore AS MATERIALIZED (SELECT id, s AS score, {top} AS confidence,
  CASE {' '.join(f"WHEN q{c} = {top} THEN '{v}'" for c, v in enumerate(names))} END AS verdict FROM to_)"""


# ---------------------------------------------------------------- batch inference over stored completions
N_DOCS = "(SELECT count(*) FROM documents)"
KEY = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


NO_FAST = "SELECT NULL AS key, NULL AS i, NULL AS score, NULL AS verdict WHERE false"


def loop_cte(runs: str, fast: str = NO_FAST) -> str:
    """The loop over ``runs`` (key, n, query, answer), restated: yields ``done``, one row per run. ``fast``: (key, i, score,
    verdict) of the critiques that a learned critic gave without issues or cost."""
    return f"""{critic_expected_cte()},
runs AS ({runs}),
fast AS ({fast}),
its AS (SELECT key, n, answer, i, (n + 17 * i) % {N_DOCS} AS d, (n + i) % 17 = 3 AS cfail, (n + i) % 19 = 4 AS rfail
        FROM runs, (SELECT unnest([1, 2, 3]) AS i)),
sc AS (SELECT its.* EXCLUDE (cfail), fast.key IS NULL AND cfail AS cfail, coalesce(fast.score, cx.score) AS score,
         coalesce(fast.verdict, cx.verdict) AS verdict, CASE WHEN fast.key IS NULL THEN cx.n_hallucinations ELSE 0 END AS h,
         CASE WHEN fast.key IS NULL THEN cx.n_factual_errors ELSE 0 END AS f, CASE WHEN fast.key IS NULL THEN its.i ELSE 0 END AS cost
       FROM its JOIN cx ON cx.doc_id = d LEFT JOIN fast ON fast.key = its.key AND fast.i = its.i),
dl AS (SELECT *, {RND('score - lag(score) OVER (PARTITION BY key ORDER BY i)', 3)} AS delta FROM sc),
ex AS (SELECT *, CASE WHEN cfail THEN 'error'
         WHEN h = 0 AND f = 0 AND score >= 7.0 AND verdict IN ('good', 'excellent') THEN 'converged'
         WHEN count(delta) OVER w >= 2 AND max(delta) OVER w < 0.3 THEN 'stagnated'
         WHEN i = 3 THEN 'exhausted' END AS exit_at
       FROM dl WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
le AS (SELECT *, min(CASE WHEN exit_at IS NOT NULL THEN i END) OVER (PARTITION BY key) AS last FROM ex),
sm AS (SELECT key, any_value(last) AS last, bool_or(rfail AND i < last) AS rbad, max(CASE WHEN i = last THEN exit_at END) AS exit_at,
         max(CASE WHEN i = last THEN score END) AS score, max(CASE WHEN i = last THEN h END) AS h,
         array_to_string(list_transform(list(score ORDER BY i) FILTER (WHERE i <= last), lambda x: printf('%.3f', x)), ',') AS history,
         sum(CASE WHEN i <= last THEN cost ELSE 0 END) + sum(CASE WHEN i < last THEN i * 2 ELSE 0 END) AS spent
       FROM le GROUP BY key),
er AS (SELECT sm.*, runs.n, runs.query, runs.answer,
         CASE WHEN n % 13 = 5 THEN 'RuntimeError: generator unavailable' WHEN rbad THEN 'RuntimeError: refiner unavailable'
              WHEN exit_at = 'error' THEN 'RuntimeError: critic unavailable' END AS error FROM sm JOIN runs USING (key)),
done AS (SELECT key, n, CAST(CASE WHEN error IS NULL THEN last ELSE 0 END AS BIGINT) AS total_iterations,
           CASE WHEN error IS NULL THEN exit_at ELSE 'error' END AS exit_reason, error IS NULL AND exit_at = 'converged' AS converged,
           CASE WHEN error IS NULL THEN score ELSE {D(0.0)} END AS final_score,
           CASE WHEN error IS NOT NULL THEN '[ERROR: ' || error || ']' WHEN last = 1 THEN answer
                ELSE answer || ' (revision ' || (last - 1) || ')' END AS final_answer,
           CASE WHEN error IS NULL THEN {D('n % 7 + spent')} ELSE {D(0.0)} END AS latency_s,
           CASE WHEN error IS NULL THEN history ELSE '' END AS score_history,
           CAST(CASE WHEN error IS NULL THEN h ELSE 0 END AS BIGINT) AS hallucination_count FROM er)"""


def judge_cte(src: str) -> str:
    """``jd``: key, factual accuracy and flag of the judgement recorded for each run of ``src`` (key, n)."""
    return f"""jd AS (SELECT key, CASE WHEN bad THEN {D(5.0)} ELSE least((n_chars % 121) / {D(10.0)}, {D(10.0)}) END AS factual_accuracy,
    NOT bad AND dj % 4 IN (0, 2) AS hallucinations_detected
  FROM (SELECT key, (n * 3) % {N_DOCS} AS dj FROM {src}) x
  JOIN (SELECT doc_id, n_chars, doc_id % 3 = 2 OR doc_id % 7 = 5 AS bad FROM documents) y ON y.doc_id = dj)"""


def inference_sql() -> dict[str, str]:
    from critica.sources.fixtures import critic_replies_sql
    pairs = f"SELECT {KEY} AS key, conv_id * 31 + turn AS n, conv_id, turn, query, answer FROM qa"
    systems = ["A_Baseline", "B_LLM_Critic", "C_Learned_Critic", "D_Browser_Augmented"]
    under = " UNION ALL ".join(f"SELECT '{s}:' || {KEY} AS key, '{s}' AS system_name, conv_id * 31 + turn + {5 * i} AS n, query, answer FROM qa"
                               for i, s in enumerate(systems))
    results = f"""results AS (
  SELECT r.system_name, r.key AS run_id, CASE WHEN r.n % 13 = 5 THEN '' ELSE r.answer END AS final_answer, CAST(0 AS BIGINT) AS iterations_used,
    {D('r.n % 7')} AS latency_s, jd.factual_accuracy AS pipeline_critic_score,
    CAST(CASE WHEN jd.hallucinations_detected THEN 1 ELSE 0 END AS BIGINT) AS hallucination_count, jd.factual_accuracy,
    'baseline' AS exit_reason, jd.hallucinations_detected AS judge_hallucination
  FROM runs r JOIN jd USING (key) WHERE r.system_name = 'A_Baseline'
  UNION ALL
  SELECT r.system_name, r.key, d.final_answer, d.total_iterations, d.latency_s, d.final_score, d.hallucination_count,
    CASE WHEN d.exit_reason = 'error' THEN {D(0.0)} ELSE jd.factual_accuracy END, d.exit_reason,
    d.exit_reason <> 'error' AND jd.hallucinations_detected
  FROM runs r JOIN done d USING (key) JOIN jd USING (key) WHERE r.system_name <> 'A_Baseline')"""
    bench = f"WITH {QA_PAIRS}, {loop_cte(under)}, {judge_cte('runs')}, {results}"
    revised = "answer || CASE WHEN i > 1 THEN ' (revision ' || (i - 1) || ')' ELSE '' END"
    texts = f"""SELECT 'C_Learned_Critic:' || {KEY} || '#' || i AS id, query, {revised} AS answer FROM qa, (SELECT unnest([1, 2, 3]) AS i)"""
    fast = "SELECT split_part(id, '#', 1) AS key, CAST(split_part(id, '#', 2) AS INTEGER) AS i, score, verdict FROM mscore WHERE score >= 8.5"
    routed = f"WITH {QA_PAIRS}, {model_cte()}, {model_score_cte(texts)}, {loop_cte(under, fast)}, {judge_cte('runs')}, {results}"
    one = f"""WITH {QA_PAIRS}, {critic_expected_cte()}, p AS ({pairs}),
k AS (SELECT p.*, (n + 1) % 17 = 3 AS fail, (n + 17) % {N_DOCS} AS d FROM p)"""
    c_err = "CASE WHEN fail THEN 'RuntimeError: critic unavailable' END"
    return {
        "i1_complete_batch": f"""WITH {QA_PAIRS}, r AS ({critic_replies_sql()}), p AS ({pairs}),
k AS (SELECT p.*, (n + 1) % 17 = 3 AS fail, (n + 17) % {N_DOCS} AS d FROM p)
SELECT conv_id, turn, CASE WHEN fail THEN '' ELSE r.raw_response END AS completion, {D(1.0)} AS latency_s, {c_err} AS error
FROM k JOIN r ON r.doc_id = k.d""",
        "i8_generate_batch": f"""WITH {QA_PAIRS}, p AS ({pairs}) SELECT conv_id, turn,
  'Question: ' || query || chr(10) || chr(10) || 'Answer:' AS prompt_used, CASE WHEN n % 13 = 5 THEN NULL ELSE answer END AS answer,
  CASE WHEN n % 13 = 5 THEN 'RuntimeError: generator unavailable' END AS error FROM p""",
        "i3_critique_batch": f"""{one} SELECT conv_id, turn, CASE WHEN fail THEN {D(3.0)} ELSE score END AS score,
  CASE WHEN fail THEN 'poor' ELSE verdict END AS verdict, {c_err} AS critic_error, CAST(CASE WHEN fail THEN 0 ELSE
  n_factual_errors + n_hallucinations + n_logical_flaws + n_missing_concepts END AS BIGINT) AS total_issue_count
FROM k JOIN cx ON cx.doc_id = d""",
        "i4_judge_batch": f"""WITH {QA_PAIRS}, p AS ({pairs}), {judge_cte('p')}
SELECT conv_id, turn, factual_accuracy, hallucinations_detected FROM p JOIN jd USING (key)""",
        "i5_refine_batch": f"""WITH {QA_PAIRS}, {loop_cte(pairs)}
SELECT key AS run_id, total_iterations, exit_reason, converged, final_score, final_answer, latency_s, score_history FROM done""",
        "i6_benchmark": f"{bench} SELECT * FROM results",
        "i6_benchmark_learned": f"""{routed} SELECT * EXCLUDE (pipeline_critic_score), {RND('pipeline_critic_score', 6)} AS pipeline_critic_score
FROM results""",
        "i7_error_rows": f"""{bench} SELECT system_name, count(*) AS query_count,
  {RND('CAST(sum(CAST(factual_accuracy AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 3)} AS avg_factual_accuracy,
  {RND('avg(CASE WHEN hallucination_count > 0 THEN 1.0 ELSE CAST(0.0 AS DOUBLE) END)', 3)} AS hallucination_rate,
  {RND('CAST(sum(CAST(pipeline_critic_score AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 3)} AS avg_critic_score,
  {RND('CAST(sum(CAST(iterations_used AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 2)} AS avg_iterations,
  {RND('CAST(sum(CAST(latency_s AS DECIMAL(28,6))) AS DOUBLE) / count(*)', 3)} AS avg_latency_s,
  {RND("avg(CASE WHEN exit_reason = 'converged' THEN 1.0 ELSE CAST(0.0 AS DOUBLE) END)", 3)} AS convergence_rate
FROM results GROUP BY system_name""",
        "d2_label_records": f"""WITH {critic_expected_cte()}, v AS (SELECT doc_id, unnest([0, 1]) AS variant FROM documents),
k AS (SELECT v.*, variant = 1 AND doc_id % 23 = 7 AS fail, (doc_id + 17 * (variant + 1)) % {N_DOCS} AS d,
        (doc_id + variant) % {N_DOCS} AS t FROM v)
SELECT k.doc_id, CAST(variant AS BIGINT) AS variant, CAST(CASE WHEN fail THEN 0 ELSE length(x.text) END AS BIGINT) AS answer_chars,
  CASE WHEN fail THEN 'RuntimeError: corrupter unavailable' END AS error, CASE WHEN NOT fail THEN cx.score END AS score,
  CASE WHEN NOT fail THEN cx.verdict END AS verdict, CAST(CASE WHEN NOT fail THEN cx.n_hallucinations END AS BIGINT) AS n_hallucinations
FROM k JOIN cx ON cx.doc_id = d JOIN documents x ON x.doc_id = t""",
    }


# ---------------------------------------------------------------- learned critic
def learned_sql() -> dict[str, str]:
    cte = "WITH " + critic_expected_cte()
    base = f"""{cte}, j AS (SELECT cx.*, s.score AS slow_score, s.verdict AS slow_verdict
  FROM cx JOIN cx s ON s.doc_id = (cx.doc_id + 17) % {N_DOCS})"""
    dmean = lambda x: f"CAST(sum(CAST({RND(x, 9)} AS DECIMAL(38,9))) AS DOUBLE) / count(*)"
    p_true = ("(CASE WHEN " + _rank('verdict') + " = label_index THEN confidence ELSE (1.0 - confidence) / 3.0 END)")
    argmax = ("(CASE WHEN confidence >= (1.0 - confidence) / 3.0 THEN " + _rank('verdict')
              + " WHEN " + _rank('verdict') + " = 0 THEN 1 ELSE 0 END)")
    mis = "(verdict IN ('good', 'excellent') AND slow_score < 4.0)"
    docs = f"SELECT doc_id AS id, {FIRST_LINE('text')} AS query, text AS answer FROM documents"
    return {
        "f3_route_hybrid": f"""{base} SELECT doc_id, CASE WHEN score < 8.5 THEN 'slow' ELSE 'fast' END AS route,
  CASE WHEN score < 8.5 THEN slow_score ELSE score END AS score, CASE WHEN score < 8.5 THEN slow_verdict ELSE verdict END AS verdict FROM j""",
        "j5_misalignment": f"""{base} SELECT doc_id, verdict AS learned_verdict, slow_score, {mis} AS misaligned FROM j""",
        "x4_misaligned_rate": f"""{base} SELECT count(*) AS n_pairs, CAST(sum(CASE WHEN {mis} THEN 1 ELSE 0 END) AS BIGINT) AS n_misaligned,
  avg(CASE WHEN {mis} THEN 1.0 ELSE CAST(0.0 AS DOUBLE) END) AS misaligned_rate FROM j""",
        "d6_train_learned_critic": f"""WITH {model_cte()} SELECT h.e AS epoch, {RND('h.train', 6)} AS train_loss, {RND('h.val', 6)} AS val_loss,
  h.e = b.e AS is_best, CASE WHEN h.e = b.e THEN {RND('h.test', 6)} END AS test_loss FROM mhist h, mbest b""",
        "d7_score_learned_critic": f"""WITH {model_cte()}, {model_score_cte(docs)}
SELECT id AS doc_id, verdict, {RND('confidence', 6)} AS confidence, {RND('score', 6)} AS score, CAST(0 AS BIGINT) AS n_issues FROM mscore""",
        "f3_route_learned": f"""{cte}, {model_cte()}, {model_score_cte(docs)}
SELECT m.id AS doc_id, CASE WHEN m.score < 8.5 THEN 'slow' ELSE 'fast' END AS route,
  {RND('CASE WHEN m.score < 8.5 THEN s.score ELSE m.score END', 6)} AS score
FROM mscore m JOIN cx s ON s.doc_id = (m.id + 17) % {N_DOCS}""",
        "a6_critic_eval": f"""{cte}, p AS (
  SELECT cx.*, CASE WHEN l.quality = 1 THEN 2 ELSE 0 END AS label_index, cx.score AS pred_score,
         (CASE WHEN l.quality = 1 THEN CAST(8.0 AS DOUBLE) ELSE 3.0 END) - 2.0 * l.toxic AS label_score
  FROM cx JOIN labels l USING (doc_id)),
q AS (SELECT -ln(greatest({p_true}, 1e-7)) AS ce, (pred_score - label_score) * (pred_score - label_score) AS se,
        CASE WHEN {argmax} = label_index THEN 1.0 ELSE CAST(0.0 AS DOUBLE) END AS hit FROM p)
SELECT count(*) AS n, {dmean('ce')} AS cross_entropy, {dmean('se')} AS mse, avg(hit) AS verdict_accuracy,
  {dmean('ce')} + 0.5 * {dmean('se')} AS loss FROM q""",
    }


# ---------------------------------------------------------------- streaming
def streaming_sql() -> dict[str, str]:
    m_doc = METRICS_CTE("documents", "text", None, "doc_id")
    return {
        "st1_stagnation_monitor": f"""WITH {traj_cte()} SELECT run_id, iteration, improvement_delta, is_stagnated,
  exit_reason, strict_mode FROM traj""",
        "st1_every_event": f"""WITH {traj_cte(cut=False)},
x AS (SELECT fx.*, coalesce(first_exit < fx.iteration, false) AS after_exit, t.strict_mode FROM fx LEFT JOIN (SELECT event_id, strict_mode FROM traj) t USING (event_id))
SELECT event_id, run_id, CASE WHEN after_exit THEN 0 ELSE iteration END AS iteration,
  CASE WHEN after_exit THEN {D(0.0)} ELSE improvement_delta END AS improvement_delta,
  CASE WHEN NOT after_exit THEN exit_reason END AS exit_reason, coalesce(strict_mode, false) AS strict_mode, after_exit FROM x""",
        "st2_score_stream": f"""WITH {m_doc}, {critic_expected_cte()}
SELECT m.doc_id, m.word_count, m.sentence_count, m.lexical_diversity, m.composite_score, cx.score, cx.verdict
FROM m_final m JOIN cx USING (doc_id)""",
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(metrics_sql())
    out.update(critic_sql())
    out.update(trajectory_sql())
    out.update(benchmark_sql())
    out.update(evidence_sql())
    out.update(prompts_sql())
    out.update(inference_sql())
    out.update(learned_sql())
    out.update(streaming_sql())
    return out
