"""Deterministic fixtures derived from the driver tables (FIXTURES.md §3).

Critic and judge replies are built from ``documents`` with SQL that both Spark SQL and DuckDB
accept, so a query can be checked against the exact same reply text. Trajectories come from
``events``; benchmark results roll those trajectories up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from critica.config import DEFAULT_LOOP, LoopConfig
from critica.operators.ordering import number_rows
from critica.sources.tables import table

# Issue counts per reply, as functions of d = doc_id.
N_HALLUCINATIONS = "(doc_id % 4)"
N_FACTUAL = "(CAST(floor(doc_id / 4) AS BIGINT) % 3)"
N_LOGICAL = "(CAST(floor(doc_id / 12) AS BIGINT) % 4)"
N_MISSING = "(CAST(floor(doc_id / 48) AS BIGINT) % 6)"
N_ACTIONS = "(doc_id % 3)"
# (list field, item prefix, count expression, largest count)
CRITIC_LISTS = [
    ("factual_errors", "factual error", N_FACTUAL, 2),
    ("hallucinations", "hallucination", N_HALLUCINATIONS, 3),
    ("missing_concepts", "missing concept", N_MISSING, 5),
    ("logical_flaws", "logical flaw", N_LOGICAL, 3),
]
VERDICT_IN = ["poor", "acceptable", "good", "excellent", "needs_improvement", "  Great ",
              "UNKNOWN_VERDICT", ""]


def _tenths(k: str) -> str:
    """Decimal text of k/10 for a non-negative integer k, identical in both engines."""
    return f"(CAST(CAST(floor(({k}) / 10) AS BIGINT) AS STRING) || '.' || CAST(({k}) % 10 AS STRING))"


def _items(prefix: str, n: str, maxn: int) -> str:
    parts = []
    for k in range(1, maxn + 1):
        sep = "" if k == 1 else ", "
        parts.append(f"(CASE WHEN {n} >= {k} THEN '{sep}\"  {prefix} {k} of doc ' "
                     f"|| CAST(doc_id AS STRING) || '  \"' ELSE '' END)")
    return " || ".join(parts)


def critic_object_sql() -> str:
    """SQL expression (over ``documents``) for the critic's JSON object of each document."""
    lists = ", ".join(f"\"{name}\": ' || '[' || {_items(p, n, mx)} || ']' || '"
                      for name, p, n, mx in CRITIC_LISTS)
    actions = ("'[' || " + _items("action", N_ACTIONS, 2)
               + " || (CASE WHEN " + N_ACTIONS + " >= 1 THEN ', ' ELSE '' END) || '42, \"  \", null]'")
    score = _tenths("n_chars % 101")
    score = f"(CASE WHEN doc_id % 6 = 1 THEN '\"' || {score} || '\"' ELSE {score} END)"
    conf = f"(CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', \"confidence\": ' || {_tenths('doc_id % 13')} END)"
    verdict = "(CASE doc_id % 8 " + " ".join(
        f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERDICT_IN)) + " END)"
    return (f"('{{{lists}, \"improvement_actions\": ' || {actions} || ', \"score\": ' || {score} "
            f"|| {conf} || ', \"verdict\": \"' || {verdict} || '\"}}')")


def critic_wrap_sql(obj: str = "obj") -> str:
    """Wrap the object column: bare, ```json fence, plain fence, prose prefix, truncated."""
    return ("(CASE doc_id % 5 "
            f"WHEN 0 THEN {obj} "
            f"WHEN 1 THEN '```json' || chr(10) || {obj} || chr(10) || '```' "
            f"WHEN 2 THEN '```' || chr(10) || {obj} || chr(10) || '```' "
            f"WHEN 3 THEN 'Here is my evaluation of the answer.' || chr(10) || {obj} "
            f"ELSE substring({obj}, 1, length({obj}) - 1) END)")


def judge_object_sql() -> str:
    score = _tenths("n_chars % 121")
    score = f"(CASE WHEN doc_id % 7 = 5 THEN '\"n/a\"' ELSE {score} END)"
    flag = "(CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\"yes\"' ELSE '0' END)"
    return (f"('{{\"factual_accuracy_score\": ' || {score} || ', \"hallucinations_detected\": ' "
            f"|| {flag} || ', \"reasoning\": \"One sentence.\"}}')")


def judge_wrap_sql(obj: str = "obj") -> str:
    """Wrap a judge object: bare, ```json fence, or prose without JSON."""
    return ("(CASE doc_id % 3 "
            f"WHEN 0 THEN {obj} "
            f"WHEN 1 THEN '```json' || chr(10) || {obj} || chr(10) || '```' "
            "ELSE 'Score: ' || CAST(n_chars % 121 AS STRING) || ' of 120, no JSON here.' END)")


def critic_replies_sql(src: str = "documents") -> str:
    """A full query (both dialects) producing (doc_id, raw_response)."""
    return (f"SELECT doc_id, {critic_wrap_sql()} AS raw_response FROM "
            f"(SELECT doc_id, n_chars, {critic_object_sql()} AS obj FROM {src})")


def critic_replies(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, more document columns, raw_response): one critic reply per document. The object is built in one
    projection and wrapped in the next, so the expression is not repeated per branch."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", *more, "n_chars", f"{critic_object_sql()} AS obj")
    return docs.selectExpr("doc_id", *more, f"{critic_wrap_sql()} AS raw_response")


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "n_chars", f"{judge_object_sql()} AS obj")
    return docs.selectExpr("doc_id", f"{judge_wrap_sql()} AS raw_response")


# ---------------------------------------------------------------- trajectories
def trajectory_iterations(events: DataFrame, cfg: LoopConfig = DEFAULT_LOOP,
                          run_divisor: int | None = 100, cut: bool = True) -> DataFrame:
    """Critique rows of the trajectory fixture: one event = one critique.

    run_id = user_id*100 + day(ts) (or user_id when ``run_divisor`` is None); iteration =
    row_number by (ts, event_id); score = least(value/10, 10); hallucination = event 'error';
    factual error = event 'signup'; verdict = score band.

    With ``cut``, the rows the loop would have seen: it always exits at ``max_iterations``, so only the first
    ``max_iterations`` events of a run can matter. ``row_number() <= k`` is planned as a partial WindowGroupLimit *before* the
    shuffle: a run holding a third of all events is cut to k rows in every map task. Without, every
    event, numbered without a window over the run."""
    from critica.functions.critic import verdict_from_score

    run = (F.col("user_id") * F.lit(run_divisor) + F.dayofmonth("ts")) if run_divisor else F.col("user_id")
    ev = events.select(run.alias("run_id"), "ts", "event_id", "event_type", "value")
    if cut:
        w = Window.partitionBy("run_id").orderBy("ts", "event_id")
        ranked = ev.withColumn("iteration", F.row_number().over(w).cast("bigint")).filter(
            F.col("iteration") <= F.lit(cfg.max_iterations))
    else:
        ranked = number_rows(ev, ["run_id"], ["ts", "event_id"], "iteration")
    score = F.least(F.col("value") / F.lit(10.0), F.lit(10.0))
    return ranked.select(
        "run_id", "iteration", "event_id", "ts",
        score.alias("score"),
        (F.col("event_type") == "error").alias("has_hallucination"),
        (F.col("event_type") == "signup").alias("has_factual_error"),
        verdict_from_score(score).alias("verdict"),
        F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"),
        "value",
    )


def benchmark_results(events: DataFrame, cfg: LoopConfig = DEFAULT_LOOP) -> DataFrame:
    """Runs fixture: trajectory runs rolled up (A1); system by user_id % 4, query = day of month;
    factual accuracy = last score; latency = sum of ``value`` over the critiques that ran."""
    from critica.operators import benchmark as bm
    from critica.operators import trajectory as tj

    roll = tj.run_rollup(tj.trajectories(trajectory_iterations(events, cfg), cfg))
    user = F.floor(F.col("run_id") / 100)
    system = F.element_at(F.array(*[F.lit(s) for s in bm.SYSTEMS]), (user % 4 + 1).cast("int"))
    roll = roll.withColumn("system_name", system).withColumn(
        "query", F.concat(F.lit("day "), (F.col("run_id") % 100).cast("string")))
    return bm.results_from_rollup(roll)


# ---------------------------------------------------------------- stored completions
# Replies recorded for runs, all derived from the given tables: a generated answer is the assistant's turn,
# critiques and judgements are the documents' replies, chosen by the run's number n and the iteration.
# Both engines evaluate these expressions; N is the number of documents (doc_id 0 .. N - 1).
CRITIQUE_DOC = "(n + 17 * i) % N"
JUDGE_DOC = "(n * 3) % N"
GENERATE_FAILS = "n % 13 = 5"
CRITIQUE_FAILS = "(n + i) % 17 = 3"
REFINE_FAILS = "(n + i) % 19 = 4"
CORRUPT_FAILS = "doc_id % 23 = 7"
ERRORS = {"generate": "RuntimeError: generator unavailable", "critique": "RuntimeError: critic unavailable",
          "refine": "RuntimeError: refiner unavailable", "corrupt": "RuntimeError: corrupter unavailable"}
RUN_NUMBER = "conv_id * 31 + turn"


def run_key() -> str:
    """A run's key: conv_id and turn side by side, never folded into one number."""
    return "concat_ws(':', CAST(conv_id AS STRING), CAST(turn AS STRING))"


def run_completions(spark: SparkSession, sf_dir: str, runs: DataFrame, max_iterations: int = 3) -> DataFrame:
    """Stored completions (key, role, iteration, completion, latency_s, error) of ``runs`` (key, n, answer): generation,
    critiques and refinements of every iteration, and the judgement."""
    n_docs = table(spark, sf_dir, "documents").count()
    replies = critic_replies(spark, sf_dir).select(F.col("doc_id").alias("d"), "raw_response")
    judged = judge_replies(spark, sf_dir).select(F.col("doc_id").alias("d"), "raw_response")

    def rows(df, role, iteration, completion, latency, fails=None):
        error = f"CASE WHEN {fails} THEN '{ERRORS[role]}' END" if fails else "CAST(NULL AS STRING)"
        return df.selectExpr("key", f"'{role}' AS role", f"CAST({iteration} AS INT) AS iteration", f"{completion} AS completion",
                             f"CAST({latency} AS DOUBLE) AS latency_s", f"{error} AS error")

    turns = runs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(max_iterations))))
    critiqued = turns.withColumn("d", F.expr(CRITIQUE_DOC.replace("N", str(n_docs)))).join(replies, "d")
    weighed = runs.withColumn("d", F.expr(JUDGE_DOC.replace("N", str(n_docs)))).join(judged, "d")
    return (rows(runs, "generate", "1", "answer", "n % 7", GENERATE_FAILS)
            .unionByName(rows(critiqued, "critique", "i", "raw_response", "i", CRITIQUE_FAILS))
            .unionByName(rows(turns, "refine", "i", "concat(answer, ' (revision ', CAST(i AS STRING), ')')", "i * 2", REFINE_FAILS))
            .unionByName(rows(weighed, "judge", "1", "raw_response", "1")))


def document_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored completions keyed by doc_id: a corruption is the next document's text, the critique of turn i the reply
    of another document."""
    n_docs = table(spark, sf_dir, "documents").count()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    corrupt = docs.selectExpr(f"CAST((doc_id + {n_docs} - 1) % {n_docs} AS STRING) AS key", f"(doc_id + {n_docs} - 1) % {n_docs} AS doc_id",
                              "text").selectExpr(
        "key", "'corrupt' AS role", "1 AS iteration", "text AS completion", "CAST(1 AS DOUBLE) AS latency_s",
        f"CASE WHEN {CORRUPT_FAILS} THEN '{ERRORS['corrupt']}' END AS error")
    turns = docs.select(F.col("doc_id").alias("n")).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "d", F.expr(CRITIQUE_DOC.replace("N", str(n_docs))))
    critique = turns.join(critic_replies(spark, sf_dir).select(F.col("doc_id").alias("d"), "raw_response"), "d").selectExpr(
        "CAST(n AS STRING) AS key", "'critique' AS role", "i AS iteration", "raw_response AS completion",
        "CAST(i AS DOUBLE) AS latency_s", "CAST(NULL AS STRING) AS error")
    return corrupt.unionByName(critique)
