"""M9 evaluate_answer and M10 evaluate_pipeline as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.config import DEFAULT_METRICS, MetricsConfig
from critica.functions import text as tx
from critica.functions.common import py_round

METRIC_COLUMNS = ("char_count", "word_count", "sentence_count", "has_structure",
                  "avg_sentence_length", "lexical_diversity", "coverage_score", "composite_score")


def evaluate_answer(df: DataFrame, answer: str = "answer", query: str | None = "query",
                    cfg: MetricsConfig = DEFAULT_METRICS, prefix: str = "") -> DataFrame:
    """M9: append the eight metric columns (rounded 2/3/3/2 like the scorer being reproduced).

    Tokens and sentences are materialised once as intermediate columns; the regexes are not
    repeated per metric (Catalyst keeps expensive expressions referenced twice in their own
    projection)."""
    keep = df.columns
    q = F.col(query) if query else F.lit(None).cast("string")
    s1 = df.select(*keep, tx.tokens(F.col(answer)).alias("__w"),
                   tx.sentence_piece_count(F.col(answer)).alias("__ns"),
                   tx.has_structure(F.col(answer)).alias("__st"),
                   q.alias("__q"), tx.query_keywords(q).alias("__kw"))
    s2 = s1.select(*keep, "__w", "__st", "__q", "__kw",
                   F.size("__w").alias("__nw"),
                   F.greatest(F.col("__ns"), F.lit(1)).alias("__nsent"))
    s3 = s2.select(*keep, "__nw", "__nsent", "__st",
                   tx.avg_sentence_length("__nw", "__nsent").alias("__asl"),
                   tx.lexical_diversity("__w").alias("__lex"),
                   tx.coverage_score("__w", "__q", keywords="__kw").alias("__cov"))
    comp = tx.composite_score("__nw", "__st", "__lex", "__cov", "__asl", cfg)
    p = prefix
    return s3.select(
        *keep,
        F.length(F.col(answer)).cast("bigint").alias(f"{p}char_count"),
        F.col("__nw").cast("bigint").alias(f"{p}word_count"),
        F.col("__nsent").cast("bigint").alias(f"{p}sentence_count"),
        F.col("__st").alias(f"{p}has_structure"),
        py_round("__asl", 2).alias(f"{p}avg_sentence_length"),
        py_round("__lex", 3).alias(f"{p}lexical_diversity"),
        py_round("__cov", 3).alias(f"{p}coverage_score"),
        py_round(py_round(comp, 2), 2).alias(f"{p}composite_score"),
    )


def evaluate_pipeline(iterations: DataFrame, run_queries: DataFrame, run_key: str = "run_id",
                      order_key: str = "iteration", answer: str = "answer",
                      cfg: MetricsConfig = DEFAULT_METRICS) -> DataFrame:
    """All initial and final answer metrics per run, the composite's delta, the iteration count and, where
    ``run_queries`` has it, ``converged``.

    ``iterations``: (run_key, order_key, answer) - one row per critiqued answer.
    ``run_queries``: (run_key, query) - one row per run.

    The per-iteration composite scores stay a long table (``iteration_metrics``);
    the rollup uses ``min_by``/``max_by``, which aggregate partially before the shuffle, so a run
    with very many iterations is never gathered into one array."""
    scored = iteration_metrics(iterations, run_queries, run_key, order_key, answer, cfg)
    has_flag = "converged" in run_queries.columns
    agg = scored.groupBy(run_key).agg(
        *[F.min_by(F.col(m), F.col(order_key)).alias(f"initial_{m}") for m in METRIC_COLUMNS],
        *[F.max_by(F.col(m), F.col(order_key)).alias(f"final_{m}") for m in METRIC_COLUMNS],
        F.count(F.lit(1)).alias("iterations_run"),
        *([F.bool_or("converged").alias("converged")] if has_flag else []))
    delta = py_round(F.col("final_composite_score") - F.col("initial_composite_score"), 2)
    return agg.withColumn("score_delta", delta)


def iteration_metrics(iterations: DataFrame, run_queries: DataFrame, run_key: str = "run_id", order_key: str = "iteration",
                      answer: str = "answer", cfg: MetricsConfig = DEFAULT_METRICS) -> DataFrame:
    """M9 of every iteration of every run: M10's per-iteration composites as a long table."""
    return evaluate_answer(iterations.select(run_key, order_key, answer).join(run_queries, run_key, "inner"),
                           answer=answer, query="query", cfg=cfg)


def conversation_iterations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bind M10 to a conversation table: every assistant turn is one iteration of the run
    ``conv_id``; the run's query is its first user turn; it has converged if the last word is the assistant's
    (``min_by`` and ``max_by`` aggregate partially)."""
    its = conversations.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("iteration"),
        F.col("text").alias("answer"))
    is_user = F.col("role") == "user"
    qs = conversations.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("query"),
        (F.max_by("role", "turn") == "assistant").alias("converged"), F.bool_or(is_user).alias("__asked"))
    qs = qs.filter("__asked").drop("__asked")
    return its, qs
