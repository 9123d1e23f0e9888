"""Training-set construction (D1, D3, D4, D5) and training records for S2/S4/T8/T9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.functions import prompts as pr
from critica.functions.common import ustrip
from critica.functions.critic import VERDICTS, verdict_rank
from critica.operators.ordering import number_rows, with_position


def expand_corruptions(df: DataFrame, n: int = 1, key: str = "query_id", answer: str = "answer",
                       seed: int = 42) -> DataFrame:
    """Each input row -> one 'good' variant (0) and ``n`` corruption variants (1..n) whose
    prompt is a seeded, hash-picked corruption instruction (T6). Rows multiply in place; no
    shuffle."""
    out = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(int(n)))))
    corrupted = F.col("variant") > 0
    return out.select(
        "*", corrupted.alias("is_corrupted"),
        F.when(corrupted, pr.corruption_index(key, "variant", seed)).alias("template_index"),
        F.when(corrupted, pr.corruption_prompt(answer, key, "variant", seed)).alias("corruption_prompt"))


def verdict_index(verdict) -> "F.Column":
    """D3: poor..excellent -> 0..3; unknown -> 0."""
    return verdict_rank(verdict)


def verdict_from_index(idx) -> "F.Column":
    """D3 inverse: 0..3 -> verdict; unknown -> poor."""
    arr = F.array(*[F.lit(v) for v in VERDICTS])
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.when((i >= 0) & (i < len(VERDICTS)), F.element_at(arr, (i + 1).cast("int"))).otherwise(F.lit("poor"))


def split_hash(df: DataFrame, by: str = "query", train_fraction: float = 0.9,
               seed: int = 42) -> DataFrame:
    """Deterministic train/val split by a portable hash of the grouping key, so a good
    answer and its corruptions always land on the same side."""
    buckets = 100
    cut = int(round(train_fraction * buckets))
    b = F.pmod(pr.portable_hash(F.col(by), F.lit(seed)), F.lit(buckets))
    return df.withColumn("split", F.when(b < cut, F.lit("train")).otherwise(F.lit("val")))


def split_prefix(df: DataFrame, order_col: str | None = None, train_fraction: float = 0.9) -> DataFrame:
    """The first max(1, int(f*n)) rows are train, the rest val, with ``row_index`` from 0.

    Rows are in file order (``df`` read from files; no shuffle). With ``order_col`` they are in that order and, where it ties, in
    file order: a range partitioning on both, so a table with a single order value is spread over tasks too."""
    if order_col is None:
        idx = with_position(df, "row_index")
    else:
        ranked = number_rows(with_position(df, "__position"), [], [order_col, "__position"], "row_index")
        idx = ranked.drop("__position").withColumn("row_index", F.col("row_index") - 1)
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    cut = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(train_fraction)))
    return idx.join(F.broadcast(total)).withColumn(
        "split", F.when(F.col("row_index") < cut, F.lit("train")).otherwise(F.lit("val"))).drop("__total")


def first_line(text) -> "F.Column":
    t = F.col(text) if isinstance(text, str) else text
    return ustrip(F.substring_index(t, "\n", 1))


def training_records(critiqued: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic, query, answer, feedback) for labelled documents: query = first line,
    answer = whole text, feedback = the six trained fields of the parsed critic reply.

    ``critiqued``: (doc_id, text, feedback) from one pass over the documents; only the labels are joined."""
    fb = F.struct(*[F.col(f"feedback.{n}").alias(n) for n in (
        "factual_errors", "hallucinations", "missing_concepts", "logical_flaws", "score", "verdict")])
    docs = critiqued.select("doc_id", first_line("text").alias("query"), F.col("text").alias("answer"), fb.alias("feedback"))
    return docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id")
