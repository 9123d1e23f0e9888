"""Sources and sinks S1-S6.

S1 read_queries    text file, one query per line, stripped, blanks dropped
S2 read_training   JSON lines or JSON array files, both splittable, with an explicit schema
S3 cap_samples     first n records in file order, or in a stated order
S4 write_training  training records as JSON lines / parquet
S5 write_report    results / summaries / improvements tables, published by a manifest
S6 qa_pairs        (query, answer) pairs from a conversation table
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.functions.common import is_blank, ustrip
from critica.operators.ordering import number_rows, with_position
from critica.session import stored
from critica.sources import json_array as ja

# The field names of training records.
FEEDBACK_SCHEMA = T.StructType([
    T.StructField("factual_errors", T.ArrayType(T.StringType())),
    T.StructField("hallucinations", T.ArrayType(T.StringType())),
    T.StructField("missing_concepts", T.ArrayType(T.StringType())),
    T.StructField("logical_flaws", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("verdict", T.StringType()),
])

TRAINING_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("feedback", FEEDBACK_SCHEMA),
])


# ---------------------------------------------------------------- S1
def queries_from_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Strip every line (Unicode whitespace) and keep the non-blank ones.

    A query's position in its file is kept as ``line_no`` when the input carries one."""
    out = lines.select(*[c for c in lines.columns if c != text_col],
                       ustrip(F.col(text_col)).alias("query"))
    return out.filter(~is_blank(F.col("query")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.text`` -> strip -> drop blanks. Splittable, so a large query file is
    read by many tasks."""
    return queries_from_lines(spark.read.text(path))


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of a text column as rows: (doc_id, line_no, value). ``posexplode`` keeps each
    document's lines inside the task that read it."""
    out = documents.select(
        "doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "value"))
    return out.withColumn("line_no", F.col("line_no").cast("bigint"))


# ---------------------------------------------------------------- S2
def read_training(spark: SparkSession, path: str, json_array: bool | None = None) -> DataFrame:
    """Training records with a fixed schema (no inference).

    Each file holds one JSON array or JSON lines; which, is told file by file from the first character that is not blank,
    unless ``json_array`` says so for all. Both are read by many tasks, however large a file is (``json_array.py``)."""
    reader = spark.read.schema(TRAINING_SCHEMA)
    if json_array is False:
        return reader.json(path)
    if json_array:
        return ja.read_array(spark, path, TRAINING_SCHEMA)
    known = stored(ja.ranges(ja.fragments(spark, path)), "ranges")
    arrays = [r["file"] for r in ja.kinds(known).filter("is_array").collect()]  # file names only
    if not arrays:
        return reader.json(path)
    in_arrays = ja.read_array(spark, arrays, TRAINING_SCHEMA)
    others = [r["file"] for r in ja.kinds(known).filter("NOT is_array OR is_array IS NULL").collect()]
    return in_arrays.unionByName(reader.json(others)) if others else in_arrays


# ---------------------------------------------------------------- S3
def cap_samples(df: DataFrame, n: int, order_by: list[Column] | list[str] | None = None) -> DataFrame:
    """S3: the first ``n`` records in file order (``df`` read from files), ties and all: a filter on each row's place, no sort.

    With ``order_by``, a stated total order: ``orderBy().limit()`` plans as TakeOrderedAndProject, so each task
    keeps its own top n."""
    if order_by is None:
        return with_position(df, "__position").filter(F.col("__position") < n).drop("__position")
    return df.orderBy(*order_by).limit(n)


# ---------------------------------------------------------------- S4
def write_training(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write training records (JSON lines by default), UTF-8, one file per task."""
    df.select("query", "answer", "feedback").write.mode("overwrite").format(fmt).save(path)


# ---------------------------------------------------------------- S5
REPORT_TABLES = ("results", "summaries", "improvements")
MANIFEST = T.StructType([T.StructField("stamp", T.StringType()), T.StructField("folder", T.StringType()),
                         T.StructField("format", T.StringType())])


def write_report(results: DataFrame, summaries: DataFrame, improvements: DataFrame, path: str, fmt: str = "json") -> dict[str, str]:
    """The benchmark report as three tables under ``path``; per-query results partitioned by system.

    The tables go to a new time-stamped folder. The report is published by one row in ``path/manifests``, written last: readers
    (``read_report``) see all three tables of a report or none, and a run that fails leaves the report before it as it was."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%fZ")
    folder = f"report-{stamp}-{uuid.uuid4().hex[:8]}"
    out = {t: f"{path}/{folder}/{t}" for t in REPORT_TABLES}
    results.write.partitionBy("system_name").format(fmt).save(out["results"])
    summaries.coalesce(1).write.format(fmt).save(out["summaries"])
    improvements.coalesce(1).write.format(fmt).save(out["improvements"])
    spark = results.sparkSession
    spark.createDataFrame([(stamp, folder, fmt)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return {**out, "stamp": stamp}


def read_report(spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None,
                stamp: str | None = None) -> dict[str, DataFrame]:
    """The tables of the last published report (or of the one published at ``stamp``)."""
    known = spark.read.schema(MANIFEST).json(f"{path}/manifests")
    last = known.filter(F.lit(stamp is None) | (F.col("stamp") == stamp)).orderBy(F.col("stamp").desc(), "folder").first()
    if last is None:
        raise ValueError(f"no report published under {path}")
    reader = lambda t: spark.read.schema(schemas[t]) if schemas else spark.read
    return {t: reader(t).format(last["format"]).load(f"{path}/{last['folder']}/{t}") for t in REPORT_TABLES}


# ---------------------------------------------------------------- S6
def dense_turns(conversations: DataFrame) -> bool:
    """Whether every conversation's turns are consecutive numbers, each once."""
    once = conversations.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("c"))
    gaps = once.groupBy("conv_id").agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("n"), F.count("turn").alias("t"),
                                       (F.max("turn") - F.min("turn") + 1).alias("span"))
    return gaps.filter("c > 1 OR n <> t OR n <> span").isEmpty()


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn whose next row in turn order is an assistant's -> (conv_id, turn, query, answer).

    Joined on (conv_id, number + 1), so one very long conversation is spread over many tasks. The number is the
    turn where turns are dense (looked up on the slim columns first); where they have gaps or ties, rows
    are numbered without a window over the conversation."""
    c = conversations.select("conv_id", "turn", "role", "text")
    if dense_turns(c):
        c = c.withColumn("row", F.col("turn"))
    else:
        c = number_rows(c, ["conv_id"], ["turn", "role", "text"], "row")
    u = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", (F.col("row") + 1).alias("next_turn"), F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv_id"), F.col("row").alias("a_turn"),
        F.col("text").alias("answer"))
    j = u.join(a, (u.conv_id == a.a_conv_id) & (u.next_turn == a.a_turn), "inner")
    return j.select("conv_id", "turn", "query", "answer")
