"""Large JSON array files, read by many tasks.

Spark reads a JSON array with ``multiLine``: one task a file, the whole file in one value. Here the file is read as text
whose separator is ``}``, which Spark splits by byte ranges like any text. A piece of text between two ``}`` changes
the reader's state - inside a string or not, nesting depth - in a way that depends only on whether it starts inside
a string. So each byte range is summed up for both cases in parallel, the sums are composed in order (a row
a range), and with its true start each range cuts out its records in parallel. A record ends where a ``}``
outside of strings brings the depth back to 1; what lies over a range's edge is put together by (file, range it began in).

Holds for valid JSON (there, no ``}`` follows an odd number of backslashes). Elements that are no objects are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.session import stored

_ESCAPED = re.compile(r"\\.", re.S)
RANGES = [("file", "string", pa.string()), ("start", "long", pa.int64()), ("first", "string", pa.string()), ("quotes", "long", pa.int64()),
          ("outside", "long", pa.int64()), ("inside", "long", pa.int64())]
PIECES = [("file", "string", pa.string()), ("start", "long", pa.int64()), ("kind", "string", pa.string()), ("text", "string", pa.string())]


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, _, t) in zip(cols, columns)], [n for n, _, _ in columns])


def _schema(columns) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in columns)


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, value): the text between closing braces, in file order inside each byte range (``start``)."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def change(value: str) -> tuple[int, int, int]:
    """(quotes, depth change if it starts outside of a string, if it starts inside), the ``}`` after it included."""
    parts = _ESCAPED.sub("", value).split('"') if '"' in value else [value]
    depth = [0, 0]
    for i, p in enumerate(parts):
        depth[i & 1] += p.count("{") + p.count("[") - p.count("]")
    depth[(len(parts) - 1) & 1] -= 1
    return len(parts) - 1, depth[0], depth[1]


def _sum_up(batches) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for b in batches:
        for file, start, value in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now[:2] != [file, start]:
                if now:
                    rows.append(tuple(now))
                now = [file, start, None, 0, 0, 0]
            if now[2] is None and value.strip():
                now[2] = value.strip().lstrip("﻿")[:1]
            quotes, outside, inside = change(value)
            if now[3] & 1:
                outside, inside = inside, outside
            now[3] += quotes
            now[4] += outside
            now[5] += inside
    if now:
        rows.append(tuple(now))
    yield _batch(rows, RANGES)


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """Records (``whole``) and what lies over a range's edges: ``lead`` up to the first end, ``trail`` after the last, or ``middle``."""
    now, rows, text, ended, inside, depth = None, [], [], False, False, 0

    def leave():
        if now:
            rows.append((*now, "trail" if ended else "middle", "".join(text)))

    for b in batches:
        for file, start, value, in_string, level in zip(*(c.to_pylist() for c in b.columns)):
            if now != (file, start):
                leave()
                now, text, ended, inside, depth = (file, start), [], False, in_string, level
            quotes, outside, within = change(value)
            before = depth
            depth += within if inside else outside
            inside ^= bool(quotes & 1)
            text += [value, "}"]
            if not inside and depth == 1 and before >= 0:  # a closing brace that leaves depth 1 closed a record
                rows.append((file, start, "whole" if ended else "lead", "".join(text)))
                text, ended = [], True
            if len(rows) >= 5000:
                yield _batch(rows, PIECES)
                rows.clear()
    leave()
    yield _batch(rows, PIECES)


def ranges(pieces: DataFrame) -> DataFrame:
    """One row a byte range: (file, start, first, quotes, outside, inside) and its true start: in_string, level."""
    summed = stored(pieces.mapInArrow(_sum_up, _schema(RANGES)), "ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = summed.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    moved = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    return known.withColumn("__moved", moved).withColumn(
        "level", F.coalesce(F.sum("__moved").over(before), F.lit(0)).cast("int")).drop("__moved")


def kinds(known: DataFrame) -> DataFrame:
    """(file, is_array): told from each file's first character that is not blank."""
    return known.groupBy("file").agg((F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start"))) == "[").alias("is_array"))


def read_array(spark: SparkSession, path: str | list[str], schema: T.StructType, known: DataFrame | None = None) -> DataFrame:
    """The records of JSON array files. ``known``: ``ranges`` of the same files, where they were looked at before."""
    pieces = fragments(spark, path)
    known = (ranges(pieces) if known is None else known).select("file", "start", "in_string", "level")
    # one row a byte range (128 MB by default): 10 million of them would be 1 PB
    cut = stored(pieces.join(F.broadcast(known), ["file", "start"]).select("file", "start", "value", "in_string", "level")
                 .mapInArrow(_cut, _schema(PIECES)), "pieces")
    edges = cut.filter("kind <> 'whole'")
    ended = F.max(F.when(F.col("kind") == "trail", F.col("start"))).over(
        Window.partitionBy("file").orderBy("start").rangeBetween(Window.unboundedPreceding, -1))
    began = F.when(F.col("kind") == "trail", F.col("start")).otherwise(F.coalesce(ended, F.lit(-1)))
    joined = edges.withColumn("began", began).groupBy("file", "began").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", F.col("kind") != "lead", "text"))),
                                 lambda p: p["text"]), "").alias("text"))
    texts = cut.filter("kind = 'whole'").select("text").unionByName(joined.select("text"))
    bare = texts.select(F.regexp_replace("text", r"^[\s,\[\x{feff}]+", "").alias("text")).filter(F.col("text").startswith("{"))
    return bare.select(F.from_json("text", schema).alias("r")).select("r.*")
