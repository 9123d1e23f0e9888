"""Line dedup with two Bloom filters (once seen, twice seen).

1. Filters are plain bit arrays with ``BITS_PER_KEY`` bits for each distinct key (counted approximately first), so
   they filter alike at every corpus size; ``log2_bits`` fixes the size instead. Each task hashes the
   distinct line keys of its documents into a *once* filter; a key whose bits are all set already goes into the *twice*
   filter too. A task emits its filters cut into segments and compressed.
2. Segments merge in a tree (``FAN_IN`` at a time, so a group stays small however many tasks
   there are). ``twice = twice1 | twice2 | once1 & once2``: a bit set in both halves is a suspect.
3. Only lines whose bits are all set in the merged *twice* filter shuffle, by their whole key,
   for the exact document count. A full filter makes more lines suspects; it never loses one.

The twice filter is a broadcast of ``2**log2_bits / 8`` bytes, at most ``2**MAX_LOG2_BITS / 8`` (128 MB). A corpus with more
distinct keys than that holds is worked in key ranges: each range reads the documents once, with its own filter.

Definitions. A line's key is the line stripped of ASCII white space with A-Z lower-cased. Each row
is a document, also where ``doc_id`` repeats or is null. Null text is one empty line. Keys shorter
than ``min_chars`` code points are never dropped. ``keep="none"`` drops every line of a repeated key,
``keep="first"`` keeps its first occurrence (smallest doc_id, nulls last; then smallest line
number; copies of one row share that choice). ``keep="text"`` drops them as "none" does, except that among
documents that would lose over half of their text (bytes of stripped lines) the first occurrence stays: there the
repeated lines are copied text, which would otherwise be gone with its last copy."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.llm.common import TO_LOWER, lower_ascii, salted_join, stored

BITS_PER_KEY = 8
MIN_LOG2_BITS, MAX_LOG2_BITS = 20, 30
SEGMENT = 1 << 16
FAN_IN = 64
SPACES = b" \t\n\x0b\x0c\r"
ROW_KEY = ("doc_id", "text_hash")


def with_row_key(docs: DataFrame, *columns: Column) -> DataFrame:
    """doc_id, a hash of the text, the text. Equal rows get equal keys, and equal results."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.coalesce("text", F.lit("")).alias("text"), *columns)


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).translate(TO_LOWER)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _positions(keys: list[bytes], log2_bits: int) -> np.ndarray:
    """Two bit positions of each key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    shift = np.uint64(64 - log2_bits)
    return np.stack([h >> shift, (h * np.uint64(0x9E3779B97F4A7C15)) >> shift]).astype(np.int64)


def _test(bits: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _set(bits: np.ndarray, pos: np.ndarray) -> None:
    np.bitwise_or.at(bits, (pos >> 3).ravel(), (1 << (pos & 7)).astype(np.uint8).ravel())


def _of_range(keys: list[bytes], part: int, parts: int) -> list[bytes]:
    return keys if parts == 1 else [k for k in keys if zlib.crc32(k) % parts == part]


def _filters(log2_bits: int, min_chars: int, key_range: tuple[int, int]):
    size = 1 << (log2_bits - 3)

    def build(batches):
        from pyspark import TaskContext

        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                keys = list({k for line in text.encode().split(b"\n")
                             if _long_enough(k := line_key(line), min_chars)})
                keys = _of_range(keys, *key_range)
                if keys:
                    pos = _positions(keys, log2_bits)
                    _set(twice, pos[:, _test(once, pos)])
                    _set(once, pos)
        part = TaskContext.get().partitionId()
        used = [s for s in range(0, size, SEGMENT) if once[s:s + SEGMENT].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s // SEGMENT for s in used], pa.int32()), pa.array([part] * len(used), pa.int32()),
             *(pa.array([zlib.compress(bits[s:s + SEGMENT].tobytes(), 1) for s in used], pa.binary())
               for bits in (once, twice))], ["segment", "part", "once", "twice"])

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for o, t in zip(pdf["once"], pdf["twice"]):
        o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pd.DataFrame([(pdf["segment"].iloc[0], pdf["part"].iloc[0] // FAN_IN,
                          zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))],
                        columns=["segment", "part", "once", "twice"])


FILTER_SCHEMA = "segment int, part int, once binary, twice binary"


def filter_size(docs: DataFrame) -> tuple[int, int]:
    """(log2 of the bits of a filter, key ranges) for the corpus: ``BITS_PER_KEY`` bits for each distinct line key."""
    line = F.explode(F.split("text", "\n", -1))
    key = lower_ascii(F.btrim(F.col("line"), F.lit(SPACES.decode())))
    distinct = docs.select(line.alias("line")).agg(F.approx_count_distinct(key, 0.02)).first()[0]
    need = max(MIN_LOG2_BITS, math.ceil(math.log2(max(distinct, 1) * BITS_PER_KEY)))
    return min(need, MAX_LOG2_BITS), 1 << max(0, need - MAX_LOG2_BITS)


def twice_filter(docs: DataFrame, log2_bits: int, min_chars: int, key_range: tuple[int, int] = (0, 1)) -> np.ndarray:
    """The merged twice filter, ``2**log2_bits`` bits, of the keys of one range (number, of so many)."""
    segments = stored(docs.select("text").mapInArrow(_filters(log2_bits, min_chars, key_range), FILTER_SCHEMA), "bloom")
    parts = (segments.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        segments = (segments.withColumn("group", F.col("part").cast("int") / F.lit(FAN_IN))
                    .groupBy("segment", F.floor("group").alias("group")).applyInPandas(_merge, FILTER_SCHEMA))
        parts = -(-parts // FAN_IN)
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    for row in segments.select("segment", "twice").collect():
        part = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        bits[row["segment"] * SEGMENT:][:len(part)] = part
    return bits


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, log2_bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(suspects: row key, key, first line number, bytes of the key's lines and of all lines; repeated keys with their
    exact document count)."""
    bits, ranges = (log2_bits, 1) if log2_bits else filter_size(docs)
    found = None
    for r in range(ranges):
        part = stored(suspected(docs, min_chars, bits, (r, ranges)), "suspects")
        found = part if found is None else found.unionByName(part)
    counts = found.groupBy("key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return found, counts


def suspected(docs: DataFrame, min_chars: int, log2_bits: int, key_range: tuple[int, int]) -> DataFrame:
    """The lines of one key range whose bits are all set in the range's twice filter."""
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, log2_bits, min_chars, key_range))

    def suspects(batches):
        bits = twice.value
        for batch in batches:
            rows, out_keys, out_lines, out_bytes, out_totals = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                first: dict[bytes, int] = {}
                found, total = Counter(), 0
                for n, line in enumerate(text.encode().split(b"\n")):
                    k = line_key(line)
                    total += len(k)
                    if _long_enough(k, min_chars):
                        first.setdefault(k, n)
                        found[k] += 1
                keys = _of_range(list(first), *key_range)
                if keys:
                    hit = _test(bits, _positions(keys, log2_bits))
                    for k in (k for k, ok in zip(keys, hit) if ok):
                        rows.append(i)
                        out_keys.append(k)
                        out_lines.append(first[k])
                        out_bytes.append(found[k] * len(k))
                        out_totals.append(total)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                 pa.array(out_keys, pa.binary()), pa.array(out_lines, pa.int32()),
                 pa.array(out_bytes, pa.int64()), pa.array(out_totals, pa.int64())],
                ["doc_id", "text_hash", "key", "line", "bytes", "total"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(
        suspects, "doc_id long, text_hash long, key binary, line int, bytes long, total long")


def _grouped(drops: DataFrame) -> DataFrame:
    return drops.groupBy(*ROW_KEY).agg(F.collect_set(F.struct("key", "spare")).alias("drops"))


def _spared(drops: DataFrame) -> DataFrame:
    """Each row's dropped keys, with the line that stays in the row that has the key first, else -1."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    first = (drops.withColumn("at", order).groupBy("key").agg(F.min("at").alias("at"))
             .select("key", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"),
                     F.lit(True).alias("is_first")))
    return _grouped(drops.alias("d").join(
        first.alias("f"), (F.col("d.key") == F.col("f.key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
        & (F.col("d.text_hash") == F.col("f.text_hash")), "left").select(
        "d.doc_id", "d.text_hash", "d.key",
        F.when(F.col("f.is_first"), F.col("d.line")).otherwise(F.lit(-1)).alias("spare")))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none",
                log2_bits: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (without the dropped lines) and the input's other columns.

    Extra columns may have any name; ``n_lines`` and ``n_dropped`` are replaced. An empty table stays empty."""
    names = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    extra = [f"extra_{i}" for i in range(len(names))]  # out of the way of the names used here
    docs = with_row_key(docs, *[F.col(f"`{n}`").alias(e) for n, e in zip(names, extra)])
    found, counts = repeated_lines(docs, min_docs, min_chars, log2_bits)
    drops = salted_join(found, counts, "key", "text_hash", "left_semi")
    if keep == "text":
        lost = drops.groupBy(*ROW_KEY, "total").agg(F.collect_set(F.struct("key", "line", "bytes")).alias("drops"))
        sizes = F.aggregate("drops", F.lit(0).cast("long"), lambda n, x: n + x["bytes"])
        lost = stored(lost.select(*ROW_KEY, "drops", (sizes * 2 > F.col("total")).alias("mostly")), "lost")
        copied = lost.filter("mostly").select(*ROW_KEY, F.explode("drops").alias("d")).select(*ROW_KEY, "d.key", "d.line")
        drops = _spared(copied).unionByName(lost.filter("not mostly").select(
            *ROW_KEY, F.transform("drops", lambda x: F.struct(x["key"].alias("key"), F.lit(-1).alias("spare"))).alias("drops")))
    else:
        drops = _spared(drops) if keep == "first" else _grouped(drops.withColumn("spare", F.lit(-1)))
    joined = docs.alias("a").join(
        drops.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("a.text_hash") == F.col("b.text_hash")), "left").select(
        "a.doc_id", "a.text", *[f"a.{c}" for c in extra], "b.drops")
    cut = joined.select("doc_id", "text", F.col("drops.key").alias("keys"), F.col("drops.spare").alias("spares"), *extra)
    schema = T.StructType([cut.schema["doc_id"], T.StructField("text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                           *[cut.schema[c] for c in extra]])

    def drop(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys, spares in zip(*(batch.column(c).to_pylist() for c in ("text", "keys", "spares"))):
                lines = text.encode().split(b"\n")
                spare = dict(zip(keys or (), spares or ()))
                kept = [line for n, line in enumerate(lines) if spare.get(line_key(line), n) == n] if keys else lines
                texts.append(b"\n".join(kept).decode() if keys else text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64()), *(batch.column(c) for c in extra)], schema.names)

    return cut.mapInArrow(drop, schema).withColumnsRenamed(dict(zip(extra, names)))


def op9(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
