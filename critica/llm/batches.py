"""Documents in batches, and the exchange of sorted 64-bit keys between them.

Counting every word, word pair or word window of a corpus as rows costs more in row handling than in
data. So documents are written once as a bucketed table of batches (a few MB of text a row).
A batch sends its *distinct* keys, cut by key range into shards, as packed arrays; Spark
shuffles these by shard, a task merges one shard at a time, and the answers come back to the batch by
a join that does not move the texts again, since the table is bucketed by batch. Frequent
keys are pre-aggregated: a key is in a shard once a batch at most."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.llm.common import shuffle_partitions
from critica.session import scratch_path

BATCH_CHARS = 4_000_000
SHARD_KEYS = 1_500_000
BATCH_SCHEMA = "batch long, doc_id array<long>, text array<string>"
SHARD_SCHEMA = "batch long, shard long, keys binary, counts binary"
REPLY_SCHEMA = "batch long, shard long, reply binary"


def _gather(batches):
    from pyspark import TaskContext

    batch = TaskContext.get().partitionId() << 33
    ids, texts, size = [], [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([batch], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))],
            ["batch", "doc_id", "text"])

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if texts and size + len(text or "") > BATCH_CHARS:
                yield row()
                batch, ids, texts, size = batch + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text or "")
            size += len(text or "")
    if texts:
        yield row()


def batch_table(docs: DataFrame) -> DataFrame:
    """The batches as a bucketed table whose files are in the shared scratch folder; gone when the driver ends."""
    spark = docs.sparkSession
    name = f"llm_batches_{uuid.uuid4().hex}"
    (docs.select("doc_id", "text").mapInArrow(_gather, BATCH_SCHEMA).write.format("parquet")
     .option("compression", "zstd").option("path", scratch_path(spark, "batches"))
     .bucketBy(shuffle_partitions(spark), "batch").saveAsTable(name))
    return spark.table(name)


def shards_for(batches: DataFrame, keys_per_char: float) -> int:
    """Shards of about ``SHARD_KEYS`` keys, from the corpus's size in characters."""
    chars = batches.agg(F.sum(F.aggregate("text", F.lit(0).cast("long"), lambda a, t: a + F.length(t)))).first()[0] or 0
    return max(1, -(-int(chars * keys_per_char) // SHARD_KEYS))


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as 6- or 8-byte steps."""
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(keys) and int(steps[1:].max(initial=0)) < 1 << 48:
        return b"\x06" + keys[:1].tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x08" + keys.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"\x08":
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.zeros(((len(data) - 9) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    out[1:] = steps.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=np.uint64)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each key range begins in sorted ``keys``."""
    bounds = np.array([(s << 64) // shards for s in range(shards)], dtype=object).astype(np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def send(batch: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """Rows (batch, shard, keys, counts) of sorted distinct ``keys``; counts as given (any dtype the receiver knows)."""
    edges = shard_edges(keys, shards)
    return [(batch, s, pack_sorted(keys[a:b]), pack(counts[a:b]))
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def rows_to_batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


SHARD_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
SHARD_NAMES = ["batch", "shard", "keys", "counts"]


def merged(pdf: pd.DataFrame, count_dtype) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """One shard's (distinct keys, their totals, each row's places among them)."""
    parts = [unpack_sorted(k) for k in pdf["keys"]]
    weights = [unpack(c, count_dtype) for c in pdf["counts"]]
    keys = np.unique(np.concatenate(parts))
    totals = np.zeros(len(keys), np.int64)
    places = []
    for p, w in zip(parts, weights):
        at = np.searchsorted(keys, p)
        totals[at] += w  # a row's keys are distinct
        places.append(at.astype(np.uint32))
    return keys, totals, places


def answer(sent: DataFrame, reply: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(batch, replies): each batch's answers, array<struct<shard, reply>> in shard order."""
    return sent.groupBy("shard").applyInPandas(reply, REPLY_SCHEMA)


def with_replies(batches: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Join answers to their batches; the bucketed side stays where it is."""
    grouped = replies.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "reply"))).alias(name))
    return batches.join(grouped.hint("shuffle_hash"), "batch", "left")


def concat_replies(replies: list[dict] | None, dtype) -> np.ndarray:
    return np.concatenate([unpack(r["reply"], dtype) for r in replies]) if replies else np.empty(0, dtype)
