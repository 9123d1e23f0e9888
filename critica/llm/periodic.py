"""Periodic runs in word sequences: recursive frequency splitting, then a lag scan.

A run is a maximal stretch of at least ``max(min_words, 3 * period)`` consecutive words with smallest period ``period``.

**Splitting.** A run holds each of its words at least three times, so a word found fewer than three times in a segment
is in no run of that segment and splits it. The parts have smaller counts, so the rule is applied again until no part
changes; parts of fewer than ``min_words`` words go. When a segment falls apart, the largest part inherits its counts less
those of the others, so each word is recounted O(log n) times.

**Lag scan** of what survives. At lag q a run is a stretch of equal words (word i = word i + q) of at least
s = max(min_words, 3q) - q places. So it covers a multiple of s - GRAM + 1 with GRAM equal words from there on, and only those
places are looked at, through hashes of GRAM words: about n log n comparisons for all lags up to a third of the segment.
Hits are extended word by word to maximal stretches. Lags rise; a hit inside a run already found whose period divides the
lag is that run once more, so each run is kept with its smallest period.

Everything happens inside one document, so Spark's part is a map over documents; a text of any length needs memory in
proportion to its words. Null and empty texts have no words and no runs. Repeated rows are judged one by one, an empty
table gives an empty result. ``runs`` returns its own columns, so clashing names do not arise; ``collapse`` keeps every
column and replaces the text."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.llm.word_hash import combine

MIN_WORDS = 24
REPEATS = 3
GRAM = 8


def surviving(ids: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Segments in which every word occurs REPEATS times or more, by recursive splitting."""
    done, todo = [], [(0, len(ids))]
    while todo:
        base, stop = todo.pop()
        if stop - base < min_words:
            continue
        words, local, counts = np.unique(ids[base:stop], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[local] < REPEATS)
        if not len(rare):
            done.append((base, stop))
            continue
        if len(rare) == stop - base:
            continue
        order = first = None
        lo, hi = 0, stop - base
        while hi - lo >= min_words:
            if not len(rare):
                done.append((base + lo, base + hi))
                break
            edges = np.concatenate(([lo - 1], rare, [hi]))
            sizes = np.diff(edges) - 1
            largest = int(sizes.argmax())
            todo += [(base + int(edges[k]) + 1, base + int(edges[k + 1])) for k in np.flatnonzero(sizes >= min_words)
                     if k != largest]
            left, right = int(edges[largest]) + 1, int(edges[largest + 1])
            if right - left < min_words:
                break
            if order is None:
                order = np.argsort(local, kind="stable")
                first = np.concatenate(([0], np.cumsum(counts)))
            gone, n = np.unique(np.concatenate((local[lo:left], local[right:hi])), return_counts=True)
            counts[gone] -= n
            short = gone[(counts[gone] > 0) & (counts[gone] < REPEATS)]
            places = [order[first[w]:first[w + 1]] for w in short]
            rare = np.sort(np.concatenate(places)) if places else np.empty(0, np.int64)
            rare = rare[(rare >= left) & (rare < right)]
            lo, hi = left, right
    return sorted(done)


def _agree(ids: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """The first place from ``at`` on (or down, step -1) where word i differs from word i + lag; ``stop`` if none."""
    size = 64
    while at != stop:
        n = min(size, abs(stop - at))
        part = slice(at, at + n) if step > 0 else slice(at - n + 1, at + 1)
        same = ids[part] == ids[part.start + lag:part.stop + lag]
        if not same.all():
            return at + int(np.argmin(same)) if step > 0 else at - int(np.argmin(same[::-1]))
        at, size = at + step * n, size * 4
    return stop


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words at each place, two words at a time."""
    h, width = ids.astype(np.uint64), 1
    while width < GRAM:
        h = combine(h[:len(h) - width], h[width:])
        width *= 2
    return h


def scan(ids: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n = len(ids)
    longest = n // REPEATS
    grams = _grams(ids)
    found: list[tuple[int, int, int]] = []
    starts, ends, periods = [], [], []
    lag = 1
    while lag <= longest:
        lags = np.arange(lag, min(lag + 1 + lag // 8, longest + 1))  # lags of one step
        step = max(min_words - lags[-1], (REPEATS - 1) * lag) - GRAM + 1
        at = np.arange(0, len(grams) - lag, max(step, 1))
        other = at[:, None] + lags[None, :]
        inside = other < len(grams)
        hit = inside & (grams[np.where(inside, other, 0)] == grams[at][:, None])
        rows, cols = np.nonzero(hit.T)
        places, hit_lags = at[cols], lags[rows]
        if len(places) and starts:
            known = np.zeros(len(places), bool)
            for s, e, q in zip(starts, ends, periods):
                known |= (places >= s) & (places + hit_lags + GRAM <= e) & (hit_lags % q == 0)
            places, hit_lags = places[~known], hit_lags[~known]
        seen = -1, -1  # lag and end of the last stretch
        for p, q in zip(places.tolist(), hit_lags.tolist()):
            if (q == seen[0] and p < seen[1]) or any(s <= p and p + q + GRAM <= e and q % d == 0
                                                     for s, e, d in zip(starts, ends, periods)):
                continue
            right = _agree(ids, p, q, n - q, 1)
            left = _agree(ids, p, q, -1, -1) + 1
            seen = q, right
            length = right - left + q
            if length >= max(min_words, REPEATS * q):
                starts.append(left)
                ends.append(left + length)
                periods.append(q)
                found.append((left, length, q))
        lag = int(lags[-1]) + 1
    return found


def find(words: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if 2 * min_words < REPEATS * GRAM:
        raise ValueError(f"min_words must be at least {REPEATS * GRAM // 2}: shorter runs hold no {GRAM} equal words a lag apart")
    if len(words) < min_words:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return sorted((base + s, n, q) for base, stop in surviving(ids, min_words) for s, n, q in scan(ids[base:stop], min_words))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in a run after its first ``period`` words."""
    gone = np.zeros(n, bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return gone


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    return b" ".join(w for w, out in zip(words, dropped(len(words), runs).tolist()) if not out)


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, length, period: a row for each run."""
    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column("doc_id").to_pylist(), _texts(b, "text")) for r in find(t.split(), min_words)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each run of ``text`` cut to its first period; texts without a run stay as they are, spacing included."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            out = []
            for old in b.column(at).cast(pa.large_binary()).to_pylist():
                words = (old or b"").split()
                found = find(words, min_words)
                out.append(collapsed(words, found) if found else old)
            yield b.set_column(at, "text", pa.array(out, pa.binary()).cast(pa.string()))

    return docs.mapInArrow(run, schema)


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the contract of op11 judges them: a tenth of the documents end in a periodic tail (null id: none)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, rest = divmod(h, 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[:n - a]


OP11_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
               "collapsed_sha256 string")


def op11(docs: DataFrame) -> DataFrame:
    """Run digests of each document."""
    names = [f.split(" ")[0] for f in OP11_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), _texts(b, "text")):
                words = rewritten(i, text.split())
                found = find(words)
                s, n, q = greatest(found) or (None,) * 3
                listed = "".join(f"{a},{c},{d}\n" for a, c, d in found)
                rows.append((len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(collapsed(words, found)).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()),
                                              *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, OP11_SCHEMA)
