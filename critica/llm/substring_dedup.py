"""Substring dedup by recompression: every word of a repeated window of ``window`` words is removed.

Rounds (in each batch of documents, by rules that depend on the symbols alone, so that every batch
gives one name to one string):
* runs: two or more equal words become one run symbol, named after the word, final;
* pairs, ``ROUNDS`` times: a hash gives each symbol a side; a left symbol followed by a right one
  becomes one symbol, named after both. Symbols span at most ``2**ROUNDS`` words (runs apart).

A symbol depends on its neighbours only, so inside equal strings the symbols are equal but for
``EDGE = 2**ROUNDS`` words at either end (1 for the runs, then 1, 2, 4...). An anchor is the name of the
symbols from one symbol's start on that span at least ``ANCHOR`` words. Of the anchors that begin in the
``SPREAD`` words after a window's edge, the least names the window: equal windows have equal names.

1. Names that occur once in the corpus rule their windows out. Names are counted by exchange.
2. The windows left are hashed word for word, and the hashes counted by exchange together with a second, independent hash: a
   window whose two hashes both occur again is a repeat.
3. Words covered by repeats go.

A window is confirmed by 64 bits and 56 bits of two hashes of all its words: two different windows of different batches are taken
for equal with a chance of 2^-120 a pair (2^-64 inside a batch of a few MB). Null text has no words; repeated rows are
repeats of each other. Very long texts are read whole; extra columns are not read, so their names cannot clash; an
empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.llm.batches import (SHARD_NAMES, SHARD_SCHEMA, SHARD_TYPES, answer, batch_table, concat_replies, merged, pack,
                                 rows_to_batch, send, shards_for, unpack, unpack_sorted, with_replies)
from critica.llm.common import stored
from critica.llm.word_hash import WordHashes, combine, mix

ROUNDS = 3
RUN = np.uint64(0xA24BAED4963EE407)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0xD1342543DE82EF95
LOW = np.uint64(0xFF)  # the count, beside 56 bits of the second hash


class Geometry:
    """Lengths in words that follow from the window and the rounds."""

    def __init__(self, window: int, rounds: int = ROUNDS):
        while rounds and window - 2 * 2 ** rounds < 2 * 2 ** rounds:
            rounds -= 1
        if window < 4:
            raise ValueError("window: at least 4 words")
        self.window, self.rounds, self.edge, self.longest = window, rounds, 2 ** rounds, 2 ** rounds
        inner = window - 2 * self.edge
        self.anchor = max(1, min(5, inner - 2 * self.longest + 2))
        self.spread = inner - (self.anchor + self.longest - 1) + 1


def parse(words: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their first words' places, whether each begins a document) after all rounds."""
    start = np.flatnonzero(first | np.append(True, words[1:] != words[:-1])) if len(words) else np.empty(0, np.int64)
    run = np.diff(np.append(start, len(words))) > 1
    symbol, opens = words[start].copy(), first[start]
    symbol[run] = mix(symbol[run] ^ RUN)
    fixed = run
    for level in range(rounds):
        left = (mix(symbol + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        joins = np.flatnonzero(left[:-1] & ~left[1:] & ~opens[1:] & ~fixed[:-1] & ~fixed[1:])
        symbol[joins] = combine(symbol[joins] + np.uint64(level + 1), symbol[joins + 1])
        keep = np.ones(len(symbol), bool)
        keep[joins + 1] = False
        symbol, start, opens, fixed = symbol[keep], start[keep], opens[keep], fixed[keep]
    return symbol, start, opens


def window_names(words: np.ndarray, first: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """(The least anchor of each window, by the window's first word, ``NONE`` where no symbol begins there; the anchors
    that occur twice within ``spread`` words, as in periodic texts: neighbouring windows may have either)."""
    n = len(words)
    symbol, start, opens = parse(words, first, g.rounds)
    end = np.append(start[1:], n)
    doc = np.cumsum(opens)
    name = symbol.copy()
    open_ = np.flatnonzero(end - start < g.anchor)
    for k in range(1, g.anchor):
        at = open_ + k
        inside = at < len(symbol)
        open_, at = open_[inside], at[inside]
        same = doc[at] == doc[open_]
        open_, at = open_[same], at[same]
        name[open_] = combine(name[open_], symbol[at])
        open_ = open_[end[at] - start[open_] < g.anchor]
    least = np.full(n, NONE)
    name = np.minimum(mix(name), NONE - np.uint64(1))
    least[start] = name
    close = [np.flatnonzero((name[d:] == name[:-d]) & (start[d:] - start[:-d] <= g.spread))
             for d in range(1, min(g.spread + 1, len(name)))]
    close = np.unique(name[np.concatenate(close)]) if close else name[:0]
    width = 1
    while width < g.spread:
        step = min(width, g.spread - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    return least[g.edge:] if n > g.edge else least[:0], close


def window_hashes(words: np.ndarray, at: np.ndarray, window: int, second: bool = False) -> np.ndarray:
    """A hash of the window at each place, all of its words; ``second``: one independent of the first."""
    if second:
        words = mix(words ^ RUN)
    powers, inverse = _powers(len(words))
    sums = np.append(np.uint64(0), np.cumsum(words * powers, dtype=np.uint64))
    return mix((sums[at + window] - sums[at]) * inverse[at])


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << max(n, 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
                              for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))
    p, q = _POWERS[size]
    return p[:n], q[:n]


def tokens(texts: list[str], hashes: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(words by document, all word hashes, whether each begins a document, documents' edges)."""
    docs = [t.encode().split() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    words = np.concatenate([hashes.of(d) for d in docs]) if docs else np.empty(0, np.uint64)
    first = np.zeros(len(words), bool)
    first[edges[:-1][edges[:-1] < len(words)]] = True
    return docs, words, first, edges


def valid_windows(edges: np.ndarray, window: int) -> np.ndarray:
    """Places where a whole window begins."""
    last = edges[1:] - window
    ok = last >= edges[:-1]
    a, b = edges[:-1][ok], last[ok] + 1
    if not len(a):
        return np.empty(0, np.int64)
    n = b - a
    return np.arange(n.sum()) + np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n)


def named(texts: list[str], hashes: WordHashes, g: Geometry):
    """(tokens, windows' places, stretches of windows of one name: length, name; names that occur twice close by)."""
    toks = tokens(texts, hashes)
    at = valid_windows(toks[3], g.window)
    none = np.empty(0, np.uint64)
    names, close = window_names(toks[1], toks[2], g) if len(at) else (none, none)
    names = names[at]
    begin = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at
    return toks, at, np.diff(np.append(begin, len(at))), names[begin], close


def _send_names(g: Geometry, shards: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for batch, texts in zip(b.column("batch").to_pylist(), b.column("text").to_pylist()):
                _, _, _, name, close = named(texts, hashes, g)
                keys, seen = np.unique(name[name != NONE], return_counts=True)
                seen[np.isin(keys, close)] = 2
                yield rows_to_batch(send(batch, keys, np.minimum(seen, 2).astype(np.uint8), shards), SHARD_NAMES, SHARD_TYPES)
    return run


def _twice(pdf: pd.DataFrame) -> pd.DataFrame:
    _, totals, places = merged(pdf, np.uint8)
    return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"],
                         "reply": [pack((totals[p] > 1).astype(np.uint8)) for p in places]})


def _confirmed(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each sent window: whether its hash occurs twice with the same second hash."""
    parts = [unpack_sorted(k) for k in pdf["keys"]]
    sent = [unpack(c, np.uint64) for c in pdf["counts"]]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    data = np.concatenate(sent)
    check, seen = data & ~LOW, (data & LOW).astype(np.int64)
    first = np.zeros(len(keys), np.uint64)
    first[place] = check  # any one of a key's second hashes
    other = np.flatnonzero(first[place] != check)
    if len(other):  # two windows under one hash: counted by both hashes
        mixed = np.isin(place, place[other])
        pairs = np.rec.fromarrays([place, check])
        _, where = np.unique(pairs[mixed], return_inverse=True)
        place[mixed] = len(keys) + where
    twice = np.bincount(place, weights=seen) > 1
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"],
                         "reply": [pack(x.astype(np.uint8)) for x in np.split(twice[place], ends[:-1])]})


def _send_windows(g: Geometry, shards: int):
    """The shards' rows, and one row (shard -1) with the batch's own candidate windows."""
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for batch, texts, replies in zip(*(b.column(c).to_pylist() for c in ("batch", "text", "names"))):
                toks, at, length, name, _ = named(texts, hashes, g)
                keys = np.unique(name[name != NONE])
                shared = concat_replies(replies, np.uint8).astype(bool)
                hot = name == NONE
                hot[~hot] = shared[np.searchsorted(keys, name[~hot])]
                own = at[np.repeat(hot, length)]
                found = window_hashes(toks[1], own, g.window)
                keys, place, seen = np.unique(found, return_index=True, return_counts=True)
                check = window_hashes(toks[1], own[place], g.window, second=True)
                rows = send(batch, keys, check & ~LOW | np.minimum(seen, 2).astype(np.uint64), shards)
                steps = np.diff(own, prepend=0).astype(np.int64)
                yield rows_to_batch([*rows, (batch, -1, pack(steps), b"")], SHARD_NAMES, SHARD_TYPES)
    return run


def _cut(g: Geometry):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for ids, texts, mine, replies in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "mine", "windows"))):
                own = np.cumsum(unpack(mine, np.int64)) if mine else np.empty(0, np.int64)
                docs, words, _, edges = tokens(texts, hashes) if len(own) else ([t.encode().split() for t in texts], None, None, None)
                gone = None
                if len(own):
                    found = window_hashes(words, own, g.window)
                    twice = concat_replies(replies, np.uint8).astype(bool)
                    hit = own[twice[np.searchsorted(np.unique(found), found)]]
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + g.window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                kept = []
                for i, d in enumerate(docs):
                    cut = gone[edges[i]:edges[i + 1]] if gone is not None else None
                    kept.append(d if cut is None or not cut.any() else [d[j] for j in np.flatnonzero(~cut)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(d) for d in docs], pa.int64()),
                     pa.array([len(d) - len(k) for d, k in zip(docs, kept)], pa.int64()),
                     pa.array([b" ".join(k).decode() for k in kept], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space): one row per input row."""
    g = Geometry(window)
    batches = batch_table(docs)
    shards = shards_for(batches, 0.05)
    names = answer(batches.select("batch", "text").mapInArrow(_send_names(g, shards), SHARD_SCHEMA), _twice)
    sent = stored(with_replies(batches.select("batch", "text"), names, "names").mapInArrow(
        _send_windows(g, shards), SHARD_SCHEMA), "windows")
    replies = answer(sent.filter("shard >= 0"), _confirmed)
    mine = sent.filter("shard = -1").select("batch", F.col("keys").alias("mine"))
    joined = with_replies(batches, replies, "windows").join(mine.hint("shuffle_hash"), "batch", "left")
    return joined.mapInArrow(_cut(g), "doc_id long, n_words long, n_removed long, kept_text string")


def op7(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed",
                                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
