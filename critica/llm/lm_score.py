"""Language-model scores from Elias-Fano n-gram tries.

Learning documents are those whose crc32(doc_id as text) modulo 10 is not 0. Tokens are the words, A-Z
lower-cased, then one end; the end also stands before the first word.

1. Word counts by exchange (see ``batches``): each batch gets the corpus count of its words, and their ranks among
   all words of the corpus.
2. Word pairs by exchange: a shard gets, from every batch, contexts with their totals, and successors with
   counts. It builds a trie of the learnt pairs and answers each batch's pairs from it. A context
   with more than ``HOT_CONTEXT`` occurrences is spread over all shards by successor.
3. Each batch adds up its documents' scores.

The trie (one file a shard, memory-mapped, removed after use) has monotone levels in Elias-Fano form (low
parts in whole bytes, high parts in unary with a directory of the ones before every 512 bits): context ids, pointers to each
context's successors, and successor ranks made monotone by adding what came before their context. Its payload is one byte a
pair: log10 of the smoothed share (1 - MIX) * c12 / (c1 + PRIOR), in steps of ``STEP``; 0 is no pair.
Levels are searched where they lie (select on the unary part, then the low parts of one high value). Successors are looked
up relative to their context: rank plus the context's base, between the context's two pointers.

p(w2 | w1) = share + p(w2) * (MIX + (1 - MIX) * PRIOR / (c1 + PRIOR)), with p(w2) = (c + 0.1) / (N + 0.1 * (V + 1)).

Words meet as 64-bit hashes, pairs as the 32-bit ranks of both words, which no two words share (more than 2^32
distinct words are an error). Null text has the end only; a null doc_id counts
as held out; repeated rows are learnt and scored one by one; with nothing to learn p(w2) is 1."""

from __future__ import annotations

import os
import tempfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.llm.batches import (SHARD_NAMES, SHARD_SCHEMA, SHARD_TYPES, batch_table, concat_replies, merged, pack,
                                 rows_to_batch, send, shards_for, unpack, with_replies)
from critica.llm.common import TO_LOWER, stored
from critica.llm.word_hash import WordHashes, combine

MIX = 0.3
PRIOR = 4.0
STEP = 0.04
HOT_CONTEXT = 500_000
LOOKUPS = 100_000  # pairs looked up at once
END = b"\n"  # no word holds white space
PAIR_SCHEMA = "batch long, shard long, contexts binary, sizes binary, totals binary, successors binary, counts binary"
PAIR_NAMES = ["batch", "shard", "contexts", "sizes", "totals", "successors", "counts"]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokenized(ids: list, texts: list[str], hashes: WordHashes):
    """(distinct words, each token's place among them, first token of each document, whether each token is learnt)."""
    end = np.array([hashes[END]], np.uint64)
    docs = []
    for t in texts:
        docs += [hashes.of(t.encode().translate(TO_LOWER).split()), end]
    n = np.array([len(a) + 1 for a in docs[::2]], np.int64)
    words, at = np.unique(np.concatenate(docs), return_inverse=True)
    learnt = np.repeat(np.array([not held_out(i) for i in ids]), n)
    return words, at, np.append(0, np.cumsum(n)), learnt


def pairs_of(words, at, edges, learnt, hashes, counts, shards):
    """Distinct (context, successor) pairs in (shard, key) order: both words' places in ``words``, shard, context totals,
    learnt counts, and each token's place among them."""
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[edges[:-1]] = np.searchsorted(words, np.uint64(hashes[END]))
    code, where = np.unique(before << 32 | at, return_inverse=True)
    seen = np.bincount(where, weights=learnt, minlength=len(code)).astype(np.int64)
    context, successor = code >> 32, code & 0xFFFFFFFF
    total = counts[context]
    spread = np.where(total > HOT_CONTEXT, combine(words[context], words[successor]), words[context]) >> np.uint64(32)
    shard = (spread * np.uint64(shards)) >> np.uint64(32)
    order = np.lexsort((code, shard))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return context[order], successor[order], shard[order].astype(np.int64), total[order], seen[order], place[where]


def counts_and_ranks(replies: list[dict] | None, bases: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Corpus counts of a batch's words, and (with each shard's first rank) their ranks."""
    counts, ranks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for r in replies or ():
        data = zlib.decompress(r["reply"])
        n = len(data) // 12
        counts.append(np.frombuffer(data, np.int64, n))
        if bases is not None:
            ranks.append(bases[r["shard"]] + np.cumsum(np.frombuffer(data, np.uint32, n, 8 * n), dtype=np.uint64))
    return np.concatenate(counts), np.concatenate(ranks) if bases is not None else None


def _send_words(shards: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for batch, ids, texts in zip(*(b.column(c).to_pylist() for c in ("batch", "doc_id", "text"))):
                words, at, _, learnt = tokenized(ids, texts, hashes)
                seen = np.bincount(at, weights=learnt, minlength=len(words)).astype(np.uint32)
                yield rows_to_batch(send(batch, words, seen, shards), SHARD_NAMES, SHARD_TYPES)
    return run


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each batch's totals, and the steps between its words' places in the shard; on the first row also the shard's
    words, known words and learnt tokens."""
    _, totals, places = merged(pdf, np.uint32)
    replies = [zlib.compress(totals[p].tobytes() + np.diff(p, prepend=np.uint32(0)).tobytes(), 1) for p in places]
    out = pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"], "reply": replies, "words": 0, "known": 0, "tokens": 0})
    out.loc[out.index[0], ["words", "known", "tokens"]] = len(totals), int((totals > 0).sum()), int(totals.sum())
    return out


def _send_pairs(shards: int, bases):
    def run(batches):
        hashes, starts = WordHashes(), bases.value
        for b in batches:
            for batch, ids, texts, replies in zip(*(b.column(c).to_pylist() for c in ("batch", "doc_id", "text", "words"))):
                words, at, edges, learnt = tokenized(ids, texts, hashes)
                counts, ranks = counts_and_ranks(replies, starts)
                context, successor, shard, total, seen, _ = pairs_of(words, at, edges, learnt, hashes, counts, shards)
                key = ranks[context] << np.uint64(32) | ranks[successor]
                cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
                rows = []
                for x, y in zip(cuts[:-1], cuts[1:]):
                    context, first, size = np.unique(key[x:y] >> np.uint64(32), return_index=True, return_counts=True)
                    rows.append((batch, int(shard[x]), context.astype(np.uint32).tobytes(), pack(size.astype(np.uint32)),
                                 pack(total[x:y][first]), key[x:y].astype(np.uint32).tobytes(), pack(seen[x:y].astype(np.uint32))))
                yield rows_to_batch(rows, PAIR_NAMES, [pa.int64(), pa.int64(), *[pa.binary()] * 5])
    return run


# --- the trie ---------------------------------------------------------------------------------------


BLOCK = 8  # 64-bit words of the high part for each entry of the directory
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)  # place of the k-th one in a byte
_ONES = _BITS.sum(1).astype(np.uint8)


def ef_encode(x: np.ndarray) -> list[np.ndarray]:
    """Monotone numbers as (bytes in a low part, count, zeros of the high part), low parts, the unary high part in words, and
    the ones before every ``BLOCK`` words."""
    n, top = len(x), int(x[-1]) + 1 if len(x) else 1
    low = 0
    while low < 7 and n and (top >> (8 * low)) > n:
        low += 1
    lows = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]
    high = (x >> np.uint64(8 * low)).astype(np.int64)
    zeros = int(high[-1]) + 1 if n else 1
    bits = np.zeros(-(-(zeros + n) // (64 * BLOCK)) * 64 * BLOCK, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little")
    ones = np.append(0, np.cumsum(_ONES[words].reshape(-1, 8 * BLOCK).sum(1, dtype=np.int64)))
    return [np.array([low, n, zeros], np.uint64).view(np.uint8), np.ascontiguousarray(lows).reshape(-1), words,
            ones.astype(np.uint64).view(np.uint8)]


def _step(counts: np.ndarray, left: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the column in which the ``left``-th of ``counts`` falls, what is left of it there), row by row."""
    upto = np.cumsum(counts, axis=1, dtype=np.int16)
    at = (upto <= left[:, None]).sum(1)
    return at, left - upto[row, at] + counts[row, at]


class Monotone:
    """Elias-Fano numbers, read and searched where they lie."""

    def __init__(self, head: np.ndarray, lows: np.ndarray, words: np.ndarray, ones: np.ndarray):
        self.low, self.n, self.zeros = (int(v) for v in np.frombuffer(head.tobytes(), np.uint64))
        self.lows, self.words = lows.reshape(self.n, self.low), words.view(np.uint64).reshape(-1, BLOCK)
        self.ones = ones.view(np.int64)

    def __len__(self) -> int:
        return self.n

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one (zero) of the high part: by the directory, then by word, byte and bit."""
        before = self.ones if ones else np.arange(len(self.ones)) * (64 * BLOCK) - self.ones
        block = np.searchsorted(before, k, "right") - 1
        data = self.words[block] if ones else ~self.words[block]
        left, row = (k - before[block]).astype(np.int16), np.arange(len(k))
        word, left = _step(np.bitwise_count(data), left, row)
        octets = np.ascontiguousarray(data[row, word]).view(np.uint8).reshape(-1, 8)
        byte, left = _step(_ONES[octets], left, row)
        return block * (64 * BLOCK) + word * 64 + byte * 8 + _SELECT[octets[row, byte], left]

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for j in range(self.low):
            out |= self.lows[i, j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(8 * self.low) | self._low_at(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part less than ``high``."""
        out = np.where(high > self.zeros - 1, self.n, 0)
        some = np.flatnonzero((high > 0) & (high <= self.zeros - 1))
        if len(some):
            out[some] = self._select(high[some] - 1, False) - (high[some] - 1)
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first number >= x in [lo, hi), whether it is x), for each x."""
        high = (x >> np.uint64(8 * self.low)).astype(np.int64)
        hi = self.n if hi is None else hi
        a = np.clip(self._below(high), lo, hi)
        end = np.clip(self._below(high + 1), lo, hi)
        part = x & np.uint64((1 << (8 * self.low)) - 1)
        b = end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low_at(middle) < part[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < end)
        equal[inside] = self._low_at(a[inside]) == part[inside]
        return a, equal


class Trie:
    """A shard's levels in one memory-mapped file; nothing is decoded but what a search reads."""

    PARTS = 4  # of a level

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        context, first = np.unique(keys >> np.uint64(32), return_index=True)
        successor = keys & np.uint64(0xFFFFFFFF)
        vocabulary = np.unique(successor)
        rank = np.searchsorted(vocabulary, successor).astype(np.uint64)
        last = rank[np.append(first[1:], len(keys)) - 1] if len(keys) else rank
        base = np.append(np.uint64(0), np.cumsum(last + np.uint64(1))[:-1]) if len(keys) else rank
        sizes = np.diff(np.append(first, len(keys)))
        levels = [context, np.append(first, len(keys)).astype(np.uint64), base.astype(np.uint64), vocabulary,
                  rank + np.repeat(base, sizes).astype(np.uint64)]
        parts = [p for x in levels for p in ef_encode(x)] + [codes]
        handle, self.path = tempfile.mkstemp(suffix=".trie")
        self.spans, at = [], 0
        with os.fdopen(handle, "wb") as f:
            for p in parts:
                self.spans.append((at, at + p.nbytes))
                f.write(p.tobytes() + bytes(-p.nbytes % 8))
                at += p.nbytes + -p.nbytes % 8
        self.map = np.memmap(self.path, np.uint8, "r")
        self.context, self.pointer, self.base, self.vocabulary, self.level = (
            Monotone(*(self._part(self.PARTS * i + j) for j in range(self.PARTS))) for i in range(5))
        self.codes = self._part(5 * self.PARTS)

    def _part(self, i: int) -> np.ndarray:
        return np.asarray(self.map[slice(*self.spans[i])])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The payload of each (context, successor), 0 where absent. A context is looked up once for neighbours that share it;
        successors are searched between their context's pointers only."""
        out = np.zeros(len(keys), np.uint8)
        if not len(self.level) or not len(keys):
            return out
        context = keys >> np.uint64(32)
        starts = np.append(0, np.flatnonzero(context[1:] != context[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(keys)))
        c, known = self.context.successor(context[starts])
        keep = np.flatnonzero(np.repeat(known, sizes))
        if not len(keep):
            return out
        spread = lambda x: np.repeat(x, sizes[known])
        c = c[known]
        v, is_word = self.vocabulary.successor(keys[keep] & np.uint64(0xFFFFFFFF))
        lo, hi, base = self.pointer.get(c).astype(np.int64), self.pointer.get(c + 1).astype(np.int64), self.base.get(c)
        at, found = self.level.successor(spread(base) + v.astype(np.uint64), spread(lo), spread(hi))
        ok = is_word & found
        out[keep[ok]] = self.codes[at[ok]]
        return out

    def close(self) -> None:
        del self.map, self.codes, self.context, self.pointer, self.base, self.vocabulary, self.level
        os.unlink(self.path)


def quantise(share: np.ndarray) -> np.ndarray:
    """1..255: steps of ``STEP`` down from log10 share = 0."""
    return np.clip(np.rint(-np.log10(share) / STEP), 0, 254).astype(np.uint8) + np.uint8(1)


def share_of(codes: np.ndarray) -> np.ndarray:
    table = np.append(0.0, 10.0 ** (-STEP * np.arange(255)))
    return table[codes]


def _answer_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    asked, contexts, totals, counts = [], [], [], []
    for c, size, total, s, n in zip(*(pdf[x] for x in PAIR_NAMES[2:])):
        context = np.frombuffer(c, np.uint32).astype(np.uint64)
        size = unpack(size, np.uint32)
        asked.append(np.repeat(context, size) << np.uint64(32) | np.frombuffer(s, np.uint32).astype(np.uint64))
        contexts.append(context)
        totals.append(unpack(total, np.int64))
        counts.append(unpack(n, np.uint32))
    pairs = np.unique(np.concatenate(asked))
    c12 = np.zeros(len(pairs), np.int64)
    places = [np.searchsorted(pairs, a).astype(np.uint32) for a in asked]
    for p, n in zip(places, counts):
        c12[p] += n
    learnt = c12 > 0
    keys, c12 = pairs[learnt], c12[learnt]
    context, first = np.unique(np.concatenate(contexts), return_index=True)
    c1 = np.concatenate(totals)[first][np.searchsorted(context, keys >> np.uint64(32))]
    trie = Trie(keys, quantise((1 - MIX) * c12 / (np.maximum(c1, c12) + PRIOR)))
    try:  # each distinct pair that any batch asks is looked up once, in order
        codes = np.concatenate([trie.find(pairs[i:i + LOOKUPS]) for i in range(0, len(pairs), LOOKUPS)])
    finally:
        trie.close()
    replies = [pack(codes[p]) for p in places]
    return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"], "reply": replies})


def _score(shards: int, known: int, tokens: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for ids, texts, replies, codes in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "words", "pairs"))):
                words, at, edges, learnt = tokenized(ids, texts, hashes)
                counts, _ = counts_and_ranks(replies)
                *_, place = pairs_of(words, at, edges, learnt, hashes, counts, shards)
                p = (counts + 0.1) / (tokens + 0.1 * (known + 1))
                before = np.empty_like(at)
                before[1:] = at[:-1]
                before[edges[:-1]] = np.searchsorted(words, np.uint64(hashes[END]))
                rest = MIX + (1 - MIX) * PRIOR / (counts + PRIOR)
                full = np.log10(share_of(concat_replies(codes, np.uint8))[place] + rest[before] * p[at])
                sums = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731 - no document is without a token
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(np.diff(edges)),
                     pa.array(sums((counts > 0)[at].astype(np.int64))), pa.array([tokens] * len(ids), pa.int64()),
                     pa.array(sums(np.log10(p)[at])), pa.array(sums(full))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row."""
    batches = batch_table(docs)
    shards = shards_for(batches, 0.2)
    words = stored(batches.mapInArrow(_send_words(shards), SHARD_SCHEMA).groupBy("shard").applyInPandas(
        _count_words, "batch long, shard long, reply binary, words long, known long, tokens long"), "words")
    row = words.agg(F.sum("known"), F.sum("tokens")).first()
    known, tokens = row[0] or 0, row[1] or 0
    sizes = np.zeros(shards + 1, np.int64)
    for r in words.filter("words > 0").select("shard", "words").collect():  # one row a shard
        sizes[r["shard"] + 1] = r["words"]
    if sizes.sum() > 1 << 32:
        raise ValueError("op10: more than 2^32 distinct words")
    bases = docs.sparkSession.sparkContext.broadcast(np.cumsum(sizes).astype(np.uint64))
    with_words = with_replies(batches, words, "words")
    sent = with_words.mapInArrow(_send_pairs(shards, bases), PAIR_SCHEMA)
    pairs = sent.groupBy("shard").applyInPandas(_answer_pairs, "batch long, shard long, reply binary")
    return with_replies(with_words, pairs, "pairs").mapInArrow(
        _score(shards, known, tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


def op10(docs: DataFrame) -> DataFrame:
    return score(docs)
