"""BPE encoding and decoding as streaming transducers.

**Encoding.** Text is fed in slices. Pre-tokens that touch the end of what was fed so far are held back; a pre-token that
grows past ``HOLD`` characters is left open and its bytes go to a ``Transducer`` as they come. That one holds
a buffer of at most ``LOOKAHEAD + CHUNK`` bytes, merges it, and emits the tokens that no later byte can change.

*Sufficient lookahead.* Let two texts agree up to a point, and follow their merges by rank. A boundary between tokens left
of that point differs only if the token x on its left merges rightwards in one text alone, by a rule (x, y). Then the
texts differ from the left end of x on, and there, at a later rank, the next such rule (x', y') must have a y' that
starts with x. So a difference walks left through rules of strictly rising rank, and the furthest it gets is the
longest such chain of left parts: one pass over the merge list from its end (``sufficient_lookahead``). A token that
ends at least that many bytes before the end of the buffer is stable, and what follows it can be
encoded by itself, because no merge crosses its right edge.

**Decoding** concatenates the bytes of ids and runs them through an incremental UTF-8 state machine: an unfinished
character waits for the next id, bytes that are no text become U+FFFD.

Results are those of the ``tokenizers`` library with the same file (added tokens in a text included, unless
``added=False``). Character classes are the library's: its Unicode tables may be older than those of ``regex``, so a
character is classed by the library when it is first seen.

Null and empty texts have no ids. Texts of any length need the memory of the text itself, one buffer and the word cache.
Repeated rows are encoded one by one; an empty table gives an empty result. Every column of the input stays; a column
with the name of the output is replaced."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The byte-level pre-token pattern and what continues an open pre-token of each class.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = {"letter": r"\p{L}*", "number": r"\p{N}*", "other": r"[^\s\p{L}\p{N}]*", "space": r"\s*"}
EXAMPLES = {"letter": "a", "number": "1", "other": "!", "space": "\t"}

SLICE = 1 << 16      # characters fed at once
HOLD = 1024          # characters of a pre-token before it is left open
CHUNK = 512          # bytes that a transducer gathers beyond its lookahead
CACHED_BYTES = 64    # longest pre-token kept in the cache
CACHE_WORDS = 400_000
GROUP = 1 << 21      # characters of short texts whose new pre-tokens are merged together
TOGETHER = 4096      # pre-tokens merged at once
NO_RULE = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """The bytes after a token beyond which nothing can change it."""
    made = {c for a, b in merges for c in a + b}
    for a, b in merges:
        if a not in made or b not in made or a + b in made:
            raise ValueError("a merge list must build each token once, from tokens built before")
        made.add(a + b)
    reach: dict[str, int] = {}  # token x -> furthest walk by later rules whose right part starts with x
    best = 0
    for x, y in reversed(merges):
        walk = len(x) + reach.get(x, 0)
        best = max(best, walk)
        for i in range(1, len(y) + 1):
            if reach.get(y[:i], 0) < walk:
                reach[y[:i]] = walk
    return best


class Model:
    """A byte-level BPE file: ids, the rank of each pair of ids and the id it makes, lookahead, bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, odd = spec.get("pre_tokenizer") or {}, spec["model"], ("dropout", "unk_token", "continuing_subword_prefix",
                                                                          "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer")
                or model.get("type") != "BPE" or any(model.get(k) for k in odd)):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab, letters = model["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab.get(c) for c in letters]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.numbers = np.array(range(max(vocab.values(), default=0) + 1), object)  # one int object for each id
        self.pairs, self.pair_ranks = np.array(sorted(self.ranks.items()), np.int64).reshape(-1, 2).T.copy()
        self.lookahead = sufficient_lookahead(merges)
        self.bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.added = {}
        for t in spec.get("added_tokens") or []:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError(f"{path}: added token {t['content']!r} takes its surroundings along")
            self.added[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        contents = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.decimal = {i: str(i) for i in self.bytes}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one run of bytes: pairs by rank, equal ranks from the left."""
        sym = [self.byte_ids[b] for b in data]
        return self._merge_long(sym) if len(sym) > CACHED_BYTES else self._merge_short(sym)

    def _merge_short(self, sym: list[int]) -> list[int]:
        """The least rank is looked for again after each merge: the quickest way for words."""
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(a << 32 | b, NO_RULE) for a, b in zip(sym, sym[1:])]
        while ranks and (r := min(ranks)) != NO_RULE:
            i = ranks.index(r)
            sym[i] = new = made[r]
            del sym[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | sym[i + 1], NO_RULE)
            if i:
                ranks[i - 1] = rank_of(sym[i - 1] << 32 | new, NO_RULE)
        return sym

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many runs of at most ``CACHED_BYTES`` bytes: in each round every run merges its pair of least rank, the leftmost.

        A run is a row of places, with an empty place at either end; a place knows its neighbours, its id and the rank of the pair it begins."""
        if None in self.byte_ids or not self.made:
            return [tuple(self.merge(w)) for w in words]
        byte_ids, made, none = np.array(self.byte_ids, np.int64), np.array(self.made, np.int64), np.iinfo(np.int32).max

        def rank(a, b):
            code = np.where(b < 0, -1, a << 32 | b)
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            return np.where(self.pairs[at] == code, self.pair_ranks[at], none).astype(np.int32)

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max()) + 2
        sym = np.full((len(words), width), -1, np.int64)
        inner = np.arange(width) - 1
        inner = (inner >= 0) & (inner < sizes[:, None])
        sym[inner] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        key = np.full(sym.shape, none, np.int32)
        key[:, :-1] = rank(sym[:, :-1], sym[:, 1:])
        after, before = np.arange(1, sym.size + 1), np.arange(-1, sym.size - 1)
        live, ids = np.arange(len(words)), sym.reshape(-1)
        while True:
            first = key.argmin(1)
            r = key[np.arange(len(live)), first]
            going = r != none
            if not going.all():
                live, key, first, r = live[going], key[going], first[going], r[going]
            if not len(live):
                break
            base, row = live * width, np.arange(len(live))
            i = base + first
            j, h = after[i], before[i]
            k = after[j]
            ids[i], ids[j] = new, _ = made[r], -1
            after[i], before[k] = k, i
            key[row, j - base] = none
            key[row, first] = rank(new, ids[k])
            key[row, h - base] = rank(ids[h], new)
        flat, ends = self.numbers[ids[ids >= 0]].tolist(), np.cumsum((sym >= 0).sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _merge_long(self, sym: list[int | None]) -> list[int]:
        """A heap of candidate pairs over a linked list."""
        rank_of, made, n = self.ranks.get, self.made, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := rank_of(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = new, _ = made[r], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank_of(new << 32 | sym[k])) is not None:
                    heapq.heappush(heap, (q, i, new, sym[k]))
            h = before[i]
            if h >= 0 and (q := rank_of(sym[h] << 32 | new)) is not None:
                heapq.heappush(heap, (q, h, sym[h], new))
        return [x for x in sym if x is not None]


class Transducer:
    """Bytes of one pre-token in, stable ids out; holds at most lookahead + CHUNK bytes between calls."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> Iterator[int]:
        look = self.model.lookahead
        for at in range(0, len(data), CHUNK):
            self.held += data[at:at + CHUNK]
            if len(self.held) < look + CHUNK:
                continue
            done = 0
            for i in self.model.merge(self.held):
                end = done + len(self.model.bytes[i])
                if end > len(self.held) - look:
                    break
                done = end
                yield i
            self.held = self.held[done:]

    def close(self) -> list[int]:
        ids, self.held = self.model.merge(self.held), b""
        return ids


class Classes:
    """Letters, numbers, space and the rest as the library has them: replaces characters that ``regex`` would class otherwise."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.pattern = regex.compile(PATTERN)
        self.known: set[str] = set()
        self.odd: set[str] = set()
        self.other: dict[int, str] = {}

    def probe(self, c: str) -> None:
        text = f"a{c}a 1{c}1 !{c}!"
        spans = [s for _, s in self.library.pre_tokenize_str(text)]
        if spans != [m.span() for m in self.pattern.finditer(text)]:
            whole = {"letter": (0, 3), "number": (3, 7), "other": (7, 11)}
            kind = next((k for k, s in whole.items() if s in spans), "space")
            self.other[ord(c)] = EXAMPLES[kind]
            self.odd.add(c)
        self.known.add(c)

    def plain(self, text: str) -> str:
        """``text``, or a text of equal length and classes on which ``regex`` agrees with the library."""
        if text.isascii():
            return text
        letters = set(text)
        for c in letters - self.known:
            if not c.isascii():
                self.probe(c)
        return text if letters.isdisjoint(self.odd) else text.translate(self.other)


class Words(dict):
    """pre-token -> ids; long ones go through a transducer and are not kept, and all are forgotten at ``CACHE_WORDS``.

    A tuple of ids stands for itself, so that a text is a list of units: pre-tokens, and ids that are known already."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def ids(self, units: list[str | tuple[int, ...]]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, units)))

    def learn(self, units: set[str | tuple[int, ...]]) -> None:
        """Merges the new pre-tokens among ``units`` together, those of like length side by side."""
        new = [u for u in units if u not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = units
        new = [u for u in new if isinstance(u, str) and len(u) <= CACHED_BYTES]
        new.sort(key=len)
        for at in range(0, len(new), TOGETHER):
            some = new[at:at + TOGETHER]
            data = [u.encode() for u in some]
            if max(map(len, data)) > CACHED_BYTES:
                some = [u for u, d in zip(some, data) if len(d) <= CACHED_BYTES]
                data = [u.encode() for u in some]
            if some:
                self.update(zip(some, self.model.merge_many(data)))

    def __missing__(self, word: str | tuple[int, ...]) -> Iterable[int]:
        if isinstance(word, tuple):
            return word
        data = word.encode()
        if len(data) > CACHED_BYTES:
            stream = Transducer(self.model)
            return [*stream.feed(data), *stream.close()]
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = tuple(self.model.merge(data))
        return ids


class Encoder:
    """Text in slices in, units (``Words``) out. ``close`` ends the text."""

    def __init__(self, model: Model, classes: Classes, added: bool = True):
        self.model, self.classes = model, classes
        self.added = model.added_pattern if added else None
        self.keep = max(map(len, model.added)) - 1 if self.added else 0
        self.held, self.open, self.stream = "", None, None

    def feed(self, text: str) -> list[str | tuple[int, ...]]:
        return self._take(text, False)

    def close(self, text: str = "") -> list[str | tuple[int, ...]]:
        return self._take(text, True)

    def _take(self, text: str, last: bool) -> list[str | tuple[int, ...]]:
        text, out, at = self.held + text, [], 0
        if self.added:
            for m in self.added.finditer(text):
                self._part(text[at:m.start()], True, out)
                out.append((self.model.added[m[0]],))
                at = m.end()
        end = len(text) if last else max(at, len(text) - self.keep)
        used = self._part(text[at:end], last, out)
        self.held = text[at + used:]
        return out

    def _part(self, text: str, last: bool, out: list[str | tuple[int, ...]]) -> int:
        """Units of the pre-tokens that no further text can change; the characters used."""
        plain, start = self.classes.plain(text), 0
        if self.open:
            start = _CONTINUE[self.open].match(plain).end()
            closed = start < len(plain)
            if self.open == "space" and (closed or not last):
                start = max(start - 1, 0)  # the last blank may belong to the next word
            out.append(tuple(self.stream.feed(text[:start].encode())))
            if not (closed or last):
                return start
            out.append(tuple(self.stream.close()))
            self.open = None
        if plain is text:
            tokens = _PRE.findall(text, start)
        else:
            tokens = [text[m.start():m.end()] for m in _PRE.finditer(plain, start)]
        end = len(text)
        if not last and tokens:
            end -= len(tokens.pop())
            if tokens and tokens[-1][0] == "'" and end - len(tokens[-1]) + 3 > len(text):
                end -= len(tokens.pop())
        out.extend(tokens)
        if len(text) - end > HOLD:
            tail = plain[-1]
            self.open = next(k for k, p in _CONTINUE.items() if p.fullmatch(tail))
            self.stream = Transducer(self.model)
            stop = len(text) - (self.open == "space")
            out.append(tuple(self.stream.feed(text[end:stop].encode())))
            end = stop
        return end


class Decoder:
    """Ids in, text out; an unfinished character waits. Ids outside the vocabulary are skipped, as the library does."""

    def __init__(self, model: Model):
        self.bytes = model.bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        try:
            data = b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            data = b"".join([self.bytes.get(i, b"") for i in ids])
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


_PRE = regex.compile(PATTERN)
_CONTINUE = {k: regex.compile(p) for k, p in CLASSES.items()}


@cache
def loaded(path: str) -> tuple[Model, Words, Classes]:
    """Model, word cache and classes: once a Python worker."""
    model = Model(path)
    return model, Words(model), Classes()


def pieces(text: str | None, path: str, added: bool = True) -> Iterator[list[int]]:
    """The ids of a text, slice by slice."""
    model, words, classes = loaded(path)
    encoder = Encoder(model, classes, added)
    for at in range(0, len(text or ""), SLICE):
        yield words.ids(encoder.feed(text[at:at + SLICE]))
    yield words.ids(encoder.close())


def encoded(texts: list[str | None], path: str, added: bool = True) -> Iterator[Iterable[list[int]]]:
    """``pieces`` of each text. Texts of one slice are taken ``GROUP`` characters at a time and their new pre-tokens merged together."""
    model, words, classes = loaded(path)
    group, size = [], 0

    def done():
        words.learn(set().union(*group))
        for units in group:
            yield [words.ids(units)]
        group.clear()

    for text in texts:
        text = text or ""
        if len(text) > SLICE:
            yield from done()
            yield pieces(text, path, added)
            size = 0
            continue
        group.append(Encoder(model, classes, added).close(text))
        size += len(text)
        if size >= GROUP:
            yield from done()
            size = 0
    yield from done()


def _with(df: DataFrame, column: str, out: str, kind: T.DataType, value) -> DataFrame:
    """``df`` with ``out`` = value(list of ``column``), an Arrow array."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, kind)])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], value(b.columns[-1].to_pylist())], [*rest, out])

    return df.select(*rest, F.col(f"`{column}`").alias("__in")).mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str | None = None, column: str = "text", out: str = "ids", added: bool = True) -> DataFrame:
    """``df`` with the ids of ``column``; ``added=False`` reads the strings of added tokens as ordinary text."""
    path = tokenizer or default_tokenizer()
    return _with(df, column, out, T.ArrayType(T.IntegerType()), lambda texts: pa.array(
        [[i for part in parts for i in part] for parts in encoded(texts, path, added)], pa.list_(pa.int32())))


def decode(df: DataFrame, tokenizer: str | None = None, column: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of the ids in ``column`` (null: empty)."""
    path = tokenizer or default_tokenizer()

    def texts(rows):
        model = loaded(path)[0]
        out = []
        for ids in rows:
            decoder = Decoder(model)
            out.append(decoder.feed(ids or []) + decoder.close())
        return pa.array(out, pa.string())

    return _with(df, column, out, T.StringType(), texts)


OP12_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def op12(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of each document's ids and of their text, both taken while they stream by."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        model = loaded(path)[0]
        decimal = model.decimal.__getitem__
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for parts in encoded(b.column("text").to_pylist(), path):
                n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(model)
                for ids in parts:
                    if ids:
                        of_ids.update(("," * (n > 0) + ",".join(map(decimal, ids))).encode())
                        of_text.update(decoder.feed(ids).encode())
                        n += len(ids)
                of_text.update(decoder.close().encode())
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, OP12_SCHEMA)
