"""op11 to op13 against plain versions, the library and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from critica.llm import bpe, periodic, prefix_trie
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_operators import by_id, odd_texts, texts_of, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, None) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(params=["odd", "given"])
def docs(request):
    return request.getfixturevalue(request.param)


# --- op11 ----------------------------------------------------------------------------------------------

def plain_runs(w, min_words=24):
    """Every lag, every place."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_random_sequences():
    rng = random.Random(5)
    for _ in range(800):
        v, w = rng.choice([1, 2, 3, 5, 20]), []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < .6:
                unit = [b"%d" % rng.randrange(v) for _ in range(rng.randrange(1, rng.choice([3, 8, 30])))]
                w += (unit * 40)[:rng.randrange(1, 150)]
            else:
                w += [b"%d" % rng.randrange(v) for _ in range(rng.randrange(40))]
        size = rng.choice([12, 24, 30])
        assert periodic.find(w, size) == plain_runs(w, size)


def test_splitting_is_stable_and_loses_no_run():
    rng = random.Random(6)
    for _ in range(200):
        w = np.array([rng.randrange(rng.choice([3, 30, 300])) for _ in range(rng.randrange(400))], np.int64)
        parts = periodic.surviving(w, 24)
        for a, b in parts:
            assert b - a >= 24 and np.unique(w[a:b], return_counts=True)[1].min() >= 3
        for s, n, _ in plain_runs(list(w)):
            assert any(a <= s and s + n <= b for a, b in parts)
    # each round uncovers the next rare word: still stable at the end
    chain = [x for i in range(200) for x in (i, i + 1, i + 2)]
    assert periodic.surviving(np.array(chain, np.int64), 24) == [] or plain_runs(chain) == []


def test_runs_of_long_texts_take_few_comparisons():
    rng = random.Random(8)
    unit = [b"%d" % rng.randrange(9) for _ in range(70_000)]
    assert periodic.find(unit * 4) == [(0, 280_000, 70_000)]
    assert periodic.find([b"a"] * 300_000) == [(0, 300_000, 1)]
    with pytest.raises(ValueError):
        periodic.find([b"a"] * 30, 8)


def test_op11(docs):
    texts, got = texts_of(docs), by_id(periodic.op11(docs))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = brute.words(t)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = periodic.find(w) if n > 3000 else plain_runs(w)
        gone = {j for s, size, q in runs for j in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[i]
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == brute.sha(" ".join(x for j, x in enumerate(w) if j not in gone))


def test_runs_and_collapse_keep_general_columns(spark):
    rows = [(1, "x " * 30 + "end", "k"), (2, "no  run\there", "k"), (None, None, None), (1, "x " * 30 + "end", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, period string")
    assert [tuple(r) for r in periodic.runs(df).collect()] == [(1, 0, 30, 1)] * 2
    out = periodic.collapse(df)
    assert out.columns == df.columns
    assert sorted(str(r["text"]) for r in out.collect()) == ["None", "no  run\there", "x end", "x end"]


# --- op12 ----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    tok.no_truncation()
    tok.no_padding()
    return tok


def bpe_texts():
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "'s", "'", "re", "ll", "\n", "  ", "1", "日", "!", "՘", "<|endoftext|>", "<|", " \t", "\x1c", "\x85"]
    yield from ("".join(rng.choice(parts) for _ in range(rng.randrange(1, 200))) for _ in range(150))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aehtinr", " \n", "日本é"):
        yield "".join(rng.choice(letters) for _ in range(6000))
    yield from ("x" * 9000, " " * 5000 + "a", "\n" * 3000 + "  b", "'" * 3000 + "s", "a'" * 1000, "<|endoftext|>" * 3 + " b")


@pytest.mark.parametrize("slice_chars,hold", [(1 << 16, 1024), (7, 20), (50, 64), (1000, 64)])
def test_slices_change_no_id(library, monkeypatch, slice_chars, hold):
    monkeypatch.setattr(bpe, "SLICE", slice_chars)
    monkeypatch.setattr(bpe, "HOLD", hold)
    for t in [*bpe_texts(), *(x or "" for x in odd_texts())]:
        ids = [i for part in bpe.pieces(t, bpe.default_tokenizer()) for i in part]
        assert ids == library.encode(t, add_special_tokens=False).ids
        decoder = bpe.Decoder(bpe.loaded(bpe.default_tokenizer())[0])
        assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == t


def test_constant_memory_and_lookahead(library):
    model = bpe.loaded(bpe.default_tokenizer())[0]
    rng = random.Random(4)
    data = "".join(rng.choice("abcdefghij") for _ in range(20_000)).encode()
    stream, out, held = bpe.Transducer(model), [], 0
    for at in range(0, len(data), 100):
        out += stream.feed(data[at:at + 100])
        held = max(held, len(stream.held))
    assert held < model.lookahead + bpe.CHUNK + 100
    assert out + stream.close() == library.encode(data.decode(), add_special_tokens=False).ids
    # the bound: whatever follows, tokens that end a lookahead before the end stay
    for _ in range(60):
        text = "".join(rng.choice("aehtinrs") for _ in range(700)).encode()
        one, two = (model.merge(text + x) for x in (b"", bytes(rng.choice(b"aehtinrs") for _ in range(40))))
        at = 0
        for a, b in zip(one, two):
            at += len(model.bytes[a])
            if at > 700 - model.lookahead:
                break
            assert a == b


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # after "a", "b", "c": one more letter may pull c from b, which then goes to a
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c"), ("a", "b")])


def test_decoder_takes_any_ids(library):
    rng = random.Random(9)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(30)]
        decoder = bpe.Decoder(bpe.loaded(bpe.default_tokenizer())[0])
        assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == library.decode(ids, skip_special_tokens=False)


def test_op12(docs, library):
    texts, got = texts_of(docs), by_id(bpe.op12(docs))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == brute.sha(",".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_encode_and_decode_columns(spark, library):
    df = spark.createDataFrame([(1, "a <|endoftext|>", "k"), (None, None, None), (1, "é", "k")], "doc_id long, text string, ids string")
    coded = bpe.encode(df)
    assert coded.columns == ["doc_id", "text", "ids"]
    assert bpe.encode(df, added=False).collect()[0]["ids"] != coded.collect()[0]["ids"]
    back = bpe.decode(coded, out="again").collect()
    assert [r["again"] for r in back] == [r["text"] or "" for r in back]


# --- op13 ----------------------------------------------------------------------------------------------

def plain_trie(rows, graft):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    by = {c: [(r, x) for _, r, _, x in sorted(v, key=lambda z: z[:3])] for c, v in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in by}
    built = {c: by.get(c - c % 5, [])[:heads[c]] + v[heads[c]:] if graft else v for c, v in by.items()}
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        kids[k[:-1]] += k != ()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
             brute.sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))))) for k, m in members.items()]


def cases():
    rng = random.Random(2)
    for n in (1, 30, 80):
        rows = []
        for c in range(n):
            same = rng.random() < .5
            for i in range(9 if same else rng.randrange(1, 14)):
                rows.append((c, rng.choice([i, i, i, None]), "u" if same else rng.choice(["u", None]),
                             f"copy {i}" if same else rng.choice(["a", "bé", None, ""])))
        yield rows + rows[:3] + [(None, 1, "u", "nobody")]
    yield [(c, i, "u", "same") for c in range(40) for i in range(12)] + [
        (40 + c, i, "u", "same" if i < 5 else str(c % 3)) for c in range(30) for i in range(9)]
    yield [(7, i, "u", "long") for i in range(200)] + [(6, i, "u", "long") for i in range(150)] + [(9, None, None, None)]


@pytest.fixture()
def many_shards(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("number", range(5))
def test_trie_over_many_shards(spark, many_shards, monkeypatch, number):
    rows = list(cases())[number]
    if number % 2:
        monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 20)
        monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, depth string")
    for op, graft in ((prefix_trie.op13, True), (prefix_trie.prefix_trie, False)):
        if graft or number < 4:
            assert sorted(map(str, map(tuple, op(df.repartition(3)).collect()))) == sorted(map(str, plain_trie(rows, graft)))


def test_trie_of_nothing(spark):
    schema = T.StructType([T.StructField(n, k()) for n, k in (("conv_id", T.LongType), ("turn", T.LongType), ("role", T.StringType),
                                                              ("text", T.StringType))])
    assert prefix_trie.op13(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic.op11(docs).collect() == [] and bpe.op12(docs).collect() == []
