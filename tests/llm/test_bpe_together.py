"""op12: new pre-tokens of many texts are merged together, with the ids that each has by itself."""

import random

import pytest

from critica.llm import bpe
from tests.llm.test_runs_bpe_trie import bpe_texts


@pytest.fixture(scope="module")
def model():
    return bpe.Model(bpe.default_tokenizer())


def test_many_words_at_once(model):
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 65))) for _ in range(300)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))).encode()
              for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aehtinr", " ", "日本é") for _ in range(300)]
    words = [w for w in words if len(w) <= bpe.CACHED_BYTES]
    assert model.merge_many(words) == [tuple(model.merge(w)) for w in words]
    assert model.merge_many([b"a"]) == [tuple(model.merge(b"a"))]


@pytest.mark.parametrize("group,cached", [(1 << 21, 400_000), (1, 10), (900, 50)])
def test_groups_of_texts_change_no_id(monkeypatch, group, cached):
    monkeypatch.setattr(bpe, "GROUP", group)
    monkeypatch.setattr(bpe, "CACHE_WORDS", cached)
    monkeypatch.setattr(bpe, "SLICE", 5000)
    path = bpe.default_tokenizer()
    texts = [None, "", *bpe_texts(), None, "<|endoftext|>"]
    flat = lambda parts: [i for part in parts for i in part]
    bpe.loaded(path)[1].clear()
    assert [flat(parts) for parts in bpe.encoded(texts, path)] == [flat(bpe.pieces(t, path)) for t in texts]
    assert flat(next(iter(bpe.encoded(["<|endoftext|>"], path, added=False)))) == flat(bpe.pieces("<|endoftext|>", path, added=False))


def test_a_group_is_merged_by_rounds_not_word_by_word(monkeypatch):
    path, single = bpe.default_tokenizer(), []
    monkeypatch.setattr(bpe.Model, "merge", lambda self, data: single.append(data))
    bpe.loaded(path)[1].clear()
    texts = [f"some words {i} never{i}seen so{i}far" for i in range(200)]
    assert all(ids for parts in bpe.encoded(texts, path) for ids in parts) and single == []
    bpe.loaded(path)[1].clear()
