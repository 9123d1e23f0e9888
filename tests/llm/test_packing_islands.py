"""The genetic algorithm of op1 where best fit is not enough: lengths in triples that fill a sequence exactly."""

import random

from pyspark.sql import functions as F

from critica.llm import packing

SIZE = 1000


def triples(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < 3 * n:
        a, b = rng.randrange(SIZE // 4 + 1, SIZE // 2), rng.randrange(SIZE // 4 + 1, SIZE // 2)
        if SIZE // 4 < SIZE - a - b < SIZE // 2:
            out += [a, b, SIZE - a - b]
    return out


def down(lengths):
    return len(packing.best_fit([], sorted(lengths, reverse=True), SIZE))


def test_islands_with_migration_need_fewer_sequences(spark, monkeypatch):
    """Strictly fewer than best fit and than one island, summed over shards; never fewer than fit."""
    shards = {s: triples(60, s) for s in range(4)}
    items = spark.createDataFrame([(s, x) for s, xs in shards.items() for x in xs], "shard long, length long")

    def sequences():
        out = {r["shard"]: r["bins"] for r in packing.island_solutions(items, SIZE).collect()}
        for s, bins in out.items():
            assert sorted(x for b in bins for x in b) == sorted(shards[s]) and max(map(sum, bins)) <= SIZE
        return sum(len(b) for b in out.values())

    many = sequences()
    monkeypatch.setattr(packing, "ISLANDS", 1)
    monkeypatch.setattr(packing, "EPOCHS", 1)
    one = sequences()
    assert 4 * 60 <= many < one < sum(map(down, shards.values()))


def test_without_generations_nothing_is_gained(monkeypatch):
    cases = [triples(40, s) for s in range(4)]
    with_it = sum(len(packing.evolve(x, [], SIZE, 3)) for x in cases)
    calls = []
    cross = packing.cross
    monkeypatch.setattr(packing, "cross", lambda *a: calls.append(1) or cross(*a))
    assert sum(len(packing.evolve(x, [], SIZE, 3)) for x in cases) == with_it and len(calls) == 4 * packing.GENERATIONS
    monkeypatch.setattr(packing, "GENERATIONS", 0)
    assert with_it < sum(len(packing.evolve(x, [], SIZE, 3)) for x in cases)


def test_crossover_injects_whole_bins_and_keeps_every_piece():
    import numpy as np
    rng = np.random.default_rng(5)
    lengths = triples(30, 9)
    a = packing.best_fit([], sorted(lengths, reverse=True), SIZE)
    b = [lengths[i:i + 3] for i in range(0, 90, 3)]  # the perfect packing
    child = packing.cross(a, b, SIZE, rng)
    assert sorted(x for c in child for x in c) == sorted(lengths) and max(map(sum, child)) <= SIZE
    whole = {tuple(sorted(x)) for x in b}
    assert sum(tuple(sorted(c)) in whole for c in child) >= 15 and len(child) < len(a)


def test_best_is_optimal_on_small_cases():
    """Against every way to pack up to seven pieces."""
    def optimum(pieces, bins):
        if not pieces:
            return len(bins)
        best = len(pieces) + len(bins)
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + pieces[0] <= 20:
                best = min(best, optimum(pieces[1:], [*bins[:i], bins[i] + pieces[0], *bins[i + 1:]]))
        return min(best, optimum(pieces[1:], [*bins, pieces[0]]))

    rng = random.Random(1)
    for k in range(60):
        pieces = [rng.randrange(3, 15) for _ in range(rng.randrange(1, 8))]
        assert len(packing.evolve(pieces, [], 20, k)) == optimum(sorted(pieces, reverse=True), [])


def test_small_shards_are_packed_together_again(spark):
    """A second round over the part-filled sequences of all shards: few more than one shard would need."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join("a" for _ in range(rng.randrange(1, 60)))) for i in range(400)], "doc_id long, text string")
    one = packing.pack(docs, size=128).select("sequence_id").distinct().count()
    parts = packing.pack(docs, size=128, shard_pieces=50)
    assert parts.select("sequence_id").distinct().count() <= one + 3
    assert parts.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 128").isEmpty()
