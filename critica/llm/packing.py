"""Best-fit packing by a grouping genetic algorithm, as islands with elite migration.

Documents become token ids (plus an end id); longer ones are cut into pieces of ``size`` tokens, the first
piece taking the rest. A full piece is a sequence by itself. The others are dealt at random to
shards of about ``SHARD_PIECES`` pieces; each shard is packed by ``ISLANDS`` islands, each island one row of
one Spark task, for ``EPOCHS`` epochs:

* an individual is a list of bins (groups of piece lengths); fitness is the mean squared fill;
* crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
  duplicates of the injected pieces, and best-fits the displaced pieces;
* mutation dissolves some of the worst-filled bins and best-fits their pieces;
* between epochs the best individual (elite) of each island moves to the next island of its shard.

Pieces of one length are interchangeable, so islands work on lengths; the shard's best solution is then
dealt to its pieces by (length, rank). An island stops as soon as its best reaches the bound
ceil(tokens / size). At the end the worst-filled sequences of all shards are dealt to fewer shards and packed
once more, so the number of part-filled sequences does not grow with the number of shards.

Null text counts as empty (the end id alone). Repeated rows are packed one by one; pieces of equal length tie and are dealt by
rank. Texts of any length are encoded whole, one row at a time. Input columns named like a result are replaced, all
others stay. An empty table gives an empty result."""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.llm.common import shuffle_partitions, stored

SIZE = 2048
END_ID = 0
SHARD_PIECES = 8192
ISLANDS = 4
EPOCHS = 2
POPULATION = 6
GENERATIONS = 12
WELL_FILLED = 0.999


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def load_encoder(path: str):
    """text -> ids of the tokenizer file, loaded once a Python worker.

    Where the same vocabulary lies beside it as ranks (``.tiktoken``), the faster library gives the same ids."""
    import os

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                 special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, size: int, tokenizer: str, carry: list[str]) -> DataFrame:
    """carry, piece, start, length, ids_crc32, uid (unique), for every piece."""
    def cut(batches):
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                n = len(ids)
                edge, at, k = ((n - 1) % size) + 1, 0, 0
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(edge - at)
                    crc.append(zlib.crc32(ids[at:edge].tobytes()))
                    at, edge, k = edge, edge + size, k + 1
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in carry), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(np.arange(uid, uid + len(row)), pa.int64())],
                [*carry, "piece", "start", "length", "ids_crc32", "uid"])
            uid += len(row)

    schema = T.StructType([docs.schema[c] for c in carry] + [
        T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in (
            "start", "length", "ids_crc32", "uid")]])
    return docs.select(*carry, "text").mapInArrow(cut, schema)


# --- one island -------------------------------------------------------------------------------------

class Rooms:
    """Open bins by the room left; finds the bin of least sufficient room."""

    def __init__(self, size: int):
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0  # bit r is set if some bin has room r

    def put(self, room: int, bin_: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room

    def best(self, need: int) -> tuple[int, int] | None:
        above = self.mask >> need
        if not above:
            return None
        room = need + ((above & -above).bit_length() - 1)
        at = self.by_room[room]
        bin_ = at.pop()
        if not at:
            self.mask &= ~(1 << room)
        return room, bin_


def best_fit(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Add ``lengths`` to ``bins``: each into the fullest bin that has room, else a new one."""
    rooms = Rooms(size)
    for b, content in enumerate(bins):
        room = size - sum(content)
        if room:
            rooms.put(room, b)
    for x in lengths:
        found = rooms.best(x)
        if found is None:
            bins.append([x])
            left, b = size - x, len(bins) - 1
        else:
            room, b = found
            bins[b].append(x)
            left = room - x
        if left:
            rooms.put(left, b)
    return bins


def fitness(bins: list[list[int]], size: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill."""
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins) / max(len(bins), 1)


def cross(a: list[list[int]], b: list[list[int]], size: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled bins of ``b`` into ``a``; bins of ``a`` that held the injected pieces are dissolved and
    their other pieces best-fitted again."""
    full = [x for x in b if sum(x) >= WELL_FILLED * size]
    if not full:
        return [list(x) for x in a]
    chosen = [full[i] for i in rng.choice(len(full), max(1, len(full) // 2), replace=False)]
    taken: dict[int, int] = {}
    for x in chosen:
        for v in x:
            taken[v] = taken.get(v, 0) + 1
    kept, displaced = [], []
    for i in sorted(range(len(a)), key=lambda i: sum(a[i])):  # the worst-filled bins give up their pieces first
        hit = False
        rest = []
        for v in a[i]:
            if taken.get(v, 0):
                taken[v] -= 1
                hit = True
            else:
                rest.append(v)
        if hit:
            displaced += rest
        else:
            kept.append(list(a[i]))
    return best_fit(kept + [list(x) for x in chosen], sorted(displaced, reverse=True), size)


def mutate(bins: list[list[int]], size: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolve some part-filled bins and best-fit their pieces in a disturbed order."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    gone = {i for i in order[:max(2, len(bins) // 20)] if rng.random() < 0.7} | set(rng.choice(len(bins), min(2, len(bins)), replace=False).tolist())
    pieces_ = [v for i in gone for v in bins[i]]
    noise = rng.normal(0, 0.05, len(pieces_))
    pieces_ = [v for _, v in sorted(zip((-v * (1 + e) for v, e in zip(pieces_, noise)), pieces_))]
    return best_fit([list(x) for i, x in enumerate(bins) if i not in gone], pieces_, size)


def evolve(lengths: list[int], elites: list[list[list[int]]], size: int, seed: int) -> list[list[int]]:
    """The best individual after ``GENERATIONS`` generations, given other islands' elites."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(lengths) // size)
    down = sorted(lengths, reverse=True)
    people = [[list(b) for b in e] for e in elites] or [best_fit([], down, size)]
    if len(min(people, key=len)) > bound:
        while len(people) < POPULATION:
            noise = rng.normal(0, 0.02 * (1 + len(people)), len(down))
            people.append(best_fit([], [v for _, v in sorted(zip((-v * (1 + e) for v, e in zip(down, noise)), down))], size))
        for _ in range(GENERATIONS):
            people.sort(key=lambda p: fitness(p, size), reverse=True)
            if len(people[0]) <= bound:
                break
            i, j = rng.choice(min(4, len(people)), 2, replace=False)
            people = people[:POPULATION - 2] + [cross(people[i], people[j], size, rng), mutate(people[0], size, rng)]
    return max(people, key=lambda p: fitness(p, size))


# --- Spark: islands, migration, dealing --------------------------------------------------------------

ISLAND_SCHEMA = "shard long, island int, n_bins long, fill double, lengths array<int>, bins array<array<int>>"


ISLAND_ARROW = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int64()), ("fill", pa.float64()),
                          ("lengths", pa.list_(pa.int32())), ("bins", pa.list_(pa.list_(pa.int32())))])


def _epoch(size: int, epoch: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # a row out at a time: it holds a whole shard's lengths
                best = evolve(row["lengths"], row["elites"] or [], size, hash((row["shard"], row["island"], epoch)) & 0xFFFFFFFF)
                score = fitness(best, size)
                yield pa.RecordBatch.from_pylist([{
                    "shard": row["shard"], "island": row["island"], "n_bins": -score[0], "fill": score[1],
                    "lengths": row["lengths"], "bins": best}], ISLAND_ARROW)
    return run


def island_solutions(items: DataFrame, size: int) -> DataFrame:
    """(shard, bins): the best packing of each shard's lengths. ``items`` has (shard, length)."""
    shards = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.col("length").cast("int"))).alias("lengths"))
    islands = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths",
                            F.lit(None).cast("array<array<array<int>>>").alias("elites"))
    for epoch in range(EPOCHS):
        # by number: these few small rows are the work of whole tasks, not to be coalesced
        done = stored(islands.repartition(shuffle_partitions(items.sparkSession), "shard", "island").mapInArrow(_epoch(size, epoch), ISLAND_SCHEMA), "islands")
        moved = done.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("guest"))
        islands = done.join(moved, ["shard", "island"]).select(
            "shard", "island", "lengths", F.array("bins", "guest").alias("elites"))
    return done.groupBy("shard").agg(F.max_by("bins", F.struct(-F.col("n_bins"), "fill", -F.col("island"))).alias("bins"))


def deal(items: DataFrame, solutions: DataFrame) -> DataFrame:
    """(uid, length, shard, bin, offset, fill): each piece's place; pieces of one length by rank."""
    slots = (solutions.select("shard", F.posexplode("bins").alias("bin", "b"))
             .select("shard", "bin", F.posexplode("b").alias("place", "length"),
                     F.aggregate("b", F.lit(0), lambda a, x: a + x).alias("fill"), "b")
             .select("shard", "bin", F.col("length").cast("long").alias("length"), "fill",
                     F.aggregate(F.slice("b", F.lit(1), F.col("place")), F.lit(0), lambda a, x: a + x).cast("long").alias("offset")))
    slots = slots.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "length").orderBy("bin", "offset")))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "length").orderBy("uid")))
    return ranked.join(slots, ["shard", "length", "rank"]).select("uid", "length", "shard", "bin", "offset", "fill")


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, (the input's other columns but text,) piece, start, length, ids_crc32, sequence_id, offset."""
    made = {"piece", "start", "length", "ids_crc32", "sequence_id", "offset", "uid", "text"}
    carry = [c for c in docs.columns if c not in made]
    table = stored(pieces(docs, size, tokenizer or default_tokenizer(), carry), "pieces")
    small = table.filter(F.col("length") < size)
    n = small.count()
    if not n:
        return table.select(*carry, "piece", "start", "length", "ids_crc32", F.col("uid").alias("sequence_id"),
                            F.lit(0).cast("long").alias("offset"))
    shards = -(-n // shard_pieces)
    items = small.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    placed = stored(deal(items, island_solutions(items, size)), "placed")
    tail = placed.filter(F.col("fill") < size)
    if shards > 1:
        m = tail.count()
        again = -(-m // shard_pieces)
        rest = tail.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(again)).alias("shard"))
        second = stored(deal(rest, island_solutions(rest, size)), "placed")
        bins = lambda df: df.select("shard", "bin").distinct().count()
        if m and bins(second) <= bins(tail):
            placed = placed.filter(F.col("fill") == size).withColumn("level", F.lit(0)).unionByName(
                second.withColumn("level", F.lit(1)))
    if "level" not in placed.columns:
        placed = placed.withColumn("level", F.lit(0))
    # ids: a full piece -1 - uid, a packed bin (level, shard, bin) in one non-negative long
    where = placed.select("uid", ((F.col("shard") * 2 + F.col("level")) * (shard_pieces * 16) + F.col("bin")).alias("sequence_id"), "offset")
    return table.join(where, "uid", "left").select(
        *carry, "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", -1 - F.col("uid")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))


def op1(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
