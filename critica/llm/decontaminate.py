"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed hashes the words that a fixed mask selects and ignores the others, so a substituted word under
an ignored position does not hide a match. Seeds of benchmark items and of training documents
meet in a join. Each hit fixes an alignment (document position minus item position); on it, the item's
words are compared with the document's one by one. A document is contaminated by an item if some
aligned window of ``window`` item words (the whole item, where shorter) agrees in at least
``min_agree`` of its positions. Items of ``SHORT`` words up to the window have masks of their own over their first
``SHORT`` words; shorter ones must occur whole.

Words are the white-space separated words, A-Z lower-cased. Null and empty texts have no seeds:
such documents are clean, such items match nothing. Repeated rows are judged alike; items of equal
text all match.

The item side is broadcast only while its seeds number at most ``BROADCAST_SEEDS``; beyond that,
both sides shuffle on the seed hash, frequent seeds dealt to several tasks. Document words are cut into blocks, so a very
long text is many rows of bounded size. Empty tables give empty or clean results. Input columns named like a
result are replaced, all others stay, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critica.llm.common import fresh, let, lower_ascii, salted_join, stored, words

# 8 words compared each. Of the places of any two substitutions in 13 words, every pair is
# ignored by one of the masks at some place in the window (found by search, checked by a test): no
# window of 13 words with 11 or more equal is without a common seed.
MASKS = ("1101110111", "111101111", "11111001011", "110001011111", "1110111000011")
SPAN = 13
# Any two of 8 words lie in two of four pairs: each mask ignores two pairs.
SHORT_MASKS = ("11110000", "11001100", "11000011", "00111100", "00110011", "00001111")
SHORT = 8
WINDOW = 13
MIN_AGREE = 0.8
BLOCK = 2048
BROADCAST_SEEDS = 500_000


def block_rows(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, base (words before the block), w (the block's words and ``SPAN - 1`` more)."""
    split = df.select(*keys, F.explode(F.array(words(lower_ascii("text")))).alias("all"))  # a barrier: split once
    return split.filter(F.size("all") > 0).select(
        *keys, F.explode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("all") - 1) / block).cast("int")),
            lambda b: F.struct((b * block).alias("base"),
                               F.slice("all", b * block + 1, block + SPAN - 1).alias("w")))).alias("b")).select(
        *keys, "b.base", "b.w")


def seeds(df: DataFrame, keys: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    """keys, pos, mask, seed: every masked window of every text."""
    blocks = block_rows(df, keys).select(*keys, "base", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    shifted = [F.when(F.size("h") > i, F.slice("h", i + 1, BLOCK)).otherwise(F.array().cast("array<bigint>")).alias(f"w{i}")
               for i in range(SPAN)]
    rows = blocks.select(*keys, "base", F.posexplode(F.arrays_zip(*shifted)).alias("i", "w"))
    at = rows.select(*keys, (F.col("base") + F.col("i")).alias("pos"), *[f"w.w{i}" for i in range(SPAN)])
    hashes = [F.struct(F.lit(n).alias("mask"), F.xxhash64(F.lit(n), *[
        F.col(f"w{i}") for i, bit in enumerate(mask) if bit == "1"]).alias("seed")) for n, mask in enumerate(masks)]
    last = [mask.rindex("1") for mask in masks]
    full = F.array(*[F.when(F.col(f"w{e}").isNotNull(), h) for h, e in zip(hashes, last)])
    return at.select(*keys, "pos", F.explode(full).alias("s")).filter("s is not null").select(*keys, "pos", "s.mask", "s.seed")


def find_hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Stored: distinct (doc_id, text_hash, item, shift) with a common seed; shift = document position of the
    item's first word."""
    keys = ["doc_id", "text_hash"]
    sized = items.withColumn("n", F.size("item_words")).filter("n > 0")
    short = sized.filter(F.col("n") < window)
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # below ``window`` each
    masked = [("long", sized.filter(F.col("n") >= window), MASKS)]
    if any(n >= SHORT for n in lengths):
        masked.append(("short", short.filter(F.col("n") >= SHORT), SHORT_MASKS))
    hits = None
    for name, some, masks in masked:
        side = seeds(some, ["item"], masks)
        side = stored(side if name == "long" else side.filter("pos = 0"), f"{name}_seeds")
        found = meet(seeds(docs, keys, masks), side.select("item", "seed", F.col("pos").alias("item_pos"))).select(
            *keys, "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
        hits = found if hits is None else hits.unionByName(found)
    whole = [n for n in lengths if n < SHORT]
    if whole:  # one pass for all lengths
        grams = block_rows(docs, keys).select(*keys, "base", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("w")), lambda i: F.array(*[F.xxhash64(F.slice("w", i, n)) for n in whole]))).alias("i", "g"))
        grams = grams.select(*keys, (F.col("base") + F.col("i")).alias("pos"), F.explode("g").alias("seed"))
        items_whole = stored(short.filter(F.col("n") < SHORT).select("item", F.xxhash64("item_words").alias("seed")), "whole_seeds")
        hits = hits.unionByName(meet(grams, items_whole).select(*keys, "item", F.col("pos").alias("shift")))
    return stored(hits.distinct(), "hits")


def meet(texts: DataFrame, side: DataFrame) -> DataFrame:
    """Seeds of documents joined to a stored table of item seeds."""
    if side.count() <= BROADCAST_SEEDS:
        return texts.join(F.broadcast(side), "seed")
    return salted_join(texts, side, "seed", "pos")


def best_agreement(doc_words: Column, item_words: Column, shift: Column, window: int) -> Column:
    """The most agreeing positions in any aligned window, as a share of the window's length."""
    n = F.size(item_words)
    equal = F.transform(item_words, lambda w, i: F.coalesce(
        F.when(shift + i >= 0, F.get(doc_words, (shift + i).cast("int")) == w), F.lit(False)).cast("int"))
    sums = let(equal, lambda e: F.aggregate(e, F.array(F.lit(0)), lambda acc, x: F.concat(
        acc, F.array(F.element_at(acc, -1) + x))))
    size = F.least(n, F.lit(window))
    return let(sums, lambda c: F.array_max(F.transform(
        F.sequence(F.lit(0), n - size), lambda s: F.get(c, s + size) - F.get(c, s)))) / size


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_agree: float = MIN_AGREE) -> DataFrame:
    """Confirmed (doc_id, text_hash, item_id, shift, agreement)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text",
                                    words(lower_ascii("text")).alias("item_words")), "items")
    hits = find_hits(docs, items, window)
    aligned = hits.groupBy("doc_id", "text_hash", "item").agg(F.collect_set("shift").alias("shifts"))
    # each side of the next join is one row per (document, item): documents without a hit stay out of it
    texts = docs.join(aligned.select("doc_id", "text_hash").distinct().withColumnsRenamed(
        {"doc_id": "d", "text_hash": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")),
        "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = stored(texts.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"),
                                words(lower_ascii("text")).alias("doc_words")), "hit_texts")
    pairs = aligned.join(items.select("item", "item_id", "item_words"), "item").join(
        texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    scored = pairs.select("doc_id", "text_hash", "item_id", let(F.col("doc_words"), lambda dw: F.array_max(F.transform(
        "shifts", lambda s: F.struct(best_agreement(dw, F.col("item_words"), s, window).alias("agreement"),
                                     (-s).alias("back"))))).alias("best"), F.size("item_words").alias("n"))
    enough = F.when(F.col("n") < min(window, SHORT), F.lit(1.0)).otherwise(F.lit(min_agree))
    return scored.filter(F.col("best.agreement") >= enough).select(
        "doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("shift"), F.col("best.agreement").alias("agreement"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_agree: float = MIN_AGREE) -> DataFrame:
    """The input rows and columns, with contaminated, n_items (distinct items found), best_item and
    best_agreement (null where clean)."""
    made = {"contaminated", "n_items", "best_item", "best_agreement"}
    found = (leaks(docs, benchmark, window, min_agree).groupBy("doc_id", "text_hash").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.max(F.struct("agreement", (-F.col("item_id")).alias("item"))).alias("best")))
    d, t, best = (fresh(docs.columns, n) for n in ("d", "t", "best"))
    found = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), "n_items", F.col("best").alias(best))
    keep = [f"`{c}`" for c in docs.columns if c not in made]
    out = docs.select(*keep).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")
    return out.select(*keep, F.col(best).isNotNull().alias("contaminated"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      (-F.col(f"{best}.item")).alias("best_item"), F.col(f"{best}.agreement").alias("best_agreement"))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return mark(docs.select("doc_id", "text"), benchmark).drop("text")
