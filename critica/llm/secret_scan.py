"""Secret scan: fixed patterns, and a log-likelihood ratio of two character Markov models.

One model is of random strings, the other of ordinary identifiers; both are first-order over 68
character classes, backing off to single characters. Each learns from about ``sample_tokens`` tokens of the whole table, or
all of them if there are fewer (those whose hash is below a share of its range: the same on every run, without a sort):
* random: what the base patterns matched;
* ordinary: words in the shape of identifiers (runs of small letters, each with one capital at most before it,
  joined by ``_`` or ``-``; two closing digits at most).
The ratio table has 68 x 68 entries whatever the corpus, so it travels as one literal.

A token of 16 or more characters with letters and digits in it, outside every base span, is a secret
(kind ``random``) if its ratio reaches ``min_ratio`` bits a character. Without any sample of random
strings the table is flat and nothing is added.

Null text counts as empty; repeated rows give repeated results. Very long texts are searched whole. Only doc_id and text
are read, so other columns cannot clash; an empty table gives an empty result."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critica.llm.common import let, stored
from critica.llm.spans import Kind, count, digest, entries, located

# The base patterns, least lengths, and the classes of characters.
KINDS = [
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
         r"(?i)password|passwd|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]++", "AKIA"),
    Kind("hex", r"[0-9a-f]{24,}+", r"[0-9a-f]{24}"),
]
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
CANDIDATE = Kind("random", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+", r"[A-Za-z0-9+/_=-]{16}")
ORDINARY = Kind("word", r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?+[a-z]++[_-]?+)++(?:[0-9]{1,2})?+(?![A-Za-z0-9+/_=-])", r"[a-z]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CLASSES = len(ALPHABET)
SAMPLE_TOKENS = 2_000_000
MIN_RATIO = 1.0
BACK_OFF = 8


def base_valid() -> Column:
    value = F.regexp_extract("match", VALUE, 1)
    return F.when(F.col("kind") == 0, F.length(value) >= 6).when(
        F.col("kind") == 1, F.length("match") >= 20).otherwise(F.col("kind") == 2)


def payload() -> Column:
    return F.when(F.col("kind") == 0, F.regexp_extract("match", VALUE, 1)).otherwise(F.col("match"))


def codes(token: Column) -> Column:
    """class(previous) * CLASSES + class(next) for each pair of neighbouring characters."""
    spots = F.transform(F.filter(F.split(token, ""), lambda c: c != ""),
                        lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return let(spots, lambda at: F.transform(
        F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.get(at, i) * CLASSES + F.get(at, i + 1)))


def sampled(tokens: DataFrame, n: int, sample_tokens: int) -> DataFrame:
    """About ``sample_tokens`` of ``n`` rows, by their ``hash``."""
    top = min(2 ** 64 - 1, (2 ** 64 - 1) * sample_tokens // max(n, 1)) - 2 ** 63
    return tokens.filter(F.col("hash") <= top).select("token", "label")


def ratio_table(docs: DataFrame, sample_tokens: int = SAMPLE_TOKENS) -> list[float]:
    """log2 P(next | previous, random) - log2 P(next | previous, ordinary), flattened."""
    row = F.xxhash64("doc_id", "text").alias("row")
    words = F.filter(F.regexp_extract_all("text", F.lit(ORDINARY.pattern), F.lit(0)), lambda w: F.length(w) > 3)
    hashed = F.xxhash64("row", "pos").alias("hash")
    found = stored(docs.select(row, entries(F.col("text"), KINDS).alias("e"), F.size(words).alias("words")), "labels")
    random = (found.select("row", F.posexplode("e").alias("pos", "e")).select("row", "pos", "e.kind", "e.match")
              .filter(base_valid()).select(payload().alias("token"), F.lit(1).alias("label"), hashed))
    word = docs.select(row, F.posexplode(words).alias("pos", "token")).select("token", F.lit(0).alias("label"), hashed)
    random = sampled(random, random.count(), sample_tokens)
    word = sampled(word, found.agg(F.sum("words")).first()[0] or 0, sample_tokens)
    pairs = (random.unionByName(word).select("label", F.explode(codes(F.col("token"))).alias("code"))
             .groupBy("label", "code").count().collect())  # at most 2 * 68 * 68 rows
    counts = [[0] * (CLASSES * CLASSES) for _ in range(2)]
    if not any(r["label"] == 1 for r in pairs):
        return [0.0] * (CLASSES * CLASSES)
    for r in pairs:
        counts[r["label"]][r["code"]] += r["count"]
    logs = []
    for c in counts:
        nexts = [sum(c[b::CLASSES]) for b in range(CLASSES)]
        alone = [(n + 0.5) / (sum(nexts) + 0.5 * CLASSES) for n in nexts]
        sums = [sum(c[a * CLASSES:(a + 1) * CLASSES]) for a in range(CLASSES)]
        logs.append([math.log2((n + BACK_OFF * alone[i % CLASSES]) / (sums[i // CLASSES] + BACK_OFF)) for i, n in enumerate(c)])
    return [a - b for a, b in zip(logs[1], logs[0])]


def scan(docs: DataFrame, min_ratio: float = MIN_RATIO, sample_tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """One row per document (uid, doc_id) with ``spans``: array of (start, kind, name, end, score) in the order of
    start, then kind. ``score`` is the ratio in bits a character, null for base spans."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ratios = F.from_json(F.lit(json.dumps([round(x, 3) for x in ratio_table(docs, sample_tokens)])), "array<double>")
    found = located(docs, [*KINDS, CANDIDATE])
    base, token = F.col("kind") < len(KINDS), F.col("kind") == len(KINDS)
    found = found.withColumn("kind", F.when(token | base_valid(), F.col("kind")))  # failed matches keep their document
    # a candidate is outside the base spans that start before its end, and before those that start later
    by_start = Window.partitionBy("uid").orderBy("start", "kind")
    found = found.withColumns({
        "base_end": F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "base_start": F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    outside = (F.coalesce(F.col("base_end"), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.col("base_start"), F.col("end")) >= F.col("end"))
    mixed = F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")
    score = F.when(token & outside & mixed, F.aggregate(
        F.transform(codes(F.col("match")), lambda c: F.get(ratios, c)), F.lit(0.0), lambda a, x: a + x)
        / (F.length("match") - 1))
    name = F.element_at(F.array(*[F.lit(k.name) for k in (*KINDS, CANDIDATE)]), F.col("kind") + 1)
    found = found.withColumn("score", score)
    span = F.when(base | (F.col("score") >= min_ratio), F.struct(
        "start", "kind", name.alias("name"), "end", "score"))
    return found.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def op8(docs: DataFrame) -> DataFrame:
    out = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return out.select(
        "doc_id", *[count(F.col("spans"), n).alias(f"n_{k.name}") for n, k in enumerate(KINDS)],
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
        count(F.col("spans"), len(KINDS)).alias("n_random"))
