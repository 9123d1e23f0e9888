"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own; lines that fail are removed; a document that loses too much of
its text, or fails the document rules on what it was given, is rejected.

Line rules (a line without a word is always kept):
* ``navigation``: at least 2 separators among the words, and more than 1 to every 5 words;
* ``symbols``: more than 1 symbol character of ``#*$%&|<>`` to every 3 words, and at least 3;
* ``shouting``: at least 3 words ending in ``!!``, and more than a third of the words;
* ``boilerplate``: a fixed phrase of web pages (cookies, sign-in, scripts, rights);
* ``punctuation``: at least 25 words and no sentence mark anywhere.

Document rules: fewer than 10 words; more than a fifth of the words in 5-word windows that occur
twice or more; more than half of the words in failed lines.

Null or empty text has no words, so it is rejected; repeated rows are judged alike; an empty table stays empty. Texts of any
length are judged whole and exactly. Input columns named like a result are replaced, all others stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critica.llm.common import SPACE, WORD, let

# Phrases of page furniture.
BOILERPLATE = (r"(?i)(?=[acelpst])(?:accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved"
               r"|enable javascript|sign in to|log in to|subscribe to our newsletter|click here)")
MARK = r"[.!?…。！？]"
MAX_LOST = 0.5
POSITION_BITS = 24


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def line_fails(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(WORD))
    # the separator itself first, then what stands before it: a lookbehind at every character is slow
    separators = F.regexp_count(line, F.lit(r"[|»›•·>](?<![^\x20\x09-\x0D].)[|»›•·>]*+(?![^\x20\x09-\x0D])"))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]"))
    shouts = F.regexp_count(line, F.lit(r"!!(?![^\x20\x09-\x0D])"))
    return (n > 0) & (((separators >= 2) & (separators * 5 > n)) | ((symbols >= 3) & (symbols * 3 > n))
                      | ((shouts >= 3) & (shouts * 3 > n)) | line.rlike(BOILERPLATE)
                      | ((n >= 25) & ~line.rlike(MARK)))


def repeated_words(text: Column, width: int = 5) -> Column:
    """Words in ``width``-word windows found twice or more in the text, the first included.

    Most texts have no equal windows: their hashes are all distinct, which is cheap to see. Otherwise a window's
    hash and its position are packed into one long, so one sort brings equal windows together, and
    neighbours of equal hash are compared word for word. Where two of them differ all the same, or the text has more
    words than positions fit, the windows themselves are sorted instead."""
    low = (1 << POSITION_BITS) - 1

    def windows(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.xxhash64(F.slice(ws, i, width)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            F.when(F.size(h) > low - 1, by_words(ws)).otherwise(by_hash(ws, h))))

    def by_hash(ws: Column, h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR((i + 1).cast("long"))))
        return let(packed, lambda order: let(
            F.transform(order, lambda x, i: next_one(ws, order, i)),
            lambda pairs: F.when(F.array_contains(pairs, 2), by_words(ws)).otherwise(
                covered(F.transform(order, position), F.transform(pairs, lambda k: k == 1)))))

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    def next_one(ws: Column, order: Column, i: Column) -> Column:
        """0: the next hash is another one; 1: the next window is equal; 2: equal hashes, different windows."""
        a, b = F.get(order, i), F.get(order, i + 1)
        return F.when(b.isNull() | (a.bitwiseXOR(b).bitwiseAND(F.lit(~low)) != 0), F.lit(0)).when(
            F.slice(ws, position(a), width) == F.slice(ws, position(b), width), F.lit(1)).otherwise(F.lit(2))

    def by_words(ws: Column) -> Column:
        """The exact way for every case: windows sorted as words."""
        order = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.struct(
            F.slice(ws, i, width).alias("w"), i.alias("at"))))
        return let(order, lambda o: covered(F.transform(o, lambda x: x["at"]), F.transform(o, lambda x, i: F.coalesce(
            x["w"] == F.get(o, i + 1)["w"], F.lit(False)))))

    def covered(places: Column, with_next: Column) -> Column:
        """Words in the windows that equal the one before or after them in the order."""
        hit = let(with_next, lambda same: F.filter(F.transform(places, lambda at, i: F.when(
            F.get(same, i) | F.coalesce(F.get(same, i - 1), F.lit(False)), at)), lambda x: x.isNotNull()))
        return let(F.sort_array(hit), lambda h: F.aggregate(
            h, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, x: F.struct((x + width).alias("end"),
                                    (acc["n"] + width - F.greatest(acc["end"] - x, F.lit(0))).alias("n")),
            lambda acc: acc["n"]))

    return let(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE + "+"), lambda ws: F.when(
        F.size(ws) > width, windows(ws)).otherwise(F.lit(0))).cast("long")


def judge(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Every input column but those made here, then the counts, ``cleaned`` (text without failed lines),
    ``n_words_kept``, ``base_failed`` and ``kept``."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned",
            "n_words_kept", "base_failed", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    with_word = F.filter(lines, lambda x: x.rlike(WORD))
    out = docs.drop(*made).withColumns({
        "n_words": n_words(text),
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(text),
        "cleaned": F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n"),
    })
    out = out.withColumn("n_words_kept", n_words(F.col("cleaned")))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumns({
        "base_failed": failed,
        "kept": ~failed & ((F.col("n_words") - F.col("n_words_kept")) <= F.col("n_words") * F.lit(max_lost))})


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that pass, their failed lines removed and ``n_chars`` (where present) renewed."""
    out = judge(docs, max_lost).filter("kept").withColumn("text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_words_kept")
