"""Model-free answer-quality metrics (M1-M8) as native Column expressions.

Every function takes and returns Columns, so a whole metric row is one projection inside
whole-stage codegen; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from critica.config import DEFAULT_METRICS, MetricsConfig
from critica.functions.common import NON_WS_CLASS, WS_CLASS, col

# A word character the way Python 3 ``\w`` sees it (Unicode letters, numbers, underscore).
# Java's plain \w is ASCII-only, so the class is spelled out.
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_SPLIT = r"[.!?]+"

# Structure markers (bullets, numbered items, markdown headers, bold) as one multi-line
# pattern. (?m): ^ after newline; [^\n] instead of '.' so only \n ends a line in every engine.
STRUCTURE = (
    "(?m)("
    f"^{WS_CLASS}*[-*•]{WS_CLASS}"
    f"|^{WS_CLASS}*\\p{{Nd}}+[.)]{WS_CLASS}"
    f"|^#+{WS_CLASS}"
    r"|\*\*[^\n]+?\*\*"
    ")"
)


NON_WORD = r"[^\p{L}\p{N}_]+"


def tokens(text) -> Column:
    """M1: lower-cased word tokens (maximal runs of word characters).

    Computed as the non-empty pieces of a split on non-word runs - the same list as extracting
    every word run, with native functions only (no per-match objects, no lambda)."""
    return F.array_remove(F.split(F.lower(col(text)), NON_WORD, -1), "")


def sentences(text) -> Column:
    """M2: pieces between runs of . ! ?, blank pieces dropped (pieces are not stripped here;
    only their count is used downstream)."""
    parts = F.split(col(text), SENTENCE_SPLIT, -1)
    return F.filter(parts, lambda s: s.rlike(NON_WS_CLASS))


def word_count(words) -> Column:
    return F.size(col(words))


def sentence_piece_count(text) -> Column:
    """Number of M2 sentences without building them: one match per non-blank piece between
    [.!?] runs (a piece matches from its first non-blank character to its end; linear time)."""
    return F.regexp_count(col(text), F.lit("[^.!?" + WS_CLASS[1:-1] + "][^.!?]*"))


def sentence_count(sents) -> Column:
    """M3: at least one sentence, so the average below never divides by zero."""
    return F.greatest(F.size(col(sents)), F.lit(1))


def has_structure(text) -> Column:
    """M4: 1.0 if any bullet / numbered list / header / bold marker occurs."""
    return F.when(col(text).rlike(STRUCTURE), F.lit(1.0)).otherwise(F.lit(0.0))


def avg_sentence_length(n_words, n_sents) -> Column:
    """M5: words per sentence (unrounded)."""
    return col(n_words) / col(n_sents)


def lexical_diversity(words) -> Column:
    """M6: distinct / total tokens, 0 when there are none."""
    n = F.size(col(words))
    return F.when(n > 0, F.size(F.array_distinct(col(words))) / n).otherwise(F.lit(0.0))


def query_keywords(query) -> Column:
    """Distinct query tokens of four or more characters."""
    return F.array_distinct(F.filter(tokens(query), lambda t: F.length(t) >= 4))


def coverage_score(words, query, keywords=None) -> Column:
    """M7: share of query keywords present in the answer; 0.5 without query or keywords.
    ``keywords`` may pass a precomputed ``query_keywords(query)`` column."""
    kw = col(keywords) if keywords is not None else query_keywords(query)
    n_kw = F.size(kw)
    hit = F.size(F.array_intersect(kw, col(words)))
    q = col(query)
    return (F.when(q.isNull() | (q == F.lit("")), F.lit(0.5))
            .when(n_kw == 0, F.lit(0.5))
            .otherwise(hit / n_kw))


def composite_score(n_words, structure, diversity, coverage, asl,
                    cfg: MetricsConfig = DEFAULT_METRICS) -> Column:
    """M8: weighted composite in [0, 10] before rounding.

    length = min(w/max, 1), scaled by w/min below the minimum; density prefers ~15 words per
    sentence. Arithmetic order is fixed so the oracle reproduces the same doubles."""
    w = col(n_words)
    length = F.least(w / F.lit(float(cfg.max_word_count)), F.lit(1.0))
    length = F.when(w < cfg.min_word_count, length * (w / F.lit(float(cfg.min_word_count)))).otherwise(length)
    density = F.lit(1.0) - F.least(F.abs(col(asl) - F.lit(15.0)) / F.lit(15.0), F.lit(1.0))
    raw = (F.lit(0.25) * length + F.lit(0.25) * col(diversity) + F.lit(0.30) * col(coverage)
           + F.lit(0.20) * col(structure)) * density
    return raw * F.lit(10.0)
