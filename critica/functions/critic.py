"""Critic-reply parsing and scoring (C1-C13, F1, F2) as native Column expressions.

A reply is parsed once into a VARIANT (``try_parse_json``); list, number and verdict fields are
read from it with ``try_variant_get`` and typed by ``schema_of_variant``. No Python UDF: the
coercion rules of the reproduced critic are written as CASE expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critica.config import DEFAULT_LOOP, DEFAULT_WEIGHTS, CriticWeights, LoopConfig
from critica.functions.common import WS_CLASS, col, is_blank, py_round, ustrip

# Verdict domain, aliases, score bands and the fallback action text of the
# critic being reproduced.
VERDICTS = ["poor", "acceptable", "good", "excellent"]
VERDICT_ALIASES = {
    "needs_improvement": "poor",
    "needs improvement": "poor",
    "unacceptable": "poor",
    "bad": "poor",
    "great": "good",
    "perfect": "excellent",
}
VERDICT_BANDS = [(8.5, "excellent"), (6.5, "good"), (4.0, "acceptable")]  # else poor
FALLBACK_ACTION = ("Critic failed to parse structured feedback — rewrite answer "
                   "with clearer, more precise language.")
FALLBACK_SCORE = 3.0
FALLBACK_CONFIDENCE = 0.2
LIST_FIELDS = ["factual_errors", "hallucinations", "missing_concepts", "logical_flaws",
               "improvement_actions"]
ISSUE_MARKERS = [("hallucinations", "[!]"), ("factual_errors", "[x]"),
                 ("logical_flaws", "[~]"), ("missing_concepts", "[ ]"),
                 ("improvement_actions", ">>")]

# (?s) lets '.' match newlines: same as [\s\S] but far cheaper per character in Java regex.
FENCE = "(?s)```(?:json)?" + WS_CLASS + "*(.*?)```"
JSON_OBJECT = r"(?s)\{.*\}"
# What Python's float() takes of a reply's texts: no type suffixes (Java's cast takes "7.5d"), no hex.
NUMBER = r"(?i)^\s*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
_INT_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT")


# ---------------------------------------------------------------- C1 / C2
def strip_fences(raw) -> Column:
    """Replace every fenced block by its body, then strip."""
    return ustrip(F.regexp_replace(col(raw), FENCE, "$1"))


def extract_json_object(text) -> Column:
    """Greedy first '{' to last '}'; the whole text when there is none."""
    m = F.regexp_extract(col(text), JSON_OBJECT, 0)
    return F.coalesce(F.nullif(m, F.lit("")), col(text))


def parse_reply(raw) -> Column:
    """C1 -> C2 -> JSON: a VARIANT, NULL when the text is not valid JSON."""
    return F.try_parse_json(extract_json_object(strip_fences(raw)))


def is_object(v) -> Column:
    return F.coalesce(F.schema_of_variant(col(v)).startswith("OBJECT"), F.lit(False))


def field(v, name: str) -> Column:
    return F.try_variant_get(col(v), f"$.{name}", "variant")


# ---------------------------------------------------------------- C4
def _item_text(x: Column) -> Column:
    """One list element -> kept text or NULL (dropped)."""
    t = F.schema_of_variant(x)
    s = F.try_variant_get(x, "$", "string")
    return (F.when(t == "STRING", F.when(is_blank(s), F.lit(None)).otherwise(ustrip(s)))
            .when(t == "BOOLEAN", F.initcap(s))
            .when(t.isin(*_INT_TYPES), s)
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                  F.try_variant_get(x, "$", "double").cast("string"))
            .otherwise(F.lit(None)))


def safe_list(value, vtype=None) -> Column:
    """C4: null -> []; non-blank string -> [s] (unstripped); list -> stripped non-blank strings
    and numbers as text (booleans count as numbers); anything else -> [].

    ``vtype`` may pass a precomputed ``schema_of_variant(value)`` column."""
    v = col(value)
    t = col(vtype) if vtype is not None else F.schema_of_variant(v)
    s = F.try_variant_get(v, "$", "string")
    arr = F.try_variant_get(v, "$", "array<variant>")
    from_list = F.filter(F.transform(arr, _item_text), lambda e: e.isNotNull())
    texts = F.filter(F.transform(F.try_variant_get(v, "$", "array<string>"), ustrip), lambda e: e != "")
    empty = F.array().cast("array<string>")
    return (F.when(v.isNull(), empty)
            .when(t == "STRING", F.when(is_blank(s), empty).otherwise(F.array(s)))
            .when(t == "ARRAY<STRING>", texts)  # no item to type one by one
            .when(t.startswith("ARRAY"), from_list)
            .otherwise(empty))


# ---------------------------------------------------------------- C5
def safe_float(value, lo: float, hi: float, default: float) -> Column:
    """Missing -> default; number, bool or numeric text -> float; anything else -> midpoint;
    then clamp to [lo, hi]."""
    v = col(value)
    t = F.schema_of_variant(v)
    mid = F.lit((lo + hi) / 2.0)
    s = F.try_variant_get(v, "$", "string")
    num = (F.when(v.isNull(), F.lit(float(default)))
           .when(t == "BOOLEAN", F.when(s == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
           .when(t.isin(*_INT_TYPES) | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                 F.try_variant_get(v, "$", "double"))
           .when(t == "STRING", F.coalesce(F.when(s.rlike(NUMBER), s.try_cast("double")), mid))
           .otherwise(mid))
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), num))


def verdict_text(value) -> Column:
    """Verdict field as lower-case stripped text; '' when missing or not a string."""
    v = col(value)
    s = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", ustrip(F.lower(s))).otherwise(F.lit(""))


# ---------------------------------------------------------------- C6 / C7 / C9
def penalty(h, f, lf, m, w: CriticWeights = DEFAULT_WEIGHTS) -> Column:
    """Sum of capped category penalties (issue counts in, points out)."""
    return (F.lit(0.0)
            + F.least(col(h) * F.lit(w.hallucination_penalty), F.lit(w.hallucination_cap))
            + F.least(col(f) * F.lit(w.factual_error_penalty), F.lit(w.factual_error_cap))
            + F.least(col(lf) * F.lit(w.logical_flaw_penalty), F.lit(w.logical_flaw_cap))
            + F.least(col(m) * F.lit(w.missing_concept_penalty), F.lit(w.missing_concept_cap)))


def apply_penalties(raw_score, h, f, lf, m, w: CriticWeights = DEFAULT_WEIGHTS) -> Column:
    """max(0, raw - penalty)."""
    return F.greatest(F.lit(0.0), col(raw_score) - penalty(h, f, lf, m, w))


def verdict_from_score(score) -> Column:
    """Score band."""
    s = col(score)
    out = F.lit("poor")
    for threshold, label in reversed(VERDICT_BANDS):
        out = F.when(s >= threshold, F.lit(label)).otherwise(out)
    return out


def verdict_rank(verdict) -> Column:
    """D3: poor..excellent -> 0..3, anything else -> 0."""
    m = F.create_map(*[x for i, v in enumerate(VERDICTS) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.element_at(m, col(verdict)), F.lit(0))


def normalize_verdict(verdict, score) -> Column:
    """Alias map; unknown -> band of the score; more than one tier from the band -> band."""
    aliases = F.create_map(*[F.lit(x) for kv in VERDICT_ALIASES.items() for x in kv])
    v = F.coalesce(F.element_at(aliases, col(verdict)), col(verdict))
    band = verdict_from_score(score)
    valid = v.isin(*VERDICTS)
    far = F.abs(verdict_rank(v) - verdict_rank(band)) > 1
    return F.when(~valid | v.isNull(), band).when(far, band).otherwise(v)


# ---------------------------------------------------------------- C3 / C8 / C10
def parse_feedback(df: DataFrame, raw: str = "raw_response", out: str = "feedback",
                   w: CriticWeights = DEFAULT_WEIGHTS) -> DataFrame:
    """Append a ``feedback`` struct parsed from the reply column.

    Unparseable or non-object JSON gives the C8 fallback. Verdict is derived from the unrounded
    penalised score; score is stored rounded to 2 places, confidence to 3."""
    keep = df.columns
    scalar = ["score", "confidence", "verdict"]
    # Stage 1: parse once. Stage 2: one variant column per field. Stage 3: coerce. Staging keeps
    # every generated method small (one fused projection exceeds the 64 KB JVM method limit).
    s1 = df.select(*keep, parse_reply(col(raw)).alias("__v"))
    s2 = s1.select(*keep, is_object("__v").alias("__ok"),
                   *[field("__v", n).alias(f"__f_{n}") for n in LIST_FIELDS + scalar])
    s2 = s2.select(*keep, "__ok", *[f"__f_{n}" for n in LIST_FIELDS + scalar],
                   *[F.schema_of_variant(f"__f_{n}").alias(f"__t_{n}") for n in LIST_FIELDS])
    s2 = s2.select(
        *keep, "__ok",
        *[safe_list(f"__f_{n}", f"__t_{n}").alias(f"__{n}") for n in LIST_FIELDS],
        safe_float("__f_score", 0.0, 10.0, 5.0).alias("__raw"),
        safe_float("__f_confidence", 0.0, 1.0, 0.5).alias("__conf"),
        verdict_text("__f_verdict").alias("__verdict"))
    pen = apply_penalties("__raw", F.size("__hallucinations"), F.size("__factual_errors"),
                          F.size("__logical_flaws"), F.size("__missing_concepts"), w)
    s3 = s2.withColumn("__pen", pen)
    parsed = F.struct(
        *[F.col(f"__{n}").alias(n) for n in LIST_FIELDS],
        py_round("__pen", 2).alias("score"),
        py_round("__raw", 2).alias("raw_llm_score"),
        py_round("__conf", 3).alias("confidence"),
        normalize_verdict("__verdict", "__pen").alias("verdict"),
        col(raw).alias("raw_response"),
        F.lit(True).alias("parse_ok"),
    )
    # ``parse_ok`` is also a top-level column: a filter on it is pushed down as the small
    # is_object(parse(raw)) test instead of through the whole feedback struct.
    # The struct is emitted through a one-element ``inline`` (a Generate node). A filter on the
    # parsed fields cannot be pushed below a Generate, so it is not rewritten into the parse
    # expressions (which would re-parse the reply once per referenced field).
    one = F.struct(F.when(F.col("__ok"), parsed).otherwise(fallback_feedback(raw)).alias(out),
                   F.col("__ok").alias("parse_ok"))
    return s3.select(*keep, F.inline(F.array(one)))


def fallback_feedback(raw) -> Column:
    """Empty lists, one canned action, score 3.0, confidence 0.2, verdict poor."""
    empty = F.array().cast("array<string>")
    return F.struct(
        empty.alias("factual_errors"), empty.alias("hallucinations"),
        empty.alias("missing_concepts"), empty.alias("logical_flaws"),
        F.array(F.lit(FALLBACK_ACTION)).alias("improvement_actions"),
        F.lit(FALLBACK_SCORE).alias("score"), F.lit(FALLBACK_SCORE).alias("raw_llm_score"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"), F.lit("poor").alias("verdict"),
        col(raw).alias("raw_response"), F.lit(False).alias("parse_ok"))


def has_hallucinations(fb="feedback") -> Column:
    return F.size(col(fb).getField("hallucinations")) > 0


def has_critical_issues(fb="feedback") -> Column:
    return has_hallucinations(fb) | (F.size(col(fb).getField("factual_errors")) > 0)


def total_issue_count(fb="feedback") -> Column:
    """Issues over four categories (improvement actions excluded)."""
    c = col(fb)
    return (F.size(c.getField("factual_errors")) + F.size(c.getField("hallucinations"))
            + F.size(c.getField("logical_flaws")) + F.size(c.getField("missing_concepts")))


# ---------------------------------------------------------------- F1 / F2
def quality_met(fb="feedback", cfg: LoopConfig = DEFAULT_LOOP) -> Column:
    """F1: no hallucination, no factual error, score >= min and verdict good/excellent."""
    c = col(fb)
    return (~has_critical_issues(fb) & (c.getField("score") >= F.lit(cfg.min_quality_score))
            & c.getField("verdict").isin("good", "excellent"))


def needs_grounding(fb="feedback", enabled: bool = True) -> Column:
    """evidence is fetched only for hallucinations or factual errors, and only if enabled."""
    return has_critical_issues(fb) & F.lit(bool(enabled))


# ---------------------------------------------------------------- C12 / C13
def _num_or_null(v: Column, t: Column) -> Column:
    s = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull(), F.lit(5.0))
            .when(t == "BOOLEAN", F.when(s == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(t.isin(*_INT_TYPES) | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                  F.try_variant_get(v, "$", "double"))
            .when(t == "STRING", F.when(s.rlike(NUMBER), s.try_cast("double"))))


def _truthy(v: Column, t: Column) -> Column:
    s = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", s == "true")
            .when(t == "STRING", F.length(s) > 0)
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.coalesce(F.length(s) > 2, F.lit(False)))
            .otherwise(F.try_variant_get(v, "$", "double") != 0))


def parse_judge(df: DataFrame, raw: str = "raw_response", out: str = "judge") -> DataFrame:
    """Judge reply -> struct(factual_accuracy DOUBLE, hallucinations_detected BOOLEAN,
    parse_ok BOOLEAN). Fences stripped, first '{...}' parsed; a missing score is 5.0, a score
    that is not a number (or unparseable JSON) gives the fallback (5.0, false). The flag follows
    Python truthiness (non-empty string or list, non-zero number, true). Parsed once, in stages."""
    keep = df.columns
    m = F.regexp_extract(strip_fences(col(raw)), JSON_OBJECT, 0)
    s1 = df.select(*keep, F.try_parse_json(F.nullif(m, F.lit(""))).alias("__jv"))
    s2 = s1.select(*keep, is_object("__jv").alias("__jok"),
                   F.try_variant_get("__jv", "$.factual_accuracy_score", "variant").alias("__js"),
                   F.try_variant_get("__jv", "$.hallucinations_detected", "variant").alias("__jh"))
    s3 = s2.select(*keep, "__jok", "__js", "__jh", F.schema_of_variant("__js").alias("__jst"),
                   F.schema_of_variant("__jh").alias("__jht"))
    s4 = s3.select(*keep, "__jok", _num_or_null(F.col("__js"), F.col("__jst")).alias("__jn"),
                   _truthy(F.col("__jh"), F.col("__jht")).alias("__jt"))
    ok = F.col("__jok") & F.col("__jn").isNotNull()
    return s4.select(*keep, F.struct(
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("__jn")))).otherwise(F.lit(5.0))
        .alias("factual_accuracy"),
        F.when(ok, F.col("__jt")).otherwise(F.lit(False)).alias("hallucinations_detected"),
        ok.alias("parse_ok")).alias(out))


def critique_json_or_raw(raw_text) -> Column:
    """Fine-tuned critic output -> VARIANT: the first '{...}' block parsed, else
    ``{"raw": text}`` (text stripped)."""
    t = ustrip(raw_text)
    m = F.regexp_extract(t, JSON_OBJECT, 0)
    parsed = F.try_parse_json(F.nullif(m, F.lit("")))
    return F.coalesce(parsed, F.to_variant_object(F.struct(t.alias("raw"))))


# ---------------------------------------------------------------- C11
def issues_long(df: DataFrame, key_cols: list[str], fb: str = "feedback") -> DataFrame:
    """C11: one row per issue with category, 1-based position and display marker.

    ``explode`` of a per-row array keeps the work inside the task that holds the row."""
    c = F.col(fb)
    def tag(name: str, marker: str):
        return lambda x, i: F.struct(F.lit(name).alias("category"), (i + 1).alias("position"),
                                     F.lit(marker).alias("marker"), x.alias("item"))

    per_cat = [F.transform(c.getField(name), tag(name, marker)) for name, marker in ISSUE_MARKERS]
    out = df.select(*key_cols, F.explode(F.concat(*per_cat)).alias("__i"))
    return out.select(*key_cols, "__i.category", "__i.position", "__i.marker", "__i.item")
