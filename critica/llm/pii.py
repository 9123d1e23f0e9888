"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the validated base matches (score 1 for their kind). A lexical pattern is the two words
before an entity, lower-cased, digits as 0. Candidates are, outside all base spans, identifier-shaped tokens
and runs of digit groups written with spaces. A token inside a run is not counted as a further instance of its
pattern, and gives way where both become spans. Patterns and instances form a bipartite graph, scored in ``rounds`` rounds:

* confidence of a pattern for a kind = sum of its instances' scores / (distinct instances + 1), where
  a pattern needs ``min_support`` distinct seed instances of that kind;
* score of an unseen instance for a kind = 1 - product of (1 - confidence) over its patterns.

An occurrence becomes a span of the kind if its instance's score reaches ``min_score``, its own
pattern's confidence reaches ``min_score`` too, and it has the least form of the kind (an email
an ``@``, an ip three dots, a card 12 and a phone 7 digits).

The graph is pre-aggregated to distinct (pattern, instance) edges before any join, so a frequent
word pair is one row per instance. Null text counts as empty; a document without any match keeps
its row; repeated rows get equal results. Very long texts are searched whole; contexts are at most ``CONTEXT`` characters.
Only doc_id and text are read, so other columns cannot clash; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critica.llm.common import let, stored
from critica.llm.spans import Kind, count, digest, located

# The four base kinds. Lookbehinds and \G only skip starts that cannot match.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
# Tokens that may be identifiers, and the least form of each kind.
RUN = Kind("run", r"(?<![^\x20\x09-\x0D])[(\[]?+[0-9]++(?:(?:[.-]|\x20-\x20|[()\[\]][\x20-]?+|\x20[(\[]?+)[0-9]++(?![A-Za-z_@]))++",
           r"[0-9][)\]]?\x20")
CANDIDATE = Kind("candidate", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", "[0-9@]")
FORM = [r".@.", r"[0-9]\D+[0-9]+\D+[0-9]+\D+[0-9]", r"([0-9]\D?){12}", r"([0-9]\D?){7}"]
CONTEXT = 48
MIN_SUPPORT = 5
MIN_SCORE = 0.8
ROUNDS = 2


def luhn(digits: Column) -> Column:
    """Luhn's test. Every second digit from the right counts double, less 9 above 9."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(chars, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def base_valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    part_fits = F.regexp_replace("match", r"(?<![0-9])0+(?=[0-9])", "")
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (F.when(F.col("kind") == 0, F.lit(True))
            .when(F.col("kind") == 1, part_fits.rlike(rf"^{octet}(\.{octet}){{3}}$"))
            .when(F.col("kind") == 2, F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False)))
            .otherwise(F.length(digits).between(8, 15)))


def pattern() -> Column:
    """The last two words before the entity, lower-cased, digits as 0; null without two words."""
    last = F.regexp_extract("before", r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    return F.when(last != "", F.regexp_replace(F.regexp_replace(F.lower(last), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def occurrences(docs: DataFrame) -> DataFrame:
    """Stored: valid base matches and the candidates outside them, with their patterns."""
    found = located(docs.select("doc_id", "text"), [*KINDS, RUN, CANDIDATE], CONTEXT)
    base, run, token = F.col("kind") < len(KINDS), F.col("kind") == len(KINDS), F.col("kind") > len(KINDS)
    found = found.withColumn("kind", F.when(token | F.when(run, F.contains("match", F.lit(" "))).otherwise(base_valid()), F.col("kind")))  # failed matches keep their document
    by_start = Window.partitionBy("uid").orderBy("start", "kind")
    found = found.withColumns({
        "base_end": F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "base_start": F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    outside = (F.coalesce(F.col("base_end"), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.col("base_start"), F.col("end")) >= F.col("end"))
    found = found.withColumn("kind", F.when(base | outside, F.col("kind")))
    found = found.withColumn("inner", token & (F.coalesce(F.max(F.when(run, F.col("end"))).over(
        by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) > F.col("start")))
    instance = F.when(run | token, F.regexp_replace("match", r"^[(\[{<\"']+|[)\]}>\"'.,;:!?]+$", "")).otherwise(F.col("match"))
    return stored(found.select("uid", "doc_id", "kind", "start", "end", "inner", instance.alias("instance"),
                               pattern().alias("pattern")), "occurrences")


def confidences(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """((pattern, of_kind, confidence), (instance, of_kind, score)) after the last round."""
    edges = stored(found.filter("kind is not null and pattern is not null").groupBy("pattern", "instance").agg(
        F.min(F.when(F.col("kind") < len(KINDS), F.col("kind"))).alias("seed"), F.min("inner").alias("inner")), "edges")
    sizes = edges.filter("not inner").groupBy("pattern").agg(F.count("*").alias("n"))
    support = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("of_kind")).agg(
        F.count("*").alias("support")).filter(F.col("support") >= min_support)
    patterns = support.join(sizes, "pattern")
    open_edges = edges.filter("seed is null").select("pattern", "instance", "inner")
    confident = patterns.select("pattern", "of_kind", (F.col("support") / (F.col("n") + 1)).alias("confidence"))
    for _ in range(rounds):
        confident = stored(confident, "patterns")
        scores = (open_edges.join(confident, "pattern").groupBy("instance", "of_kind")
                  .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")))
        scores = stored(scores, "scores")
        gained = open_edges.filter("not inner").join(scores, "instance").groupBy("pattern", "of_kind").agg(F.sum("score").alias("gain"))
        confident = patterns.join(gained, ["pattern", "of_kind"], "left").select(
            "pattern", "of_kind", ((F.col("support") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1)).alias("confidence"))
    return confident, scores


def extract(docs: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document (uid, doc_id) with ``spans``: array of (kind, start, end, name, base), ordered."""
    found = occurrences(docs)
    patterns, scores = confidences(found, rounds, min_support)
    token = found.filter(F.col("kind") >= len(KINDS)).withColumn("run", F.col("kind") == len(KINDS)).drop("kind")
    shape = F.when(F.col("run"), F.regexp_replace("instance", "[^0-9]+", "-")).otherwise(F.col("instance"))
    form = F.element_at(F.array(*[shape.rlike(f) for f in FORM]), F.col("of_kind") + 1)
    by_start = Window.partitionBy("uid").orderBy("start", ~F.col("run")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = (token.join(patterns.filter(F.col("confidence") >= min_score), "pattern")
           .join(scores.filter(F.col("score") >= min_score), ["instance", "of_kind"]).filter(form)
           .groupBy("uid", "doc_id", "start", "end", "run").agg(F.max(F.struct("score", -F.col("of_kind"))).alias("best"))
           .withColumn("run_end", F.max(F.when(F.col("run"), F.col("end"))).over(by_start))
           .filter(F.col("run") | F.coalesce(F.col("run_end") <= F.col("start"), F.lit(True)))
           .select("uid", "doc_id", (-F.col("best").getField("col2")).alias("kind"), "start", "end", F.lit(False).alias("base")))
    rows = (found.filter(F.col("kind").isNull() | (F.col("kind") < len(KINDS)))
            .select("uid", "doc_id", "kind", "start", "end", F.lit(True).alias("base"))
            .unionByName(found.groupBy("uid", "doc_id").agg(
                F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"),
                F.lit(None).cast("long").alias("end"), F.lit(True).alias("base")))
            .unionByName(new))
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", name.alias("name"), "base"))
    return rows.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def op3(docs: DataFrame) -> DataFrame:
    out = extract(docs)
    base = F.filter("spans", lambda s: s["base"])
    return out.select(
        "doc_id", *[count(base, n).alias(f"n_{k.name}") for n, k in enumerate(KINDS)],
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
