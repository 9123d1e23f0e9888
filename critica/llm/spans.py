"""Positions of regular-expression matches, in DataFrame functions only.

``regexp_extract_all`` gives the matches, ``split`` by the same pattern the gaps between them;
running sums of their lengths give code-point positions. Matches leave their document's row as
short entries, so one document with very many matches is no large row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critica.llm.common import let


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str        # possessive: the same matches, without backtracking or deep recursion
    hint: str           # a cheap test that any match's text passes


def entries(text: Column, kinds: list[Kind], context: int = 0) -> Column:
    """array<struct<kind, i, gap, match, before>>: ``before`` is the text before the match, up to ``context`` characters.

    It is put together from the gap and the pieces (gap and match) before it; a piece after the first must have two
    characters or more."""
    n_pieces = -(-context // 2)

    def with_pieces(found: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            pieces = F.transform(F.slice(found, F.greatest(i - n_pieces, F.lit(0)) + 1, F.least(i, F.lit(n_pieces))),
                                 lambda y: F.concat(y["before"], F.right(y["match"], F.lit(context))))
            whole = F.concat(F.array_join(pieces, ""), x["before"])
            return F.when(F.length(x["before"]) < context, F.right(whole, F.lit(context))).otherwise(x["before"])

        return F.transform(found, lambda x, i: F.struct(
            x["kind"].alias("kind"), x["gap"].alias("gap"), x["match"].alias("match"), before(x, i).alias("before")))

    def of(number: int, kind: Kind) -> Column:
        found = F.zip_with(
            F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
            lambda gap, m: F.struct(F.lit(number).alias("kind"), F.length(gap).alias("gap"), m.alias("match"),
                                    F.right(gap, F.lit(context)).alias("before")))
        if context:
            found = let(found, with_pieces)
        none = F.array().cast("array<struct<kind:int,gap:int,match:string,before:string>>")
        return F.when(text.rlike(kind.hint), F.filter(found, lambda x: x["match"].isNotNull())).otherwise(none)

    each = [F.transform(of(n, k), lambda x, i: F.struct(
        x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["match"].alias("match"),
        x["before"].alias("before"))) for n, k in enumerate(kinds)]
    return F.concat(*each)


def located(docs: DataFrame, kinds: list[Kind], context: int = 0) -> DataFrame:
    """One row per match (uid, doc_id, kind, match, before, start, end), and one row with a null kind for
    each document without any. ``uid`` numbers the rows of ``docs``; store the result before using it twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = (docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", entries(text, kinds, context).alias("e"))
            .select("uid", "doc_id", F.explode_outer("e").alias("e"))
            .select("uid", "doc_id", "e.kind", "e.i", "e.gap", "e.match", "e.before"))
    so_far = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (flat.withColumn("end", F.sum(F.col("gap").cast("long") + F.length("match")).over(so_far))
            .select("uid", "doc_id", "kind", "match", "before",
                    (F.col("end") - F.length("match")).alias("start"), "end"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an ordered array of (…, name, start, end)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def count(spans: Column, kind: int) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
