"""Not-modified revisits resolved to the responses they stand for.

Each revisit record (a 304 answer) is joined as of its time to the latest strictly earlier full response
of the same canonical URL. Its validators are then checked against that response (ETag by weak
comparison; without one, Last-Modified), and the headers that a 304 may update are merged.

The as-of join is two window passes that never gather one URL in one task: time is cut into ``slices``
of equal depth, the first pass finds the latest response inside a (URL, slice), the second carries
the last response of each slice to later ones and sees one row per (URL, slice).

Result per revisit: ``status`` is ``resolved``, ``validator_mismatch``, ``unverified`` (no validator on one of
the sides) or ``no_earlier``; the response's id and payload digest; merged headers where resolved.
Null URL or time: ``no_earlier``. Responses of one URL and time: the greatest record_id counts. Repeated
records give repeated rows. Null headers count as none; header names are compared in lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 does not update, since they describe the stored payload or one connection.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
ROWS_PER_SLICE = 50_000
MAX_SLICES = 256


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.`` or ``m.``, default port, fragment, tracking parameters and closing slash removed; host in lower case.

    Only whole parameters of the query string count as tracking ones: ``xref=`` and a path that holds ``ref=`` stay."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)[.]|:(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: ~p.rlike("^(utm_[a-z]+|ref)=")), "&")
    return F.concat(host, F.regexp_replace(F.concat(path, F.lit("?"), kept), "[?&/]+$", ""))


def lowered(headers: Column) -> Column:
    """Header names in lower case; the first of repeated names counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))


def header(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def header_lines(entries: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def time_slices(records: DataFrame, rows_per_slice: int, max_slices: int) -> Column:
    """The number of a row's time slice: slices of equal depth, as many as the table's rows ask for."""
    n = records.count()
    slices = min(max_slices, -(-n // rows_per_slice))
    if slices <= 1:
        return F.lit(0)
    cuts = records.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)])).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col("ts")))


def resolve(records: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, max_slices: int = MAX_SLICES) -> DataFrame:
    """``records``: record_id long, url string, ts long, kind string (``response`` or ``revisit``),
    headers map<string,string>, payload_digest string. One row per revisit."""
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind",
        lowered(F.col("headers")).alias("headers"), "payload_digest")
    rows = rows.withColumn("slice", time_slices(records, rows_per_slice, max_slices))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers", "payload_digest"))
    earlier = Window.partitionBy("canonical_url", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.max(full).over(earlier))
    ends = rows.filter("kind = 'response'").groupBy("canonical_url", "slice").agg(F.max(full).alias("last"))
    # a slice's rows need the last response of any slice before it
    marks = (ends.select("canonical_url", "slice", "last").unionByName(
        rows.filter("kind = 'revisit'").select("canonical_url", "slice").distinct().withColumn("last", F.lit(None).cast(
            ends.schema["last"].dataType))).groupBy("canonical_url", "slice").agg(F.max("last").alias("last")))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("canonical_url", "slice", F.max("last").over(before).alias("carried"))
    joined = inside.filter("kind = 'revisit'").join(carried, ["canonical_url", "slice"], "left")
    found = joined.withColumn("r", F.when(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(),
                                          F.coalesce("inside", "carried")))
    etag, modified = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    r_etag, r_modified = header(F.col("r.headers"), "etag"), header(F.col("r.headers"), "last-modified")
    weak = lambda e: F.regexp_replace(e, "^W/", "")
    status = (F.when(F.col("r").isNull(), "no_earlier")
              .when(etag.isNotNull() & r_etag.isNotNull(), F.when(weak(etag) == weak(r_etag), "resolved").otherwise("validator_mismatch"))
              .when(etag.isNull() & modified.isNotNull() & r_modified.isNotNull(),
                    F.when(modified == r_modified, "resolved").otherwise("validator_mismatch"))
              .otherwise("unverified"))
    updates = F.filter("headers", lambda e: ~e["key"].isin(NOT_MERGED))
    stayed = F.filter("r.headers", lambda e: ~F.array_contains(F.transform(updates, lambda u: u["key"]), e["key"]))
    return found.withColumn("status", status).select(
        "record_id", "canonical_url", "ts", "status", F.col("r.record_id").alias("response_id"),
        F.when(F.col("status") == "resolved", F.col("r.payload_digest")).alias("payload_digest"),
        F.when(F.col("status") == "resolved", header_lines(F.concat(updates, stayed))).alias("merged_headers"))


# Captures derived from ``pages``; Spark and DuckDB run the same text. Four captures a page: a response (a
# revisit for every 11th page), a revisit, for every fourth page a changed response (else a revisit), a revisit.
CAPTURES_SQL = r"""
SELECT page_id * 4 + c AS record_id, url,
       CAST(1700000000 + (page_id * 7919 % 100000) * 60 + c * 3600 * (1 + page_id % 5) AS BIGINT) AS ts,
       CASE WHEN (c = 0 AND page_id % 11 <> 0) OR (c = 2 AND page_id % 4 = 1) THEN 'response' ELSE 'revisit' END AS kind,
       CASE WHEN c = 2 AND page_id % 4 = 1 THEN concat('"', substr(v2, 1, 16), '"')
            WHEN c = 0 AND page_id % 11 <> 0 THEN concat('W/"', substr(v1, 1, 16), '"')
            WHEN page_id % 6 = 0 THEN '"stale"' WHEN page_id % 6 IN (1, 2) THEN NULL
            WHEN c = 3 AND page_id % 3 <> 0 AND page_id % 4 = 1 THEN concat('"', substr(v2, 1, 16), '"')
            ELSE concat('"', substr(v1, 1, 16), '"') END AS etag,
       CASE WHEN page_id % 6 = 2 THEN NULL ELSE concat('day ', CAST(page_id % 365 AS VARCHAR(9))) END AS modified,
       concat('capture ', CAST(c AS VARCHAR(9))) AS served, CAST(c * 100 AS VARCHAR(9)) AS length,
       CASE WHEN c = 2 THEN v2 ELSE v1 END AS digest
FROM (SELECT page_id, url, md5(coalesce(html, '')) AS v1, md5(concat(coalesce(html, ''), '2')) AS v2, c
      FROM pages CROSS_CAPTURES)
"""


def captures(pages: DataFrame) -> DataFrame:
    """The derived WARC records of ``pages``."""
    view = "warc_pages"
    pages.select("page_id", "url", "html").createOrReplaceTempView(view)
    rows = pages.sparkSession.sql(CAPTURES_SQL.replace(
        "pages CROSS_CAPTURES", f"{view} LATERAL VIEW explode(array(0, 1, 2, 3)) AS c"))
    entries = F.map_filter(F.create_map(
        F.lit("ETag"), "etag", F.lit("Last-Modified"), "modified", F.lit("X-Served-By"), "served",
        F.lit("Content-Length"), "length"), lambda k, v: v.isNotNull())
    return rows.select("record_id", "url", "ts", "kind", entries.alias("headers"), F.col("digest").alias("payload_digest"))


def op2(pages: DataFrame) -> DataFrame:
    return resolve(captures(pages))
