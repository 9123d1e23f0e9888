"""The registered queries of this subpackage: opN_<name> over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from critica.llm import prefix_trie, warc
from critica.llm.bpe import op12
from critica.llm.common import table
from critica.llm.decontaminate import op5
from critica.llm.line_dedup import op9
from critica.llm.lm_score import op10
from critica.llm.near_dup import op4
from critica.llm.packing import op1
from critica.llm.periodic import op11
from critica.llm.pii import op3
from critica.llm.quality import op6
from critica.llm.secret_scan import op8

from critica.llm.substring_dedup import op7


def _docs(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def queries():
    return {"op1_best_fit_packing": _docs(op1), 
            "op2_warc_revisits": lambda spark, sf_dir: warc.op2(table(spark, sf_dir, "pages")), "op3_pii_bootstrap": _docs(op3), 
            "op4_near_dup": _docs(op4),
            "op5_decontaminate": lambda spark, sf_dir: op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
            "op6_quality_rules": _docs(op6), "op7_substring_dedup": _docs(op7),
            "op8_secret_scan": _docs(op8), "op9_line_dedup": _docs(op9), "op10_lm_score": _docs(op10),
            "op11_periodic_runs": _docs(op11), "op12_bpe_codec": _docs(op12),
            "op13_prefix_trie": lambda spark, sf_dir: prefix_trie.op13(table(spark, sf_dir, "conversations"))}


def oracle_sql():
    return {"op2_warc_revisits": OP2_SQL, "op4_near_dup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_quality_rules": OP6_SQL,
            "op9_line_dedup": OP9_SQL, "op13_prefix_trie": OP13_SQL}


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM s),
k AS (SELECT r, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, string_agg(line, chr(10) ORDER BY n) AS kept, count(*) AS n_kept
      FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY r)
SELECT s.doc_id, CAST(len(s.ls) AS BIGINT) AS n_lines,
       CAST(len(s.ls) - coalesce(g.n_kept, 0) AS BIGINT) AS n_dropped, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM s LEFT JOIN g USING (r)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [w FOR w IN string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.y, r.c FROM r JOIN g ON g.x = r.doc_id AND r.c < g.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

OP2_SQL = "WITH c AS (" + warc.CAPTURES_SQL.replace(
    "pages CROSS_CAPTURES", "pages, (SELECT unnest([0, 1, 2, 3]) AS c)") + r"""),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
k AS (SELECT *, concat(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(www|m)[.]|:(80|443)$', '', 'g'),
      rtrim(regexp_extract(bare, '^[^/?]*([^?]*)', 1) || '?' || array_to_string([x FOR x IN string_split(
        CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END, '&')
        IF NOT (starts_with(x, 'ref=') OR regexp_matches(x, '^utm_[a-z]+='))], '&'), '?&/')) AS canonical_url FROM u),
p AS (SELECT canonical_url AS pu, ts AS pt, max(record_id) AS pid FROM k WHERE kind = 'response' GROUP BY 1, 2),
q AS (SELECT p.*, k.etag AS pe, k.modified AS pm, k.served AS ps, k.length AS pl, k.digest AS pd
      FROM p JOIN k ON k.record_id = p.pid),
j AS (SELECT * FROM (SELECT * FROM k WHERE kind = 'revisit') r ASOF LEFT JOIN q ON r.canonical_url = q.pu AND r.ts > q.pt),
t AS (SELECT *, CASE WHEN pid IS NULL THEN 'no_earlier'
      WHEN etag IS NOT NULL AND pe IS NOT NULL THEN
        CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(pe, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN etag IS NULL AND modified IS NOT NULL AND pm IS NOT NULL THEN
        CASE WHEN modified = pm THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'unverified' END AS status FROM j)
SELECT record_id, canonical_url, ts, status, pid AS response_id,
       CASE WHEN status = 'resolved' THEN pd END AS payload_digest,
       CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'content-length: ' || pl, 'etag: ' || coalesce(etag, pe),
         'last-modified: ' || coalesce(modified, pm), 'x-served-by: ' || coalesce(served, ps)) END AS merged_headers
FROM t
"""

# 13 words with two substitutions hold a run of 4 equal words: runs of 4 give every alignment to look at. (The
# given items have 13 words or more.)
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [w FOR w IN string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS ws
      FROM documents),
b AS (SELECT item_id, [w FOR w IN string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS ws
      FROM benchmark),
dg AS (SELECT r, i, array_to_string(ws[i + 1:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 3)) AS i FROM d)),
bg AS (SELECT item_id, j, array_to_string(ws[j + 1:j + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(0, len(ws) - 3)) AS j FROM b)),
al AS (SELECT DISTINCT r, item_id, i - j AS s FROM dg JOIN bg USING (g)),
eq AS (SELECT al.r, al.item_id, s, j, CASE WHEN s + j >= 0 AND d.ws[s + j + 1] = b.ws[j + 1] THEN 1 ELSE 0 END AS e, len(b.ws) AS n
       FROM al JOIN d USING (r) JOIN b USING (item_id), unnest(range(0, len(b.ws))) AS t(j)),
wn AS (SELECT r, item_id, n, j, sum(e) OVER (PARTITION BY r, item_id, s ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS m FROM eq),
hit AS (SELECT r, item_id, max(m) / 13 AS a FROM wn WHERE j + 13 <= n GROUP BY r, item_id HAVING max(m) >= 11),
best AS (SELECT r, count(*) AS n_items, max(a) AS a, arg_min(item_id, (-a, item_id)) AS item FROM hit GROUP BY r)
SELECT doc_id, best.r IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item AS best_item, a AS best_agreement
FROM d LEFT JOIN best USING (r)
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
        string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 4)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
l AS (SELECT r, unnest(ls) AS line FROM w),
lw AS (SELECT r, line, [x FOR x IN string_split_regex(line, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM l),
lc AS (SELECT r, line, len(ws) AS n, len([x FOR x IN ws IF regexp_full_match(x, '[|»›•·>]+')]) AS sep,
        len([x FOR x IN ws IF suffix(x, '!!')]) AS shout,
        length(line) - length(translate(line, '#*$%&|<>', '')) AS sym FROM lw),
lf AS (SELECT *, n > 0 AND ((sep >= 2 AND sep * 5 > n) OR (sym >= 3 AND sym * 3 > n) OR (shout >= 3 AND shout * 3 > n)
        OR regexp_matches(line, '(?i)(accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|sign in to|log in to|subscribe to our newsletter|click here)')
        OR (n >= 25 AND NOT regexp_matches(line, '[.!?…。！？]'))) AS fails FROM lc),
ag AS (SELECT r, sum(CASE WHEN fails THEN 0 ELSE n END) AS kept_words, count(*) FILTER (WHERE n > 0) AS full_lines,
        count(DISTINCT line) FILTER (WHERE n > 0) AS different FROM lf GROUP BY r),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(full_lines - different AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(kept_words AS BIGINT) AS n_words_kept FROM w JOIN ag USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (n_words - n_words_kept) <= n_words * 0.5 AS kept FROM c
"""

# CRC-32 by its definition: the reflected polynomial 0xEDB88320, a bit at a time.
OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS b,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, k) - 1 AS p FROM t),
h AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
        lambda a, v: list_reduce(list_prepend(xor(a, v), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT h.c, p, k, b FROM h JOIN p ON p.c = h.c - h.c % 5 AND p < h UNION ALL SELECT h.c, p, k, b FROM h JOIN p USING (c) WHERE p >= h),
q AS (SELECT h.c, coalesce(list(k ORDER BY p) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(b ORDER BY p) FILTER (k IS NOT NULL), []) AS bs
      FROM h LEFT JOIN u USING (c) GROUP BY h.c),
m AS (SELECT c, ks, bs, unnest(range(0, len(ks) + 1)) AS d FROM q),
n AS (SELECT array_to_string(ks[1:d], ' ') AS node, any_value(array_to_string(ks[1:d - 1], ' ')) AS up, any_value(ks[1:d]) AS ks, any_value(d) AS d, min(c) AS c,
        count(*) AS convs, any_value(CASE WHEN d > 0 THEN bs[d] ELSE 0 END) AS b,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ks) = d), '')) AS ends FROM m GROUP BY node, d = 0),
k AS (SELECT up, count(*) AS kids FROM n WHERE d > 0 GROUP BY up),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.up = n.node),
a AS (SELECT array_to_string(ks[1:e], ' ') AS node, count(*) FILTER (kids = 0) AS leaves, sum((convs - 1) * b) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, g.c AS parent_conv_id, f.convs AS n_convs, f.kids AS n_children, a.leaves AS n_leaves,
  CAST(a.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN a USING (node) LEFT JOIN n g ON g.node = f.up AND f.d > 0
"""
