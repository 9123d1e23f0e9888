"""Words told apart inside the tasks are those of M1; F3 carries on only the columns asked for."""

from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from critica.functions import prompts as pr
from critica.functions.text import tokens
from critica.operators import learned as lc

ODD = ["", " ", "plain Words, with_some 12 3x", "Straße É—è “quoted” …", "日本、東京", "٣٤ ½ ²", "İstanbul ΑΣ ǅ", "é combining", "\u0085x y　z",
       "� a�b", "😀a😀b 𝒳𝟘", "_ __ -a- ", "\x00a\x1fb\x7fc", "ª º ʰ 々 ـ", "‍zero‌width"]


def test_words_are_those_of_the_split(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in [None, *ODD] for b in [None, *ODD])]
    df = spark.createDataFrame(rows, "id int, query string, answer string").coalesce(2)
    text = pr.pair_text(F.coalesce("query", F.lit("")), F.coalesce("answer", F.lit("")))
    got = df.select("id", tokens(text).alias("w"), lc.pair_line().alias("line")).orderBy("id").collect()
    for size in (1, 200, 1 << 23):
        lc.BYTES_AT_ONCE, before = size, lc.BYTES_AT_ONCE
        try:
            row, feature, n = lc._Hasher(10_007).counts(pa.array([r["line"] for r in got]))
        finally:
            lc.BYTES_AT_ONCE = before
        want = Counter((i, int(md5(w.encode() + b"|1").hexdigest()[:8], 16) % 10_007) for i, r in enumerate(got) for w in r["w"])
        assert dict(zip(zip(row.tolist(), feature.tolist()), n.tolist())) == want
        assert list(zip(row.tolist(), feature.tolist())) == sorted(want)


def test_no_texts_no_words():
    for texts in (pa.array([], pa.string()), pa.array(["", ""]), pa.array([" ", "--"])):
        assert [len(x) for x in lc._Hasher(97).counts(texts)] == [0, 0, 0]


def test_words_do_not_leave_the_engine_one_by_one(spark, capsys):
    df = spark.createDataFrame([(1, "q", "a")], "id int, query string, answer string")
    lc.word_counts(df, ["id"], 97).explain()
    assert "split(" not in capsys.readouterr().out


def test_routed_rows_have_the_columns_asked_for(spark):
    df = spark.createDataFrame([(1, "long text", 9.0), (2, "long text", 3.0)], "id int, answer string, s double")
    fast = df.select("id", "answer", F.struct(F.col("s").alias("score")).alias("feedback"))
    slow = lambda rows: rows.select("id", F.struct(F.lit(5.0).alias("score")).alias("feedback"))
    out = lc.route_hybrid(fast, slow, columns=["id", "feedback"])
    assert out.columns == ["id", "feedback", "route"]
    assert sorted((r["id"], r["feedback"]["score"], r["route"]) for r in out.collect()) == [(1, 9.0, "fast"), (2, 5.0, "slow")]
    assert lc.route_hybrid(fast, slow, has_fallback=False).columns == ["id", "answer", "feedback", "route"]


def test_gradients_of_some_rows_at_a_time(monkeypatch):
    rng, n, net = np.random.default_rng(2), 300, lc._Net(64, 3)
    sizes = rng.integers(0, 9, n)
    sizes[[0, 1, 7, -1]] = 0  # rows without a known word
    at = np.append(0, np.cumsum(sizes))
    index, value = rng.integers(0, 64, at[-1]).astype(np.int32), rng.random(at[-1])
    rest = rng.integers(0, 4, n), rng.random(n) * 10, rng.integers(0, 3, n), (1.0, 0.5)
    whole = net.batch(index.astype(np.int64), value, at[:-1], *rest)
    for size in (1, 20, 1 << 17):
        monkeypatch.setattr(lc, "ENTRIES_AT_ONCE", size)
        assert np.allclose(net.batches(index, value, at, *rest), whole, rtol=1e-12, atol=1e-9)
