"""Answer metrics and HTML cleaning against a plain-Python restatement of the same rules."""

import math
import re

import pytest

from critica.functions.html import html_to_text, truncate_text
from critica.operators.metrics import evaluate_answer


def py_round(x, d):
    s = 10.0 ** d
    return math.floor(x * s + 0.5) / s


def py_metrics(answer, query):
    words = re.findall(r"\b\w+\b", answer.lower())
    sents = [s for s in re.split(r"[.!?]+", answer) if s.strip()]
    wc, sc = len(words), max(len(sents), 1)
    pats = [r"^\s*[-*•]\s", r"^\s*\d+[.)]\s", r"^#+\s", r"\*\*.+?\*\*"]
    st = 1.0 if any(re.search(p, answer, re.MULTILINE) for p in pats) else 0.0
    asl = wc / sc
    lex = len(set(words)) / len(words) if words else 0.0
    if not query:
        cov = 0.5
    else:
        kw = set(re.findall(r"\b\w{4,}\b", query.lower()))
        cov = len(kw & set(words)) / len(kw) if kw else 0.5
    length = min(wc / 300, 1.0)
    if wc < 30:
        length *= wc / 30
    density = 1.0 - min(abs(asl - 15) / 15, 1.0)
    comp = (0.25 * length + 0.25 * lex + 0.30 * cov + 0.20 * st) * density * 10
    return dict(char_count=len(answer), word_count=wc, sentence_count=sc, has_structure=st,
                avg_sentence_length=py_round(asl, 2), lexical_diversity=py_round(lex, 3),
                coverage_score=py_round(cov, 3), composite_score=py_round(py_round(comp, 2), 2))


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def words(n):
    return " ".join(WORDS[i % len(WORDS)] + str(i // len(WORDS)) for i in range(n)) + "."


ROWS = [
    ("- first point\n- second point", "points please"),
    ("Intro\n1. one thing\n2) another", "things"),
    ("# Header\nbody text here", "header text"),
    ("this is **bold** text", None),
    ("plain text without markers. Another sentence!", "plain markers"),
    ("", "empty answer"),
    (words(29), "alpha0 beta0"),
    (words(30), "alpha0 gamma9"),
    (words(300), "delta epsilon"),
    (words(301), "zeta2 theta3"),
    ("Ünïcödé wörds and ñ letters. Straße!", "wörds straße"),
    ("short answer", "a an to of"),
    ("  \t indented\n   * star bullet", ""),
]


@pytest.fixture(scope="module")
def computed(spark):
    df = spark.createDataFrame([(i, a, q) for i, (a, q) in enumerate(ROWS)],
                               "id int, answer string, query string")
    return {r["id"]: r for r in evaluate_answer(df).collect()}


@pytest.mark.parametrize("i", range(len(ROWS)))
def test_metrics_match_python(computed, i):
    exp = py_metrics(*ROWS[i])
    got = computed[i]
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-9), (k, ROWS[i])
    assert 0.0 <= got["composite_score"] <= 10.0


def py_strip_html(html):
    html = re.sub(r"<(script|style)[^>]*>.*?</(script|style)>", " ", html, flags=re.DOTALL | re.IGNORECASE)
    html = re.sub(r"<[^>]+>", " ", html)
    for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]:
        html = html.replace(a, b)
    return re.sub(r"\s+", " ", html).strip()


def py_truncate(t, n=1800):
    t = t.strip()
    return t[:n] + "\n[... truncated ...]" if len(t) > n else t


PAGES = [
    "<html><SCRIPT type='x'>var a = '<p>';</SCRIPT><p>Hello&amp;lt;world&gt;</p></html>",
    "<style>p{}</style><div>a&nbsp;b &quot;c&quot; &#39;d&#39;</div>\n\n<b>bold</b>",
    "<p>" + "x" * 1800 + "</p>",
    "<p>" + "y" * 1801 + "</p>",
    "<Script>\nmulti\nline\n</sTyle> tail",
]


def test_html_and_truncation(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)], "id int, html string")
    out = {r["id"]: r for r in df.select("id", html_to_text("html").alias("t"),
                                         truncate_text(html_to_text("html")).alias("c")).collect()}
    for i, h in enumerate(PAGES):
        assert out[i]["t"] == py_strip_html(h)
        assert out[i]["c"] == py_truncate(py_strip_html(h))
    assert out[0]["t"] == "Hello<world>"          # &amp;lt; decodes twice, in order
    assert len(out[2]["c"]) == 1800 and out[3]["c"].endswith("[... truncated ...]")
