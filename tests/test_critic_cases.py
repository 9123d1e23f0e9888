"""Critic parsing and penalty cases (the reproduced critic's unit cases, as table rows)."""

import json

import pytest
from pyspark.sql import functions as F

from critica.functions import critic as cr


def reply(h=0, f=0, lf=0, m=0, score=8.0, verdict="good", confidence=0.9, actions=0):
    return json.dumps({
        "factual_errors": [f"fe{i}" for i in range(f)],
        "hallucinations": [f"h{i}" for i in range(h)],
        "missing_concepts": [f"m{i}" for i in range(m)],
        "logical_flaws": [f"l{i}" for i in range(lf)],
        "improvement_actions": [f"a{i}" for i in range(actions)],
        "score": score, "confidence": confidence, "verdict": verdict,
    })


# (raw reply, expected score, expected verdict)
CASES = [
    (reply(1, 1, 1, 1, 6.0, "acceptable"), 1.0, "acceptable"),
    (reply(2, 0, 0, 0, 8.0, "good"), 4.0, "good"),             # one tier off is kept
    (reply(0, 2, 0, 0, 7.5, "good"), 4.5, "good"),
    (reply(4, 3, 3, 4, 3.0, "good"), 0.0, "poor"),             # floor at 0, overridden
    (reply(0, 0, 0, 0, 9.0, "excellent"), 9.0, "excellent"),
    (reply(0, 0, 0, 0, 8.0, "UNKNOWN_VERDICT"), 8.0, "good"),
    (reply(0, 0, 0, 0, 3.5, "needs_improvement"), 3.5, "poor"),
    (reply(0, 0, 0, 0, 2.5, "excellent"), 2.5, "poor"),
    ("I think the answer is fine, maybe a 7.", 3.0, "poor"),   # malformed -> fallback
    ("```json\n" + reply(0, 0, 0, 1, 8.2, "good") + "\n```", 7.7, "good"),
    ("Here is my evaluation:\n" + reply(0, 0, 0, 0, 8.0, "great"), 8.0, "good"),
    ('{"score": "7.5", "verdict": "good"}', 7.5, "good"),       # numeric text
    ('{"score": null}', 5.0, "acceptable"),                     # null -> midpoint
    ('{"score": 42}', 10.0, "excellent"),                       # clamp
    ("5", 3.0, "poor"),                                         # valid JSON, not an object
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(CASES)], "id int, raw string")
    rows = cr.parse_feedback(df, raw="raw").orderBy("id").collect()
    return rows


@pytest.mark.parametrize("i", range(len(CASES)))
def test_score_and_verdict(parsed, i):
    _, score, verdict = CASES[i]
    fb = parsed[i]["feedback"]
    assert fb["score"] == pytest.approx(score)
    assert fb["verdict"] == verdict
    assert 0.0 <= fb["score"] <= 10.0


def test_malformed_fallback(parsed):
    fb = parsed[8]["feedback"]
    assert parsed[8]["parse_ok"] is False
    assert fb["confidence"] == pytest.approx(0.2)
    assert fb["improvement_actions"] == [cr.FALLBACK_ACTION]
    assert fb["hallucinations"] == [] and fb["factual_errors"] == []


def test_issue_counts(spark):
    raw = reply(2, 1, 3, 1, 5.0, "poor", actions=2)
    df = spark.createDataFrame([(raw,)], "raw string")
    r = cr.parse_feedback(df, raw="raw").select(
        cr.total_issue_count().alias("n"), cr.has_hallucinations().alias("h"),
        cr.has_critical_issues().alias("c")).first()
    assert r["n"] == 7 and r["h"] and r["c"]


def test_safe_list_coercion(spark):
    raw = json.dumps({"hallucinations": ["  x  ", " ", None, 3, 2.5, True, {"a": 1}, [1]],
                      "factual_errors": "  single  ", "logical_flaws": 5, "missing_concepts": None,
                      "score": 6})
    df = spark.createDataFrame([(raw,)], "raw string")
    fb = cr.parse_feedback(df, raw="raw").first()["feedback"]
    assert fb["hallucinations"] == ["x", "3", "2.5", "True"]
    assert fb["factual_errors"] == ["  single  "]      # a bare string is kept unstripped
    assert fb["logical_flaws"] == [] and fb["missing_concepts"] == []


def test_judge_parse(spark):
    rows = [
        ('{"factual_accuracy_score": 12, "hallucinations_detected": "yes"}', 10.0, True),
        ('```json\n{"factual_accuracy_score": 4.5, "hallucinations_detected": false}\n```', 4.5, False),
        ('{"factual_accuracy_score": "n/a", "hallucinations_detected": true}', 5.0, False),
        ("no json", 5.0, False),
        ('{"hallucinations_detected": 1}', 5.0, True),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(rows)], "id int, raw string")
    out = cr.parse_judge(df, raw="raw", out="j").orderBy("id").collect()
    for (_, s, h), r in zip(rows, out):
        assert r["j"]["factual_accuracy"] == pytest.approx(s)
        assert r["j"]["hallucinations_detected"] == h


def test_filter_on_parsed_field_is_not_pushed_into_parse(spark):
    df = spark.createDataFrame([(reply(score=9.0, verdict="excellent"),)], "raw string")
    plan = cr.parse_feedback(df, raw="raw").filter(F.col("feedback.score") > 8)._jdf \
        .queryExecution().optimizedPlan().toString()
    # the filter sits above the Generate barrier; the parse is not duplicated into it
    assert plan.index("Filter") < plan.index("Generate")
