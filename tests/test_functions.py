"""Driver-side helpers and column functions."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.errors import ValidationError
from lorekeep.functions import concepts, redact, refs, text, times
from lorekeep.operators import maintain, search, vector


def test_query_terms():
    assert text.query_terms("auth-bug fix_it, ünï") == ["auth", "bug", "fix_it", "ünï"]
    for bad in ("", "  ", "--!"):
        with pytest.raises(ValidationError):
            text.query_terms(bad)


def test_phrases_split_on_underscore_and_fold():
    assert text.phrases(["Auth_Bug", "MÜLLER", "__"]) == [["auth", "bug"], ["muller"]]


def test_concepts():
    out = concepts.expand(["Bug", "x", "bug"])
    assert out[:2] == ["Bug", "x"] and set(out[2:]) == {"error", "failure", "fault", "defect"}
    assert concepts.expand(["nothing"]) == ["nothing"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("#54", ("pr", "#54")), ("0054", ("pr", "#54")), ("org/repo#7", ("pr", "#7")), ("#000", ("pr", "#0")), ("ABC123f", ("commit", "abc123f")), ("x#y", ("commit", "x#y"))],
)
def test_normalize_ref(raw, want):
    assert refs.normalize(raw) == want


def test_normalized_refs(spark):
    raws = ["#54", " 0054\n", "org/repo#7", "#000", "ABC123f", "x#y", "a#1# 02 ", "", "#", "É12Z", "3 4", None]
    got = spark.createDataFrame([(x,) for x in raws], "raw string").select(refs.normalized(F.col("raw")).alias("r")).collect()
    assert [q.r and tuple(q.r) for q in got] == [x if x is None else refs.normalize(x) for x in raws]


def test_threshold():
    from datetime import UTC, datetime

    now = datetime(2024, 5, 2, tzinfo=UTC)
    assert times.threshold("1d", now=now) == "2024-05-01T00:00:00Z"
    assert times.threshold("2024-01-31") == "2024-01-31T00:00:00Z"
    assert times.threshold("2024-01-31T01:00:00+01:00") == "2024-01-31T00:00:00Z"
    assert times.threshold("2024-01-31T00:00:00.5Z") == "2024-01-31T00:00:00.5Z"
    for bad in ("", "yesterday", "2024-13-01", "d"):
        with pytest.raises(ValidationError):
            times.threshold(bad)


@given(st.text(max_size=80), st.text(min_size=1, max_size=5), st.integers(1, 60))
def test_snippet_is_part_of_text(body, term, most):
    cut = text.snippet(body, [term], most)
    assert cut in body and len(cut.encode()) <= max(most, 4 * most if len(body) <= most else most)


@given(st.text(max_size=50), st.integers(0, 60))
def test_utf8_prefix(body, most):
    cut = text.utf8_prefix(body, most)
    assert body.startswith(cut) and len(cut.encode()) <= most


def test_redact_text_and_json():
    made = "Bearer " + "a" * 20 + " API_KEY=" + "z" * 10 + " sk-" + "q" * 24
    out = redact.redact_text(made)
    assert "[REDACTED:BEARER_TOKEN]" in out and "API_KEY=[REDACTED:ENV_VALUE]" in out and "[REDACTED:API_KEY]" in out
    doc = {"password": {"deep": 1}, "list": ["AKIA" + "A" * 16, 3], "session_token": "x", "ok": None}
    assert redact.redact_json(doc) == {"password": redact.ENV_VALUE, "list": ["[REDACTED:API_KEY]", 3], "session_token": redact.ENV_VALUE, "ok": None}
    assert json.loads(redact.redact_line('{"b":"x","a_key":"y"}')) == {"b": "x", "a_key": redact.ENV_VALUE}
    assert redact.redact_line("not json " + made).startswith("not json Bearer [")


def test_redact_column_equals_driver_side(spark):
    rows = ["a TOKEN = '12345678' b", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY----- y", "ghp_" + "a" * 22, "plain", "key=short"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(redact.redact(F.col("t"))).collect()
    assert [r[0] for r in got] == [redact.redact_text(r) for r in rows]


def test_refs_column(spark):
    rows = ["see https://github.com/o/r/pull/54/files and #007, org/x#9 commit ABCDEF1 1234567 0xdeadbeef", None, "#54 #55", "abc1234 def5678"]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(refs.extract(F.col("t"))).collect()]
    assert got == [[("commit", "abcdef1"), ("pr", "#54"), ("pr", "#7"), ("pr", "#9")], [], [("pr", "#54")], [("commit", "abc1234")]]


def test_like_folds_ascii_only(spark):
    rows = spark.createDataFrame([("ÉCOLE",), ("école",), ("ECOLE",)], "t string")
    assert [r.t for r in rows.where(text.like_ascii_fold(F.col("t"), "%école%")).collect()] == ["école"]
    assert rows.where(text.like_ascii_fold(F.col("t"), "%ecole%")).count() == 1
    assert text.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"


def test_ellipsis_quote_and_line_command(spark):
    df = spark.createDataFrame([("  ab cd  ", "it's", 3), ("", "x", 0)], "t string, p string, n int")
    got = df.select(text.ellipsis(F.col("t"), 3).alias("e"), text.native_line_command(F.col("p"), F.col("n")).alias("c")).collect()
    assert [r.e for r in got] == ["ab…", None]
    assert got[0].c == "sed -n '3p' 'it'\"'\"'s' | jq ." and got[1].c is None


def test_bounds():
    assert search.bounded("limit", 0) == 1 and search.bounded("limit", 99) == 50
    with pytest.raises(ValidationError):
        search.bounded("limit", 99, strict=True)
    assert search.overfetch(0, 10) == 20 and search.overfetch(1000, 10) == 1510


def test_vectors():
    assert vector.truncate_and_normalize([3.0, 4.0, 9.0], 2) == [0.6, 0.8]
    with pytest.raises(ValidationError):
        vector.truncate_and_normalize([1.0], 2)
    assert maintain.nearest_rank([1, 2, 3, 4], 0.5) == 3 and maintain.nearest_rank([5], 0.99) == 5
    assert vector.adaptive_k(20, 0) == [40, 80] and vector.adaptive_k(20, 1) == [80]
