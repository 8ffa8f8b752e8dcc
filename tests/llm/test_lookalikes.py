"""One form for texts that look the same."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import lookalikes
from codeloom.llm.lookalikes import canonical, confusion, consistent_forms, look_classes, same_look, script_report


@pytest.mark.parametrize(
    ("a", "b"),
    [("scope", "sсоpe"), ("cafe\u0301", "café"), ("file", "ﬁle"), ("AB 12", "ＡＢ\u3000１２"), ("a b", "a\u00a0b"), ("a b", "a\u202fb"), ("ab", "a\u200b\u00ad\ufeffb"), ("a-b", "a‑b"),
     ("ёлка", "е\u0308лка"), ("жaл", "жал"), ("BETA", "ΒΕΤΑ"), ("coco", "сосо"), ("a\nb", "a\r\nb"), ("ë", "ё"), ("a\u0323\u0302", "a\u0302\u0323"), ("VIII", "Ⅷ")],
)
def test_same_look(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [("List", "list"), ("café", "cafe"), ("елка", "ёлка"), ("l1", "ll"), ("O0", "00"), ("a b", "a  b"), ("a b", "ab"), ("x²", "x2"), ("™", "TM"), ("a,b", "a;b"), ("①", "1"), ("в", "b"), ("у", "u"), ("'", "’"), ("a—b", "a-b"), ("½", "1/2")],
)
def test_visibly_different(a, b):
    assert canonical(a) != canonical(b)


def test_script_resolution():
    assert canonical("мecto") == canonical("месto")
    assert canonical("жap") == "жар" and canonical("bоок").startswith("boo")
    assert [confusion(w) for w in ("sсope", "сосо", "жар", "frog", "東京タワー", "12", "ꓐank", "жaр", "bя")] == ["mixed", "whole", "", "", "", "", "mixed", "mixed", ""]


def test_more_scripts():
    assert [canonical(w) for w in ("ɡoogle", "ɑpple", "ꓐank", "ⲟpen", "ꓣꓴꓠ")] == ["google", "apple", "Bank", "open", "RUN"]
    assert canonical("ⲁ") == "ⲁ" and canonical("ı") != canonical("i")


def test_reports_and_classes(spark):
    rows = [(1, "scope ok", None), (2, "sсope ok", None), (3, "сосо sсope", None), (4, None, None), (None, "sсope", None), (5, "", None), (2, "sсope ok", None), (6, "scope ok", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_mixed string")
    assert {tuple(r) for r in script_report(documents).distinct().collect()} == {(2, 1, 0), (3, 1, 1)}
    assert {tuple(r) for r in look_classes(documents).collect()} == {(1, 1, 3, 2), (2, 1, 3, 2), (6, 1, 3, 2), (3, 3, 1, 1), (5, 5, 1, 1)}
    assert look_classes(documents.limit(0)).count() == 0 and script_report(documents.limit(0)).count() == 0


def test_joiners_stay_where_they_show():
    assert canonical("\U0001f468\u200d\U0001f469") != canonical("\U0001f468\U0001f469") and canonical("a\u200db") == "ab"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abceopxyABCEHOTX аеожи\u0306\u0308οα\u200b\u00a0ａﬁё\r\n1l-‑", max_size=12))
def test_idempotent(text):
    assert canonical(canonical(text)) == canonical(text)


def test_operator(spark):
    long = "word " * 60_000
    rows = [(1, "scope", None), (2, "scоpe", "x"), (3, "scope", "x"), (4, "scоpe", None), (5, "SCOPE", None), (6, None, None), (7, "", None), (8, "\u200b", None), (9, "", None), (None, "scоpe\u200b", None), (2, "scоpe", "y"), (10, long, None), (11, long.replace(" ", "\u00a0"), None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, form string")
    found = sorted(map(tuple, same_look(documents).collect()))
    assert found == [(1, 2), (1, 4), (2, 3), (3, 4), (7, 8), (8, 9), (10, 11)]
    forms = {r.doc_id: r.form for r in consistent_forms(documents).collect()}
    assert forms[2] == "scope" and forms[6] is None and forms[8] == ""
    assert same_look(documents.limit(0)).count() == 0


def test_large_group_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "LOOK_BLOCK", 30)
    texts = ["scope", "scоpe", "sсope", "other"]
    rows = [(i, texts[i % 4]) for i in range(400)]
    found = {tuple(r) for r in same_look(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(a, b) for a in range(400) for b in range(a + 1, 400) if a % 4 != b % 4 and a % 4 != 3 and b % 4 != 3}
