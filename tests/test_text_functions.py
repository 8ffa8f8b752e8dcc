"""Text functions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codeloom.functions import text as tx


def test_intents(spark):
    rows = spark.createDataFrame([("What would BREAK if I change it?",), ("trace the call",), ("which calls it",), ("Where is it",), ("hello",), (None,)], "q string")
    assert [r.i for r in rows.select(tx.intent(F.col("q")).alias("i")).collect()] == ["impact", "path", "dependency", "discovery", "explanation", None]


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "Does Checkout call GET /orders or orders2?"), (2, None), (3, "checkout_all")], "text_id int, text string")
    names = spark.createDataFrame([("a", "checkout"), ("b", "GET /orders"), ("c", "orders"), ("d", "or"), ("e", "get /order"), ("f", "Checkout.pay")], "id string, name string")
    assert {tuple(r) for r in tx.mentions(texts, names).select("text_id", "id").collect()} == {(1, "a"), (1, "b"), (1, "c")}


def test_addresses(spark):
    rows = spark.createDataFrame([("https://code.invalid/A/b.git",), ("https://code.invalid/../b",), ("http://code.invalid/a/b",), (None,)], "u string")
    assert [r.p and tuple(r.p) for r in rows.select(tx.repository_parts(F.col("u")).alias("p")).collect()] == [("a", "b"), None, None, None]


def test_reports_and_streams(spark):
    rows = spark.createDataFrame([("r", 2, "a|b"), ("r", 1, "x\ny"), ("r", 3, None), ("q", 1, "z")], "k string, n int, t string")
    reports = {r.k: r.report for r in tx.markdown_tables(rows, "k", ["n", "t"], "n", 2).collect()}
    assert reports["r"] == "| n | t |\n|---|---|\n| 1 | x y |\n| 2 | a\\|b |" and set(reports) == {"r", "q"}
    assert len(tx.markdown_tables(rows, "k", ["n", "t"], "n", most=40).where("k = 'r'").first().report) <= 40
    events = tx.answer_events(spark.createDataFrame([(1, "It  is\nso."), (2, None)], "answer_id int, text string")).orderBy("place").collect()
    assert [json.loads(e.event)["text"] for e in events] == ["It  ", "is\n", "so.", "It  is\nso."]
    told = tx.answer_events(spark.createDataFrame([(1, "So.", ["look"], None), (2, "So.", ["look", "ask"], "no model"), (3, None, None, None)], "answer_id int, text string, steps array<string>, error string"))
    assert [(r.answer_id, json.loads(r.event)["type"]) for r in told.orderBy("answer_id", "place").collect()] == [(1, "status"), (1, "delta"), (1, "result"), (2, "status"), (2, "status"), (2, "error")]


def test_evidence_budget(spark):
    big = {"nodes": [{"id": str(i), "source": "x" * 3000, "embedding": [1], "empty": ""} for i in range(50)]}
    for budget in (20_000, 3000, 400):
        out = tx.fit_evidence(big, budget)
        assert len(json.dumps(out)) <= budget and "embedding" not in json.dumps(out)
    assert tx.fit_evidence(big, 50) == {"notice": "too large"} and tx.fit_evidence([1], 9) == [1]
    # the longest cut is kept: lists first, strings only when one item is too long
    assert len(tx.fit_evidence({"a": list(range(50))}, 1000)["a"]) == 20 and len(tx.fit_evidence(["x" * 5000], 700)[0]) == 696
    node = {"id": "n", "file_path": "f", "type": "File", "hash": "h", "source": "s"}
    assert tx.fit_evidence(node, 500) == {"id": "n", "file_path": "f", "type": "File", "source": "s"}
    purse = tx.EvidenceBudget(100)
    assert purse.take(["x" * 60]) and purse.left == 36 and purse.take(["x" * 200]) == {"notice": "too large"} and purse.left == 36 and purse.take(1) == 1
    rows = spark.createDataFrame([(json.dumps(big),), ("no json",), (None,)], "t string")
    assert [r.f and len(r.f) <= 500 for r in rows.select(tx.fitted(500)("t").alias("f")).collect()] == [True, None, None]
