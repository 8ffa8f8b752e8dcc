"""Mixing sources to target shares."""

from __future__ import annotations

import math

import pytest

from codeloom.llm import source_mixing as module
from codeloom.llm.source_mixing import mix, mix_shares, solve_multipliers, token_counts

DOCS = "doc_id long, text string, source string, copies int, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, n int"


def build(spark, spec):
    """{source: [number of words, ...]} as documents."""
    rows, i = [], 0
    for source, sizes in spec.items():
        for n in sizes:
            rows.append((i, " word" * n, source, 9, "clash"))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_rates(spark):
    spec = {"wiki": [5 + i % 37 for i in range(400)], "Tutor-ial ": [20 + i for i in range(40)], "issue": [3 + i % 90 for i in range(900)], "other": [50] * 50}
    documents = build(spark, spec)
    targets = spark.createDataFrame([("Wiki", 0.5, 3, 1), ("tutor_ial", 0.2, 4, 1), ("issue", 0.25, 1, 1), ("podcast", 0.05, 9, 1)], TARGETS)
    mixed = mix(documents, targets)
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"wiki", "tutor_ial", "issue"}
    caps = {"wiki": 3, "tutor_ial": 4, "issue": 1}
    assert all(1 <= r.copies <= caps[r.source] and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    shares = {r.source: r for r in mix_shares(targets, mixed).collect()}
    total = sum(r.n_tokens for r in shares.values())
    for source, share in (("wiki", 0.5), ("tutor_ial", 0.2), ("issue", 0.25)):
        assert abs(shares[source].n_tokens - share / 0.95 * total) < 0.005 * total
    assert (shares["podcast"].n_tokens, shares["podcast"].reached_share, shares["podcast"].n_documents) == (0, 0.0, 0)
    assert {(r.doc_id, r.copies) for r in mix(documents, targets).collect()} == {(r.doc_id, r.copies) for r in rows}
    # rates are tilted exponentially in size
    tilted = sorted((r.n_tokens, r.rate) for r in rows if r.source == "wiki" and 0.01 < r.rate < 3)
    (a, x), (b, y), (c, z) = tilted[0], tilted[len(tilted) // 2], tilted[-1]
    assert math.isclose((math.log(y) - math.log(x)) / (b - a), (math.log(z) - math.log(x)) / (c - a), rel_tol=1e-3)


def test_multipliers_meet_their_goals(spark):
    sizes = spark.createDataFrame([("a", t, 3) for t in range(1, 200)] + [("b", 10, 5)], "source string, n_tokens long, n long")
    whole = 3 * sum(range(1, 200))
    for goal in (1e-3, 0.3, 1.0, 1.7, 1.999):
        m = solve_multipliers(sizes, {"a": (goal * whole, 100.0, 2), "b": (60.0, 10.0, 4)})
        reached = sum(3 * t * min(2.0, math.exp(min(50, m["a"] * t / 100))) for t in range(1, 200))
        assert math.isclose(reached, goal * whole, rel_tol=1e-6) and math.isclose(50 * math.exp(m["b"]), 60, rel_tol=1e-6)


def test_total_beyond_the_caps(spark):
    documents = build(spark, {"a": [10] * 20, "b": [10] * 20})
    targets = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.5, None, 1)], TARGETS)
    copies = {r.source: r.copies for r in mix(documents, targets, total=10_000.0).collect()}
    assert copies == {"a": 2, "b": 1}


def test_dirty_and_empty_tables(spark):
    rows = [(1, "a b c", "x", 1, ""), (2, None, "x", 1, ""), (3, "", "x", 1, ""), (4, "a b", None, 1, ""), (None, "a", "x", 1, ""), (5, "long " * 30_000, "X ", 1, "")]
    documents = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("x", 1.0, 2, 1), ("x", 1.0, 2, 1), (None, 0.5, 1, 1), ("z", 0.0, 3, 1)], TARGETS)
    assert {r.doc_id: r.copies for r in mix(documents, targets).collect()} == {1: 2, 5: 2}
    assert {r.doc_id: r.n_tokens for r in token_counts(documents).collect()}[1] == 3
    assert mix(documents.limit(0), targets).count() == 0 and mix(documents, targets.limit(0)).count() == 0
    assert mix_shares(targets, mix(documents.limit(0), targets)).count() == 2


def test_missing_tokenizer(spark):
    with pytest.raises(Exception, match="nowhere"):
        token_counts(build(spark, {"a": [1]}), "/nowhere/x.tiktoken").collect()


def test_halving_ends_where_newton_is_left_out(spark, monkeypatch):
    sizes = spark.createDataFrame([("a", t, 3) for t in range(1, 60)], "source string, n_tokens long, n long")
    goals = {"a": (0.4 * 3 * sum(range(1, 60)), 30.0, 2)}
    newton = solve_multipliers(sizes, goals)
    monkeypatch.setattr(module, "NEWTON_STEPS", 0)
    assert math.isclose(solve_multipliers(sizes, goals)["a"], newton["a"], rel_tol=1e-6)
    with pytest.raises(ArithmeticError):
        solve_multipliers(sizes.withColumn("n", sizes["n"] * float("nan")), goals)
