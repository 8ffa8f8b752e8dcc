"""Nearest neighbours against brute force, with copies, ties and unusable vectors."""

from __future__ import annotations

import numpy as np
import pytest

from codeloom.llm import vector_neighbours as module
from codeloom.llm.vector_neighbours import OneBitCodes, neighbour_pairs, neighbours, rotation, search_cell, unit

SCHEMA = "id string, embedding array<float>, seq long, rank string, near_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], s, "clash", "clash") for i, v, s in rows], SCHEMA)


def clustered(n: int, d: int, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(2, int(n**0.5) // 3), d))
    return (centres[r.integers(len(centres), size=n)] + 0.9 * r.standard_normal((n, d))).astype(np.float32) * r.uniform(0.1, 9, (n, 1)).astype(np.float32)


def brute(ids, x, k):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, row in enumerate(np.round(u @ u.T, 6)):
        out[ids[i]] = [(ids[j], row[j]) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-row[j], ids[j]))[:k]]
    return out


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r["rank"], r.near_id, r.similarity))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {i: [(b, c) for _, b, c in sorted(v)] for i, v in out.items()}


def recall(found, truth):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in t}) / max(1, len(t)) for q, t in truth.items()])


@pytest.mark.parametrize("d", [64, 24, 100])
def test_estimates_keep_their_bounds(d):
    x = unit(clustered(800, d))
    codes = OneBitCodes(x, x.mean(axis=0), rotation(d))
    estimate, width = codes.estimate(x[:100])
    error = np.abs(estimate - x[:100] @ x.T) / np.maximum(width, 1e-9)
    assert np.mean(error <= 3) > 0.99 and np.abs(estimate - x[:100] @ x.T).mean() < 0.15
    turn = rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d), atol=1e-5)


def test_cell_search_is_nearly_exact():
    x = unit(clustered(3000, 64))
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :6]
    found = search_cell(x[:200], x, x.mean(axis=0), rotation(64), 6)
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, truth)]) > 0.99


def test_recall_and_ranks(spark):
    x = clustered(4000, 64)
    ids = [f"n{i:05d}" for i in range(len(x))]
    found = collect(neighbours(frame(spark, [(i, v, 1) for i, v in zip(ids, x.tolist())])))
    truth = brute(ids, x, 5)
    assert len(found) == 4000 and all(len(v) == 5 for v in found.values())
    assert recall(found, truth) > 0.95
    assert np.mean([abs(found[q][0][1] - truth[q][0][1]) < 2e-6 for q in truth]) > 0.95


def test_blocks_give_the_same(spark, monkeypatch):
    x = clustered(1500, 64)
    ids = [f"n{i:05d}" for i in range(len(x))]
    vectors = frame(spark, [(i, v, 1) for i, v in zip(ids, x.tolist())])
    whole = collect(neighbours(vectors))
    monkeypatch.setattr(module, "QUERY_BLOCK", 60)
    monkeypatch.setattr(module, "MEMBER_BLOCK", 90)
    blocks = collect(neighbours(vectors))
    assert recall(blocks, whole) > 0.99 and all(len(v) == 5 for v in blocks.values())


def test_copies_ties_and_unusable_rows(spark):
    r = np.random.default_rng(3)
    a, b, c = (r.standard_normal(64).round(3) for _ in range(3))
    rows = [(f"a{i:03d}", a, i) for i in range(400)] + [(f"b{i}", b, i) for i in range(3)] + [("c0", c, 1), ("c1", 2 * c, 1)]
    rows += [("a000", a, 0), ("old", b, 1), ("old", c, 2), ("zero", [0] * 64, 1), ("nan", [float("nan"), *a[1:]], 1), ("inf", [float("inf"), *a[1:]], 1), ("short", a[:32], 1), ("none", None, 1), (None, a, 1), ("hole", [None, *a[1:]], 1), ("empty", [], 1)]
    found = collect(neighbours(frame(spark, rows)))
    x = {i: v for i, v, s in sorted((q for q in rows if q[0] and q[1] is not None and len(q[1]) == 64 and None not in q[1] and np.isfinite(q[1]).all() and np.any(q[1])), key=lambda q: q[2])}
    truth = brute(sorted(x), np.array([x[i] for i in sorted(x)], np.float32), 5)
    assert found.keys() == truth.keys()
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in truth.items()}
    pairs = {tuple(p) for p in neighbour_pairs(frame(spark, rows)).collect()}
    assert pairs == {tuple(sorted((q, i))) for q, v in truth.items() for i, _ in v}


def test_few_and_no_vectors(spark):
    one = frame(spark, [("a", [1.0] * 64, None)])
    assert neighbours(one).count() == 0 and neighbours(one.limit(0)).count() == 0
    two = frame(spark, [("a", [1.0] * 64, None), ("b", [1.0] * 63 + [-1.0], 1)])
    assert collect(neighbours(two)) == {"a": [("b", 0.96875)], "b": [("a", 0.96875)]}


def test_ties_of_scaled_and_noisy_copies_go_by_id(spark):
    r = np.random.default_rng(3)
    x = clustered(500, 64, 5)
    x[:150] = x[0] * r.uniform(0.1, 9, (150, 1)).astype(np.float32)  # one direction, other lengths
    x[150:300] = x[150] * (1 + 1e-6 * r.standard_normal((150, 64))).astype(np.float32)  # noise of floats
    ids = [f"n{i:04d}" for i in r.permutation(len(x))]
    found, truth = collect(neighbours(frame(spark, [(i, v, 1) for i, v in zip(ids, x)]))), brute(ids, x, 5)
    for i in ids[:300]:
        assert found[i] == truth[i], i
    assert recall(found, truth) > 0.98


def test_cell_search_keeps_all_that_may_tie():
    x = unit(clustered(400, 64))
    x[100:160] = x[100]
    for places in search_cell(x[100:160], x, x.mean(axis=0), rotation(64), 6):
        assert set(places) >= set(range(100, 160))


def test_exact_mode_is_brute_force(spark):
    x = clustered(1200, 64, 9)
    x[:40] = x[0]
    ids = [f"n{i:04d}" for i in range(len(x))]
    vectors = frame(spark, [(i, v, 1) for i, v in zip(ids, x)])
    truth = brute(ids, x, 5)
    found = collect(neighbours(vectors, exact=True))
    assert {i: [a for a, _ in v] for i, v in found.items()} == {i: [a for a, _ in v] for i, v in truth.items()}
    assert {tuple(p) for p in neighbour_pairs(vectors, exact=True).collect()} == {tuple(sorted((q, i))) for q, v in truth.items() for i, _ in v}
    wide = collect(neighbours(vectors, margin=2.0, spill=10_000, confidence=5.0))
    assert recall(wide, truth) >= recall(collect(neighbours(vectors)), truth) and recall(wide, truth) > 0.999


def test_a_cell_loses_nothing_without_codes(spark):
    x = clustered(3000, 24, 4)
    ids = [f"n{i:04d}" for i in range(len(x))]
    found = collect(neighbours(frame(spark, [(i, v, 1) for i, v in zip(ids, x.tolist())]), dimensions=24, margin=2.0, spill=10_000))
    assert recall(found, brute(ids, x, 5)) == 1


def test_best_of_blocks_are_merged_by_the_engine(spark):
    near = [("v", ["v"], [("b", 0.5), ("c", 0.5), ("z", -0.25)], True), ("v", ["v"], [("v", 1.0), ("a", 0.5), ("y", 0.0)], True), ("w", ["w", "x"], [("w", 1.0)], True)]
    found = spark.createDataFrame(near, "vid string, ids array<string>, near array<struct<near: string, sims: double>>, parted boolean")
    merged = module._merged(found, 4)
    assert "Python" not in (plan := merged._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    assert {r.vid: (r.ids, [tuple(e) for e in r.near]) for r in merged.collect()} == {"v": (["v"], [("v", 1.0), ("a", 0.5), ("b", 0.5), ("c", 0.5), ("y", 0.0)]), "w": (["w", "x"], [("w", 1.0)])}
