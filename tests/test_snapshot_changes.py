"""Changes between snapshots, on small tables and against a plain reading of the rules."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.operators.snapshot_changes import snapshot_changes

ROWS = "seq long, repository_id string, commit_sha string, id string, hash string, ord string"
SNAPSHOTS = "repository_id string, commit_sha string, created_at timestamp, id string, hash string"


def at(day: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def run(spark, rows, snapshots, **kw):
    out = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(snapshots, SNAPSHOTS), **kw)
    assert out.columns == ["commit_sha", "id", "change_kind"]
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found))
    return set(found)


def plain(rows, snapshots):
    """Brute force."""
    first = {}
    for repo, commit, created, *_ in snapshots:
        if None not in (repo, commit, created):
            first[repo, commit] = min(created, first.get((repo, commit), created))
    latest = {}
    for seq, _, commit, key, value, _ in rows:
        if commit is not None and key is not None:
            place = -(2**63) if seq is None else seq
            if (commit, key) not in latest or latest[commit, key][0] < place:
                latest[commit, key] = (place, (value or "").strip().lower())
    out = set()
    for repo in {r for r, _ in first}:
        commits = [c for _, c in sorted((t, c) for (r, c), t in first.items() if r == repo)]
        for a, b in zip(commits, commits[1:]):
            old = {k: v for (c, k), (_, v) in latest.items() if c == a}
            new = {k: v for (c, k), (_, v) in latest.items() if c == b}
            out |= {(b, k, "added") for k in new.keys() - old.keys()}
            out |= {(b, k, "removed") for k in old.keys() - new.keys()}
            out |= {(b, k, "changed") for k in new.keys() & old.keys() if old[k] != new[k]}
    return out


SNAPS = [("r", "c1", at(1), None, None), ("r", "c0", at(0), None, None), ("r", "c1", at(1), None, None), ("r", "c2", at(2), None, None), ("q", "d", at(0), None, None)]


def test_kinds_order_and_repeats(spark):
    rows = [
        (1, "r", "c0", "a", "X", None), (2, "r", "c0", "b", "y", None), (3, "r", "c0", "gone", "z", None),
        (4, "r", "c1", "a", " x ", None), (9, "r", "c1", "b", "Y", None), (5, "r", "c1", "b", "wrong", None),
        (6, "r", "c1", "new", None, None), (6, "r", "c1", "new", None, None), (7, "r", "c2", "new", "", None),
        (8, "q", "d", "a", "1", None), (10, "r", "unknown", "a", "1", None), (11, "r", "c1", None, "1", None),
    ]
    found = run(spark, rows, SNAPS)
    assert found == plain(rows, SNAPS) == {("c1", "gone", "removed"), ("c1", "new", "added"), ("c2", "a", "removed"), ("c2", "b", "removed")}


def test_empty_snapshot_removes_all(spark):
    assert run(spark, [(1, "r", "c0", "a", "x", None)], SNAPS) == {("c1", "a", "removed")}


def test_empty_tables(spark):
    assert run(spark, [], SNAPS) == set()
    assert run(spark, [(1, "r", "c0", "a", "x", None)], []) == set()


def test_hot_key_long_text_and_buckets(spark):
    rows = [(i, "r", "c0", "hot", "old" + "x" * 100_000 * (i == 7), None) for i in range(3000)] + [(9999, "r", "c1", "hot", "new", None)]
    assert run(spark, rows, SNAPS, buckets=3) == {("c1", "hot", "changed"), ("c2", "hot", "removed")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["c0", "c1", "c2", "d", None]), st.sampled_from(["a", "b", "é", "", None]), st.sampled_from(["", None, "X", "x ", "y"])), max_size=25))
def test_against_brute_force(spark, cells):
    rows = [(i, "r", c, k, h, None) for i, (c, k, h) in enumerate(cells)]
    assert run(spark, rows, SNAPS) == plain(rows, SNAPS)
