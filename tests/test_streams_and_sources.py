"""Event folds in batch and as streams; trees, archives and snapshots."""

from __future__ import annotations

import datetime as dt
import io
import random
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.schema import EDGES, NODES
from codeloom.sources import snapshots, trees
from codeloom.sources.snapshots import GraphStore, cascade, decode_snapshot, encode_snapshot, newest, pack_text, set_where, unpack_text, upsert, visible_to
from codeloom.sources.trees import read_archives, scan_tree, skip_reason, zip_members
from codeloom.streaming import deliveries as de

T0 = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


EVENTS = "id long, k string, at timestamp, state string"


def test_accepted_once(spark):
    rows = [(1, "a", at(0), ""), (2, "a", at(1), ""), (3, "a", at(24), ""), (4, "a", at(47.9), ""), (5, "a", at(48), ""), (6, "b", at(5), ""), (7, "a", at(0), ""), (8, None, at(1), ""), (9, None, at(2), ""), (10, "a", None, "")]
    found = {r.id: r.accepted for r in de.accepted_once(spark.createDataFrame(rows, EVENTS), ["k"], "at", "id").collect()}
    assert found == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: False, 8: True, 9: False}
    r = random.Random(5)
    rows = [(i, r.choice("abc"), at(r.uniform(0, 300)), "") for i in range(800)]
    until, plain = {}, {}
    for i, k, t, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        plain[i] = k not in until or t >= until[k]
        if plain[i]:
            until[k] = t + dt.timedelta(hours=7)
    assert {x.id: x.accepted for x in de.accepted_once(spark.createDataFrame(rows, EVENTS), ["k"], "at", "id", 7 * 3600).collect()} == plain
    assert de.accepted_once(spark.createDataFrame([], EVENTS), ["k"], "at", "id").count() == 0


def test_latest_wins_states_and_memory(spark):
    events = spark.createDataFrame([(1, "a", at(0), "QUEUED"), (2, "a", at(2), "READY"), (3, "a", at(1), "PARSING"), (4, "b", at(1), "FAILED"), (5, "b", at(1), "READY"), (6, "c", None, "X")], EVENTS)
    assert {r.id: r.superseded for r in de.latest_wins(events, ["k"], "at", "id").collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert {r.k: (r.state, r.n_events, r.log) for r in de.last_states(events, ["k"], "at", "state", "id", 2).collect()} == {"a": ("READY", 3, "PARSING,READY"), "b": ("READY", 2, "FAILED,READY")}
    assert {(r.k, r.id) for r in de.memory(events, "k", "at", 1).collect()} >= {("a", 2), ("c", 6)}
    moves = {("QUEUED", "start"): "RUNNING", ("RUNNING", "end"): "READY"}
    rows = spark.createDataFrame([("QUEUED", "start"), ("QUEUED", "end"), ("RUNNING", "end")], "s string, e string")
    assert [r.n for r in rows.select(de.next_state(rows.s, rows.e, moves).alias("n")).collect()] == ["RUNNING", "QUEUED", "READY"]


def test_routes(spark):
    sha = "a" * 40
    rows = [("push", f'{{"ref":"refs/heads/main","default_branch":"main","after":"{sha}"}}'), ("push", f'{{"ref":"refs/heads/x","default_branch":"main","after":"{sha}"}}'), ("push", f'{{"ref":"refs/heads/main","default_branch":"main","after":"{sha}","deleted":true}}'),
            ("pull_request", '{"action":"opened","draft":false}'), ("pull_request", '{"action":"opened","draft":true}'), ("issue_comment", '{"action":"created","association":"OWNER","comment":" /review"}'), ("issue_comment", '{"action":"created","association":"NONE","comment":"/review"}'), ("ping", "{}"), ("push", "{bad"), ("push", None)]
    out = [r.route for r in de.routed(spark.createDataFrame(rows, "kind string, body string")).collect()]
    assert out == ["push", "ignored", "ignored", "pull_request", "ignored", "comment", "ignored", "ping", "malformed", "malformed"]


def test_claims_retries_and_cleaning(spark):
    claims = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "k string, owner string")
    assert {r.k: (r.owner, r.status) for r in de.unbound(claims, "k", "owner").collect()} == {"a": ("x", "BOUND"), "b": (None, "AMBIGUOUS"), "c": (None, "NOT_FOUND")}
    runs = spark.createDataFrame([("1", "ERROR"), ("2", "COMPLETE"), ("3", "ERROR"), ("retry:3", "QUEUED")], "id string, status string")
    asked = spark.createDataFrame([("1",), ("1",), ("2",), ("3",)], "id string")
    assert [tuple(r) for r in de.retries(runs, asked).collect()] == [("retry:1", "1")]
    key = "0a1b2c3d-0a1b-2c3d-4e5f-0a1b2c3d4e5"
    folders = spark.createDataFrame([(key + "1", at(0)), (key + "2", at(40)), (key + "3", at(0)), ("tmp", at(0))], "name string, modified_at timestamp")
    gone = de.abandoned(folders, spark.createDataFrame([(key + "3",)], "id string"), F.lit(at(48)))
    assert [r.name for r in gone.collect()] == [key + "1"]


def test_streaming_queries(spark, tmp_path):
    rows = [(1, "a", at(0), "x"), (2, "a", at(0.5), "x"), (3, "b", at(1), "y")]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            query.processAllAvailable()
            return spark.table(name).collect()
        finally:
            query.stop()

    assert {r.k for r in run(de.stream_once(stream(), ["k"], "at"), "once", "append")} == {"a", "b"} and len(spark.table("once").collect()) == 2
    assert {(r.state, r.n) for r in run(de.counts_stream(stream(), "at", "state"), "counts", "complete")} == {("x", 2), ("y", 1)}


def archive(members: dict[str, str], link: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            info = zipfile.ZipInfo(name)
            if name == link:
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, text)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = archive({"top/a.py": "x = 1", "top/node_modules/b.js": "y", "top/c/d.ts": "z"})
    assert [(p, n, c) for p, n, c in zip_members(good)] == [("a.py", 5, b"x = 1"), ("c/d.ts", 1, b"z")]
    assert [p for p, *_ in zip_members(archive({"a.py": "", "b/c.py": ""}))] == ["a.py", "b/c.py"] and zip_members(archive({})) == []
    for bad in (archive({"/a.py": ""}), archive({"../a.py": ""}), archive({"a\\b.py": ""}), archive({"c:d.py": ""}), archive({"l.py": "x"}, "l.py"), b"no zip", archive({"big.py": "x" * (trees.MOST_FILE_BYTES + 1)})):
        with pytest.raises(ValueError):
            zip_members(bad)
    (tmp_path / "x.zip").write_bytes(good)
    assert {(r.path, bytes(r.content)) for r in read_archives(spark, str(tmp_path / "*.zip")).collect()} == {("a.py", b"x = 1"), ("c/d.ts", b"z")}


def test_scan_tree(spark, tmp_path, monkeypatch):
    files = {"a.py": "x = 1", "b/c.ts": "let x", "b/dist/d.js": "y", "e.min.js": "z", "f.txt": "t", "g.py": "\0", "h.js": "x" * 2001, "i.py": "# AUTO-GENERATED\n", "j.py": "\n" * 600 + "# do not edit"}
    for name, text in files.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    (tmp_path / "t" / "k.py").write_bytes(b"# \xff\nx = 1\n")  # no UTF-8
    found = {r.path: (r.language, r.text) for r in scan_tree(spark, str(tmp_path / "t")).where("path <> 'k.py'").collect()}
    assert scan_tree(spark, str(tmp_path / "t")).count() == 4
    assert found == {"a.py": ("Python", "x = 1"), "b/c.ts": ("TypeScript", "let x"), "j.py": ("Python", files["j.py"])}
    reasons = spark.createDataFrame([(k, v) for k, v in files.items()], "p string, t string")
    assert {r.p: r.r for r in reasons.select("p", skip_reason(F.col("p"), F.col("t")).alias("r")).collect()} == {"a.py": None, "b/c.ts": None, "b/dist/d.js": "folder", "e.min.js": "ending", "f.txt": "extension", "g.py": "binary", "h.js": "long line", "i.py": "generated", "j.py": None}
    monkeypatch.setattr(trees, "MOST_FILES", 3)
    with pytest.raises(ValueError, match="files"):
        scan_tree(spark, str(tmp_path / "t"))
    monkeypatch.undo()
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no Python"):
        scan_tree(spark, str(tmp_path / "n"))


def test_snapshot_codec(spark):
    node = {"id": "a", "embedding": [1.0], "name": "é"}
    payload = encode_snapshot([node], [{"id": "e"}])
    assert decode_snapshot(payload) == {"nodes": [{"id": "a", "embedding": [], "name": "é"}], "edges": [{"id": "e"}]} and node["embedding"] == [1.0]
    for bad in ("", "x", "eJwDAAAAAAE=", None, payload[:-6]):
        with pytest.raises(ValueError):
            decode_snapshot(bad)
    rows = spark.createDataFrame([("é" * 5000,), ("",), (None,)], "t string")
    assert [r.u for r in rows.select(unpack_text(pack_text("t")).alias("u")).collect()] == ["é" * 5000, "", None]
    assert rows.limit(1).select(unpack_text(F.lit("bad")).alias("u")).first().u is None


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    assert store.snapshots().count() == 0
    with pytest.raises(KeyError):
        store.read("r")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "id string")
    edges = spark.createDataFrame([("e", "a", "b", "CALLS"), ("f", "a", "gone", "CALLS")], "id string, source string, target string, type string")
    store.publish("r", "c1", nodes("a", "b"), edges)
    store.publish("r", "c2", nodes("a"), edges.limit(0))
    store.publish("r", "c1", nodes("a", "b", "c"), edges)
    assert {(r.commit_sha) for r in store.snapshots().collect()} == {"c1", "c2"}
    n, e = store.read("r")
    assert {r.id for r in n.collect()} == {"a", "b", "c"} and [(r.id, r.type) for r in e.collect()] == [("e", "CALLS")]
    assert store.read("r", "c2")[0].count() == 1


def test_table_updates(spark):
    table = spark.createDataFrame([("1", "r", "a", at(0)), ("2", "r", "b", at(1)), ("3", "q", "c", None)], "id string, repository_id string, owner string, created_at timestamp")
    rows = spark.createDataFrame([("2", "r", "B", at(9)), ("4", "r", "d", at(2))], table.schema)
    merged = upsert(table, rows, ["id"])
    assert {(r.id, r.owner) for r in merged.collect()} == {("1", "a"), ("2", "B"), ("3", "c"), ("4", "d")}
    assert {r.id for r in newest(merged, "repository_id", 2).collect()} == {"2", "4", "3"}
    assert {r.id: r.owner for r in set_where(table, F.col("id") == "1", owner=F.lit("z")).collect()} == {"1": "z", "2": "b", "3": "c"}
    seen = lambda user: {r.id for r in spark.createDataFrame([("1", "a"), ("2", None)], "id string, owner_id string").where(visible_to("owner_id", user)).collect()}
    assert seen("a") == {"1"} and seen("local") == {"2"}
    left = cascade({"repositories": spark.createDataFrame([("r",), ("q",)], "id string"), "runs": table}, "r")
    assert [r.id for r in left["repositories"].collect()] == ["q"] and [r.id for r in left["runs"].collect()] == ["3"]


def test_store_prunes_and_compares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "KEPT_SNAPSHOTS", 2)
    store = snapshots.GraphStore(spark, f"file://{tmp_path}/store")
    node = lambda i, h: (0, i, i, "Function", "r", i, "a.py", "Python", 1, 2, "", "", "", h, "m", False, "", "", [])
    edge = (0, "e", "a", "b", "CALLS", "a.py", 1, 1.0, "resolved", "syntax")
    shas = [c * 40 for c in "abc"]
    for k, sha in enumerate(shas):
        store.publish("r", sha, spark.createDataFrame([node("a", str(k)), node("b", "1")], NODES), spark.createDataFrame([edge], EDGES))
    store.publish("r", shas[2], spark.createDataFrame([node("a", "9"), node("b", "1")], NODES), spark.createDataFrame([], EDGES))
    assert store.prune() == 2 and store.prune() == 0
    assert len(list((tmp_path / "store" / "versions").iterdir())) == 2 and {r.commit_sha for r in store.snapshots().collect()} == set(shas[1:])
    nodes, edges = store.compare("r", shas[1], shas[2])
    assert [(r.id, r.change, list(r.changed_fields)) for r in nodes.collect()] == [("a", "modified", ["hash"])] and [(r.id, r.change) for r in edges.collect()] == [("e", "removed")]
    with pytest.raises(KeyError, match=shas[0]):
        store.compare("r", shas[0], shas[1])
    for bad in ((shas[1], shas[1]), ("x", shas[1])):
        with pytest.raises(ValueError):
            store.compare("r", *bad)
    assert snapshots.GraphStore(spark, f"file://{tmp_path}/none").prune() == 0


def test_projections_and_sessions(spark):
    repos = spark.createDataFrame([("r", "secret", '["a"]', "no json", "READY", None), ("s", "x", None, "", "CLONING", "READY"), ("t", "x", None, None, None, "PARSING")], "id string, source string, logs string, warnings string, status string, sync_status string")
    shown = snapshots.public_repositories(repos)
    assert "source" not in shown.columns and {r.id: (r.a, r.b) for r in shown.select("id", F.try_variant_get("logs", "$[0]", "string").alias("a"), F.col("warnings").isNull().alias("b")).collect()}["r"] == ("a", True)
    assert {r.id: r.a for r in repos.select("id", snapshots.active().alias("a")).collect()} == {"r": False, "s": True, "t": True}
    runs = spark.createDataFrame([("1", "ERROR", "", None, "kept out")], "id string, status string, error string, head_sha string, token string")
    assert snapshots.public_runs(runs).first().run == '{"id":"1","status":"ERROR"}'
    held = spark.createDataFrame([("c", "r", "{}")], "id string, repository_id string, state string")
    asked = spark.createDataFrame([("c", "r"), ("c", "s"), ("c", "s")], "id string, repository_id string")
    assert {(r.repository_id, r.state) for r in snapshots.sessions(held, asked).collect()} == {("r", "{}"), ("s", '{"messages": [], "symbols": []}')}
    later = held.withColumn("state", F.lit("new")).unionByName(spark.createDataFrame([("d", "r", "x"), (None, "r", "x")], held.schema))
    assert {(r.id, r.state) for r in snapshots.merged(held, later).collect()} == {("c", "new"), ("d", "x")}


def test_claims(spark):
    repos = spark.createDataFrame([("a", "H/a", None), ("b", "h/b", "me"), ("c", "h/c", None), ("c2", "h/c", None), ("d", "h/d", "me"), ("d2", "h/d", "me"), ("e", "h/e", "other"), ("f", "h/f", None), ("f2", "h/f", "other")], "id string, address string, owner string")
    claims = spark.createDataFrame([("1", "h/A", "me"), ("2", "h/a", "you"), ("3", "h/b", "me"), ("4", "h/c", "me"), ("5", "h/d", "me"), ("6", "h/e", "me"), ("7", "h/f", "me"), ("8", "none", "me"), ("9", None, "me")], "claim string, address string, owner string")
    found = {r.claim: (r.repository_id, r.status) for r in de.bindings(claims, repos).collect()}
    assert found == {"1": ("a", "BOUND"), "2": (None, "CONFLICT"), "3": ("b", "BOUND"), "4": (None, "AMBIGUOUS"), "5": (None, "AMBIGUOUS"), "6": (None, "NOT_FOUND"), "7": ("f", "BOUND"), "8": (None, "NOT_FOUND"), "9": (None, "NOT_FOUND")}
