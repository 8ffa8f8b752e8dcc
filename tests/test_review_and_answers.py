"""Reviews, plan evidence, seeds, routes and grounding of answers, on small graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators import answers, review, rules, structure
from codeloom.operators.traverse import impacts
from codeloom.schema import EDGES, NODES


@pytest.fixture(scope="module")
def graph(spark):
    """core is called by a and b, a by a route and a test, b writes an entity; lone stands alone, tests/t.py tests a."""
    row = lambda i, t="Function", path="src/m.py", module="src": (0, i, i, t, "r", i, path, "Python", 1, 9, "", "", "", "", module, False, "", "", [])
    edge = lambda s, t, kind="CALLS": (0, f"{s}-{t}", s, t, kind, "", 1, 1.0, "resolved", "syntax")
    nodes = [row("core"), row("aaa"), row("bbb", path="src/n.py"), row("GET /x", "Endpoint", "src/api.py"), row("t1", path="tests/test_a.py", module="tests"), row("ent", "DatabaseEntity"), row("lone", path="src/lone.py"), row("file", "File")]
    edges = [edge("aaa", "core"), edge("bbb", "core"), edge("GET /x", "aaa", "HANDLES"), edge("t1", "aaa"), edge("bbb", "ent", "WRITES_TO")]
    return PropertyGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_parts_and_paths(spark, graph):
    parts = {(r.id, r.part, r.hops) for r in review.impact_parts(graph, ids(spark, "core", "nowhere")).collect()}
    assert parts == {("core", "selected", 0), ("aaa", "dependent", 1), ("bbb", "dependent", 1), ("GET /x", "dependent", 2), ("t1", "dependent", 2), ("ent", "database", None)}
    paths = [tuple(r.path) for r in review.impact_paths(graph, ids(spark, "core"), 3).orderBy("place").collect()]
    assert paths == [("GET /x", "aaa", "core"), ("t1", "aaa", "core"), ("aaa", "core")]


def test_review(spark, graph):
    changed = spark.createDataFrame([("r", "src/m.py", "core"), ("r", "src/lone.py", "lone"), ("r", "src/m.py", "core")], "repository_id string, path string, id string")
    files = spark.createDataFrame([("r", "src/m.py"), ("r", "src/lone.py"), ("r", "gone.py"), ("r", "tests/test_b.py"), ("q", "x.py"), ("r", None)], "repository_id string, path string")
    found = review.review(graph, changed, files)
    rows = {r.repository_id: r for r in found.summary.collect()}
    assert (rows["r"].files_changed, rows["r"].symbols_changed, rows["r"].files_unmatched, rows["r"].n_tests, rows["r"].n_gaps, rows["r"].status) == (4, 2, 2, 2, 1, "ATTENTION")
    assert (rows["r"].affected_files, rows["r"].affected_endpoints) == (4, 1)
    assert (rows["q"].files_changed, rows["q"].files_unmatched, rows["q"].score, rows["q"].risk) == (1, 1, 0, "LOW")
    assert [(r.id, list(r.tests)) for r in found.findings.orderBy("place").collect()] == [("core", ["tests/test_a.py"]), ("lone", [])]
    assert [r.id for r in found.gaps.collect()] == ["lone"] and {r.id for r in found.shown.collect()} == {"core", "lone", "aaa", "bbb", "GET /x", "t1", "ent"}
    few = review.review(graph, changed, files, analysed=1, listed=1)
    assert [r.id for r in few.impacts.collect()] == ["lone"] and few.summary.where("repository_id = 'r'").first().truncated
    assert review.review(graph, changed.limit(0), files.limit(0)).summary.count() == 0


def test_plan_evidence_and_stages(spark, graph):
    evidence = review.plan_evidence(graph, ids(spark, "core", "lone")).collect()
    order = [(r.id, r.origin) for r in sorted((x for x in evidence if x.seed == "core"), key=lambda x: x.place)]
    assert order == [("core", "target"), ("aaa", "direct"), ("bbb", "direct"), ("GET /x", "endpoint"), ("ent", "database"), ("t1", "path")]
    assert [(r.id, r.origin) for r in evidence if r.seed == "lone"] == [("lone", "target")]
    stages = {(r.seed, r.name): list(r.evidence) for r in review.plan_stages(graph, review.plan_evidence(graph, ids(spark, "core", "lone"))).collect()}
    assert stages["core", "dependents"] == ["aaa", "bbb", "GET /x", "ent", "core"] and stages["core", "verification"] == ["t1", "GET /x", "ent", "core"]
    assert ("lone", "dependents") not in stages and stages["lone", "verification"] == ["lone"]
    assert review.plan_evidence(graph, ids(spark, "core"), 2).count() == 2 and review.plan_evidence(graph, ids(spark).limit(0)).count() == 0


def test_seeds(spark, graph):
    nodes = graph.node_view("id", "type", "name")
    asked = spark.createDataFrame([("q1", "Does bbb use core?", None), ("q2", "what does it do", None), ("q3", "what does it do", "lone"), ("q4", None, "lone"), ("q5", "aaa bbb core lone ent", None), ("q6", "hm", "nowhere")], "query_id string, query string, symbol_id string")
    hits = spark.createDataFrame([("q1", "lone", 1), ("q1", "core", 2), ("q2", "lone", 1), ("q4", "aaa", 1), ("q6", "aaa", 9)], "query_id string, id string, place int")
    held = spark.createDataFrame([("q2", "t1", 1), ("q2", "gone", 2), ("q3", "t1", 1), ("q1", "t1", 1)], "query_id string, id string, at int")
    found = {}
    for r in answers.seeds(asked, nodes, hits, held).orderBy("place").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {"q1": ["core", "bbb", "lone"], "q2": ["t1", "lone"], "q3": ["lone"], "q5": ["core", "lone", "aaa", "bbb"]}


def test_routes(spark):
    texts = ["What breaks?", "trace the call", "overview please", "who calls it", "what does checkout depend on", "what does it depend on; who uses it", "hello", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string").orderBy("i")
    assert [r.t for r in rows.select(answers.route(F.col("q")).alias("t")).collect()] == ["analyze_impact", "trace_endpoint", "repository_overview", "get_dependents", "get_dependencies", "get_dependencies", "get_neighbors", None]


def test_grounding(spark):
    schema = "answer_id string, intent string, text string, symbols array<string>, edge_ids array<string>, paths array<array<string>>"
    rows = [
        ("good", "path", "a reaches b", ["a"], ["e"], [["a", "b"], ["b"]]), ("figures", "impact", "4 callers", ["a"], [], []), ("risk", "impact", "a Medium risk", ["a"], [], []), ("other figures", "path", "4 callers", ["a"], [], []),
        ("none", "path", "x", [], [], []), ("null", "path", None, None, None, None), ("foreign", "path", "x", ["z"], [], []), ("edge", "path", "x", ["a"], ["f"], []), ("path", "path", "x", ["a"], [], [["b", "a"]]), ("walk", "path", "x", ["a"], [], [["a", "z"]]),
    ]
    seen = spark.createDataFrame([(r[0], k, i) for r in rows for k, i in (("node", "a"), ("node", "b"), ("edge", "e"))], "answer_id string, kind string, id string")
    links = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    found = {r.answer_id: r.reason for r in answers.grounded(spark.createDataFrame(rows, schema), seen, links).collect()}
    assert found == {"good": None, "figures": "metrics", "risk": "metrics", "other figures": None, "none": "symbols", "null": "symbols", "foreign": "symbols", "edge": "edges", "path": "paths", "walk": "paths"}


def test_facts_and_citations(spark, graph):
    facts = answers.impact_text(impacts(graph, ids(spark, "core")), graph.node_view("id", "name"))
    assert facts.first().fact.startswith("Impact of core: ") and "4 dependents (2 direct, 2 transitive)" in facts.first().fact
    text = answers.architecture_text(structure.overview(graph), graph.node_view("id", "name", "file_path")).first()
    assert text.fact.startswith("1 source files") and text.symbols[0] == "aaa" and "0 dependency cycles" in text.fact
    cited = spark.createDataFrame([("q", "core", 2), ("q", "aaa", 1), ("q", "core", 5), ("q", "nowhere", 0)], "answer_id string, id string, at int")
    assert [(r.place, r.id) for r in answers.citations(graph, cited).orderBy("place").collect()] == [(1, "aaa"), (2, "core")]


def test_review_of_a_head(spark):
    tree = {"app/a.py": "from lib.b import helper\n\ndef run():\n    return helper()\n", "lib/b.py": "def helper():\n    return 1\n", "tests/test_a.py": "from app.a import run\n\ndef test_run():\n    run()\n"}
    files = spark.createDataFrame([("r", p, t) for p, t in tree.items()], "repository_id string, file_path string, text string")
    patches = spark.createDataFrame([("r", "lib/b.py", None, "@@ -1,2 +1,2 @@"), ("r", "gone.py", None, None)], "repository_id string, path string, previous_path string, patch string")
    policy = rules.validated({"version": 1, "rules": [{"id": "no-lib", "type": "forbid_dependency", "from": "app/*", "to": "lib/*"}]})
    found, outcome = review.review_of_head(files, patches, policy)
    row = found.summary.first()
    assert (row.symbols_changed, row.files_unmatched, row.n_tests, row.n_gaps, row.affected_files) == (1, 1, 1, 0, 2)
    assert outcome.first().status == "FAIL" and [r.name for r in found.findings.collect()] == ["helper"]
