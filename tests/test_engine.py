"""The engine's tools, views and policy files."""

from __future__ import annotations

import pytest

from codeloom.engine import TOOLS, GraphEngine
from codeloom.graph import PropertyGraph
from codeloom.operators import rules
from codeloom.schema import EDGES, NODES


@pytest.fixture(scope="module")
def engine(spark):
    row = lambda i, t="Function", s="": (0, i, i, t, "r", i, f"{i}.py", "Python", 1, 2, "", s, "", "", "m", False, "", "", [])
    edge = lambda a, b: (0, a + b, a, b, "CALLS", "", 1, 1.0, "resolved", "syntax")
    return GraphEngine(PropertyGraph(spark.createDataFrame([row("a", s="x" * 9000), row("b"), row("c"), row("d", "Endpoint")], NODES), spark.createDataFrame([edge("a", "b"), edge("b", "c"), edge("d", "a")], EDGES)))


def test_tools(engine):
    assert set(engine.tools()) == set(TOOLS) and len(TOOLS) == 14
    ids = lambda df, c="id": {r[c] for r in df.collect()}
    assert ids(engine.run("get_symbol", {"symbol_id": "a"})) == {"a"} and len(engine.run("get_source", {"symbol_id": "a"}).first().source) == 6000
    assert ids(engine.run("find_callers", {"symbol_id": "b"})) == {"a", "b"} and ids(engine.run("find_callees", {"symbol_id": "b"})) == {"b", "c"}
    assert ids(engine.run("get_neighbors", {"symbol_id": "b"})) == {"a", "b", "c"} and ids(engine.run("get_neighbors", {"symbol_id": "b", "depth": 2})) == {"a", "b", "c", "d"}
    assert list(engine.run("shortest_path", {"source_id": "d", "target_id": "c"}).first().path) == ["d", "a", "b", "c"]
    assert ids(engine.run("get_dependencies", {"symbol_id": "d"})) == {"a", "b", "c", "d"} and engine.run("get_dependents", {"symbol_id": "c"}).first().blast_radius == 3
    assert ids(engine.run("trace_endpoint", {"endpoint_id": "d"})) == {"c"} and engine.run("analyze_impact", {"symbol_id": "c"}).first().n_endpoints == 1
    assert ids(engine.run("search_symbol", {"name": "b"})) == {"b"} and ids(engine.run("search_code", {"query": "xxx"})) == {"a"} and "b" in ids(engine.run("semantic_search", {"query": "b"}))
    assert engine.run("repository_overview", {}).first().nodes == 4


@pytest.mark.parametrize(
    ("tool", "arguments"),
    [("nothing", {}), ("get_symbol", {}), ("get_symbol", {"symbol_id": "zz"}), ("get_symbol", {"symbol_id": 1}), ("search_symbol", {"query": "b"}), ("trace_endpoint", {"symbol_id": "d"}), ("get_symbol", {"symbol_id": "a", "x": "y"}), ("search_code", {"query": "x" * 4001}), ("search_code", {"query": ""}), ("get_neighbors", {"symbol_id": "a", "depth": "2"}), ("repository_overview", {"x": 1})],
)
def test_refused_calls(engine, tool, arguments):
    with pytest.raises(ValueError):
        engine.run(tool, arguments)


def test_views(spark, engine):
    assert engine.register_views("t_") == ["t_nodes", "t_edges", "t_deps"]
    rows = spark.sql("SELECT n.name, count(*) AS n FROM t_deps d JOIN t_nodes n ON n.id = d.dst GROUP BY n.name ORDER BY n.name").collect()
    assert [(r.name, r.n) for r in rows] == [("a", 1), ("b", 1), ("c", 1)]


def test_policy_files(tmp_path):
    good = tmp_path / "policy.yml"
    good.write_text("version: 1\nrules:\n  - id: a\n    type: no_cycles\n    severity: warning\n")
    assert rules.read_policy([str(tmp_path / "none.yml"), str(good)])[0]["severity"] == "warning" and rules.read_policy([str(tmp_path / "none.yml")]) is None
    for text in ("version: 2", "a: [", "x" * 70_000):
        (tmp_path / "bad.yml").write_text(text)
        with pytest.raises(ValueError):
            rules.read_policy([str(tmp_path / "bad.yml")])


def test_files_sources_and_parts(spark):
    row = lambda i, t, path, module="m", s="": (0, i, i, t, "r", i, path, "Python", 1, 2, "", s, "", "", module, False, "", "", [])
    edge = lambda a, b, k: (0, a + b, a, b, k, "", 1, 1.0, "resolved", "syntax")
    nodes = [row("f", "File", "b.py", "", "x" * 9000), row("g", "File", "a.py"), row("h", "Function", "b.py"), row("i", "Function", "b.py")]
    graph = GraphEngine(PropertyGraph(spark.createDataFrame([*nodes, nodes[0]], NODES), spark.createDataFrame([edge("h", "i", "CALLS"), edge("f", "h", "DEFINES")], EDGES)))
    assert [(r.file_path, r.module) for r in graph.files("r").collect()] == [("a.py", "m"), ("b.py", "root")] and graph.files("q").count() == 0
    assert [len(r.source) for r in graph.source_at("r", "b.py").collect()] == [9000] and graph.source_at("r", "c.py").count() == 0
    part = graph.only("Function", "CALLS").graph
    assert part.nodes.count() == 2 and [r.id for r in part.edges.collect()] == ["hi"] and graph.only().graph.edges.count() == 2 and graph.only("Endpoint").graph.edges.count() == 0
