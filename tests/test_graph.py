"""Graph operators on small graphs."""

from __future__ import annotations

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom import schema
from codeloom.graph import PropertyGraph
from codeloom.operators import changes, rules, search, structure, traverse, versions
from codeloom.operators.resolve import directories, module_candidates, normal_path, resolve_modules
from codeloom.schema import EDGES, NODES, stable_id, stable_key
from codeloom.session import marked, sifted


def node(i, type_="Function", **kw):
    base = dict(seq=0, id=i, name=i, type=type_, repository_id="r", qualified_name=i, file_path=f"src/{i}.py", language="Python", start_line=1, end_line=9, signature="", source="", docstring="", hash="", module="m", exported=False, parameters="", returns="", embedding=[])
    base.update(kw)
    return tuple(base[f.name] for f in NODES)


def edge(a, b, type_="CALLS", resolution="resolved", seq=0):
    return (seq, f"{a}-{type_}-{b}", a, b, type_, f"src/{a}.py", 1, 1.0, resolution, "syntax")


def graph(spark, nodes, edges):
    return PropertyGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(scope="module")
def chain(spark):
    """a -> b -> c -> db, a File that defines a, an unresolved call, a self call, a repeated node and edge."""
    nodes = [node(x, seq=i) for i, x in enumerate("abc")] + [node("a", seq=9), node("db", "DatabaseEntity"), node("api", "Endpoint", module="n"), node("f", "File"), node("lone", "Method"), node("u", "UnresolvedSymbol"), node("__init__", "Method")]
    edges = [edge("a", "b"), edge("a", "b", seq=4), edge("a", "b", "REFERENCES"), edge("b", "c", resolution="probable"), edge("c", "db", "WRITES_TO"), edge("api", "a", "HANDLES"), edge("f", "a", "DEFINES"), edge("b", "u", resolution="unresolved"), edge("c", "c"), edge("x", "a"), edge("a", "x")]
    return graph(spark, nodes, edges)


def test_keys(spark):
    row = spark.range(1).select(stable_id(*[__import__("pyspark.sql.functions", fromlist=["lit"]).lit(x) for x in ("r", "dir", "ä/b")]).alias("k")).first()
    assert row.k == stable_key("r", "dir", "ä/b") and len(row.k) == 24


def test_neighbourhood(spark, chain):
    near = {(r.id, r.hops, r.place, r.total) for r in traverse.neighbourhood(chain, ids(spark, "b", "zz"), 1).collect()}
    assert near == {("b", 0, 1, 4), ("a", 1, 2, 4), ("c", 1, 3, 4), ("u", 1, 4, 4)}
    assert {r.id for r in traverse.neighbourhood(chain, ids(spark, "b"), 0).collect()} == {"b"}
    assert {r.id for r in traverse.neighbourhood(chain, ids(spark, "b"), 9, direction="out").collect()} == {"b", "c", "u", "db"}
    assert {r.id for r in traverse.neighbourhood(chain, ids(spark, "b"), 5, ("CALLS",), "in").collect()} == {"b", "a"}
    assert [r.id for r in traverse.neighbourhood(chain, ids(spark, "b"), 1, limit=2).orderBy("place").collect()] == ["b", "a"]
    assert traverse.neighbourhood(chain, ids(spark), 2).count() == 0
    with pytest.raises(ValueError):
        traverse.neighbourhood(chain, ids(spark, "b"), direction="up")


def test_paths_and_checks(spark, chain):
    pairs = spark.createDataFrame([("api", "db"), ("db", "api"), ("a", "a"), ("a", "zz"), (None, "a")], "source string, target string")
    found = {(r.source, r.target): list(r.path) for r in traverse.shortest_paths(chain, pairs).collect()}
    assert found == {("api", "db"): ["api", "a", "b", "c", "db"], ("a", "a"): ["a"]}
    assert {(r.source, r.length) for r in traverse.shortest_paths(chain, pairs, directed=False).collect()} == {("api", 5), ("db", 5), ("a", 1)}
    paths = spark.createDataFrame([(1, ["api", "a", "b"]), (2, ["a", "c"]), (3, ["a"]), (4, ["b", "u"])], "path_id int, path array<string>")
    assert {(r.path_id, r.valid) for r in traverse.valid_paths(chain, paths).collect()} == {(1, True), (2, False), (3, True), (4, False)}


def test_traces(spark, chain):
    rows = traverse.traces(chain, ids(spark, "api", "db", "lone"), with_paths=True).collect()
    assert {(r.seed, r.id, r.hops, tuple(r.path)) for r in rows} >= {("api", "db", 4, ("api", "a", "b", "c", "db")), ("db", "db", 0, ("db",))} and not [r for r in rows if r.seed == "lone"]


def test_impact(spark, chain):
    rows = {r.seed: r for r in traverse.impacts(chain, ids(spark, "c", "f", "lone", "zz")).collect()}
    assert set(rows) == {"c", "f", "lone"}
    c = rows["c"]
    assert (c.n_direct, c.n_transitive, c.n_endpoints, c.n_modules, c.n_writes, c.depth) == (1, 2, 1, 2, 1, 3)
    assert c.score == 4 + 4 + 5 + 3 + 5 + 6 and c.risk == "LOW"
    assert (rows["f"].n_direct, rows["f"].depth, rows["lone"].score) == (1, 1, 0)
    assert {(r.seed, r.caller) for r in traverse.direct_callers(chain, ids(spark, "c", "b")).collect()} == {("c", "b"), ("b", "a")}


def test_published_score_arithmetic(spark):
    columns = "seed string, n_direct long, n_transitive long, blast_radius long, n_endpoints long, n_files long, n_modules long, n_tables long, n_writes long, depth int"
    rows = spark.createDataFrame([("x", 2, 9, 11, 3, 3, 2, 0, 0, 4), ("y", 10, 2, 12, 0, 8, 2, 0, 0, 3)], columns)
    assert {(r.seed, r.score, r.risk) for r in traverse.score_impacts(rows).collect()} == {("x", 52, "MEDIUM"), ("y", 33, "MEDIUM")}


def test_subgraph_limits(spark, chain):
    listed = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "b", 3), ("s", "zz", 0), ("s", "c", 4)], "seed string, id string, at int")
    kept = traverse.first_seen(listed, chain.node_view("id"), 2)
    assert [(r.id, r.place, r.total) for r in kept.orderBy("place").collect()] == [("b", 1, 3), ("a", 2, 3)]
    assert {(r.source, r.target) for r in traverse.induced_edges(kept, chain.edge_view("id", "source", "target")).collect()} == {("a", "b")}
    assert {(r.seed, r.direction, r.other) for r in traverse.calls_around(chain, ids(spark, "b")).collect()} == {("b", "caller", "a"), ("b", "callee", "c"), ("b", "callee", "u")}
    assert {(r.direction, r.other) for r in traverse.symbol_edges(chain, ids(spark, "a"), 2).collect()} <= {("in", "api"), ("in", "f"), ("in", "x"), ("out", "b"), ("out", "x")}


def test_counts_hubs_and_unused(chain):
    totals = structure.totals(chain).first()
    assert (totals.files, totals.lines, totals.nodes, totals.unresolved) == (1, 9, 9, 1)
    assert {r.id: r.degree for r in structure.degrees(chain).collect()} == {"a": 4, "b": 2, "c": 4, "db": 1, "api": 1, "f": 0, "lone": 0, "u": 0, "__init__": 0}
    assert [r.id for r in structure.hubs(chain, 2).orderBy("place").collect()] == ["a", "c"]
    assert {r.id for r in structure.potentially_unused(chain).collect()} == {"lone"}


def cyclic(spark, pairs):
    names = sorted({x for p in pairs for x in p})
    return graph(spark, [node(n) for n in names], [edge(a, b) for a, b in pairs])


def test_cycles(spark):
    g = cyclic(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("e", "f"), ("b", "a"), ("f", "g")])
    members = {(r.id, r.component, r.size) for r in structure.cyclic_nodes(g.dependencies()).collect()}
    assert members == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2), ("s", "s", 1)}
    assert {tuple(r.path) for r in structure.cycles(g).collect()} == {("a", "b", "a"), ("d", "e", "d"), ("s", "s")}
    policy = rules.validated({"version": 1, "rules": [{"id": "c", "type": "no_cycles"}]})
    broken = rules.cycle_violations(g, policy)
    assert {tuple(r.evidence) for r in broken.collect()} == {("a-CALLS-b", "b-CALLS-a"), ("d-CALLS-e", "e-CALLS-d"), ("s-CALLS-s",)}


def tarjan(pairs):
    reach = {x: {x} for p in pairs for x in p}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    loops = {a for a, b in pairs if a == b}
    comp = {x: frozenset(y for y in reach[x] if x in reach[y]) for x in reach}
    return {(x, min(c), len(c)) for x, c in comp.items() if len(c) > 1 or x in loops}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=14))
def test_components_against_brute_force(spark, pairs):
    links = spark.createDataFrame(sorted(set(pairs)), "src string, dst string")
    assert {tuple(r) for r in structure.cyclic_nodes(links).select("id", "component", "size").collect()} == tarjan(pairs)


def test_overview_and_components(chain):
    row = structure.overview(chain).first()
    assert row.counts["Method"] == 2 and row.languages == {"Python": 1} and len(row.cycles) == 2
    assert {(r.component, r.n) for r in structure.components(chain).collect()} == {("m", 6), ("Database", 1), ("n", 1)}
    edges = {(r.source_component, r.target_component): (r.n, r.resolution, tuple(r.evidence)) for r in structure.component_edges(chain).collect()}
    assert edges == {("m", "Database"): (1, "resolved", ("c-WRITES_TO-db",)), ("n", "m"): (1, "resolved", ("api-HANDLES-a",))}


def test_version_changes(spark):
    base = spark.createDataFrame([node("s", hash="1"), node("gone"), node("same")], NODES)
    head = spark.createDataFrame([node("s", hash="2", docstring="x"), node("new", "Endpoint", file_path="src/routes.py"), node("same")], NODES)
    rows = versions.compare_nodes(base, head)
    assert {(r.id, r.change, tuple(r.changed_fields)) for r in rows.collect()} == {("s", "modified", ("hash", "docstring")), ("gone", "removed", ()), ("new", "added", ())}
    assert versions.compare_nodes(base, base).count() == 0
    edges = versions.compare_edges(spark.createDataFrame([edge("s", "gone"), edge("s", "same")], EDGES), spark.createDataFrame([edge("s", "same", resolution="probable")], EDGES), base)
    assert {(r.change, r.target_name, tuple(r.changed_fields)) for r in edges.collect()} == {("removed", "gone", ()), ("modified", "same", ("resolution",))}
    row = versions.risk(rows, edges).first()
    assert (row.symbols_added, row.symbols_removed, row.symbols_modified, row.n_files, row.n_endpoints, row.score, row.risk) == (1, 1, 1, 3, 1, 12 + 4 + 9 + 5 + 1, "MEDIUM")
    none = versions.risk(versions.compare_nodes(base, base), None).first()
    assert (none.score, none.risk) == (0, "LOW")
    shown = versions.evidence(rows, limit=2)
    assert [(r.id, r.truncated) for r in shown.collect()] == [("new", True), ("gone", True)]


def test_rules(spark, chain):
    good = {"version": 1, "rules": [{"id": "a", "type": "forbid_dependency", "from": "src/[ab].py", "to": "*/c*"}, {"id": "b", "type": "forbid_dependency", "severity": "warning", "from": "*", "to": "src/?b.py", "relationships": ["WRITES_TO"]}]}
    policy = rules.validated(good)
    found = rules.forbidden(chain, policy)
    assert {(r.rule_id, r.source, r.target, r.message) for r in found.collect()} == {("a", "b", "c", "src/b.py calls src/c.py"), ("b", "c", "db", "src/c.py writes to src/db.py")}
    row = rules.summary(found, policy, spark.createDataFrame([("r",), ("q",)], "repository_id string")).orderBy("repository_id").collect()
    assert [(r.repository_id, r.status, r.errors, r.warnings, r.passed) for r in row] == [("q", "PASS", 0, 0, 2), ("r", "FAIL", 1, 1, 0)]
    for bad in [{}, {"version": 1, "rules": []}, {"version": 1, "rules": [{"id": "A b"}]}, {"version": 1, "rules": [{"id": "a", "type": "x"}]}, {"version": 1, "rules": [{"id": "a", "type": "forbid_dependency", "from": "*"}]}, {"version": 1, "rules": [{"id": "a", "type": "no_cycles"}] * 2}]:
        with pytest.raises(ValueError):
            rules.validated(bad)
    globs = spark.createDataFrame([("a/b/c.py",), ("a.py\n",), ("A.py",), ("x[1].py",)], "p string")
    match = lambda g: {r.p for r in globs.where(rules.glob_match("p", g)).collect()}
    assert match("a*.py") == {"a/b/c.py"} and match("?.py") == {"A.py"} and match("x[[]1].py") == {"x[1].py"} and match("[!a]*") == {"A.py", "x[1].py"}


def test_changed_ranges_and_symbols(spark):
    patches = spark.createDataFrame([(1, "@@ -4,6 +8,3 @@ def\n x\n@@ -1 +2,0 @@\n"), (2, ""), (3, None), (4, "x @@ -1,2 +1,2 @@")], "k int, patch string")
    assert {tuple(r) for r in changes.changed_ranges(patches).collect()} == {(1, "base", 4, 9), (1, "head", 8, 10), (1, "base", 1, 1), (1, "head", 2, 2)}
    g = graph(spark, [node("f", "File", file_path="a.py"), node("x", file_path="a.py", start_line=1, end_line=5), node("y", file_path="a.py", start_line=6, end_line=9), node("o", "File", file_path="old.py"), node("z", file_path="old.py"), node("e", "File", file_path="empty.py")], [edge("y", "x")])
    files = spark.createDataFrame([("r", "a.py", None, "@@ -5,1 +5,1 @@"), ("r", "new.py", "old.py", ""), ("r", "empty.py", None, "@@ -1 +1 @@"), ("r", "lost.py", None, "@@ -1 +1 @@")], "repository_id string, path string, previous_path string, patch string")
    found = changes.changed_symbols(g, files)
    assert {(r.path, r.id, r.fallback) for r in found.collect()} == {("a.py", "x", False), ("new.py", "z", False), ("empty.py", "e", True)}
    top = changes.change_impacts(g, found)
    assert [(r.id, r.place) for r in top.orderBy("place").collect()][0] == ("x", 1)
    row = changes.roll_up(top, found).first()
    assert (row.files_changed, row.symbols_changed, row.risk) == (3, 3, "LOW")
    assert {r.id for r in changes.coverage_gaps(g, found).collect()} == {"x", "z", "e"}
    paths = spark.createDataFrame([("a/tests/x.py",), ("test_a.py",), ("a.SPEC.ts",), ("latest.py",), ("a/test.py",), (None,)], "p string")
    assert [r.t for r in paths.select(changes.is_test_path("p").alias("t")).collect()] == [True, True, True, False, False, False]


def test_search_modes(spark):
    nodes = spark.createDataFrame([node("1", name="Checkout", qualified_name="shop.Checkout", source="persist order"), node("2", name="order", docstring="of the Checkout"), node("3", "File", name="checkout.py", source="checkout order"), node("4", "Directory", name="checkout"), node("5", name="x", source=None)], NODES)
    asked = spark.createDataFrame([("q", " Checkout ", "r"), ("p", "where is the order", None), ("e", "nothing at all", "other")], "query_id string, query string, repository_id string")
    by = lambda mode, sim=None: {(r.query_id, r.id): (r.place, r.score, r.mechanism) for r in search.search(asked, nodes, mode, 10, sim).collect()}
    assert by("symbol")["q", "1"] == (1, 1.0, "symbol") and by("symbol")["q", "3"][1] == 0.65 and by("symbol")["p", "2"][1] == 0.9
    assert set(by("text")) == {("q", "1"), ("q", "2"), ("q", "3")}
    sim = spark.createDataFrame([("q", "2", 0.8), ("q", "3", 0.8)], "query_id string, id string, similarity double")
    assert by("semantic", sim) == {("q", "2"): (1, 0.83, "semantic"), ("q", "3"): (2, round(0.83 * 0.65, 4), "symbol")} and by("semantic") == {}
    assert by("hybrid", sim)["q", "1"][1] == 1.25
    with pytest.raises(ValueError):
        search.search(asked, nodes, "magic")


def _brute_search(asked, nodes, near, mode, k):
    """{query_id: [(id, score, semantic_score, mechanism)]} by Python over all pairs; near: {(query_id, id): similarity}."""
    half_up = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    out = {}
    for query, text, of in asked:
        q = text.lower().strip()
        words = [w for w in dict.fromkeys(re.findall(r"[a-z][a-z0-9_]+", q)) if w not in search.STOP_WORDS]
        hits = []
        for id_, kind, repository, name, source in nodes:
            if kind in search.NOT_SEARCHED or (of is not None and of != repository):
                continue
            exact = 1.0 if q == name.lower() else 0.9 if name.lower() in words else 0.65 if q in name.lower() else 0.0
            lexical = sum(w in source.lower() for w in words) / max(1, len(words))
            s, damp = near.get((query, id_), 0.0), 0.65 if kind == "File" else 1.0
            raw = (0.5 * s + 0.25 * lexical + exact) * damp if mode == "hybrid" else (0.85 * s + 0.15 * lexical) * damp if s > 0 else 0.0
            if raw > 0:
                hits.append((id_, half_up(raw), half_up(s), "symbol" if exact > 0 else "semantic" if s > 0 else "text"))
        if hits:
            out[query] = sorted(hits, key=lambda h: (-h[1], h[0]))[:k]
    return out


@pytest.mark.parametrize("mode", ["semantic", "hybrid"])
@pytest.mark.parametrize("most", [20_000, 40])
def test_blocks_of_a_search_give_the_best_of_all_pairs(spark, monkeypatch, mode, most):
    monkeypatch.setattr(search, "NODES_A_TASK", most)
    r = random.Random(5)
    words = ["order", "orders", "pay", "payment", "get_user", "user", "élan", "x9", "find", "File"]
    nodes = [(f"n{i:03d}", r.choice(["Function", "File", "Class", "Directory"]), r.choice("rs"), r.choice([*words, "get", ""]), r.choice([" ", "_", "\u00e9"]).join(r.choices(words, k=r.randrange(5)))) for i in range(300)]
    asked = [(f"q{i:02d}", " ".join(r.choices([*words, "where", "is"], k=r.randrange(4))), r.choice(["r", "s", "none", None])) for i in range(40)]
    near = {(f"q{i:02d}", f"n{j:03d}"): round(r.uniform(-0.2, 1), 4) for i in range(40) for j in r.sample(range(300), 20)}
    frame = spark.createDataFrame([node(i, t, repository_id=repo, name=name, source=source) for i, t, repo, name, source in nodes], NODES)
    queries = spark.createDataFrame(asked, "query_id string, query string, repository_id string")
    found: dict = {}
    for h in search.search(queries, frame, mode, 7, spark.createDataFrame([(*p, s) for p, s in near.items()], "query_id string, id string, similarity double")).orderBy("query_id", "place").collect():
        found.setdefault(h.query_id, []).append((h.id, h.score, h.semantic_score, h.mechanism))
        assert len(found[h.query_id]) == h.place
    assert found == _brute_search(asked, nodes, near, mode, 7)


@pytest.mark.parametrize("mode", ["semantic", "hybrid"])
def test_no_text_leaves_the_stage_that_scores(spark, mode):
    """All pairs of queries and nodes, with the nodes' texts, were shuffled for the sake of their similarities."""
    nodes = spark.createDataFrame([node(f"n{i:03d}", name="order", source="persist order " * 50) for i in range(200)], NODES)
    asked = spark.createDataFrame([(f"q{i}", "order", "r") for i in range(50)], "query_id string, query string, repository_id string")
    near = spark.createDataFrame([(f"q{i}", f"n{i:03d}", 0.5) for i in range(50)], "query_id string, id string, similarity double")
    tracked = search.search(asked, nodes, mode, 3, near)
    assert tracked.count() == (50 if mode == "semantic" else 150)
    plan = tracked._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join.*query_id", plan)


def shuffled_bytes(df):
    """Bytes that the last query of ``df`` shuffles, before compression."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("dataSize").value()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


@pytest.fixture
def no_small_broadcasts(spark):
    """Spark broadcasts nothing for its size, as with tables that are beyond its threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [100_000, 3])
def test_texts_are_not_shuffled_for_repeated_keys(spark, monkeypatch, no_small_broadcasts, most):
    """Beyond Spark's threshold for broadcasts all texts were shuffled to be joined with the repeated keys."""
    monkeypatch.setattr(schema, "BROADCAST_KEYS", most)
    rows = [node(f"n{i:04d}", source=f"{i} " * 200, seq=i) for i in range(1000)] + [node(f"n{i:04d}", source="later", seq=i + 2000) for i in range(0, 1000, 100)] + [node("n0001", source="old", seq=None), node(None, source="none", seq=9)]
    # one row for each id, also of two with one seq, and the same one each time
    tied = [node("t", source=s, seq=7) for s in ("b", "c", "a")]
    view = PropertyGraph(spark.createDataFrame(rows, NODES), None).node_view("id", "source")
    assert {r.id: r.source for r in view.collect()} == {f"n{i:04d}": "later" if i % 100 == 0 else f"{i} " * 200 for i in range(1000)} and view.count() == 1000
    assert shuffled_bytes(view) < 0.1 * sum(len(r[NODES.fieldNames().index("source")]) for r in rows)
    both = PropertyGraph(spark.createDataFrame(rows + tied, NODES), None).node_view("id", "source")
    assert both.count() == 1001 and {r.source for r in both.where("id = 't'").collect()} == {"c"}


def test_rows_are_sifted_by_few_keys(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) as id").unionByName(spark.createDataFrame([(None,)], "id string"))
    keys = rows.where("id % 50 = 0")
    assert keys.join(sifted(rows, keys), "id", "left_anti").isEmpty() and sifted(rows, keys).count() < 400 + 0.03 * 20_000
    assert marked(rows, keys).count() == 20_001 and marked(rows, keys).columns == ["id", "may_be"] and sifted(rows, keys.limit(0)).isEmpty()


def test_semantic_search_shuffles_texts_of_similar_nodes_only(spark, no_small_broadcasts):
    """The texts of all nodes were sent to the tasks that score."""
    nodes = spark.createDataFrame([node(f"n{i:03d}", name="order", source=f"persist order {i} " * 100) for i in range(500)], NODES)
    asked = spark.createDataFrame([("q", "order", "r")], "query_id string, query string, repository_id string")
    near = spark.createDataFrame([("q", "n007", 0.5), ("q", "n008", -0.5)], "query_id string, id string, similarity double")
    hits = search.search(asked, nodes, "semantic", 3, near)
    assert [(h.id, h.place) for h in hits.collect()] == [("n007", 1)]
    assert shuffled_bytes(hits) < 0.2 * 500 * len("persist order 100 " * 100)


def test_vectors(spark):
    vectors = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", [1.0, 1.0]), ("c", "r", [-1.0, 0.0]), ("d", "q", [1.0, 0.0]), ("z", "r", [0.0, 0.0]), ("s", "r", [1.0]), ("n", "r", None)], "id string, repository_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", "r", [2.0, 0.0]), ("bad", "r", [0.0, 0.0])], "query_id string, repository_id string, vector array<float>")
    assert [(r.id, r.score) for r in search.vector_search(asked, vectors, 3, 2).orderBy("place").collect()] == [("a", 1.0), ("b", 0.853553), ("c", 0.0)]
    texts = search.embedding_texts(spark.createDataFrame([node("f", "File", file_path="a.py", seq=0), node("g", file_path="a.py", signature="def g()", seq=2), node("C", "Class", file_path="a.py", signature="class C", seq=1), node("u", "UnresolvedSymbol")], NODES))
    found = {r.id: r.text for r in texts.collect()}
    assert found["f"] == "a.py\nclass C\ndef g()" and set(found) == {"f", "g", "C"}
    embedded = {r.id: r.embedding for r in search.hashed_embeddings(texts, 8).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in embedded.values())
    cache = spark.createDataFrame([("g", "", [1.0, 2.0]), ("f", "old", [1.0, 2.0]), ("C", "", [1.0])], "id string, hash string, embedding array<float>")
    kept, missing = search.reuse_vectors(texts, cache, 2)
    assert [r.id for r in kept.collect()] == ["g"] and {r.id for r in missing.collect()} == {"f", "C"}


def test_modules_and_folders(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/app/a.py", "src/app/b/__init__.py", "lib/x.ts", "lib/y/index.js", "top.py", "lib/z.tsx")], "repository_id string, file_path string")
    cases = {("src/app/a.py", ".b"): "src/app/b/__init__.py", ("src/app/a.py", "app.b"): "src/app/b/__init__.py", ("src/app/b/__init__.py", "..a"): "src/app/a.py", ("lib/x.ts", "./y"): "lib/y/index.js", ("lib/y/index.js", "../x.js"): "lib/x.ts", ("lib/x.ts", "./z.jsx"): "lib/z.tsx", ("src/app/a.py", "top"): "top.py"}
    others = {("lib/x.ts", "react/dom"): ("package", "react"), ("lib/x.ts", "@a/b/c"): ("package", "@a/b"), ("lib/x.ts", "./none"): ("unresolved", None), ("top.py", "os.path"): ("package", "os"), ("top.py", ".gone"): ("unresolved", None)}
    imports = spark.createDataFrame([("r", p, m) for p, m in [*cases, *others]], "repository_id string, file_path string, module string")
    found = {(r.file_path, r.module): r for r in resolve_modules(imports, files).collect()}
    assert {k: found[k].target_path for k in cases} == cases and {k: (found[k].kind, found[k].package) for k in others} == others
    paths = spark.createDataFrame([("a/./b/../c",), ("../a",), ("a//b",), ("./",)], "p string")
    assert [r.p for r in paths.select(normal_path(paths.p).alias("p")).collect()] == ["a/c", "../a", "a/b", ""]
    assert {(r.path, r.parent) for r in directories(files).collect()} == {("src", ""), ("src/app", "src"), ("src/app/b", "src/app"), ("lib", ""), ("lib/y", "lib")}
    assert files.limit(1).select(module_candidates(files.file_path, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x")).alias("c")).first().c[0] == "x.py"


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert structure.totals(g).count() == 0 and structure.hubs(g).count() == 0 and structure.cycles(g).count() == 0 and traverse.impacts(g, ids(spark, "a")).count() == 0
    assert rules.forbidden(g, []).count() == 0 and structure.component_edges(g).count() == 0
