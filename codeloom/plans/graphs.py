"""Queries on the code graph. Searches start at every node one of whose rows has a seq divisible by 100, and run over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import rules as rl
from ..operators import structure as st
from ..operators import traverse as tr
from ..schema import dependency, stable_id
from ..session import materialize
from .sql import DEPENDENCY_LIST, graph_sql


def starts(graph: PropertyGraph) -> DataFrame:
    """The stated set of start nodes."""
    return graph.nodes.where((F.col("seq") % 100 == 0) & F.col("id").isNotNull()).select("id").distinct()


def schema_stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of files and directories from their parts."""
    nodes = PropertyGraph.read(spark, folder).node_view("id", "type", "repository_id", "file_path").where(F.col("type").isin("File", "Directory"))
    key = F.when(F.col("type") == "File", stable_id("repository_id", "file_path")).otherwise(stable_id("repository_id", F.lit("dir"), "file_path"))
    return nodes.select("id", "type", key.alias("key"))


def prj_01_public_node(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes without source and embedding; neither is read."""
    return PropertyGraph.read(spark, folder).node_view("id", "name", "type", "repository_id", "qualified_name", "file_path", "start_line", "end_line", "signature", "module", "exported")


def flt_01_dependency_edges(spark: SparkSession, folder: str) -> DataFrame:
    return PropertyGraph.read(spark, folder).dependencies()


def flt_02_symbol_view(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the symbol view with their component."""
    return st.groups(PropertyGraph.read(spark, folder))


def flt_03_typed_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of two types both ends of which are functions, methods or classes."""
    graph = PropertyGraph.read(spark, folder)
    kept = graph.node_view("id", "type").where(F.col("type").isin("Function", "Method", "Class")).select("id")
    edges = graph.edge_view("id", "source", "target", "type").where(F.col("type").isin("CALLS", "DEFINES"))
    return edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target", "type")


def agg_01_counts_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return st.counts_by_type(PropertyGraph.read(spark, folder))


def agg_02_totals(spark: SparkSession, folder: str) -> DataFrame:
    return st.totals(PropertyGraph.read(spark, folder))


def agg_03_files_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return st.files_by_language(PropertyGraph.read(spark, folder))


def agg_04_largest_modules(spark: SparkSession, folder: str) -> DataFrame:
    return st.largest_modules(PropertyGraph.read(spark, folder))


def agg_05_hubs(spark: SparkSession, folder: str) -> DataFrame:
    return st.hubs(PropertyGraph.read(spark, folder))


def agg_06_potentially_unused(spark: SparkSession, folder: str) -> DataFrame:
    return st.potentially_unused(PropertyGraph.read(spark, folder))


def grf_01_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of any type among the first 250 nodes of each repository, by seq."""
    graph = PropertyGraph.read(spark, folder)
    nodes = graph.node_view("id", "repository_id", "seq")
    listed = nodes.select(F.col("repository_id").alias("seed"), "id", F.col("seq").alias("at"))
    return tr.induced_edges(tr.first_seen(listed, nodes), graph.edge_view("id", "source", "target", "type").withColumnRenamed("id", "edge_id")).select("seed", "edge_id", "source", "target", "type")


def _near(direction: str, depth: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = PropertyGraph.read(spark, folder)
        return tr.neighbourhood(graph, starts(graph), depth, direction=direction, limit=None)

    query.__doc__ = f"Nodes within {depth} hops over all edges, direction {direction}; nothing is cut."
    return query


grf_02_neighbors_in, grf_02_neighbors_out, grf_02_neighbors_both = _near("in", 5), _near("out", 5), _near("both", 2)


def grf_02_limited(spark: SparkSession, folder: str) -> DataFrame:
    """One hop around each start, of which the first 20 nodes are returned."""
    graph = PropertyGraph.read(spark, folder)
    return tr.neighbourhood(graph, starts(graph), 1, limit=20).select("seed", "id", "place", "total")


def grf_03_path_length(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of a shortest dependency path, in either direction, from each start to the hubs of its repository."""
    graph = PropertyGraph.read(spark, folder)
    hubs = st.hubs(graph).select("repository_id", F.col("id").alias("target"))
    pairs = starts(graph).join(graph.node_view("id", "repository_id"), "id").select(F.col("id").alias("source"), "repository_id").join(hubs, "repository_id").select("source", "target")
    return tr.path_lengths(graph, pairs, directed=False)


def grf_04_trace_sinks(spark: SparkSession, folder: str) -> DataFrame:
    graph = PropertyGraph.read(spark, folder)
    return tr.traces(graph, starts(graph))


def grf_05_impact(spark: SparkSession, folder: str) -> DataFrame:
    graph = PropertyGraph.read(spark, folder)
    return tr.impacts(graph, starts(graph))


def grf_05c_direct_callers(spark: SparkSession, folder: str) -> DataFrame:
    graph = PropertyGraph.read(spark, folder)
    return tr.direct_callers(graph, starts(graph))


def grf_06_cyclic_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Strongly connected components of the dependencies of all repositories."""
    return st.cyclic_nodes(PropertyGraph.read(spark, folder).dependencies())


def _closed(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph with a link back from the end of each walk of two dependencies to its start, where both are in one file: a graph
    with many cycles, as the delivered ones have hardly any."""
    graph = PropertyGraph.read(spark, folder)
    links, at = graph.dependencies(), graph.node_view("id", "repository_id", "file_path").where("file_path <> ''")
    walks = links.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(links.select(F.col("src").alias("m"), F.col("dst").alias("c")), "m").where("a <> c").select("a", "c").distinct()
    ends = lambda x: at.select(F.col("id").alias(x), F.struct("repository_id", "file_path").alias(f"of_{x}"))
    back = walks.join(ends("a"), "a").join(ends("c"), "c").where("of_a = of_c")
    fields = {"seq": F.lit(0).cast("long"), "id": stable_id("c", "a"), "source": F.col("c"), "target": F.col("a"), "type": F.lit("CALLS"), "source_file": F.col("of_a.file_path"), "source_line": F.lit(1), "confidence": F.lit(1.0), "resolution": F.lit("resolved"), "analysis_method": F.lit("closing")}
    return PropertyGraph(graph.nodes, materialize(graph.edges.unionByName(back.select(*[v.alias(k) for k, v in fields.items()])), "closed-edges"))


def grf_06_closed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Strongly connected components of the graph with closing links."""
    return st.cyclic_nodes(_closed(spark, folder).dependencies())


def grf_06_closed_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Length of a shortest cycle through the smallest id of each component of the graph with closing links."""
    return st.cycles(_closed(spark, folder), None).select("repository_id", "component", "size", (F.size("path") - 1).alias("length"))


def pol_03_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles of the graph with closing links that a rule forbids, at most 20 of a repository, with the number of their steps."""
    rules = rl.validated({"version": 1, "rules": [{"id": "acyclic", "type": "no_cycles"}]})
    return rl.cycle_violations(_closed(spark, folder), rules).select("repository_id", "rule_id", F.col("path")[0].alias("component"), F.size("evidence").alias("n_steps"))


def grf_06_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Length of a shortest cycle through the smallest id of each cyclic component."""
    return st.cycles(PropertyGraph.read(spark, folder), None).select("repository_id", "component", "size", (F.size("path") - 1).alias("length"))


def grf_07_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Overview of each repository, maps and lists as text."""
    rows = st.overview(PropertyGraph.read(spark, folder))
    return rows.select("repository_id", "files", "lines", "nodes", "relationships", "unresolved", F.to_json("counts").alias("counts"), F.to_json("languages").alias("languages"), F.to_json("largest_modules").alias("largest_modules"), F.size("hubs").alias("n_hubs"), F.coalesce(F.size("cycles"), F.lit(0)).alias("n_cycles"))


def grf_08_components(spark: SparkSession, folder: str) -> DataFrame:
    return st.components(PropertyGraph.read(spark, folder))


def grf_08_component_edges(spark: SparkSession, folder: str) -> DataFrame:
    return st.component_edges(PropertyGraph.read(spark, folder)).withColumn("evidence", F.array_join("evidence", ","))


def grf_09_symbol_edges(spark: SparkSession, folder: str) -> DataFrame:
    graph = PropertyGraph.read(spark, folder)
    return tr.symbol_edges(graph, starts(graph))


def grf_10_callers_callees(spark: SparkSession, folder: str) -> DataFrame:
    graph = PropertyGraph.read(spark, folder)
    return tr.calls_around(graph, starts(graph))


def grf_11_path_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the two-step walks over edges of any type and resolution are dependency paths."""
    graph = PropertyGraph.read(spark, folder)
    links = graph.links("CALLS", "DEFINES")
    calls = graph.links("CALLS")
    walks = links.join(calls.select(F.col("src").alias("mid"), F.col("dst").alias("end")), F.col("dst") == F.col("mid")).select(F.concat_ws(">", "src", "mid", "end").alias("path_id"), F.array("src", "mid", "end").alias("path"))
    return tr.valid_paths(graph, walks)


def grf_13_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes around the first twelve nodes of each file, merged."""
    graph = PropertyGraph.read(spark, folder)
    nodes = graph.node_view("id", "repository_id", "file_path", "seq").where("file_path <> ''")
    return tr.evidence_neighbourhood(graph, nodes.select(F.concat_ws(":", "repository_id", "file_path").alias("answer"), "id", F.col("seq").alias("at")))


def join_13_edge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of which both ends exist, with the types of the ends."""
    graph = PropertyGraph.read(spark, folder)
    nodes = graph.node_view("id", "type")
    edges = graph.edge_view("id", "source", "target", "type", "resolution").withColumn("dependency", dependency())
    return edges.join(nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target").groupBy("source_type", "type", "target_type", "dependency").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (schema_stable_ids, prj_01_public_node, flt_01_dependency_edges, flt_02_symbol_view, flt_03_typed_subgraph, agg_01_counts_by_type, agg_02_totals, agg_03_files_by_language, agg_04_largest_modules, agg_05_hubs, agg_06_potentially_unused, grf_01_subgraph, grf_02_limited, grf_03_path_length, grf_04_trace_sinks, grf_05_impact, grf_05c_direct_callers, grf_06_cyclic_nodes, grf_06_cycles, grf_06_closed_nodes, grf_06_closed_cycles, pol_03_closed, grf_07_overview, grf_08_components, grf_08_component_edges, grf_09_symbol_edges, grf_10_callers_callees, grf_11_path_check, grf_13_evidence, join_13_edge_rows)}
QUERIES |= {"grf_02_neighbors_in": grf_02_neighbors_in, "grf_02_neighbors_out": grf_02_neighbors_out, "grf_02_neighbors_both": grf_02_neighbors_both}

_GROUPS = "g AS (SELECT id, repository_id, CASE WHEN type = 'ExternalPackage' THEN 'External packages' WHEN type = 'DatabaseEntity' THEN 'Database' WHEN coalesce(module, '') <> '' THEN module ELSE 'root' END AS component FROM n WHERE type NOT IN ('Repository', 'Directory', 'UnresolvedSymbol'))"
_COMPONENTS = _GROUPS + """, c AS (SELECT repository_id, component, substr(sha256(repository_id || ':architecture:' || component), 1, 24) AS component_id, count(*) AS n FROM g GROUP BY repository_id, component
  QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY component) <= 100)"""
_DEGREE = "k AS (SELECT n.id, n.repository_id, (SELECT count(*) FROM d WHERE d.src = n.id) + (SELECT count(*) FROM d WHERE d.dst = n.id) AS degree FROM n)"
_MEMBERS = "m(seed, id, lvl) AS (SELECT s.id, s.id, 0 FROM s JOIN n ON n.id = s.id UNION SELECT m.seed, x.target, m.lvl + 1 FROM m JOIN n q ON q.id = m.seed JOIN code_edges x ON x.source = m.id AND x.type IN ('DEFINES', 'CONTAINS') WHERE m.lvl < 3 AND q.type IN ('File', 'Class', 'Interface')), sel AS (SELECT DISTINCT seed, id FROM m)"

#: Tables that end in f (features of the impact of each start in s), and the scored rows.
IMPACT_TABLES = (
    _MEMBERS
        + """, w(seed, id, hop) AS (SELECT seed, id, 0 FROM sel UNION SELECT w.seed, d.src, w.hop + 1 FROM w JOIN d ON d.dst = w.id WHERE w.hop < 8),
        r AS (SELECT seed, id, min(hop) AS hops FROM w GROUP BY seed, id), dep AS (SELECT r.* FROM r ANTI JOIN sel USING (seed, id)),
        a AS (SELECT dep.seed, count(*) FILTER (hops = 1) AS n_direct, count(*) FILTER (hops > 1) AS n_transitive, count(*) AS blast_radius, count(*) FILTER (type = 'Endpoint') AS n_endpoints,
              count(DISTINCT nullif(file_path, '')) AS n_files, count(DISTINCT nullif(module, '')) AS n_modules FROM dep JOIN n ON n.id = dep.id GROUP BY 1),
        b AS (SELECT r.seed, count(DISTINCT x.target) AS n_tables, count(DISTINCT x.target) FILTER (x.type = 'WRITES_TO') AS n_writes FROM r JOIN code_edges x ON x.source = r.id AND x.type IN ('READS_FROM', 'WRITES_TO') GROUP BY 1),
        c AS (SELECT z.seed, coalesce(n_direct, 0) AS n_direct, coalesce(n_transitive, 0) AS n_transitive, coalesce(blast_radius, 0) AS blast_radius, coalesce(n_endpoints, 0) AS n_endpoints, coalesce(n_files, 0) AS n_files,
              coalesce(n_modules, 0) AS n_modules, coalesce(n_tables, 0) AS n_tables, coalesce(n_writes, 0) AS n_writes, depth FROM (SELECT seed, max(hops)::BIGINT AS depth FROM r GROUP BY 1) z LEFT JOIN a USING (seed) LEFT JOIN b USING (seed)),
        f AS (SELECT *, least(4 * n_direct, 20)::INT AS f_direct, least(2 * n_transitive, 25)::INT AS f_transitive, least(5 * n_endpoints, 20)::INT AS f_endpoints,
              least(3 * greatest(n_modules - 1, 0), 15)::INT AS f_modules, least(5 * n_writes, 10)::INT AS f_writes, least(2 * depth, 10)::INT AS f_depth FROM c)"""
)
IMPACT_ROWS = """SELECT *, f_direct + f_transitive + f_endpoints + f_modules + f_writes + f_depth AS score,
             CASE WHEN f_direct + f_transitive + f_endpoints + f_modules + f_writes + f_depth >= 65 THEN 'HIGH' WHEN f_direct + f_transitive + f_endpoints + f_modules + f_writes + f_depth >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM f"""


def _walk(links: str, depth: int) -> str:
    return f"l AS ({links}), w(seed, id, hop) AS (SELECT s.id, s.id, 0 FROM s JOIN n ON n.id = s.id UNION SELECT w.seed, l.dst, w.hop + 1 FROM w JOIN l ON l.src = w.id WHERE w.hop < {depth}), r AS (SELECT seed, id, min(hop) AS hops FROM w GROUP BY seed, id)"


_CLOSED = """z AS (SELECT src, dst FROM d UNION SELECT y.dst, x.src FROM d x JOIN d y ON y.src = x.dst JOIN n a ON a.id = x.src JOIN n c ON c.id = y.dst
    WHERE x.src <> y.dst AND a.file_path <> '' AND a.repository_id = c.repository_id AND a.file_path = c.file_path),
  w(a, b, len) AS (SELECT src, dst, 1 FROM z UNION SELECT w.a, z.dst, w.len + 1 FROM w JOIN z ON z.src = w.b WHERE w.len < 12),
  m AS (SELECT a, b, min(len) AS len FROM w GROUP BY a, b), scc AS (SELECT p.a AS id, least(p.a, min(p.b)) AS component FROM m p JOIN m q ON q.a = p.b AND q.b = p.a GROUP BY p.a)"""
_CLOSED_CYCLES = "SELECT n.repository_id, s.component, s.size, m.len AS length FROM (SELECT component, count(*) AS size FROM scc GROUP BY component) s JOIN n ON n.id = s.component JOIN m ON m.a = s.component AND m.b = s.component"


_OUT = "SELECT DISTINCT source AS src, target AS dst FROM code_edges"
_IN = "SELECT DISTINCT target AS src, source AS dst FROM code_edges"

ORACLES = {
    "schema_stable_ids": graph_sql("SELECT id, type, substr(sha256(CASE WHEN type = 'File' THEN repository_id || ':' || file_path ELSE repository_id || ':dir:' || file_path END), 1, 24) AS key FROM n WHERE type IN ('File', 'Directory')"),
    "prj_01_public_node": graph_sql("SELECT id, name, type, repository_id, qualified_name, file_path, start_line, end_line, signature, module, exported FROM n"),
    "flt_01_dependency_edges": graph_sql("SELECT src, dst FROM d"),
    "flt_02_symbol_view": graph_sql("SELECT id, repository_id, component FROM g", _GROUPS),
    "flt_03_typed_subgraph": graph_sql("SELECT id, source, target, type FROM e WHERE type IN ('CALLS', 'DEFINES') AND source IN (SELECT id FROM n WHERE type IN ('Function', 'Method', 'Class')) AND target IN (SELECT id FROM n WHERE type IN ('Function', 'Method', 'Class'))"),
    "agg_01_counts_by_type": graph_sql("SELECT repository_id, type, count(*) AS n FROM n GROUP BY ALL"),
    "agg_02_totals": graph_sql(
        "SELECT n.repository_id, count(*) FILTER (type = 'File') AS files, coalesce(sum(end_line) FILTER (type = 'File'), 0)::BIGINT AS lines, count(*) AS nodes, coalesce(any_value(x.relationships), 0) AS relationships, coalesce(any_value(x.unresolved), 0) AS unresolved "
        "FROM n LEFT JOIN (SELECT n.repository_id, count(*) AS relationships, count(*) FILTER (e.resolution = 'unresolved') AS unresolved FROM e JOIN n ON n.id = e.source GROUP BY 1) x ON x.repository_id = n.repository_id GROUP BY n.repository_id"
    ),
    "agg_03_files_by_language": graph_sql("SELECT repository_id, coalesce(language, '') AS language, count(*) AS n FROM n WHERE type = 'File' GROUP BY ALL"),
    "agg_04_largest_modules": graph_sql("SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, module) AS place FROM (SELECT repository_id, module, count(*) AS n FROM n WHERE type = 'File' GROUP BY ALL) QUALIFY place <= 10"),
    "agg_05_hubs": graph_sql("SELECT repository_id, id, degree, row_number() OVER (PARTITION BY repository_id ORDER BY degree DESC, id) AS place FROM k QUALIFY place <= 10", _DEGREE),
    "agg_06_potentially_unused": graph_sql("SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY seq, id) AS place FROM n WHERE type IN ('Function', 'Method') AND NOT regexp_matches(coalesce(name, ''), '^(__|callback@)') AND id NOT IN (SELECT dst FROM d) QUALIFY place <= 50"),
    "grf_01_subgraph": graph_sql("SELECT a.repository_id AS seed, e.id AS edge_id, e.source, e.target, e.type FROM e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target AND b.repository_id = a.repository_id", "p AS (SELECT id, repository_id FROM n QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY seq, id) <= 250)"),
    "grf_02_limited": graph_sql("SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY (id <> seed)::INT, id) AS place, count(*) OVER (PARTITION BY seed) AS total FROM r QUALIFY place <= 20", _walk(f"{_OUT} UNION {_IN}", 1)),
    "grf_02_neighbors_in": graph_sql("SELECT seed, id, hops FROM r", _walk(_IN, 5)),
    "grf_02_neighbors_out": graph_sql("SELECT seed, id, hops FROM r", _walk(_OUT, 5)),
    "grf_02_neighbors_both": graph_sql("SELECT seed, id, hops FROM r", _walk(f"{_OUT} UNION {_IN}", 2)),
    "grf_03_path_length": graph_sql(
        "SELECT r.seed AS source, r.id AS target, r.hops + 1 AS length FROM r JOIN n ON n.id = r.seed JOIN h ON h.id = r.id AND h.repository_id = n.repository_id",
        _DEGREE + ", h AS (SELECT id, repository_id FROM k QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY degree DESC, id) <= 10), " + _walk("SELECT src, dst FROM d UNION SELECT dst, src FROM d", 15),
    ),
    "grf_04_trace_sinks": graph_sql("SELECT r.seed, r.id, r.hops, row_number() OVER (PARTITION BY r.seed ORDER BY r.hops DESC, r.id) AS place FROM r JOIN n ON n.id = r.id WHERE n.type IN ('DatabaseEntity', 'ExternalPackage') OR (r.hops > 0 AND r.id NOT IN (SELECT src FROM d)) QUALIFY place <= 25", _walk("SELECT src, dst FROM d", 8)),
    "grf_05_impact": graph_sql(IMPACT_ROWS, IMPACT_TABLES),
    "grf_05c_direct_callers": graph_sql("SELECT DISTINCT sel.seed, x.source AS caller FROM sel JOIN code_edges x ON x.target = sel.id WHERE x.type = 'CALLS' AND x.resolution <> 'unresolved' AND (sel.seed, x.source) NOT IN (SELECT seed, id FROM sel)", _MEMBERS),
    "grf_08_components": graph_sql("SELECT repository_id, component, component_id, n FROM c", _COMPONENTS),
    "grf_08_component_edges": graph_sql(
        f"""SELECT a.repository_id, a.component AS source_component, b.component AS target_component, substr(sha256(any_value(p.component_id) || ':' || any_value(q.component_id)), 1, 24) AS id, count(*) AS n,
            CASE WHEN bool_and(e.resolution = 'resolved') THEN 'resolved' ELSE 'probable' END AS resolution, array_to_string(list_sort(list(e.id))[1:20], ',') AS evidence
            FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target JOIN c p ON p.repository_id = a.repository_id AND p.component = a.component JOIN c q ON q.repository_id = b.repository_id AND q.component = b.component
            WHERE e.type IN ({DEPENDENCY_LIST}) AND coalesce(e.resolution, '') <> 'unresolved' AND (a.component <> b.component OR a.repository_id <> b.repository_id) GROUP BY a.repository_id, b.repository_id, a.component, b.component""",
        _COMPONENTS,
    ),
    "grf_09_symbol_edges": graph_sql(
        "SELECT seed, direction, id, type, other FROM (SELECT s.id AS seed, 'in' AS direction, e.id, e.type, e.source AS other, e.seq FROM e JOIN s ON s.id = e.target UNION ALL SELECT s.id, 'out', e.id, e.type, e.target, e.seq FROM e JOIN s ON s.id = e.source) QUALIFY row_number() OVER (PARTITION BY seed, direction ORDER BY seq, id) <= 100"
    ),
    "grf_10_callers_callees": graph_sql(
        "SELECT seed, direction, other FROM (SELECT DISTINCT s.id AS seed, 'caller' AS direction, x.source AS other FROM s JOIN code_edges x ON x.target = s.id AND x.type = 'CALLS' UNION ALL SELECT DISTINCT s.id, 'callee', x.target FROM s JOIN code_edges x ON x.source = s.id AND x.type = 'CALLS') WHERE other <> seed QUALIFY row_number() OVER (PARTITION BY seed, direction ORDER BY other) <= 50"
    ),
    "grf_11_path_check": graph_sql(
        "SELECT a.src || '>' || b.src || '>' || b.dst AS path_id, ((a.src, a.dst) IN (SELECT src, dst FROM d) AND (b.src, b.dst) IN (SELECT src, dst FROM d)) AS valid FROM (SELECT DISTINCT source AS src, target AS dst FROM code_edges WHERE type IN ('CALLS', 'DEFINES')) a JOIN (SELECT DISTINCT source AS src, target AS dst FROM code_edges WHERE type = 'CALLS') b ON b.src = a.dst"
    ),
    "grf_13_evidence": graph_sql(
        f"SELECT DISTINCT a.answer, x.id FROM a JOIN (SELECT id AS seed, id FROM n UNION SELECT src, dst FROM ({_OUT} UNION {_IN})) x ON x.seed = a.id JOIN n ON n.id = x.id",
        "a AS (SELECT repository_id || ':' || file_path AS answer, id FROM n WHERE file_path <> '' QUALIFY row_number() OVER (PARTITION BY repository_id, file_path ORDER BY seq, id) <= 12)",
    ),
    "join_13_edge_rows": graph_sql(f"SELECT a.type AS source_type, e.type, b.type AS target_type, (e.type IN ({DEPENDENCY_LIST}) AND coalesce(e.resolution, '') <> 'unresolved') AS dependency, count(*) AS n FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target GROUP BY ALL"),
    "grf_06_closed_nodes": graph_sql("SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM scc", _CLOSED),
    "grf_06_closed_cycles": graph_sql(_CLOSED_CYCLES, _CLOSED),
    "pol_03_closed": graph_sql(f"SELECT repository_id, 'acyclic' AS rule_id, component, length AS n_steps FROM ({_CLOSED_CYCLES}) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY component) <= 20", _CLOSED),
    "grf_06_cyclic_nodes": graph_sql(
        "SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT a.a AS id, least(a.a, min(a.b)) AS component FROM w a JOIN w b ON b.a = a.b AND b.b = a.a GROUP BY a.a)",
        "w(a, b) AS (SELECT src, dst FROM d UNION SELECT w.a, d.dst FROM w JOIN d ON d.src = w.b)",
    ),
}
