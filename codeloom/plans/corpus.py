"""Queries on versions, rules, changes, search, files, retention and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..graph import PropertyGraph
from ..operators import answers as an
from ..operators import changes as ch
from ..operators import resolve as rs
from ..operators import review as rv
from ..operators import rules as rl
from ..operators import search as se
from ..operators import versions as ve
from ..operators.snapshot_changes import snapshot_order
from ..operators.structure import overview
from ..operators.traverse import impacts
from ..schema import latest
from ..session import materialize, sifted
from ..sources import trees
from ..sources.snapshots import active, merged, newest, public_repositories, visible_to
from ..sources.tables import table
from ..streaming import deliveries as de
from .graphs import IMPACT_ROWS, IMPACT_TABLES, starts
from .sql import DEPENDENCY_LIST, GRAPH, graph_sql

#: Fields in which the derived base of a comparison differs.
MOVED = ("hash", "start_line", "end_line", "signature", "docstring")
SNAPSHOT_FIELDS = ("type", "file_path", "start_line", "end_line", "hash")


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of every snapshot but the last of its repository (as base), and of every one but the first (as head), keyed by the
    later commit and id."""
    order = snapshot_order(table(spark, folder, "graph_snapshots"))
    rows = table(spark, folder, "snapshot_nodes").where("id is not null and commit_sha is not null")
    hash_ = F.lower(F.btrim(F.coalesce("hash", F.lit("")), F.lit(" \t\r\n\f\v"))).alias("hash")
    rows = rows.select("seq", "commit_sha", "id", "type", "file_path", "start_line", "end_line", hash_)
    one = rows.groupBy("commit_sha", "id").agg(F.max_by(F.struct(*SNAPSHOT_FIELDS), "seq").alias("x")).select("commit_sha", "id", "x.*")
    placed = materialize(one.join(order, "commit_sha"), "snapshot-rows")
    later = order.select("repository_id", (F.col("ord") - 1).alias("ord"), F.col("commit_sha").alias("head_sha"))
    base = placed.drop("commit_sha").join(later, ["repository_id", "ord"]).select("head_sha", "id", *SNAPSHOT_FIELDS)
    head = placed.where("ord > 0").select(F.col("commit_sha").alias("head_sha"), "id", *SNAPSHOT_FIELDS)
    return base, head


def _node_changes(spark: SparkSession, folder: str) -> DataFrame:
    base, head = _pairs(spark, folder)
    return ve.compare_rows(base, head, SNAPSHOT_FIELDS, keys=("head_sha", "id"), keep=("type", "file_path", "start_line", "end_line"))


def dif_01_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes added, removed or modified in any field between consecutive snapshots."""
    return _node_changes(spark, folder).select("head_sha", "id", "change", F.array_join("changed_fields", ",").alias("changed_fields"))


def dif_01_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The graph against a derived base, in all fields of nodes: of each node the base holds what the next node of its file and type
    holds (signature, docstring, hash, lines); nodes without a next one are new."""
    nodes = PropertyGraph.read(spark, folder).node_view("id", *ve.NODE_FIELDS, "repository_id")
    after = Window.partitionBy("repository_id", "file_path", "type").orderBy("start_line", "id")
    held = nodes.withColumn("next", F.lead(F.struct(*MOVED)).over(after)).where("next is not null")
    base = held.select("id", *[F.col(f"next.{c}").alias(c) if c in MOVED else F.col(c) for c in ve.NODE_FIELDS])
    return ve.compare_nodes(base, nodes).select("id", "change", F.array_join("changed_fields", ",").alias("changed_fields"))


def dif_02_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The graph's edges against a derived base: calls that are not resolved now were probable there, edges from odd lines stood
    without a confidence, and those from lines divisible by ten were missing."""
    edges = PropertyGraph.read(spark, folder).edge_view("id", *ve.EDGE_FIELDS)
    probable = (F.col("type") == "CALLS") & (F.col("resolution") == "unresolved")
    base = edges.where("source_line % 10 <> 0").withColumns({"resolution": F.when(probable, "probable").otherwise(F.col("resolution")), "confidence": F.when(F.col("source_line") % 2 == 0, F.when(probable, 0.65).otherwise(F.col("confidence")))})
    nodes = PropertyGraph.read(spark, folder).node_view("id", "qualified_name", "name")
    return ve.compare_edges(base, edges, nodes).select("id", "change", F.array_join("changed_fields", ",").alias("changed_fields"), "source_name", "target_name")


def dif_03_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, score and risk of each snapshot against the preceding one."""
    rows = ve.risk(_node_changes(spark, folder), None, ("head_sha",))
    return rows.select("head_sha", "symbols_added", "symbols_removed", "symbols_modified", "n_files", "n_endpoints", "score", "risk")


def dif_04_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200 changes of each snapshot."""
    return ve.evidence(_node_changes(spark, folder), ("head_sha",)).select("head_sha", "id", "change", "truncated")


POLICY = rl.validated(
    {
        "version": 1,
        "rules": [
            {"id": "no-lib-to-app", "type": "forbid_dependency", "from": "lib/*", "to": "app/*"},
            {"id": "no-helper-calls", "type": "forbid_dependency", "severity": "warning", "from": "*", "to": "*[_-]helpers.??", "relationships": ["CALLS", "IMPORTS"]},
            {"id": "python-stays-out", "type": "forbid_dependency", "severity": "warning", "from": "[!a-m]*.py", "to": "*.py"},
            {"id": "acyclic", "type": "no_cycles"},
        ],
    }
)


def pol_02_forbidden(spark: SparkSession, folder: str) -> DataFrame:
    return rl.forbidden(PropertyGraph.read(spark, folder), POLICY)


def pol_04_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of the policy for each repository."""
    graph = PropertyGraph.read(spark, folder)
    broken = rl.forbidden(graph, POLICY).select("repository_id", "rule_id", "severity").unionByName(rl.cycle_violations(graph, POLICY).select("repository_id", "rule_id", "severity"))
    return rl.summary(broken, POLICY, table(spark, folder, "repositories").select(F.col("id").alias("repository_id")))


def _patches(spark: SparkSession, folder: str) -> DataFrame:
    """Diffs of each file of a repository: one hunk for every node that changed its lines between consecutive snapshots."""
    base, head = _pairs(spark, folder)
    both = base.alias("b").join(head.alias("h"), ["head_sha", "id"]).where("b.type <> 'File' and b.file_path = h.file_path and not (b.start_line <=> h.start_line and b.end_line <=> h.end_line and b.hash <=> h.hash)")
    commits = snapshot_order(table(spark, folder, "graph_snapshots")).select(F.col("commit_sha").alias("head_sha"), "repository_id")
    hunk = F.format_string("@@ -%d,%d +%d,%d @@", "b.start_line", F.col("b.end_line") - F.col("b.start_line") + 1, "h.start_line", F.col("h.end_line") - F.col("h.start_line") + 1)
    rows = both.select("head_sha", F.col("h.file_path").alias("path"), hunk.alias("hunk")).where("hunk is not null").join(commits, "head_sha")
    return rows.groupBy("repository_id", "path").agg(F.array_join(F.array_sort(F.collect_set("hunk")), "\n").alias("patch")).withColumn("previous_path", F.lit(None).cast("string"))


def pri_01_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """Changed ranges of the diffs."""
    return ch.changed_ranges(_patches(spark, folder).select("repository_id", "path", "patch"))


def pri_02_changed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Current symbols that the diffs touch."""
    return ch.changed_symbols(PropertyGraph.read(spark, folder), _patches(spark, folder))


def pri_03_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Changed files and symbols and the highest impact of each repository."""
    graph = PropertyGraph.read(spark, folder)
    changed = materialize(ch.changed_symbols(graph, _patches(spark, folder)), "changed")
    return ch.roll_up(ch.change_impacts(graph, changed), changed)


def _changed(spark: SparkSession, folder: str) -> tuple[PropertyGraph, DataFrame, DataFrame]:
    """The graph, the symbols that the diffs touch, and the files of the diffs."""
    graph = PropertyGraph.read(spark, folder)
    patches = materialize(_patches(spark, folder), "patches")
    return graph, materialize(ch.changed_symbols(graph, patches), "changed"), patches.select("repository_id", "path")


def pri_04_review(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of the review of each repository's diffs."""
    return rv.review(*_changed(spark, folder)).summary


def pri_04_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The first findings of each review, with the number of their tests."""
    found = rv.review(*_changed(spark, folder)).findings
    return found.select("repository_id", "place", "id", "severity", "blast_radius", F.size("tests").alias("n_tests"))


def top_03_impact_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Ends and lengths of the twelve longest impact paths of each stated start."""
    graph = PropertyGraph.read(spark, folder)
    return rv.impact_paths(graph, starts(graph)).select("seed", "id", "place", F.size("path").alias("length"))


def rfp_01_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What a plan for changing each stated start may cite."""
    graph = PropertyGraph.read(spark, folder)
    return rv.plan_evidence(graph, starts(graph))


def rfp_02_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Stages of a plan for each stated start, with what they cite."""
    graph = PropertyGraph.read(spark, folder)
    return rv.plan_stages(graph, materialize(rv.plan_evidence(graph, starts(graph)), "evidence")).select("seed", "stage", "name", F.array_join("evidence", ",").alias("evidence"))


def qa_02_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that each stated question starts from, by mentions and symbol search."""
    asked, nodes = _questions(spark, folder)
    hits = se.search(asked, nodes, "symbol", an.MOST_SEEDS)
    return an.seeds(asked.select("query_id", "query", F.lit(None).cast("string").alias("symbol_id")), nodes.select("id", "type", "name"), hits)


def qa_03_route(spark: SparkSession, folder: str) -> DataFrame:
    """The tool that would answer each document, if it were a question."""
    return table(spark, folder, "documents").select("doc_id", an.route(F.col("text")).alias("tool"))


def qa_05_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Whether walks of two calls are grounded in what one hop around their first node shows."""
    graph = PropertyGraph.read(spark, folder)
    calls = graph.links("CALLS")
    first = starts(graph).join(calls.select(F.col("src").alias("id"), F.col("dst").alias("mid")), "id")
    walks = first.join(calls.select(F.col("src").alias("mid"), F.col("dst").alias("end")), "mid").select(F.concat_ws(">", "id", "mid", "end").alias("answer_id"), "id", "mid", "end")
    walks = materialize(walks.distinct(), "walks")
    seen = walks.select("answer_id", F.lit("node").alias("kind"), F.col("id").alias("id")).unionByName(walks.join(graph.links().select(F.col("src").alias("id"), "dst"), "id").select("answer_id", F.lit("node").alias("kind"), F.col("dst").alias("id")))
    answers = walks.select("answer_id", F.lit("path").alias("intent"), F.lit("").alias("text"), F.array("id").alias("symbols"), F.array().cast("array<string>").alias("edge_ids"), F.array(F.array("id", "mid", "end")).alias("paths"))
    return an.grounded(answers, seen, graph.dependencies())


def qa_06_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The impact of each stated start as a sentence."""
    graph = PropertyGraph.read(spark, folder)
    return an.impact_text(impacts(graph, starts(graph)), graph.node_view("id", "name"))


def qa_07_architecture(spark: SparkSession, folder: str) -> DataFrame:
    """Each repository's overview in two sentences."""
    graph = PropertyGraph.read(spark, folder)
    return an.architecture_text(overview(graph), graph.node_view("id", "name", "file_path")).select("repository_id", "fact", F.array_join("symbols", ",").alias("symbols"))


def prj_02_repositories(spark: SparkSession, folder: str) -> DataFrame:
    return public_repositories(table(spark, folder, "repositories"))


def str_10_active(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories that are being worked on."""
    return table(spark, folder, "repositories").select("id", active().alias("active"))


def join_15_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots of the first and the last delivery of each commit merged, the last ones winning."""
    rows = table(spark, folder, "snapshot_nodes").where("id is not null")
    ends = lambda pick: rows.groupBy("id").agg(pick(F.struct("commit_sha", "hash"), "seq").alias("x")).select("id", "x.*")
    return merged(ends(F.min_by), ends(F.max_by)).groupBy("commit_sha").agg(F.count("*").alias("n"))


def flt_06_globs(spark: SparkSession, folder: str) -> DataFrame:
    """Which of three globs each file path matches."""
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "file_path").where("type = 'File'")
    return files.select("id", rl.glob_match("file_path", "*/*_*.py").alias("a"), rl.glob_match("file_path", "[abc]*[!0-9].ts*").alias("b"), rl.glob_match("file_path", "src/??*/**").alias("c"))


def flt_07_test_paths(spark: SparkSession, folder: str) -> DataFrame:
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "file_path").where("type = 'File'")
    return files.select("id", ch.is_test_path("file_path").alias("is_test"))


def _questions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries: names of the nodes one of whose rows has a seq divisible by 100, within their repository; and all nodes."""
    graph = PropertyGraph.read(spark, folder)
    asked = materialize(starts(graph), "asked-nodes")
    nodes = graph.node_view("id", "type", "repository_id", "name", "qualified_name", "docstring", "source")
    words = F.concat(F.lit("where is "), F.lower(F.regexp_replace("name", "([a-z])([A-Z])", "$1_$2")))
    return sifted(nodes, asked).join(asked, "id", "left_semi").select(F.col("id").alias("query_id"), "repository_id", F.when(F.col("type") == "File", words).otherwise(F.col("name")).alias("query")), nodes


def _search(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        asked, nodes = _questions(spark, folder)
        similar = None
        if mode in ("semantic", "hybrid"):
            similar = _similar(spark, folder, se.candidates(10)).select("query_id", "id", F.col("score").alias("similarity"))
        return se.search(asked, nodes, mode, 10, similar)

    query.__doc__ = f"The ten best nodes for each stated query, mode {mode}."
    return query


def _similar(spark: SparkSession, folder: str, k: int) -> DataFrame:
    graph = PropertyGraph.read(spark, folder)
    vectors = graph.node_view("id", "repository_id", "embedding").where("repository_id is not null")
    asked = materialize(starts(graph), "asked-nodes")
    queries = sifted(vectors, asked).join(asked, "id", "left_semi").select(F.col("id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))
    return se.vector_search(queries, vectors, k)


def vec_01_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of its repository for each stated query."""
    return _similar(spark, folder, 10)


def vec_02_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Length and hash of the text to embed of each node."""
    nodes = PropertyGraph.read(spark, folder).node_view("seq", "id", "type", "repository_id", "qualified_name", "signature", "docstring", "file_path", "source", "hash")
    return se.embedding_texts(nodes).select("id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def vec_03_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes of each type can keep their vector (hash as in the last snapshot that holds it)."""
    nodes = PropertyGraph.read(spark, folder).node_view("id", "type", "hash", "embedding").where(F.col("type").isin(*se.EMBEDDED))
    old = table(spark, folder, "snapshot_nodes").where("id is not null").groupBy("id").agg(F.max_by("hash", "seq").alias("hash"))
    cache = old.join(nodes.select("id", "embedding"), "id")
    kept, missing = se.reuse_vectors(nodes.select("id", "hash", F.lit("").alias("text")), cache)
    kinds = nodes.select("id", "type")
    return kept.join(kinds, "id").select("type", F.lit("kept").alias("what")).unionByName(missing.join(kinds, "id").select("type", F.lit("missing").alias("what"))).groupBy("type", "what").agg(F.count("*").alias("n"))


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hit rate and recall of symbol search, where each stated query should find its own node."""
    asked, nodes = _questions(spark, folder)
    hits = se.search(asked, nodes, "symbol", 10)
    return se.retrieval_metrics(hits, asked.select("query_id", F.col("query_id").alias("id")))


def res_01_directories(spark: SparkSession, folder: str) -> DataFrame:
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "repository_id", "file_path").where("type = 'File'")
    return rs.directories(files)


def res_05_links(spark: SparkSession, folder: str) -> DataFrame:
    """What the imports of the parsed files lead to."""
    parsed = table(spark, folder, "parsed_files")
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "repository_id", "file_path").where("type = 'File'")
    return rs.resolve_modules(parsed.select("repository_id", "file_path", F.explode("imports").alias("module")), files)


def res_13_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return rs.fingerprint(PropertyGraph.read(spark, folder).node_view("id", "type", "repository_id", "file_path", "hash").where("type = 'File'"))


def src_01_scan_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Why each file row would be skipped by a scan, if it would."""
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "file_path", "source").where("type = 'File'")
    return files.select("id", F.coalesce(trees.skip_reason(F.col("file_path"), F.coalesce("source", F.lit(""))), F.lit("")).alias("reason"))


def src_12_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories a user sees, the newest first, at most a hundred."""
    rows = table(spark, folder, "repositories").where(visible_to("owner_id", "local"))
    return rows.select("id", "name", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


def src_16_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The newest twenty snapshots of each repository, and which is the indexed one."""
    rows = table(spark, folder, "graph_snapshots").select("id", "repository_id", "commit_sha", "created_at").distinct()
    repos = table(spark, folder, "repositories").select(F.col("id").alias("repository_id"), "indexed_sha")
    return newest(rows, "repository_id", 20).join(repos, "repository_id", "left").select("id", "repository_id", "commit_sha", F.coalesce(F.col("commit_sha") == F.col("indexed_sha"), F.lit(False)).alias("current"))


def snk_07_retention(spark: SparkSession, folder: str) -> DataFrame:
    """The newest twenty events of each user."""
    return newest(table(spark, folder, "events"), "user_id", 20, "ts", "event_id").select("user_id", "event_id")


def str_01_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Which events start a new day of their user and type."""
    return de.accepted_once(table(spark, folder, "events"), ["user_id", "event_type"], "ts", "event_id")


def str_04_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return de.latest_wins(table(spark, folder, "events"), ["user_id"], "ts", "event_id")


def str_05_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the indexed commit of each repository is the latest one known."""
    rows = table(spark, folder, "repositories")
    state = F.when(F.col("indexed_sha").isNull() | F.col("latest_github_sha").isNull(), "UNKNOWN").when(F.col("indexed_sha") == F.col("latest_github_sha"), "CURRENT").otherwise("STALE")
    return rows.select("id", state.alias("state"))


def str_07_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return de.last_states(table(spark, folder, "events"), ["user_id"], "ts", "event_type", "event_id")


def str_11_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The last four events of each user, the newest first."""
    return de.memory(table(spark, folder, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at")), "user_id", "at", 4).select("user_id", "event_id", "place")


def str_12_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type that each document would be told in, if it were an answer."""
    told = tx.answer_events(table(spark, folder, "documents").select(F.col("doc_id").alias("answer_id"), "text"))
    return told.groupBy("answer_id").agg(F.count_if(F.get_json_object("event", "$.type") == "delta").alias("n_deltas"), F.count_if(F.get_json_object("event", "$.type") == "result").alias("n_results"))


def str_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and type."""
    return de.counts_stream(table(spark, folder, "events"), "ts", "event_type")


def set_05_touched_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that occur on nodes or on edges."""
    graph = PropertyGraph.read(spark, folder)
    return graph.nodes.select(F.col("file_path").alias("path")).union(graph.edges.select("source_file")).where("path <> ''").distinct()


def top_03_long_files(spark: SparkSession, folder: str) -> DataFrame:
    """The three longest files of each repository."""
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "repository_id", "end_line").where("type = 'File'")
    return files.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("end_line"), "id"))).where("place <= 3").select("repository_id", "id", "place")


def qa_01_intent(spark: SparkSession, folder: str) -> DataFrame:
    """What each document would be about, if it were a question."""
    return table(spark, folder, "documents").select("doc_id", tx.intent(F.col("text")).alias("intent"))


def flt_08_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Owner and name of the repositories' addresses."""
    parts = tx.repository_parts(F.col("source"))
    return table(spark, folder, "repositories").select("id", parts["owner"].alias("owner"), parts["name"].alias("name"))


QUERIES = {f.__name__: f for f in (qa_01_intent, flt_08_addresses, dif_01_nodes, dif_01_fields, dif_02_edges, dif_03_risk, dif_04_evidence, pol_02_forbidden, pol_04_summary, pri_01_hunks, pri_02_changed_symbols, pri_03_rollup, flt_06_globs, flt_07_test_paths, vec_01_topk, vec_02_texts, vec_03_reuse, eval_metrics, res_01_directories, res_05_links, res_13_fingerprint, src_01_scan_filters, src_12_repositories, src_16_snapshots, snk_07_retention, str_01_dedupe, str_04_coalesce, str_05_sync, str_07_lifecycle, str_11_memory, str_counts, str_12_events, set_05_touched_files, top_03_long_files, pri_04_review, pri_04_findings, top_03_impact_paths, rfp_01_evidence, rfp_02_stages, qa_02_seeds, qa_03_route, qa_05_grounding, qa_06_facts, qa_07_architecture, prj_02_repositories, str_10_active, join_15_merged)}
QUERIES |= {"sch_02_symbol": _search("symbol"), "sch_03_text": _search("text"), "sch_04_semantic": _search("semantic"), "sch_04_hybrid": _search("hybrid")}

_ORD = "o AS (SELECT repository_id, commit_sha, row_number() OVER (PARTITION BY repository_id ORDER BY min(created_at), commit_sha) AS k FROM graph_snapshots WHERE repository_id IS NOT NULL AND commit_sha IS NOT NULL AND created_at IS NOT NULL GROUP BY repository_id, commit_sha)"
_SNAP = f"WITH {_ORD}, y AS (SELECT o.repository_id, o.k, v.commit_sha, v.id, v.type, v.file_path, v.start_line, v.end_line, lower(trim(coalesce(v.hash, ''))) AS hash FROM snapshot_nodes v JOIN o USING (commit_sha) WHERE v.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v.commit_sha, v.id ORDER BY v.seq DESC) = 1)"
_BOTH = """, b AS (SELECT nx.commit_sha AS head_sha, y.* FROM y JOIN o nx ON nx.repository_id = y.repository_id AND nx.k = y.k + 1), h AS (SELECT commit_sha AS head_sha, * FROM y WHERE k > 1),
f AS (SELECT coalesce(b.head_sha, h.head_sha) AS head_sha, coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
 CASE WHEN b.id IS NULL OR h.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.type IS DISTINCT FROM h.type THEN 'type' END, CASE WHEN b.file_path IS DISTINCT FROM h.file_path THEN 'file_path' END, CASE WHEN b.start_line IS DISTINCT FROM h.start_line THEN 'start_line' END,
 CASE WHEN b.end_line IS DISTINCT FROM h.end_line THEN 'end_line' END, CASE WHEN b.hash IS DISTINCT FROM h.hash THEN 'hash' END) END AS changed_fields, CASE WHEN h.id IS NULL THEN b.file_path ELSE h.file_path END AS file_path, CASE WHEN h.id IS NULL THEN b.type ELSE h.type END AS type
 FROM b FULL JOIN h ON h.head_sha = b.head_sha AND h.id = b.id), x AS (SELECT * FROM f WHERE change <> 'modified' OR changed_fields <> '')"""
_LINES = """, p AS (SELECT DISTINCT h.repository_id, h.file_path AS path, b.start_line AS bs, b.end_line AS be, h.start_line AS hs, h.end_line AS he FROM b JOIN h ON h.head_sha = b.head_sha AND h.id = b.id
 WHERE b.type <> 'File' AND b.file_path = h.file_path AND NOT (b.start_line IS NOT DISTINCT FROM h.start_line AND b.end_line IS NOT DISTINCT FROM h.end_line AND b.hash = h.hash) AND b.start_line IS NOT NULL AND b.end_line IS NOT NULL AND h.start_line IS NOT NULL AND h.end_line IS NOT NULL),
r AS (SELECT DISTINCT repository_id, path, 'base' AS side, bs AS "start", bs + greatest(be - bs + 1, 1) - 1 AS "end" FROM p UNION SELECT DISTINCT repository_id, path, 'head', hs, hs + greatest(he - hs + 1, 1) - 1 FROM p)"""
_RULES = f"""z AS (SELECT id, repository_id, coalesce(nullif(file_path, ''), nullif(module, ''), nullif(qualified_name, ''), nullif(name, ''), '') AS loc FROM n),
v AS (SELECT a.repository_id, e.seq, e.id, e.source, e.target, e.type, a.loc AS la, b.loc AS lb FROM e JOIN z a ON a.id = e.source JOIN z b ON b.id = e.target WHERE e.type IN ({DEPENDENCY_LIST}) AND coalesce(e.resolution, '') <> 'unresolved'),
u AS (SELECT *, 'no-lib-to-app' AS rule_id, 'error' AS severity FROM v WHERE regexp_full_match(la, 'lib/.*') AND regexp_full_match(lb, 'app/.*')
 UNION ALL SELECT *, 'no-helper-calls', 'warning' FROM v WHERE type IN ('CALLS', 'IMPORTS') AND regexp_full_match(lb, '.*[_-]helpers\\...')
 UNION ALL SELECT *, 'python-stays-out', 'warning' FROM v WHERE regexp_full_match(la, '[^a-m].*\\.py') AND regexp_full_match(lb, '.*\\.py')),
t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY repository_id, rule_id ORDER BY seq, id) <= 50)"""
_TEST = "(^|/)(test|tests|__tests__|spec|specs)/|(^|/)test_[^/]*$|(_test\\.py|\\.(test|spec)\\.(jsx?|tsx?))$"
_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)
_ASKED = f"""q0 AS (SELECT n.id AS query_id, n.repository_id, lower(trim(CASE WHEN n.type = 'File' THEN 'where is ' || lower(regexp_replace(n.name, '([a-z])([A-Z])', '\\1_\\2', 'g')) ELSE n.name END)) AS q FROM n JOIN s USING (id)),
q AS (SELECT *, list_filter(list_distinct(regexp_extract_all(q, '[a-z][a-z0-9_]+')), lambda w: w NOT IN ({_STOP})) AS words FROM q0 WHERE q IS NOT NULL),
t AS (SELECT id, repository_id, type, lower(coalesce(name, '')) AS lname, lower(coalesce(qualified_name, '') || ' ' || coalesce(docstring, '') || ' ' || coalesce(source, '')) AS txt FROM n WHERE type NOT IN ('Repository', 'Directory', 'UnresolvedSymbol', 'Module')),
a AS (SELECT q.query_id, t.id, t.type, CASE WHEN q.q = t.lname THEN 1.0 WHEN list_contains(q.words, t.lname) THEN 0.9 WHEN contains(t.lname, q.q) THEN 0.65 ELSE 0.0 END::DOUBLE AS exact,
 len(list_filter(q.words, lambda w: contains(t.txt, w)))::DOUBLE / greatest(1, len(q.words)) AS lexical, contains(t.txt, q.q)::INT::DOUBLE AS whole FROM q JOIN t ON q.repository_id IS NULL OR q.repository_id = t.repository_id)"""
_VECTORS = """g AS (SELECT id, repository_id, embedding::DOUBLE[] AS v FROM n WHERE repository_id IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
c AS (SELECT a.id AS query_id, b.id, round((1 + list_cosine_similarity(a.v, b.v)) / 2, 6) AS score FROM g a JOIN s ON s.id = a.id JOIN g b ON b.repository_id = a.repository_id)"""


def _found(score: str, similar: bool) -> str:
    sim = "coalesce(m.score, 0.0)" if similar else "0.0::DOUBLE"
    join = "LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30) m ON m.query_id = a.query_id AND m.id = a.id" if similar else ""
    tables = _ASKED + (", " + _VECTORS if similar else "")
    return graph_sql(
        f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, id, score, round(sim, 4) AS semantic_score, CASE WHEN exact > 0 THEN 'symbol' WHEN sim > 0 THEN 'semantic' ELSE 'text' END AS mechanism "
        f"FROM (SELECT query_id, id, exact, sim, round(raw, 4) AS score FROM (SELECT *, {score} AS raw FROM (SELECT a.*, {sim} AS sim FROM a {join})) WHERE raw > 0) QUALIFY place <= 10",
        tables,
    )


_DAMP = "CASE WHEN type = 'File' THEN 0.65 ELSE 1.0 END::DOUBLE"
_EVENTS_KEYED = "k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)"

_INTENT = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for label, words in tx.INTENTS)

ORACLES = {
    "qa_01_intent": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL {_INTENT} ELSE 'explanation' END AS intent FROM documents",
    "flt_08_addresses": "SELECT id, nullif(lower(regexp_extract(source, p, 1)), '') AS owner, nullif(lower(regexp_extract(source, p, 2)), '') AS name FROM (SELECT *, '^https://[a-z0-9.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\\.git)?/?$' AS p FROM repositories)",
    "dif_01_nodes": f"{_SNAP}{_BOTH} SELECT head_sha, id, change, changed_fields FROM x",
    "dif_01_fields": graph_sql(
        "SELECT id, CASE WHEN new THEN 'added' ELSE 'modified' END AS change, changed_fields FROM (SELECT id, nx IS NULL AS new, CASE WHEN nx IS NULL THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN nx.{c} IS DISTINCT FROM q.{c} THEN '{c}' END" for c in ve.NODE_FIELDS if c in MOVED) + ") END AS changed_fields FROM q) WHERE new OR changed_fields <> ''",
        "q AS (SELECT *, lead({" + ", ".join(f"'{c}': {c}" for c in MOVED) + "}) OVER (PARTITION BY repository_id, file_path, type ORDER BY start_line, id) AS nx FROM n)",
    ),
    "dif_02_edges": graph_sql(
        "SELECT c.id, change, changed_fields, coalesce(nullif(s.qualified_name, ''), s.name, c.source) AS source_name, coalesce(nullif(t.qualified_name, ''), t.name, c.target) AS target_name FROM c LEFT JOIN n s ON s.id = c.source LEFT JOIN n t ON t.id = c.target WHERE change = 'added' OR changed_fields <> ''",
        "b AS (SELECT id, CASE WHEN type = 'CALLS' AND resolution = 'unresolved' THEN 'probable' ELSE resolution END AS resolution, CASE WHEN source_line % 2 = 0 THEN CASE WHEN type = 'CALLS' AND resolution = 'unresolved' THEN 0.65 ELSE confidence END END AS confidence FROM e WHERE source_line % 10 <> 0), "
        "c AS (SELECT e.id, e.source, e.target, CASE WHEN b.id IS NULL THEN 'added' ELSE 'modified' END AS change, CASE WHEN b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.confidence IS DISTINCT FROM e.confidence THEN 'confidence' END, CASE WHEN b.resolution IS DISTINCT FROM e.resolution THEN 'resolution' END) END AS changed_fields FROM e LEFT JOIN b USING (id))",
    ),
    "dif_03_risk": f"""{_SNAP}{_BOTH}, w AS (SELECT head_sha, count(*) FILTER (change = 'added') AS symbols_added, count(*) FILTER (change = 'removed') AS symbols_removed, count(*) FILTER (change = 'modified') AS symbols_modified,
 count(DISTINCT nullif(file_path, '')) AS n_files, count(DISTINCT id) FILTER (type = 'Endpoint') AS n_endpoints FROM x GROUP BY head_sha),
 w2 AS (SELECT *, least(100, least(40, 4 * (symbols_added + symbols_removed + symbols_modified)) + least(15, 3 * n_files) + least(10, 5 * n_endpoints) + least(5, symbols_removed))::INT AS score FROM w)
 SELECT *, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM w2""",
    "dif_04_evidence": f"{_SNAP}{_BOTH} SELECT head_sha, id, change, count(*) OVER (PARTITION BY head_sha) > 200 AS truncated FROM x QUALIFY row_number() OVER (PARTITION BY head_sha ORDER BY CASE change WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END, id) <= 200",
    "pol_02_forbidden": graph_sql("SELECT repository_id, rule_id, severity, id AS edge_id, source, target, la || ' ' || replace(lower(type), '_', ' ') || ' ' || lb AS message FROM t", _RULES),
    "pol_04_summary": graph_sql(
        """SELECT r.id AS repository_id, 4::BIGINT AS rules, 4 - coalesce(x.broken, 0) AS passed, coalesce(x.warnings, 0)::BIGINT AS warnings, coalesce(x.errors, 0)::BIGINT AS errors, (coalesce(x.errors, 0) + coalesce(x.warnings, 0))::BIGINT AS violations,
 CASE WHEN coalesce(x.errors, 0) > 0 THEN 'FAIL' WHEN coalesce(x.warnings, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM repositories r LEFT JOIN
 (SELECT repository_id, count(DISTINCT rule_id) AS broken, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM (SELECT repository_id, rule_id, severity FROM t UNION ALL SELECT repository_id, 'acyclic', 'error' FROM cyc) GROUP BY 1) x ON x.repository_id = r.id""",
        _RULES + """, wk(a, b) AS (SELECT src, dst FROM d UNION SELECT wk.a, d.dst FROM wk JOIN d ON d.src = wk.b),
 cyc AS (SELECT DISTINCT n.repository_id, least(a.a, min(a.b)) AS component FROM wk a JOIN wk b ON b.a = a.b AND b.b = a.a JOIN n ON n.id = a.a GROUP BY n.repository_id, a.a)""",
    ),
    "src_01_scan_filters": graph_sql(
        "SELECT id, CASE WHEN list_has_any(string_split(file_path, '/')[:-2], [" + ", ".join(f"'{x}'" for x in trees.IGNORED) + "]) THEN 'folder' WHEN NOT regexp_matches(file_path, '\\.(py|js|jsx|mjs|cjs|ts|tsx)$') THEN 'extension' WHEN strlen(t) > 1000000 THEN 'size' "
        "WHEN regexp_matches(file_path, '(\\.min\\.js|\\.d\\.ts|\\.generated\\.ts|\\.gen\\.ts)$') THEN 'ending' WHEN contains(t, chr(0)) THEN 'binary' WHEN list_max(list_transform(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda x: strlen(x))) > 2000 THEN 'long line' "
        "WHEN contains(lower(left(t, 500)), '@generated') OR contains(lower(left(t, 500)), 'auto-generated') OR contains(lower(left(t, 500)), 'do not edit') THEN 'generated' ELSE '' END AS reason FROM (SELECT *, coalesce(source, '') AS t FROM n WHERE type = 'File')"
    ),
    "pri_01_hunks": f'{_SNAP}{_BOTH}{_LINES} SELECT repository_id, path, side, "start", "end" FROM r',
    "pri_02_changed_symbols": f"""{_SNAP}{_BOTH}{_LINES}, n AS (SELECT * FROM code_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
 hit AS (SELECT DISTINCT r.repository_id, r.path, n.id FROM r JOIN n ON n.repository_id = r.repository_id AND n.file_path = r.path AND n.start_line <= r."end" AND n.end_line >= r."start" WHERE n.type IN ('Class', 'Interface', 'Function', 'Method', 'Endpoint', 'DatabaseEntity'))
 SELECT repository_id, path, id, false AS fallback FROM hit UNION ALL SELECT r.repository_id, r.path, min(n.id), true FROM r JOIN n ON n.repository_id = r.repository_id AND n.file_path = r.path AND n.type = 'File' WHERE (r.repository_id, r.path) NOT IN (SELECT repository_id, path FROM hit) GROUP BY r.repository_id, r.path""",
    "flt_06_globs": graph_sql("SELECT id, regexp_full_match(file_path, '.*/.*_.*\\.py') AS a, regexp_full_match(file_path, '[abc].*[^0-9]\\.ts.*') AS b, regexp_full_match(file_path, 'src/...*/.*') AS c FROM n WHERE type = 'File'"),
    "flt_07_test_paths": graph_sql("SELECT id, regexp_matches(lower(file_path), '(^|/)(test|tests|__tests__|spec|specs)/|(^|/)test_[^/]*$|(_test\\.py|\\.(test|spec)\\.(jsx?|tsx?))$') AS is_test FROM n WHERE type = 'File'"),
    "vec_01_topk": graph_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, id, score FROM c QUALIFY place <= 10", _VECTORS),
    "vec_03_reuse": graph_sql(
        "SELECT n.type, CASE WHEN o.id IS NOT NULL AND len(n.embedding) = 64 THEN 'kept' ELSE 'missing' END AS what, count(*) AS n FROM n LEFT JOIN (SELECT id, arg_max_null(hash, seq) AS hash FROM snapshot_nodes WHERE id IS NOT NULL GROUP BY id) o ON o.id = n.id AND o.hash = n.hash WHERE n.type IN ('File', 'Function', 'Method', 'Class', 'Interface', 'Endpoint') GROUP BY ALL"
    ),
    "res_01_directories": graph_sql(
        "SELECT DISTINCT repository_id, array_to_string(p[1:i], '/') AS path, array_to_string(p[1:i - 1], '/') AS parent, substr(sha256(repository_id || ':dir:' || array_to_string(p[1:i], '/')), 1, 24) AS id, CASE WHEN i = 1 THEN repository_id ELSE substr(sha256(repository_id || ':dir:' || array_to_string(p[1:i - 1], '/')), 1, 24) END AS parent_id FROM (SELECT repository_id, p, unnest(range(1, len(p))) AS i FROM (SELECT repository_id, string_split(file_path, '/') AS p FROM n WHERE type = 'File'))"
    ),
    "res_13_fingerprint": graph_sql("SELECT repository_id, substr(sha256(string_agg(part, ':' ORDER BY part)), 1, 24) AS fingerprint FROM (SELECT DISTINCT repository_id, file_path || ':' || coalesce(hash, '') AS part FROM n WHERE type = 'File') GROUP BY repository_id"),
    "src_12_repositories": "SELECT id, name, created_at FROM repositories WHERE owner_id = 'local' OR owner_id IS NULL ORDER BY created_at DESC, id LIMIT 100",
    "src_16_snapshots": "SELECT g.id, g.repository_id, g.commit_sha, coalesce(g.commit_sha = r.indexed_sha, false) AS current FROM (SELECT * FROM (SELECT DISTINCT id, repository_id, commit_sha, created_at FROM graph_snapshots) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) <= 20) g LEFT JOIN repositories r ON r.id = g.repository_id",
    "snk_07_retention": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "str_01_dedupe": f"WITH RECURSIVE {_EVENTS_KEYED}, c(user_id, event_type, event_id, ts) AS (SELECT user_id, event_type, event_id, ts FROM k WHERE i = 1 UNION ALL SELECT x.* FROM (SELECT k.user_id, k.event_type, k.event_id, k.ts FROM c JOIN k ON k.user_id = c.user_id AND k.event_type = c.event_type AND k.ts >= c.ts + INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY k.user_id, k.event_type ORDER BY k.ts, k.event_id) = 1) x) SELECT event_id, event_id IN (SELECT event_id FROM c) AS accepted FROM events",
    "str_04_coalesce": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 1 AS superseded FROM events",
    "str_05_sync": "SELECT id, CASE WHEN indexed_sha IS NULL OR latest_github_sha IS NULL THEN 'UNKNOWN' WHEN indexed_sha = latest_github_sha THEN 'CURRENT' ELSE 'STALE' END AS state FROM repositories",
    "str_07_lifecycle": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events, string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (i <= 100) AS log FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) GROUP BY user_id",
    "str_11_memory": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 4",
    "str_12_events": "SELECT doc_id AS answer_id, sum(len(regexp_extract_all(text, '\\S+(?:\\s+|$)')))::BIGINT AS n_deltas, count(*) AS n_results FROM documents WHERE text IS NOT NULL GROUP BY doc_id",
    "str_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "set_05_touched_files": "SELECT file_path AS path FROM code_nodes WHERE file_path <> '' UNION SELECT source_file FROM code_edges WHERE source_file <> ''",
    "top_03_long_files": graph_sql("SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY end_line DESC, id) AS place FROM n WHERE type = 'File' QUALIFY place <= 3"),
    "eval_metrics": "SELECT count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(hit), 6) AS recall FROM (SELECT q.query_id, max(CASE WHEN f.id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM (SELECT DISTINCT id AS query_id FROM code_nodes WHERE seq % 100 = 0 AND id IS NOT NULL) q LEFT JOIN (" + _found("exact", False) + ") f ON f.query_id = q.query_id AND f.id = q.query_id AND f.place <= 5 GROUP BY q.query_id)",
    "sch_02_symbol": _found("exact", False),
    "sch_03_text": _found("whole", False),
    "sch_04_semantic": _found(f"CASE WHEN sim > 0 THEN (0.85::DOUBLE * sim + 0.15::DOUBLE * lexical) * {_DAMP} ELSE 0.0 END", True),
    "sch_04_hybrid": _found(f"(0.5::DOUBLE * sim + 0.25::DOUBLE * lexical + exact) * {_DAMP}", True),
}
# impacts of the changed symbols: the start nodes of the common tables are replaced by them
_CHANGED = GRAPH.replace(
    "s AS (SELECT DISTINCT id FROM code_nodes WHERE seq % 100 = 0 AND id IS NOT NULL)",
    "chg AS (" + ORACLES["pri_02_changed_symbols"] + "), fst AS (SELECT repository_id, id FROM (SELECT repository_id, id, min(path) AS path FROM chg GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY path, id) <= 50), s AS (SELECT DISTINCT id FROM fst)",
)
ORACLES["pri_03_rollup"] = (
    f"WITH RECURSIVE {_CHANGED}, {IMPACT_TABLES}, scored AS ({IMPACT_ROWS}) SELECT repository_id, count(DISTINCT path) AS files_changed, count(DISTINCT chg.id) AS symbols_changed, coalesce(max(score), 0) AS score, "
    "CASE WHEN coalesce(max(score), 0) >= 65 THEN 'HIGH' WHEN coalesce(max(score), 0) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM chg LEFT JOIN scored ON scored.seed = chg.id GROUP BY repository_id"
)
_TOP = f"""WITH RECURSIVE {_CHANGED}, {IMPACT_TABLES}, scored AS ({IMPACT_ROWS}), top AS (SELECT fst.repository_id, scored.*, row_number() OVER (PARTITION BY fst.repository_id ORDER BY score DESC, blast_radius DESC, seed) AS place FROM fst JOIN scored ON scored.seed = fst.id QUALIFY place <= 20),
 tst AS (SELECT DISTINCT q.seed, n.file_path AS path FROM (SELECT seed, id FROM r UNION SELECT r.seed, x.target FROM r JOIN code_edges x ON x.source = r.id AND x.type IN ('READS_FROM', 'WRITES_TO')) q JOIN n ON n.id = q.id WHERE regexp_matches(lower(n.file_path), '{_TEST}'))"""
ORACLES["pri_04_findings"] = f"{_TOP} SELECT repository_id, place, seed AS id, lower(risk) AS severity, blast_radius, (SELECT count(*) FROM tst WHERE tst.seed = top.seed)::INT AS n_tests FROM top WHERE place <= 8"
ORACLES["pri_04_review"] = f"""{_TOP}, fl AS ({ORACLES["pri_01_hunks"].replace('SELECT repository_id, path, side, "start", "end" FROM r', 'SELECT DISTINCT repository_id, path FROM p')}),
 g AS (SELECT top.repository_id, count(*) AS n FROM top JOIN n ON n.id = top.seed WHERE NOT regexp_matches(lower(coalesce(n.file_path, '')), '{_TEST}') AND top.seed NOT IN (SELECT seed FROM tst) GROUP BY 1),
 u AS (SELECT repository_id, count(DISTINCT path) AS n FROM (SELECT top.repository_id, tst.path FROM top JOIN tst ON tst.seed = top.seed UNION SELECT repository_id, path FROM fl WHERE regexp_matches(lower(path), '{_TEST}')) GROUP BY 1),
 t AS (SELECT repository_id, max(score) AS score, count(*) FILTER (risk = 'HIGH') AS n_high FROM top GROUP BY 1), k AS (SELECT repository_id, count(DISTINCT id) AS n FROM chg GROUP BY 1),
 y AS (SELECT fst.repository_id, count(DISTINCT nullif(n.file_path, '')) AS af, count(DISTINCT n.id) FILTER (n.type = 'Endpoint') AS ae FROM fst JOIN dep ON dep.seed = fst.id JOIN n ON n.id = dep.id GROUP BY 1),
 o AS (SELECT fl.repository_id, count(*) AS files_changed, count(*) FILTER (c.path IS NULL) AS files_unmatched FROM fl LEFT JOIN (SELECT DISTINCT repository_id, path FROM chg) c ON c.repository_id = fl.repository_id AND c.path = fl.path GROUP BY 1),
 z AS (SELECT o.*, coalesce(k.n, 0) AS symbols_changed, coalesce(y.af, 0) AS affected_files, coalesce(y.ae, 0) AS affected_endpoints, coalesce(t.score, 0) AS score, coalesce(t.n_high, 0) AS n_high, coalesce(u.n, 0) AS n_tests, coalesce(g.n, 0) AS n_gaps FROM o LEFT JOIN k USING (repository_id) LEFT JOIN t USING (repository_id) LEFT JOIN u USING (repository_id) LEFT JOIN g USING (repository_id) LEFT JOIN y USING (repository_id))
 SELECT repository_id, files_changed, symbols_changed, files_unmatched, affected_files, affected_endpoints, score, CASE WHEN score >= 65 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk, n_tests, n_gaps, n_high, symbols_changed > 50 AS truncated,
 CASE WHEN n_gaps > 0 OR files_unmatched > 0 OR n_high > 0 OR symbols_changed > 50 THEN 'ATTENTION' ELSE 'REVIEW' END AS status FROM z"""
ORACLES["top_03_impact_paths"] = graph_sql("SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY hops DESC, id) AS place, hops + 1 AS length FROM r QUALIFY place <= 12", IMPACT_TABLES)
ORACLES["qa_06_facts"] = graph_sql(
    f"SELECT x.seed, 'Impact of ' || coalesce(n.name, '') || ': ' || risk || ' risk, ' || score || '/100. ' || blast_radius || ' dependents (' || n_direct || ' direct, ' || n_transitive || ' transitive) in ' || n_files || ' files and ' || n_modules || ' modules, at most ' || depth || ' hops away; ' || n_endpoints || ' routes, ' || n_tables || ' entities.' AS fact FROM ({IMPACT_ROWS}) x JOIN n ON n.id = x.seed",
    IMPACT_TABLES,
)
ORACLES["qa_03_route"] = (
    f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN i = 'architecture' THEN 'repository_overview' WHEN i = 'impact' THEN 'analyze_impact' WHEN i = 'path' THEN 'trace_endpoint' WHEN i = 'dependency' AND ("
    + " OR ".join(f"contains(lower(text), '{m}')" for m in an._INCOMING)
    + f") AND NOT regexp_matches(lower(text), '\\b(?:does|do)\\s+.+?\\s+depend on\\b') THEN 'get_dependents' WHEN i = 'dependency' THEN 'get_dependencies' ELSE 'get_neighbors' END AS tool FROM (SELECT doc_id, text, CASE {_INTENT} ELSE 'explanation' END AS i FROM documents)"
)
ORACLES["qa_05_grounding"] = graph_sql(
    """SELECT answer_id, ok AS valid, CASE WHEN NOT ok THEN 'paths' END AS reason FROM (SELECT DISTINCT a.src || '>' || a.dst || '>' || b.dst AS answer_id,
 (a.src, a.dst) IN (SELECT src, dst FROM d) AND (b.src, b.dst) IN (SELECT src, dst FROM d) AND (b.dst = a.src OR (a.src, b.dst) IN (SELECT source, target FROM code_edges)) AS ok
 FROM (SELECT DISTINCT source AS src, target AS dst FROM code_edges WHERE type = 'CALLS') a JOIN s ON s.id = a.src JOIN (SELECT DISTINCT source AS src, target AS dst FROM code_edges WHERE type = 'CALLS') b ON b.src = a.dst)"""
)
ORACLES["prj_02_repositories"] = "SELECT id, name, kind, status, progress, fingerprint, indexed_sha, latest_github_sha, sync_status, created_at, updated_at FROM repositories"
ORACLES["str_10_active"] = "SELECT id, coalesce(status IN ('QUEUED', 'CLONING', 'SCANNING', 'PARSING', 'BUILDING_GRAPH', 'EMBEDDING', 'ANALYZING'), false) OR coalesce(sync_status IN ('QUEUED', 'CLONING', 'SCANNING', 'PARSING', 'BUILDING_GRAPH', 'EMBEDDING', 'ANALYZING'), false) AS active FROM repositories"
ORACLES["join_15_merged"] = "SELECT commit_sha, count(*) AS n FROM (SELECT commit_sha FROM snapshot_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) GROUP BY commit_sha"
_NORMAL = "array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(%s, '/'), lambda y: [y])), lambda acc, y: CASE WHEN y[1] IN ('', '.') THEN acc WHEN y[1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] ELSE list_concat(acc, y) END), '/')"
ORACLES["res_05_links"] = graph_sql(
    """SELECT i.repository_id, i.file_path, i.module, h.target_path, CASE WHEN h.target_path IS NOT NULL THEN 'file' WHEN starts_with(i.module, '.') THEN 'unresolved' ELSE 'package' END AS kind,
 CASE WHEN h.target_path IS NULL AND NOT starts_with(i.module, '.') THEN CASE WHEN ends_with(i.file_path, '.py') THEN string_split(i.module, '.')[1] WHEN starts_with(i.module, '@') THEN array_to_string(string_split(i.module, '/')[1:2], '/') ELSE string_split(i.module, '/')[1] END END AS package
 FROM i LEFT JOIN h USING (repository_id, file_path, module)""",
    f"""i AS (SELECT DISTINCT repository_id, file_path, module FROM (SELECT repository_id, file_path, unnest(imports) AS module FROM parsed_files) WHERE repository_id IS NOT NULL AND file_path IS NOT NULL AND module IS NOT NULL),
 a AS (SELECT *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, length(regexp_extract(module, '^(\\.*)', 1)) AS dots, replace(regexp_replace(module, '^\\.+', ''), '.', '/') AS tail FROM i),
 b AS (SELECT *, array_to_string(string_split(folder, '/')[1:greatest(len(string_split(folder, '/')) - (dots - 1), 0)], '/') AS base, {_NORMAL % "folder || '/' || module"} AS there FROM a),
 c AS (SELECT *, CASE WHEN dots = 0 OR base = '' THEN tail WHEN tail = '' THEN base ELSE base || '/' || tail END AS v, regexp_replace(there, '\\.(js|jsx|mjs)$', '') AS stem FROM b),
 t AS (SELECT *, CASE WHEN ends_with(file_path, '.py') THEN [v || '.py', v || '/__init__.py', 'src/' || v || '.py', 'src/' || v || '/__init__.py'] WHEN starts_with(module, '.') THEN [there, stem || '.ts', stem || '.tsx', stem || '.js', stem || '.jsx', stem || '/index.ts', stem || '/index.tsx', stem || '/index.js'] ELSE [] END AS tries FROM c),
 u AS (SELECT repository_id, file_path, module, unnest(tries) AS target_path, generate_subscripts(tries, 1) AS place FROM t),
 h AS (SELECT u.repository_id, u.file_path, u.module, arg_min(u.target_path, u.place) AS target_path FROM u JOIN (SELECT DISTINCT repository_id, file_path FROM n WHERE type = 'File') k ON k.repository_id = u.repository_id AND k.file_path = u.target_path GROUP BY u.repository_id, u.file_path, u.module)""",
)
ORACLES["vec_02_texts"] = graph_sql(
    """SELECT id, length(t) AS n, md5(t) AS digest FROM (SELECT n.id, CASE WHEN n.type = 'File' THEN coalesce(n.file_path, '') || chr(10) || left(coalesce(g.signatures, ''), 3000)
 ELSE left(concat_ws(chr(10), coalesce(n.qualified_name, ''), coalesce(n.signature, ''), coalesce(n.docstring, ''), coalesce(n.file_path, ''), left(coalesce(n.source, ''), 3500)), 6000) END AS t
 FROM n LEFT JOIN g ON g.repository_id = n.repository_id AND g.file_path = n.file_path WHERE n.type IN ('File', 'Function', 'Method', 'Class', 'Interface', 'Endpoint'))""",
    "g AS (SELECT repository_id, file_path, string_agg(coalesce(signature, ''), chr(10) ORDER BY seq, id) AS signatures FROM n WHERE type IN ('Function', 'Class', 'Interface') GROUP BY repository_id, file_path)",
)
