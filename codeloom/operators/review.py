"""What a change touches and what speaks for it: dependents, paths and tests of many start nodes, reviews, evidence of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..session import materialize
from .changes import MOST_CHANGED, MOST_IMPACTS, changed_symbols, first_changed, is_test_path, ranked_impacts
from .index import index_files
from .rules import cycle_violations, forbidden, summary
from .traverse import impact_reach, impacts, walk_back

MOST_PATHS, MOST_FINDINGS, MOST_EVIDENCE, MOST_SHOWN = 12, 8, 40, 300


def _first(rows: DataFrame, by: str, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows of each ``by`` with their place; the window is cut before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= limit)


def impact_parts(graph: PropertyGraph, starts: DataFrame, walked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(seed, id, part, hops): members of each start ("selected"), what depends on them within 8 hops ("dependent"), and what
    either reads or writes ("database", hops null), each once a part; ``walked`` may be :func:`impact_reach` of the starts."""
    selected, reached = walked or impact_reach(graph, starts)
    own = selected.select("seed", "id").withColumn("own", F.lit(True))
    parts = reached.join(own, ["seed", "id"], "left").select("seed", "id", F.when(F.col("own"), "selected").otherwise("dependent").alias("part"), "hops")
    stores = graph.edges.where(F.col("type").isin("READS_FROM", "WRITES_TO")).select(F.col("source").alias("id"), "target").dropna().distinct()
    touched = reached.select("seed", "id").join(stores, "id").select("seed", F.col("target").alias("id")).distinct()
    return parts.unionByName(touched.select("seed", "id", F.lit("database").alias("part"), F.lit(None).cast("int").alias("hops")))


def impact_paths(graph: PropertyGraph, starts: DataFrame, limit: int = MOST_PATHS) -> DataFrame:
    """(seed, id, place, path): of each start the ``limit`` longest of the shortest paths from what depends on it, ties by id."""
    _, reached = impact_reach(graph, starts)
    far = _first(reached.select("seed", "id", "hops"), "seed", limit, F.desc("hops"), "id").select("seed", "id", "place")
    return far.join(walk_back(reached, far), ["seed", "id"]).select("seed", "id", "place", F.reverse("path").alias("path"))


def related_tests(parts: DataFrame, graph: PropertyGraph) -> DataFrame:
    """(seed, path): test files among the nodes of each start's impact (:func:`impact_parts`), once each."""
    paths = graph.node_view("id", "file_path").where(is_test_path("file_path")).select("id", F.col("file_path").alias("path"))
    return parts.join(paths, "id").select("seed", "path").distinct()


@dataclass(frozen=True)
class Review:
    """Tables of a review: ``impacts`` (repository_id, place, id, score, risk, ...), ``findings`` (the first of them, with their tests),
    ``gaps`` (repository_id, id), ``shown`` (repository_id, id) and ``summary``, one row a repository."""

    impacts: DataFrame
    findings: DataFrame
    gaps: DataFrame
    shown: DataFrame
    summary: DataFrame


def review(graph: PropertyGraph, changed: DataFrame, files: DataFrame, analysed: int = MOST_CHANGED, listed: int = MOST_IMPACTS) -> Review:
    """Review of changed symbols (``changed``: repository_id, path, id, as :func:`changed_symbols` makes them) of changed files
    (``files``: repository_id, path).

    The first ``analysed`` symbols of a repository, by path then id, are looked at; the ``listed`` with the highest score, then the
    widest reach, then by id, are its impacts. A symbol outside of tests that no test is connected with is a gap. Summary:
    files_changed, symbols_changed, files_unmatched, affected_files, affected_endpoints (of all analysed), score, risk, n_tests (related or changed test files), n_gaps, n_high,
    truncated, status (ATTENTION with a gap, an unmatched file, a high risk or a cut list, else REVIEW).
    """
    symbols = changed.select("repository_id", "id").distinct()
    looked = first_changed(changed, analysed)
    seeds = looked.select("id").distinct()
    walked = impact_reach(graph, seeds)  # one walk for all that follows
    top = materialize(ranked_impacts(looked, impacts(graph, seeds, walked), listed), "impacts")
    all_parts = materialize(impact_parts(graph, seeds, walked), "impact-parts")
    kinds = graph.node_view("id", "type", "file_path")
    affected = looked.withColumnRenamed("id", "seed").join(all_parts.where("part = 'dependent'"), "seed").join(kinds, "id")
    reach = affected.groupBy("repository_id").agg(F.countDistinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("affected_files"), F.countDistinct(F.when(F.col("type") == "Endpoint", F.col("id"))).alias("affected_endpoints"))
    parts = all_parts.join(top.select(F.col("id").alias("seed")), "seed", "left_semi")
    tests = materialize(related_tests(parts, graph), "related-tests")
    of_symbol = tests.groupBy(F.col("seed").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("tests"))  # files of at most one impact
    own = graph.node_view("id", "name", "file_path", "start_line", "end_line")
    shown_of = top.join(own, "id").join(of_symbol, "id", "left").withColumn("tests", F.coalesce("tests", F.array().cast("array<string>")))
    findings = shown_of.where(F.col("place") <= MOST_FINDINGS).select("repository_id", "place", "id", F.lower("risk").alias("severity"), "name", "file_path", "start_line", "end_line", "blast_radius", "n_files", "n_endpoints", "tests")
    gaps = shown_of.where(~is_test_path("file_path") & (F.size("tests") == 0)).select("repository_id", "id")
    seen = symbols.select("repository_id", "id", F.lit(0).alias("rank")).unionByName(top.select("repository_id", F.col("id").alias("seed")).join(parts, "seed").select("repository_id", "id", F.lit(1).alias("rank")))
    shown = _first(seen.groupBy("repository_id", "id").agg(F.min("rank").alias("rank")), "repository_id", MOST_SHOWN, "rank", "id").select("repository_id", "id")
    listed_files = files.select("repository_id", "path").dropna().distinct()
    known = changed.select("repository_id", "path").distinct().withColumn("known", F.lit(True))
    counts = listed_files.join(known, ["repository_id", "path"], "left").groupBy("repository_id").agg(F.count("*").alias("files_changed"), F.count_if(F.col("known").isNull()).alias("files_unmatched"))
    all_tests = top.select("repository_id", F.col("id").alias("seed")).join(tests, "seed").select("repository_id", "path").unionByName(listed_files.where(is_test_path("path"))).distinct()
    rows = (
        counts.join(symbols.groupBy("repository_id").agg(F.count("*").alias("symbols_changed")), "repository_id", "left")
        .join(top.groupBy("repository_id").agg(F.max("score").alias("score"), F.count_if(F.col("risk") == "HIGH").alias("n_high")), "repository_id", "left")
        .join(all_tests.groupBy("repository_id").agg(F.count("*").alias("n_tests")), "repository_id", "left")
        .join(gaps.groupBy("repository_id").agg(F.count("*").alias("n_gaps")), "repository_id", "left")
        .join(reach, "repository_id", "left")
        .fillna(0, ["affected_files", "affected_endpoints", "symbols_changed", "score", "n_high", "n_tests", "n_gaps"])
    )
    risk = F.when(F.col("score") >= 65, "HIGH").when(F.col("score") >= 30, "MEDIUM").otherwise("LOW")
    cut = F.col("symbols_changed") > analysed
    status = F.when((F.col("n_gaps") > 0) | (F.col("files_unmatched") > 0) | (F.col("n_high") > 0) | cut, "ATTENTION").otherwise("REVIEW")
    outcome = rows.select("repository_id", "files_changed", "symbols_changed", "files_unmatched", "affected_files", "affected_endpoints", "score", risk.alias("risk"), "n_tests", "n_gaps", "n_high", cut.alias("truncated"), status.alias("status"))
    return Review(top, findings, gaps, shown, outcome)


def review_of_head(files: DataFrame, patches: DataFrame, rules: list[dict]) -> tuple[Review, DataFrame]:
    """(review, outcome of the rules) of the heads of changes: the source files as they are there (``files``: repository_id, file_path,
    text) are indexed afresh, and the diffs (``patches``: repository_id, path, previous_path, patch) are mapped to that graph."""
    graph, _ = index_files(files)
    changed = materialize(changed_symbols(graph, patches), "changed")
    broken = forbidden(graph, rules).select("repository_id", "rule_id", "severity").unionByName(cycle_violations(graph, rules).select("repository_id", "rule_id", "severity"))
    return review(graph, changed, patches), summary(broken, rules, patches)


def plan_evidence(graph: PropertyGraph, starts: DataFrame, limit: int = MOST_EVIDENCE) -> DataFrame:
    """(seed, place, id, origin): what a plan for changing each start may cite, each id once, at its first place: the start itself, then
    direct dependents, endpoints, entities, nodes of the longest paths, and all else of its impact; the first ``limit``."""
    parts = materialize(impact_parts(graph, starts), "impact-parts")
    kinds = graph.node_view("id", "type")
    rank = lambda rows, n, name, at=None: rows.select("seed", "id", F.lit(n).alias("rank"), (F.lit(0) if at is None else at).cast("int").alias("at"), F.lit(name).alias("origin"))
    dependents = parts.where("part = 'dependent'")
    steps = impact_paths(graph, starts).select("seed", "place", F.posexplode("path").alias("at", "id"))
    seeds = starts.select("id").distinct().join(kinds, "id", "left_semi")
    listed = [
        rank(seeds.select(F.col("id").alias("seed"), "id"), 0, "target"),
        rank(dependents.where("hops = 1"), 1, "direct"),
        rank(dependents.join(kinds.where("type = 'Endpoint'"), "id"), 2, "endpoint"),
        rank(parts.where("part = 'database'"), 3, "database"),
        rank(steps, 4, "path", F.col("place") * 32 + F.col("at")),
        rank(parts.where("part <> 'database'"), 5, "graph"),
        rank(parts.where("part = 'database'"), 6, "graph"),
    ]
    rows = listed[0]
    for part in listed[1:]:
        rows = rows.unionByName(part)
    once = rows.groupBy("seed", "id").agg(F.min(F.struct("rank", "at", "origin")).alias("x")).select("seed", "id", "x.*")
    return _first(once, "seed", limit, "rank", "at", "id").select("seed", "place", "id", "origin")


def plan_stages(graph: PropertyGraph, evidence: DataFrame) -> DataFrame:
    """(seed, stage, name, evidence): stages of a careful change with at most 8 cited ids each, from :func:`plan_evidence`: "contract",
    "source", "dependents" (only where there are any) and "verification" (tests first)."""
    paths = graph.node_view("id", "file_path")
    rows = evidence.join(paths, "id", "left").withColumn("test", is_test_path("file_path"))
    pick = lambda condition, n: F.slice(F.transform(F.array_sort(F.filter(F.collect_list(F.when(condition, F.struct("place", "id"))), lambda x: x.isNotNull())), lambda x: x["id"]), 1, n)
    lists = rows.groupBy("seed").agg(  # at most MOST_EVIDENCE rows each
        pick(F.col("origin") == "direct", 8).alias("direct"), pick(F.col("origin") == "endpoint", 6).alias("endpoints"), pick(F.col("origin") == "database", 6).alias("database"), pick(F.col("test"), 8).alias("tests"), F.count_if(~F.col("origin").isin("target", "database")).alias("n_other")
    )
    cite = lambda *parts: F.slice(F.array_distinct(F.concat(*parts)), 1, 8)
    target = F.array("seed")
    stage = lambda n, name, ids, condition=None: F.when(F.lit(True) if condition is None else condition, F.struct(F.lit(n).alias("stage"), F.lit(name).alias("name"), ids.alias("evidence")))
    stages = F.array(
        stage(1, "contract", target),
        stage(2, "source", cite(target, "database", "endpoints")),
        stage(3, "dependents", cite("direct", "endpoints", "database", target), (F.size("direct") > 0) | (F.col("n_other") > 0)),
        stage(4, "verification", cite("tests", "endpoints", "database", target)),
    )
    return lists.select("seed", F.explode(F.filter(stages, lambda x: x.isNotNull())).alias("s")).select("seed", "s.stage", "s.name", "s.evidence")
