"""Bounded traversals for many start nodes at once.

State is (seed, id, hops, parent). A hop is one join of the frontier with the links, a map-side combined aggregation per
(seed, id), and an anti-join with what was reached before; each hop is written to the shared folder, so lineage stays short and
the loss of an executor costs at most a hop. Ties between parents go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..session import materialize, new_path, write_counted

#: Hops of a neighbourhood, of a trace or impact, and nodes of a path, at most.
NEAR_HOPS, FAR_HOPS, PATH_NODES = 5, 8, 16
#: Nodes a neighbourhood returns unless told otherwise.
LIMIT = 250
# fixed values: types whose members change with them, and types at which a trace ends
CONTAINERS = ("File", "Class", "Interface")
SINKS = ("DatabaseEntity", "ExternalPackage")

REACHED = "seed string, id string, hops int, parent string"


def reverse(links: DataFrame) -> DataFrame:
    """Links with their ends exchanged."""
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(starts: DataFrame, links: DataFrame, hops: int, open_seeds=None) -> DataFrame:
    """All (seed, id, hops, parent) within ``hops`` of the starts (seed, id), each id once a seed at its least number of hops.

    ``links`` are distinct (src, dst). ``open_seeds`` may be a function from what was reached so far to the seeds that go on.
    Null seeds and ids are left out; unknown ids reach themselves.
    """
    spark = starts.sparkSession
    links = materialize(links, "links")
    folder = new_path(spark, "reached")  # one folder for all hops, so their small files are read together
    new = starts.select("seed", "id").dropna().distinct().select("seed", "id", F.lit(None).cast("string").alias("parent"))
    for hop in range(hops + 1):
        n = write_counted(new, f"{folder}/hops={hop}")
        reached = spark.read.schema("seed string, id string, parent string, hops int").parquet(folder).select("seed", "id", "hops", "parent")
        if not n or hop == hops:
            break
        frontier = reached.where(F.col("hops") == hop)
        if open_seeds is not None:
            frontier = frontier.join(open_seeds(reached), "seed", "left_semi")
        new = (
            frontier.select("seed", F.col("id").alias("src"))
            .join(links, "src")
            .groupBy("seed", F.col("dst").alias("id"))
            .agg(F.min("src").alias("parent"))
            .join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
            .select("seed", "id", "parent")
        )
    return reached


def seeds_of(nodes: DataFrame) -> DataFrame:
    """(seed, id) that start at each node of ``nodes`` (id)."""
    return nodes.select(F.col("id").alias("seed"), "id")


def _first(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows of each seed with their place and the seed's total; totals are combined on the map side, and the window
    is cut to the limit before the shuffle, so a seed with very many rows burdens no task."""
    totals = rows.groupBy("seed").agg(F.count("*").alias("total"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).where(F.col("place") <= limit)
    return placed.join(totals, "seed")


def first_seen(listed: DataFrame, known: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(seed, id, place, total) of lists (seed, id, at): known ids only, each at its first place, the first ``limit`` of a seed."""
    unique = listed.groupBy("seed", "id").agg(F.min("at").alias("at")).join(known.select("id"), "id", "left_semi")
    return _first(unique, limit, "at", "id").select("seed", "id", "place", "total")


def induced_edges(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both ends of which are selected for one seed: (seed, columns of ``edges``)."""
    picked = selected.select("seed", "id")
    return edges.join(picked.withColumnRenamed("id", "source"), "source").join(picked.withColumnRenamed("id", "target"), ["seed", "target"])


def neighbourhood(graph: PropertyGraph, starts: DataFrame, depth: int = 1, types: tuple[str, ...] = (), direction: str = "both", limit: int | None = LIMIT) -> DataFrame:
    """(seed, id, hops, place, total) around each start node: all edges of ``types`` (else all) in ``direction`` ("in", "out", "both").

    Depth is kept within 0 and 5. A seed stops after the hop in which it has ``limit`` nodes; the seed itself comes first, then
    ids ascending, the first ``limit`` of them. Start nodes that are no nodes of the graph have no neighbourhood. With
    ``limit`` None nothing is cut, and there is no place and total: (seed, id, hops).
    """
    if direction not in ("in", "out", "both"):
        raise ValueError("direction must be in, out or both")
    out = graph.links(*types)
    links = {"out": out, "in": reverse(out), "both": out.unionByName(reverse(out)).distinct()}[direction]
    known = graph.node_view("id")
    seeds = seeds_of(starts.select("id").join(known, "id", "left_semi"))

    def open_seeds(reached: DataFrame) -> DataFrame:
        return reached.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") < limit).select("seed")

    reached = reach(seeds, links, min(NEAR_HOPS, max(0, depth)), None if limit is None else open_seeds).join(known, "id", "left_semi")
    if limit is None:
        return reached.select("seed", "id", "hops")
    return _first(reached, limit, (F.col("id") != F.col("seed")).cast("int"), "id").select("seed", "id", "hops", "place", "total")


def walk_back(reached: DataFrame, ends: DataFrame) -> DataFrame:
    """Paths (seed, id, path) from the seeds to the given ends (seed, id), along the parents of ``reached``."""
    reached = materialize(reached.select("seed", "id", "hops", "parent"), "reached")
    paths = ends.select("seed", "id").join(reached, ["seed", "id"]).select("seed", "id", "hops", "parent", F.array("id").alias("path"))
    longest = paths.agg(F.max("hops")).first()[0] or 0
    step = reached.where("hops < %d" % longest).select("seed", F.col("id").alias("parent"), F.col("parent").alias("before"))
    for _ in range(longest):
        onward = F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path"))
        paths = paths.join(step, ["seed", "parent"], "left").select("seed", "id", F.col("before").alias("parent"), onward.alias("path"))
    return paths.select("seed", "id", "path")


def _shortest(graph: PropertyGraph, pairs: DataFrame, directed: bool) -> tuple[DataFrame, DataFrame, str, str]:
    """(reached, ends asked for as (seed, id), column of ``pairs`` the walk starts at, the other column)."""
    links = graph.dependencies()
    if not directed:
        links = links.unionByName(reverse(links)).distinct()
    known = graph.node_view("id")
    asked = materialize(
        pairs.select("source", "target").dropna().distinct().join(known.select(F.col("id").alias("source")), "source", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi"), "pairs"
    )
    ends = asked.agg(F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets")).first()
    first, last = ("target", "source") if ends.targets < ends.sources else ("source", "target")
    if first == "target" and directed:
        links = reverse(links)
    wanted = asked.select(F.col(first).alias("seed"), F.col(last).alias("id"))

    def open_seeds(reached: DataFrame) -> DataFrame:
        return wanted.join(reached, ["seed", "id"], "left_anti").select("seed").distinct()

    return reach(wanted.select("seed", F.col("seed").alias("id")), links, PATH_NODES - 1, open_seeds), wanted, first, last


def path_lengths(graph: PropertyGraph, pairs: DataFrame, directed: bool = True) -> DataFrame:
    """(source, target, length) of each pair that :func:`shortest_paths` finds a path for."""
    reached, wanted, first, last = _shortest(graph, pairs, directed)
    return wanted.join(reached, ["seed", "id"]).select(F.col("seed").alias(first), F.col("id").alias(last), (F.col("hops") + 1).alias("length")).select("source", "target", "length")


def shortest_paths(graph: PropertyGraph, pairs: DataFrame, directed: bool = True) -> DataFrame:
    """(source, target, length, path) of each pair (source, target) with a dependency path of at most 16 nodes, one of the shortest.

    Length counts nodes; a pair of one known node has length 1. Pairs without a path, with an unknown end or with nulls have no row.
    The walk starts at the sources or back from the targets, whichever are fewer; a start takes no further step once all its pairs
    are found.
    """
    reached, wanted, first, last = _shortest(graph, pairs, directed)
    path = F.reverse("path") if first == "target" else F.col("path")
    return walk_back(reached, wanted).select(F.col("seed").alias(first), F.col("id").alias(last), F.size("path").alias("length"), path.alias("path")).select("source", "target", "length", "path")


def valid_paths(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    """(path_id, valid): whether every step of each path (path_id, path) is a dependency; paths of one node are valid."""
    steps = paths.select("path_id", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("src"), F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))).alias("dst"))).alias("s"))
    broken = steps.select("path_id", "s.src", "s.dst").join(graph.dependencies(), ["src", "dst"], "left_anti").select("path_id").distinct().withColumn("broken", F.lit(True))
    return paths.select("path_id").join(broken, "path_id", "left").select("path_id", F.col("broken").isNull().alias("valid"))


def traces(graph: PropertyGraph, starts: DataFrame, limit: int = 25, with_paths: bool = False) -> DataFrame:
    """(seed, id, hops, place[, path]) of the nodes at which dependencies downstream of each start end, the farthest first.

    Within 8 hops, an end is a database entity or an external package (also the seed itself), or another node without
    dependencies of its own. The ``limit`` farthest of a seed are kept, ties by id.
    """
    links = materialize(graph.dependencies(), "dependencies")
    nodes = graph.node_view("id", "type")
    reached = reach(seeds_of(starts.select("id").join(nodes, "id", "left_semi")), links, FAR_HOPS)
    inner = links.select(F.col("src").alias("id")).distinct().withColumn("inner", F.lit(True))
    ends = reached.join(nodes, "id").join(inner, "id", "left").where(F.col("type").isin(*SINKS) | ((F.col("hops") > 0) & F.col("inner").isNull()))
    ranked = ends.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("hops"), "id"))).where(F.col("place") <= limit)
    kept = ranked.select("seed", "id", "hops", "place")
    return kept.join(walk_back(reached, kept), ["seed", "id"]) if with_paths else kept


def with_members(graph: PropertyGraph, starts: DataFrame) -> DataFrame:
    """(seed, id): each start and, of files, classes and interfaces, what they define or contain, three levels deep."""
    inner = materialize(graph.links("DEFINES", "CONTAINS"), "members")
    known = graph.node_view("id", "type").join(starts.select("id").distinct(), "id", "left_semi")
    level = known.where(F.col("type").isin(*CONTAINERS)).select(F.col("id").alias("seed"), "id")
    out = known.select(F.col("id").alias("seed"), "id")
    for _ in range(3):
        level = level.join(inner, level["id"] == inner["src"]).select("seed", F.col("dst").alias("id")).distinct()
        out = out.unionByName(level)
    return materialize(out.distinct(), "selected")


def capped(count: str | Column, each: int, most: int) -> Column:
    """``each`` points for every unit, at most ``most``."""
    return F.least(F.lit(most), (F.col(count) if isinstance(count, str) else count) * each).cast("int")


def risk_level(score: str, high: int = 65, medium: int = 30) -> Column:
    return F.when(F.col(score) >= high, "HIGH").when(F.col(score) >= medium, "MEDIUM").otherwise("LOW")


def impact_reach(graph: PropertyGraph, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, reached): members of each start, and all nodes that depend on one of them within 8 hops (seed, id, hops, parent)."""
    selected = with_members(graph, starts)
    return selected, reach(selected, reverse(graph.dependencies()), FAR_HOPS)


def impacts(graph: PropertyGraph, starts: DataFrame, walked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What a change of each start node may affect, one row a known start; ``walked`` may be :func:`impact_reach` of the starts.

    seed, n_direct, n_transitive, blast_radius, n_endpoints, n_files, n_modules, n_tables (entities read or written), n_writes,
    depth, the six features, score (their sum), risk. Reads and writes count also where they are unresolved.
    """
    selected, reached = walked or impact_reach(graph, starts)
    nodes = graph.node_view("id", "type", "file_path", "module")
    dependents = reached.join(selected, ["seed", "id"], "left_anti")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    counts = dependents.join(nodes, "id").groupBy("seed").agg(
        F.count_if(F.col("hops") == 1).alias("n_direct"),
        F.count("*").alias("blast_radius"),
        F.count_if(F.col("type") == "Endpoint").alias("n_endpoints"),
        F.countDistinct(filled("file_path")).alias("n_files"),
        F.countDistinct(filled("module")).alias("n_modules"),
    )
    depth = reached.groupBy("seed").agg(F.max("hops").alias("depth"))
    stores = graph.edges.where(F.col("type").isin("READS_FROM", "WRITES_TO")).select(F.col("source").alias("id"), "target", (F.col("type") == "WRITES_TO").alias("write")).distinct()
    touched = reached.select("seed", "id").join(stores, "id").groupBy("seed").agg(F.countDistinct("target").alias("n_tables"), F.countDistinct(F.when(F.col("write"), F.col("target"))).alias("n_writes"))
    zero = ["n_direct", "blast_radius", "n_endpoints", "n_files", "n_modules", "n_tables", "n_writes"]
    rows = depth.join(counts, "seed", "left").join(touched, "seed", "left").fillna(0, zero)
    return score_impacts(rows.withColumn("n_transitive", F.col("blast_radius") - F.col("n_direct")))


def score_impacts(rows: DataFrame) -> DataFrame:
    """Features, score and risk of rows with the counts that :func:`impacts` makes."""
    features = {
        "f_direct": capped("n_direct", 4, 20),
        "f_transitive": capped("n_transitive", 2, 25),
        "f_endpoints": capped("n_endpoints", 5, 20),
        "f_modules": capped(F.greatest(F.col("n_modules") - 1, F.lit(0)), 3, 15),
        "f_writes": capped("n_writes", 5, 10),
        "f_depth": capped("depth", 2, 10),
    }
    scored = rows.withColumns(features).withColumn("score", sum((F.col(c) for c in features), F.lit(0)))
    counts = ["n_direct", "n_transitive", "blast_radius", "n_endpoints", "n_files", "n_modules", "n_tables", "n_writes", "depth"]
    return scored.withColumn("risk", risk_level("score")).select("seed", *[F.col(c).cast("long").alias(c) for c in counts], *features, "score", "risk")


def direct_callers(graph: PropertyGraph, starts: DataFrame) -> DataFrame:
    """(seed, caller): what calls a start or one of its members, resolved at least probably, members themselves excepted."""
    selected = with_members(graph, starts)
    calls = graph.edges.where((F.col("type") == "CALLS") & (F.col("resolution") != "unresolved")).select(F.col("source").alias("caller"), F.col("target").alias("id")).distinct()
    found = selected.join(calls, "id").select("seed", "caller").distinct()
    return found.join(selected.select("seed", F.col("id").alias("caller")), ["seed", "caller"], "left_anti")


def calls_around(graph: PropertyGraph, starts: DataFrame, limit: int = 50) -> DataFrame:
    """(seed, direction, other) one call away, unresolved calls too; direction "caller" or "callee"; the first ``limit`` ids each."""
    calls = graph.edges.where(F.col("type") == "CALLS").select("source", "target").dropna().distinct()
    ids = starts.select(F.col("id").alias("seed")).distinct()
    both = ids.join(calls, ids["seed"] == calls["target"]).select("seed", F.lit("caller").alias("direction"), F.col("source").alias("other")).unionByName(
        ids.join(calls, ids["seed"] == calls["source"]).select("seed", F.lit("callee").alias("direction"), F.col("target").alias("other"))
    )
    others = both.where("other <> seed")
    place = F.row_number().over(Window.partitionBy("seed", "direction").orderBy("other"))
    return others.withColumn("place", place).where(F.col("place") <= limit).select("seed", "direction", "other")


def symbol_edges(graph: PropertyGraph, starts: DataFrame, limit: int = 100) -> DataFrame:
    """(seed, direction, id, type, other): the first ``limit`` edges into and out of each start, by seq, then id."""
    edges = graph.edge_view("seq", "id", "source", "target", "type")
    ids = starts.select(F.col("id").alias("seed")).distinct()
    sides = ids.join(edges, ids["seed"] == edges["target"]).select("seed", F.lit("in").alias("direction"), "seq", "id", "type", F.col("source").alias("other")).unionByName(
        ids.join(edges, ids["seed"] == edges["source"]).select("seed", F.lit("out").alias("direction"), "seq", "id", "type", F.col("target").alias("other"))
    )
    place = F.row_number().over(Window.partitionBy("seed", "direction").orderBy("seq", "id"))
    return sides.withColumn("place", place).where(F.col("place") <= limit).select("seed", "direction", "id", "type", "other")


def evidence_neighbourhood(graph: PropertyGraph, answers: DataFrame, ids: int = 12) -> DataFrame:
    """(answer, id): nodes one hop around the first ``ids`` nodes of each answer (answer, id, at), merged."""
    first = answers.withColumn("place", F.row_number().over(Window.partitionBy("answer").orderBy("at", "id"))).where(F.col("place") <= ids).select("answer", "id")
    near = neighbourhood(graph, first.select("id").distinct(), 1)
    return first.join(near.select(F.col("seed").alias("id"), F.col("id").alias("near")), "id").select("answer", F.col("near").alias("id")).distinct()
