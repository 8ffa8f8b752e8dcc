"""Counts, hubs, unused symbols, cycles and components of graphs, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import dependency, stable_id
from ..session import counted, materialize, new_path, write_counted
from .traverse import reach, reverse, walk_back


def counts_by_type(graph: PropertyGraph) -> DataFrame:
    """(repository_id, type, n)."""
    return graph.node_view("id", "type", "repository_id").groupBy("repository_id", "type").agg(F.count("*").alias("n"))


def totals(graph: PropertyGraph) -> DataFrame:
    """Per repository: files, lines (sum of end_line of files), nodes, relationships and unresolved ones (of edges that leave its nodes)."""
    nodes = graph.node_view("id", "type", "repository_id", "end_line")
    is_file = F.col("type") == "File"
    own = nodes.groupBy("repository_id").agg(F.count_if(is_file).alias("files"), F.coalesce(F.sum(F.when(is_file, F.col("end_line"))), F.lit(0)).alias("lines"), F.count("*").alias("nodes"))
    edges = graph.edge_view("id", "source", "resolution").join(nodes.select(F.col("id").alias("source"), "repository_id"), "source")
    of_edges = edges.groupBy("repository_id").agg(F.count("*").alias("relationships"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"))
    return own.join(of_edges, "repository_id", "left").fillna(0, ["relationships", "unresolved"])


def files_by_language(graph: PropertyGraph) -> DataFrame:
    """(repository_id, language, n) of files; an unknown language is ""."""
    files = graph.node_view("id", "type", "repository_id", "language").where("type = 'File'")
    return files.groupBy("repository_id", F.coalesce("language", F.lit("")).alias("language")).agg(F.count("*").alias("n"))


def largest_modules(graph: PropertyGraph, limit: int = 10) -> DataFrame:
    """(repository_id, module, n, place): modules with most files, ties by name."""
    files = graph.node_view("id", "type", "repository_id", "module").where("type = 'File'")
    sizes = files.groupBy("repository_id", "module").agg(F.count("*").alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("n"), "module"))).where(F.col("place") <= limit)


def degrees(graph: PropertyGraph) -> DataFrame:
    """(id, degree): dependency pairs at each node, in and out; a pair with itself counts twice; nodes without are 0."""
    links = graph.dependencies()
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.node_view("id").join(ends, "id", "left").fillna(0, ["degree"])


def hubs(graph: PropertyGraph, limit: int = 10) -> DataFrame:
    """(repository_id, id, degree, place): the nodes of highest degree, ties by id."""
    rows = degrees(graph).join(graph.node_view("id", "repository_id"), "id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("degree"), "id"))).where(F.col("place") <= limit).select("repository_id", "id", "degree", "place")


def potentially_unused(graph: PropertyGraph, limit: int | None = 50) -> DataFrame:
    """(repository_id, id, place): functions and methods nothing depends on, special and anonymous ones excepted, by seq then id."""
    nodes = graph.node_view("id", "type", "repository_id", "name", "seq").where(F.col("type").isin("Function", "Method") & ~F.coalesce("name", F.lit("")).rlike("^(__|callback@)"))
    idle = nodes.join(graph.dependencies().select(F.col("dst").alias("id")), "id", "left_anti")
    placed = idle.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy("seq", "id")))
    return (placed if limit is None else placed.where(F.col("place") <= limit)).select("repository_id", "id", "place")


#: Layers of dead ends that are peeled off before the rest is written.
LAYERS = 3


def trimmed(links: DataFrame) -> tuple[DataFrame, int]:
    """Links that may lie on a cycle, and their number: without those into dead ends or out of nodes nothing leads to, until none is
    left. LAYERS of them go in one job."""
    links, n = counted(links, "links")
    while n:
        kept = links
        for _ in range(LAYERS):
            kept = kept.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        links, m = counted(kept, "links")
        if m == n:
            break
        n = m
    return links, n


def cyclic_nodes(links: DataFrame) -> DataFrame:
    """(id, component, size) of nodes on cycles: strongly connected components of more than one node, or with a link to themselves.

    The component is its smallest id. Dead ends are trimmed; then the smallest id is passed forward to a fixed point, and what
    leads back to the id among its own colour is one component, which is taken out; until no link is left. Every round finds at
    least one component, and in each round all colours are worked off at once.
    """
    spark = links.sparkSession
    self_links = links.where("src = dst").select(F.col("src").alias("id")).distinct()
    rest, n = trimmed(links.where("src <> dst"))
    found = spark.createDataFrame([], "id string, component string")
    while n:
        ids = rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct()
        colour = materialize(ids.select("id", F.col("id").alias("colour")), "colours")
        while True:
            passed = rest.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
            # the smallest colour that leads here; and the colour of that colour, so that long chains take a logarithm of rounds
            step = colour.join(passed, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", "new").alias("colour"))
            jump = colour.select(F.col("id").alias("colour"), F.col("colour").alias("beyond"))
            seen = Observation()
            path = new_path(spark, "colours")
            step.join(jump, "colour", "left").select("id", F.least("colour", "beyond").alias("colour"), "old").observe(seen, F.count_if(F.col("colour") < F.col("old")).alias("moved")).write.parquet(path)
            colour = spark.read.parquet(path).select("id", "colour")
            if not seen.get["moved"]:
                break
        within = rest.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        roots = colour.where("id = colour").select(F.col("id").alias("seed"), "id")
        back = _reach_all(roots, reverse(within))
        part = materialize(back.select("id", F.col("seed").alias("component")), "components")
        found = found.unionByName(part)
        rest, n = trimmed(rest.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    large = found.join(found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component").select("id", "component", "size")
    alone = self_links.join(large, "id", "left_anti").select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))
    return materialize(large.unionByName(alone), "cyclic")


def _reach_all(starts: DataFrame, links: DataFrame) -> DataFrame:
    """Everything reachable from the starts, over any number of hops."""
    spark = starts.sparkSession
    links = materialize(links, "links")
    folder = new_path(spark, "reached")
    new, hop = starts.select("seed", "id"), 0
    while write_counted(new, f"{folder}/hop={hop}"):
        reached = spark.read.schema("seed string, id string, hop int").parquet(folder)
        found = reached.where(F.col("hop") == hop).join(links, F.col("id") == links["src"]).select("seed", F.col("dst").alias("id")).distinct()
        new, hop = found.join(reached, ["seed", "id"], "left_anti").select("seed", "id"), hop + 1
    return spark.read.schema("seed string, id string, hop int").parquet(folder).select("seed", "id")


def cycles(graph: PropertyGraph, limit: int | None = 20) -> DataFrame:
    """(repository_id, component, size, path): of each cyclic component a shortest cycle through its smallest id, first = last; the
    first ``limit`` components of a repository. Cycles longer than the component are impossible, so the search ends by itself."""
    links = graph.dependencies()
    members = cyclic_nodes(links)
    inner = links.join(members.select(F.col("id").alias("src"), "component"), "src").join(members.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("component", "src", "dst")
    inner = materialize(inner, "inner-links")
    heads = members.where("id = component").select("component", "size").join(graph.node_view("id", "repository_id").withColumnRenamed("id", "component"), "component", "left")
    placed = heads.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy("component")))
    placed = placed if limit is None else placed.where(F.col("place") <= limit)
    bound = placed.agg(F.max("size")).first()[0] or 0
    reached = reach(placed.select(F.col("component").alias("seed"), F.col("component").alias("id")), inner.select("src", "dst"), int(bound))
    closing = inner.where("dst = component").select(F.col("component").alias("seed"), F.col("src").alias("id"))
    last = reached.join(closing, ["seed", "id"]).groupBy("seed").agg(F.min(F.struct("hops", "id"))["id"].alias("id"))
    paths = walk_back(reached, last)
    return placed.join(paths.select(F.col("seed").alias("component"), "path"), "component").select("repository_id", "component", "size", F.concat("path", F.array("component")).alias("path"))


def overview(graph: PropertyGraph) -> DataFrame:
    """One row a repository: totals, counts by type and files by language as maps, largest modules, hubs, unused symbols, cycles."""
    counts = counts_by_type(graph).where("type is not null").groupBy("repository_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))
    languages = files_by_language(graph).groupBy("repository_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    listed = lambda df, name, *c: df.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("place", *c))).alias(name))
    parts = [
        counts,
        languages,
        listed(largest_modules(graph), "largest_modules", "module", "n"),
        listed(hubs(graph), "hubs", "id", "degree"),
        listed(potentially_unused(graph), "potentially_unused", "id"),
        cycles(graph).groupBy("repository_id").agg(F.array_sort(F.collect_list("path")).alias("cycles")),
    ]
    out = totals(graph)
    for part in parts:
        out = out.join(part, "repository_id", "left")
    return out


def groups(graph: PropertyGraph) -> DataFrame:
    """(id, repository_id, component): the component each node belongs to; repositories, directories and unresolved symbols have none."""
    nodes = graph.node_view("id", "type", "repository_id", "module").where(~F.col("type").isin("Repository", "Directory", "UnresolvedSymbol"))
    name = F.when(F.col("type") == "ExternalPackage", "External packages").when(F.col("type") == "DatabaseEntity", "Database").when(F.coalesce("module", F.lit("")) != "", F.col("module")).otherwise("root")
    return nodes.select("id", "repository_id", name.alias("component"))


def components(graph: PropertyGraph, limit: int | None = 100) -> DataFrame:
    """(repository_id, component, component_id, n): members of each component; the first ``limit`` of a repository, by name."""
    rows = groups(graph).groupBy("repository_id", "component").agg(F.count("*").alias("n"))
    keyed = rows.select("repository_id", "component", stable_id("repository_id", F.lit("architecture"), "component").alias("component_id"), "n")
    if limit is None:
        return keyed
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy("component"))).where(F.col("place") <= limit).drop("place")


def component_edges(graph: PropertyGraph, limit: int | None = 100, evidence: int = 20) -> DataFrame:
    """(repository_id, source_component, target_component, id, n, resolution, evidence): dependencies between components of the
    kept ones; resolved if all edges are, else probable; the ids of the first ``evidence`` edges by id."""
    of = groups(graph)
    edges = graph.edge_view("id", "source", "target", "type", "resolution").where(dependency())
    pairs = (
        edges.join(of.select(F.col("id").alias("source"), "repository_id", F.col("component").alias("source_component")), "source")
        .join(of.select(F.col("id").alias("target"), F.col("component").alias("target_component"), F.col("repository_id").alias("target_repository")), "target")
        .where("source_component <> target_component or repository_id <> target_repository")
    )
    by = ["repository_id", "target_repository", "source_component", "target_component"]
    placed = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("place") <= evidence)
    shown = placed.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("evidence"))
    rolled = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.bool_and(F.col("resolution") == "resolved"), "resolved").otherwise("probable").alias("resolution"))
    kept = components(graph, limit).select("repository_id", "component", "component_id")
    out = rolled.join(shown, by).join(kept.select("repository_id", F.col("component").alias("source_component"), F.col("component_id").alias("a")), ["repository_id", "source_component"]).join(
        kept.select(F.col("repository_id").alias("target_repository"), F.col("component").alias("target_component"), F.col("component_id").alias("b")), ["target_repository", "target_component"]
    )
    return out.select("repository_id", "source_component", "target_component", stable_id("a", "b").alias("id"), "n", "resolution", "evidence")
