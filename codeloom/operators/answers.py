"""Questions about graphs: which nodes they start from, which tool answers them, whether an answer is grounded, and facts as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import intent, mentions
from ..graph import PropertyGraph

MOST_SEEDS, MOST_CITED = 4, 12
# fixed values: types that a question doesn't mention by name, and types that are no evidence
NOT_MENTIONED = ("File", "Directory", "UnresolvedSymbol", "Repository")
NOT_CITED = ("Directory", "UnresolvedSymbol")
# fixed values: words that point at what was talked about before, and marks of what depends on a thing
_PRONOUN = r"(?i)\b(it|this|that|them)\b"
_INCOMING = ("calls", "uses", " use ", "depends on", "depend on", "dependents")
_OUTGOING = r"\b(?:does|do)\s+.+?\s+depend on\b"
_STATED = r"\b\d+\b|%|(?i:\b(?:low|medium|high)\s+risk\b)"


def seeds(questions: DataFrame, nodes: DataFrame, hits: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """(query_id, place, id): the nodes a question (query_id, query, symbol_id) starts from, at most MOST_SEEDS, each once.

    First the explicit symbol if it is a node; else, where the question points back (it, this, that, them), the symbols that the
    session ``remembered`` (query_id, id, at); then nodes whose name it mentions, the longest names first; then ``hits`` of a search
    (query_id, id, place). ``nodes``: id, type, name. Null questions start nowhere.
    """
    asked = questions.where("query is not null")
    named = mentions(asked.select(F.col("query_id").alias("text_id"), F.col("query").alias("text")), nodes.where(~F.col("type").isin(*NOT_MENTIONED)).select("id", "name"))
    rank = lambda rows, n, at: rows.select("query_id", "id", F.lit(n).alias("rank"), at.cast("long").alias("at"))
    parts = [
        rank(asked.select("query_id", F.col("symbol_id").alias("id")).join(nodes.select("id"), "id", "left_semi"), 0, F.lit(0)),
        rank(named.withColumnRenamed("text_id", "query_id"), 2, -F.length("name")),
        rank(hits.where(F.col("place") <= MOST_SEEDS).join(asked.select("query_id"), "query_id", "left_semi"), 3, F.col("place")),
    ]
    if remembered is not None:
        explicit = parts[0].select("query_id")
        back = asked.where(F.col("query").rlike(_PRONOUN)).select("query_id").join(explicit, "query_id", "left_anti")
        parts.append(rank(remembered.join(back, "query_id", "left_semi").join(nodes.select("id"), "id", "left_semi"), 1, F.col("at")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    once = rows.groupBy("query_id", "id").agg(F.min(F.struct("rank", "at")).alias("x"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("x.rank", "x.at", "id"))
    return once.withColumn("place", place).where(F.col("place") <= MOST_SEEDS).select("query_id", "place", "id")


def route(question: Column) -> Column:
    """The tool that answers a question, by what it is about; null for a null question."""
    kind = intent(question)
    folded = F.lower(question)
    incoming = F.lit(False)
    for mark in _INCOMING:
        incoming = incoming | folded.contains(mark)
    dependents = incoming & ~folded.rlike(_OUTGOING)
    tool = F.when(kind == "architecture", "repository_overview").when(kind == "impact", "analyze_impact").when(kind == "path", "trace_endpoint").when((kind == "dependency") & dependents, "get_dependents").when(kind == "dependency", "get_dependencies").otherwise("get_neighbors")
    return F.when(question.isNotNull(), tool)


def grounded(answers: DataFrame, seen: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(answer_id, valid, reason): whether an answer cites only what was retrieved for it.

    ``answers``: answer_id, intent, text, symbols, edge_ids (arrays of ids), paths (array of arrays). ``seen``: answer_id, kind ("node"
    or "edge"), id. ``dependencies``: src, dst. Symbols are needed and must be seen nodes, edges seen edges, paths seen nodes each of
    which depends on the next; an answer on impact may not state figures. The first reason in this order is given: metrics, symbols,
    edges, paths. Null arrays count as empty. Citations are exploded and joined, so no list of all that was seen is built.
    """
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    base = answers.select("answer_id", "intent", F.coalesce("text", F.lit("")).alias("text"), empty("symbols", "array<string>").alias("symbols"), empty("edge_ids", "array<string>").alias("edge_ids"), empty("paths", "array<array<string>>").alias("paths"))
    cited = lambda column, kind, reason: base.select("answer_id", F.explode(column).alias("id")).withColumn("kind", F.lit(kind)).withColumn("reason", F.lit(reason))
    all_cited = cited(F.col("symbols"), "node", 2).unionByName(cited(F.col("edge_ids"), "edge", 3)).unionByName(cited(F.flatten("paths"), "node", 4))
    unseen = all_cited.join(seen.select("answer_id", "kind", "id").distinct(), ["answer_id", "kind", "id"], "left_anti").select("answer_id", "reason")
    pairs = F.flatten(F.transform("paths", lambda p: F.when(F.size(p) > 1, F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("src"), F.slice(p, F.lit(2), F.size(p) - 1).alias("dst"))).otherwise(F.array().cast("array<struct<src:string,dst:string>>"))))
    steps = base.select("answer_id", F.explode(pairs).alias("s")).select("answer_id", "s.src", "s.dst")
    broken = steps.join(dependencies.select("src", "dst"), ["src", "dst"], "left_anti").select("answer_id", F.lit(4).alias("reason"))
    stated = base.where((F.col("intent") == "impact") & F.col("text").rlike(_STATED)).select("answer_id", F.lit(1).alias("reason"))
    nothing = base.where(F.size("symbols") == 0).select("answer_id", F.lit(2).alias("reason"))
    worst = unseen.unionByName(broken).unionByName(stated).unionByName(nothing).groupBy("answer_id").agg(F.min("reason").alias("reason"))
    names = F.array(*map(F.lit, ("metrics", "symbols", "edges", "paths")))
    return base.select("answer_id").join(worst, "answer_id", "left").select("answer_id", F.col("reason").isNull().alias("valid"), F.get(names, F.col("reason") - 1).alias("reason"))


def citations(graph: PropertyGraph, cited: DataFrame) -> DataFrame:
    """(answer_id, place, id, file_path, start_line, end_line) of what answers cite (answer_id, id, at): nodes in files, the first
    MOST_CITED of each answer by ``at``, then id."""
    nodes = graph.node_view("id", "type", "file_path", "start_line", "end_line").where((F.col("file_path") != "") & ~F.col("type").isin(*NOT_CITED))
    once = cited.groupBy("answer_id", "id").agg(F.min("at").alias("at")).join(nodes.drop("type"), "id")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("at", "id"))).where(F.col("place") <= MOST_CITED)
    return placed.select("answer_id", "place", "id", "file_path", "start_line", "end_line")


def impact_text(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, fact): the impact of a node (rows of :func:`impacts`; ``nodes``: id, name) in one sentence."""
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) and not x.isidentifier() else F.col(x).cast("string") for x in xs])
    fact = part("Impact of ", "name", ": ", "risk", " risk, ", "score", "/100. ", "blast_radius", " dependents (", "n_direct", " direct, ", "n_transitive", " transitive) in ", "n_files", " files and ", "n_modules", " modules, at most ", "depth", " hops away; ", "n_endpoints", " routes, ", "n_tables", " entities.")
    return impacts.join(nodes.select(F.col("id").alias("seed"), F.coalesce("name", F.lit("")).alias("name")), "seed").select("seed", fact.alias("fact"))


def architecture_text(overview: DataFrame, nodes: DataFrame, hubs: int = 4) -> DataFrame:
    """(repository_id, fact, symbols): a repository's overview in two sentences, with its first hubs that stand in a file as evidence."""
    placed = overview.select("repository_id", F.explode_outer(F.slice("hubs", 1, hubs)).alias("h")).select("repository_id", "h.place", "h.id")
    named = placed.join(nodes.where(F.col("file_path") != "").select("id", "name"), "id")
    listed = named.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "id"))).alias("x"))  # a handful each
    rows = overview.join(listed, "repository_id", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<place:int,name:string,id:string>>")))
    names = F.array_join(F.transform("x", lambda h: h["name"]), ", ")
    text = F.concat(F.col("files").cast("string"), F.lit(" source files with "), F.col("lines").cast("string"), F.lit(" lines and "), F.col("relationships").cast("string"), F.lit(" relationships. "), F.when(names != "", F.concat(F.lit("Most connected: "), names, F.lit(". "))).otherwise(""), F.coalesce(F.size("cycles"), F.lit(0)).cast("string"), F.lit(" dependency cycles."))
    return rows.select("repository_id", text.alias("fact"), F.transform("x", lambda h: h["id"]).alias("symbols"))
