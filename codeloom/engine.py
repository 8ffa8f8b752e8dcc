"""One graph with all its operators: methods, named tools with checked arguments, and SQL views."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import search, structure, traverse

LONGEST_ARGUMENT, SOURCE_PART = 4000, 6000
# bounds of what tools return: search results, nodes and hops around a symbol
TOOL_RESULTS, TOOL_NODES, TOOL_HOPS = 8, 50, 3
# fixed values: names of the tools with the arguments each takes
TOOLS = {
    "semantic_search": ("query",),
    "search_symbol": ("name",),
    "get_symbol": ("symbol_id",),
    "get_source": ("symbol_id",),
    "find_callers": ("symbol_id",),
    "find_callees": ("symbol_id",),
    "get_neighbors": ("symbol_id", "depth"),
    "shortest_path": ("source_id", "target_id"),
    "trace_endpoint": ("endpoint_id",),
    "analyze_impact": ("symbol_id",),
    "repository_overview": (),
    "search_code": ("query",),
    "get_dependencies": ("symbol_id",),
    "get_dependents": ("symbol_id",),
}


class GraphEngine:
    """Operators on one graph. Methods take a DataFrame of start nodes (id), or ids; results are DataFrames, computed when read."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.spark: SparkSession = graph.nodes.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> GraphEngine:
        """The graph of a data folder."""
        return cls(PropertyGraph.read(spark, folder))

    def ids(self, *names: str) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "id string")

    def _starts(self, starts: DataFrame | str) -> DataFrame:
        return self.ids(starts) if isinstance(starts, str) else starts

    def register_views(self, prefix: str = "") -> list[str]:
        """Temporary views ``nodes``, ``edges`` (one row for each id) and ``deps`` for SQL; returns their names."""
        views = {"nodes": self.graph.node_view(*[c for c in self.graph.nodes.columns if c != "seq"]), "edges": self.graph.edge_view(*[c for c in self.graph.edges.columns if c != "seq"]), "deps": self.graph.dependencies()}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in views]

    def symbol(self, starts: DataFrame | str) -> DataFrame:
        """Nodes without source and vector."""
        rows = self.graph.node_view("id", "name", "type", "repository_id", "qualified_name", "file_path", "language", "start_line", "end_line", "signature", "docstring", "module", "exported")
        return rows.join(self._starts(starts).select("id").distinct(), "id", "left_semi")

    def source(self, starts: DataFrame | str) -> DataFrame:
        """(id, source) of nodes, cut to SOURCE_PART characters."""
        return self.graph.node_view("id", "source").join(self._starts(starts).select("id").distinct(), "id", "left_semi").select("id", F.substring("source", 1, SOURCE_PART).alias("source"))

    def files(self, repository_id: str) -> DataFrame:
        """(id, file_path, module, language, end_line) of a repository's files, by path; files of no module are of "root"."""
        rows = self.graph.node_view("id", "type", "repository_id", "file_path", "module", "language", "end_line").where((F.col("type") == "File") & (F.col("repository_id") == repository_id))
        return rows.select("id", "file_path", F.coalesce(F.when(F.col("module") != "", F.col("module")), F.lit("root")).alias("module"), "language", "end_line").orderBy("file_path", "id")

    def source_at(self, repository_id: str, path: str) -> DataFrame:
        """(id, source) of the file that stands at exactly this path, whole."""
        at = (F.col("type") == "File") & (F.col("repository_id") == repository_id) & (F.col("file_path") == path)
        return PropertyGraph(self.graph.nodes.where(at), self.graph.edges).node_view("id", "source")

    def only(self, node_type: str | None = None, relationship: str | None = None) -> GraphEngine:
        """The graph of the nodes of one type, and the edges of one type between them (None: of any type)."""
        nodes = self.graph.nodes if node_type is None else self.graph.nodes.where(F.col("type") == node_type)
        edges = self.graph.edges if relationship is None else self.graph.edges.where(F.col("type") == relationship)
        ends = nodes.select("id").distinct()
        kept = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
        return GraphEngine(PropertyGraph(nodes, kept.select(*edges.columns)))

    def neighbours(self, starts: DataFrame | str, depth: int = 1, types: tuple[str, ...] = (), direction: str = "both", limit: int = traverse.LIMIT) -> DataFrame:
        return traverse.neighbourhood(self.graph, self._starts(starts), depth, types, direction, limit)

    def paths(self, pairs: DataFrame, directed: bool = True) -> DataFrame:
        return traverse.shortest_paths(self.graph, pairs, directed)

    def traces(self, starts: DataFrame | str) -> DataFrame:
        return traverse.traces(self.graph, self._starts(starts), with_paths=True)

    def impacts(self, starts: DataFrame | str) -> DataFrame:
        return traverse.impacts(self.graph, self._starts(starts))

    def callers(self, starts: DataFrame | str) -> DataFrame:
        return traverse.calls_around(self.graph, self._starts(starts)).where("direction = 'caller'")

    def callees(self, starts: DataFrame | str) -> DataFrame:
        return traverse.calls_around(self.graph, self._starts(starts)).where("direction = 'callee'")

    def overview(self) -> DataFrame:
        return structure.overview(self.graph)

    def find(self, query: str, mode: str = "hybrid", k: int = 10, repository_id: str | None = None) -> DataFrame:
        """The k best nodes for one query, by names and text; similarities of an embedding model can be passed to :func:`search.search`."""
        nodes = self.graph.node_view("id", "type", "repository_id", "name", "qualified_name", "docstring", "source")
        asked = self.spark.createDataFrame([("q", query, repository_id)], "query_id string, query string, repository_id string")
        return search.search(asked, nodes, mode, k)

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        """The tools by name."""
        near = lambda id_, depth=1, types=(), direction="both": self.neighbours(id_, min(TOOL_HOPS, depth), types, direction, TOOL_NODES)
        return {
            "semantic_search": lambda query: self.find(query, "hybrid", TOOL_RESULTS),
            "search_symbol": lambda name: self.find(name, "symbol", TOOL_RESULTS),
            "get_symbol": self.symbol,
            "get_source": self.source,
            "find_callers": lambda symbol_id: near(symbol_id, types=("CALLS",), direction="in"),
            "find_callees": lambda symbol_id: near(symbol_id, types=("CALLS",), direction="out"),
            "get_neighbors": near,
            "shortest_path": lambda source_id, target_id: self.paths(self.spark.createDataFrame([(source_id, target_id)], "source string, target string")),
            "trace_endpoint": self.traces,
            "analyze_impact": self.impacts,
            "repository_overview": self.overview,
            "search_code": lambda query: self.find(query, "text", TOOL_RESULTS),
            "get_dependencies": lambda symbol_id: near(symbol_id, TOOL_HOPS, direction="out"),
            "get_dependents": self.impacts,
        }

    def run(self, tool: str, arguments: dict[str, Any]) -> DataFrame:
        """Run a tool by name. Raises ValueError for unknown tools, arguments that are missing, unknown, of the wrong type or too long,
        and ids that are no nodes. ``depth`` may be left out."""
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool!r}")
        allowed = set(TOOLS[tool])
        if not set(arguments) <= allowed or not allowed - {"depth"} <= set(arguments):
            raise ValueError(f"{tool} takes {', '.join(TOOLS[tool]) or 'no arguments'}")
        for name, value in arguments.items():
            if name == "depth":
                if isinstance(value, bool) or not isinstance(value, int):
                    raise ValueError("depth must be a whole number")
            elif not isinstance(value, str) or not value or len(value) > LONGEST_ARGUMENT:
                raise ValueError(f"{name} must be a text of 1 to {LONGEST_ARGUMENT} characters")
        wanted = {v for n, v in arguments.items() if n.endswith("_id")}
        known = {r.id for r in self.graph.nodes.where(F.col("id").isin(*wanted)).select("id").distinct().collect()} if wanted else set()
        if wanted - known:
            raise ValueError(f"unknown ids: {', '.join(sorted(wanted - known))}")
        return self.tools()[tool](*[arguments[n] for n in TOOLS[tool] if n in arguments])
