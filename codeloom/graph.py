"""A property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import dependency, latest
from .sources.tables import table


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes and edges, repeated deliveries among them; the views below keep one row for each id."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> PropertyGraph:
        """The graph of the tables ``code_nodes`` and ``code_edges`` of a folder."""
        return cls(table(spark, folder, "code_nodes"), table(spark, folder, "code_edges"))

    def node_view(self, *columns: str) -> DataFrame:
        """One row for each node, with these columns; the highest seq counts."""
        return latest(self.nodes, *columns)

    def edge_view(self, *columns: str) -> DataFrame:
        """One row for each edge, with these columns; the highest seq counts."""
        return latest(self.edges, *columns)

    def links(self, *types: str) -> DataFrame:
        """Distinct (src, dst) of all edges, or of those of ``types``."""
        rows = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        return rows.select(F.col("source").alias("src"), F.col("target").alias("dst")).dropna().distinct()

    def dependencies(self) -> DataFrame:
        """Distinct (src, dst) of dependency edges; several edges of a pair are one."""
        return self.edges.where(dependency()).select(F.col("source").alias("src"), F.col("target").alias("dst")).dropna().distinct()
