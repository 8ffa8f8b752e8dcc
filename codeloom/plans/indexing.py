"""Queries that extract and resolve the source files of the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.runner import extracted
from ..graph import PropertyGraph
from ..operators.index import index_files
from .sql import graph_sql


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = PropertyGraph.read(spark, folder).node_view("id", "type", "repository_id", "file_path", "source").where("type = 'File'")
    return files.select("repository_id", "file_path", F.col("source").alias("text"))


def ext_03_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """All symbols extracted from all source files, callbacks without a name among them."""
    rows = extracted(_files(spark, folder)).select("repository_id", "file_path", F.explode("symbols").alias("s"))
    return rows.select("s.id", "repository_id", "file_path", "s.name", "s.type", "s.start_line", "s.end_line").distinct()


def ext_03_index(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of the index, and whether extraction finds each with the same name, type and lines."""
    found = ext_03_symbols(spark, folder).select("id", "name", "type", "start_line", "end_line").withColumn("hit", F.lit(True))
    held = PropertyGraph.read(spark, folder).node_view("id", "name", "type", "start_line", "end_line").where(F.col("type").isin("Function", "Method", "Class", "Interface"))
    return held.join(found, ["id", "name", "type", "start_line", "end_line"], "left").select("id", "name", "type", F.coalesce("hit", F.lit(False)).alias("found"))


def ext_03_surplus(spark: SparkSession, folder: str) -> DataFrame:
    """Number of extracted symbols by type that the index lacks, and how many of these are callbacks without a name."""
    held = PropertyGraph.read(spark, folder).nodes.select("id").distinct()
    rest = ext_03_symbols(spark, folder).join(held, "id", "left_anti")
    return rest.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("name").startswith("callback@")).alias("n_callbacks"))


def ext_13_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Number of references of each kind by language."""
    return extracted(_files(spark, folder)).select("language", F.explode("refs").alias("r")).groupBy("language", F.col("r.kind").alias("kind")).agg(F.count("*").alias("n"))


def ext_17_imports(spark: SparkSession, folder: str) -> DataFrame:
    """What each source file imports, by local name."""
    return extracted(_files(spark, folder)).select("repository_id", "file_path", F.explode("imports").alias("i")).select("repository_id", "file_path", "i.local", "i.module", "i.imported", "i.line")


def res_06_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all source files: number of edges by type, resolution and types of their ends."""
    graph, _ = index_files(_files(spark, folder))
    nodes = graph.nodes.select("id", "type")
    ends = graph.edges.join(nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")
    return ends.groupBy("source_type", "type", "target_type", "resolution").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ext_03_symbols, ext_03_index, ext_03_surplus, ext_13_calls, ext_17_imports, res_06_index)}

ORACLES = {"ext_03_index": graph_sql("SELECT id, name, type, true AS found FROM n WHERE type IN ('Function', 'Method', 'Class', 'Interface')")}
