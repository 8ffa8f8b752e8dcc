"""Differences between two versions of keyed rows, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traverse import capped, risk_level

# fixed values: fields whose change counts, in the order in which they are listed
NODE_FIELDS = ("hash", "name", "type", "qualified_name", "file_path", "start_line", "end_line", "signature", "docstring", "module", "exported", "parameters", "returns")
EDGE_FIELDS = ("source", "target", "type", "source_file", "source_line", "confidence", "resolution", "analysis_method")
MOST_EVIDENCE = 200


def differing(fields: tuple[str, ...] | list[str], base: str = "b", head: str = "h") -> Column:
    """Names of the fields that differ, in the order given; null equals null."""
    flags = [F.when(~F.col(f"{base}.{f}").eqNullSafe(F.col(f"{head}.{f}")), F.lit(f)) for f in fields]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def compare_rows(base: DataFrame, head: DataFrame, fields: tuple[str, ...] | list[str], keys: tuple[str, ...] = ("id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, change, changed_fields, keep columns) of rows added, removed or modified from ``base`` to ``head``.

    Both sides need one row for each key, without nulls in it; rows that differ in no field have no result. ``keep`` columns are
    those of the head, of removed rows those of the base. One full outer join on the keys.
    """
    columns = list(dict.fromkeys([*fields, *keep]))
    b = base.select(*keys, F.struct(*columns).alias("b"))
    h = head.select(*keys, F.struct(*columns).alias("h"))
    both = b.join(h, list(keys), "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("modified")
    changed = F.when(F.col("b").isNull() | F.col("h").isNull(), F.array().cast("array<string>")).otherwise(differing(fields))
    rows = both.select(*keys, change.alias("change"), changed.alias("changed_fields"), *[F.coalesce(F.col(f"h.{c}"), F.col(f"b.{c}")).alias(c) for c in keep])
    return rows.where((F.col("change") != "modified") | (F.size("changed_fields") > 0))


def compare_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Changes of nodes, with what a report shows of them."""
    return compare_rows(base, head, NODE_FIELDS, keep=("name", "type", "qualified_name", "file_path", "module", "start_line", "end_line", "signature"))


def compare_edges(base: DataFrame, head: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changes of edges, with the names of their ends (``nodes``: id, qualified_name, name; else the raw id)."""
    rows = compare_rows(base, head, EDGE_FIELDS, keep=("source", "target", "type", "source_file", "source_line", "resolution"))
    label = F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), F.col("name"))
    names = nodes.select("id", label.alias("label"))
    out = rows
    for end in ("source", "target"):
        out = out.join(names.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
    return out


def risk(nodes: DataFrame, edges: DataFrame | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, affected files, modules, endpoints and entities, score and risk of a comparison; one row for each of ``by``.

    ``nodes`` as :func:`compare_nodes` makes them (``by`` columns kept), ``edges`` as :func:`compare_edges`, or None. Without
    ``by`` there is one row, also for no change.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    label = F.coalesce(text("qualified_name") if "qualified_name" in nodes.columns else F.lit(None), text("name") if "name" in nodes.columns else F.lit(None), F.col("id"))
    module = text("module") if "module" in nodes.columns else F.lit(None).cast("string")
    part = nodes.select(*by, F.lit("n").alias("what"), "change", text("file_path").alias("file"), module.alias("module"), F.when(F.col("type") == "Endpoint", label).alias("endpoint"), F.when(F.col("type") == "DatabaseEntity", label).alias("entity"))
    if edges is not None:
        none = F.lit(None).cast("string")
        part = part.unionByName(edges.select(*by, F.lit("e").alias("what"), "change", text("source_file").alias("file"), none.alias("module"), none.alias("endpoint"), none.alias("entity")))
    count = lambda what, change: F.count_if((F.col("what") == what) & (F.col("change") == change))
    sums = [count(w, c).alias(f"{n}_{c}") for w, n in (("n", "symbols"), ("e", "relationships")) for c in ("added", "removed", "modified")]
    sums += [F.countDistinct(c).alias(n) for c, n in (("file", "n_files"), ("module", "n_modules"), ("endpoint", "n_endpoints"), ("entity", "n_entities"))]
    rows = part.groupBy(*by).agg(*sums)
    symbols = F.col("symbols_added") + F.col("symbols_removed") + F.col("symbols_modified")
    relations = F.col("relationships_added") + F.col("relationships_removed") + F.col("relationships_modified")
    score = capped(symbols, 4, 40) + capped(relations, 2, 20) + capped("n_files", 3, 15) + capped("n_endpoints", 5, 10) + capped("n_entities", 5, 10) + capped("symbols_removed", 1, 5)
    return rows.withColumn("score", F.least(F.lit(100), score)).withColumn("risk", risk_level("score", 60, 25))


def evidence(changes: DataFrame, by: tuple[str, ...] = (), limit: int = MOST_EVIDENCE) -> DataFrame:
    """The first ``limit`` changes (of each of ``by``): added, then removed, then modified, each by id; ``truncated`` tells if there are more."""
    order = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    if not by:
        n = changes.count()
        return changes.withColumn("rank_", order).orderBy("rank_", "id").limit(limit).drop("rank_").withColumn("truncated", F.lit(n > limit))
    counts = changes.groupBy(*by).agg((F.count("*") > limit).alias("truncated"))
    placed = changes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, "id"))).where(F.col("place") <= limit)
    return placed.drop("place").join(counts, list(by))
