"""Changed line ranges of unified diffs, the symbols they touch, and what depends on these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..session import materialize
from .traverse import impacts

MOST_IMPACTS, MOST_CHANGED = 20, 50
# fixed values: types of symbols that a changed range is mapped to
SYMBOLS = ("Class", "Interface", "Function", "Method", "Endpoint", "DatabaseEntity")
# fixed value: the head of a hunk
_HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# fixed value: paths of tests, case-folded
_TEST_PATH = r"(?:^|/)(?:test|tests|__tests__|spec|specs)/|(?:^|/)test_[^/]*$|(?:_test\.py|\.(?:test|spec)\.(?:jsx?|tsx?))$"


def is_test_path(path: str | Column) -> Column:
    """Whether a path is one of a test; never null."""
    column = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.lower(column).rlike(_TEST_PATH), F.lit(False))


def changed_ranges(patches: DataFrame) -> DataFrame:
    """(keys, side, start, end) of the hunks of each patch (keys, patch), both sides; keys are all columns but the patch.

    A missing count is 1, a count of 0 is widened to 1. Null and empty patches have none; equal ranges of a patch count once.
    """
    keys = [c for c in patches.columns if c != "patch"]
    part = lambda g: F.regexp_extract_all("patch", F.lit(_HUNK), g)
    hunks = patches.where("patch is not null").select(*keys, F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d"))).alias("h"))
    size = lambda c: F.greatest(F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(1)), F.lit(1))
    sides = F.array(
        F.struct(F.lit("base").alias("side"), F.expr("try_cast(h.a as int)").alias("start"), size("h.b").alias("n")), F.struct(F.lit("head").alias("side"), F.expr("try_cast(h.c as int)").alias("start"), size("h.d").alias("n"))
    )
    return hunks.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", "s.start", (F.col("s.start") + F.col("s.n") - 1).alias("end")).where("start is not null").distinct()


def changed_symbols(graph: PropertyGraph, files: DataFrame) -> DataFrame:
    """(repository_id, path, id, fallback) of the symbols that changed files touch.

    ``files``: repository_id, path, previous_path, patch. A file is looked up by its path, else by its previous path. Symbols
    overlap a hunk, or are all symbols of the file where the patch has no hunk; if there is none, the File node stands for it
    (fallback). Files the graph doesn't know have no row. Ranges and symbols meet on repository and path, then by overlap.
    """
    nodes = graph.node_view("id", "type", "repository_id", "file_path", "start_line", "end_line").where(F.col("file_path") != "")
    known = nodes.select("repository_id", F.col("file_path").alias("path")).distinct().withColumn("known", F.lit(True))
    listed = files.select("repository_id", "path", "previous_path", "patch").distinct()
    at = listed.join(known, ["repository_id", "path"], "left").withColumn("at", F.when(F.col("known"), F.col("path")).otherwise(F.col("previous_path"))).drop("known")
    ranges = changed_ranges(at.select("repository_id", "path", "at", "patch"))
    has = ranges.select("repository_id", "path").distinct()
    symbols = nodes.where(F.col("type").isin(*SYMBOLS)).withColumnRenamed("file_path", "at")
    touched = ranges.join(symbols, ["repository_id", "at"]).where((F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start"))).select("repository_id", "path", "id")
    whole = at.join(has, ["repository_id", "path"], "left_anti").join(symbols, ["repository_id", "at"]).select("repository_id", "path", "id")
    found = touched.unionByName(whole).distinct()
    rest = at.join(found.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_anti")
    files_ = nodes.where("type = 'File'").groupBy("repository_id", F.col("file_path").alias("at")).agg(F.min("id").alias("id"))
    fallback = rest.join(files_, ["repository_id", "at"]).select("repository_id", "path", "id").distinct()
    return found.withColumn("fallback", F.lit(False)).unionByName(fallback.withColumn("fallback", F.lit(True)))


def change_impacts(graph: PropertyGraph, changed: DataFrame, limit: int | None = None, analysed: int | None = MOST_CHANGED) -> DataFrame:
    """Impacts of changed symbols (repository_id, path, id): the columns of :func:`impacts` with repository_id and place, the highest
    score first, then the widest; the first ``limit`` of a repository. The first ``analysed`` symbols of a repository are looked
    at, by path, then id (None: all)."""
    looked = first_changed(changed, analysed)
    return ranked_impacts(looked, impacts(graph, looked.select("id").distinct()), limit)


def first_changed(changed: DataFrame, analysed: int | None = MOST_CHANGED) -> DataFrame:
    """(repository_id, id): the first ``analysed`` changed symbols (repository_id, path, id) of each repository, by path, then id."""
    symbols = changed.groupBy("repository_id", "id").agg(F.min("path").alias("path"))
    if analysed is not None:
        symbols = symbols.withColumn("at", F.row_number().over(Window.partitionBy("repository_id").orderBy("path", "id"))).where(F.col("at") <= analysed)
    return materialize(symbols.select("repository_id", "id"), "analysed")


def ranked_impacts(looked: DataFrame, impacts_: DataFrame, limit: int | None = None) -> DataFrame:
    """Impacts (seed, ...) of symbols (repository_id, id) with their place in the repository."""
    scored = looked.join(impacts_.withColumnRenamed("seed", "id"), "id")
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("score"), F.desc("blast_radius"), "id")))
    return placed if limit is None else placed.where(F.col("place") <= limit)


def roll_up(impacts_: DataFrame, changed: DataFrame) -> DataFrame:
    """Per repository: files_changed, symbols_changed, score (the highest), risk."""
    counts = changed.groupBy("repository_id").agg(F.countDistinct("path").alias("files_changed"), F.countDistinct("id").alias("symbols_changed"))
    top = impacts_.groupBy("repository_id").agg(F.max("score").alias("score"))
    rows = counts.join(top, "repository_id", "left").fillna(0, ["score"])
    return rows.withColumn("risk", F.when(F.col("score") >= 65, "HIGH").when(F.col("score") >= 30, "MEDIUM").otherwise("LOW"))


def coverage_gaps(graph: PropertyGraph, changed: DataFrame) -> DataFrame:
    """(repository_id, id) of changed symbols outside tests that no test depends on within the bounds of impacts."""
    from .traverse import impact_reach

    paths = graph.node_view("id", "file_path")
    _, reached = impact_reach(graph, changed.select("id").distinct())
    tested = reached.join(paths, "id").where(is_test_path("file_path")).select(F.col("seed").alias("id")).distinct()
    own = changed.select("repository_id", "id").distinct().join(paths, "id").where(~is_test_path("file_path"))
    return own.join(tested, "id", "left_anti").select("repository_id", "id")
