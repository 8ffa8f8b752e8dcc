"""Versioned graphs: codec, upsert, retention, atomic publication; and small tables of repositories, runs and sessions."""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.utils import AnalysisException

from ..session import materialize

# fixed value: the name of the interchange format (compact JSON with sorted keys, zlib level 6, base64)
FORMAT = "zlib-json-v1"
KEPT_SNAPSHOTS, KEPT_RUNS, LISTED = 20, 200, 100


def encode_snapshot(nodes: list[dict], edges: list[dict]) -> str:
    """Text of a graph, without vectors: base64 of compressed JSON with sorted keys."""
    data = {"edges": edges, "nodes": [{**n, "embedding": []} for n in nodes]}
    return base64.b64encode(zlib.compress(json.dumps(data, separators=(",", ":"), sort_keys=True).encode(), 6)).decode()


def decode_snapshot(payload: str) -> dict:
    """The graph of such a text; raises ValueError if it is none."""
    try:
        data = json.loads(zlib.decompress(base64.b64decode(payload, validate=True)))
    except (ValueError, TypeError, zlib.error) as e:
        raise ValueError("invalid snapshot") from e
    if not isinstance(data, dict) or not isinstance(data.get("nodes"), list) or not isinstance(data.get("edges"), list):
        raise ValueError("invalid snapshot")
    return data


@F.pandas_udf(StringType())
def pack_text(text: pd.Series) -> pd.Series:
    """base64 of compressed UTF-8; null stays null."""
    return text.map(lambda t: None if t is None else base64.b64encode(zlib.compress(t.encode(), 6)).decode())


@F.pandas_udf(StringType())
def unpack_text(text: pd.Series) -> pd.Series:
    """Inverse of :func:`pack_text`; what is no such text becomes null."""

    def one(t):
        try:
            return None if t is None else zlib.decompress(base64.b64decode(t, validate=True)).decode()
        except (ValueError, zlib.error):
            return None

    return text.map(one)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of rows of equal keys; ``rows`` must not repeat a key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def newest(rows: DataFrame, by: str, limit: int, order: str = "created_at", tie: str = "id") -> DataFrame:
    """The ``limit`` newest rows of each ``by``, ties by the larger ``tie``. The window is cut to the limit before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(order), F.desc_nulls_last(tie)))
    return rows.withColumn("place_", place).where(F.col("place_") <= limit).drop("place_")


def visible_to(owner: Column | str, user: str) -> Column:
    """Rows a user may see: their own, and for the user "local" also those without an owner."""
    column = F.col(owner) if isinstance(owner, str) else owner
    return F.coalesce(column == user, F.lit(False)) | (column.isNull() & F.lit(user == "local"))


def set_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows with some columns replaced where ``condition`` holds (null: doesn't hold)."""
    return rows.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def cascade(tables: dict[str, DataFrame], repository_id: str, key: str = "repository_id") -> dict[str, DataFrame]:
    """All tables without the rows of one repository; the table "repositories" is keyed by id."""
    return {n: t.where(~F.coalesce(F.col("id" if n == "repositories" else key) == repository_id, F.lit(False))) for n, t in tables.items()}


# fixed values: columns of repositories that are not shown, those that hold JSON, and the columns of a run that are shown
HIDDEN = ("source_root", "source", "overview", "owner_id")
JSON_COLUMNS = ("logs", "warnings", "last_pr_guardian")
RUN_COLUMNS = ("id", "status", "pull_request", "pr_url", "head_sha", "command", "delivery_id", "retry_of", "created_at", "updated_at", "started_at", "completed_at", "failed_at", "review_status", "policy_status", "comment_url", "error")
# fixed values: states in which a repository is being worked on
ACTIVE = ("QUEUED", "CLONING", "SCANNING", "PARSING", "BUILDING_GRAPH", "EMBEDDING", "ANALYZING")


def public_repositories(rows: DataFrame) -> DataFrame:
    """Repositories without the columns of HIDDEN; texts of JSON are parsed to variants (unreadable ones are null)."""
    shown = rows.select(*[c for c in rows.columns if c not in HIDDEN])
    return shown.withColumns({c: F.try_parse_json(c) for c in JSON_COLUMNS if c in shown.columns})


def public_runs(rows: DataFrame) -> DataFrame:
    """(id, run): the shown columns of each run as JSON, null and empty ones left out."""
    fields = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in RUN_COLUMNS if c in rows.columns]
    return rows.select("id", F.to_json(F.struct(*fields)).alias("run"))


def active(status: Column | str = "status", sync_status: Column | str = "sync_status") -> Column:
    """Whether a repository is being indexed or synchronised; never null."""
    on = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).isin(*ACTIVE), F.lit(False))
    return on(status) | on(sync_status)


def sessions(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, repository_id, state) of the sessions ``asked`` for (id, repository_id), once each; one that isn't ``held`` is empty."""
    empty = json.dumps({"messages": [], "symbols": []})
    keys = ["id", "repository_id"]
    return asked.select(*keys).distinct().join(held.select(*keys, "state"), keys, "left").select(*keys, F.coalesce("state", F.lit(empty)).alias("state"))


def merged(first: DataFrame, *later: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several tables, one for each key: that of the last table that has it. Keys must not repeat within a table; rows with a
    null key are left out."""
    parts = [part.select(*first.columns).withColumn("rank_", F.lit(i)) for i, part in enumerate((first, *later))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("rank_").alias("rank_"))
    return rows.join(best, [key, "rank_"]).select(*first.columns)


_SHA = re.compile(r"[0-9a-fA-F]{40,64}")


class GraphStore:
    """Versions of graphs in a folder: each is written to a folder of its own, then one small pointer table names it, so readers see
    the old graph or the new one whole. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/pointers")
        except AnalysisException:
            return None

    def publish(self, repository_id: str, commit_sha: str, nodes: DataFrame, edges: DataFrame) -> str:
        """Write a version and make it the current one of its repository; the same commit again replaces it. Returns its name."""
        version = uuid.uuid4().hex
        ends = nodes.select("id")
        nodes.write.parquet(f"{self.root}/versions/{version}/nodes")
        linked = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
        linked.select(*edges.columns).write.parquet(f"{self.root}/versions/{version}/edges")
        row = self.spark.createDataFrame([(repository_id, commit_sha, version)], "repository_id string, commit_sha string, version string").withColumn("created_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")
        return version

    def snapshots(self) -> DataFrame:
        """(repository_id, commit_sha, version, created_at): the newest version of each commit, the KEPT_SNAPSHOTS newest of a repository."""
        pointers = self._pointers()
        if pointers is None:
            return self.spark.createDataFrame([], "repository_id string, commit_sha string, version string, created_at timestamp")
        last = pointers.groupBy("repository_id", "commit_sha").agg(F.max(F.struct("created_at", "version")).alias("s")).select("repository_id", "commit_sha", "s.version", "s.created_at")
        return newest(last, "repository_id", KEPT_SNAPSHOTS, tie="version")

    def prune(self) -> int:
        """Delete all versions but those of :meth:`snapshots`, and write their pointers anew; returns how many went. A reader that has
        opened an older version loses it."""
        pointers = self._pointers()
        if pointers is None:
            return 0
        kept = materialize(self.snapshots(), "kept-versions")
        gone = [r.version for r in pointers.select("version").distinct().join(kept, "version", "left_anti").collect()]  # one name a version
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(path(f"{self.root}/pointers"))]
        kept.select("repository_id", "commit_sha", "version", "created_at").coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")
        for file in old:  # readers see a version twice for a moment, and never miss one
            fs.delete(file, False)
        for version in gone:
            fs.delete(path(f"{self.root}/versions/{version}"), True)
        return len(gone)

    def compare(self, repository_id: str, base_sha: str, head_sha: str) -> tuple[DataFrame, DataFrame]:
        """(changes of nodes, changes of edges) from one version to another. ValueError for names that are no commits or are the same,
        KeyError with the commits that are missing."""
        from ..operators.versions import compare_edges, compare_nodes

        if not (_SHA.fullmatch(base_sha) and _SHA.fullmatch(head_sha)):
            raise ValueError("a commit has 40 to 64 hexadecimal digits")
        if base_sha == head_sha:
            raise ValueError("two different versions are needed")
        held = {r.commit_sha for r in self.snapshots().where((F.col("repository_id") == repository_id) & F.col("commit_sha").isin(base_sha, head_sha)).collect()}
        missing = [sha for sha in (base_sha, head_sha) if sha not in held]
        if missing:
            raise KeyError(*missing)
        (base, base_edges), (head, head_edges) = self.read(repository_id, base_sha), self.read(repository_id, head_sha)
        names = merged(base.select("id", "qualified_name", "name"), head.select("id", "qualified_name", "name"))
        return compare_nodes(base, head), compare_edges(base_edges, head_edges, names)

    def read(self, repository_id: str, commit_sha: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a version, by default the current one; raises KeyError if there is none."""
        rows = self.snapshots().where(F.col("repository_id") == repository_id)
        if commit_sha is not None:
            rows = rows.where(F.col("commit_sha") == commit_sha)
        row = rows.orderBy(F.desc("created_at"), F.desc("version")).first()
        if row is None:
            raise KeyError((repository_id, commit_sha))
        at = f"{self.root}/versions/{row.version}"
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")
