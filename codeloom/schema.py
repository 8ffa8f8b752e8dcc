"""Node and edge tables of a code graph: schemas, type domains, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import counted, marked

# fixed values: columns of the two tables
NODES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("repository_id", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("signature", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("parameters", T.StringType()),
        T.StructField("returns", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_line", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("analysis_method", T.StringType()),
    ]
)

#: Columns that are too wide to be shuffled for the sake of a few repeated rows.
WIDE = ("source", "docstring", "embedding")

#: Repeated keys that are broadcast at most; if there are more, rows that may have one are told by a bit filter.
BROADCAST_KEYS = 100_000

# fixed values: edge types that are dependencies, and the structural rest
DEPENDENCIES = ("CALLS", "IMPORTS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "HANDLES", "ROUTES_TO", "DEPENDS_ON", "USES_PACKAGE", "READS_FROM", "WRITES_TO")
STRUCTURE = ("CONTAINS", "DEFINES", "BELONGS_TO")
# fixed values: confidence of an edge by its resolution
CONFIDENCE = {"resolved": 1.0, "probable": 0.65, "unresolved": 0.0}


def stable_id(*parts: Column | str) -> Column:
    """Key of an element: 24 hexadecimal digits of the SHA-256 of its parts, joined by colons. Numbers must be cast to strings;
    a null part counts as empty."""
    columns = [F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(":", *columns), 256), 1, 24)


def stable_key(*parts: str) -> str:
    """The same key for Python strings."""
    import hashlib

    return hashlib.sha256(":".join(parts).encode()).hexdigest()[:24]


def latest(rows: DataFrame, *columns: str, key: str = "id", wide: bool | None = None) -> DataFrame:
    """One row for each ``key``, the one with the highest seq (null lowest), with ``columns`` only; rows with a null key are left out.

    Select few columns: they are what is shuffled. Columns of WIDE are not: which delivery of a repeated key holds is found on
    (key, seq) alone, and the others are taken out of the scan by a join with the repeated keys (``wide``: always, or never). At most
    BROADCAST_KEYS of these are broadcast; if there are more, only rows that a bit filter lets through are shuffled for the join. Of
    rows with one key and one seq an arbitrary but whole one is kept, of wide rows the one with the greatest values.
    """
    if bool(set(columns) & set(WIDE)) if wide is None else wide:
        return _latest_wide(rows, columns, key)
    rest = [c for c in columns if c != key]
    place = F.coalesce("seq", F.lit(-(2**63)))
    if "seq" in rest:
        rest.remove("seq")
        picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_") if rest else F.lit(None).alias("_"), F.max("seq").alias("seq"))
        return picked.select(*[F.col(c) if c in (key, "seq") else F.col(f"_.{c}").alias(c) for c in columns])
    if not rest:
        return rows.where(F.col(key).isNotNull()).select(key).distinct()
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_"))
    return picked.select(*[F.col(c) if c == key else F.col(f"_.{c}").alias(c) for c in columns])


def _latest_wide(rows: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    place = F.coalesce("seq", F.lit(-(2**63)))
    whole = rows.where(F.col(key).isNotNull())
    counts = whole.groupBy(key, place.alias("_seq")).agg(F.count("*").alias("n")).groupBy(key).agg(F.max("_seq").alias("_top"), F.max_by("n", "_seq").alias("_tied"), F.sum("n").alias("n"))
    repeated, n = counted(counts.where("n > 1").select(key, "_top", "_tied"), "repeated-keys")
    rows_ = whole.select(*dict.fromkeys([key, *columns]), place.alias("_seq"))
    if n <= BROADCAST_KEYS:
        joined = rows_.join(F.broadcast(repeated), key, "left")
    else:
        tested = marked(rows_, repeated, key, "_may")
        joined = tested.where("_may").join(repeated, key, "left").drop("_may").unionByName(tested.where("not _may").drop("_may"), allowMissingColumns=True)
    once = joined.where("_top is null or _seq = _top")
    kept = once.where("_tied is null or _tied = 1").select(*columns)
    if repeated.where("_tied > 1").isEmpty():
        return kept
    rest = [c for c in columns if c != key]
    tied = once.where("_tied > 1").groupBy(key).agg(F.max(F.struct(*rest)).alias("_"))  # the same one whenever the view is read
    return kept.unionByName(tied.select(*[F.col(c) if c == key else F.col(f"_.{c}").alias(c) for c in columns]))


def dependency(type_: str = "type", resolution: str = "resolution") -> Column:
    """Predicate of edges that count as dependencies: a dependency type, and resolved at least probably."""
    return F.col(type_).isin(*DEPENDENCIES) & (F.coalesce(F.col(resolution), F.lit("")) != "unresolved")
