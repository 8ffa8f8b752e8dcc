"""Session helpers: configuration defaults, shared checkpoint folder, input spreading."""

from __future__ import annotations

import atexit
import contextlib
import math
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys a 64-bit word of a filter is made for, and words at most (64 MB): beyond, more rows pass, and none is lost.
KEYS_PER_WORD, MOST_WORDS = 5, 1 << 22


def build_session(app: str = "codeloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use; on a cluster, use the cluster's own session."""
    root = str(Path(__file__).resolve().parents[1])  # Python workers inherit the variable
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the one named by ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one machine: any of its folders is shared
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = "file://" + os.path.join(tempfile.gettempdir(), "codeloom-shared")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors. The files go when the driver
    ends; an application that is killed leaves them in the folder ``codeloom-<application id>``."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`materialize`, and the number of rows, which is observed while they are written."""
    path = new_path(df.sparkSession, name)
    n = write_counted(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), n


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` to a new folder; returns the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that doesn't exist yet and goes when the driver ends."""
    folder = f"{shared_dir(spark)}/codeloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clean_up, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_folders: set[str] = set()


def _clean_up(spark: SparkSession, folder: str) -> None:
    """Delete what an application has materialized, when its driver ends."""
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def marked(rows: DataFrame, keys: DataFrame, key: str = "id", mark: str = "may_be") -> DataFrame:
    """``rows`` with a column ``mark``: true where the row's ``key`` is among those of ``keys``, and in about one of a hundred other rows;
    else false. Nothing of ``rows`` is shuffled: they are tested against a bit filter, which is broadcast. ``keys`` is read twice."""
    words = min(MOST_WORDS, 1 << max(6, math.ceil(math.log2(keys.count() / KEYS_PER_WORD + 1))))
    word, bit = F.pmod(F.xxhash64(key), F.lit(words)), lambda shift: f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{key}`, 1), {shift}) & 63 as int))"
    mask = F.expr(f"{bit(0)} | {bit(6)} | {bit(12)}")
    bits = keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))  # at most MOST_WORDS rows
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").withColumn(mark, F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_word", "_bits")


def sifted(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows that :func:`marked` marks: before a join with few keys, so that the other rows aren't shuffled for it."""
    return marked(rows, keys, key, "_may_be").where("_may_be").drop("_may_be")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores, before CPU-heavy Python work.

    A scan with enough splits is returned unchanged, so nothing is shuffled at scale.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df
