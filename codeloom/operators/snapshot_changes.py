"""Changes between consecutive full snapshots of keyed tables.

Design. Rows are reduced to compact arrays (snapshot ordinal, 128-bit key hash, 64-bit row hash, delivery position) before
anything is shuffled, and repeated deliveries are combined on the map side, so a key delivered very often costs one row a
map task. Compact rows are hash-bucketed by key; each bucket is sorted in numpy and neighbouring snapshots are compared by
``searchsorted`` set differences. Only for keys that differ is the full value (here: the id) fetched: rows are tested against a
bit filter of the differing rows while they are scanned, and what passes is joined on the key hash and delivery position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one bucket; a bucket is what one task sorts in memory (44 bytes a row).
BUCKET_ROWS = 1_000_000

#: Differing keys a 64-bit word of the filter is made for, and words at most (64 MB): beyond, more rows pass, and none is lost.
KEYS_PER_WORD, MOST_WORDS = 5, 1 << 22

_COMPACT = "ord int, last int, k1 long, k2 long, row long, seq long"
_COLUMNS = ("ord", "last", "k1", "k2", "row", "seq")
_DIFFER = "ord int, k1 long, k2 long, seq long, kind byte"
KINDS = ("added", "removed", "changed")


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """Ordinal (from 0) of each snapshot within its repository by created_at, and the last ordinal of the repository.

    Repeated rows of one (repository_id, commit_sha) count once, at their earliest created_at; equal times are ordered by
    commit_sha. Rows with a null repository_id, commit_sha or created_at have no place in the order and are left out.
    """
    whole = snapshots.select("repository_id", "commit_sha", "created_at").dropna()
    once = whole.groupBy("repository_id", "commit_sha").agg(F.min("created_at").alias("created_at"))
    by = Window.partitionBy("repository_id")
    return once.select(
        "repository_id",
        "commit_sha",
        (F.row_number().over(by.orderBy("created_at", "commit_sha")) - 1).alias("ord"),
        (F.count("*").over(by).cast("int") - 1).alias("last"),
    )


def _arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    rows = pa.Table.from_batches(batches)
    return {c: rows.column(c).to_numpy() for c in _COLUMNS}


def _latest(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted by key and ordinal, with the highest delivery position of each (key, ordinal)."""
    order = np.lexsort((a["row"], a["seq"], a["ord"], a["k2"], a["k1"]))
    a = {c: v[order] for c, v in a.items()}
    if not len(order):
        return a
    same = (a["k1"][1:] == a["k1"][:-1]) & (a["k2"][1:] == a["k2"][:-1]) & (a["ord"][1:] == a["ord"][:-1])
    keep = np.append(~same, True)
    return {c: v[keep] for c, v in a.items()}


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side combine: one row per (key, ordinal) of up to BUCKET_ROWS input rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BUCKET_ROWS:
            yield pa.RecordBatch.from_pydict(_latest(_arrays(held)))
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_pydict(_latest(_arrays(held)))


def diff_arrays(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Differences between neighbouring ordinals of each key, of arrays as :func:`_latest` returns them."""
    n = len(a["ord"])
    first = np.ones(n, bool)
    first[1:] = (a["k1"][1:] != a["k1"][:-1]) | (a["k2"][1:] != a["k2"][:-1])
    width = int(a["ord"].max(initial=0)) + 3
    place = np.cumsum(first).astype(np.int64) * width + a["ord"]  # ascending, one per (key, ordinal)
    before = np.searchsorted(place, place - 1)
    has_before = (before < n) & (place[np.minimum(before, n - 1)] == place - 1) if n else np.zeros(0, bool)
    after = np.searchsorted(place, place + 1)
    has_after = (after < n) & (place[np.minimum(after, n - 1)] == place + 1) if n else np.zeros(0, bool)
    added = ~has_before & (a["ord"] > 0)
    removed = ~has_after & (a["ord"] < a["last"])
    changed = has_before.copy()
    changed[has_before] = a["row"][has_before] != a["row"][before[has_before]]
    parts = [(added, 0, 0), (removed, 1, 1), (changed, 0, 2)]
    return {
        "ord": np.concatenate([a["ord"][m] + step for m, step, _ in parts]).astype(np.int32),
        **{c: np.concatenate([a[c][m] for m, _, _ in parts]) for c in ("k1", "k2", "seq")},
        "kind": np.concatenate([np.full(m.sum(), kind, np.int8) for m, _, kind in parts]),
    }


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield pa.RecordBatch.from_pydict(diff_arrays(_latest(_arrays(held))))


def _word(words: int) -> Column:
    """The word of the filter that a row falls into."""
    return F.pmod(F.xxhash64("k1", "k2", "seq"), F.lit(words))


def _mask() -> Column:
    """The three bits that a row sets in its word."""
    bit = lambda shift: f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(seq, k2, k1), {shift}) & 63 as int))"
    return F.expr(f"{bit(0)} | {bit(6)} | {bit(12)}")


def _may_differ(full: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows (k1, k2, seq) that may be among ``differ``: all that are, and about one in a hundred others. Nothing is shuffled."""
    words = min(MOST_WORDS, 1 << max(6, math.ceil(math.log2(differ.count() / KEYS_PER_WORD + 1))))
    bits = differ.select(_word(words).alias("word"), _mask().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    tested = full.withColumns({"word": _word(words), "mask": _mask()}).join(F.broadcast(bits), "word")  # at most MOST_WORDS rows
    return tested.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(*full.columns)


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, buckets: int | None = None) -> DataFrame:
    """Ids added, removed or changed in hash, for each snapshot against the preceding one of its repository.

    ``rows`` needs seq, commit_sha, id, hash; ``snapshots`` needs repository_id, commit_sha, created_at; other columns, also
    with clashing names, are ignored. Result: commit_sha (of the later snapshot), id, change_kind in added, removed, changed.

    Defined cases: of several rows with one (commit_sha, id) the highest seq holds (null seq is lowest; with equal seq and
    unequal hashes an arbitrary but fixed one of them). Hashes are compared in lower case without surrounding blanks, null
    being equal to "". Rows with a null id or commit_sha, and rows of commits that ``snapshots`` doesn't hold, have no place
    and are left out. A snapshot without rows is empty: everything of its predecessor is removed. Empty tables give an empty
    result. ``buckets`` defaults to one per BUCKET_ROWS rows, at least the session's parallelism.
    """
    spark = rows.sparkSession
    if buckets is None:
        buckets = max(min(spark.sparkContext.defaultParallelism, 64), math.ceil(rows.count() / BUCKET_ROWS))
    order = snapshot_order(snapshots)
    # the row's own repository_id plays no part: a commit belongs to one repository
    keyed = rows.select("commit_sha", "id", F.coalesce("seq", F.lit(-(2**63))).cast("long").alias("seq"), "hash").where(
        F.col("id").isNotNull() & F.col("commit_sha").isNotNull()
    )
    compact = keyed.join(order, "commit_sha").select(
        "ord",
        "last",
        F.xxhash64("repository_id", "id").alias("k1"),
        F.xxhash64("id", "repository_id", F.lit(1)).alias("k2"),
        F.xxhash64(F.lower(F.btrim(F.coalesce("hash", F.lit("")), F.lit(" \t\r\n\f\v")))).alias("row"),
        "seq",
    )
    combined = compact.mapInArrow(_combine, _COMPACT)
    bucketed = combined.repartitionById(buckets, F.pmod("k1", F.lit(buckets)).cast("int"))
    differ = materialize(bucketed.mapInArrow(_bucket, _DIFFER), "differing-keys")
    full = (
        keyed.join(order.select("commit_sha", "repository_id"), "commit_sha")
        .select("repository_id", "id", "seq")
        .select(
            "repository_id",
            "id",
            "seq",
            F.xxhash64("repository_id", "id").alias("k1"),
            F.xxhash64("id", "repository_id", F.lit(1)).alias("k2"),
        )
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return (
        _may_differ(full, differ)
        .join(differ, ["k1", "k2", "seq"])
        .groupBy("k1", "k2", "seq", "ord", "kind")  # rows repeated with one seq; no further shuffle
        .agg(F.first("repository_id").alias("repository_id"), F.first("id").alias("id"))
        .join(order.select("repository_id", "ord", "commit_sha"), ["repository_id", "ord"])
        .select("commit_sha", "id", F.get(kinds, F.col("kind").cast("int")).alias("change_kind"))
    )
