"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are put into cells around centroids (fitted on a bounded sample; every vector is indexed). A vector is searched for in its
nearest cell, and stands to be found in every cell whose centroid is nearly as near. Within a cell, vectors are centred, rotated
at random and reduced to one bit a dimension with two correction scalars. A searched vector is rotated too and quantised to four
bits a dimension; inner products are estimated from the packed bits by population counts, with an error bound. Vectors whose upper
bound reaches the worst exact similarity so far are reranked exactly; all others cannot (up to the bound's confidence) be among
the most similar. That is done where a confidence is given; else a cell's vectors are compared by products of matrices, which lose
nothing and take a tenth of the time a pair (numpy, 64 to 1024 dimensions). Whatever may tie with the last place is kept until cosines are rounded, then ids decide. Copies of one direction
(of any length) are one entry with their smallest ids, so groups of copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Vectors a centroid is fitted on, and vectors at most for all centroids together.
SAMPLE_PER_CELL, SAMPLE = 200, 200_000
#: Cells: the square root of the number of vectors over CELL_FACTOR, at most MOST_CELLS.
CELL_FACTOR, MOST_CELLS = 3.0, 16_384
#: A vector stands in the cells whose centroid's cosine is within MARGIN of its nearest one's, at most SPILL of them.
MARGIN, SPILL = 0.3, 12
#: Standard errors of the bound on estimates.
CONFIDENCE = 3.0
#: Similarities in single precision that lie so near may be equal once they are rounded to 6 decimals.
TIE = 1e-5
#: Directions are one entry if all their coordinates are equal in steps of 1 / GRID, the step of the cosines.
GRID = 1e6
#: A cell is worked off in blocks of so many searched and so many found vectors at most.
QUERY_BLOCK, MEMBER_BLOCK = 20_000, 60_000

_RESULT = "vid string, ids array<string>, near array<string>, sims array<double>, parted boolean"


def usable(embedding: Column, dimensions: int) -> Column:
    """True for arrays of exactly ``dimensions`` finite numbers, not all zero; never null."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(embedding, lambda x: x == 0)
    return F.coalesce((F.size(embedding) == dimensions) & ~bad & ~zero, F.lit(False))


def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    """A random rotation, always the same for one seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, computed in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors; cells that run empty are moved to the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    centroids = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = np.empty(len(sample), np.int64)
        fit = np.empty(len(sample), np.float32)
        for at in range(0, len(sample), 8192):
            s = sample[at : at + 8192] @ centroids.T
            own[at : at + 8192] = s.argmax(axis=1)
            fit[at : at + 8192] = s.max(axis=1)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(cells))
        counts = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centroids)
        full = counts > 0
        sums[full] = np.add.reduceat(sample[order], starts[full], axis=0)
        empty = np.flatnonzero(~full)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centroids)
    return centroids.astype(np.float32)


class OneBitCodes:
    """One-bit codes of unit vectors around a centre, and estimates of inner products with searched vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.dimensions = vectors.shape[1]
        self.centre, self.turn = centre, turn
        rest = (vectors - centre) @ turn.T
        self.length = np.linalg.norm(rest, axis=1)
        direction = rest / np.maximum(self.length, 1e-12)[:, None]
        bits = direction > 0
        self.words = self.pack(bits)
        self.ones = bits.sum(axis=1).astype(np.float32)
        # inner product of a direction with its code, by which estimates are corrected
        self.fit = np.maximum(np.abs(direction).sum(axis=1) / math.sqrt(self.dimensions), 1e-6).astype(np.float32)
        self.error = (np.sqrt(np.maximum(0, 1 - self.fit**2)) / self.fit / math.sqrt(max(1, self.dimensions - 1))).astype(np.float32)
        self.with_centre = (vectors @ centre).astype(np.float32)
        self.centre_square = float(centre @ centre)

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Bits of each row in 64-bit words."""
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        return packed.view(np.uint64)

    def estimate(self, searched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products with all coded vectors, half-widths of their bounds at one standard error)."""
        d = self.dimensions
        rest = (searched - self.centre) @ self.turn.T
        length = np.linalg.norm(rest, axis=1)
        direction = rest / np.maximum(length, 1e-12)[:, None]
        low = direction.min(axis=1, keepdims=True)
        step = np.maximum((direction.max(axis=1, keepdims=True) - low) / 15, 1e-12)
        levels = np.rint((direction - low) / step).astype(np.uint8)
        total = np.zeros((len(searched), len(self.words)), np.uint16)
        for bit in range(4):
            planes = self.pack((levels >> bit) & 1)
            for w in range(planes.shape[1]):
                total += np.bitwise_count(planes[:, w, None] & self.words[None, :, w]).astype(np.uint16) << bit
        product = (2 * (step * total + low * self.ones) - (step * levels.sum(axis=1, keepdims=True) + low * d)) / np.float32(math.sqrt(d))
        product = product.astype(np.float32)
        scale = length.astype(np.float32)[:, None] * self.length.astype(np.float32)[None, :]
        mine = (searched @ self.centre).astype(np.float32)[:, None]
        estimate = mine + self.with_centre[None, :] - self.centre_square + scale * product / self.fit[None, :]
        return estimate, scale * self.error[None, :]


def search_cell(searched: np.ndarray, found: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, confidence: float | None = CONFIDENCE) -> list[np.ndarray]:
    """For each searched unit vector, the positions in ``found`` of the k most similar (in single precision) and of all that may
    tie with the k-th, unordered. Without a ``confidence`` all are compared exactly."""
    if confidence is None:
        return list(_compare_all(searched, found, k))
    codes = OneBitCodes(found, centre, turn)
    out: list[np.ndarray] = []
    n = len(found)
    first = min(n, 3 * k)
    block = max(16, 2_000_000 // max(1, n))
    for at in range(0, len(searched), block):
        q = searched[at : at + block]
        estimate, width = codes.estimate(q)
        if first < n:
            likely = np.argpartition(estimate, n - first, axis=1)[:, n - first :]
        else:
            likely = np.broadcast_to(np.arange(n), (len(q), n))
        exact = np.einsum("qd,qkd->qk", q, found[likely])
        kth = np.partition(exact, max(0, first - k), axis=1)[:, max(0, first - k)]
        estimate += confidence * width
        may = estimate >= kth[:, None] - TIE
        np.put_along_axis(may, likely, False, axis=1)
        rows, columns = np.nonzero(may)
        sims = np.empty(len(rows), np.float32)
        for a in range(0, len(rows), 200_000):
            sims[a : a + 200_000] = np.einsum("pd,pd->p", q[rows[a : a + 200_000]], found[columns[a : a + 200_000]])
        bounds = np.searchsorted(rows, np.arange(len(q) + 1))
        for i in range(len(q)):
            places = np.concatenate([likely[i], columns[bounds[i] : bounds[i + 1]]])
            values = np.concatenate([exact[i], sims[bounds[i] : bounds[i + 1]]])
            out.append(places[values >= np.partition(values, len(values) - k)[-k] - TIE] if len(values) > k else places)
    return out


def _near(searched: np.ndarray, found: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in searched, in found) of the k most similar and all that may tie with the k-th, in blocks of searched vectors."""
    n = len(found)
    block = max(1, 2_000_000 // max(1, n))
    groups = n // 32
    for at in range(0, len(searched), block):
        sims = searched[at : at + block] @ found.T
        if groups > 4 * k:
            # k groups have a member that reaches the k-th best of the groups' best
            best = sims[:, : 32 * groups].reshape(len(sims), 32, groups).max(axis=1)
            least = np.partition(best, groups - k, axis=1)[:, groups - k]
        elif n > k:
            least = np.partition(sims, n - k, axis=1)[:, n - k]
        else:
            least = np.full(len(sims), -np.inf, np.float32)
        i, j = np.nonzero(sims >= least[:, None] - np.float32(TIE))
        yield i + at, j


def _compare_all(searched: np.ndarray, found: np.ndarray, k: int) -> Iterator[np.ndarray]:
    for i, j in _near(searched, found, k) if len(found) else ():
        yield from np.split(j, np.flatnonzero(np.diff(i)) + 1)


def _best_of_cell(raw: np.ndarray, q: np.ndarray, m: np.ndarray, by_id: np.ndarray, k: int, near: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, positions of the k most similar, cosines) of the vectors ``q``, from positions (in q, in m) that may be among them,
    which come in blocks, all of one vector in one block. Cosines are in double precision, rounded to 6; equal ones go by ``by_id``."""
    rows = raw.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    norms = np.linalg.norm(rows, axis=1)
    for i, j in near:
        a, b = q[i], m[j]
        sims = np.empty(len(a))
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            sims[at : at + 50_000] = np.einsum("pd,pd->p", rows[x], rows[y]) / (norms[x] * norms[y])
        sims = np.round(sims, 6) + 0.0
        order = np.lexsort((by_id[b], -sims, a))
        a, b, sims = a[order], b[order], sims[order]
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
            end = min(end, start + k)
            yield int(a[start]), b[start:end], sims[start:end]


def _nearest(entries: list[tuple[float, str]], k: int) -> tuple[list[str], list[float]]:
    """First k ids by descending similarity, then by id."""
    best = sorted(entries, key=lambda e: (-e[0], e[1]))[:k]
    return [i for _, i in best], [s for s, _ in best]


def _cell_searcher(centroids: np.ndarray, held_blocks: np.ndarray, turn: np.ndarray, k: int, confidence: float | None):
    want = k + 1  # the vector itself is among the entries

    def search(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        vectors = table.column("embedding").combine_chunks()
        raw = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        asked = table.column("asked").to_numpy(zero_copy_only=False)
        held = table.column("held").to_numpy(zero_copy_only=False)
        vid = table.column("vid").to_pylist()
        ids = table.column("ids").to_pylist()
        q, m = np.flatnonzero(asked), np.flatnonzero(held)
        units = unit(raw)
        by_id = np.empty(len(vid), np.int64)  # places of the entries' smallest ids in order
        by_id[sorted(range(len(vid)), key=vid.__getitem__)] = np.arange(len(vid))
        rows: dict[str, list] = {"vid": [], "ids": [], "near": [], "sims": [], "parted": []}
        parted = bool(held_blocks[cell] > 1)
        if confidence is None:
            near = _near(units[q], units[m], want)
        else:
            near = ((np.full(len(places), i), places) for i, places in enumerate(search_cell(units[q], units[m], centroids[cell], turn, want, confidence)))
        # later entries hold no id that comes before the smallest ids of these
        for i, others, sims in _best_of_cell(raw, q, m, by_id, want, near) if len(m) else ():
            best, values = _nearest([(s, x) for s, j in zip(sims.tolist(), others.tolist()) for x in ids[j]], want)
            for column, value in zip(rows, (vid[i], ids[i], best, values, parted)):
                rows[column].append(value)
        return pa.table(rows, schema=pa.schema([("vid", pa.string()), ("ids", pa.list_(pa.string())), ("near", pa.list_(pa.string())), ("sims", pa.list_(pa.float64())), ("parted", pa.bool_())]))

    return search


def _cell_assigner(centroids: np.ndarray, asked_blocks: np.ndarray, held_blocks: np.ndarray, margin: float, most: int):
    schema = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("asked", pa.bool_()), ("held", pa.bool_()), ("vid", pa.string()), ("ids", pa.list_(pa.string())), ("embedding", pa.list_(pa.float32()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sims = unit(raw) @ centroids.T
            spill = min(most, sims.shape[1])
            top = np.argpartition(-sims, spill - 1, axis=1)[:, :spill]
            values = np.take_along_axis(sims, top, axis=1)
            best = sims.argmax(axis=1)
            near = values >= values.max(axis=1, keepdims=True) - margin
            rows, places = np.nonzero(near)
            cells = top[rows, places]
            hashes = batch.column("h").to_numpy(zero_copy_only=False).astype(np.uint64)[rows]
            own = cells == best[rows]
            qn, mn = asked_blocks[cells], held_blocks[cells]
            qb, mb = (hashes % qn.astype(np.uint64)).astype(np.int64), ((hashes >> np.uint64(20)) % mn.astype(np.uint64)).astype(np.int64)
            # a task is a pair of a block of searched and a block of found vectors of a cell
            out = []
            for i in range(int((qn * mn).max())):
                a, b = i // mn, i % mn
                live = i < qn * mn
                asked, held = live & own & (a == qb), live & (b == mb)
                take = np.flatnonzero(asked | held)
                out.append((take, np.full(len(take), i), asked[take], held[take]))
            take = np.concatenate([x[0] for x in out])
            columns = batch.select(["vid", "ids", "embedding"]).take(pa.array(rows[take]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[take].astype(np.int32)), pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out])), *columns.columns],
                schema=schema,
            )

    return assign


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each vector that was compared with several blocks of its cell: the k + 1 best of all."""
    entry = F.transform("near", lambda x: F.struct((-x["sims"]).alias("down"), x["near"].alias("near")))
    best = found.groupBy("vid").agg(F.first("ids").alias("ids"), F.flatten(F.collect_list(entry)).alias("all")).select("vid", "ids", F.slice(F.array_sort(F.array_distinct("all")), 1, k + 1).alias("best"))
    return best.select("vid", "ids", F.transform("best", lambda x: F.struct(x["near"].alias("near"), (F.lit(0.0) - x["down"]).alias("sims"))).alias("near"))


def neighbours(vectors: DataFrame, k: int = 5, dimensions: int = 64, margin: float = MARGIN, spill: int = SPILL, confidence: float | None = None, exact: bool = False) -> DataFrame:
    """The k most similar others of each vector: id, rank (from 1), near_id, similarity (cosine rounded to 6).

    ``vectors`` needs id, embedding, seq; other columns are ignored. Usable are arrays of exactly ``dimensions`` finite numbers,
    not all zero; rows with a null id or another embedding are left out. Of several usable rows with one id the one with the
    highest seq counts (null is lowest). Equal similarities rank by id. With fewer than k + 1 vectors, each gets what there is.
    Results are exact but for vectors that stand in no common cell or, where a ``confidence`` (:data:`CONFIDENCE`) is given and codes
    are compared, fall below the error bound; directions that agree in all
    coordinates to 6 decimals count as one, with the cosines of that of the smallest id. A larger ``margin``, ``spill`` and
    ``confidence`` lose less, and no confidence the least. With ``exact`` nothing is lost: all vectors are one cell, worked off block against block without
    codes; the work then grows with the square of their number.
    """
    spark = vectors.sparkSession
    good = vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), dimensions)).select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce("seq", F.lit(-(2**63))).alias("seq"))
    one = good.groupBy("id").agg(F.max_by("embedding", F.struct("seq", F.xxhash64("embedding"))).alias("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a value that is computed once and used several times
    direction = bound(F.lit(GRID) / length, lambda scale: F.transform("embedding", lambda x: F.rint(x.cast("double") * scale).cast("int")))
    hashes = bound(direction, lambda d: F.struct(F.xxhash64(d).alias("v1"), F.xxhash64(F.lit(7), d).alias("v2")))
    one = materialize(one.withColumn("h", hashes).select("id", "embedding", "h.v1", "h.v2"), "vectors")
    # copies: the smallest ids of each distinct direction stand for it
    place = F.row_number().over(Window.partitionBy("v1", "v2").orderBy("id"))
    heads = one.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = materialize(
        heads.groupBy("v1", "v2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("embedding", "id").alias("embedding")).select(F.col("ids")[0].alias("vid"), "ids", "embedding", F.xxhash64(F.col("ids")[0], F.lit(3)).alias("h")),
        "vector-entries",
    )
    n = entries.count()
    if exact:
        confidence = None
    cells = 1 if exact else int(min(MOST_CELLS, max(1, round(math.sqrt(n) / CELL_FACTOR))))
    size = min(SAMPLE, SAMPLE_PER_CELL * cells)
    share = min(1.0, size / max(1, n))
    drawn = entries.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").limit(2 * size).toArrow()
    if not drawn.num_rows:
        drawn = entries.select("embedding").limit(1).toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "id string, rank int, near_id string, similarity double")
    sample = unit(drawn.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(drawn.num_rows, -1))
    centroids = fit_centroids(sample, cells)
    turn = rotation(dimensions)
    # blocks of each cell, from the sample's counts
    sims = sample @ centroids.T
    scale = n / len(sample)
    asked = np.bincount(sims.argmax(axis=1), minlength=len(centroids)) * scale
    held = (sims >= sims.max(axis=1, keepdims=True) - margin).sum(axis=0) * scale
    asked_blocks = np.maximum(1, np.ceil(asked / QUERY_BLOCK)).astype(np.int64)
    held_blocks = np.maximum(1, np.ceil(held / MEMBER_BLOCK)).astype(np.int64)
    placed = entries.mapInArrow(_cell_assigner(centroids, asked_blocks, held_blocks, margin, spill), "cell int, part int, asked boolean, held boolean, vid string, ids array<string>, embedding array<float>")
    found = placed.groupBy("cell", "part").applyInArrow(_cell_searcher(centroids, held_blocks, turn, k, confidence), _RESULT)
    found = materialize(found.select("vid", "ids", F.arrays_zip("near", "sims").alias("near"), "parted"), "vector-neighbours")
    if (held_blocks > 1).any():
        found = found.where("not parted").select("ids", "near").unionByName(materialize(_merged(found.where("parted"), k), "vector-neighbours-of-blocks").select("ids", "near"))
    direct = found.select(F.explode("ids").alias("id"), "near")
    # ids of large groups of copies that don't stand for their vector take its list; spread, as one group may be very large
    parts = 16
    listed = found.where(F.size("ids") > k).select(F.explode("ids").alias("head"), "near", "ids").where(F.col("head") == F.col("ids")[0])
    large = one.select("id", "v1", "v2").join(listed.select(F.col("head").alias("id"), "ids", "near"), "id").select("v1", "v2", "ids", "near", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    rest = one.select("id", "v1", "v2", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).join(large, ["v1", "v2", "part"]).where(~F.array_contains("ids", F.col("id"))).select("id", "near")
    return (
        direct.unionByName(rest)
        .select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["near"] != F.col("id")), 1, k)).alias("rank", "entry"))
        .select("id", (F.col("rank") + 1).alias("rank"), F.col("entry.near").alias("near_id"), F.col("entry.sims").alias("similarity"))
    )


def neighbour_pairs(vectors: DataFrame, k: int = 5, dimensions: int = 64, exact: bool = False) -> DataFrame:
    """Pairs id_a < id_b of which at least one is among the k most similar others of the other one, once each."""
    links = neighbours(vectors, k, dimensions, exact=exact)
    return links.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()
