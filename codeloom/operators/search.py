"""Symbol, text, semantic and hybrid search over nodes, for many queries at once; exact vector search."""

from __future__ import annotations

import re
from bisect import bisect_right
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, sifted

MOST_RESULTS, LEAST_CANDIDATES = 50, 30
#: Queries of no repository that are sent to all nodes at once, about.
QUERY_BLOCK = 1000
#: Nodes, or vectors, of one repository that one task compares with its queries; larger repositories are split.
NODES_A_TASK, VECTORS_A_TASK = 20_000, 100_000
MODES = ("symbol", "text", "semantic", "hybrid")
# fixed values: words that say nothing in a query, and types that are no results
STOP_WORDS = ("what", "where", "does", "the", "this", "that", "how", "which", "are", "is", "if", "it", "to", "from", "a", "an", "of", "in", "handled")
NOT_SEARCHED = ("Repository", "Directory", "UnresolvedSymbol", "Module")


def normal(query: Column) -> Column:
    """A query in lower case, blanks around it cut."""
    return F.btrim(F.lower(query), F.lit(" \t\r\n\f\v"))


def tokens(query: Column) -> Column:
    """Distinct words of a query (a letter, then letters, digits and underscores), without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(normal(query), F.lit(r"([a-z][a-z0-9_]+)"), 1)), F.array(*map(F.lit, STOP_WORDS)))


def searchable(nodes: DataFrame) -> DataFrame:
    """(id, repository_id, type, lname, text) of the nodes that can be found; text is qualified name, docstring and source in lower case."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return nodes.where(~F.col("type").isin(*NOT_SEARCHED)).select(
        "id", "repository_id", "type", F.lower(blank(F.col("name"))).alias("lname"), F.lower(F.concat_ws(" ", blank(F.col("qualified_name")), blank(F.col("docstring")), blank(F.col("source")))).alias("text")
    )


def exact_score(q: Column, name: Column, words: Column) -> Column:
    """1 where the query is the name, 0.9 where the name is one of its words, 0.65 where the name holds it, else 0."""
    return F.when(q == name, 1.0).when(F.array_contains(words, name), 0.9).when(name.contains(q), 0.65).otherwise(0.0)


def final_score(mode: str, exact: Column, whole: Column) -> Column:
    """Score of one hit in the symbol or text mode."""
    return exact if mode == "symbol" else whole.cast("double")


def search(queries: DataFrame, nodes: DataFrame, mode: str = "hybrid", k: int = 10, similarities: DataFrame | None = None) -> DataFrame:
    """(query_id, place, id, score, semantic_score, mechanism): the k best nodes for each query, ties by id.

    ``queries``: query_id, query, repository_id (null: any). ``nodes``: rows of the node table, one for each id. ``similarities``:
    query_id, id, similarity, one row for each pair; without it the semantic mode finds nothing. Scores are rounded to 4; hits score
    above 0; k is kept within 1 and 50. Queries of a repository meet its nodes only. Queries are a stated set: each node's text is
    shuffled once (in the semantic mode those of similar nodes only), large repositories are split into tasks to each of which their queries are sent, and only scores leave that
    stage; in the semantic and hybrid modes those of the k best nodes of each query and task, similarities being sent to the task that
    holds their node.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    k = min(MOST_RESULTS, max(1, k))
    asked = queries.select("query_id", F.col("repository_id").alias("of"), normal(F.col("query")).alias("q"), tokens(F.col("query")).alias("words")).where("query_id is not null and q is not null")
    if mode in ("semantic", "hybrid"):
        hits = _best_of_blocks(asked, searchable(nodes), mode, k, similarities)
    else:
        hits = _hits_of_pairs(asked, searchable(nodes), mode, similarities)
    ranked = hits.withColumn("score", F.round("raw", 4)).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)
    return ranked.select("query_id", "place", "id", "score", F.round("similarity", 4).alias("semantic_score"), "mechanism")


def _hits_of_pairs(asked: DataFrame, found: DataFrame, mode: str, similarities: DataFrame | None) -> DataFrame:
    pairs = _asked_of(asked, found)
    if similarities is not None:
        pairs = pairs.join(similarities.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    else:
        pairs = pairs.withColumn("similarity", F.lit(0.0))
    similarity = F.coalesce("similarity", F.lit(0.0))
    exact = exact_score(F.col("q"), F.col("lname"), F.col("words"))
    score = final_score(mode, exact, F.contains("text", "q"))
    mechanism = F.when(exact > 0, "symbol").when(similarity > 0, "semantic").otherwise("text")
    return pairs.select("query_id", "id", score.alias("raw"), similarity.alias("similarity"), mechanism.alias("mechanism")).where("raw > 0")


def _best_of_blocks(asked: DataFrame, found: DataFrame, mode: str, k: int, similarities: DataFrame | None) -> DataFrame:
    """The k best nodes of each query in each block of nodes; queries of no repository meet all nodes as if these were of one."""
    asked = materialize(asked, "search-queries")
    held = found.select("repository_id", "id", F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("double").alias("similarity"), (F.col("type") == "File").alias("is_file"), "lname", "text")
    if similarities is not None:
        near = similarities.where("query_id is not null and id is not null and similarity <> 0 and not isnan(similarity)").join(asked.select("query_id", "of").distinct(), "query_id")
        near = materialize(near.select(F.col("of").alias("repository_id"), "id", "query_id", F.col("similarity").cast("double").alias("similarity")), "search-similarities")
        if mode == "semantic":  # no other node scores above 0
            held = sifted(held, near.select("id"))

    def best(mine: DataFrame, nodes: DataFrame, those: Column, key: Column) -> DataFrame:
        if similarities is not None:
            nodes = nodes.unionByName(near.where(those), allowMissingColumns=True)
        mine, parts = split_repositories(mine.withColumn("repository_id", key).drop("of"), nodes.withColumn("repository_id", key), NODES_A_TASK)
        return mine.groupBy("repository_id", "part").cogroup(parts.groupBy("repository_id", "part")).applyInArrow(_block_hits(mode, k), _HITS)

    repository = F.col("repository_id")
    hits = best(asked.where("of is not null").withColumn("repository_id", F.col("of")), held.where("repository_id is not null"), repository.isNotNull(), repository)
    if not asked.where("of is null").isEmpty():
        hits = hits.unionByName(best(asked.where("of is null"), held, repository.isNull(), F.lit("")))
    return hits


_HITS = "query_id string, id string, raw double, similarity double, mechanism string"
_HITS_ARROW = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("raw", pa.float64()), ("similarity", pa.float64()), ("mechanism", pa.string())])
# exact scores by level, as in exact_score
_LEVELS = np.array([0.0, 0.65, 0.9, 1.0])
_RUN = re.compile(rb"[a-z0-9_]+")


class _Parts:
    """Short byte strings, none of which holds the byte 255, to be searched for others."""

    def __init__(self, parts: list[bytes]):
        self.text = b"\xff".join(parts)
        self.starts = list(accumulate((len(p) + 1 for p in parts), initial=0))

    def holding(self, wanted: bytes) -> list[int]:
        """Places of the parts that hold ``wanted``."""
        if not wanted:
            return list(range(len(self.starts) - 1))
        out, at = [], self.text.find(wanted)
        while at >= 0:
            out.append(bisect_right(self.starts, at) - 1)
            at = self.text.find(wanted, self.starts[out[-1] + 1])
        return out


class _Lists:
    """Lists of numbers by place, of which several are taken at once."""

    def __init__(self, places: list[int] | np.ndarray, values: list[int] | np.ndarray, n: int):
        order = np.argsort(places, kind="stable")
        self.values = np.asarray(values, np.int64)[order]
        self.bounds = np.searchsorted(np.asarray(places, np.int64)[order], np.arange(n + 1))

    def of(self, places: list[int]) -> np.ndarray:
        return np.concatenate([self.values[self.bounds[p] : self.bounds[p + 1]] for p in places]) if places else np.empty(0, np.int64)


def _holders(texts: list[bytes], words: set[bytes]) -> dict[bytes, np.ndarray]:
    """Numbers of the texts that hold each word. A word lies within one run of letters, digits and underscores, so distinct runs are searched."""
    runs: dict[bytes, int] = {}
    places, numbers = [], []
    for i, text in enumerate(texts):
        own = set(_RUN.findall(text))
        places += [runs.setdefault(run, len(runs)) for run in own]
        numbers += [i] * len(own)
    parts, lists = _Parts(list(runs)), _Lists(places, numbers, len(runs))
    return {w: np.unique(lists.of(parts.holding(w))) for w in words}


def _round4(x: np.ndarray) -> np.ndarray:
    """Rounded to 4 places as Spark does it: halves of the shortest decimal go up."""
    steps = x * 1e4
    out = np.floor(steps + 0.5) / 1e4
    half = np.abs(steps - np.floor(steps) - 0.5) < 1e-6
    values, back = np.unique(x[half], return_inverse=True)
    out[half] = np.array([float(Decimal(repr(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values.tolist()])[back]
    return out


def _block_hits(mode: str, k: int):
    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        nodes, near = held.filter(held.column("query_id").is_null()), held.filter(held.column("query_id").is_valid())
        if not len(asked) or not len(nodes):
            return _HITS_ARROW.empty_table()
        ids = nodes.column("id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # ties go to the smaller id
        nodes = nodes.take(pa.array(order))
        n, place = len(order), {ids[j]: i for i, j in enumerate(order)}
        similar: dict[str, dict[int, float]] = {}
        for query, id_, value in zip(*(near.column(c).to_pylist() for c in ("query_id", "id", "similarity"))):
            if id_ in place:
                similar.setdefault(query, {})[place[id_]] = value
        texts, names = ([x or b"" for x in nodes.column(c).cast(pa.binary()).to_pylist()] for c in ("text", "lname"))
        damp = np.where(nodes.column("is_file").to_numpy(zero_copy_only=False).astype(bool), 0.65, 1.0)
        called: dict[bytes, int] = {}
        own = [called.setdefault(name, len(called)) for name in names]
        parts, lists = _Parts(list(called)), _Lists(own, np.arange(n), len(called))
        questions = list(zip(asked.column("query_id").to_pylist(), (q.encode() for q in asked.column("q").to_pylist()), ([w.encode() for w in words] for words in asked.column("words").to_pylist())))
        holders = _holders(texts, {w for _, _, words in questions for w in words}) if mode == "hybrid" else {}
        where, columns, raws, sims, levels = [], [], [], [], []
        for i, (query, q, words) in enumerate(questions):
            mine = similar.get(query, {})
            if mode == "semantic" and not mine:
                continue
            similarity, level, count = np.zeros(n), np.zeros(n, np.int8), np.zeros(n, np.int32)
            similarity[list(mine)] = list(mine.values())
            for those, value in ((parts.holding(q), 1), ([called[w] for w in words if w in called], 2), ([called[q]] if q in called else [], 3)):
                level[lists.of(those)] = value
            if mode == "hybrid":
                for w in words:
                    count[holders[w]] += 1
                some = np.flatnonzero((similarity != 0) | (count > 0) | (level > 0))
            else:
                some = np.flatnonzero(similarity > 0)
                count[some] = [sum(w in texts[j] for w in words) for j in some]
            lexical = count[some] / max(1, len(words))
            if mode == "hybrid":
                raw = (0.5 * similarity[some] + 0.25 * lexical + _LEVELS[level[some]]) * damp[some]
            else:
                raw = (0.85 * similarity[some] + 0.15 * lexical) * damp[some]
            some, raw = some[raw > 0], raw[raw > 0]
            if len(some) > k:  # the k-th score, then all above it and the first of those equal to it
                score = _round4(raw)
                kth = np.partition(score, len(score) - k)[len(score) - k]
                take = np.sort(np.concatenate([np.flatnonzero(score > kth), np.flatnonzero(score == kth)])[:k])
                some, raw = some[take], raw[take]
            for column, values in zip((where, columns, raws, sims, levels), (np.full(len(some), i), some, raw, similarity[some], level[some])):
                column.append(values)
        if not where:
            return _HITS_ARROW.empty_table()
        where, columns, raws, sims, levels = map(np.concatenate, (where, columns, raws, sims, levels))
        mechanism = np.where(levels > 0, "symbol", np.where(sims > 0, "semantic", "text"))
        taken = [t.column(c).take(pa.array(rows)).combine_chunks() for t, c, rows in ((asked, "query_id", where), (nodes, "id", columns))]
        return pa.Table.from_arrays([*taken, pa.array(raws), pa.array(sims), pa.array(mechanism.tolist(), pa.string())], schema=_HITS_ARROW)

    return search


def _asked_of(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Each query with the nodes of its repository, by an equi-join; queries of no repository meet all nodes, in blocks of QUERY_BLOCK."""
    mine, parts = split_repositories(asked.where("of is not null").withColumnRenamed("of", "repository_id"), found, NODES_A_TASK)
    out = mine.join(parts, ["repository_id", "part"]).drop("part")
    anywhere = asked.where("of is null").drop("of")
    n = anywhere.count()
    blocks = -(-n // QUERY_BLOCK)
    for k in range(blocks):
        part = anywhere.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        out = out.unionByName(found.join(F.broadcast(part)))
    return out


def split_repositories(queries: DataFrame, held: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``part``: rows of ``held`` (id, repository_id, ...) of a repository of more than ``most`` rows are
    spread over several parts, and its queries are repeated for each. The sizes of large repositories are a written table, which
    Spark broadcasts if it is small."""
    sizes = held.groupBy("repository_id").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    sizes = materialize(sizes, "large-repositories")
    parts = F.coalesce("parts", F.lit(1))
    renewed = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns if c != "parts"])  # noqa: E731  both sides may stem from one table
    spread = held.join(sizes, "repository_id", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    repeated = queries.join(sizes, "repository_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return renewed(repeated), renewed(spread)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 20, dimensions: int = 64) -> DataFrame:
    """(query_id, place, id, score): the k most similar vectors of the query's repository; score is (1 + cosine) / 2, rounded to 6.

    ``queries``: query_id, repository_id, vector. ``vectors``: id, repository_id, embedding, one row for each id. Vectors and
    queries of another dimension, with values that aren't finite, or all zero are left out. The search is exact: queries, a
    stated set, meet the vectors of their repository as products of matrices in double precision, a block of at most
    VECTORS_A_TASK vectors a task, and each task keeps its k best, by rounded score, then id.
    """
    good = lambda c: (F.size(c) == dimensions) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    asked = queries.where(good(F.col("vector"))).select("query_id", "repository_id", F.col("vector").alias("v"))
    held = vectors.where(good(F.col("embedding"))).select("id", "repository_id", F.col("embedding").alias("v"))
    mine, parts = split_repositories(asked, held, VECTORS_A_TASK)
    best = mine.groupBy("repository_id", "part").cogroup(parts.groupBy("repository_id", "part")).applyInArrow(_block_search(k), _SCORED)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k).select("query_id", "place", "id", "score")


_SCORED = "query_id string, id string, score double"
_SCORED_ARROW = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])


def _unit_rows(table: pa.Table) -> np.ndarray:
    rows = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _block_search(k: int):
    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return _SCORED_ARROW.empty_table()
        order = np.argsort(np.array(held.column("id").to_pylist(), object), kind="stable")  # ties go to the smaller id
        held = held.take(pa.array(order))
        w, q = _unit_rows(held), _unit_rows(asked)
        n, keep = len(w), min(k, len(w))
        rows, columns, scores = [], [], []
        block = max(1, 4_000_000 // n)
        for at in range(0, len(q), block):
            score = np.round((1.0 + q[at : at + block] @ w.T) / 2, 6)
            # the k-th score, then all above it and the first of those equal to it
            kth = np.partition(score, n - keep, axis=1)[:, n - keep, None]
            above = score > kth
            equal = score == kth
            take = above | (equal & (np.cumsum(equal, axis=1) <= keep - above.sum(axis=1, keepdims=True)))
            i, j = np.nonzero(take)
            rows.append(i + at)
            columns.append(j)
            scores.append(score[i, j])
        i, j = np.concatenate(rows), np.concatenate(columns)
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(i)).combine_chunks(), held.column("id").take(pa.array(j)).combine_chunks(), pa.array(np.concatenate(scores))], schema=_SCORED_ARROW)

    return search


def candidates(k: int) -> int:
    """Vectors to look at for k results of a semantic or hybrid search."""
    return max(3 * k, LEAST_CANDIDATES)


# fixed values: types that get a vector, and lengths of the texts it is made of
EMBEDDED = ("File", "Function", "Method", "Class", "Interface", "Endpoint")
SOURCE_PART, WHOLE_PART, FILE_PART = 3500, 6000, 3000


def embedding_texts(nodes: DataFrame) -> DataFrame:
    """(id, hash, text) to embed: of symbols their names, signature, documentation, path and source; of files their path and the
    signatures of what they define, in order of seq. The signatures of a file are cut at FILE_PART, so few are ever gathered."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    symbol = F.substring(F.concat_ws("\n", blank("qualified_name"), blank("signature"), blank("docstring"), blank("file_path"), F.substring(blank("source"), 1, SOURCE_PART)), 1, WHOLE_PART)
    symbols = nodes.where(F.col("type").isin(*EMBEDDED) & (F.col("type") != "File")).select("id", "hash", symbol.alias("text"))
    by = Window.partitionBy("repository_id", "file_path").orderBy("seq", "id")
    signed = nodes.where(F.col("type").isin("Function", "Class", "Interface")).select("repository_id", "file_path", "seq", "id", blank("signature").alias("signature"))
    first = signed.withColumn("before", F.sum(F.length("signature") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < FILE_PART)
    listed = first.groupBy("repository_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "signature"))), lambda x: x["signature"]), "\n").alias("signatures"))
    files = nodes.where("type = 'File'").select("id", "hash", "repository_id", "file_path").join(listed, ["repository_id", "file_path"], "left")
    summary = F.concat(blank("file_path"), F.lit("\n"), F.substring(F.coalesce("signatures", F.lit("")), 1, FILE_PART))
    return symbols.unionByName(files.select("id", "hash", summary.alias("text")))


def reuse_vectors(wanted: DataFrame, cache: DataFrame, dimensions: int = 64) -> tuple[DataFrame, DataFrame]:
    """(kept, missing): vectors of ``cache`` (id, hash, embedding) that still hold for ``wanted`` (id, hash, text), and the rows that
    need a new one. A vector holds if id and hash are equal and its dimension is right."""
    good = cache.where(F.size("embedding") == dimensions).select("id", "hash", "embedding")
    both = wanted.join(good, ["id", "hash"], "left")
    return both.where("embedding is not null").select("id", "embedding"), both.where("embedding is null").select("id", "hash", "text")


def hashed_embeddings(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """(id, embedding) by hashing words into signed buckets, scaled to length one: the offline stand-in for an embedding model.
    Texts without words get zeros."""
    words = texts.select("id", F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z][a-z0-9]+)"), 1)).alias("word"))
    hashed = words.select("id", F.pmod(F.xxhash64("word"), F.lit(dimensions)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign"), F.col("word").isNotNull().alias("live"))
    sums = hashed.groupBy("id", "at").agg(F.sum(F.when(F.col("live"), F.col("sign")).otherwise(0.0)).alias("x"))
    maps = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    cell = lambda i: F.coalesce(F.try_divide(F.coalesce(F.try_element_at("m", i), F.lit(0.0)), F.col("norm")), F.lit(0.0)).cast("float")
    return maps.select("id", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), cell).alias("embedding"))


def retrieval_metrics(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row: n queries of ``expected`` (query_id, id), hit_rate (share with an expected id in the first k), recall (share of expected ids)."""
    found = expected.select("query_id", "id").distinct().join(hits.where(F.col("place") <= k).select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    per = found.groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("any"), F.avg(F.coalesce("hit", F.lit(0))).alias("part"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("any"), 6).alias("hit_rate"), F.round(F.avg("part"), 6).alias("recall"))
