"""Mixing sources to target shares of tokens, by entropy balancing.

Each document gets a rate, as near to one copy as possible in relative entropy, such that every source reaches its target of
tokens and no rate exceeds the source's cap. The dual of this convex problem has one multiplier a source, and its solution tilts
rates exponentially in document size: rate = min(cap, exp(multiplier * tokens / mean tokens)). Newton steps need two sums a
source, which are aggregated over a table of (source, tokens) counts. Rates are then rounded to whole copies by a threshold on
hashed fractions, set for each source so that its tokens are met to within a document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread

#: Vocabulary of the public tokenizer: a file of base64 tokens and ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before that vocabulary's merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Newton steps, after which the range that holds the multiplier is halved.
NEWTON_STEPS = 30
TOLERANCE = 1e-9
BINS = 4096


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(re.sub(r"\W", "_", path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for batch in batches:
            sizes = [len(x) for x in encoding.encode_ordinary_batch(batch["text"].tolist(), num_threads=1)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": sizes})

    return count


def source_name(column):
    """One spelling of a source: lower case, blanks around it cut, runs of blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.btrim(column)), r"[\s\-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (one spelling, null kept), n_tokens of each document with a text that isn't empty."""
    scan = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return spread(scan).mapInPandas(_counter(tokenizer), "doc_id long, source string, n_tokens long")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and cap of each source; at most 10 000 sources can be mixed. Repeated rows count once."""
    rows = targets.where("source is not null and target_share is not null").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = rows.groupBy("source").agg(F.max("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 sources")
    return {r.source: (float(r.share), int(r.cap)) for r in rows if r.share > 0 and r.cap > 0}


def solve_multipliers(sizes: DataFrame, goals: dict[str, tuple[float, float, int]]) -> dict[str, float]:
    """Multiplier of each source, by safeguarded Newton steps; one aggregation over ``sizes`` (source, n_tokens, n) a step.

    ``goals`` has for each source the tokens to reach, the mean tokens of its documents, and the cap; a goal must lie below
    cap times the source's tokens. A source is solved when its tokens are met to TOLERANCE, or no number lies between the two that
    enclose its multiplier. Newton steps that don't get there are followed by halvings, which always do; ArithmeticError if sums
    aren't numbers.
    """
    spark = sizes.sparkSession
    at = dict.fromkeys(goals, 0.0)
    low = dict.fromkeys(goals, -math.inf)
    high = dict.fromkeys(goals, math.inf)
    open_ = set(goals)
    steps = 0
    while open_:
        table = F.broadcast(spark.createDataFrame([(s, at[s], goals[s][1], math.log(goals[s][2]), float(goals[s][2])) for s in sorted(open_)], "source string, m double, mean double, log_cap double, cap double"))
        x = F.col("n_tokens") / F.col("mean")
        free = F.col("m") * x < F.col("log_cap")
        rate = F.when(free, F.exp(F.col("m") * x)).otherwise(F.col("cap"))
        sums = sizes.join(table, "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("n_tokens") * rate).alias("reached"), F.sum(F.when(free, F.col("n") * F.col("n_tokens") * x * rate).otherwise(0.0)).alias("slope")
        )
        for r in sums.collect():  # one row a source
            goal = goals[r.source][0]
            gap = r.reached - goal
            if not math.isfinite(gap):
                raise ArithmeticError(f"the tokens of source {r.source} can't be summed")
            if abs(gap) <= TOLERANCE * goal:
                open_.discard(r.source)
                continue
            (high if gap > 0 else low)[r.source] = at[r.source]
            at[r.source] = _next_step(at[r.source], gap, r.slope, low[r.source], high[r.source], steps < NEWTON_STEPS)
            if at[r.source] in (low[r.source], high[r.source]):
                open_.discard(r.source)
        steps += 1
    return at


def _next_step(at: float, gap: float, slope: float, low: float, high: float, newton: bool) -> float:
    """Where to look next for a multiplier that lies between ``low`` and ``high``."""
    step = at - gap / slope if newton and slope > 0 else math.nan
    if low < step < high and abs(step) <= 4 * (abs(at) + 1):
        return step
    if math.isfinite(low) and math.isfinite(high):
        return low + (high - low) / 2
    return at + (2.0 if gap < 0 else -2.0) * (abs(at) + 0.5)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: float | None = None) -> DataFrame:
    """The mixed collection: doc_id, source, n_tokens, rate (rounded to 6), copies (at least 1, at most the source's cap).

    ``documents`` needs doc_id, text, source; ``targets`` needs source, target_share, max_repeats; other columns are ignored.
    Sources are compared in one spelling. Sources without documents can't be filled: the others share their part in proportion.
    ``total`` tokens are mixed; the default is the most that lets every source reach its share under its cap. With a larger
    ``total``, sources that fall short stay at their cap. Documents of unlisted, null or zero-share sources, and documents
    without tokens, are in no mix; a null cap is 1. Empty tables give an empty mix. The same input gives the same mix.
    """
    spark = documents.sparkSession
    counted = materialize(token_counts(documents, tokenizer), "token-counts")
    wanted = _targets(targets)
    sizes = counted.where(F.col("n_tokens") > 0).groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    listed = F.broadcast(spark.createDataFrame([(s,) for s in sorted(wanted)], "source string"))
    sizes = materialize(sizes.join(listed, "source"), "token-sizes")
    have = {r.source: (r.t, r.n) for r in sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    whole = sum(wanted[s][0] for s in have)
    goals: dict[str, tuple[float, float, int]] = {}
    rates: list[tuple[str, float, float, float, float]] = []
    if have:
        most = min(wanted[s][1] * t / (wanted[s][0] / whole) for s, (t, _) in have.items())
        total = most if total is None else total
        for s, (t, n) in have.items():
            goal = total * wanted[s][0] / whole
            if goal < wanted[s][1] * t * (1 - 1e-9):
                goals[s] = (goal, t / n, wanted[s][1])
            else:
                rates.append((s, 0.0, t / n, float(wanted[s][1]), 1.0))  # all at the cap
    multipliers = solve_multipliers(sizes, goals)
    rates += [(s, m, goals[s][1], float(goals[s][2]), 0.0) for s, m in multipliers.items()]
    table = F.broadcast(spark.createDataFrame(rates, "source string, m double, mean double, cap double, full double"))
    rate = F.when(F.col("full") > 0, F.col("cap")).otherwise(F.least(F.col("cap"), F.exp(F.least(F.col("m") * F.col("n_tokens") / F.col("mean"), F.lit(50.0)))))
    rated = counted.where(F.col("n_tokens") > 0).join(table, "source").withColumn("rate", rate)
    rated = rated.withColumn("base", F.floor("rate")).withColumn(
        "v",  # in (-1, 1): a document goes up if its v is below the source's threshold
        (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)) - (F.col("rate") - F.col("base")),
    )
    thresholds = _thresholds(rated, {s: g[0] for s, g in goals.items()})
    cut = F.broadcast(spark.createDataFrame([(s, v) for s, v in thresholds.items()], "source string, threshold double"))
    up = (F.col("v") < F.coalesce("threshold", F.lit(-2.0))) & (F.col("base") < F.col("cap"))
    return (
        rated.join(cut, "source", "left")
        .select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), (F.col("base") + up.cast("int")).cast("int").alias("copies"))
        .where("copies > 0")
    )


def _thresholds(rated: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """Threshold of each source, below which documents are rounded up: two passes of BINS sums a source, the second in the bin
    that the first found."""
    spark = rated.sparkSession
    if not goals:
        return {}
    spans = {s: (-1.0, 1.0, 0.0) for s in goals}  # from, to, tokens below from
    of_source = Window.partitionBy("source")
    for _ in range(2):
        table = F.broadcast(spark.createDataFrame([(s, goals[s], *span) for s, span in spans.items()], "source string, goal double, a double, b double, below double"))
        place = F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * BINS).cast("int")
        rows = rated.join(table, "source").withColumn("bin", F.when(F.col("base") >= F.col("cap"), -1).when((F.col("v") >= F.col("a")) & (F.col("v") < F.col("b")), place).otherwise(-1))
        sums = rows.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin") >= 0, F.col("n_tokens")).otherwise(0)).alias("t"), F.sum(F.col("n_tokens") * F.col("base")).alias("floor"), F.first("goal").alias("goal"), F.first("below").alias("below"))
        # the first bin that would go beyond the goal, and the tokens before it
        run = sums.withColumns({"upto": F.sum("t").over(of_source.orderBy("bin")), "room": F.col("goal") - F.col("below") - F.sum("floor").over(of_source)})
        hit = F.when((F.col("bin") >= 0) & (F.col("upto") > F.col("room")), F.struct("bin", (F.col("upto") - F.col("t")).alias("before")))
        for r in run.groupBy("source").agg(F.min(hit).alias("hit"), F.max("upto").alias("all")).collect():  # one row a source
            a, b, below = spans[r.source]
            k, before = (r.hit.bin, r.hit.before) if r.hit else (BINS, r["all"])
            width = (b - a) / BINS
            spans[r.source] = (a + k * width, a + (k + 1) * width, below + before)
    return {s: a for s, (a, _, _) in spans.items()}


def mix_shares(targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """What was reached, one row for each source of ``targets``: source, target_share, max_repeats, n_documents (in the mix),
    most_copies, n_tokens (mixed), reached_share (of all tokens mixed, rounded to 6); zeros where a source lacks documents."""
    reached = mixed.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    whole = F.broadcast(reached.agg(F.sum("n_tokens").alias("whole")))
    wanted = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    return wanted.join(reached, "source", "left").crossJoin(whole).select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.round(F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"),
    )
