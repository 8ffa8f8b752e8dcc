"""Text functions: labels by keywords, mentions, report tables, answer streams, evidence that fits a budget."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: what a question is about, by the first list that has a part of it
INTENTS = (
    ("impact", ("break", "impact", "change", "modify", "blast")),
    ("path", ("trace", "path", "reach", "connection")),
    ("architecture", ("architecture", "structured", "overview", "central", "major modules")),
    ("dependency", ("calls", "uses", "depends", "depend on", "dependents", "dependencies")),
    ("discovery", ("where", "find", "search")),
)
# fixed values: fields of a node that an answer may rest on
EVIDENCE_FIELDS = ("id", "name", "type", "file_path", "start_line", "end_line", "signature", "source", "docstring")
#: One piece of evidence takes at most so many characters of JSON, and keeps so many items of a list and characters of a string.
MOST_EVIDENCE, MOST_ITEMS, MOST_CHARACTERS, LEAST_CHARACTERS = 7000, 20, 1200, 100


def first_label(text: Column, labels: tuple[tuple[str, tuple[str, ...]], ...], otherwise: str) -> Column:
    """Label of the first list of which the text (case-folded) holds a part; null text has no label."""
    folded = F.lower(text)
    out = None
    for label, parts in labels:
        hit = F.lit(False)
        for part in parts:
            hit = hit | folded.contains(part)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(text.isNotNull(), otherwise if out is None else out.otherwise(otherwise))


def intent(question: Column) -> Column:
    """What a question is about."""
    return first_label(question, INTENTS, "explanation")


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, id, name) of names (id, name) of more than two characters that stand in texts (text_id, text) as whole words, without
    regard to case. Names of one word meet the words of the texts in an equi-join; names with other characters are cut into words, and
    the texts that hold their first word are looked through."""
    word = r"([\p{L}\p{N}_]+)"
    words = texts.where("text is not null").select("text_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), 1))).alias("word"))
    wanted = names.where(F.length("name") > 2).select("id", "name", F.lower("name").alias("folded"), F.regexp_extract(F.lower("name"), word, 1).alias("word")).where("word <> ''")
    near = words.join(wanted, "word")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace("folded", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return near.where((F.col("folded") == F.col("word")) | F.rlike(F.lower("text"), whole)).select("text_id", "id", "name").distinct()


def repository_parts(url: Column) -> Column:
    """Struct (owner, name) of an address of a code host's repository, in lower case; null where it is none or has dot parts."""
    pattern = r"^https://[a-z0-9.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    owner, name = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    good = (owner != "") & ~owner.isin(".", "..") & ~name.isin(".", "..")
    return F.when(good, F.struct(F.lower(owner).alias("owner"), F.lower(name).alias("name")))


def markdown_cell(value: Column) -> Column:
    """A value as one cell of a Markdown table: marks escaped, line breaks as blanks, null as a dash."""
    text = value.cast("string")
    for mark in ("\\", "|", "`", "*", "_", "<", ">"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return F.coalesce(F.regexp_replace(text, r"\s*[\r\n]+\s*", " "), F.lit("-"))


def markdown_tables(rows: DataFrame, by: str, columns: list[str], order: str, limit: int = 100, most: int = 59_000) -> DataFrame:
    """(by, report): a Markdown table of the first ``limit`` rows of each ``by``, cut at whole lines to ``most`` characters."""
    from pyspark.sql import Window

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n" + "|" + "---|" * len(columns)
    placed = rows.select(by, order, line.alias("line")).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, "line"))).where(F.col("place") <= limit)
    sized = placed.withColumn("so_far", F.sum(F.length("line") + 1).over(Window.partitionBy(by).orderBy("place"))).where(F.col("so_far") <= most - len(head))
    listed = sized.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return listed.select(by, F.concat(F.lit(head + "\n"), "body").alias("report"))


def answer_events(answers: DataFrame) -> DataFrame:
    """(answer_id, place, event): an answer (answer_id, text, and if there are such columns, steps: array of texts, error) as JSON lines.

    First a status for each step, then a delta for each word with the blanks behind it and the result, or the error in their place.
    An answer with neither text nor error has its steps only.
    """
    line = lambda kind, name, value: F.to_json(F.struct(F.lit(kind).alias("type"), value.alias(name)))
    none = F.array().cast("array<string>")
    steps = F.coalesce(F.transform("steps", lambda s: line("status", "message", s)), none) if "steps" in answers.columns else none
    error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    words = F.transform(F.regexp_extract_all("text", F.lit(r"(\S+(?:\s+|$))"), 1), lambda w: line("delta", "text", w))
    rest = F.when(error.isNotNull(), F.array(line("error", "message", error))).when(F.col("text").isNotNull(), F.concat(words, F.array(line("result", "text", F.col("text"))))).otherwise(none)
    return answers.select("answer_id", F.posexplode(F.concat(steps, rest)).alias("place", "event"))


class EvidenceBudget:
    """Characters of JSON left for evidence; each piece is cut so that it fits, and what it takes is gone for the next ones.

    Of a piece, the longest lists that fit are kept (MOST_ITEMS at most); if even single items are too long, the longest strings.
    Structures are never broken, vectors, empty fields and fields of nodes beyond EVIDENCE_FIELDS are left out. What can't be
    made to fit becomes a notice and takes nothing.
    """

    NOTICE = {"notice": "too large"}

    def __init__(self, characters: int):
        self.left = characters

    def take(self, value: Any) -> Any:
        """``value`` as it fits, paid from the budget."""
        room = max(0, min(MOST_EVIDENCE, self.left))
        kept = _widest(1, MOST_ITEMS, lambda n: _pruned(value, n, MOST_CHARACTERS), room) or _widest(LEAST_CHARACTERS, MOST_CHARACTERS, lambda n: _pruned(value, 1, n), room)
        if kept is None:
            return dict(self.NOTICE)
        self.left -= len(kept)
        return json.loads(kept)


def _widest(low: int, high: int, cut: Callable[[int], Any], room: int) -> str | None:
    """JSON of the largest cut from ``low`` to ``high`` of at most ``room`` characters, by bisection; None if there is none."""
    best = None
    while low <= high:
        middle = (low + high) // 2
        text = json.dumps(cut(middle))
        if len(text) <= room:
            best, low = text, middle + 1
        else:
            high = middle - 1
    return best


def _pruned(value: Any, items: int, characters: int) -> Any:
    """A JSON value with long lists and strings cut."""
    if isinstance(value, str):
        return value[:characters]
    if isinstance(value, list):
        return [_pruned(x, items, characters) for x in value[:items]]
    if not isinstance(value, dict):
        return value
    fields = value.keys() & set(EVIDENCE_FIELDS) if {"id", "file_path", "type"} <= value.keys() else value.keys() - {"embedding"}
    return {k: _pruned(x, items, characters) for k, x in value.items() if k in fields and not (x is None or x == "")}


def fit_evidence(value: Any, budget: int) -> Any:
    """One JSON value cut to at most ``budget`` characters of JSON, as :class:`EvidenceBudget` does."""
    return EvidenceBudget(budget).take(value)


def fitted(budget: int):
    """A column function that fits JSON texts to a budget; texts that are no JSON become null."""

    @F.pandas_udf(StringType())
    def fit(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(fit_evidence(json.loads(t), budget))
            except ValueError:
                return None

        return texts.map(one)

    return fit
