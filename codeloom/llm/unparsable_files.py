"""Source files that do not parse, found by memoised parsing with derivatives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import syntax_python, syntax_script
from .languages import EXTENSIONS, extension, is_source

SCHEMA = "id string, repository_id string, file_path string, language string, parses boolean, line int, failure string"


def failure(text: str, ext: str) -> tuple[int, str] | None:
    """None if ``text`` is valid for the extension ``ext``, else (line, kind).

    Kind is "syntax" (the token on that line cannot stand there), "conflict" (it belongs to a merge conflict mark) or
    "truncated" (the text ends too early). Blank texts parse.
    """
    if not text or text.isspace():
        return None
    found = syntax_python.check(text) if EXTENSIONS[ext] == "python" else syntax_script.check(text, ext in ("ts", "tsx"), ext in ("jsx", "tsx"))
    if not found:
        return None
    at, kind = found
    start = text.rfind("\n", 0, at) + 1
    if kind == "syntax" and text.startswith(("<<<<<<<", "=======", ">>>>>>>", "|||||||"), start):
        kind = "conflict"
    return text.count("\n", 0, at) + 1, kind


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [failure(text, ext) for text, ext in zip(batch["source"], batch["ext"])]
        yield pd.DataFrame(
            {
                "id": batch["id"],
                "repository_id": batch["repository_id"],
                "file_path": batch["file_path"],
                "language": [EXTENSIONS[x] for x in batch["ext"]],
                "parses": [x is None for x in found],
                "line": pd.array([x and x[0] for x in found], dtype="Int32"),
                "failure": [x and x[1] for x in found],
            }
        )


def check_files(files: DataFrame) -> DataFrame:
    """Whether each source file parses: id, repository_id, file_path, language (by extension: python, js, jsx, ts, tsx),
    parses, and for those that don't, line (from 1) and failure ("syntax", "conflict" or "truncated").

    ``files`` needs id, repository_id, file_path, source; other columns are ignored. One row per delivered row. Files of other
    extensions, and rows with a null path, are left out. Null, empty and blank sources parse.
    """
    scan = files.where(is_source(F.col("file_path"))).select("id", "repository_id", "file_path", "source", extension(F.col("file_path")).alias("ext"))
    return spread(scan).mapInPandas(_check, SCHEMA)


def unparsable(files: DataFrame) -> DataFrame:
    """Ids of the source files that do not parse, once each; rows without id are left out."""
    return check_files(files).where(~F.col("parses") & F.col("id").isNotNull()).select("id").distinct()


def failure_rates(files: DataFrame) -> DataFrame:
    """Per repository_id (null is a group of its own) and language: n_files, n_unparsable, n_truncated, n_conflicts, rate
    (rounded to 6). A file delivered several times (equal id) counts once; it counts as unparsable if one delivery is."""
    once = check_files(files).groupBy("id", "repository_id", "language").agg(F.max(~F.col("parses")).alias("bad"), F.max("failure").alias("failure"))
    n = F.count("*")
    bad = F.count_if("bad")
    return once.groupBy("repository_id", "language").agg(
        n.alias("n_files"),
        bad.alias("n_unparsable"),
        F.count_if(F.col("failure") == "truncated").alias("n_truncated"),
        F.count_if(F.col("failure") == "conflict").alias("n_conflicts"),
        F.round(bad / n, 6).alias("rate"),
    )
