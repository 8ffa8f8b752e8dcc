"""Extraction as a DataFrame operator: one row a file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ..sources.trees import LANGUAGES
from . import python_source, script_source
from .records import SCHEMA, FileRecord


def extract(repository_id: str, path: str, text: str) -> FileRecord | None:
    """What one file tells; None for files of other languages."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1] if "." in path else "")
    if language is None:
        return None
    return (python_source if language == "Python" else script_source).extract(repository_id, path, text)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["repository_id", "file_path", "id", "module", "language", "end_line", "hash", "source", "warnings", "symbols", "imports", "refs", "bindings", "shadowed", "endpoints"]
    for batch in batches:
        rows = [r.row() for repo, path, text in zip(batch["repository_id"], batch["file_path"], batch["text"]) if (r := extract(repo, path, text)) is not None]
        yield pd.DataFrame(rows, columns=columns)


def extracted(files: DataFrame) -> DataFrame:
    """One row for each source file of ``files`` (repository_id, file_path, text), with its symbols, imports, references, bindings,
    shadowed names, endpoints and warnings as arrays. Rows with a null column and files of other languages are left out."""
    return spread(files.select("repository_id", "file_path", F.col("text")).dropna()).mapInPandas(_extract, SCHEMA)
