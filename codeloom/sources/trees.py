"""Source trees and archives as rows (path, content)."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES, MOST_FILE_BYTES, MOST_BYTES, MOST_ARCHIVE_BYTES, MOST_LINE = 10_000, 1_000_000, 250 * 1024**2, 50 * 1024**2, 2000
# fixed values: folders that are not source, extensions of source files with their language, endings and marks of generated files
IGNORED = (".git", "node_modules", "venv", ".venv", "dist", "build", "coverage", "__pycache__", "vendor", ".idea", ".vscode", ".next", ".cache", ".mypy_cache", ".pytest_cache", "site-packages", "bower_components")
LANGUAGES = {"py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript"}
GENERATED_ENDINGS = (".min.js", ".d.ts", ".generated.ts", ".gen.ts")
GENERATED_MARKS = ("@generated", "auto-generated", "do not edit")

FILES = "path string, size long, content binary"


def language_of(path: Column) -> Column:
    """Language of a path by its extension (case counts); null for others."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.coalesce(*[F.when(ext == e, F.lit(v)) for e, v in LANGUAGES.items()], F.lit(None).cast("string"))


def skip_reason(path: Column, text: Column, size: Column | None = None) -> Column:
    """Why a file is no source to analyse, else null: folder, extension, size, ending, binary, long line, generated."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    size = F.octet_length(text) if size is None else size
    long_line = F.exists(F.split(text, r"\r\n|\n|\r"), lambda x: F.octet_length(x) > MOST_LINE)
    head = F.lower(F.substring(text, 1, 500))
    ending = F.lit(False)
    for end in GENERATED_ENDINGS:
        ending = ending | path.endswith(end)
    mark = F.lit(False)
    for m in GENERATED_MARKS:
        mark = mark | head.contains(m)
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))), "folder")
        .when(language_of(path).isNull(), "extension")
        .when(size > MOST_FILE_BYTES, "size")
        .when(ending, "ending")
        .when(text.contains("\0"), "binary")
        .when(long_line, "long line")
        .when(mark, "generated")
    )


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files below ``root``: path (relative), language, size, text, in no order. Ignored folders, other extensions, large,
    binary, generated and minified files are left out. Raises if there are too many files or bytes, or no source file.

    The folder may lie on any file system Spark reads; symbolic links are as that file system treats them.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), {len('/' + base.split('://')[-1].lstrip('/')) + 2})")
    seen = raw.select(path.alias("path"), F.col("length").alias("size"), "content")
    checked_limits(seen)
    rows = seen.where(F.col("size") <= MOST_FILE_BYTES).withColumn("text", F.col("content").cast("string"))
    kept = rows.where(skip_reason(F.col("path"), F.col("text"), F.col("size")).isNull()).select("path", language_of(F.col("path")).alias("language"), "size", "text")
    if kept.select("path").isEmpty():
        raise ValueError("no Python, JavaScript or TypeScript source files were found")
    return kept


def checked_limits(files: DataFrame) -> None:
    """Raise if ``files`` (path, size) are too many or too large; files of ignored folders don't count."""
    folders = F.split("path", "/")
    live = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))))
    row = live.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if row.n > MOST_FILES:
        raise ValueError("too many files")
    if row.bytes > MOST_BYTES:
        raise ValueError("too many bytes")


def zip_members(data: bytes) -> list[tuple[str, int, bytes]]:
    """Members (path, size, content) of a ZIP archive without ignored folders, a single top folder taken off. Raises ValueError for
    archives that are damaged, too large, or hold unsafe paths or links."""
    if len(data) > MOST_ARCHIVE_BYTES:
        raise ValueError("the archive is too large")
    out, total = [], 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            members = archive.infolist()
            if len(members) > MOST_FILES:
                raise ValueError("too many files")
            for member in members:
                name = member.filename
                parts = [p for p in name.split("/") if p]
                if name.startswith("/") or ".." in parts or "\\" in name or ":" in name or stat.S_ISLNK(member.external_attr >> 16):
                    raise ValueError("unsafe path or link in the archive")
                total += member.file_size
                if member.file_size > MOST_FILE_BYTES or total > MOST_BYTES:
                    raise ValueError("too many bytes")
                if member.is_dir() or any(p in IGNORED for p in parts):
                    continue
                out.append(("/".join(parts), member.file_size, archive.read(member)))
    except zipfile.BadZipFile as e:
        raise ValueError("not a ZIP archive") from e
    tops = {p.split("/", 1)[0] for p, _, _ in out}
    if len(tops) == 1 and all("/" in p for p, _, _ in out):
        out = [(p.split("/", 1)[1], n, c) for p, n, c in out]
    return out


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            yield pd.DataFrame([(path, *m) for m in zip_members(bytes(content))], columns=["archive", "path", "size", "content"])


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, path, size, content) of the members of all ZIP archives that match a path pattern; one archive is read by one task."""
    raw = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return raw.mapInPandas(_unpack, f"archive string, {FILES}")
