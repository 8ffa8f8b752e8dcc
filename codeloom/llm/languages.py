"""Which language a file is in, by the extension of its path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extension of a source file -> language
EXTENSIONS = {"py": "python", "js": "js", "mjs": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx"}


def extension(path: Column) -> Column:
    """Extension in lower case, without the dot; "" where there is none or the path is null."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def is_source(path: Column) -> Column:
    """True for paths of Python, JavaScript and TypeScript files; never null."""
    return extension(path).isin(*EXTENSIONS)
