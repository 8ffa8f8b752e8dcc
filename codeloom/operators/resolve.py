"""Resolution of directories, modules and references by joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import stable_id

_FINGERPRINT = pa.schema([("repository_id", pa.string()), ("fingerprint", pa.string())])
# fixed values: suffixes a module may have, the first that exists wins
PYTHON_SUFFIXES = (".py", "/__init__.py")
SCRIPT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def directories(files: DataFrame) -> DataFrame:
    """(repository_id, path, parent, id, parent_id) of every folder above the files (repository_id, file_path), once each; the parent
    of a top folder is "" and its id the repository's."""
    parts = F.split("file_path", "/")
    depth = F.size(parts) - 1
    up = files.where("file_path is not null").select("repository_id", parts.alias("p"), depth.alias("n")).where("n > 0")
    rows = up.select("repository_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.array_join(F.slice("p", F.lit(1), i), "/").alias("path"), F.array_join(F.slice("p", F.lit(1), i - 1), "/").alias("parent")))).alias("d"))
    one = rows.select("repository_id", "d.path", "d.parent").distinct()
    key = lambda c: F.when(F.col(c) == "", F.col("repository_id")).otherwise(stable_id("repository_id", F.lit("dir"), c))
    return one.select("repository_id", "path", "parent", key("path").alias("id"), key("parent").alias("parent_id"))


def normal_path(path: Column) -> Column:
    """A relative path without ``.``, ``..`` and empty parts; parts that climb above the top stay."""
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x)))
    )
    safe = lambda acc, x: F.when(F.size(acc) == 0, F.when((x == "") | (x == "."), acc).otherwise(F.concat(acc, F.array(x)))).otherwise(step(acc, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), safe), "/")


def folder_of(path: Column) -> Column:
    """Folder of a path; "" at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module_candidates(path: Column, module: Column) -> Column:
    """Paths, in order, at which the module named in a file may be found; empty for script modules that aren't relative."""
    python = path.endswith(".py")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.split(folder_of(path), "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (dots - 1), F.lit(0))), "/")
    joined = F.when(base == "", tail).when(tail == "", base).otherwise(F.concat_ws("/", base, tail))
    value = F.when(dots > 0, joined).otherwise(tail)
    plain = F.array(*[F.concat(value, F.lit(s)) for s in PYTHON_SUFFIXES])
    py = F.concat(plain, F.transform(plain, lambda x: F.concat(F.lit("src/"), x)))
    there = normal_path(F.concat_ws("/", folder_of(path), module))
    stem = F.regexp_replace(there, r"\.(js|jsx|mjs)$", "")
    script = F.array(there, *[F.concat(stem, F.lit(s)) for s in SCRIPT_SUFFIXES if s])
    return F.when(python, py).when(module.startswith("."), script).otherwise(F.array().cast("array<string>"))


def package_name(path: Column, module: Column) -> Column:
    """Package of a module that is no file: the first dotted part in Python, else the first path part, with the scope where there is one."""
    parts = F.split(module, "/")
    script = F.when(module.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))
    name = F.when(path.endswith(".py"), F.element_at(F.split(module, r"\."), 1)).otherwise(script)
    return F.when(name == "", module).otherwise(name)


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, file_path, module, target_path, kind, package) of imports (repository_id, file_path, module), once each.

    kind is "file" where a candidate path exists among ``files`` (repository_id, file_path), the first one wins; else
    "unresolved" for relative modules and "package" for others, with the package's name. Candidates meet files in one equi-join.
    """
    asked = imports.select("repository_id", "file_path", "module").dropna().distinct()
    tried = asked.select("*", F.posexplode(module_candidates(F.col("file_path"), F.col("module"))).alias("rank", "target_path"))
    known = files.select("repository_id", F.col("file_path").alias("target_path")).dropna().distinct()
    hits = tried.join(known, ["repository_id", "target_path"]).groupBy("repository_id", "file_path", "module").agg(F.min_by("target_path", "rank").alias("target_path"))
    rows = asked.join(hits, ["repository_id", "file_path", "module"], "left")
    kind = F.when(F.col("target_path").isNotNull(), "file").when(F.col("module").startswith("."), "unresolved").otherwise("package")
    return rows.select("repository_id", "file_path", "module", "target_path", kind.alias("kind"), F.when(kind == "package", package_name(F.col("file_path"), F.col("module"))).alias("package"))


def scope_prefixes(scope: Column) -> Column:
    """A dotted scope and its prefixes, innermost first, down to ""."""
    parts = F.split(scope, r"\.")
    n = F.when(scope == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def lexical_targets(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, id): the symbol each reference (ref_id, repository_id, file_path, scope, target) names in its own file, from the
    innermost scope outwards; ``symbols`` are (repository_id, file_path, dotted, id). A name is never looked up in other files."""
    tried = refs.select("ref_id", "repository_id", "file_path", F.posexplode(scope_prefixes(F.col("scope"))).alias("rank", "prefix"), "target")
    keyed = tried.withColumn("dotted", F.when(F.col("prefix") == "", F.col("target")).otherwise(F.concat_ws(".", "prefix", "target")))
    return keyed.join(symbols, ["repository_id", "file_path", "dotted"]).groupBy("ref_id").agg(F.min_by("id", "rank").alias("id"))


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the parts of each repository, joined by colons; rows come sorted by repository and part."""
    current, digest = None, None
    for batch in batches:
        done: dict[str, list[str]] = {"repository_id": [], "fingerprint": []}
        for repo, part in zip(batch.column("repository_id").to_pylist(), batch.column("part").to_pylist()):
            if repo != current:
                if digest is not None:
                    done["repository_id"].append(current)
                    done["fingerprint"].append(digest.hexdigest()[:24])
                current, digest = repo, hashlib.sha256(part.encode())
            else:
                digest.update(b":" + part.encode())
        yield pa.RecordBatch.from_pydict(done, schema=_FINGERPRINT)
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"repository_id": [current], "fingerprint": [digest.hexdigest()[:24]]}, schema=_FINGERPRINT)


def fingerprint(files: DataFrame) -> DataFrame:
    """(repository_id, fingerprint) over the sorted "path:hash" of a repository's files (repository_id, file_path, hash).

    The key is one hash over the whole sorted list, so a repository's parts are read in order by one task: as a sorted stream in
    constant memory. Repeated parts count once; rows with a null repository or path are left out; a null hash is "".
    """
    rows = files.dropna(subset=["repository_id", "file_path"]).select("repository_id", F.concat_ws(":", "file_path", F.coalesce("hash", F.lit(""))).alias("part")).distinct()
    return rows.repartition("repository_id").sortWithinPartitions("repository_id", "part").mapInArrow(_hash_stream, "repository_id string, fingerprint string")
