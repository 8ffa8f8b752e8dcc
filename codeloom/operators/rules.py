"""Architecture rules: forbidden dependencies by globs, and no cycles."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import DEPENDENCIES, dependency
from .structure import cycles

MOST_RULES, MOST_OF_RULE, MOST_SHOWN = 50, 50, 100
KINDS = ("forbid_dependency", "no_cycles")
SEVERITIES = ("error", "warning")
RULES = "id string, name string, type string, severity string, from string, to string, relationships array<string>"


def glob_pattern(glob: str) -> str:
    """A glob (* and ? cross slashes, [seq], [!seq], case counts) as an anchored regular expression of the JVM's dialect."""
    body = fnmatch.translate(glob)
    m = re.fullmatch(r"\(\?s:(.*)\)(?:\\Z|\\z)", body, re.DOTALL)
    return f"^(?s:{m[1]})\\z"


def glob_match(column: Column | str, glob: str) -> Column:
    """True where ``column`` matches the glob as a whole."""
    return (F.col(column) if isinstance(column, str) else column).rlike(glob_pattern(glob))


def validated(document: dict) -> list[dict]:
    """Rules of a policy document, checked; raises ValueError with the reason."""
    if not isinstance(document, dict) or document.get("version") != 1:
        raise ValueError("version must be 1")
    rules = document.get("rules")
    if not isinstance(rules, list) or not 1 <= len(rules) <= MOST_RULES:
        raise ValueError(f"between 1 and {MOST_RULES} rules are needed")
    out, seen = [], set()
    for rule in rules:
        if not isinstance(rule, dict):
            raise ValueError("a rule must be a mapping")
        key = rule.get("id")
        if not isinstance(key, str) or not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", key) or key in seen:
            raise ValueError(f"rule id {key!r} is malformed or repeated")
        seen.add(key)
        kind, severity, name = rule.get("type"), rule.get("severity", "error"), rule.get("name", key)
        if kind not in KINDS or severity not in SEVERITIES:
            raise ValueError(f"rule {key}: unknown type or severity")
        if not isinstance(name, str) or not 1 <= len(name) <= 120:
            raise ValueError(f"rule {key}: the name must have 1 to 120 characters")
        clean = {"id": key, "name": name, "type": kind, "severity": severity, "from": None, "to": None, "relationships": None}
        if kind == "forbid_dependency":
            for side in ("from", "to"):
                if not isinstance(rule.get(side), str) or not 1 <= len(rule[side]) <= 200:
                    raise ValueError(f"rule {key}: {side} must be a glob of 1 to 200 characters")
                clean[side] = rule[side]
            kinds = rule.get("relationships", list(DEPENDENCIES))
            if not isinstance(kinds, list) or not 1 <= len(kinds) <= 20 or not set(kinds) <= set(DEPENDENCIES):
                raise ValueError(f"rule {key}: unknown relationships")
            clean["relationships"] = list(kinds)
        out.append(clean)
    return out


def location() -> Column:
    """Where a node is: its path, else its module, qualified name or name."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("file_path", "module", "qualified_name", "name")], F.lit(""))


def forbidden(graph: PropertyGraph, rules: list[dict], limit: int | None = MOST_OF_RULE) -> DataFrame:
    """(repository_id, rule_id, severity, edge_id, source, target, message): dependencies the rules forbid; the first ``limit`` of a
    rule and repository, by seq then id.

    There are at most MOST_RULES rules, so each becomes one condition on the edges with the locations of their ends; matching
    rules are exploded from an array, and no edge is paired with a rule it doesn't break.
    """
    rules = [r for r in rules if r["type"] == "forbid_dependency"]
    where = graph.node_view("id", "repository_id", "file_path", "module", "qualified_name", "name").select("id", "repository_id", location().alias("location"))
    edges = graph.edge_view("seq", "id", "source", "target", "type", "resolution").where(dependency())
    placed = edges.join(where.select(F.col("id").alias("source"), "repository_id", F.col("location").alias("a")), "source").join(where.select(F.col("id").alias("target"), F.col("location").alias("b")), "target")
    broken = [
        F.when(F.col("type").isin(*r["relationships"]) & glob_match("a", r["from"]) & glob_match("b", r["to"]), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"))) for r in rules
    ]
    none = F.array().cast("array<struct<rule_id:string,severity:string>>")
    hits = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else none
    rows = placed.select("repository_id", F.explode(hits).alias("rule"), "seq", F.col("id").alias("edge_id"), "source", "target", F.concat_ws(" ", "a", F.replace(F.lower("type"), F.lit("_"), F.lit(" ")), "b").alias("message"))
    rows = rows.select("repository_id", "rule.rule_id", "rule.severity", "seq", "edge_id", "source", "target", "message")
    if limit is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("repository_id", "rule_id").orderBy("seq", "edge_id"))).where(F.col("place") <= limit)
    return rows.select("repository_id", "rule_id", "severity", "edge_id", "source", "target", "message")


def cycle_violations(graph: PropertyGraph, rules: list[dict]) -> DataFrame:
    """(repository_id, rule_id, severity, path, evidence): each cycle, for each rule against them; evidence is the first edge of each step."""
    rules = [r for r in rules if r["type"] == "no_cycles"]
    found = cycles(graph)
    steps = found.select("repository_id", "component", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("source"), F.slice("path", F.lit(2), F.size("path") - 1).alias("target"))).alias("at", "s"))
    edges = graph.edge_view("seq", "id", "source", "target", "type", "resolution").where(dependency())
    first = steps.select("component", "at", "s.source", "s.target").join(edges, ["source", "target"]).groupBy("component", "at").agg(F.min(F.struct("seq", "id"))["id"].alias("edge"))
    shown = first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edge"))), lambda x: x["edge"]).alias("evidence"))
    which = F.array(*[F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity")) for r in rules]) if rules else F.array().cast("array<struct<rule_id:string,severity:string>>")
    return found.join(shown, "component").select("repository_id", F.explode(which).alias("rule"), "path", "evidence").select("repository_id", "rule.rule_id", "rule.severity", "path", "evidence")


def summary(violations: DataFrame, rules: list[dict], repositories: DataFrame) -> DataFrame:
    """One row for each repository (repository_id) of ``repositories``: rules, passed, warnings, errors, violations, status.

    ``violations`` needs repository_id, rule_id, severity. Status is FAIL with an error, else WARN with a warning, else PASS.
    """
    per_rule = violations.groupBy("repository_id", "rule_id", "severity").agg(F.count("*").alias("n"))
    rolled = per_rule.groupBy("repository_id").agg(F.count("*").alias("broken"), F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"), F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"))
    rows = repositories.select("repository_id").distinct().join(rolled, "repository_id", "left").fillna(0, ["broken", "errors", "warnings"])
    status = F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS")
    return rows.select("repository_id", F.lit(len(rules)).cast("long").alias("rules"), (F.lit(len(rules)) - F.col("broken")).cast("long").alias("passed"), "warnings", "errors", (F.col("errors") + F.col("warnings")).alias("violations"), status.alias("status"))


def read_policy(paths: list[str]) -> list[dict] | None:
    """Rules of the first policy file that exists (YAML, at most 64 KB), None if there is none; ValueError if it is no valid policy."""
    import os

    for path in paths:
        if os.path.isfile(path):
            if os.path.getsize(path) > 64 * 1024:
                raise ValueError("the policy file is too large")
            try:
                import yaml
            except ImportError as e:
                raise ValueError("reading a policy file needs a YAML library") from e
            with open(path, encoding="utf-8") as file:
                try:
                    return validated(yaml.safe_load(file))
                except yaml.YAMLError as e:
                    raise ValueError("the policy file is no YAML") from e
    return None
