"""From source files to a property graph: extraction, then resolution of references by joins, for all repositories at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract.records import WRITES
from ..extract.runner import extracted
from ..graph import PropertyGraph
from ..schema import CONFIDENCE, NODES, latest, stable_id
from ..session import counted, materialize
from .resolve import directories, folder_of, lexical_targets, resolve_modules, scope_prefixes

#: Rounds of resolution through bindings and imports at most, as many as the reference's; they end when no query is open.
ROUNDS = 20
# fixed value: bases that make a class a model
_MODEL_BASE = r"(^|\.)(Model|Base|Document)$"
_AT = ["repository_id", "file_path"]


class Resolver:
    """Tables that references are resolved against; queries are (qid, repository_id, file_path, target, scope)."""

    def __init__(self, parsed: DataFrame):
        at = [F.col(c) for c in _AT]
        self.symbols = materialize(parsed.select(*at, F.explode("symbols").alias("s")).where("s.is_last").select(*_AT, "s.dotted", "s.id", "s.type"), "symbols")
        self.bindings = materialize(parsed.select(*at, F.explode("bindings").alias("b")).select(*_AT, "b.key", F.col("b.target").alias("bound")), "bindings")
        self.shadowed = materialize(parsed.select(*at, F.explode("shadowed").alias("key")), "shadowed")
        imports = parsed.select(*at, F.explode("imports").alias("i")).select(*_AT, "i.local", "i.module", "i.imported", "i.line")
        self.files = materialize(parsed.select(*at, "id"), "files")
        asked = imports.select(*_AT, "module").unionByName(imports.select(*_AT, F.concat_ws(".", "module", "imported").alias("module")))
        modules = resolve_modules(asked, self.files)
        first = modules.select(*_AT, "module", F.col("target_path").alias("path_1"), "package", F.col("kind").alias("kind_1"))
        second = modules.select(*_AT, F.col("module").alias("full"), F.col("target_path").alias("path_2"))
        both = imports.withColumn("full", F.concat_ws(".", "module", "imported")).join(first, [*_AT, "module"], "left").join(second, [*_AT, "full"], "left")
        defaults = parsed.select("repository_id", F.col("file_path").alias("to"), F.explode("symbols").alias("s")).where("s.is_default")
        named = defaults.groupBy("repository_id", "to").agg(F.count("*").alias("n"), F.min("s.name").alias("default_name")).where("n = 1").drop("n")
        whole = F.col("path_1").isNull() & (F.col("imported") != "*") & F.col("path_2").isNotNull()
        self.imports = materialize(
            both.select(*_AT, "local", "module", "line", "package", "kind_1", F.when(whole, F.lit("*")).otherwise(F.col("imported")).alias("imported"), F.coalesce("path_1", F.when(whole | (F.col("path_1").isNull()), F.col("path_2"))).alias("to")).join(named, ["repository_id", "to"], "left"), "imports"
        )

    def _shadow_hits(self, queries: DataFrame) -> DataFrame:
        """(qid, bound): queries whose first name is shadowed in a scope around them, and whether each such scope also binds it."""
        keys = queries.select("qid", *_AT, F.split("target", r"\.")[0].alias("root"), F.explode(scope_prefixes(F.col("scope"))).alias("prefix")).withColumn("key", F.concat_ws(":", "prefix", "root"))
        bound = self.bindings.select(*_AT, "key", F.lit(True).alias("bound"))
        return keys.join(self.shadowed, [*_AT, "key"]).join(bound, [*_AT, "key"], "left").groupBy("qid").agg(F.bool_and(F.coalesce("bound", F.lit(False))).alias("bound"))

    def resolve(self, queries: DataFrame, rounds: int = ROUNDS) -> DataFrame:
        """(qid, id) of the queries that name a known symbol or file; at most one id each.

        One round looks up scopes and own members, and turns what is left into queries about bindings and imports, which the next
        round answers all at once. A query that leads back to one it came from (``seen``) ends there.
        """
        key = F.xxhash64(*_AT, "target", "scope")
        seen = F.col("seen") if "seen" in queries.columns else F.array().cast("array<bigint>")
        fresh = queries.withColumn("seen", seen).where(~F.array_contains("seen", key))
        asked, n = counted(fresh.select("qid", *_AT, F.regexp_replace("target", r"\(\)$", "").alias("target"), "scope", F.concat("seen", F.array(key)).alias("seen")), "queries")
        if not n:
            return asked.select("qid", F.lit("").alias("id")).limit(0)
        shadow = materialize(self._shadow_hits(asked), "shadow-hits")
        blocked = asked.where(~F.col("target").contains(".")).join(shadow.where(~F.col("bound")), "qid", "left_semi").select("qid")
        live = asked.join(blocked, "qid", "left_anti")
        lexical = lexical_targets(live.withColumnRenamed("qid", "ref_id"), self.symbols.select(*_AT, "dotted", "id")).select(F.col("ref_id").alias("qid"), "id", F.lit(0).alias("way"))
        local = lexical.unionByName(self._own_members(live).withColumn("way", F.lit(1))).groupBy("qid").agg(F.min_by("id", "way").alias("id"))
        local = materialize(local, "found")
        if rounds <= 0:
            return local
        rest = live.join(local, "qid", "left_anti")
        bound = materialize(self._bound(rest), "bound")
        onward = materialize(self._imported(rest.join(shadow, "qid", "left_anti")), "imported")
        sub = bound.select(F.col("sub").alias("qid"), *_AT, F.col("bound").alias("target"), F.col("prefix").alias("scope"), "seen").unionByName(
            onward.where("target <> ''").select(F.xxhash64("qid", F.lit("import")).alias("qid"), *_AT, "target", F.lit("").alias("scope"), "seen")
        )
        inner = self.resolve(sub, rounds - 1)
        whole = onward.where("target = ''").select("qid", stable_id(*_AT).alias("id"))
        named = onward.select("qid", F.xxhash64("qid", F.lit("import")).alias("sub")).join(inner.withColumnRenamed("qid", "sub"), "sub").select("qid", "id")
        through = self._members(bound, inner).withColumn("way", F.lit(0)).unionByName(whole.unionByName(named).withColumn("way", F.lit(1)))
        return materialize(local.unionByName(through.groupBy("qid").agg(F.min_by("id", "way").alias("id"))), "found")

    def _own_members(self, queries: DataFrame) -> DataFrame:
        """Members that self, cls or this name, of the innermost class around."""
        mine = queries.where(F.col("target").rlike(r"^(self|cls|this)\."))
        scopes = mine.select("qid", *_AT, F.regexp_extract("target", r"^[^.]*\.(.*)$", 1).alias("member"), F.posexplode(scope_prefixes(F.col("scope"))).alias("rank", "dotted"))
        classes = scopes.join(self.symbols.where("type = 'Class'").select(*_AT, "dotted"), [*_AT, "dotted"]).groupBy("qid", *_AT, "member").agg(F.min_by("dotted", "rank").alias("class"))
        return classes.withColumn("dotted", F.concat_ws(".", "class", "member")).join(self.symbols.select(*_AT, "dotted", "id"), [*_AT, "dotted"]).select("qid", "id")

    def _bound(self, queries: DataFrame) -> DataFrame:
        """What the receivers of dotted names are bound to, in each scope around: (sub, qid, rank, short, way, member, bound, prefix, seen)."""
        parts = F.split("target", r"\.")
        n = F.size(parts)
        dotted = queries.where(F.col("target").contains("."))
        cut = dotted.select("qid", *_AT, "seen", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct((n - k).alias("short"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("receiver"), F.array_join(F.slice(parts, k + 1, n - k), ".").alias("member")))).alias("c"), F.col("scope"))
        placed = cut.select("qid", *_AT, "seen", "c.short", "c.receiver", "c.member", F.posexplode(scope_prefixes(F.col("scope"))).alias("rank", "prefix"))
        is_own = F.col("receiver").rlike(r"^(self|this)\.")
        keys = F.when(is_own, F.array(F.concat_ws(":", "prefix", "receiver"), F.concat(F.col("prefix"), F.lit(".__init__:"), F.col("receiver")), F.concat(F.col("prefix"), F.lit(".constructor:"), F.col("receiver")))).otherwise(F.array(F.concat_ws(":", "prefix", "receiver")))
        tried = placed.select("*", F.posexplode(keys).alias("way", "key")).join(self.bindings, [*_AT, "key"])
        return tried.select(F.xxhash64("qid", "rank", "short", "way").alias("sub"), "qid", *_AT, "rank", "short", "way", "member", "bound", "prefix", "seen")

    def _members(self, bound: DataFrame, classes: DataFrame) -> DataFrame:
        """Members of the classes that receivers are bound to: the innermost scope and the longest receiver that lead somewhere win."""
        owner = self.symbols.select("repository_id", F.col("file_path").alias("in_path"), F.col("dotted").alias("class"), F.col("id").alias("class_id"))
        hits = bound.join(classes.select(F.col("qid").alias("sub"), F.col("id").alias("class_id")), "sub").join(owner, ["repository_id", "class_id"]).withColumn("dotted", F.concat_ws(".", "class", "member"))
        members = self.symbols.select("repository_id", F.col("file_path").alias("in_path"), "dotted", "id")
        return hits.join(members, ["repository_id", "in_path", "dotted"]).groupBy("qid").agg(F.min_by("id", F.struct("rank", "short", "way")).alias("id"))

    def _imported(self, queries: DataFrame) -> DataFrame:
        """What an imported name is called in the file it comes from: (qid, repository_id, file_path, target, seen); "" is the file itself."""
        parts = F.split("target", r"\.")
        linked = queries.select("qid", *_AT, "target", "seen", parts[0].alias("local")).join(self.imports.where("to is not null").select(*_AT, "local", "imported", "to", "default_name"), [*_AT, "local"])
        suffix = F.regexp_extract("target", r"^[^.]*\.?(.*)$", 1)
        head = F.when(F.col("imported") == "default", F.coalesce("default_name", F.lit(""))).when(F.col("imported") == "*", "").otherwise(F.col("imported"))
        name = F.concat_ws(".", F.when(head != "", head), F.when(suffix != "", suffix))
        return linked.select("qid", "repository_id", F.col("to").alias("file_path"), name.alias("target"), "seen")


def _edges(rows: DataFrame, kind: Column | str, resolution: Column | str, method: str = "syntax") -> DataFrame:
    """Edge rows of (source, target, file_path, line), keyed, with the confidence of their resolution."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    resolution = F.lit(resolution) if isinstance(resolution, str) else resolution
    confidence = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        confidence = F.when(resolution == name, value).otherwise(confidence)
    built = rows.select("source", "target", kind.alias("type"), F.col("file_path").alias("source_file"), F.col("line").cast("int").alias("source_line"), confidence.alias("confidence"), resolution.alias("resolution"), F.lit(method).alias("analysis_method"))
    live = built.where((F.col("source") != F.col("target")) | ~F.col("type").isin("CONTAINS", "DEFINES"))
    return live.select(stable_id("source", "target", "type", "source_file", F.col("source_line").cast("string")).alias("id"), *live.columns)


def _nodes(rows: DataFrame, **columns: Column) -> DataFrame:
    """Node rows of these columns, the others at their defaults."""
    out = []
    for f in NODES.fields[1:]:
        kind = f.dataType.simpleString()
        default = {"string": F.lit(""), "int": F.lit(1), "boolean": F.lit(False)}.get(kind, F.array().cast(kind))
        out.append(columns.get(f.name, default).cast(kind).alias(f.name))
    return rows.select(*out)


def index_files(files: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """(graph, warnings) of source files (repository_id, file_path, text), one row a file.

    References are resolved as far as imports, bindings, scopes and members of the own class tell, never by a bare name across
    files; others lead to unresolved symbols. Warnings are (repository_id, file_path, warning). Of nodes and edges with one key
    one is kept: edges the best resolved, nodes the last by line. Nodes that hold text are read from the table of parsed files,
    they aren't written again.
    """
    parsed = materialize(extracted(files), "parsed")
    r = Resolver(parsed)
    at = [F.col(c) for c in _AT]
    c, s, lit = F.col, F.col, F.lit
    repos = parsed.select("repository_id").distinct()
    folders = materialize(directories(parsed.select(*at)), "folders")
    texts = [_nodes(parsed, id=c("id"), name=F.regexp_extract("file_path", r"([^/]*)$", 1), type=lit("File"), repository_id=c("repository_id"), qualified_name=c("file_path"), file_path=c("file_path"), language=c("language"), end_line=c("end_line"), source=c("source"), hash=c("hash"), module=c("module"))]
    nodes = [
        _nodes(repos, id=c("repository_id"), name=lit("Repository"), type=lit("Repository"), repository_id=c("repository_id")),
        _nodes(folders, id=c("id"), name=F.regexp_extract("path", r"([^/]*)$", 1), type=lit("Directory"), repository_id=c("repository_id"), file_path=c("path"), module=c("path")),
    ]
    symbols = parsed.select(*at, "language", "module", F.explode("symbols").alias("s"))
    fields = {n: s(f"s.{n}") for n in ("id", "name", "type", "start_line", "end_line", "signature", "source", "docstring", "parameters", "returns", "exported", "hash")}
    texts.append(_nodes(symbols, **fields, repository_id=c("repository_id"), file_path=c("file_path"), language=c("language"), module=c("module"), qualified_name=F.concat_ws(":", "file_path", "s.dotted")))
    endpoints = parsed.select(*at, "id", "language", "module", F.explode("endpoints").alias("e"))
    texts.append(_nodes(endpoints, id=c("e.id"), name=c("e.name"), qualified_name=c("e.name"), type=lit("Endpoint"), signature=c("e.name"), source=c("e.source"), start_line=c("e.start_line"), end_line=c("e.end_line"), repository_id=c("repository_id"), file_path=c("file_path"), language=c("language"), module=c("module")))
    parent = F.when(folder_of(F.col("file_path")) == "", c("repository_id")).otherwise(stable_id("repository_id", lit("dir"), folder_of(F.col("file_path"))))
    inside = parsed.select("repository_id", "file_path", F.posexplode(F.split("file_path", "/")).alias("i", "_")).where("i > 0")
    up = inside.select("repository_id", "file_path", F.expr("substring_index(file_path, '/', i)").alias("path")).join(folders, ["repository_id", "path"])
    edges = [
        _edges(up.select(c("parent_id").alias("source"), c("id").alias("target"), "file_path", lit(1).alias("line")), "CONTAINS", "resolved"),
        _edges(parsed.select(parent.alias("source"), c("id").alias("target"), "file_path", lit(1).alias("line")), "CONTAINS", "resolved"),
        _edges(endpoints.select(c("id").alias("source"), c("e.id").alias("target"), "file_path", c("e.start_line").alias("line")), "DEFINES", "resolved"),
    ]
    # imports
    own = stable_id(*_AT)  # the key of a file
    to_file = r.imports.where("to is not null").select("file_path", "line", own.alias("source"), stable_id("repository_id", "to").alias("target"))
    edges.append(_edges(to_file.select("source", "target", "file_path", "line"), "IMPORTS", "resolved"))
    outside = r.imports.where("to is null").withColumn("source", own)
    local = c("kind_1") != "package"
    label = F.when(local, c("module")).otherwise(c("package"))
    outside = materialize(outside.select(*_AT, "source", "line", "local", "module", local.alias("is_local"), label.alias("label"), stable_id("repository_id", F.when(local, "unresolved-module").otherwise("package"), label).alias("target")), "outside")
    nodes.append(_nodes(outside, id=c("target"), name=c("label"), type=F.when(c("is_local"), "Module").otherwise("ExternalPackage"), repository_id=c("repository_id"), qualified_name=c("module")))
    edges.append(_edges(outside, F.when(c("is_local"), "IMPORTS").otherwise("USES_PACKAGE"), F.when(c("is_local"), "unresolved").otherwise("resolved")))
    # references, imported names and handlers are resolved together; what a file alone tells was found when it was read
    refs = parsed.select(*at, "module", F.posexplode("refs").alias("pos", "r")).select(*_AT, "module", F.xxhash64("repository_id", "file_path", "pos", lit("r")).alias("qid"), c("r.owner").alias("source"), "r.target", "r.kind", "r.line", "r.scope", "r.found", "r.is_open", "r.by_import", "r.models")
    refs = materialize(refs, "refs")
    named = r.imports.where("to is not null").select(*_AT, F.xxhash64("repository_id", "file_path", "local", lit("i")).alias("qid"), c("local").alias("target"), lit("").alias("scope"), "line")
    handled = endpoints.select(*_AT, F.xxhash64("repository_id", "file_path", "e.id", lit("h")).alias("qid"), c("e.handler").alias("target"), "e.handler_id", lit("").alias("scope"), c("e.id").alias("source"), c("e.start_line").alias("line"), c("e.end_line").alias("last"))
    open_refs = refs.where("kind <> 'DEFINES'")
    direct = handled.where("handler_id is not null").select("qid", c("handler_id").alias("id"))
    pending = open_refs.where("is_open")
    asked = pending.select("qid", *_AT, "target", "scope").unionByName(named.select("qid", *_AT, "target", "scope")).unionByName(handled.where("handler_id is null").select("qid", *_AT, "target", "scope"))
    operation = F.element_at(F.split("target", r"\."), -1)
    calls = refs.where(F.size("models") > 0).select("qid", *_AT, "source", "scope", "line", F.when(operation.isin(*WRITES), "WRITES_TO").otherwise("READS_FROM").alias("kind"), F.posexplode("models").alias("k", "m"))
    of_models = calls.select(F.xxhash64("qid", "k").alias("qid"), *_AT, "source", "scope", "line", "kind", "m.target", "m.found", "m.is_open")
    found = materialize(r.resolve(asked.unionByName(of_models.where("is_open").select("qid", *_AT, "target", "scope"))).unionByName(direct), "resolved")
    edges.append(_edges(refs.where("kind = 'DEFINES'"), "DEFINES", "resolved"))
    shown = named.join(found, "qid").withColumn("source", own).join(r.files.select(c("id")), "id", "left_anti")
    edges.append(_edges(shown.select("source", c("id").alias("target"), "file_path", "line"), "REFERENCES", "resolved"))
    hit = pending.join(found, "qid").drop("found").withColumnRenamed("id", "found").select(*open_refs.columns).unionByName(open_refs.where("found is not null"))
    edges.append(_kinded(hit.select("source", c("found").alias("target"), "file_path", "line", "kind"), "resolved"))
    missed = open_refs.where("found is null and not is_open").unionByName(pending.join(found, "qid", "left_anti")).withColumn("id", stable_id("repository_id", "file_path", "scope", lit("unresolved"), "target"))
    nodes.append(_nodes(missed, id=c("id"), name=c("target"), type=lit("UnresolvedSymbol"), repository_id=c("repository_id"), file_path=c("file_path"), start_line=c("line"), end_line=c("line"), qualified_name=c("target"), module=c("module")))
    edges.append(_kinded(missed.select("source", c("id").alias("target"), "file_path", "line", "kind"), "unresolved"))
    used = refs.where("kind = 'CALLS' and by_import").withColumn("local", F.split("target", r"\.")[0]).join(outside.where("not is_local").select(*_AT, "local", c("target").alias("package_id")), [*_AT, "local"])
    edges.append(_edges(used.select("source", c("package_id").alias("target"), "file_path", "line"), "USES_PACKAGE", "resolved"))
    bound = handled.join(found, "qid")
    edges.append(_edges(bound.select("source", c("id").alias("target"), "file_path", "line"), "HANDLES", "resolved"))
    lost = handled.join(found, "qid", "left_anti").withColumn("id", stable_id("repository_id", "file_path", lit("handler"), "target"))
    nodes.append(_nodes(lost, id=c("id"), name=c("target"), type=lit("UnresolvedSymbol"), repository_id=c("repository_id"), file_path=c("file_path"), start_line=c("line"), end_line=c("last")))
    edges.append(_edges(lost.select("source", c("id").alias("target"), "file_path", "line"), "HANDLES", "unresolved"))
    # model entities, and what reads and writes them
    models = refs.where(c("kind").isin("EXTENDS", "IMPLEMENTS") & c("target").rlike(_MODEL_BASE)).select("file_path", "line", "source").withColumn("entity", stable_id("source", lit("entity")))
    entities = materialize(models.select(c("source").alias("of"), "entity").distinct(), "entities")
    entity_nodes = entities.join(symbols.select(c("s.id").alias("of"), "*"), "of")
    texts.append(_nodes(entity_nodes, **{**fields, "id": c("entity"), "type": lit("DatabaseEntity")}, repository_id=c("repository_id"), file_path=c("file_path"), language=c("language"), module=c("module"), qualified_name=F.concat_ws(":", "file_path", "s.dotted")))
    edges.append(_edges(models.select("source", c("entity").alias("target"), "file_path", "line"), "BELONGS_TO", "resolved", "orm-pattern"))
    models_hit = of_models.where("is_open").drop("found").join(found, "qid").select("source", "file_path", "line", "kind", "id").unionByName(of_models.where("found is not null").select("source", "file_path", "line", "kind", c("found").alias("id")))
    touched = models_hit.join(entities.withColumnRenamed("of", "id"), "id")
    edges.append(_kinded(touched.select("source", c("entity").alias("target"), "file_path", "line", "kind"), "probable", "orm-pattern"))
    all_edges = reduce(DataFrame.unionByName, edges)
    columns = [f.name for f in NODES.fields[1:]]
    last = F.struct("start_line", "end_line", "type", "file_path", "qualified_name")
    bare = reduce(DataFrame.unionByName, nodes).groupBy("id").agg(F.max_by(F.struct(*columns[1:]), last).alias("x")).select("id", "x.*")
    whole = latest(reduce(DataFrame.unionByName, texts).withColumn("seq", F.col("start_line").cast("long")), *columns)
    node_rows = materialize(bare, "bare-nodes").unionByName(whole)
    best = F.coalesce((F.col("confidence") * 100).cast("long"), F.lit(-1)) * 2 + (F.col("analysis_method") != "syntax").cast("long")
    edge_rows = latest(materialize(all_edges, "raw-edges").withColumn("seq", best), *all_edges.columns, wide=True)
    graph = PropertyGraph(node_rows.withColumn("seq", F.lit(None).cast("long")), edge_rows.withColumn("seq", F.lit(None).cast("long")))
    return graph, parsed.select(*_AT, F.explode("warnings").alias("warning"))


def _kinded(rows: DataFrame, resolution: str, method: str = "syntax") -> DataFrame:
    """Edges whose type stands in the column kind."""
    return _edges(rows, F.col("kind"), resolution, method)


def graph_fingerprint(files: DataFrame) -> DataFrame:
    """(repository_id, fingerprint) of source files (repository_id, file_path, text)."""
    from .resolve import fingerprint

    return fingerprint(files.select("repository_id", "file_path", stable_id("text").alias("hash")))
