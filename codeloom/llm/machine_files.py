"""Source files that nobody wrote by hand for their repository: generated, minified, blocks of data, copies of third-party code.

Tool marks, running numbers, density and literal share are told from one file alone. Copies are told from what other
repositories hold: each file's normalised token stream (no comments, blanks, semicolons or quote style) is fingerprinted by
winnowing, and a file most of whose fingerprints recur in other repositories is a copy, also if it was slightly altered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .languages import EXTENSIONS, extension, is_source
from .unparsable_files import failure

#: Tokens of a fingerprinted run, and runs of which the least hash is kept: runs of TOKENS + WINDOW - 1 equal tokens share one.
TOKENS, WINDOW = 30, 10
#: Of a copy's fingerprints at least this share recurs in so many other repositories.
SHARE, HOLDERS = 0.6, 1
#: A fingerprint held more often than this share of all is joined by broadcast (at most 1 / HOT_SHARE of them exist).
HOT_SHARE = 1 / 2000

_PY = re.compile(r"""\#[^\n]*+|[rRbBuUfF]{0,2}(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')|\w++|[^\s\w]""")
_JS = re.compile(r"""//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`|[\w$]++|[^\s\w$]""")

# fixed values: words of tools about the file they wrote
_GENERATED = re.compile(
    r"""(?ix)^\W*(?:
     @generated\b | <\s*auto-?generated
    |(?:this\s+(?:file|code|module|source|script|class)\s+(?:is|was|has\s+been)\s+)?(?:auto(?:matically)?|machine)[-\s]?(?:generated|written|produced|created|built)\b(?!\s+(?:stubs?|tables?|values?|names?|parts?|docs?)\s+(?:are|is|were|was|must|should|carry|have|that))
    |(?:code\s+|file\s+|source\s+)?generated\s+(?:automatically\s+)?(?:by|from|with|using|on|at|via)\b
    |this\s+(?:file|code|module|source|script|class)\s+(?:is|was|has\s+been)\s+(?:auto\w*\s+)?(?:generated|produced|created|written|built|compiled|emitted)\s+(?:by|from|with|using|automatically)\b
    |(?:produced|created|emitted|built|compiled|written|output)\s+(?:automatically\s+)?(?:by|from|with)\s+\S+.*\b(?:edits?|changes?|modif\w+)\b.*\b(?:lost|discarded|overwritten|ignored|reverted)
    |(?:source|input|schema)\s*:\s*\S+\.(?:proto|thrift|idl|graphql|gql|avsc|avdl|xsd|wsdl|capnp|fbs|proto3|g4|y|lex|swagger|openapi)\b
    |.*\b(?:wurde|wird)\b.*\b(?:generiert|erzeugt|erstellt)\b.*\b(?:nicht|nie)\b.*\b(?:bearbeiten|[aä]ndern|editieren)
    |.*\b(?:g[eé]n[eé]r[eé]|produit|cr[eé][eé])\w*\s+(?:automatiquement|par)\b.*(?:ne\s+pas|modifi|[eé]dit)
    |.*\b(?:generad|producid|cread)[oa]\w*\s+(?:autom[aá]ticamente|por)\b.*(?:no\s+(?:editar|modificar|cambiar|tocar))
    |.*\b(?:gerad|generat)[oa]\w*\s+(?:automaticamente|por|da)\b.*(?:n[aã]o|non)\s+(?:edit|modific)
    |.*(?:сгенерирован|создан\s+автоматически).*(?:не\s+(?:редактир|измен|прав))
    ) | generated\b[^.;!\n]*[.;!,:\-–—]+\s*(?:please\s+)?(?:do\s+not|don'?t|never)\s+(?:edit|modify|change|touch)
      | \b(?:do\s+not|don'?t|never)\s+(?:edit|modify)\b[^.\n]{0,40}[.;!,:\-–—]+[^.\n]{0,30}\bgenerated\s+(?:by|from|file|code)""",
)
_BY_HAND = re.compile(r"(?i)\b(?:once|formerly|previously|originally|no longer|used to be|not|never|instead of)\b[^.\n]{0,20}\bgenerated|kept by hand|by hand (?:now|since)|hand-?(?:written|maintained|edited)|maintained by hand")
_KEYWORDS = frozenset(
    "if in do of as is or for var let new try get set def and not int any else this null true void with case from elif pass None True self const while break class super yield async await throw return switch typeof delete import export default "
    "function continue undefined".split()
)
_NUMBERED = re.compile(r"(?m)^(?:export\s+)?(?:(?:async\s+)?(?:def|function|class|const|let|var|interface|type)\s+)?([A-Za-z_$]\w*?)_?(\d+)(\w*)\s*(?:[=(:{<]|extends)")
_DEFINED = re.compile(r"(?m)^(?:export\s+)?(?:(?:async\s+)?(?:def|function|class|const|let|var|interface|type)\s+[A-Za-z_$][\w$]*|[A-Za-z_$][\w$]*\s*=(?!=))")
_STRING = re.compile(r"""[rRuU]?["']""")
_DIRECTIVES = frozenset(q + "use " + w + q for q in "\"'" for w in ("strict", "client", "server", "asm"))
# operators and commas without blanks around them, and with
_TIGHT = re.compile(r"[\w)\]\"](?:[-+*/%<>=!]=?|,|:)[\w(\[\"]")
_LOOSE = re.compile(r"[ \t][-+*/%<>=!]=?[ \t]|,[ \t]|\w:[ \t]+\w")
_MARKS = re.compile(r"(?m)^\s*(?:/\*+!?|\*+/|\*+|//+!?|#+!?|\"\"\"|''')\s?|\s*\*+/\s*$")

SCHEMA = "id string, repository_id string, file_path string, repo long, parses boolean, kind string, prints array<long>"


def tokens(text: str, python: bool) -> list[str]:
    """Tokens of ``text``, comments among them; strings whole."""
    return (_PY if python else _JS).findall(text)


def is_comment(token: str, python: bool) -> bool:
    return token[0] == "#" and len(token) > 1 if python else token[:2] in ("//", "/*")


def header(stream: list[str], python: bool) -> Iterator[str]:
    """Lines of the comments (and the docstring) with which a file opens; directives like "use strict" may stand between."""
    docstring = False
    for i, token in enumerate(stream):
        if is_comment(token, python):
            yield from _MARKS.sub("", token).splitlines()
        elif python and not docstring and _STRING.match(token):
            docstring = True
            yield from _MARKS.sub("", token.lstrip("rRuU")).splitlines()
        elif not python and (token in _DIRECTIVES or (token == ";" and i and stream[i - 1] in _DIRECTIVES)):
            continue
        elif token in ("#", "!") and i < 2 or (i < 12 and stream[0] == "#" and not python and stream[1] == "!"):
            continue  # the line that names an interpreter
        elif not (python and token == "#"):
            return


def says_generated(stream: list[str], python: bool) -> bool:
    """Whether a tool says in the opening comments that it wrote the file."""
    lines = list(header(stream, python))
    return any(_GENERATED.search(line) and not _BY_HAND.search(line) for line in lines)


def is_numbered(text: str) -> bool:
    """Whether the definitions of a file are a run of numbered ones, as generators write them: most of them, and the fewer there are
    the more."""
    found = [int(m[2]) for m in _NUMBERED.finditer(text) if len(m[2]) < 7]
    if len(found) < 3:
        return False  # two make no run
    steps = Counter(b - a for a, b in zip(found, found[1:]))
    slack = 0 if len(found) < 6 else 1
    return steps[1] >= (1 - 0.2 * slack) * (len(found) - 1) and len(found) >= (1 - 0.3 * slack) * len(_DEFINED.findall(text))


def is_minified(text: str, stream: list[str], python: bool) -> bool:
    """Dense code with hardly any blanks, and mostly one- or two-letter names: in scripts on few lines, in Python with statements
    joined by semicolons or indents of one column."""
    code = [t for t in stream if not is_comment(t, python)]
    names = [t for t in code if (t[0].isalpha() or t[0] in "_$") and t not in _KEYWORDS and t[-1] not in "\"'"]
    short = sum(len(t) <= 2 for t in names)
    if python:
        bare = _PY.sub(lambda m: "" if is_comment(m[0], True) else '""' if m[0][-1] in "\"'" and len(m[0]) > 1 else m[0], text)
        indents = [len(m[1]) for m in re.finditer(r"(?m)^([ \t]+)\S", bare)]
        tight, loose = len(_TIGHT.findall(bare)), len(_LOOSE.findall(bare))
        joined = len(re.findall(r";[ \t]*\S", bare))
        lines = sum(1 for x in bare.splitlines() if x.strip())
        close = bool(indents) and min(indents) == 1 and sum(n <= 3 for n in indents) >= 0.8 * len(indents)
        return bool(code) and len(code) == len(stream) and tight + loose >= 3 and loose <= 0.1 * (tight + loose) and short >= 0.5 * max(1, len(names)) and (close or joined >= 0.3 * lines)
    strings = sum(len(t) - 2 for t in code if t[0] in "\"'`")
    dense = sum(map(len, code)) - strings
    bare = _JS.sub(lambda m: "" if is_comment(m[0], python) else m[0], text)
    lines = [x for x in bare.splitlines() if x.strip()]
    blanks = len(re.findall(r"\s", bare)) - sum(len(re.findall(r"\s", t)) for t in code if t[0] in "\"'`")
    return dense / max(1, len(lines)) >= 110 and blanks <= 0.15 * dense and short >= 0.35 * max(1, len(names))


def is_data(stream: list[str], python: bool) -> bool:
    """Mainly literals: numbers, encoded or short strings and what separates them; prose in strings doesn't count as data."""
    total = data = values = 0
    for t in stream:
        if is_comment(t, python):
            continue
        n = len(t)
        total += n
        c = t[0]
        if c.isdigit() or c in ",[]{}:-.+":
            data += n
            values += c.isdigit()
        elif c in "\"'`" or (python and n > 2 and t[-1] in "\"'"):
            values += 1
            if t.count(" ") < 0.08 * n or n <= 24:
                data += n
            elif not re.search(r"[A-Za-z]{2,} [A-Za-z]{2,} [A-Za-z]{2,}", t):
                data += n
    return values >= 5 and data >= 0.88 * total  # a few values make no block


_hashes: dict[str, int] = {}


def fingerprints(stream: list[str], python: bool) -> np.ndarray:
    """Winnowed hashes of runs of TOKENS normalised tokens, distinct, as signed 64-bit numbers; a shorter stream is one run."""
    if len(_hashes) > 500_000:
        _hashes.clear()
    codes = []
    for t in stream:
        if is_comment(t, python) or t == ";":
            continue
        code = _hashes.get(t)
        if code is None:
            bare = t.lstrip("rRbBuUfF")[1:-1] if python and t[-1] in "\"'" and len(t) > 1 else t[1:-1] if t[0] in "\"'`" and len(t) > 1 else t
            code = _hashes[t] = xxhash.xxh64_intdigest(bare)
        codes.append(code)
    if not codes:
        return np.empty(0, np.int64)
    length = min(TOKENS, len(codes))
    n = len(codes) - length + 1
    runs = sliding_window_view(np.array(codes, np.uint64), length)
    weights = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
    mixed = (runs * weights).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    least = sliding_window_view(mixed, min(WINDOW, n)).min(axis=1)
    return np.unique(least).view(np.int64)


def features(text: str, ext: str) -> tuple[bool, str | None, np.ndarray]:
    """(parses, "generated", "minified", "data" or None, fingerprints) of one text."""
    python = EXTENSIONS[ext] == "python"
    stream = tokens(text, python)
    if not stream:
        return True, None, np.empty(0, np.int64)
    kind = None
    if says_generated(stream, python) or is_numbered(text):
        kind = "generated"
    elif is_minified(text, stream, python):
        kind = "minified"
    elif is_data(stream, python):
        kind = "data"
    return failure(text, ext) is None, kind, fingerprints(stream, python)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [features(text or "", ext) for text, ext in zip(batch["source"], batch["ext"])]
        yield pd.DataFrame(
            {
                **{c: batch[c] for c in ("id", "repository_id", "file_path", "repo")},
                "parses": [x[0] for x in found],
                "kind": [x[1] for x in found],
                "prints": [x[2] for x in found],
            }
        )


def machine_files(files: DataFrame, holders: int = HOLDERS) -> DataFrame:
    """Source files not written by hand for their repository: id, repository_id, file_path, kind ("generated", "minified",
    "data" or "copy"), once for each id.

    ``files`` needs id, repository_id, file_path, source; other columns are ignored. Files of other extensions, with null id or
    path, without tokens, and files that do not parse are no cases. A null repository_id counts as one repository. Rows repeated
    with one id count once. A fingerprint recurs if at least ``holders`` other repositories hold it. Exact and altered copies are found alike; which repositories hold a copy is told from the
    fingerprints of all files, and a fingerprint that is held very often is joined apart, so it burdens no single task.
    """
    scan = files.where(is_source(F.col("file_path")) & F.col("id").isNotNull()).select(
        "id", "repository_id", "file_path", extension(F.col("file_path")).alias("ext"), "source", F.xxhash64(F.coalesce("repository_id", F.lit(""))).alias("repo")
    )
    known = materialize(spread(scan).mapInPandas(_features, SCHEMA), "file-features")
    prints = known.select("id", "repo", F.explode("prints").alias("print"))
    total = known.agg(F.sum(F.size("prints"))).first()[0] or 0
    several = F.min("repo") != F.max("repo") if holders == 1 else F.countDistinct("repo") > holders
    held = prints.groupBy("print").agg(F.count("*").alias("n"), several.alias("recurs"))
    hot_from = max(20_000, int(total * HOT_SHARE))
    hot = F.broadcast(held.where(F.col("n") > hot_from).select("print", F.col("recurs").alias("hot")))
    elsewhere = held.where((F.col("n") <= hot_from) & F.col("recurs")).select("print", F.lit(True).alias("cold"))
    marked = prints.join(hot, "print", "left")
    recurring = marked.where(F.col("hot").isNull()).join(elsewhere, "print").select("id", "print").unionByName(marked.where("hot").select("id", "print"))
    shared = recurring.groupBy("id").agg(F.countDistinct("print").alias("shared"))
    verdict = F.coalesce("kind", F.when(F.col("shared") >= SHARE * F.size("prints"), "copy"))
    return (
        known.where("parses")
        .join(shared, "id", "left")
        .withColumn("kind", verdict)
        .where(F.col("kind").isNotNull())
        .groupBy("id")
        .agg(F.first("repository_id").alias("repository_id"), F.first("file_path").alias("file_path"), F.min("kind").alias("kind"))
    )
