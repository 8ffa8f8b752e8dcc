"""What extraction yields for one file."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

SYMBOL = "id string, name string, type string, dotted string, start_line int, end_line int, signature string, source string, docstring string, parameters string, returns string, exported boolean, is_default boolean, hash string, place int, is_last boolean"
REFERENCE = "owner string, target string, kind string, line int, scope string, found string, is_open boolean, by_import boolean, models array<struct<target:string,found:string,is_open:boolean>>"
SCHEMA = (
    "repository_id string, file_path string, id string, module string, language string, end_line int, hash string, source string, warnings array<string>, "
    f"symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, "
    "imports array<struct<local:string,module:string,imported:string,line:int>>, "
    f"refs array<struct<{REFERENCE.replace(' ', ':').replace(',:', ',')}>>, "
    "bindings array<struct<key:string,target:string>>, shadowed array<string>, "
    "endpoints array<struct<id:string,name:string,handler:string,handler_id:string,start_line:int,end_line:int,source:string>>"
)
# fixed values: names of operations on models
WRITES = ("create", "save", "update", "delete", "add", "insert", "insert_one")
READS = ("find", "find_one", "filter", "get", "all", "select", "query")
_OPERATIONS = frozenset((*WRITES, *READS))
_MODEL = re.compile(r"\b([A-Z]\w*)\b", re.ASCII)
# fixed values: patterns of names, of routes and prefixes in decorators, and of what a call injects
NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
DOTTED = re.compile(r"[\w.]+\Z")
_VERBS = re.compile(r"@(?:[\w.]+\.)?(get|post|put|patch|delete|route|Get|Post|Put|Patch|Delete)\(\s*['\"]([^'\"]*)['\"]([^)]*)\)")
_CONTROLLER = re.compile(r"@Controller\(\s*['\"]([^'\"]*)['\"]")
_INJECTED = re.compile(r"\(\s*([\w.]+)\s*[,)]")


def key_of(*parts: str) -> str:
    """Key of an element, as in the schema module."""
    return hashlib.sha256(":".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:24]


@dataclass
class FileRecord:
    """Everything one file tells, in the order in which it stands there."""

    repository_id: str
    path: str
    text: str
    language: str
    warnings: list[str] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    imports: dict[str, tuple[str, str, int]] = field(default_factory=dict)
    refs: list[dict] = field(default_factory=list)
    bindings: dict[str, str] = field(default_factory=dict)
    shadowed: set[str] = field(default_factory=set)
    assigned: set[str] = field(default_factory=set)
    endpoints: list[dict] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.id = key_of(self.repository_id, self.path)

    def symbol(self, kind: str, scope: str, name: str, start: int, end: int, source: str, signature: str, *, docstring: str = "", parameters: str = "", returns: str = "", exported: bool = False, owner: str = "", at: int = 0) -> tuple[str, str]:
        """Add a symbol and its definition by ``owner``; returns (id, dotted name). ``at`` is its place in the text, by which an
        exported symbol is told to be the default one."""
        dotted = f"{scope}.{name}" if scope else name
        key = key_of(self.repository_id, self.path, dotted, kind)
        self.symbols.append(
            {"id": key, "name": name, "type": kind, "dotted": dotted, "start_line": start, "end_line": end, "signature": signature.strip().rstrip(":{"), "source": source, "docstring": docstring, "parameters": parameters, "returns": returns, "exported": exported, "is_default": exported and "export default" in self.text[max(0, at - 30) : at + 15], "hash": key_of(source), "place": len(self.symbols)}
        )
        self.reference(owner or self.id, key, "DEFINES", start)
        return key, dotted

    def reference(self, owner: str, target: str, kind: str, line: int, scope: str = "", arguments: str = "") -> None:
        self.refs.append({"owner": owner, "target": target, "kind": kind, "line": line, "scope": scope, "arguments": arguments})

    def call(self, owner: str, target: str, line: int, scope: str, arguments: str) -> None:
        """A call, and what it injects."""
        self.reference(owner, target, "CALLS", line, scope, arguments)
        if target.rsplit(".", 1)[-1] in ("Depends", "Security") and (m := _INJECTED.match(arguments)):
            self.reference(owner, m[1], "DEPENDS_ON", line, scope)

    def bases(self, key: str, extends: list[str], implements: list[str], line: int, scope: str) -> None:
        for names, kind in ((extends, "EXTENDS"), (implements, "IMPLEMENTS")):
            for name in names:
                self.reference(key, name, kind, line, scope)

    def assign(self, scope: str, name: str, call: str | None, function: bool = False) -> None:
        """A name is bound: to the result of a call where ``call`` names it; a second binding makes it unknown."""
        key = f"{scope}:{name}"
        again = key in self.assigned
        self.assigned.add(key)
        if not function or again:
            self.shadowed.add(key)
        if again:
            self.bindings.pop(key, None)
        elif call:
            self.bindings[key] = call

    def endpoint(self, method: str, route: str, handler: str, start: int, end: int, source: str) -> None:
        name = f"{method.upper()} {route}"
        self.endpoints.append({"id": key_of(self.repository_id, self.path, name, str(start)), "name": name, "handler": handler, "start_line": start, "end_line": end, "source": source})

    def decorated(self, decorators: str, key: str, dotted: str, kind: str, class_name: str, start: int, end: int) -> None:
        """Routes that decorators declare."""
        if kind == "Class" and (m := _CONTROLLER.search(decorators)):
            self.prefixes[dotted] = m[1]
        for verb, route, rest in _VERBS.findall(decorators):
            if verb[0].isupper():
                route = "/" + "/".join(p for p in (self.prefixes.get(class_name, "").strip("/"), route.strip("/")) if p)
            methods = re.findall(r"['\"](GET|POST|PUT|PATCH|DELETE)['\"]", rest) or ["GET"] if verb == "route" else [verb]
            for method in methods:
                self.endpoint(method, route, key, start, end, decorators.strip())

    def settle(self, target: str, scope: str) -> tuple[str | None, bool]:
        """(id of the symbol of this file that a name stands for, whether other files must be asked): scopes from the innermost
        outwards, then members of the innermost class around. (None, False) is a name that nothing here leads to."""
        target = target.removesuffix("()")
        parts = scope.split(".") if scope else []
        around = [".".join(parts[:n]) for n in range(len(parts), -1, -1)]
        names = target.split(".")
        hidden = [p for p in around if f"{p}:{names[0]}" in self.shadowed]
        if len(names) == 1 and hidden and not all(f"{p}:{target}" in self.bindings for p in hidden):
            return None, False
        for p in around:
            if symbol := self._known.get(f"{p}.{target}" if p else target):
                return symbol["id"], False
        if names[0] in ("self", "cls", "this") and len(names) > 1:
            inner = next((p for p in around if (s := self._known.get(p)) and s["type"] == "Class"), None)
            if inner is not None and (symbol := self._known.get(f"{inner}.{'.'.join(names[1:])}")):
                return symbol["id"], False
        if not hidden and names[0] in self.imports:
            return None, True
        for n in range(1, len(names)):
            receiver = ".".join(names[:n])
            inits = ("", ".__init__", ".constructor") if names[0] in ("self", "this") and n > 1 else ("",)
            if any(f"{p}{x}:{receiver}" in self.bindings for p in around for x in inits):
                return None, True
        return None, False

    def _settled(self, ref: dict) -> dict:
        """A reference with what it is found to be, and the models that an operation may be about."""
        arguments = ref.pop("arguments")
        found, open_ = (None, False) if ref["kind"] == "DEFINES" else self.settle(ref["target"], ref["scope"])
        models = []
        if ref["kind"] == "CALLS" and ref["target"].rsplit(".", 1)[-1] in _OPERATIONS:
            for name in dict.fromkeys([ref["target"].split(".", 1)[0], *_MODEL.findall(arguments)]):
                model = self.settle(name, ref["scope"])
                if model != (None, False):
                    models.append({"target": name, "found": model[0], "is_open": model[1]})
        return {**ref, "found": found, "is_open": open_, "by_import": ref["target"].split(".", 1)[0] in self.imports, "models": models}

    def row(self) -> dict:
        folder = self.path.rpartition("/")[0]
        self._known = {s["dotted"]: s for s in self.symbols}
        refs = [self._settled(dict(r)) for r in self.refs]
        ids = {s["id"] for s in self.symbols}
        symbols = [{**s, "is_last": self._known[s["dotted"]] is s} for s in self.symbols]
        endpoints = [{**e, "handler_id": e["handler"] if e["handler"] in ids else None} for e in self.endpoints]
        return {
            "repository_id": self.repository_id, "file_path": self.path, "id": self.id, "module": folder or "root", "language": self.language, "end_line": max(1, len(self.text.splitlines())), "hash": key_of(self.text),
            "source": self.text, "warnings": self.warnings, "symbols": symbols, "imports": [{"local": k, "module": m, "imported": i, "line": n} for k, (m, i, n) in self.imports.items()], "refs": refs,
            "bindings": [{"key": k, "target": t} for k, t in self.bindings.items()], "shadowed": sorted(self.shadowed), "endpoints": endpoints,
        }
