"""Configuration texts as (key path, value, start, end): offsets of each value in the original text, quotes excluded.

The readers are tolerant: what they cannot read they skip, so a damaged file still yields its other settings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Setting = tuple[tuple[str, ...], str, int, int]

_ENV = re.compile(r"""(?m)^[ \t]*+(?:export[ \t]+)?([\w.\-]+)[ \t]*+=[ \t]*+(?:"((?:[^"\\]|\\.)*+)"|'([^']*+)'|([^\s#"'][^\n\r#]*?(?=[ \t]+\#|[ \t]*\r?$)|[^\s"'][^\n\r]*?(?=[ \t]*\r?$)))""")
_INI = re.compile(r"""(?m)^(?:[ \t]*+\[([^\]\n]*+)\]|[ \t]*+(?![#;])([^=:\n\[\]#;]+?)[ \t]*+[=:](?!=)[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'([^'\n]*+)'|([^\s"'][^\n\r]*?(?=[ \t]*\r?$))))""")
_TOML = re.compile(
    r'''(?m)^[ \t]*+(?:\[{1,2}([^\]\n]*+)\]{1,2}|([\w.\-]+|"[^"\n]*+"|'[^'\n]*+')[ \t]*+=[ \t]*+(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'((?:[^']|'(?!''))*+)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|'([^'\n]*+)'|([^\s#"'][^\n\r#]*?(?=[ \t]*(?:\#|\r?$)))))'''
)
# tokens of collections in brackets or braces: quoted and plain scalars, marks, comments
_TOML_TOKEN = re.compile(r'''"""(?P<d3>(?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'(?P<s3>(?:[^']|'(?!''))*+)\'\'\'|"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>[^'\n]*+)'|\#[^\n]*+|(?P<mark>[{}\[\],=])|(?P<plain>[^\s{}\[\],=\#"'](?:[^{}\[\],=\#\n]*[^\s{}\[\],=\#])?)''')
_YAML_TOKEN = re.compile(
    r"""(?s)"(?P<d>(?:[^"\\]|\\.)*+)"|'(?P<s>(?:[^']|'')*+)'|(?<=\s)\#[^\n]*+|(?P<mark>[{}\[\],]|:(?=[\s,\[\]{}"']|\Z)|(?<=["']):)|(?P<plain>(?:[^\s,\[\]{}"':]|:(?![\s,\[\]{}"']|\Z))(?:(?:[^\n\r,\[\]{}:\#]|:(?![\s,\[\]{}]|\Z)|(?<!\s)\#)*(?:[^\s,\[\]{}:]|:(?![\s,\[\]{}]|\Z)))?)"""
)
_YAML_OPEN = re.compile(r"(?m)^[ \t]*+(?:---[ \t]++)?(?:-[ \t]++)*+(?=[{\[])")
_JSON = re.compile(r'"((?:[^"\\\n]|\\.)*+)"|([{}\[\],:])|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|[^\s{}\[\],:"]++')
_YAML = re.compile(
    r"""(?m)^([ \t]*+(?:-[ \t]+)*+)(?:(?!["'\#&*!|>%@`{\[])([^\s:#][^:\n]*?)|"([^"\n]*+)"|'([^'\n]*+)')[ \t]*+:(?=[ \t\r]|$)[ \t]*+(?:!\S++[ \t]*+|&\S++[ \t]*+)*+(?:"((?:[^"\\]|\\.)*+)"|'((?:[^']|'')*+)'|([|>][+-]?\d?[ \t]*\r?$)|([^\s#"'|>&*!\[{][^\n\r]*?(?=[ \t]+\#|[ \t]*\r?$)))?"""
)
_YAML_ITEM = re.compile(r"""(?m)^([ \t]*+)-[ \t]+(?:"((?:[^"\\\n]|\\.)*+)"|'([^'\n]*+)'|([^\s#"'\-][^\n\r:]*?(?=[ \t]*\r?$)))[ \t]*\r?$""")

_YAML_HEAD = re.compile(r"(?m)^[ \t]*(?:-[ \t]+)?([\w.\-]+):[ \t]*\r?$")


def _pick(m: re.Match, groups: range) -> tuple[str, int, int] | None:
    for g in groups:
        if m[g] is not None:
            return m[g], m.start(g), m.end(g)
    return None


def _name(raw: str) -> str:
    return raw.strip().strip("\"'")


def dotenv(text: str) -> Iterator[Setting]:
    for m in _ENV.finditer(text):
        if found := _pick(m, range(2, 5)):
            yield (m[1],), *found


def ini(text: str) -> Iterator[Setting]:
    section: tuple[str, ...] = ()
    for m in _INI.finditer(text):
        if m[1] is not None:
            section = (m[1].strip(),)
        elif found := _pick(m, range(3, 6)):
            yield (*section, _name(m[2])), *found


_INI_KEY = re.compile(r"[ \t]*+(?![#;])([^=:\n\[\]#;]+?)[ \t]*+[=:](?!=)")
_BARE = re.compile(r"""(?<!\S)([\w.\-]++)[ \t]++(?:"((?:[^"\\\n]|\\.)*+)"|'([^'\n]*+)'|([^\s"';]++(?<!;)))[ \t]*+;?[ \t]*+\r?$""")


def bare_rows(text: str, prose: bool = False) -> Iterator[Setting]:
    """Rows of INI-like texts that hold a value without a mark between: continuations of the setting above, which are indented
    deeper, and directives (name, blanks, value; of more words the last two, but in ``prose`` rows of two words only)."""
    key: tuple[str, ...] = ()
    section: tuple[str, ...] = ()
    depth = 0
    for row in re.compile(r"[^\n]+").finditer(text):
        line = row[0]
        body = line.strip()
        if not body or body[0] in "#;":
            continue
        indent = len(line) - len(line.lstrip())
        if body[0] == "[" and body[-1] == "]":
            section, key = (body[1:-1].strip(),), ()
            continue
        if m := _INI_KEY.match(line):
            if m.end() < len(line.rstrip()) or not key or indent <= depth:
                key, depth = (*section, _name(m[1])), indent
                continue
        if key and indent > depth:
            value = body.rstrip("\\,").rstrip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            at = row.start() + indent + quoted
            yield key, value[1:-1] if quoted else value, at, at + len(value) - 2 * quoted
        else:
            key = ()
            if (m := _BARE.match(line, indent) if prose else _BARE.search(line)) and (found := _pick(m, range(2, 5))):
                yield (*section, m[1]), found[0], row.start() + found[1], row.start() + found[2]


def _collection(text: str, at: int, path: tuple[str, ...], token: re.Pattern, mark: str) -> tuple[list[Setting], int | None]:
    """Settings of the collection that opens at ``at``, and its end (None if it isn't closed); ``mark`` stands behind keys."""
    out: list[Setting] = []
    paths: list[tuple[str, ...]] = []
    here = path
    held: tuple[str, int, int] | None = None  # a scalar that may turn out to be a key
    for m in token.finditer(text, at):
        if m["mark"] is None:
            if m.lastgroup:
                if held is not None:
                    out.append((here, *held))
                held = m[m.lastgroup], m.start(m.lastgroup), m.end(m.lastgroup)
            continue
        if m["mark"] == mark:
            if held is not None:
                here = (*paths[-1], *(map(_name, held[0].split(".")) if mark == "=" else (held[0],)))
                held = None
            continue
        if held is not None:
            out.append((here, *held))
            held = None
        if m["mark"] in "{[":
            paths.append(here)
        elif m["mark"] in "}]":
            here = paths.pop()
            if not paths:
                return out, m.end()
        if paths and m["mark"] == ",":
            here = paths[-1]
    if held is not None:
        out.append((here, *held))
    return out, None


def toml(text: str) -> Iterator[Setting]:
    section: tuple[str, ...] = ()
    skip = 0
    whole = True  # so far all collections are closed; an open one takes the rest of the text
    for m in _TOML.finditer(text):
        if m.start() < skip:
            continue
        if m[1] is not None:
            section = tuple(map(_name, m[1].split(".")))
        elif found := _pick(m, range(3, 8)):
            path = (*section, *map(_name, m[2].split(".")))
            if m[7] is not None and found[0].startswith(("{", "[")):
                if whole:
                    inner, end = _collection(text, found[1], path, _TOML_TOKEN, "=")
                    # numbers and the like of fewer than 4 characters are no settings that matter
                    yield from (x for x in inner if x[3] - x[2] >= 4 or text[x[2] - 1] in "\"'")
                    whole, skip = end is not None, end or 0
            else:
                yield path, *found


def json_text(text: str) -> Iterator[Setting]:
    path: list[str] = []
    kinds: list[str] = []
    key = ""
    held: re.Match | None = None  # a string that may turn out to be a key

    def value(m: re.Match) -> Setting:
        return (*path[1:], key) if kinds and kinds[-1] == "{" else tuple(path[1:]), m[1], m.start(1), m.end(1)

    for m in _JSON.finditer(text):
        if m[1] is not None:
            if held is not None:
                yield value(held)
            held = m
            continue
        mark = m[2]
        if mark == ":" and held is not None:
            key, held = held[1], None
            continue
        if held is not None and mark:
            yield value(held)
            held = None
        if mark in ("{", "["):
            path.append(key)
            kinds.append(mark)
        elif mark in ("}", "]") and path:
            key = path.pop()
            kinds.pop()
    if held is not None:
        yield value(held)


def yaml(text: str) -> Iterator[Setting]:
    stack: list[tuple[int, str]] = []
    block = -1
    skip = 0
    whole = True  # so far all collections are closed; an open one takes the rest of the text
    flows: list[tuple[int, int]] = []
    heads = [(m.start(), m[1]) for m in _YAML_HEAD.finditer(text)] if _YAML_OPEN.search(text) else []
    at = 0
    last = ""
    for m in _YAML_OPEN.finditer(text):
        if whole and (not flows or m.start() >= flows[-1][1]):
            while at < len(heads) and heads[at][0] < m.start():
                last, at = heads[at][1], at + 1
            inner, end = _collection(text, m.end(), (last,) if last else (), _YAML_TOKEN, ":")
            yield from inner
            whole = end is not None
            if whole:
                flows.append((m.start(), end))
    flow = 0
    closed = 0
    keys: list[tuple[int, int, str]] = []
    for m in _YAML.finditer(text):
        indent = len(m[1].replace("- ", "  ").expandtabs(8))
        while flow < len(flows) and flows[flow][1] <= m.start():
            flow += 1
        if m.start() < skip and indent > block or m.start() < closed or (flow < len(flows) and flows[flow][0] <= m.start()):
            continue
        key = next(x for x in (m[2], m[3], m[4]) if x is not None).strip()
        while stack and stack[-1][0] >= indent:
            stack.pop()
        path = (*(k for _, k in stack), key)
        stack.append((indent, key))
        keys.append((m.start(), indent, key))
        if m[7] is not None:  # a block scalar: all deeper lines
            body = re.compile(rf"(?:\r?\n(?:[ \t]{{{indent + 1},}}[^\n]*|[ \t\r]*(?=\n|\Z)))*").match(text, m.end())
            skip, block = body.end(), indent
            inner = body[0]
            yield path, inner.strip(), body.start() + len(inner) - len(inner.lstrip()), body.end() - (len(inner) - len(inner.rstrip()))
        elif found := _pick(m, range(5, 7)) or _pick(m, range(8, 9)):
            yield path, *found
        elif whole and text[m.end() : m.end() + 1] in ("{", "["):
            inner, end = _collection(text, m.end(), path, _YAML_TOKEN, ":")
            yield from inner
            whole, closed = end is not None, end or 0
    yield from _yaml_items(text, keys)


def _yaml_items(text: str, keys: list[tuple[int, int, str]]) -> Iterator[Setting]:
    """Scalars of block lists, under all keys around them; ``keys`` are (place, indent, key) in order."""
    stack: list[tuple[int, str]] = []
    at = 0
    for m in _YAML_ITEM.finditer(text):
        while at < len(keys) and keys[at][0] < m.start():
            _, indent, key = keys[at]
            while stack and stack[-1][0] >= indent:
                stack.pop()
            stack.append((indent, key))
            at += 1
        indent = len(m[1].expandtabs(8))
        while stack and stack[-1][0] > indent:
            stack.pop()
        if found := _pick(m, range(2, 5)):
            yield tuple(k for _, k in stack) or ("",), *found


_XML = re.compile(r"""(?s)<!--.*?-->|<!\[CDATA\[(?P<data>.*?)\]\]>|<[?!][^>]*+>|</\s*+(?P<close>[\w:.\-]++)\s*+>|<(?P<open>[\w:.\-]++)(?P<attributes>(?:[^<>"']|"[^"]*+"|'[^']*+')*+)>|(?P<text>[^<]++)""")
_ATTRIBUTE = re.compile(r"""([\w:.\-]+)\s*=\s*(?:"([^"]*+)"|'([^']*+)')""")


def xml(text: str) -> Iterator[Setting]:
    """Texts of elements and values of attributes. A value beside a key or name is that one's, as is the element behind a key."""
    path: list[str] = []
    named = ""
    for m in _XML.finditer(text):
        if m["open"]:
            tag = m["open"].rpartition(":")[2]
            fields = {a[1].rpartition(":")[2].lower(): a for a in _ATTRIBUTE.finditer(text, m.start("attributes"), m.end("attributes"))}
            label = next((_pick(fields[k], range(2, 4))[0] for k in ("key", "name") if k in fields), "")
            for a in fields.values():
                at = a[1].rpartition(":")[2]
                if found := _pick(a, range(2, 4)):
                    yield (*path, tag, label if label and at.lower() == "value" else at), *found
            if not m["attributes"].rstrip().endswith("/"):
                path.append(label or tag)
        elif m["close"]:
            if path:
                path.pop()
        elif (m["text"] or m["data"]) is not None:
            group = "text" if m["text"] is not None else "data"
            body = m[group].strip()
            if not body:
                continue
            start = m.start(group) + m[group].index(body)
            if path and path[-1].lower() == "key":
                named = body
            elif path:
                own = path[-1]
                yield (*path[:-1], named if named and own.lower() in ("string", "data") else own), body, start, start + len(body)
                named = ""


def nested(keys: tuple[str, ...], value: str, start: int, prose: bool = False) -> Iterator[Setting]:
    """Settings within a value of several lines (also of escaped line breaks) that starts at ``start``, read by the format that
    its key names (`settings.toml`), else as YAML and as rows of settings; offsets are those of the original text."""
    opens = False

    def plain(m: re.Match) -> str:
        nonlocal opens
        if m[1] == '"':
            opens = not opens
            return ' "' if opens else '" '
        return " \n" if m[1] == "n" else "  "

    value = re.sub(r'\\([nrt"])', plain, value)
    named = reader(keys[-1], None) if keys and "." in keys[-1] else None
    for read in ((named, bare_rows) if named is ini else (named,)) if named else (yaml, ini, bare_rows):
        for inner, text, a, b in bare_rows(value, prose) if read is bare_rows else read(value):
            if b - a < len(value):
                yield (*keys, *inner), text, start + a, start + b


# fixed values: extensions and index languages of configuration formats
READERS = {"env": dotenv, "ini": ini, "cfg": ini, "conf": ini, "properties": ini, "toml": toml, "json": json_text, "yml": yaml, "yaml": yaml, "xml": xml, "config": xml, "plist": xml}
LANGUAGES = {"dotenv": dotenv, "ini": ini, "toml": toml, "json": json_text, "yaml": yaml, "xml": xml}


def reader(path: str | None, language: str | None):
    """Reader for a file, by name, extension, then language; None if it is no configuration file."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    if name == ".env" or name.startswith(".env.") or name.endswith(".env"):
        return dotenv
    return READERS.get(name.rsplit(".", 1)[-1] if "." in name else "") or LANGUAGES.get((language or "").strip().lower())
