"""Functions paired with their documentation, by recursive patterns over whole source texts.

Strings, template texts, regular expressions and comments are units: one pass hides what stands in them, and one pass over the
brackets finds each one's partner. On the hidden text a recursive pattern for each language family captures decorators and
signature, balanced brackets in them, at each function (Python) or behind each comment (scripts); comment, docstring and body
are cut out around it, the body to the partner of its bracket or, in Python, to the next line that isn't deeper. The time is
linear in the text, also of damaged ones.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .languages import EXTENSIONS, extension, is_source

SCHEMA = "repository_id string, file_path string, start_line int, name string, signature string, description string, code string, trivial boolean"

#: Documentation with fewer words of prose is trivial.
LEAST_WORDS = 5

# units that hide what stands in them
_PY_UNIT = regex.compile(r"""\#[^\n]*+|(?:(?<!\w)[A-Za-z]{1,2})?+(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\')""", regex.DOTALL)
_JS_UNIT = regex.compile(r"""//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`|/|[{}]""", regex.DOTALL)
_PIECE = regex.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(?:`|\$(?=\{))", regex.DOTALL)
_REGEX = regex.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+")
_BRACKET = regex.compile(r"[()\[\]{}]")
_PARTNER = {")": "(", "]": "[", "}": "{"}

# heads of functions in texts whose units are masked, and whose brackets all have a partner: balanced by recursion
_BALANCED = r"""
(?(DEFINE)
  (?P<par>\((?:[^()\[\]{}]++|(?&par)|(?&brk)|(?&brc))*+\))
  (?P<brk>\[(?:[^()\[\]{}]++|(?&par)|(?&brk)|(?&brc))*+\])
  (?P<brc>\{(?:[^()\[\]{}]++|(?&par)|(?&brk)|(?&brc))*+\})
  (?P<ang><(?:[^<>(){}]++|(?&ang)|(?&par)|(?&brc))*+>)
  (?P<type>(?:[^(){}\[\]=;,\n<\x01]++|(?&ang)|(?&par)\s*+=>|(?&par)|(?&brk)|(?&brc)(?=\s*+(?:[\[|&{]|=>)))++)
)
"""
_PY_HEAD = _BALANCED + r"""
(?P<indent>[ \t]*+)(?P<signature>(?:async[ \t]++)?+def[ \t]++(?P<name>\w++)\s*+(?&brk)?+(?&par)\s*+(?:->(?:[^:\n\[\](){}]++|(?&par)|(?&brk)|(?&brc))*+)?+:?)
"""
_JS_HEAD = _BALANCED + r"""
(?P<decorators>(?:[ \t]*+@[\w.]++[ \t]*+(?&par)?+[^\n]*+\n)*+)
[ \t]*+(?P<signature>(?:export[ \t]++)?+(?:default[ \t]++)?+(?:declare[ \t]++)?+
  (?:(?:async[ \t]++)?+function\b[ \t]*+\*?[ \t]*+(?P<name>[\p{L}_$][\w$]*+)?\s*+(?&ang)?+\s*+(?&par)(?:\s*+:(?&type))?+
   |(?:const|let|var)[ \t]++(?P<name>[\p{L}_$][\w$]*+)(?:\s*+:(?&type))?+\s*+=\s*+(?:async\b\s*+)?+(?:function\b\s*+\*?\s*+[\w$]*+\s*+(?&ang)?+(?&par)(?:\s*+:(?&type))?+|(?&ang)?+(?:(?&par)|[\p{L}_$][\w$]*+)(?:\s*+:(?&type))?+\s*+=>)
   |(?!(?:if|for|while|switch|catch|return|function|new|typeof|do|else|with|await|throw)\b)(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|accessor)[ \t]++)*+\*?[ \t]*+(?P<name>\#?[\p{L}_$][\w$]*+)\s*+\??(?:(?&ang)?+\s*+(?&par)(?:\s*+:(?&type))?+\s*+(?=[{\x01])|(?:\s*+:(?&type))?+\s*+=\s*+(?:async\b\s*+)?+(?:(?&par)|[\p{L}_$][\w$]*+)(?:\s*+:(?&type))?+\s*+=>)
  ))
"""
_BEFORE_REGEX = frozenset("=(,:[!&|?{};")


@cache
def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    flags = regex.VERBOSE | regex.MULTILINE | regex.DOTALL | regex.VERSION0
    return regex.compile(_PY_HEAD, flags), regex.compile(_JS_HEAD, flags)


class Masked:
    """A text with its units hidden, character by character: comments are blanks, strings are quotes without line breaks, brackets
    without a partner are marks that open and close nothing. One pass over units, one over brackets."""

    def __init__(self, text: str, python: bool):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.strings: dict[int, int] = {}
        parts, at = [], 0
        for start, end in self._python_units() if python else self._script_units():
            parts.append(text[at:start])
            piece, at = text[start:end], end
            if piece[0] == "#" or piece[:2] in ("//", "/*"):
                self.comments.append((start, end))
                parts.append(regex.sub(r"[^\r\n]", " ", piece))
            else:
                self.strings[start] = end
                parts.append('"' * len(piece))
        code = "".join([*parts, text[at:]])
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        waiting = dict.fromkeys("([{", 0)
        lost: list[int] = []
        for m in _BRACKET.finditer(code):
            c, i = m[0], m.start()
            if c in waiting:
                stack.append(i)
                waiting[c] += 1
            elif not waiting[_PARTNER[c]]:
                lost.append(i)
            else:
                while code[stack[-1]] != _PARTNER[c]:
                    waiting[code[stack[-1]]] -= 1
                    lost.append(stack.pop())
                waiting[_PARTNER[c]] -= 1
                self.partner[stack.pop()] = i
        lost += stack
        if lost:
            marks, at, parts = sorted(lost), 0, []
            for i in marks:
                parts += (code[at:i], "\x01")
                at = i + 1
            code = "".join([*parts, code[at:]])
        self.code = code

    def _python_units(self) -> Iterator[tuple[int, int]]:
        return (m.span() for m in _PY_UNIT.finditer(self.text))

    def _script_units(self) -> Iterator[tuple[int, int]]:
        """Comments, strings, regular expressions and the pieces of text of templates; code in templates is code."""
        text, at = self.text, 0
        braces: list[bool] = []  # open braces: whether text of a template goes on behind them
        whole = True
        while m := _JS_UNIT.search(text, at):
            c, start, at = m[0], m.start(), m.end()
            if c == "{":
                braces.append(start > 0 and text[start - 1] == "$" and start == self._opened)
                continue
            if c == "}" and not (braces and braces.pop()):
                continue
            if c in "`}" and whole:
                if not (piece := _PIECE.match(text, start + 1)):
                    whole = False  # no template ends any more
                    continue
                at = piece.end()
                self._opened = at if text[at - 1 : at + 1] == "${" else -1
                first = start + (c == "}")
                if at > first:
                    yield first, at
            elif c in "`}":
                continue
            elif c == "/":
                back = start - 1
                while back >= 0 and text[back] in " \t\r\n":
                    back -= 1
                if (back < 0 or text[back] in _BEFORE_REGEX or text[max(0, back - 5) : back + 1] == "return") and (r := _REGEX.match(text, start)):
                    at = r.end()
                    yield start, at
            else:
                yield start, at

    _opened = -1


# fixed values: comments that address a tool and not a reader
_DIRECTIVE = regex.compile(
    r"^\W*(?:eslint\b|prettier-ignore|@ts-\w+|istanbul ignore|c8 ignore|v8 ignore|jshint\b|jslint\b|tslint:|webpack\w+:|noqa\b|pylint:|"
    r"type:\s*ignore|mypy:|pyright:|fmt:|yapf:|isort:|flake8|nosec\b|pragma:|ruff:|region\b|endregion\b|-\*-|vim:|coding[:=]|"
    r"biome-ignore|stylelint-|sourceMappingURL|@jsx\b|@flow\b|global\s+\w+$|NOLINT|#?!/)"
)
_PLACEHOLDER = regex.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip)\b\W*(?:\(\w*\)\W*)?(?:.{0,40}\b(?:describe|description|document|documentation|docs?|docstring|explain|comment|summary|write|fill)\b.*)?"
    r"|.{0,40}\b(?:descriptions?|documentation|docs|docstring|summary|comment)\b.{0,30}\b(?:goes? here|to be (?:written|added|done|filled)|pending|missing|follows|will be|comes? (?:here|later)|needed|tbd|todo)\b.*"
    r"|(?:please )?(?:add|insert|write|put|fill in|provide)\b.{0,20}\b(?:descriptions?|documentation|docs?|docstring|summary|comment)\b.{0,20}\b(?:here|later|soon)?"
    r"|.{0,30}\bto be (?:written|documented|described)\b.*"
    r"|(?:this (?:function|method) )?(?:needs|lacks|has no) (?:a )?(?:description|documentation|docs|docstring)\b.*"
    r"|not (?:yet )?documented\b.*|undocumented\b.*|lorem ipsum\b.*)\W*$",
    regex.IGNORECASE | regex.DOTALL,
)
_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!/)|//+[!/]?|#+[!:]?)?\s?|\s*\*+/\s*$", regex.MULTILINE)
_QUOTES = regex.compile(r"^[rRuU]?(\"\"\"|'''|\"|')(.*)\1$", regex.DOTALL)
_TAG = regex.compile(
    r"^\s*(?:[@\\](?:param|arg|argument|property|prop|template|typedef|type|throws|raises|exception|returns?|yields?)\b(?:\s*\{[^}]*\})?(?:\s*\[?[\w$.]+(?:=[^\]\s]*)?\]?)?\s*-?"
    r"|[@\\]\w+(?:\s*\{[^}]*\})?"
    r"|:(?:param|type|raises?|keyword|arg|argument|var|ivar|cvar|rtype|returns?|yields?)\b[^:\n]*:)[ \t]*",
    regex.MULTILINE,
)
_SECTION = regex.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|examples?|notes?|attributes)\s*:?\s*$", regex.IGNORECASE)
_FIELD = regex.compile(r"^\s*\*{0,2}[\w$.]+(?:\s*\([^)]*\))?\s*:(?=\s|$)\s*")
_CODE = regex.compile(
    r"""^\s*(?:
      .*[;{}]\s*$                                                     # statements and braces
     |[\w$.\[\]'"]+(?:\s*:\s*[\w$.\[\]|<>]+)?\s*(?:[-+*/%|&^]|\*\*|//|<<|>>|\?\?|\|\||&&|:)?=(?!=)\s*\S.*   # assignment
     |(?:await\s+|yield\s+|return\s+|raise\s+|throw\s+|new\s+)*[\w$]+(?:\.[\w$]+)*\(.*\)[;:,]?\s*$       # call
     |(?:const|let|var)\s+[\w${\[].*=.*
     |(?:return|break|continue|pass)(?:\s+[\w$.\-"'()\[\]]+)?\s*;?\s*$
     |(?:if|elif|while|for|with|except|def|class|else|try|finally|async\s+def|match|case)\b[^.!?]*:\s*$
     |(?:if|while|for|switch|catch)\s*\(.*\).*
     |from\s+[\w.]+\s+import\s+.*$
     |import\s+[\w.$]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.$]+)*\s*$
     |import\s+.*\bfrom\s*['"].*$
     |@\w+\(.*\)\s*$
     |[)\]}]+[;,]?\s*$
    )""",
    regex.VERBOSE,
)
# fixed values: notices of licences, which document no function
_NOTICE = regex.compile(r"\(c\)|©|\bcopyright\b|all rights reserved|spdx-license", regex.IGNORECASE)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’‑-]\p{L}[\p{L}\p{M}]*)*")
_CAMEL = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{L}+")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*(?:todo|fixme|xxx|tbd)\b)", regex.IGNORECASE)


def _stems(word: str) -> set[str]:
    word = word.casefold()
    return {word, word.removesuffix("s"), word.removesuffix("es"), word.removesuffix("ies") + "y", word.removesuffix("ing"), word.removesuffix("ed"), word.removesuffix("d")}


def plain_comment(comment: str) -> str:
    """Text of a comment without its marks, rules, directives and disabled code, line by line."""
    lines = []
    for line in _MARKS.sub("", comment).splitlines():
        if _DIRECTIVE.match(line) or not _WORD.search(line) or _CODE.match(line):
            continue
        lines.append(line.strip())
    return "\n".join(lines)


def plain_docstring(docstring: str) -> str:
    """Text of a docstring literal, without quotes, rules and directives."""
    m = _QUOTES.match(docstring)
    lines = [x.strip() for x in (m[2] if m else docstring).splitlines()]
    return "\n".join(x for x in lines if _WORD.search(x) and not _DIRECTIVE.match(x))


def prose_words(text: str, name: str) -> int:
    """Words of prose in ``text`` (marks removed): no tags and names of tags, no placeholders, no notices of
    licences, no words of ``name``."""
    kept = []
    for sentence in _SENTENCE.split(text):
        if not _PLACEHOLDER.match(sentence):
            kept.append(sentence)
    own: set[str] = set()
    for part in _CAMEL.findall(name or ""):
        own |= _stems(part)
    if name:
        own |= _stems(name)
    n = 0
    for line in "\n".join(kept).splitlines():
        if _SECTION.match(line) or _PLACEHOLDER.match(line) or _NOTICE.search(line):
            continue
        line = _FIELD.sub("", _TAG.sub("", line)) if _TAG.match(line) or _FIELD.match(line) else line
        for word in _WORD.findall(line):
            parts = _CAMEL.findall(word) or [word]
            if not (_stems(word) & own or all(_stems(p) & own for p in parts)):
                n += 1
    return n


def _python_functions(text: str) -> Iterator[tuple[int, int, int, str, str | None, str | None, int]]:
    """(start, start with decorators, end of the head, name, comment, docstring, end of the body) of each function."""
    masked = Masked(text, True)
    inside: list[tuple[int, int]] = []  # outermost brackets: line breaks in them end no line
    for start in sorted(masked.partner):
        if not inside or start > inside[-1][1]:
            inside.append((start, masked.partner[start]))
    parts, at = [], 0
    for start, end in inside:
        parts += (masked.code[at:start], masked.code[start:end].replace("\n", " "))
        at = end
    code = "".join([*parts, masked.code[at:]])
    lines = [0, *[m.end() for m in regex.finditer("\n", code)]]
    bare = [line.strip() for line in code.split("\n")]
    depth = [len(line) - len(line.lstrip(" \t")) for line in code.split("\n")]
    alone = set()  # lines that hold nothing but a comment
    for start, _ in masked.comments:
        i = bisect_right(lines, start) - 1
        if not bare[i]:
            alone.add(i)
    # the first line behind each that isn't deeper
    behind, stack = [len(lines)] * len(lines), []
    for i, line in enumerate(bare):
        if line:
            while stack and depth[i] <= depth[stack[-1]]:
                behind[stack.pop()] = i
            stack.append(i)
    pattern = _patterns()[0]
    for i, line in enumerate(bare):
        if not (line.startswith("def ") or line.startswith("async ") or line.startswith("def\t")) or not (m := pattern.match(code, lines[i])):
            continue
        top = i
        while top and bare[top - 1].startswith("@"):
            top -= 1
        first = top
        while first and first - 1 in alone:
            first -= 1
        comment = text[lines[first] : lines[top]] if first < top else None
        doc = None
        begin = m.end()
        if code[begin - 1] == ":":
            while begin < len(code) and code[begin] in " \t\r\n":
                begin += 1
            if begin in masked.strings and regex.match(r"[rRuU]?[\"\']", text[begin : begin + 2]):
                end = masked.strings[begin]
                if regex.compile(r"[ \t\r]*+(?:[;\n]|\Z)").match(code, end):
                    doc = text[begin:end]
        last = behind[i] - 1
        while last > i and not bare[last]:
            last -= 1
        end = lines[last + 1] - 1 if last + 1 < len(lines) else len(code)
        yield m.start("signature"), lines[top], m.end("signature"), m["name"], comment, doc, end


def _script_functions(text: str) -> Iterator[tuple[int, int, int, str, str | None, str | None, int]]:
    """The same of each function of a script that has a comment on the line above."""
    masked = Masked(text, False)
    code, comments = masked.code, masked.comments
    pattern = _patterns()[1]
    found = []
    k = 0
    while k < len(comments):
        start, end = comments[k]
        k += 1
        if code[code.rfind("\n", 0, start) + 1 : start].strip(" \t"):
            continue
        while text.startswith("//", start) and k < len(comments) and text.startswith("//", comments[k][0]) and not text[end : comments[k][0]].strip() and text.count("\n", end, comments[k][0]) == 1:
            end = comments[k][1]
            k += 1
        line = text.find("\n", end)
        if line < 0 or text[end:line].strip() or not (m := pattern.match(code, line + 1)):
            continue
        body = m.end()
        while body < len(code) and code[body].isspace():
            body += 1
        head = m.start("signature")
        found.append((start, head - code.rfind("\n", 0, head), head, m.start("decorators") if m["decorators"] else head, m.end("signature"), m["name"] or "", text[start:end], body))
    later: list[tuple[int, int]] = []  # (comment, depth) of the functions behind, each less deep than the one before it
    out = []
    for start, depth, head, top, signed, name, comment, body in reversed(found):
        while later and later[-1][1] > depth:
            later.pop()
        if text[body : body + 1] == "{":
            # an open body goes on to the next documented function that isn't deeper, or to the end
            stop = masked.partner[body] + 1 if body in masked.partner else later[-1][0] if later else len(text)
        else:
            stop = text.find("\n", body)
            stop = len(text) if stop < 0 else stop
        out.append((head, top, signed, name, comment, None, stop))
        later.append((start, depth))
    yield from reversed(out)


def documented(text: str, language: str) -> Iterator[tuple[int, str, str, str, str, bool]]:
    """(line, name, signature, description, code, trivial) of each function in ``text`` that has a comment or docstring."""
    line, at = 1, 0
    for start, top, head, name, comment, docstring, stop in _python_functions(text) if language == "python" else _script_functions(text):
        if not (comment or docstring):
            continue
        line += text.count("\n", at, start)
        at = start
        found = []
        if docstring:
            found.append(plain_docstring(docstring))
        if comment:
            found.append(plain_comment(comment))
        words = [prose_words(x, name) for x in found]
        best = max(range(len(found)), key=lambda i: (words[i] >= LEAST_WORDS, -i))
        yield line, name, text[top:head].strip(), found[best], text[top:stop], words[best] < LEAST_WORDS


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for repo, path, ext, source in zip(batch["repository_id"], batch["file_path"], batch["ext"], batch["source"]):
            if source:
                rows.extend((repo, path, *found) for found in documented(source, EXTENSIONS[ext]))
        yield pd.DataFrame(rows, columns=columns)


def documented_functions(files: DataFrame, keep_trivial: bool = False) -> DataFrame:
    """Pairs of code and description for each documented function of the source files.

    ``files`` needs repository_id, file_path, source; other columns are ignored. One row per function and delivered row of its
    file: repository_id, file_path, start_line (of the ``def``, ``function`` or name, from 1), name, signature, description
    (marks removed; the docstring where it isn't trivial, else the comment above), code (whole, with decorators), trivial.
    Rows with trivial documentation are left out unless ``keep_trivial``.

    Defined cases: null or empty source has no functions; files of other extensions or with a null path are skipped; texts of
    any length are read whole; text that doesn't parse still yields the functions whose heads can be read.
    """
    scan = files.where(is_source(F.col("file_path")) & (F.length("source") > 0)).select(
        "repository_id", "file_path", extension(F.col("file_path")).alias("ext"), "source"
    )
    found = spread(scan).mapInPandas(_extract, SCHEMA)
    return found if keep_trivial else found.where(~F.col("trivial"))


def documented_rows(nodes: DataFrame) -> DataFrame:
    """Ids of Function and Method rows of ``nodes`` with non-trivial documentation in the text of their File row, once each.

    A row belongs to the found function that has its repository_id, file_path, start_line and name. Rows without a File row,
    or with null in one of these columns, have no documentation.
    """
    files = nodes.where(F.col("type") == "File").select("repository_id", "file_path", "source")
    pairs = documented_functions(files).select("repository_id", "file_path", "start_line", "name")
    symbols = nodes.where(F.col("type").isin("Function", "Method")).select("id", "repository_id", "file_path", "start_line", "name")
    return symbols.join(pairs, ["repository_id", "file_path", "start_line", "name"], "left_semi").select("id").distinct()
