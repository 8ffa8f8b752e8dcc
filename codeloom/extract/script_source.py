"""Extraction from JavaScript and TypeScript files by a tolerant scan of tokens and brackets."""

from __future__ import annotations

import re

from .records import DOTTED, NAME, FileRecord

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<str>"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')|(?P<tick>`)|(?P<num>\d[\w.]*+)|(?P<id>[#@]?[A-Za-z_$\u0080-￿][\w$]*+)|(?P<p>=>|\?\.|\.\.\.|[=!<>]==?|&&|\|\||\?\?|\+\+|--|[{}()\[\];,.:?=<>+\-*/%&|^!~@\#])"""
)
_PIECE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+")
_NOT_CALLED = frozenset("if for while switch catch function return typeof await new delete void in of else do case throw yield instanceof import super class extends default export async".split())
_MODIFIERS = frozenset("public private protected static async readonly override abstract declare get set accessor".split())
_BEFORE_VALUE = frozenset(("(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "??", "+", "-", "*", "%", "<", ">", "==", "===", "!=", "!==", "...", "^", "~"))
# fixed values: calls that declare a route, files that are routes, and verbs
_VERB = re.compile(r"[\w.]+\.(get|post|put|patch|delete|use|all)\Z")
_ROUTE_FILES = ("route.ts", "route.tsx")
_HTTP = frozenset("GET POST PUT PATCH DELETE HEAD OPTIONS".split())
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_OPENS = {close: open_ for open_, close in _CLOSES.items()}


class _Scan:
    def __init__(self, record: FileRecord, typed: bool):
        self.record, self.text, self.typed = record, record.text, typed
        self.kind: list[str] = []
        self.word: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.pieces: set[int] = set()  # tokens that carry a template on
        self.comments: dict[int, str] = {}  # index of the token behind -> last comment before it
        self.lines = [0, *[m.end() for m in re.finditer("\n", self.text)]]
        self.tokenise()
        self.pair_up()

    def tokenise(self) -> None:
        """Tokens of the text. A template is a string token for each piece of its text, and brackets around the code between them."""
        text, at, n, before = self.text, 0, len(self.text), ""
        braces: list[bool] = []  # open braces: whether code in a template ends with it
        while at < n:
            if text[at] == "/" and (not before or before in _BEFORE_VALUE or before in ("return", "typeof", "case")) and (m := _REGEX.match(text, at)):
                self.add("re", m[0], at, m.end())
                at, before = m.end(), "re"
                continue
            m = _TOKEN.search(text, at)
            if not m:
                break
            if m[0][0] == "/" and m.lastgroup == "p" and m.start() != at:
                at = m.start()
                continue
            if m.lastgroup == "comment":
                self.comments[len(self.word)] = m[0]
            elif m.lastgroup == "tick" or m[0] == "}" and braces and braces[-1]:
                if m[0] == "}":
                    braces.pop()
                    self.add("p", ")", m.start(), m.end())
                    self.pieces.add(len(self.word))
                if piece := _PIECE.match(text, m.end()):
                    self.add("str", "`" + piece[0], m.end() if m[0] == "}" else m.start(), piece.end())
                    at, before = piece.end(), "str"
                    if piece[0].endswith("${"):
                        braces.append(True)
                        self.add("p", "(", at - 1, at)
                        before = "("
                    continue
                self.pieces.discard(len(self.word))
            else:
                if m.lastgroup == "p" and m[0] in "{}":
                    braces.append(False) if m[0] == "{" else braces and braces.pop()
                self.add(m.lastgroup, m[0], m.start(), m.end())
                before = m[0] if m.lastgroup in ("p", "id") else m.lastgroup
            at = m.end()

    def add(self, kind: str, word: str, at: int, end: int) -> None:
        self.kind.append(kind)
        self.word.append(word)
        self.at.append(at)
        self.end.append(end)

    def pair_up(self) -> None:
        """Index of the bracket that closes each bracket, and back; unclosed ones close at the end. Angle brackets pair within the
        brackets and the statement they stand in."""
        self.angle: dict[int, int] = {}
        waiting = dict.fromkeys("([{", 0)
        angles: list[list[int]] = [[]]
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        stack: list[int] = []
        for i, (k, w) in enumerate(zip(self.kind, self.word)):
            if k != "p":
                continue
            if w in "([{" and len(w) == 1:
                stack.append(i)
                waiting[w] += 1
                angles.append([])
            elif w in ")]}" and len(w) == 1:
                if not waiting[_OPENS[w]]:
                    continue  # nothing for it to close
                while stack:
                    j = stack.pop()
                    angles.pop()
                    waiting[self.word[j]] -= 1
                    self.close[j] = i
                    if _CLOSES[self.word[j]] == w:
                        self.open[i] = j
                        break
            elif w == "<":
                angles[-1].append(i)
            elif w == ">":
                if angles[-1]:
                    self.angle[angles[-1].pop()] = i
            elif w == ";":
                angles[-1].clear()
        self.broken = bool(stack)
        for j in stack:
            self.close[j] = len(self.word)

    def line(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.lines, offset)

    def is_(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.word) and self.word[i] in words and self.kind[i] in ("p", "id")

    def slice(self, i: int, j: int) -> str:
        """Text of tokens i to j, the last one excluded."""
        return self.text[self.at[i] : self.end[min(j, len(self.end)) - 1]] if i < j and i < len(self.at) else ""

    def skip_angle(self, i: int) -> int:
        """Behind type parameters or arguments that open at i."""
        return self.angle.get(i, i - 1) + 1 if self.is_(i, "<") else i

    def skip_type(self, i: int, stops: tuple[str, ...]) -> int:
        """First token behind the type that begins at i, at one of ``stops`` outside brackets."""
        fresh = True
        while i < len(self.word):
            w = self.word[i]
            if self.kind[i] == "p":
                if w in stops and not (w == "{" and fresh) and not (w == "=>" and "=>" not in stops):
                    return i
                if w in "([{" and len(w) == 1:
                    i = self.close.get(i, len(self.word)) + 1
                    fresh = False
                    continue
                if w == "<":
                    j = self.skip_angle(i)
                    i = j if j > i else i + 1
                    fresh = False
                    continue
                if w in (")", "]", "}", ";"):
                    return i
                fresh = w in ("|", "&", "=>", ":", "?", ".")
            else:
                fresh = w in ("keyof", "typeof", "readonly", "extends", "is")
            i += 1
        return i

    def chain(self, i: int) -> int:
        """First token of the member chain that ends at token i."""
        while True:
            while i in self.pieces:  # back to the head of a template
                i = self.open[i - 1] - 1 if i - 1 in self.open else i - 2
            if self.word[i] in (")", "]") and self.kind[i] == "p" and i in self.open:
                o = self.open[i]
                if o > 0 and (self.kind[o - 1] == "id" and self.word[o - 1] not in _NOT_CALLED or self.word[o - 1] in (")", "]")):
                    i = o - 1
                    continue
                return o
            if self.is_(i - 1, ".", "?.") and i >= 2:
                i -= 2
                continue
            return i

    def statement_end(self, i: int, stop: int) -> int:
        """Behind the expression that begins at i."""
        while i < stop:
            w = self.word[i]
            if self.kind[i] == "p":
                if w in "([{" and len(w) == 1:
                    i = min(self.close.get(i, stop), stop) + 1
                    continue
                if w in (",", ";", ")", "]", "}"):
                    return i
            if i + 1 < stop and self.line(self.at[i + 1]) > self.line(self.end[i]) and w not in _BEFORE_VALUE and not self.is_(i + 1, ".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "=>", "(", "["):
                return i + 1
            i += 1
        return i

    def params(self, i: int, dotted: str) -> None:
        """Names and annotations of the parameters in the brackets at i."""
        stop, j = self.close.get(i, len(self.word)), i + 1
        while j < stop:
            while self.is_(j, "...") or (self.kind[j] == "id" and self.word[j] in _MODIFIERS and self.kind[j + 1 : j + 2] == ["id"]):
                j += 1
            if j < stop and self.kind[j] == "id":
                name = self.word[j]
                if NAME.match(name):
                    self.record.shadowed.add(f"{dotted}:{name}")
                k = j + 1 + self.is_(j + 1, "?")
                if self.is_(k, ":"):
                    e = self.skip_type(k + 1, (",", "=", ")"))
                    note = self.slice(k + 1, min(e, stop)).strip()
                    if DOTTED.match(note):
                        self.record.bindings[f"{dotted}:{name}"] = note
            depth_end = j
            while depth_end < stop and not self.is_(depth_end, ","):
                if self.kind[depth_end] == "p" and self.word[depth_end] in "([{" and len(self.word[depth_end]) == 1:
                    depth_end = min(self.close.get(depth_end, stop), stop)
                elif self.is_(depth_end, "<") and self.skip_angle(depth_end) > depth_end:
                    depth_end = self.skip_angle(depth_end) - 1
                depth_end += 1
            j = depth_end + 1

    def function(self, start: int, name: str, paren: int, ctx: tuple, *, doc: str = "", exported: bool = False, decorators: str = "") -> int:
        """A function whose parameters open at ``paren`` (or are the one name there); returns the token behind it."""
        owner, owner_kind, scope, class_name = ctx
        single = not self.is_(paren, "(")
        after = paren + 1 if single else self.close.get(paren, len(self.word)) + 1
        returns = ""
        if self.is_(after, ":"):
            e = self.skip_type(after + 1, ("{", "=>", ";"))
            returns = self.slice(after + 1, e).strip()
            after = e
        arrow = self.is_(after, "=>")
        body = after + arrow
        if self.is_(body, "{"):
            stop = self.close.get(body, len(self.word))
            behind = stop + 1
        elif arrow:
            stop = behind = self.statement_end(body, len(self.word))
        else:
            stop = behind = body  # a signature without a body
        last = max(start, min(behind, len(self.word)) - 1)
        first_at, last_at = self.at[start], self.end[last]
        if not name:
            line = self.line(first_at)
            name = f"callback@{line}:{len(self.text[self.lines[line - 1] : first_at].encode())}"
        kind = "Method" if owner_kind in ("Class", "Interface") else "Function"
        body_at = self.at[body] if body < len(self.at) and body < behind else last_at
        source = self.text[first_at:last_at]
        key, dotted = self.record.symbol(
            kind, scope, name, self.line(first_at), self.line(last_at), source, self.text[first_at:body_at] if body_at > first_at else source[:250], at=first_at, docstring=doc, parameters=self.slice(paren, paren + 1 if single else after if not returns else self.close.get(paren, paren) + 1).strip() if not single else "", returns=returns, exported=exported, owner=owner
        )
        if single:
            self.record.shadowed.add(f"{dotted}:{self.word[paren]}")
        else:
            self.params(paren, dotted)
            self.scan(paren + 1, self.close.get(paren, len(self.word)), (key, kind, dotted, class_name), values=True)
        if decorators:
            self.record.decorated(decorators, key, dotted, kind, class_name, self.line(first_at), self.line(first_at))
        if self.record.language == "TypeScript" and self.record.path.rsplit("/", 1)[-1] in _ROUTE_FILES and name in _HTTP and owner_kind == "File":
            parts = self.record.path.split("/")[1:-1]
            self.record.endpoint(name, "/" + "/".join(p for p in parts if not p.startswith("(")), key, self.line(first_at), self.line(last_at), self.text[first_at:body_at].strip())
        inner = (key, kind, dotted, class_name)
        if self.is_(body, "{"):
            self.scan(body + 1, stop, inner)
        elif arrow:
            self.scan(body, stop, inner, values=True)
        return behind

    def klass(self, start: int, i: int, ctx: tuple, name: str, *, doc: str = "", exported: bool = False, decorators: str = "") -> int:
        """A class or interface whose keyword stands at i; returns the token behind it."""
        owner, _, scope, class_name = ctx
        interface = self.word[i] == "interface"
        j = i + 1
        if j < len(self.word) and self.kind[j] == "id" and self.word[j] not in ("extends", "implements"):
            name = self.word[j]
            j = self.skip_angle(j + 1)
        names: dict[str, list[str]] = {"extends": [], "implements": []}
        part = ""
        while j < len(self.word) and not self.is_(j, "{"):
            if self.word[j] in names and self.kind[j] == "id":
                part = self.word[j]
            elif part and self.kind[j] == "id" and not self.is_(j - 1, "."):
                k = j
                while self.is_(k + 1, "."):
                    k += 2
                names[part].append(self.slice(j, k + 1))
                j = k
            if self.is_(j, ";"):
                return j
            j += 1
        if not name or j >= len(self.word):
            return i + 1
        stop = self.close.get(j, len(self.word))
        last_at = self.end[min(stop, len(self.word) - 1)]
        first_at = self.at[start]
        key, dotted = self.record.symbol("Interface" if interface else "Class", scope, name, self.line(first_at), self.line(last_at), self.text[first_at:last_at], self.text[first_at : self.at[j]], at=first_at, docstring=doc, exported=exported, owner=owner)
        self.record.bases(key, names["extends"], names["implements"], self.line(first_at), scope)
        if decorators:
            self.record.decorated(decorators, key, dotted, "Class", class_name, self.line(first_at), self.line(first_at))
        self.members(j + 1, stop, (key, "Interface" if interface else "Class", dotted, dotted if not interface else class_name))
        return stop + 1

    def members(self, i: int, stop: int, ctx: tuple) -> None:
        owner, kind, scope, _ = ctx
        while i < stop:
            doc = self.comments.get(i, "")
            decorators = ""
            while i < stop and self.kind[i] == "id" and self.word[i].startswith("@"):
                a = i
                while self.is_(i + 1, "."):
                    i += 2
                if self.is_(i + 1, "("):
                    i = self.close.get(i + 1, stop)
                    self.scan(a, i + 1, ctx, values=True)
                decorators += self.slice(a, i + 1) + "\n"
                i += 1
            start = i
            while i < stop and self.word[i] in _MODIFIERS and not self.is_(i + 1, "(", "=", ";", ":", "?", "<", "}"):
                i += 1
            if self.is_(i, "*"):
                i += 1
            if i >= stop:
                return
            if self.kind[i] == "p" and self.word[i] == "[":
                name, j = "", self.close.get(i, stop) + 1
            elif self.kind[i] in ("id", "str", "num"):
                name, j = self.word[i].strip("\"'"), i + 1
            elif self.is_(i, "{"):
                self.scan(i + 1, self.close.get(i, stop), ctx)
                i = self.close.get(i, stop) + 1
                continue
            else:
                i += 1
                continue
            j += self.is_(j, "?", "!")
            j = self.skip_angle(j)
            if self.is_(j, "("):
                i = max(j + 1, self.function(start, name, j, ctx, doc=doc, decorators=decorators) if name else self.close.get(j, stop) + 1)
                continue
            if self.is_(j, ":"):
                j = self.skip_type(j + 1, ("=", ";", ",")) if kind == "Class" else self.member_end(j + 1, stop)
            if self.is_(j, "="):
                if (made := self.value_function(j + 1, name, ctx)) is not None:
                    self.record.assign(scope, name, None, function=True)
                    i = made
                    continue
                e = self.statement_end(j + 1, stop)
                self.record.assign(scope, name, self.called(j + 1, e))
                self.scan(j + 1, e, ctx, values=True)
                j = e
            elif kind == "Class" and name and j < stop and self.is_(j, ";"):
                self.record.assign(scope, name, None)
            i = max(j, i + 1)

    def member_end(self, i: int, stop: int) -> int:
        while i < stop and not self.is_(i, ";", ","):
            if self.kind[i] == "p" and self.word[i] in "([{" and len(self.word[i]) == 1:
                i = min(self.close.get(i, stop), stop)
            if i + 1 < stop and self.line(self.at[i + 1]) > self.line(self.end[min(i, len(self.end) - 1)]) and not self.is_(i, "|", "&", "=>") and not self.is_(i + 1, "|", "&"):
                return i + 1
            i += 1
        return i

    def value_function(self, i: int, name: str, ctx: tuple) -> int | None:
        """If a function or class expression stands at i, take it; returns the token behind it, else None."""
        start = i
        if self.is_(i, "async") and not self.is_(i + 1, "(") or self.is_(i, "async") and self.is_(i + 1, "(") and self.is_(self.close.get(i + 1, 0) + 1, "=>", ":"):
            i += 1
        if self.is_(i, "function"):
            j = i + 1 + self.is_(i + 1, "*")
            if j < len(self.word) and self.kind[j] == "id":
                name = self.word[j]
                j += 1
            j = self.skip_angle(j)
            return self.function(start, name, j, ctx) if self.is_(j, "(") else None
        if self.is_(i, "class"):
            return self.klass(start, i, ctx, name) if name or self.kind[i + 1 : i + 2] == ["id"] else None
        j = self.skip_angle(i) if self.typed and self.is_(i, "<") else i
        if self.is_(j, "("):
            after = self.close.get(j, len(self.word)) + 1
            if self.typed and self.is_(after, ":"):
                e = self.skip_type(after + 1, ("=>", ";", ",", ")", "{"))
                after = e if self.is_(e, "=>") else after
            return self.function(start, name, j, ctx) if self.is_(after, "=>") else None
        if j < len(self.word) and self.kind[j] == "id" and self.is_(j + 1, "=>"):
            return self.function(start, name, j, ctx)
        return None

    def called(self, i: int, e: int) -> str | None:
        """Name of what is called or constructed, if the value from i to e is one call."""
        i += self.is_(i, "await")
        i += self.is_(i, "new")
        if i < e and self.kind[i] == "id" and self.word[i] not in _NOT_CALLED:
            j = i
            while self.is_(j + 1, ".") and j + 2 < e:
                j += 2
            k = self.skip_angle(j + 1)
            if self.is_(k, "(") and self.close.get(k, e) + 1 >= e:
                return self.slice(i, j + 1)
        return None

    def scan(self, i: int, stop: int, ctx: tuple, values: bool = False) -> None:
        """Statements or expressions between two tokens."""
        record = self.record
        owner, owner_kind, scope, class_name = ctx
        decorators = ""
        first = i
        while i < stop:
            k, w = self.kind[i], self.word[i]
            before = self.word[i - 1] if i else ""
            member = before in (".", "?.")
            if k == "id" and w.startswith("@") and not member:
                a = i
                while self.is_(i + 1, "."):
                    i += 2
                if self.is_(i + 1, "("):
                    i = self.close.get(i + 1, stop)
                decorators += self.slice(a, i + 1) + "\n"
                i += 1
                continue
            if k == "id" and not member:
                exported = before == "export" or (before == "default" and self.is_(i - 2, "export"))
                begin = i
                if w in ("async", "abstract", "declare") and self.is_(i + 1, "function", "class", "interface"):
                    i += 1
                    w = self.word[i]
                doc = "" if exported else self.comments.get(begin, "")
                if w == "function" and self.kind[i + 1 : i + 2] == ["id"] and (before in ("", ";", "}", "{", "export", "default", ")") or self.kind[begin - 1] != "p" or self.comments.get(begin) or self.line(self.at[begin]) > self.line(self.end[begin - 1])):
                    j = self.skip_angle(i + 2)
                    if self.is_(j, "("):
                        i = self.function(begin, self.word[i + 1], j, ctx, doc=doc, exported=exported, decorators=decorators)
                        decorators = ""
                        continue
                if w in ("class", "interface") and (self.kind[i + 1 : i + 2] == ["id"] or exported) and not self.is_(i + 1, "="):
                    i = max(i + 1, self.klass(begin, i, ctx, "", doc=doc, exported=exported, decorators=decorators))
                    decorators = ""
                    continue
                if w in ("const", "let", "var") and self.kind[i + 1 : i + 2] == ["id"]:
                    i = self.declarators(i + 1, stop, ctx)
                    continue
                if w in ("type", "import") and not values and i + 1 < stop and (w == "import" or self.is_(i + 2, "=", "<")):
                    i = self.statement_end(i + 1, stop) if w == "type" else self.statement_end(i + 1, stop)
                    continue
            here = None
            if not member and (k == "id" and (w in ("function", "class") or self.is_(i + 1, "=>") or w == "async") or w in ("(", "<") and (i == first or before in _BEFORE_VALUE or before in ("return", "await", "yield", "default", "async") or self.kind[i - 1] != "id")):
                name = self.word[i - 2].strip("\"'") if before == ":" and i >= 2 and self.kind[i - 2] in ("id", "str") and self.is_(i - 3, "{", ",") else ""
                if w != "(" or before not in (")", "]"):
                    here = self.value_function(i, name, ctx)
            if here is not None and here > i:
                i = here
                continue
            if k == "id" and not member and self.is_(i - 1, "{", ",", "get", "set", "async", "*") and w not in _NOT_CALLED and self.is_(i + 1, "(") and self.is_(self.close.get(i + 1, 0) + 1, "{", ":") and not (self.is_(i - 1, "{") and not values and owner_kind == "File" and scope == "" and False):
                j = self.close.get(i + 1, 0) + 1
                if self.is_(j, "{") or self.is_(self.skip_type(j + 1, ("{", ";", ",")), "{"):
                    i = self.function(i, w, i + 1, ctx)
                    continue
            if w == "(" and k == "p" and i > 0 and (self.kind[i - 1] == "id" and before not in _NOT_CALLED or before in (")", "]", ">")):
                self.call_at(i, ctx)
            i += 1

    def declarators(self, i: int, stop: int, ctx: tuple) -> int:
        """Names, types and values of a declaration; returns the token behind it."""
        while i < stop and self.kind[i] == "id":
            name, j = self.word[i], i + 1
            j += self.is_(j, "!")
            if self.is_(j, ":"):
                j = self.skip_type(j + 1, ("=", ";", ",", ")"))
            if not self.is_(j, "="):
                self.record.assign(ctx[2], name, None)
                return j
            if self.is_(j + 1, "require") and self.is_(j + 2, "(") and self.kind[j + 3 : j + 4] == ["str"]:
                self.record.imports[name] = (self.word[j + 3][1:-1], "*", self.line(self.at[i]))
            made = self.value_function(j + 1, name, ctx)
            if made is not None:
                self.record.assign(ctx[2], name, None, function=True)
                j = made
            else:
                e = self.statement_end(j + 1, stop)
                self.record.assign(ctx[2], name, self.called(j + 1, e))
                self.scan(j + 1, e, ctx, values=True)
                j = e
            if not self.is_(j, ","):
                return j
            i = j + 1
        return i

    def call_at(self, i: int, ctx: tuple) -> None:
        """The call whose arguments open at i."""
        owner, _, scope, _ = ctx
        last = i - 1
        if self.word[last] == ">":  # type arguments
            depth = 0
            while last > 0:
                depth += (self.word[last] == ">") - (self.word[last] == "<")
                last -= 1
                if not depth:
                    break
            if self.kind[last] != "id":
                return
        a = self.chain(last)
        target = self.slice(a, last + 1)
        if not target or self.word[a] in _NOT_CALLED and self.word[a] != "super":
            return
        stop = self.close.get(i, len(self.word))
        line = self.line(self.at[a])
        self.record.call(owner, target, line, scope, self.slice(i, stop + 1))
        m = _VERB.match(target)
        if not m:
            return
        receiver = target.rsplit(".", 1)[0]
        made = self.record.bindings.get(f":{receiver}", "").split(".")[0]
        if self.record.imports.get(made, ("",))[0] == "express" and self.kind[i + 1 : i + 2] == ["str"] and self.is_(i + 2, ","):
            b = stop - 1
            if self.kind[b] == "id":
                handler = self.slice(self.chain(b), b + 1)
            else:
                b = i + 3
                j = b
                while j < stop:  # the last argument
                    if self.is_(j, ","):
                        b = j + 1
                    if self.kind[j] == "p" and self.word[j] in "([{" and len(self.word[j]) == 1:
                        j = self.close.get(j, stop)
                    j += 1
                n = self.line(self.at[b])
                handler = f"callback@{n}:{len(self.text[self.lines[n - 1] : self.at[b]].encode())}"
            self.record.endpoint(m[1], self.word[i + 1][1:-1], handler, line, self.line(self.end[min(stop, len(self.end) - 1)]), self.slice(a, stop + 1))


_IMPORT = re.compile(r"(?m)^[ \t]*(import|export)\b((?:[^;'\"`=]|=(?=\s*require))*?)(?:\bfrom\s*)?['\"]([^'\"\n]+)['\"]")


def _imports(record: FileRecord) -> None:
    for m in _IMPORT.finditer(record.text):
        keyword, middle, module = m.groups()
        if "(" in middle and "require" not in middle or (keyword == "export" and not re.search(r"[{*]", middle)):
            continue
        line = record.text.count("\n", 0, m.start(1)) + 1
        names = re.search(r"\{([^}]*)\}", middle)
        default = re.match(r"\s*(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|$|from)", middle.rstrip() + " ") if keyword == "import" else None
        space = re.search(r"\*\s+as\s+([\w$]+)", middle)
        for part in names[1].split(",") if names else ():
            pair = re.split(r"\s+as\s+", part.strip().removeprefix("type "))
            if pair[0]:
                record.imports[pair[-1]] = (module, pair[0], line)
        if default and default[1] not in ("from", "type"):
            record.imports[default[1]] = (module, "default", line)
        elif space:
            record.imports[space[1]] = (module, "*", line)
        if not names and not default and not space and keyword == "import":
            record.imports[module] = (module, "*", line)


def extract(repository_id: str, path: str, text: str) -> FileRecord:
    """Everything a JavaScript or TypeScript file tells."""
    typed = path.endswith((".ts", ".tsx"))
    record = FileRecord(repository_id, path, text, "TypeScript" if typed else "JavaScript")
    _imports(record)
    scan = _Scan(record, typed)
    if scan.broken or len(scan.open) * 2 != sum(w in ("(", ")", "[", "]", "{", "}") for k, w in zip(scan.kind, scan.word) if k == "p"):
        record.warnings.append(f"{path}: syntax errors; only recognized syntax was extracted")
    try:
        scan.scan(0, len(scan.word), (record.id, "File", "", ""))
    except (RecursionError, IndexError):
        record.warnings.append(f"{path}: extraction is incomplete")
    return record
