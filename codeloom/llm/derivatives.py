"""Parsing with derivatives, memoised: grammars as interned expressions, each of which keeps its derivative by every token met.

A language is an expression over tokens: empty, epsilon, a token class, a rule, a sequence, a choice or a repetition. The
derivative of a language by a token is the language of what may follow that token. Reading a text means taking derivatives: an
empty derivative marks the exact token that cannot stand there; a last derivative that doesn't contain the empty string means
that the text ends too early. Expressions are interned, so equal ones are one object and a derivative is computed once for
all texts a process reads; after that, a token costs one dictionary look-up. Rules must not be left-recursive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Interned expressions of one grammar beyond which its memo is dropped and built anew.
MOST_NODES = 80_000


class Node:
    """An interned expression: ``d`` its derivatives by token, ``null`` whether it contains the empty string."""

    __slots__ = ("kind", "a", "b", "null", "d", "n")

    def __init__(self, kind: str, a, b, null: bool, n: int):
        self.kind, self.a, self.b, self.null, self.n = kind, a, b, null, n
        self.d: dict[str, Node] = {}


_LEX = re.compile(r"\s*(?:'([^']*)'|([A-Za-z_][A-Za-z_0-9]*)|([|*+?()]))")


def _parse_rules(text: str) -> dict[str, tuple]:
    """Rules written as ``name = expression``; a line that begins with blanks carries the expression on."""
    rules: dict[str, tuple] = {}
    for part in re.split(r"\n(?=\S)", re.sub(r"(?m)^\s*#.*\n?", "", text.strip("\n"))):
        if not part.strip():
            continue
        name, body = part.split("=", 1)
        tokens = []
        at = 0
        body = body.rstrip()
        while at < len(body):
            m = _LEX.match(body, at)
            if not m:
                raise ValueError(f"rule {name}: {body[at:]!r}")
            tokens.append(("tok", m[1]) if m[1] is not None else ("name", m[2]) if m[2] else ("op", m[3]))
            at = m.end()
        rules[name.strip()], rest = _choice(tokens, 0)
        if rest != len(tokens):
            raise ValueError(f"rule {name}: unbalanced")
    return rules


def _choice(tokens: list, at: int) -> tuple[tuple, int]:
    parts = []
    while True:
        items = []
        while at < len(tokens) and tokens[at] not in (("op", "|"), ("op", ")")):
            kind, value = tokens[at]
            if (kind, value) == ("op", "("):
                item, at = _choice(tokens, at + 1)
                if at >= len(tokens) or tokens[at] != ("op", ")"):
                    raise ValueError("a bracket isn't closed")
            else:
                item = (kind, value)
            at += 1
            while at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in "*+?":
                item = (tokens[at][1], item)
                at += 1
            items.append(item)
        parts.append(("seq", items))
        if at < len(tokens) and tokens[at] == ("op", "|"):
            at += 1
            continue
        return (parts[0] if len(parts) == 1 else ("alt", parts)), at


class Grammar:
    """A grammar ready to take derivatives. Upper-case names are token classes (``classes``) or plain tokens, names without a
    rule and without upper case stand for the empty language."""

    def __init__(self, rules: str, start: str, classes: dict[str, Iterable[str]]):
        self._rules = _parse_rules(rules)
        self._classes = {k: frozenset(v) for k, v in classes.items()}
        self._start = start
        self._nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for name, body in self._rules.items():
                if name not in self._nullable and self._null(body):
                    self._nullable.add(name)
                    grown = True
        self.reset()

    def _null(self, x: tuple) -> bool:
        kind, value = x
        if kind == "seq":
            return all(map(self._null, value))
        if kind == "alt":
            return any(map(self._null, value))
        if kind == "name":
            return value in self._nullable
        return kind in "*?" or (kind == "+" and self._null(value))

    def reset(self) -> None:
        """Forget all derivatives."""
        self._interned: dict[tuple, Node] = {}
        self._count = 0
        self.empty = self._node("empty", None, None, False)
        self.eps = self._node("eps", None, None, True)
        self._refs: dict[str, Node] = {}
        self.start = self._ref(self._start)

    def full(self) -> bool:
        """True if the memo should be dropped before the next text."""
        return self._count > MOST_NODES

    def _node(self, kind: str, a, b, null: bool) -> Node:
        key = (kind, a.n if isinstance(a, Node) else a, b.n if isinstance(b, Node) else b)
        node = self._interned.get(key)
        if node is None:
            node = self._interned[key] = Node(kind, a, b, null, self._count)
            self._count += 1
        return node

    def _ref(self, name: str) -> Node:
        if name not in self._rules:
            return self.empty
        return self._node("ref", name, None, name in self._nullable)

    def _build(self, x: tuple) -> Node:
        kind, value = x
        if kind == "tok":
            return self._node("tok", frozenset((value,)), None, False)
        if kind == "name":
            if value in self._classes:
                return self._node("tok", self._classes[value], None, False)
            if value.isupper():
                return self._node("tok", frozenset((value,)), None, False)
            return self._ref(value)
        if kind == "seq":
            out = self.eps
            for item in reversed(value):
                out = self.cat(self._build(item), out)
            return out
        if kind == "alt":
            return self.alt([self._build(item) for item in value])
        one = self._build(value)
        if one is self.empty:
            return self.empty if kind == "+" else self.eps
        if kind == "?":
            return self.alt([one, self.eps])
        star = self._node("star", one, None, True)
        return star if kind == "*" else self.cat(one, star)

    def cat(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == "cat":
            return self.cat(a.a, self.cat(a.b, b))
        return self._node("cat", a, b, a.null and b.null)

    def alt(self, nodes: list[Node]) -> Node:
        flat: dict[int, Node] = {}
        for x in nodes:
            if x.kind == "alt":
                for y in x.a:
                    flat[y.n] = y
            elif x is not self.empty:
                flat[x.n] = x
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        key = ("alt", tuple(sorted(flat)), None)
        node = self._interned.get(key)
        if node is None:
            node = self._interned[key] = Node("alt", tuple(flat[n] for n in key[1]), None, any(x.null for x in flat.values()), self._count)
            self._count += 1
        return node

    def step(self, node: Node, token: str) -> Node:
        """Derivative of ``node`` by ``token``."""
        found = node.d.get(token)
        if found is not None:
            return found
        kind = node.kind
        if kind == "cat":
            found = self.cat(self.step(node.a, token), node.b)
            if node.a.null:
                found = self.alt([found, self.step(node.b, token)])
        elif kind == "alt":
            found = self.alt([self.step(x, token) for x in node.a])
        elif kind == "tok":
            found = self.eps if token in node.a else self.empty
        elif kind == "ref":
            body = self._refs.get(node.a)
            if body is None:
                body = self._refs[node.a] = self._build(self._rules[node.a])
            found = self.step(body, token)
        elif kind == "star":
            found = self.cat(self.step(node.a, token), node)
        else:
            found = self.empty
        node.d[token] = found
        return found
