"""Syntax checks: valid and broken texts of each language, cuts at every place, and the operator on small tables."""

from __future__ import annotations

import ast
import random
import re
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import syntax_python, syntax_script
from codeloom.llm.derivatives import Grammar
from codeloom.llm.unparsable_files import check_files, failure, failure_rates, unparsable

PY = '''\
from __future__ import annotations
import os.path as p, sys
from . import (a, b as c,)

@dec(1)
async def f[T](a, /, b: int = 1, *args, c, **kw) -> dict[str, int]:
    """doc"""
    x: int = [i async for i in g() if i if not i]
    y = {**kw, 'a': 1}, {*args}, {k: v for k, v in kw}
    if (n := len(x)) > 1 and not y or x is not None: return await z
    elif x not in y:
        pass
    else:
        raise ValueError("a") from None
    with open(p) as h, (open(q)) as k: pass
    with (open(p) as h, open(q) as k,):
        yield from h
    try: pass
    except* (A, B) as e: pass
    else: x[1:2, ::3, ...] = 1
    finally: del x, y[0]
    return lambda a, *b, c=1: (yield)

match x:
    case [1, *rest] | {"a": -1, **kw} if rest:
        pass
    case P(a, b=Q.c) as d: pass
    case _: match = type = case = 1
type X[T] = list[T]
global_ = 0x1F + 1_000.5e3j if 1 else 0o17; print(f"{a!r:>{b}}" r'x'
  "y", *a, **b, k=1)
x = \\
  1
'''

JS = """\
#!/usr/bin/env node
import d, { a as b, default as e } from 'm';
import * as ns from "n"
export default async function* g({ a, b: [c = 1, ...r] }, ...rest) { yield* a; yield; await b }
const f = async (x, { y }) => ({ x, y, [z]: 1, get q() { return 1 }, async *m() {} })
let i = 0, re = /[/'"]\\/(?<n>x)/giu.test(s) ? a / b / c : `t${ `n${1}` }u`
for (let [k, v] of m) continue
for (var j in o) if (j) break; else { label: for (;;) { break label } }
do i++; while (i < 10)
switch (x) { case 1: case 2: { } default: y }
try { throw new Error`x` } catch { } finally { debugger }
class A extends (B, C) { #p = 1; static { this.#p } static async *[Symbol.x]() {} get a() { return this.#p } set a(v) {} 'q'() {} }
const { p, ...q } = o ?? {}, t = a?.b?.[c]?.(d) ** 2
if (a) /x/.test(b)
return_: x = typeof void 0 === 'undefined' ? new.target : import.meta
a
++b
var let_ = function () { return
  1 }
export { f as default, i }
export * as z from 'z'
!function(){}(), x = y => z => 1
"""

TS = """\
import type { A } from './a'
import fs = require('fs');
abstract class P<T extends object = {}> extends Q<T>['x'] implements R, S<T> {
  private readonly x?: number = 1; declare y: string; z!: T
  constructor(private a: string, public b?: number) { super() }
  abstract m<K extends keyof T>(k: K): T[K];
  get v(): string { return <string>this.a! }
  [key: string]: any
  @Dec() n(@Inject() a: any): asserts a is string {}
}
interface I extends J<K>, L { (a: number): void; new (b: string): I; readonly [k: string]: unknown; m?(): void, p: string
  q: number }
type U = | { [K in keyof T as `x${K}`]-?: T[K] } | [a: string, b?: number, ...c: any[]] | (new () => I) | typeof x.y | A extends infer B ? B[] : never
enum E { A = 1, B = 'b', C }
declare module 'm' { export const x: number; function f(a: string): void }
namespace N.M { export type T = 1 }
export function o(a: string): void
export function o(this: I, a: any = 1): a is string { return f<Map<string, Array<number>>>(a) as unknown as boolean satisfies boolean }
const g = async <T,>(x: T, y?: number): Promise<T> => x, h = a >> b >>> c, k = x < y
let u: unique symbol, w: import('x').Y<string>, z = (a) ? (b) : c => d
export = N
"""

TSX = """\
const v = <A.B c="d" e={f} {...g} h-i='j'>text {k && <l/>} don't {/* c */} <></> <m.n:o>{...p}</m.n:o></A.B>;
const G = <T,>(x: T) => <div>{x}</div>;
const w = a < b ? <b>1</b> : null;
"""


def broken(text, types=False, elements=False):
    return syntax_script.check(text, types, elements)


def test_valid_texts():
    ast.parse(PY)
    assert syntax_python.check(PY) is None and syntax_python.check(PY.replace("\n", "\r\n")) is None
    assert broken(JS) is None and broken(JS.replace("\n", "\r\n")) is None
    assert broken(TS, True) is None and broken(TSX, True, True) is None
    assert broken("const v = <a b='c'>d</a>", False, True) is None and broken(JS, True) is None


@pytest.mark.parametrize(
    "text",
    ["def f(:\n  pass", "x = [1, (2]\n", "if x\n  pass\n", "if x:\npass\n", "  x = 1\n", "print 'x'\n", "raise E, 'x'\n", "x = 'a\n", "x = “a”\n", "1x = 2\n", "<<<<<<< a\n",
     "x = 1\n   y = 2\n", "def f():\n    a\n  b\n", "a b\n", "x = 012\n", "class A\n  pass", ".a { b: c; }", "for x in y z: pass\n", "else: pass\n", "x = (1,\n", "def f():\n", '"""x', "f(**a b)\n", "f(a=1 b)\n"],
)
def test_broken_python(text):
    assert syntax_python.check(text)
    with pytest.raises(SyntaxError):
        ast.parse(text)


@pytest.mark.parametrize(
    "text",
    ["const a = [1, { b: 2 ];", "const a = 'x;\nb", "const 4x = 1;", "const a;", "<<<<<<< a\nx", "=======\n", "function f( {", "if (a { }", "a b", "export function f(a: string) {}", "const x = <a/>",
     "`${a`", "let x = /a", "return }", "class { a b }", "x = ;", "a.1", "for (let x of) {}", "import x", "interface A { b: string }\nc d", "<!DOCTYPE html>", "x = “a”", "def f(x):\n  return x", "/* a"],
)
def test_broken_javascript(text):
    assert broken(text)


@pytest.mark.parametrize("text", ["const a: = 1", "type A = ;", "let x: Map<string = 1", "interface A { b: ", "enum { A }", "const x = <a>1</a>", "function f(a: string, { }"])
def test_broken_typescript(text):
    assert broken(text, True)


@pytest.mark.parametrize("text", ["<a>", "x = <a></b>", "<a b=1/>", "<a>{1</a>", "<a>}</a>", "x = <a", "x = <a b='c"])
def test_broken_elements(text):
    assert broken(text, False, True) and broken(text, True, True)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, len(PY) - 1), st.integers(0, 12))
def test_python_against_exact_parser(at, n):
    """Texts with a piece cut out, or cut short, get the verdict of the exact parser (semantic errors aside)."""
    for text in (PY[:at] + PY[at + n :], PY[:at]):
        found = syntax_python.check(text)
        try:
            ast.parse(text)
            assert found is None
        except SyntaxError as e:
            if not any(x in str(e) for x in ("annot", "parameter", "positional", "argument", "default", "pattern", "target", "f-string", "must", "bytes", "deleted", "unpack", "multiple", "comma", "irrefutable", "single")):
                assert found is not None, (text, e)


def test_cut_scripts_are_truncated():
    for cut in ("function f() {", "const a = [1,", "x = `a ${b", "if (a) {\n  b()\n", "f(a, {\n"):
        assert broken(cut)[1] == "truncated" and broken(cut, True, True)[1] == "truncated"


def test_derivatives_are_memoised_and_bounded():
    g = Grammar("s = 'a' s 'b' | 'c'?", "s", {})
    state = g.start
    for token in "aaabbb":
        state = g.step(state, token)
    assert state.null
    assert g.step(g.start, "a") is g.step(g.start, "a") and g.step(g.step(g.start, "b"), "a") is g.empty
    before = g.start
    g.reset()
    assert g.start is not before


def test_deep_and_long_texts():
    assert broken("x = " + "[" * 300 + "]" * 300) is None
    assert broken("x = [" + "1, " * 200_000 + "]") is None
    assert syntax_python.check("x = [" + "1, " * 200_000 + "]\n") is None


def test_operator(spark):
    schema = "id string, repository_id string, file_path string, source string, language string, line string, parses string"
    rows = [
        ("a", "r", "a.py", "x = (", None, "l", "p"), ("a", "r", "a.py", "x = (", None, "l", "p"), ("b", "r", "b.PY", "x = 1", "JavaScript", "l", "p"), ("c", "r", "c.js", None, "", "l", "p"),
        ("d", "r", "d.ts", "", "", "l", "p"), ("e", None, "e.ts", "let a: string\n<<<<<<< x", "", "l", "p"), ("f", "r", None, "(", "", "l", "p"), ("g", "r", "g.json", "(", "", "l", "p"),
        (None, "r", "h.js", "(", "", "l", "p"), ("i", "r", "i.mjs", " \n", "", "l", "p"),
    ]
    files = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in unparsable(files).collect()) == ["a", "e"]
    assert {r.id: (r.line, r.failure) for r in check_files(files).where("not parses and id is not null").collect()} == {"a": (1, "truncated"), "e": (2, "conflict")}
    rates = {(r.repository_id, r.language): (r.n_files, r.n_unparsable, r.rate) for r in failure_rates(files).collect()}
    assert rates[("r", "python")] == (2, 1, 0.5) and rates[(None, "ts")] == (1, 1, 1.0) and rates[("r", "js")] == (3, 1, 0.333333)
    assert unparsable(files.limit(0)).count() == 0 and failure_rates(files.limit(0)).count() == 0
    assert failure("x = f'{f'{1}'}'\n", "py") is None


@pytest.mark.parametrize("text", ["def f(a=1, b): pass\n", "x = 1\nf(a=1, b)\n", "f() = 1\n", "1 += x\n", "for 1 in x: pass\n", "x = f'{a b}'\n", "if x:\n\ty\n        z\n", "f(**a, *b)\n", "lambda *, **k: 1\n", "del f()\n"])
def test_what_only_the_exact_parser_tells(text):
    with pytest.raises(SyntaxError):
        ast.parse(text)
    assert failure(text, "py") is not None


def test_limits_of_the_exact_parser_are_no_errors():
    assert failure("x = " + "(" * 250 + "1" + ")" * 250 + "\n", "py") is None
    assert failure("x = " + "9" * 5000 + "\n", "py") is None


@pytest.mark.parametrize("text", ["a + b = c", "!a = b", "a++ = b", "a ? b : c + d = e", "a || b = c", "x = a * b += 1", "typeof a = b", "(a, b + c = d)"])
def test_targets_of_assignments(text):
    assert [failure(text + ";\n", ext) for ext in ("js", "jsx", "ts", "tsx")].count(None) == 0


@pytest.mark.parametrize("text", ["a.b[c] = d += e", "[a, b] = c", "({ a, b } = c)", "new A().b = 1", "a = b ? c : d = e", "f(x => y = 1, a = b)", "a = b || (c = d)", "x = y => z = 1", "a ? b = 1 : c = 2", "const f = () => a = b", "for (i = 0, j = 1; i < 2; i += 1) a = i"])
def test_assignments(text):
    assert [failure(text + ";\n", ext) for ext in ("js", "jsx", "ts", "tsx")] == [None] * 4


def test_return_outside_functions():
    for text in ("return 1;\n", "if (a) { return }\n", "for (;;) return;\n", "try { a() } catch { return }\n", "switch (a) { case 1: return }\n", "l: return\n"):
        assert failure(text, "js") and failure(text, "jsx") and not failure(text, "ts")
        assert not failure("function f() { " + text + " }\n", "js") and not failure("x = { m() { " + text + " } }; class A { m() { " + text + "} }; (() => {" + text + "})()\n", "mjs")


# what the language allows and what it doesn't, one text a line; the exact parser says which is which
PYTHON_TEXTS = r"""
f() = 3
f"{x"
1 = 2
def f(a=1, b): pass
def f(a, /, b, *, c): pass
def f(*): pass
def f(*, **k): pass
def f(a=1, /, b=2): pass
lambda a=1, b: a
lambda *a, **k: 0
f(a=1, b)
f(**k, *a)
f(*a, b, c=1, *d, **e)
f(x for x in y, 1)
f(x := 1)
f(a.b := 1)
x := 1
for 1 in x: pass
for (x, *y) in z: pass
(x) += 1
(a, b) += 1
(a, *b), c = d
(x): int
a, b: int
del f()
del (a, b), c[0], d.e
with a as f(): pass
with (open(x) as f, y as z,): pass
[*a or b]
(*a)
{**a for a in b}
a + not b
[x for x in lambda: y]
print(f"{x!r:>{w}}")
f"{x = !r}"
f"{}"
f"{x!z}"
f"}"
f"{d["a"]}"
f"{x:=5}"
f"{lambda x: 1}"
f"\N{BULLET}{x:%H:%M}"
"C:\Users"
b"é"
"a" b"b"
if x:\n\ty\n        z
x²=1
None = 1
a < b = c
print "x"
try:\n a\nexcept A:\n b\nexcept* B:\n c
match x:\n case A(x=1, b): pass
"""


@pytest.mark.parametrize("text", [x.replace("\\n", "\n").replace("\\t", "\t") for x in PYTHON_TEXTS.strip().splitlines()])
def test_python_texts(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            valid = True
        except SyntaxError:
            valid = False
    assert (failure(text, "py") is None) == valid


def test_library_texts_damaged():
    """Modules of the standard library, whole and with a token taken out, doubled or put in, against the exact parser."""
    rnd = random.Random(3)
    for module in (ast, pytest, random, warnings):
        with open(module.__file__, encoding="utf-8") as file:
            text = file.read()
        tokens = list(re.finditer(r"\w+|[^\w\s]", text))
        for k in range(12):
            a, b = rnd.choice(tokens), rnd.choice(tokens)
            broken = [text, text[: a.start()] + text[a.end() :], text[: a.start()] + a[0] * 2 + text[a.end() :], text[: a.start()] + b[0] + " " + text[a.start() :]][k % 4]
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(broken)
                valid = True
            except SyntaxError:
                valid = False
            assert (failure(broken, "py") is None) == valid
