"""Pairs of functions and documentation."""

from __future__ import annotations

import time

import pytest

from codeloom.llm.documented_functions import documented, documented_functions, documented_rows

PY = '''\
def plain(a): return 1

# Keeps only the rows that the caller may see.
@cached(size="(")
@other
async def above(a, b={"x": ")"}) -> dict[str, int]:
    text = """
    # Looks like a comment but stands in a string.
    def inside(): pass
    """
    def nested(x):
        \'\'\'Rounds half up, as the ledger of the bank does.\'\'\'
        return x
    return 1

def opened(
    a,
):  # note
    # note

    r"""Reads every line once and forgets it."""
    pass

# Keeps only the rows that the caller may see.

def blank_between(): pass

def todo():
    """TODO: describe what this function does"""

def not_doc():
    "%s is what the caller gets back" % 1

# x = load(1)
# if x:
#     return 5
def disabled(): pass

def sort_all_rows(x):
    """Sort all the rows."""
'''

JS = """\
import a from 'b';
const t = `
/** Looks like a comment but stands in a template. */
function inside() {}
`;
/**
 * Reads every line once and forgets it.
 * @param {string} a
 */
export async function one(a, b = ")") {
  const r = /['"({]/.test(a);
  // Keeps only the rows that the caller may see.
  function nested() { return "}"; }
}
// Keeps only the rows
// that the caller may see.
export const two = async (x: number, y?: string): Promise<Map<string, number>> => {
  return `${x}}`;
};
class A {
  /** Rounds half up, as the ledger does. */
  @Get("/x")
  private async three<T>(a: T): { b: number } { return 1; }
  /** @param {string} a */
  four(a) { return 1; }
}
// eslint-disable-next-line no-unused-vars
function five() {}
/** Keeps only the rows that the caller may see. */
const six = x => x + 1;
/* Keeps only the rows that the caller may see. */

function seven() {}
// const a = load(1);
// if (!a) return null;
function eight() {}
"""


def names(text, language, trivial=False):
    return {f[1] for f in documented(text, language) if f[5] == trivial}


@pytest.mark.parametrize("text", [PY, PY.replace("\n", "\r\n")])
def test_python(text):
    assert names(text, "python") == {"above", "nested", "opened"}
    assert names(text, "python", True) == {"todo", "disabled", "sort_all_rows"}
    found = {f[1]: f for f in documented(text, "python")}
    assert [found[n][0] for n in ("above", "nested", "opened")] == [6, 11, 16]
    assert found["above"][4].startswith("@cached") and found["above"][4].rstrip().endswith("return 1")
    assert found["nested"][3] == "Rounds half up, as the ledger of the bank does."


@pytest.mark.parametrize("text", [JS, JS.replace("\n", "\r\n")])
def test_script(text):
    assert names(text, "ts") == {"one", "nested", "two", "three", "six"}
    assert names(text, "ts", True) == {"four", "five", "eight"}
    found = {f[1]: f for f in documented(text, "ts")}
    assert [found[n][0] for n in ("one", "nested", "two")] == [10, 13, 17]
    assert found["one"][4].rstrip().endswith("}") and "nested" in found["one"][4]


def test_notices_and_wrapped_prose():
    assert names("/*! metric.js v0.17 | (c) Somebody and Others */\nfunction d(a) { return a }", "js") == set()
    text = "// Calculate how far the rate has\n// from the value that was agreed.\nfunction f(a) { return a }"
    assert names(text, "js") == {"f"} and "agreed" in next(documented(text, "js"))[3]


def test_broken_text_keeps_what_can_be_read():
    text = "# Keeps only the rows that the caller may see.\ndef f(a):\n    x = (1\n<<<<<<< ours\n# Rounds half up as the ledger does.\ndef g(): pass\n    '''open"
    assert names(text, "python") == {"f", "g"}
    assert names("/** Reads every line once and forgets it. */\nfunction f(a) {\n  if (a) { '", "js") == {"f"}


def test_long_text_takes_linear_time():
    assert names("x = [" + "(" * 20_000 + "\n" + PY, "python") >= {"nested"}
    assert names("const a = {" * 3000 + "\n" + JS, "js") >= {"six"}


def test_rows(spark):
    schema = "id string, type string, repository_id string, file_path string, source string, start_line int, name string, ext string, trivial string, language string"
    node = lambda i, kind, path, source, line, name: (i, kind, "r", path, source, line, name, "clash", None, None)
    rows = [
        node("f", "File", "a.py", PY, 1, "a.py"), node("f", "File", "a.py", PY, 1, "a.py"), node("g", "File", "b.py", None, 1, "b.py"), node("h", "File", None, PY, 1, None),
        node("n", "Function", "a.py", "", 11, "nested"), node("n", "Function", "a.py", "", 11, "nested"), node("m", "Method", "a.py", "", 6, "above"),
        node("w", "Function", "a.py", "", 11, "other"), node("x", "Function", "b.py", "", 11, "nested"), node("y", "Function", None, None, None, None),
        node("z", "Class", "a.py", "", 6, "above"), node(None, "Function", "zz.py", None, 1, "q"),
    ]
    nodes = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in documented_rows(nodes).collect()) == ["m", "n"]
    assert documented_rows(nodes.limit(0)).count() == 0
    assert documented_functions(nodes.where("type = 'File'"), keep_trivial=True).where("trivial").count() == 6


def test_strings_and_brackets_in_bodies():
    text = '# Build the long text and give it back whole.\ndef f():\n    x = """\nat the edge\n"""\n    y = g(\n1,\n2)\n# note at the edge\n    return x\n\nz = 1\n'
    ((_, name, _, _, code, trivial),) = documented(text, "python")
    assert name == "f" and code.endswith("return x") and "at the edge" in code and not trivial
    script = "/** Builds the long text and gives it back whole. */\nfunction f(a) {\n  return `}${g({b: '}'})}{`;\n}\nvar z = {};\n"
    ((_, _, _, _, code, _),) = documented(script, "js")
    assert code.endswith("{`;\n}")


def test_open_bodies_go_on_to_the_end():
    text = "/** Does a thing with five words here. */\nfunction f(a) {\n" + '  x(1, "a");\n' * 100
    ((_, _, _, _, code, _),) = documented(text, "js")
    assert len(code) > 1200
    assert [len(x[4]) for x in documented("/** Does a thing with five words here. */\nfunction f(a) {\n  x(1);\n" * 3, "js")] == [24, 24, 24]
    assert [x[1] for x in documented("/** Does a thing with five words here. */\nfunction f(a {\n" * 3, "js")] == []


@pytest.mark.parametrize("unit", ["/** Does a thing with five words here. */\nfunction f(a) {\n  x(1);\n", "/** Does a thing with five words here. */\nfunction f(a {\n", "`${", "/** a */ '"])
def test_damaged_scripts_take_linear_time(unit):
    took = []
    for size in (100_000, 800_000):
        start = time.process_time()
        list(documented(unit * (size // len(unit)), "js"))
        took.append(time.process_time() - start)
    assert took[1] < 3 and took[1] < 20 * max(took[0], 0.05)
