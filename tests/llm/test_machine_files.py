"""Generated, minified, data and copied files against hand-written ones that look or talk like them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from codeloom.llm.machine_files import TOKENS, WINDOW, features, fingerprints, machine_files, tokens

WORDS = "account badge cargo depot edge fragment graph hangar index journal kiosk ledger meter node order parcel quota route socket tariff unit vessel wharf yard zone".split()


def written(seed: int, n: int = 60, style: str = "js") -> str:
    """Text that differs for each seed, as a person might write it."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.choice(WORDS), r.choice(WORDS), r.choice(WORDS)
        if style == "js":
            out.append(f"function {a}{b.title()}{r.randint(0, 99999)}({c}) {{\n  const {b} = {c}.{a} + {r.randint(0, 9999)};\n  return {b} > {r.randint(0, 999)} ? {a}({b}) : {c};\n}}")
        else:
            out.append(f"def {a}_{b}_{r.randint(0, 99999)}({c}):\n    {b} = {c}.{a} + {r.randint(0, 9999)}\n    return {a}({b}) if {b} > {r.randint(0, 999)} else {c}\n")
    return "\n".join(out) + "\n"


def kind(text: str, ext: str = "js"):
    return features(text, ext)[1]


@pytest.mark.parametrize(
    "line",
    ["Code generated by mill v1; DO NOT EDIT.", "@generated by mill", "<auto-generated> tool: mill </auto-generated>", "This file was automatically generated by mill.", "AUTO-GENERATED FILE - changes will be overwritten", "Autogenerated from a.schema, edit that instead",
     "Produced by mill on 2024-01-01; manual edits are lost on the next run", "Compiled from a.idl. Any edit made here will be discarded.", "Diese Datei wurde von mill erzeugt. Nicht von Hand bearbeiten!", "Ce fichier est produit par mill, ne pas modifier.", "source: a.proto"],
)
def test_tool_marks(line):
    assert kind(f"// {line}\n" + written(1)) == "generated" and kind(f"#!/usr/bin/env python3\n# Licence: see there.\n#\n# {line}\n" + written(1, style="py"), "py") == "generated"
    assert kind(f"/*\n * {line}\n */\n" + written(1), "ts") == "generated"
    assert kind(f'const mark = "{line}";\n' + written(1)) is None and kind(written(1) + f"\n// {line}\n") is None


@pytest.mark.parametrize(
    "line",
    ["The tables below were once generated; since 2018 they are kept by hand.", "Checks that generated stubs carry the DO NOT EDIT line.", "Do not edit the order of the calls below without asking the team.", "Generates reports.", "Copyright 2020 The Authors."],
)
def test_talk_about_generated_files(line):
    assert kind(f"// {line}\n" + written(1)) is None


def test_numbered_definitions():
    text = "".join(f"export function {WORDS[i]}{i}ToJSON(v: any) {{\n  return v === undefined ? undefined : {{ 'a': v.a, 'tag': {i} }};\n}}\n" for i in range(12))
    assert kind(text, "ts") == "generated"
    assert kind("import a_b as _d\n" + "".join(f"def set_{WORDS[i]}_{i}(self, v):\n    self._v[{i}] = v\n" for i in range(9)), "py") == "generated"
    assert kind("const a1 = 1;\nconst a2 = 2;\n" + written(1)) is None


def test_minified_and_long_lines():
    dense = "".join(f"function {a}({b},{c}){{return {b}.x||{c}({i})}}var {a}={b}?{c}:{i};" for i, (a, b, c) in enumerate(["abc", "def", "ghi", "jkl", "mno"] * 8))
    assert kind(dense) == "minified" and kind("/*! x v1 */\n" + dense) == "minified"
    prose = "We keep three snapshots per repository and drop the oldest one when another arrives. " * 20
    assert kind(f'const PROMPT = "{prose}";\n' + written(1, 20)) is None and kind(f'const ICON = "data:image/png;base64,{"aB3+" * 90}";\n' + written(1, 20)) is None


def test_data_blocks():
    numbers = "export const A = [\n" + "".join("  " + ", ".join(str(i * j % 251) for j in range(16)) + ",\n" for i in range(40)) + "];\n"
    assert kind(numbers) == "data" and kind("# taken over from the sheet\nA = [\n" + '  {"k": "a", "v": 1, "h": "0a1b2c3d"},\n' * 60 + "]\n\ndef find(k):\n    return A[k]\n", "py") == "data"
    assert kind("A = {\n" + "".join(f'    "{w}": {i},\n' for i, w in enumerate(WORDS)) + "}\n" + written(1, 20, "py"), "py") is None
    assert kind("A = [\n" + '  "Please rerun the index before the merge of both branches is done.",\n' * 40 + "]\n", "py") is None


def test_fingerprints_meet_the_winnowing_promise():
    a, b = tokens(written(1, 40), False), tokens(written(2, 40), False)
    shared = a[100 : 100 + TOKENS + WINDOW - 1 + 4]
    assert set(fingerprints(b[:50] + shared + b[50:], False)) & set(fingerprints(a, False))
    assert not set(fingerprints(b, False)) & set(fingerprints(a, False))
    one = fingerprints(tokens("const a = 'x';\n" + written(1), False), False)
    same = fingerprints(tokens('// note\nconst a = "x"\n' + written(1).replace(";", "").replace("  ", "\t"), False), False)
    assert np.array_equal(one, same) and one.dtype == np.int64
    # a stream shorter than a run is one run
    assert len(fingerprints(["a"] * (TOKENS - 1), False)) == 1 and len(fingerprints([], False)) == 0
    assert not np.array_equal(fingerprints(["a", "b"], False), fingerprints(["b", "a"], False))


def test_operator(spark):
    library = written(7)
    altered = library.replace("ledger", "konto", 2)
    hot = [(f"h{i}", f"r{i}", f"lib/{i}.js", written(100 + i, 3) + written(8, 3), None, None) for i in range(40)]
    rows = [
        ("a", "r1", "vendor/a.js", library, None, "clash"), ("a", "r1", "vendor/a.js", library, None, "clash"), ("b", "r2", "src/b.js", "// note\n" + altered, None, "clash"), ("c", "r3", "src/c.js", written(3), None, None), ("d", "r3", "lib/c.js", written(3), None, None),
        ("e", "r4", "e.js", "// @generated\nfunction (", None, None), ("f", "r4", "f.py", "# @generated\nx = 1\n", None, None), ("g", "r4", "g.js", "", None, None), ("h", "r4", "h.js", None, None, None), ("i", None, "i.js", written(9), None, None),
        ("j", "r5", "j.json", "[1]", None, None), (None, "r5", "k.js", library, None, None), ("l", "r6", None, library, None, None), ("m", "r7", "m.js", library + "function (", None, None), *hot,
    ]
    files = spark.createDataFrame(rows, "id string, repository_id string, file_path string, source string, prints string, kind string")
    assert {r.id: r.kind for r in machine_files(files).collect() if r.id[0] != "h"} == {"a": "copy", "b": "copy", "f": "generated"}
    assert machine_files(files.limit(0)).count() == 0


def test_short_copies_and_holders(spark):
    short = "export const pick = (row) => row.wharf && row.wharf.ledger;\n"
    rows = [(f"s{i}", f"r{i}", f"a{i}.js", short) for i in range(3)] + [("t", "r1", "t.js", written(3, 1)), ("u", "r1", "u.js", written(4, 1)), ("v", "r2", "v.js", written(4, 1))]
    files = spark.createDataFrame(rows, "id string, repository_id string, file_path string, source string")
    assert {r.id for r in machine_files(files).collect()} == {"s0", "s1", "s2", "u", "v"}
    assert {r.id for r in machine_files(files, holders=2).collect()} == {"s0", "s1", "s2"}
    assert machine_files(files, holders=3).count() == 0


def test_marks_behind_other_things():
    assert kind('# coding: utf-8\n"""Generated by mill from a.schema. Do not edit."""\n' + written(1, style="py"), "py") == "generated"
    assert kind("'use strict';\n// Code generated by mill; DO NOT EDIT.\n" + written(1)) == "generated" and kind('"use client"\n' + written(1)) is None
    assert kind('"""Reads what mill wrote."""\nnote = "Code generated by mill"\n', "py") is None


def test_dense_python():
    dense = "import os,sys\ndef f(a,b):\n c=a+b;d=c*2\n if d>3:return d\n return[c,d]\nclass A:\n def g(s,x):\n  s.y=x;return f(x,s.y)\n"
    assert kind(dense, "py") == "minified" and kind(dense * 20, "py") == "minified"
    assert kind(written(1, style="py"), "py") is None and kind("def f(a, b):\n  return a + b, a * b, a - b\n", "py") is None
    assert kind("x=1\ny=x+2\nz=[x,y]\n", "py") is None


def test_small_files_of_each_kind():
    assert kind("export const A = [" + ", ".join(map(str, range(60))) + "];\n") == "data"
    assert kind('"""Utilities."""\n', "py") is None and kind("...\n", "py") is None and kind("export default {};\n") is None
    assert kind("def step1():\n    pass\n\ndef step2():\n    pass\n", "py") is None
    assert kind("".join(f"export const a{i} = make({i});\n" for i in range(4))) == "generated"
    assert kind("!function(e,t){e.x=t,t.y=e,e.z=function(n){return n?t(e,n):e(t,n)},e.q=t.r||e.s&&t.u,e.v=e.w?t.a:e.b}(window,document);") == "minified"
