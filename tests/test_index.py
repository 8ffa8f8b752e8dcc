"""From small source trees to graphs."""

from __future__ import annotations

import pytest

from codeloom.extract.runner import extract, extracted
from codeloom.graph import PropertyGraph
from codeloom.operators.index import graph_fingerprint, index_files
from codeloom.operators.traverse import impacts, shortest_paths, traces

SHOP = {
    "shop/models.py": "from orm import DeclarativeBase\nclass Base(DeclarativeBase): pass\nclass User(Base): pass\nclass Order(Base):\n    total = 1\n",
    "shop/payments.py": "class PaymentService:\n    def charge(self, order):\n        return order\n",
    "shop/orders.py": "from shop.models import Order\nfrom shop.payments import PaymentService as Pay\n\nclass OrderService:\n    def __init__(self):\n        self.pay = Pay()\n    def checkout(self, session):\n        order = Order()\n        session.add(Order)\n        return self.finish(order)\n    def finish(self, order):\n        return self.pay.charge(order)\n",
    "shop/auth.py": "from .tokens import verify_token\nclass AuthService:\n    def authenticate(self, token):\n        return verify_token(token)\n",
    "shop/tokens.py": "def verify_token(token):\n    return len(token)\n",
    "shop/routes.py": "from fastapi import APIRouter, Depends\nfrom shop.auth import AuthService\nfrom shop import orders\nrouter = APIRouter()\nservice = orders.OrderService()\nauth = AuthService()\ndef require_user(token): return auth.authenticate(token)\n@router.post('/checkout')\ndef checkout(session, user=Depends(require_user)):\n    return service.checkout(session)\n@router.route('/both', methods=['GET', 'POST'])\ndef both(): pass\n",
    "web/client.ts": "import { helper as h, Unused } from './lib/helper';\nimport express from 'express';\nimport def from './lib/other';\nconst app = express();\nexport class Client extends Basic implements Closable {\n  private api = new Api();\n  load(id: string): void { this.send(id); h(id); def(); }\n  send(x: any) { fetch(x); }\n}\nclass Basic { m() {} }\ninterface Closable { close(): void; }\nclass Api { get() {} }\napp.get('/x', handler);\nfunction handler(req) { const c = new Client(); c.load('1'); }\n",
    "web/lib/helper.ts": "export function helper(x: string) { return x; }\nexport const unused = (h: any) => h();\n",
    "web/lib/other.js": "export default function other() { require('./helper'); }\n",
}


SMALL = {"a.py": "def greet(name):\n    return name\n", "b.py": "from a import greet\n\ndef main():\n    print(greet('x'))\n"}
MANY = {"a.py": "".join(f"def f{i}():\n    return {i}\n\n" for i in range(400))}
NEGATIVE = {
    "a.py": "def target(): pass\n",
    "b.py": "from a import target\ndef f(target):\n    target()\ndef g():\n    target = 1\n    target()\nclass Model: pass\nd = {}\nd.get('/x')\n",
    "c.py": "def other(): pass\ndef h(): missing()\n",
    "d.py": "def broken(:\n  pass\n@r.get('/z')\ndef kept(): return kept()\n",
    "e.js": "const m = new Map(); m.get('/y', go); function go() { if (a) { go(); } }\n",
    "f.txt": "nothing",
}
TREES = {"shop": SHOP, "small": SMALL, "many": MANY, "negative": NEGATIVE}


@pytest.fixture(scope="module")
def indexed(spark):
    """All trees as repositories of one index."""
    rows = [(repo, p, t) for repo, tree in TREES.items() for p, t in tree.items()]
    return index_files(spark.createDataFrame(rows, "repository_id string, file_path string, text string"))


def part(graph, repo):
    nodes = graph.nodes.where(f"repository_id = '{repo}'")
    return PropertyGraph(nodes, graph.edges.join(nodes.selectExpr("id as source"), "source", "left_semi"))


def triples(graph, resolution="resolved"):
    nodes = {r.id: r for r in graph.nodes.drop("embedding").collect()}
    short = lambda i: nodes[i].qualified_name.rsplit(":", 1)[-1] or nodes[i].file_path or nodes[i].name
    return {(short(e.source), e.type, short(e.target)) for e in graph.edges.collect() if resolution in (None, e.resolution)}


@pytest.fixture(scope="module")
def shop(indexed):
    return part(indexed[0], "shop")


def test_python_calls_imports_and_models(shop):
    found = triples(shop)
    for triple in [
        ("OrderService.checkout", "CALLS", "OrderService.finish"), ("OrderService.finish", "CALLS", "PaymentService.charge"), ("OrderService.checkout", "CALLS", "Order"), ("AuthService.authenticate", "CALLS", "verify_token"), ("require_user", "CALLS", "AuthService.authenticate"),
        ("checkout", "CALLS", "OrderService.checkout"), ("checkout", "DEPENDS_ON", "require_user"), ("POST /checkout", "HANDLES", "checkout"), ("GET /both", "HANDLES", "both"), ("POST /both", "HANDLES", "both"), ("Order", "EXTENDS", "Base"),
        ("shop/auth.py", "IMPORTS", "shop/tokens.py"), ("shop/auth.py", "REFERENCES", "verify_token"), ("shop/routes.py", "IMPORTS", "shop/orders.py"), ("shop/routes.py", "USES_PACKAGE", "fastapi"), ("shop/models.py", "USES_PACKAGE", "orm"),
    ]:
        assert triple in found, triple
    kinds = {(r.name, r.type) for r in shop.nodes.collect()}
    assert {("Order", "DatabaseEntity"), ("User", "DatabaseEntity"), ("shop", "Directory"), ("lib", "Directory"), ("POST /checkout", "Endpoint")} <= kinds and ("Base", "DatabaseEntity") not in kinds
    assert ("OrderService.checkout", "WRITES_TO", "Order") in triples(shop, "probable")
    assert ("verify_token", "CALLS", "len") in triples(shop, "unresolved")


def test_script_calls_imports_and_routes(shop):
    found = triples(shop)
    for triple in [
        ("Client.load", "CALLS", "Client.send"), ("Client.load", "CALLS", "helper"), ("Client.load", "CALLS", "other"), ("Client", "EXTENDS", "Basic"), ("Client", "IMPLEMENTS", "Closable"), ("GET /x", "HANDLES", "handler"), ("handler", "CALLS", "Client"), ("handler", "CALLS", "Client.load"),
        ("web/client.ts", "IMPORTS", "web/lib/helper.ts"), ("web/client.ts", "USES_PACKAGE", "express"), ("Client", "DEFINES", "Client.load"), ("Closable", "DEFINES", "Closable.close"), ("web/lib/other.js", "DEFINES", "other"),
    ]:
        assert triple in found, triple
    assert ("unused", "CALLS", "h") not in {(a, b, c) for a, b, c in found}  # a parameter shadows what it is named like


def test_paths_traces_and_impact_of_the_index(spark, shop):
    nodes = {(r.name, r.type): r.id for r in shop.nodes.collect()}
    pairs = spark.createDataFrame([(nodes["POST /checkout", "Endpoint"], nodes["charge", "Method"])], "source string, target string")
    assert shortest_paths(shop, pairs).first().length == 5
    row = impacts(shop, spark.createDataFrame([(nodes["verify_token", "Function"],)], "id string")).first()
    assert (row.n_direct, row.n_endpoints, row.depth) == (2, 1, 4) and row.score == row.f_direct + row.f_transitive + row.f_endpoints + row.f_modules + row.f_writes + row.f_depth
    ends = {r.id for r in traces(shop, spark.createDataFrame([(nodes["POST /checkout", "Endpoint"],)], "id string")).collect()}
    assert nodes["Order", "DatabaseEntity"] in ends and nodes["charge", "Method"] in ends


def test_small_tree_counts(indexed):
    graph = part(indexed[0], "small")
    assert graph.nodes.count() == 6 and graph.edges.count() == 8


def test_negative_cases(indexed):
    graph, warnings = part(indexed[0], "negative"), indexed[1]
    found = triples(graph)
    assert not {t for t in found if t[1] == "CALLS" and t[2] == "target"}
    assert ("kept", "CALLS", "kept") in found and ("GET /z", "HANDLES", "kept") in found and ("go", "CALLS", "go") in found
    assert {r.name for r in graph.nodes.where("type = 'Endpoint'").collect()} == {"GET /z"}
    assert [r.file_path for r in warnings.where("repository_id = 'negative'").collect()] == ["d.py"]


def test_many_functions(indexed):
    nodes = indexed[0].nodes.where("repository_id = 'many'")
    assert nodes.where("type = 'Function'").count() == 400 and nodes.where("name = 'f399'").first().start_line == 1198


def test_ids_survive_edits_and_fingerprints_do_not(spark):
    one, two = "def f():\n    return 1\n", "def f():\n    return 2\n"
    a, b = extract("r", "a.py", one), extract("r", "a.py", two)
    assert [s["id"] for s in a.symbols] == [s["id"] for s in b.symbols] and a.symbols[0]["hash"] != b.symbols[0]["hash"]
    rows = spark.createDataFrame([("x", "a.py", one), ("y", "a.py", two), ("z", "a.py", one)], "repository_id string, file_path string, text string")
    marks = {r.repository_id: r.fingerprint for r in graph_fingerprint(rows).collect()}
    assert marks["x"] == marks["z"] != marks["y"] and len(marks["x"]) == 24


def test_no_source_files(spark):
    rows = spark.createDataFrame([("r", "a.txt", "x"), ("r", None, "x"), ("r", "b.py", None)], "repository_id string, file_path string, text string")
    assert extracted(rows).count() == 0


def test_long_ways_and_loops_of_reexports(spark):
    tree = {
        "deep/impl.py": "class Service:\n    def run(self): pass\n", "deep/a0/__init__.py": "from deep.impl import Service\n",
        **{f"deep/a{i}/__init__.py": f"from deep.a{i - 1} import Service\n" for i in range(1, 7)},
        "main.py": "from deep.a1 import Service\nfrom deep.a6 import Service as Far\nfrom loop.x import Lost\nsvc = Service()\nfar = Far()\nlost = Lost()\ndef near_call():\n    svc.run()\ndef far_call():\n    far.run()\ndef lost_call():\n    lost.run()\n",
        "loop/x.py": "from loop.y import Lost\n", "loop/y.py": "from loop.x import Lost\n", "self.py": "a = b.f()\nb = a.g()\ndef h():\n    a.k()\n",
    }
    graph, _ = index_files(spark.createDataFrame([("deep", p, t) for p, t in tree.items()], "repository_id string, file_path string, text string"))
    found = triples(graph)
    assert {("near_call", "CALLS", "Service.run"), ("far_call", "CALLS", "Service.run")} <= found
    assert ("lost_call", "CALLS", "lost.run") in triples(graph, "unresolved")


def test_impact_of_a_guarded_tree(spark):
    """A helper two calls below a guard that three routes depend on: 11 dependents in 3 files and 2 modules, 4 hops, 52 points."""
    tree = {
        "lib/marks.py": "def read_mark(mark):\n    return {}\n",
        "core/doors.py": "from lib.marks import read_mark\n\nclass Door:\n    @staticmethod\n    def knock(mark):\n        return read_mark(mark)\n",
        "web/guard.py": "from fastapi import Header\nfrom core.doors import Door\n\ndef guest(mark=Header()):\n    return Door.knock(mark)\n",
        "web/pages.py": "from fastapi import FastAPI, Depends\nfrom web.guard import guest\n\napp = FastAPI()\n\n@app.get('/a')\ndef a(who=Depends(guest)):\n    return who\n\n@app.post('/b')\ndef b(who=Depends(guest)):\n    return who\n\n@app.get('/c')\ndef c(who=Depends(guest)):\n    return who\n",
    }
    graph, _ = index_files(spark.createDataFrame([("g", p, t) for p, t in tree.items()], "repository_id string, file_path string, text string"))
    start = graph.nodes.where("name = 'read_mark'").select("id")
    row = impacts(graph, start).first()
    assert (row.n_direct, row.n_transitive, row.n_files, row.n_modules, row.depth, row.n_endpoints, row.n_tables) == (2, 9, 3, 2, 4, 3, 0)
    assert (row.score, row.risk) == (52, "MEDIUM")


def test_templates_angles_and_brackets():
    text = "const s = `a ${call(1)} ${list.map(x => `n${deep(x)}`)} ) }`.trim();\nfunction f<T extends Map<string, Array<number>>>(a: T) { if (a < b) { return x > y } return `x${g(a)}` }\nexport default class K { m() { return `t${this.n({ a: 1 })}`; } n() {} }\n"
    record = extract("r", "a.ts", text)
    calls = [(x["target"], x["scope"]) for x in record.refs if x["kind"] == "CALLS"]
    assert {("call", ""), ("list.map", ""), ("deep", f"callback@1:{text.index('x =>')}"), ("g", "f"), ("this.n", "K.m")} <= set(calls) and not record.warnings
    assert [(s["dotted"], s["is_default"]) for s in record.symbols if s["type"] == "Class"] == [("K", True)]
    deep = "f(" + "[{(" * 40 + "x" + ")}]" * 40 + "); g();"
    assert {x["target"] for x in extract("r", "a.js", deep).refs if x["kind"] == "CALLS"} == {"f", "g"}
    stray = "function a() { b(" + "[" * 8 + "; }\nfunction c() { d(); }\n"  # brackets that nothing closes
    assert {"a", "c"} <= {s["name"] for s in extract("r", "a.js", stray).symbols}
    typed = "const m = new Map<" + ", ".join(["string"] * 500) + ">(k);\nuse(m);\n"
    assert {"Map", "use"} <= {x["target"] for x in extract("r", "a.ts", typed).refs if x["kind"] == "CALLS"}
    chain = "start(1)" + ".then(" + "x" * 400 + ")" + ".done();"
    assert any(x["target"].endswith(".done") for x in extract("r", "a.js", chain).refs)


def test_imports_and_long_chains_of_operators():
    record = extract("r", "a.py", "import a.b\nimport a.b as c\nfrom .. import d\nfrom ..e import f as g\n\ndef h():\n    import x\n    from y import d\n\nz = " + " + ".join(["call()"] * 3000) + "\n")
    assert {k: v[:2] for k, v in record.imports.items()} == {"a": ("a", "*"), "c": ("a.b", "*"), "d": ("y", "d"), "g": ("..e", "f"), "x": ("x", "*")}
    assert not record.warnings and sum(x["target"] == "call" for x in record.refs) == 3000
