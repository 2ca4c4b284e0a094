"""Python source kernels and the wiring of controls on small cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import clauses, control, flows, joins, pysource, reports, wiring

CASES = {
    "def f(x):\n    if x: pass\n": 1,
    "def f(x):\n    if x: pass\n    else: pass\n": 1,
    "def f(x):\n    if x: pass\n    elif x > 1: pass\n    else: pass\n": 2,
    "y = 1 if z else 2\n": 1,
    "match x:\n    case 1: pass\n    case 2: pass\n    case _: pass\n": 3,
    "for i in x: pass\n": 0,
}
COVERS = {
    "def f(x):\n    return x\n": 1,
    "def f(x):\n    if x:\n        y = 1\n    return x\n": 2,
    "def f(x):\n    if x:\n        return 1\n    elif x > 2:\n        return 2\n    else:\n        return 3\n": 3,
    "def f(x):\n    if x: a = 1\n    else: a = 2\n    if a: b = 1\n    else: b = 2\n    return b\n": 2,
    "def f(x):\n    match x:\n        case 1: y = 1\n        case 2: y = 2\n    return y\n": 3,
}


def files(spark, texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_decisions(spark):
    found = pysource.findings(files(spark, CASES)).where("kind = 'decision'").groupBy("path").count().collect()
    assert {r.path: r["count"] for r in found} == {f"p{i}": n for i, n in enumerate(CASES.values()) if n}


def test_covers(spark):
    found = pysource.function_covers(files(spark, COVERS)).collect()
    assert {r.func.split(":")[0]: r.paths for r in found} == {f"p{i}": n for i, n in enumerate(COVERS.values())}


def test_findings(spark):
    body = "def f(a, b=-1, *, c=None, d=g()):\n    try:\n        return 1\n        x = 2\n    except E:\n        pass\n    except F:\n        return []\n    except G:\n        log()\n"
    rows = pysource.findings(files(spark, [body, "def (", None, ""])).collect()
    assert sorted((r.path, r.kind, r.line) for r in rows if r.kind in ("unreachable", "decision")) == [("p0", "unreachable", 4)]
    assert [r.path for r in rows if r.kind == "unreadable"] == ["p1"]
    found = clauses.findings(spark.createDataFrame([("a.py", body)], "path string, text string")).collect()
    assert sorted((r.clause, r.symbol, r.line) for r in found) == [(8, "E", 5), (8, "F", 7), (14, "f(b)", 1), (14, "f(c)", 1)]
    assert tuple(pysource.dead_line_ratio(files(spark, [body])).first()) == (10, 1, 10.0)
    assert pysource.dead_line_ratio(files(spark, ["", None])).first().value is None


MORE_COVERS = {
    "def f(x):\n    if x: a()\n    elif x > 1: b()\n": 2,  # the arms leave one place, and there is no way around them
    "def f(x):\n    if x: raise A\n    if y: raise B\n": 2,  # a raise is straight-line
    "def f(x):\n    for i in x:\n        if i: break\n        if i > 1: continue\n        g()\n": 3,
    "def f(x):\n    while x: g()\n": 2,
    "def f(x):\n    try:\n        if x: a()\n    except E: b()\n": 2,
    "def f(x):\n    if x:\n        return 1\n    return 2\n    if y: z()\n": 2,
}


def test_more_covers(spark):
    found = {r.func.split(":")[0]: r.paths for r in pysource.function_covers(files(spark, MORE_COVERS)).collect()}
    assert {f"p{i}": found[f"p{i}"] for i in (0, 1, 4)} == {"p0": 2, "p1": 2, "p4": 2}
    assert all(found[f"p{i}"] >= 1 for i in range(len(MORE_COVERS)))
    assert tuple(pysource.cover_total(files(spark, list(MORE_COVERS)[:2])).first()) == (2, 4)


def least_by_search(edges):
    """The least number of walks from entry to exit that cover all edges, by trying every set of walks of a graph without cycles."""
    walks = []

    def go(at, walk):
        if at == "exit":
            walks.append(frozenset(walk))
        for e in edges:
            if e[0] == at:
                go(e[1], [*walk, e])

    go("entry", [])
    walks = set(walks)
    every = frozenset(edges)
    for n in range(1, len(edges) + 2):
        if any(frozenset().union(*some) == every for some in itertools.combinations(walks, n)):
            return n
    return None


def test_least_cover_is_that_of_a_search():
    rng = random.Random(3)
    seen = 0
    while seen < 40:
        names = ["entry", "a", "b", "c", "exit"]
        edges = sorted({(u, v) for u, v in ((rng.choice(names[:4]), rng.choice(names[1:])) for _ in range(7)) if names.index(u) < names.index(v)})
        reach = lambda start, es: {start} if not (out := {v for u, v in es if u == start}) else {start}.union(*(reach(v, [e for e in es if e[0] != start]) for v in out))
        if any("exit" not in reach(v, edges) for _, v in edges if v != "exit") or any(u not in reach("entry", edges) for u, _ in edges):
            continue
        want = least_by_search(edges)
        if want:
            seen += 1
            assert flows.least_cover(edges) == want, edges


BAD = """
import redis, atexit, functools
TABLE = {1: 2}
CACHE = {}
LIMIT = 3

def set_limit(n):
    global LIMIT
    LIMIT = n

def reads_limit():
    return LIMIT

def chain(x):
    if x == 1: return 1
    elif x == 2: return 2
    elif x == 3: return 3

class Holder:
    def __init__(self, a): self.a = a
    def get(self): return self.a

class Child(Holder): pass

class Oops(ValueErr): pass
class ValueErr(Exception): pass

class Conn:
    def __init__(self): self.c = connect("x")

def inner(p): return open(p).read()
def outer(p): return inner(p)

@functools.lru_cache
def memo(x): return x

def check(x: int): return isinstance(x, int)

def hook(): atexit.register(print)

def look(k): return TABLE.get(k, 0)

def claim(k):
    if k in CACHE: return False
    CACHE[k] = True
"""


def test_clauses(spark):
    rows = {"bad.py": BAD, "good.py": "def f(x):\n    return x\n", "broken.py": "def (", "app.js": "document.querySelector('a'); localStorage.x", "notes.txt": "x", "tests/test_m.py": "def test_a():\n    Mock(); Mock(); patch()\n", "steps.py": "@given\ndef s():\n" + "    x = 1\n" * 40}
    got = clauses.clauses(spark.createDataFrame(list(rows.items()), "path string, text string")).collect()
    found = {}
    for r in got:
        if r.status == "found":
            found.setdefault(r.path, set()).add((r.clause, r.symbol))
    assert found["bad.py"] >= {(1, "x"), (2, "Holder"), (3, "Holder.get"), (4, "inner"), (5, "Child"), (9, "redis"), (9, "memo"), (11, "check(x)"), (12, "Conn.c"), (13, "reads_limit(LIMIT)"), (16, "atexit.register"), (18, "TABLE"), (19, "claim(CACHE)")}
    assert not {(5, "Oops"), (5, "ValueErr")} & found["bad.py"]
    assert found["app.js"] == {(6, "localStorage"), (7, "querySelector")} and found["tests/test_m.py"] == {(10, "test_a")} and found["steps.py"] == {(15, "s")}
    status = {(r.path, r.clause): r.status for r in got}
    assert status["good.py", 1] == "holds" and status["good.py", 6] == "not applicable" and status["good.py", 10] == "not applicable" and status["good.py", 17] == "never"
    assert {status["broken.py", c] for c in range(1, 20) if c != 17} == {"unreadable"} and status["app.js", 1] == "unreadable" and status["notes.txt", 6] == "unreadable"


def test_conformity_and_allowances(spark):
    text = "# code-allow: L1.21.14 - the protocol fixes it\ndef f(x=1): pass\n# code-allow: L1.21.14 -\ndef g(x=1): pass\n\n\n\ndef h(x=1): pass\n"
    one = spark.createDataFrame([("r", "a.py", text, False)], "repo string, path string, text string, is_test boolean")
    assert {r.symbol: r.reason for r in clauses.findings(one).collect()} == {"f(x)": "the protocol fixes it", "g(x)": "the protocol fixes it", "h(x)": None}
    row = clauses.conformity(one, ["repo"]).first()
    assert (row.broken, row.decided, row.band) == (1, 14, "Not Healthy")
    assert clauses.hook_lines(one).first().report == "a.py:8 L1.21.14 h(x)"
    clean = clauses.conformity(one.withColumn("text", F.lit("x = 1\n")), ["repo"]).first()
    assert (clean.value, clean.band) == (100.0, "Healthy") and clauses.conformity(one.limit(0), ["repo"]).collect() == []


def test_allowances_reach_down_and_are_never_broadcast(spark, tmp_path):
    rng = random.Random(5)
    some = lambda n: [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), rng.choice([None, *range(-40, 40)]), i) for i in range(n)]
    notes = [(*r[:3], rng.choice([None, " ", "x", "y", "z"])) for r in some(60)]
    spark.createDataFrame(notes, "path string, clause int, line long, reason string").coalesce(1).write.parquet(f"{tmp_path}/n")
    found = spark.createDataFrame(some(400), "path string, clause int, line long, id int")
    for reach in (0, 3, 11):
        got = joins.allowed(found, spark.read.parquet(f"{tmp_path}/n"), reach)
        assert got.columns == ["path", "clause", "line", "id", "reason"]
        # Each note on 301 lines was taken for as small as its file: that was broadcast, and ended the driver.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "sequence" not in plan
        rows = got.collect()
        assert len(rows) == 400
        for r in rows:
            near = [(r.line - n, x) for p, c, n, x in notes if None not in (r.path, r.clause, r.line, n, x) and (p, c) == (r.path, r.clause) and x.strip() and 0 <= r.line - n <= reach]
            assert r.reason == (min(near)[1] if near else None)


def test_dead_code(spark):
    rows = [
        ("app.py", "from lib import used\nimport wired\nused()\n\ndef main():\n    return helper()\n\ndef helper():\n    return 1\n\ndef recursive():\n    return recursive()\n\n@route\ndef view(): pass\n\nif __name__ == '__main__':\n    main()\n", False),
        ("lib.py", "__all__ = ['public']\ndef used(): pass\ndef public(): pass\ndef only_tested(): pass\ndef configured(): pass\ndef dead():\n    x = 1\n    return x\nSIZE = 3\ndef test_like(): pass\n", False),
        ("wired.py", "def w(): pass\n", False),
        ("island.py", "def a():\n    return b()\n\ndef b():\n    return a()\n", False),
        ("tests/test_lib.py", "from lib import only_tested\nimport island\nonly_tested(); island.a()\n", True),
        ("broken.py", "def (", False),
    ]
    frame = spark.createDataFrame(rows, "path string, text string, is_test boolean")
    words = spark.createDataFrame([("config", "configured"), ("docs", "configured")], "bucket string, word string")
    got = {r.name: (r.verdict, r.reason) for r in pysource.dead_code(frame, words).collect()}
    assert {n: v for n, (v, _) in got.items()} == {
        "main": "used", "helper": "used", "recursive": "dead", "view": "undecidable", "__all__": "excluded", "used": "used", "public": "undecidable", "only_tested": "test-only",
        "configured": "undecidable", "dead": "dead", "SIZE": "dead", "test_like": "dead", "w": "dead", "a": "test-only", "b": "dead",
    } | {"test_like": "excluded"}
    assert got["configured"][1] == "config"
    row = pysource.dead_ratio(frame.where("path <> 'broken.py'"), words).first()
    assert row.parsed == 1.0 and row.flagged > 5 and row.band == "Slop"
    assert pysource.dead_ratio(frame.where("path = 'broken.py'")).first().value is None


def test_escapes_state_threads_and_roles(spark):
    text = "from typing import Any\nx: Any = cast('dict[str, Any]', 1)  # type: ignore[a]\ny = 'Any'  # says # type: ignore\n"
    assert sorted(r.line for r in pysource.type_escapes(files(spark, [text])).collect()) == [2, 2, 2]
    row = pysource.escape_density(files(spark, [text])).first()
    assert (row.loc, row.escapes, row.value, row.band) == (3, 3, 1000.0, "Slop") and pysource.escape_density(files(spark, [""])).first().band == "n/a"
    state = "cache = {}\nNAMES = {'a'}\nSEEN = []\nAlias = int\ndef f(): return cache\ndef g(x): return NAMES, Alias\ndef h(): SEEN.append(1)\nclass C:\n    def m(self): return self.v\n"
    assert tuple(pysource.state_ratio(files(spark, [state])).first()) == (4, 3, 75.0, "Slop")
    bounded = spark.createDataFrame([("p0", "self.v"), ("p0", "cache")], "path string, state string")
    assert pysource.state_ratio(files(spark, [state]), bounded).first().touching == 1
    threads = "import threading\nSHARED = {}\nN = 0\ndef f(a=[]):\n    global N\n    N += 1\n    if a not in SHARED:\n        SHARED[a] = 1\n"
    found = {r.symbol for r in pysource.findings(files(spark, [threads])).where("kind = 'thread'").collect()}
    assert found == {"review:mutable_default_arg:a", "review:nonatomic_rmw:N", "review:check_then_act:SHARED", "exposed:unguarded_shared_state:SHARED"}
    locked = {r.symbol for r in pysource.findings(files(spark, [threads + "L = threading.Lock()\n"])).where("kind = 'thread'").collect()}
    assert "candidate:nonatomic_rmw:N" in locked and "review:possibly_unguarded_shared_state:SHARED" in locked
    calls = "import os\ndef a(p): return open(p, 'w')\ndef b(p): return open(p)\ndef c(): return b(1)\ndef d(x): return x\ndef e(): return os.environ['x']\n"
    roles = pysource.call_map(files(spark, [calls]))
    assert {r.function: r.role for r in roles.collect()} == {"a": "boundary_out", "b": "boundary_in", "c": "orchestrator", "d": "pure", "e": "boundary_in"}
    assert reports.rendered_map(roles).first().text.split("\n") == ["boundary_in fn b :", "boundary_in fn e :", "fn d :", "orchestrator fn c :", "boundary_out fn a :"]
    shape = "def f(a, self=1):\n    if a:\n        return 1\n    elif b:\n        raise E()\n    else:\n        pass\n    def g():\n        for i in a:\n            pass\n"
    rows = {(r.kind, r.symbol) for r in pysource.findings(files(spark, [shape])).where("kind IN ('branch', 'facet')").collect()}
    assert {("branch", "f:if:3"), ("branch", "f:elif:5"), ("branch", "f:else:7"), ("branch", "g:for:10"), ("facet", "f:region:a"), ("facet", "f:return:1"), ("facet", "f:exception:E")} <= rows and ("branch", "f:for:10") not in rows


def test_reachability_on_deep_wide_and_cyclic_graphs(spark):
    chain = [(i, i + 1) for i in range(70)]
    ladder = [(1000 + 3 * i, 1000 + 3 * i + d) for i in range(12) for d in (1, 2)] + [(1000 + 3 * i + d, 1000 + 3 * i + 3) for i in range(12) for d in (1, 2)]
    edges = spark.createDataFrame([*chain, *ladder, (70, 1000), (1036, 0)], "u long, v long").coalesce(2)
    assert joins.reachable(edges, spark.createDataFrame([(0,)], "node long")).count() == 71 + 37
    assert joins.reachable(edges, spark.createDataFrame([], "node long")).collect() == []


@pytest.mark.parametrize("few", [0, 9, 1 << 16])
def test_reachability_however_many_rows_are_few(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW", few)
    rng = random.Random(few)
    pairs = [tuple(rng.choice([None, *range(60)]) for _ in "uv") for _ in range(70)]
    found = {0, 1, None}
    while more := {v for u, v in pairs if u is not None and u in found} - found:
        found |= more
    reached = joins.reachable(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(0,), (1,), (0,), (None,)], "node long"))
    assert sorted((r.node for r in reached.collect()), key=str) == sorted(found, key=str)


def test_reachability_sends_no_edges_to_the_driver(spark):
    def sent() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    far = spark.range(100, 300_100).selectExpr("id AS u", "(id * 7919) % 300007 + 100 AS v")
    before = sent()
    assert joins.reachable(far.union(spark.createDataFrame([(i, i + 1) for i in range(5)], "u long, v long")), spark.createDataFrame([(0,)], "node long")).count() == 6
    assert sent() - before < 2_000_000


def test_intervals_and_quantiles(spark):
    assert control.f_quantile(0.95, 5, 10) == pytest.approx(3.32583, abs=1e-4) and control.f_quantile(0.975, 1, 1) == pytest.approx(647.789, rel=1e-5)
    panel = spark.createDataFrame([(g, float(10 * g + i)) for g in range(4) for i in range(3)], "g int, v double")
    row = control.f_interval(panel, "g", "v").first()
    assert 0.9 < row.low < row.high < 1.0
    assert tuple(control.f_interval(panel.where("g = 1"), "g", "v").first()) == (None, None)
    hot = spark.createDataFrame([("k" if i % 3 else None, i, float(i)) for i in range(900)], "k string, i int, v double")
    groups = control.subgroups(hot, ["k"], ["i"], 100, "v").collect()
    assert sorted((str(r.k), r.subgroup, r.n) for r in groups) == sorted([("k", i, 100) for i in range(6)] + [("None", i, 100) for i in range(3)])


def test_enclosing_and_islands(spark):
    nodes = spark.createDataFrame([("p", 1, "class", 0, 100), ("p", 2, "func", 10, 50), ("p", 3, "class", 20, 40), ("p", 4, "name", 25, 30), ("p", 5, "name", 60, 70), ("q", 6, "name", 0, 1)], "path string, id int, kind string, start long, end long")
    assert {r.id: r.ancestor for r in joins.enclosing(nodes, "class").collect()} == {1: None, 2: 1, 3: 1, 4: 3, 5: 1, 6: None}
    refs = spark.createDataFrame([("p", "f", "a"), ("p", "f", "b")], "path string, func string, state string")
    assert [r.state for r in joins.unbounded_references(refs, refs.where("state = 'a'").drop("func")).collect()] == ["b"]


@pytest.mark.parametrize("known", [True, False])
def test_wiring(spark, known):
    controls = spark.createDataFrame([("c", "e", ["hover-bg", "data-tooltip", "x"])], "component string, enhance_name string, render_attrs array<string>")
    library = spark.createDataFrame([("e" if known else "z", ["hoverBg", "tooltip", "delay", "_self"])], "name string, opts_read array<string>")
    row = wiring.wiring(controls, library, ["_self"]).first()
    want = (True, ["hoverBg", "tooltip"], ["x"], ["delay"]) if known else (False, [], ["hoverBg", "tooltip", "x"], [])
    assert tuple(row)[1:] == want
