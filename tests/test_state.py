"""The state classifier on small modules, its folds and the census over them."""

from marlstone.operators import joins, pysource, pystate

CASES = {
    "MODE = 'a'\ndef put(x):\n    global MODE\n    MODE = x\ndef f():\n    if MODE == 'b': return 1\n    elif MODE == 'c': return 2\n": ("MODE", "neutral", True, 3, False, None),
    "n = 0\ndef put():\n    global n\n    n += 1\ndef f():\n    return n > 3\n": ("n", "neutral", True, 2, True, None),
    "seen = {}\ndef put(k): seen[k] = 1\ndef f(k):\n    if k in seen: return 1\n": ("seen", "promiscuous", False, 0, True, None),
    "seen = {}\ndef put(k): seen[k] = 1\ndef f():\n    if 'x' in seen: return 1\n": ("seen", "neutral", True, 2, False, None),
    "log = []\ndef put(k): log.append(k)\ndef f(): return log\n": ("log", "neutral", False, 0, True, None),
    "log = []\ndef put(k): log.append(k)\ndef f():\n    for x in log: g(x)\n": ("log", "promiscuous", False, 0, True, None),
    "cfg = {}\ndef put(k): cfg['a'] = k\ndef f(): send(cfg)\n": ("cfg", "unresolved", False, 0, True, "external_boundary"),
    "cfg = {}\ndef put(k): cfg['a'] = k\ndef f():\n    v = cfg['a']\n    w = v\n    return 1 if w else 2\n": ("cfg", "neutral", True, 2, False, None),
    "class C:\n    def __init__(self): self.on = False\n    def go(self): self.on = True\n    def f(self):\n        if not self.on: return 1\n": ("C.on", "neutral", True, 2, False, None),
    "s = 'a'\ndef put(x):\n    global s\n    s = x\ndef f():\n    match s:\n        case 'a': return 1\n        case _: return 2\n": ("s", "neutral", True, 3, False, None),
}


def test_states(spark):
    files = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(CASES)], "path string, text string")
    got = {r.path: (r.state, r.verdict, r.drives, r.classes, r.ordered, r.reason) for r in pystate.classified(files).collect()}
    assert got == {f"p{i}": want for i, want in enumerate(CASES.values())}
    row = pystate.distribution(pystate.classified(files), []).first()
    assert (row.neutral, row.drives, row.promiscuous, row.unresolved, row.verdict, row.resolvable) == (7, 6, 2, 1, "promiscuous", 0.9)
    assert pystate.distribution(pystate.classified(files.limit(0)), []).first().resolvable == 1.0
    alone = pysource.state_ratio(files).first()
    less = pysource.state_ratio(files, pystate.bounded(pystate.classified(files))).first()
    assert alone.functions == less.functions and less.touching < alone.touching


def test_what_is_written_once_or_shadowed_is_no_state(spark):
    text = "A = 1\nb = [1]\nc = {}\ndef f(c):\n    if A: return b\n    if c: return 1\ndef put(k): c[k] = 1\nclass D:\n    def __init__(self): self.x = 1\n    def g(self): return self.x > 1\n"
    files = spark.createDataFrame([("p", text), ("q", "def ("), ("r", None)], "path string, text string")
    assert [(r.state, r.line, r.verdict, r.drives) for r in pystate.classified(files).collect()] == [("c", 7, "neutral", False)]  # its own write alone
    told = {(r.kind, r.owner, r.name) for r in pystate.declarations(files).collect()}
    assert told == {("module_binding", "", "A"), ("module_binding", "", "b"), ("module_binding", "", "c"), ("instance_attribute", "D", "x")}
    kinds = spark.createDataFrame([("module_binding",), ("class_slot",), ("instance_attribute",)], "kind string")
    d = pystate.declarations(files)
    got = {r.kind: (r.declared, r.visited, r.visited_share) for r in joins.census(d, d.where("name = 'A'"), d.limit(0), kinds).collect()}
    assert got == {"module_binding": (3, 1, 0.333333), "class_slot": (0, 0, None), "instance_attribute": (1, 0, 0.0)}
