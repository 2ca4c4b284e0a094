"""Nineteen clauses about Python (two about browser code), read by one kernel a file.

The kernel says of each file and clause whether it holds, what breaks it, or why it isn't decided: `never` for a
clause that no file can decide, `not applicable` for a question that doesn't arise, `unreadable` for one that does
but couldn't be read.  Allowances and the share of clauses that hold are relational."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.joins import allowed

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SHAPES = frozenset("TypedDict Protocol Exception Enum IntEnum StrEnum NamedTuple ABC ABCMeta BaseException Generic object".split())
RESOURCES = frozenset("connect Connection Session create_engine socket open Client Pool ClientSession connect_async acquire".split())
EDGES = frozenset("boundary boundary_in boundary_out edge entrypoint entry_point".split())
IO = frozenset("read_text read_bytes write_text write_bytes open iterdir glob Popen check_output urlopen execute fetchall fetchone commit listdir makedirs remove".split())
VERBS = frozenset("get post put delete patch request run head".split())
CLIENTS = frozenset("requests httpx session client urllib aiohttp subprocess conn connection cursor db".split())
CACHES = frozenset("redis memcache memcached pylibmc diskcache aiocache".split())
MEMOS = frozenset("lru_cache cache cached memoize cached_property".split())
STORES = "redux zustand mobx vuex pinia recoil jotai localStorage sessionStorage".split()
DOM = "addEventListener querySelector querySelectorAll getElementById innerHTML createElement appendChild".split()
MOCKS = frozenset("Mock MagicMock AsyncMock patch mock_open NonCallableMock".split())
HOOKS = frozenset("register signal on_event add_event_handler atexit".split())
HOOK_DECORATORS = frozenset("atexit on_event listens_for add_event_handler before_request after_request receiver".split())
RECORDERS = frozenset("append add extend fail error insert".split())
SIGNALS = frozenset("SystemExit KeyboardInterrupt GeneratorExit".split())
MUTATORS = frozenset("append extend update pop clear setdefault add remove insert popitem sort discard".split())
STEPS = frozenset("given when then step".split())
SCALARS = frozenset("int str float bool bytes list dict set tuple".split())
LITERALS = (ast.Constant, ast.List, ast.Dict, ast.Set, ast.Tuple)
BROWSER = frozenset("javascript typescript html".split())
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "html": "html"}
TEST_CLAUSES = (10, 15)
Row = tuple[str, int]


def last_name(node: ast.AST) -> str:
    """The last part of a dotted name, of what is called if it is a call."""
    return ast.unparse(node.func if isinstance(node, ast.Call) else node).rsplit(".", 1)[-1]


def _on(node: ast.AST, name: str) -> bool:
    return isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == name


class Module:
    """One parsed file, with its nodes sorted by what the clauses ask for."""

    def __init__(self, path: str, tree: ast.Module):
        self.path, self.tree, self.nodes = path, tree, list(ast.walk(tree))
        self.functions = [n for n in self.nodes if isinstance(n, FUNCTIONS)]
        self.classes = [n for n in self.nodes if isinstance(n, ast.ClassDef)]
        self.calls = [n for n in self.nodes if isinstance(n, ast.Call)]
        self.values: dict[str, ast.expr] = {}
        for s in tree.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) and s.value else []
            self.values |= {t.id: s.value for t in targets if isinstance(t, ast.Name)}
        bases = {c.name: set(self.bases(c)) for c in self.classes}
        known, size = {"Exception", "BaseException"}, 0
        while size != len(known):  # a class of exceptions is one however deep its bases
            size = len(known)
            known |= {name for name, of in bases.items() if of & known}
        self.shapes = SHAPES | known

    @staticmethod
    def bases(c: ast.ClassDef) -> list[str]:
        return [ast.unparse(b).split("[")[0].rsplit(".", 1)[-1] for b in c.bases]

    @staticmethod
    def methods(c: ast.ClassDef) -> list[ast.FunctionDef]:
        return [n for n in c.body if isinstance(n, FUNCTIONS)]


def _chains(m: Module) -> Iterator[Row]:
    for top in (n for n in m.nodes if isinstance(n, ast.If)):
        arms, at = [], top
        while isinstance(at, ast.If):
            t = at.test
            plain = isinstance(t, ast.Compare) and isinstance(t.left, ast.Name) and len(t.ops) == 1
            arms.append(t.left.id if plain and isinstance(t.ops[0], (ast.Eq, ast.Is)) and isinstance(t.comparators[0], ast.Constant) else None)
            at = at.orelse[0] if len(at.orelse) == 1 else None
        if len(arms) > 2 and None not in arms and len(set(arms)) == 1:
            yield arms[0], top.lineno


def _passive(method: ast.AST) -> bool:
    """Whether nothing is stored on self and no method of it is called."""
    inside = list(ast.walk(method))
    stored = any(_on(n, "self") and not isinstance(n.ctx, ast.Load) for n in inside)
    return not stored and not any(isinstance(n, ast.Call) and _on(n.func, "self") for n in inside)


def _data_classes(m: Module) -> Iterator[Row]:
    for c in m.classes:
        by_name = {f.name: f for f in m.methods(c)}
        init = by_name.get("__init__")
        if init is None or set(m.bases(c)) & m.shapes or any(last_name(n) in RESOURCES for n in ast.walk(init) if isinstance(n, ast.Call)):
            continue
        if all(_passive(f) for f in m.methods(c) if f.name != "__init__"):
            yield c.name, c.lineno


def _methods(m: Module) -> Iterator[Row]:
    for c in m.classes:
        for f in m.methods(c) if not set(m.bases(c)) & SHAPES else []:
            if not f.name.startswith("__") and _passive(f) and any(_on(n, "self") for n in ast.walk(f)):
                yield f"{c.name}.{f.name}", f.lineno


def _does_io(f: ast.AST) -> bool:
    for n in ast.walk(f):
        if isinstance(n, ast.Call):
            name = last_name(n)
            if name in IO or name in VERBS and isinstance(n.func, ast.Attribute) and ast.unparse(n.func.value).rsplit(".", 1)[-1].lower() in CLIENTS:
                return True
    return False


def _decorators(f: ast.AST) -> list[list[str]]:
    """What each decorator names, part by part; what it carries as arguments doesn't count."""
    return [ast.unparse(d.func if isinstance(d, ast.Call) else d).split(".") for d in f.decorator_list]


def _inner_io(m: Module) -> Iterator[Row]:
    called = {last_name(n) for f in m.functions for n in ast.walk(f) if isinstance(n, ast.Call) and last_name(n) != f.name}
    for f in m.functions:
        if f.name in called and not any(EDGES & set(d) for d in _decorators(f)) and _does_io(f):
            yield f.name, f.lineno


def _inheritance(m: Module) -> Iterator[Row]:
    return ((c.name, c.lineno) for c in m.classes if set(m.bases(c)) - m.shapes)


def _swallows(body: list[ast.stmt]) -> bool:
    rest = [s for s in body if not isinstance(s, ast.Pass)]
    if any(isinstance(n, ast.Raise) for s in rest for n in ast.walk(s)) or len(rest) > 1:
        return False
    if not rest:
        return True
    v = rest[0].value if isinstance(rest[0], ast.Return) else rest[0]
    if isinstance(rest[0], ast.Return):
        return v is None or isinstance(v, ast.Constant) and not v.value or isinstance(v, (ast.List, ast.Set, ast.Tuple)) and not v.elts or isinstance(v, ast.Dict) and not v.keys
    return False


def _handlers(m: Module) -> Iterator[Row]:
    for t in (n for n in m.nodes if isinstance(n, ast.Try)):
        end = t.body[-1]
        records = isinstance(end, (ast.Assert, ast.Raise)) or isinstance(end, ast.Expr) and isinstance(end.value, ast.Call) and last_name(end.value) in RECORDERS
        if len(t.body) > 1 and records:  # reaching the last statement is the failure there, so the handler is success
            continue
        for h in t.handlers:
            caught = {last_name(x) for x in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type])} if h.type else set()
            if _swallows(h.body) and not (caught and caught <= SIGNALS):
                yield ast.unparse(h.type) if h.type else "everything", h.lineno


def _caches(m: Module) -> Iterator[Row]:
    for n in m.nodes:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            for name in [a.name.split(".")[0] for a in n.names] + [(getattr(n, "module", None) or "").split(".")[0]]:
                if name in CACHES:
                    yield name, n.lineno
        elif isinstance(n, FUNCTIONS) and any(d[-1] in MEMOS for d in _decorators(n)):
            yield n.name, n.lineno


def is_test_module(path: str) -> bool:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.startswith("test_") or name.endswith("_test.py") or "/tests/" in path


def _mocks(m: Module) -> Iterator[Row] | None:
    if not is_test_module(m.path):
        return None
    return ((f.name, f.lineno) for f in m.functions if f.name.startswith("test") and sum(isinstance(n, ast.Call) and last_name(n) in MOCKS for n in ast.walk(f)) >= 3)


def _rechecks(m: Module) -> Iterator[Row]:
    for f in m.functions:
        typed = {a.arg for a in f.args.args + f.args.kwonlyargs if a.annotation is not None and ast.unparse(a.annotation).split("[")[0] in SCALARS}
        for n in ast.walk(f):
            if isinstance(n, ast.Call) and last_name(n) == "isinstance" and n.args and isinstance(n.args[0], ast.Name) and n.args[0].id in typed:
                yield f"{f.name}({n.args[0].id})", n.lineno


def _resources(m: Module) -> Iterator[Row]:
    for c in m.classes:
        if {"__enter__", "__aenter__"} & {f.name for f in m.methods(c)}:
            continue
        for s in (n for f in m.methods(c) for n in ast.walk(f) if isinstance(n, ast.Assign)):
            if isinstance(s.value, ast.Call) and last_name(s.value) in RESOURCES:
                yield from ((f"{c.name}.{t.attr}", s.lineno) for t in s.targets if _on(t, "self"))


def written_names(f: ast.AST) -> set[str]:
    """The names that a function declares global, assigns, stores into or changes by a method."""
    out: set[str] = set()
    for n in ast.walk(f):
        if isinstance(n, ast.Global):
            out |= set(n.names)
        elif isinstance(n, (ast.Assign, ast.AugAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                t = t.value if isinstance(t, ast.Subscript) else t
                out |= {t.id} if isinstance(t, ast.Name) else set()
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in MUTATORS and isinstance(n.func.value, ast.Name):
            out.add(n.func.value.id)
    return out


def _knobs(m: Module) -> Iterator[Row]:
    writes = {f: written_names(f) for f in m.functions}
    turned = set().union(*writes.values()) & set(m.values) if writes else set()
    for f in m.functions:
        if not writes[f] & turned:
            yield from ((f"{f.name}({x})", f.lineno) for x in sorted({n.id for n in ast.walk(f) if isinstance(n, ast.Name)} & turned))


def _literal(d: ast.expr) -> bool:
    while isinstance(d, ast.UnaryOp):
        d = d.operand
    return isinstance(d, LITERALS)


def literal_defaults(f: ast.AST) -> Iterator[str]:
    plain = f.args.args
    pairs = [*zip(plain[len(plain) - len(f.args.defaults) :], f.args.defaults, strict=True), *zip(f.args.kwonlyargs, f.args.kw_defaults, strict=True)] if len(f.args.defaults) <= len(plain) else []
    return (a.arg for a, d in pairs if d is not None and _literal(d))


def _defaults(m: Module) -> Iterator[Row]:
    return ((f"{f.name}({a})", f.lineno) for f in m.functions for a in literal_defaults(f))


def _steps(m: Module) -> Iterator[Row] | None:
    steps = [f for f in m.functions if any(d[-1] in STEPS for d in _decorators(f))]
    return ((f.name, f.lineno) for f in steps if f.end_lineno - f.lineno > 30) if steps else None


def _hooks(m: Module) -> Iterator[Row]:
    for n in m.calls:
        whole = ast.unparse(n.func)
        if whole.split(".")[0] in ("atexit", "signal") and last_name(n) in HOOKS:
            yield whole, n.lineno
    yield from ((f.name, f.lineno) for f in m.functions for d in _decorators(f) if HOOK_DECORATORS & set(d))


def _open_tables(m: Module) -> Iterator[Row]:
    for n in m.calls:
        if isinstance(n.func, ast.Attribute) and n.func.attr == "get" and len(n.args) > 1 and isinstance(n.func.value, ast.Name):
            key = ast.dump(n.args[0])
            if isinstance(m.values.get(n.func.value.id), ast.Dict) and all(ast.dump(x) != key for x in ast.walk(n.args[1])):
                yield n.func.value.id, n.lineno


def _races(m: Module) -> Iterator[Row]:
    shared = sorted(k for k, v in m.values.items() if isinstance(v, (ast.Dict, ast.List, ast.Set)))
    for f in m.functions:
        inside = list(ast.walk(f))
        for name in shared:
            read = next((n.lineno for n in inside if isinstance(n, ast.Name) and n.id == name and isinstance(n.ctx, ast.Load)), None)
            write = next((n.lineno for n in inside if isinstance(n, ast.Subscript) and isinstance(n.ctx, ast.Store) and isinstance(n.value, ast.Name) and n.value.id == name), None)
            if read is not None and write is not None and write > read:
                yield f"{f.name}({name})", read


def _mentions(text: str, words: list[str]) -> Iterator[Row]:
    for word in words:
        if word in text:
            yield word, text[: text.index(word)].count("\n") + 1


TREE = {
    1: _chains, 2: _data_classes, 3: _methods, 4: _inner_io, 5: _inheritance, 8: _handlers, 9: _caches, 10: _mocks, 11: _rechecks,
    12: _resources, 13: _knobs, 14: _defaults, 15: _steps, 16: _hooks, 18: _open_tables, 19: _races,
}
TEXT = {6: STORES, 7: DOM}
_ROW = pa.schema([("path", pa.string()), ("clause", pa.int64()), ("status", pa.string()), ("symbol", pa.string()), ("line", pa.int64())])


def judged(path: str, text: str) -> Iterator[tuple[int, str, str | None, int | None]]:
    """(clause, status, symbol, line) of a file: found, holds, never, not applicable or unreadable."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1]) if "." in path else None
    module = None
    if language == "python":
        try:
            module = Module(path, ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            language = None
    for clause in range(1, 20):
        if clause == 17:
            yield clause, "never", None, None
        elif language is None or clause in TREE and module is None:
            yield clause, "unreadable", None, None
        else:
            rows = TREE[clause](module) if clause in TREE else _mentions(text, TEXT[clause]) if language in BROWSER else None
            if rows is None:
                yield clause, "not applicable", None, None
                continue
            some = False
            for symbol, line in rows:
                some = True
                yield clause, "found", symbol, line
            if not some:
                yield clause, "holds", None, None


def clauses(files: DataFrame) -> DataFrame:
    """(path, clause, status, symbol, line) of (path, text): a row for each finding, and one for each clause without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if p is not None for r in judged(p, t or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in rows], _ROW)

    return files.select("path", "text").mapInArrow(run, "path string, clause long, status string, symbol string, line long")


def notes(files: DataFrame) -> DataFrame:
    """(path, clause, line, reason): comments that allow a clause on their line and the three below, as
    `…-allow: L1.21.<clause> - <reason>`; those without a reason are none."""
    lines = files.where(F.col("text").contains("-allow:")).select("path", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    form = r"-allow:\s*L1\.21\.(\d+)\s*[-—:]+\s*(\S.*?)\s*$"
    got = lines.select("path", F.regexp_extract("l", form, 1).try_cast("long").alias("clause"), (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("l", form, 2).alias("reason"))
    return got.where("clause IS NOT NULL")


def findings(files: DataFrame) -> DataFrame:
    """(path, clause, symbol, line, reason): what breaks clauses, with the reason where it is allowed."""
    found = clauses(files).where("status = 'found'").drop("status")
    return allowed(found, notes(files)).select("path", "clause", "symbol", "line", "reason")


def conformity(files: DataFrame, by: list[str]) -> DataFrame:
    """(by…, decided, broken, value, band) of (by…, path, text, is_test): the share of decided clauses that no file breaks.

    Clauses about tests are decided on tests alone, all others on the rest; what is allowed breaks nothing."""
    rows = allowed(clauses(files), notes(files))
    told = rows.join(files.select(*by, "path", "is_test"), "path")
    told = told.where((F.col("clause").isin(*TEST_CLAUSES) == F.col("is_test")) & F.col("status").isin("found", "holds"))
    per = told.groupBy(*by, "clause").agg(F.bool_or((F.col("status") == "found") & F.col("reason").isNull()).alias("broken"))
    n = per.groupBy(*by).agg(F.count("*").alias("decided"), F.count_if("broken").alias("broken"))
    share = (F.col("decided") - F.col("broken")) * 100.0 / F.col("decided")
    band = F.when(share >= 95, "Healthy").when(share >= 75, "Not Healthy").otherwise("Slop")
    return n.select(*by, "decided", "broken", F.round(share, 1).alias("value"), band.alias("band"))


def hook_lines(files: DataFrame) -> DataFrame:
    """(path, report): what breaks clauses in each file, a line for each finding; files without have no row."""
    open_ = findings(files).where("reason IS NULL")
    said = F.format_string("%s:%d L1.21.%d %s", "path", "line", "clause", "symbol")
    return open_.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "clause", said.alias("said")))), lambda x: x["said"]), "\n").alias("report"))
