"""Python source read by one kernel a file: decisions, dead lines, definitions and uses, escapes, shared state, flow, roles.

Everything after the kernels' rows is relational.  A file that doesn't parse gives one row of kind `unreadable`,
so that what was not read is never counted as clean."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.bands import band_of, guarded
from marlstone.operators import joins
from marlstone.operators.clauses import FUNCTIONS, MUTATORS, last_name
from marlstone.operators.flows import path_cover

ENDS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
CONTAINERS = frozenset("dict list set defaultdict OrderedDict Counter deque".split())
READS = {
    **dict.fromkeys("read_text read_bytes iterdir glob rglob exists is_file is_dir stat listdir walk".split(), "filesystem"),
    "getenv": "environment", "input": "stdin", **dict.fromkeys("run Popen check_output".split(), "subprocess"), "import_module": "import",
}
WRITES = {**dict.fromkeys("write_text write_bytes mkdir unlink rmdir rename touch makedirs remove".split(), "filesystem"), "print": "stdout", "write": "file"}
Row = tuple


def decision_points(tree: ast.AST) -> Iterator[Row]:
    """One for each if, elif and conditional expression, and for each arm of a match; an else is none."""
    for node in ast.walk(tree):
        if isinstance(node, (ast.If, ast.IfExp)):
            yield type(node).__name__, node.lineno
        elif isinstance(node, ast.match_case):
            yield "case", node.pattern.lineno


def unreachable(tree: ast.AST) -> Iterator[Row]:
    """The lines of statements after the first one of their block that ends it."""
    for node in ast.walk(tree):
        for block in (getattr(node, f, None) for f in ("body", "orelse", "finalbody")):
            if isinstance(block, list):
                end = next((i for i, s in enumerate(block) if isinstance(s, ENDS)), len(block))
                for s in block[end + 1 :]:
                    for line in range(s.lineno, s.end_lineno + 1):
                        yield type(s).__name__, line


def _mutable(value: ast.AST | None) -> bool:
    literal = isinstance(value, (ast.Dict, ast.List, ast.Set, ast.DictComp, ast.ListComp, ast.SetComp))
    return literal or isinstance(value, ast.Call) and ast.unparse(value.func) in CONTAINERS


def _globals(tree: ast.Module) -> dict[str, tuple[ast.AST, int]]:
    out = {}
    for s in tree.body:
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
        if isinstance(target, ast.Name):
            out[target.id] = (s.value, s.lineno)
    return out


def thread_surface(tree: ast.Module) -> Iterator[Row]:
    """(severity:kind:name, line): state that threads would share.  Only mutable defaults count in a file that starts no threads."""
    nodes = list(ast.walk(tree))
    for f in (n for n in nodes if isinstance(n, (*FUNCTIONS, ast.Lambda))):
        plain = [*f.args.posonlyargs, *f.args.args]
        for a, d in [*zip(plain[len(plain) - len(f.args.defaults) :], f.args.defaults, strict=True), *zip(f.args.kwonlyargs, f.args.kw_defaults, strict=True)]:
            if _mutable(d):
                yield f"review:mutable_default_arg:{a.arg}", d.lineno
    imported = {a.name.split(".")[0] for n in tree.body if isinstance(n, ast.Import) for a in n.names} | {(n.module or "").split(".")[0] for n in tree.body if isinstance(n, ast.ImportFrom)}
    called = {last_name(n) for n in nodes if isinstance(n, ast.Call)}
    if not imported & {"threading", "multiprocessing", "concurrent"} and not called & {"Thread", "Process", "ThreadPoolExecutor", "ProcessPoolExecutor"}:
        return
    named = {n.id for n in nodes if isinstance(n, ast.Name)} | {n.attr for n in nodes if isinstance(n, ast.Attribute)} | {a.name for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names}
    locked = bool(named & {"Lock", "RLock", "Semaphore", "BoundedSemaphore", "Condition", "Barrier"}) or "acquire" in called
    shared = {name: line for name, (value, line) in _globals(tree).items() if _mutable(value)}
    for n in (n for n in nodes if isinstance(n, ast.If)):
        seen = {c.id for t in ast.walk(n.test) if isinstance(t, ast.Compare) and any(isinstance(o, (ast.In, ast.NotIn)) for o in t.ops) for c in t.comparators[-1:] if isinstance(c, ast.Name)}
        changed = {x.value.id for s in n.body + n.orelse for x in ast.walk(s) if isinstance(x, ast.Subscript) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name)}
        changed |= {x.func.value.id for s in n.body + n.orelse for x in ast.walk(s) if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in MUTATORS and isinstance(x.func.value, ast.Name)}
        yield from ((f"review:check_then_act:{name}", n.lineno) for name in sorted(seen & changed & set(shared)))
    for f in (n for n in nodes if isinstance(n, FUNCTIONS)):
        inside = list(ast.walk(f))
        declared = {x for n in inside if isinstance(n, ast.Global) for x in n.names}
        for n in inside:
            if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name) and n.target.id in declared:
                yield f"{'candidate' if locked else 'review'}:nonatomic_rmw:{n.target.id}", n.lineno
    kind = "review:possibly_unguarded_shared_state" if locked else "exposed:unguarded_shared_state"
    yield from ((f"{kind}:{name}", line) for name, line in shared.items())


def branches(tree: ast.AST) -> Iterator[Row]:
    """(function:kind:first line of the body, line) of the decisions of every function that is no test, nested ones apart."""
    for f in ast.walk(tree):
        if not isinstance(f, FUNCTIONS) or f.name.startswith("test"):
            continue
        left = list(f.body)
        while left:
            n = left.pop(0)
            if isinstance(n, FUNCTIONS):
                continue
            found = []
            if isinstance(n, ast.If):
                found = [("elif" if getattr(n, "_elif", False) else "if", n.lineno, n.body)]
                nested = len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset
                if nested:
                    n.orelse[0]._elif = True
                elif n.orelse:
                    found.append(("else", n.orelse[0].lineno, n.orelse))
            elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
                found = [("while" if isinstance(n, ast.While) else "for", n.lineno, n.body)]
            elif isinstance(n, ast.Match):
                found = [("case", c.pattern.lineno, c.body) for c in n.cases]
            yield from ((f"{f.name}:{kind}:{body[0].lineno}", line) for kind, line, body in found)
            left[:0] = list(ast.iter_child_nodes(n))


def roles(tree: ast.AST) -> Iterator[Row]:
    """(function:role, line): writes to the outside, reads from it, calls of siblings, or none of these, in that order."""
    functions = [n for n in ast.walk(tree) if isinstance(n, FUNCTIONS)]
    names = {f.name for f in functions}
    for f in functions:
        inside = list(ast.walk(f))
        made = {n.name for n in inside if isinstance(n, (*FUNCTIONS, ast.ClassDef))} | {n.id for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        reads, writes, calls = False, any(isinstance(n, ast.Global) for n in inside), False
        for n in inside:
            reads |= isinstance(n, ast.Attribute) and n.attr == "environ"
            if not isinstance(n, ast.Call):
                continue
            name = last_name(n)
            if name == "open":
                mode = next((k.value for k in n.keywords if k.arg == "mode"), n.args[1] if len(n.args) > 1 else None)
                out = isinstance(mode, ast.Constant) and bool(re.search("[wax+]", str(mode.value)))
                writes, reads = writes or out, reads or not out
            elif name in ("setattr", "delattr"):
                writes |= not (n.args and isinstance(n.args[0], ast.Name) and n.args[0].id in made - {f.name})
            writes |= name in WRITES
            reads |= name in READS
            calls |= name in names - {f.name}
        role = "boundary_out" if writes else "boundary_in" if reads else "orchestrator" if calls else "pure"
        yield f"{f.name}:{role}", f.lineno


def facets(tree: ast.AST) -> Iterator[Row]:
    """(function:facet:name, line): the parameters, returned expressions and raised exceptions of every function that is no test."""
    for f in (n for n in ast.walk(tree) if isinstance(n, FUNCTIONS) and not n.name.startswith("test")):
        yield from ((f"{f.name}:region:{a.arg}", a.lineno) for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs] if a.arg not in ("self", "cls"))
        for n in ast.walk(f):
            if isinstance(n, ast.Return) and n.value is not None:
                yield f"{f.name}:return:{ast.unparse(n.value)[:80]}", n.lineno
            elif isinstance(n, ast.Raise) and n.exc is not None:
                yield f"{f.name}:exception:{last_name(n.exc)}", n.lineno


def _alias(value: ast.AST | None, annotation: ast.AST | None) -> bool:
    """Whether a module's assignment names a type: a name, a dotted or subscripted one, or a union of those."""
    if annotation is not None and ast.unparse(annotation).split("[")[0] == "TypeAlias":
        return True
    if isinstance(value, ast.BinOp) and isinstance(value.op, ast.BitOr):
        return _alias(value.left, None) and _alias(value.right, None)
    return isinstance(value, (ast.Name, ast.Attribute, ast.Subscript))


def module_state(tree: ast.Module) -> set[str]:
    """The module's names that hold state: not dunders, aliases of types, nor constants by spelling, but for empty containers."""
    out = set()
    for s in tree.body:
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, (ast.AnnAssign, ast.AugAssign)) else None
        if not isinstance(target, ast.Name) or re.fullmatch("__.*__", target.id) or _alias(s.value, getattr(s, "annotation", None)):
            continue
        v = s.value
        empty = isinstance(v, ast.Dict) and not v.keys or isinstance(v, ast.List) and not v.elts or isinstance(v, ast.Call) and ast.unparse(v.func) in CONTAINERS | {"bytearray"} and not v.args and not v.keywords
        if not target.id.isupper() or empty:
            out.add(target.id)
    return out


def state_references(tree: ast.Module) -> Iterator[Row]:
    """(function:state, line): what functions refer to of their object or module; and (function:, line) for each function."""
    held = module_state(tree)
    for f in (n for n in ast.walk(tree) if isinstance(n, FUNCTIONS)):
        yield f"{f.name}@{f.lineno}:", f.lineno
        for n in (x for s in f.body for x in ast.walk(s)):
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
                yield f"{f.name}@{f.lineno}:self.{n.attr}", n.lineno
            elif isinstance(n, ast.Name) and n.id in held:
                yield f"{f.name}@{f.lineno}:{n.id}", n.lineno


RULES: dict[str, Callable[[ast.Module], Iterator[Row]]] = {
    "decision": decision_points, "unreachable": unreachable, "thread": thread_surface, "branch": branches, "role": roles, "facet": facets, "state": state_references,
}


def edges_of(function: ast.AST) -> list[tuple[str, str]]:
    """The flow edges of a function; straight-line code collapses, a raise too, so one without branches has none.

    The arms of an if and its elifs all leave the same place; with none but ifs there is a way around."""
    edges: list[tuple[str, str]] = []
    fresh = iter(range(1 << 30))

    def block(body: list[ast.stmt], at: str | None, out: str, again: str) -> str | None:
        for s in body:
            if at is None:  # what follows a statement that leaves the block can't be walked
                return None
            if isinstance(s, ast.If):
                arms, other = [s.body], s.orelse
                while len(other) == 1 and isinstance(other[0], ast.If) and other[0].col_offset == s.col_offset:
                    arms.append(other[0].body)
                    other = other[0].orelse
                around = len(arms) == 1 and not other
                after, ends = f"n{next(fresh)}", []
                for arm in [*arms, *([other] if other else [])]:
                    start = f"n{next(fresh)}"
                    edges.append((at, start))
                    ends.append(block(arm, start, out, again))
                edges.extend((e, after) for e in ends if e is not None)
                if around:
                    edges.append((at, after))
                at = after if around or any(e is not None for e in ends) else None
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                head, after, start = (f"n{next(fresh)}" for _ in range(3))
                edges.extend([(at, head), (head, start), (head, after)])
                end = block(s.body, start, after, head)
                if end is not None:
                    edges.append((end, head))
                at = after
            elif isinstance(s, ast.Match):
                after = f"n{next(fresh)}"
                for case in s.cases:
                    start = f"n{next(fresh)}"
                    edges.append((at, start))
                    end = block(case.body, start, out, again)
                    if end is not None:
                        edges.append((end, after))
                edges.append((at, after))
                at = after
            elif isinstance(s, (ast.Try, ast.With, ast.AsyncWith)):
                at = block(s.body, at, out, again)
            elif isinstance(s, ast.Return):
                edges.append((at, "exit"))
                return None
            elif isinstance(s, (ast.Break, ast.Continue)):
                edges.append((at, out if isinstance(s, ast.Break) else again))
                return None
        return at

    last = block(function.body, "entry", "exit", "entry")
    if last is not None:
        edges.append((last, "exit"))
    return edges


def _parsed(emit: Callable[[str, str, ast.Module | None], list[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    tree = None
                rows += emit(path, text or "", tree)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


_S, _N = pa.string(), pa.int64()


def findings(files: DataFrame) -> DataFrame:
    """(path, kind, symbol, line) of (path, text)."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        if tree is None:
            return [(path, "unreadable", None, None)]
        return [(path, k, s, n) for k, rule in RULES.items() for s, n in rule(tree)]

    schema = pa.schema([("path", _S), ("kind", _S), ("symbol", _S), ("line", _N)])
    return files.select("path", "text").mapInArrow(_parsed(emit, schema), "path string, kind string, symbol string, line long")


def flow_edges(files: DataFrame) -> DataFrame:
    """(func, u, v) of the functions of (path, text); one without branches has the single edge from entry to exit."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        found = [n for n in ast.walk(tree) if isinstance(n, FUNCTIONS)] if tree else []
        return [(f"{path}:{n.lineno}:{n.name}", u, v) for n in found for u, v in edges_of(n) or [("entry", "exit")]]

    schema = pa.schema([("func", _S), ("u", _S), ("v", _S)])
    return files.select("path", "text").mapInArrow(_parsed(emit, schema), "func string, u string, v string")


def function_covers(files: DataFrame) -> DataFrame:
    """(func, paths): the least number of walks through each function."""
    return path_cover(flow_edges(files), "func")


def cover_total(files: DataFrame) -> DataFrame:
    """(functions, paths): the sum over all functions, at least 1 each."""
    return function_covers(files).agg(F.count("*").alias("functions"), F.coalesce(F.sum(F.greatest("paths", F.lit(1))), F.lit(0)).alias("paths"))


def line_count(files: DataFrame) -> DataFrame:
    return files.where("text <> ''").agg(F.coalesce(F.sum(F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n"))), F.lit(0)).alias("loc"))


def dead_line_ratio(files: DataFrame) -> DataFrame:
    """(loc, flagged, value): distinct unreachable lines per line of code; NULL where nothing was read."""
    flagged = findings(files).where("kind = 'unreachable'").agg(F.count_distinct("path", "line").alias("flagged"))
    return line_count(files).crossJoin(flagged).select("loc", "flagged", F.round(guarded(F.col("flagged"), F.col("loc")), 2).alias("value"))  # one row each


# Definitions, uses and the dead.

_RUNNER = re.compile(r"__\w+__$|test_|pytest_|Test[A-Z_]|(setup|teardown)_(module|function)$")


def _offsets(text: str) -> list[int]:
    out = [0]
    for line in text.splitlines(keepends=True):
        out.append(out[-1] + len(line))
    return out


def definitions_of(text: str, tree: ast.Module) -> Iterator[tuple]:
    """(name, kind, line, end_line, start, end, status, reason) of a module's functions, classes and single names."""
    public: set[str] = set()
    for s in tree.body:
        if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) and isinstance(s.value, (ast.List, ast.Tuple)):
            public |= {e.value for e in s.value.elts if isinstance(e, ast.Constant)}
    lines, rows = _offsets(text), text.splitlines(keepends=True)
    at = lambda line, col: lines[line - 1] + len(rows[line - 1].encode()[:col].decode(errors="ignore"))
    for s in tree.body:
        named = isinstance(s, (*FUNCTIONS, ast.ClassDef))
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
        if not named and not isinstance(target, ast.Name):
            continue
        name = s.name if named else target.id
        kind = "class" if isinstance(s, ast.ClassDef) else "function" if named else "constant"
        status, reason = "candidate", ""
        if _RUNNER.match(name):
            status, reason = "excluded", "called by the interpreter or a test runner"
        elif named and s.decorator_list:
            status, reason = "undecidable", "a decorator can register the name"
        elif name in public:
            status, reason = "undecidable", "exported"
        yield name, kind, s.lineno, s.end_lineno, at(s.lineno, s.col_offset), at(s.end_lineno, s.end_col_offset), status, reason


def definitions(files: DataFrame) -> DataFrame:
    """(path, name, kind, line, end_line, start, end, status, reason); files that don't parse have none."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        return [(path, *d) for d in definitions_of(text, tree)] if tree else []

    schema = pa.schema([("path", _S), ("name", _S), ("kind", _S), ("line", _N), ("end_line", _N), ("start", _N), ("end", _N), ("status", _S), ("reason", _S)])
    return files.select("path", "text").mapInArrow(_parsed(emit, schema), "path string, name string, kind string, line long, end_line long, start long, end long, status string, reason string")


def names_used(files: DataFrame) -> DataFrame:
    """(path, name, at): every identifier outside strings and comments, also of files that don't parse, as far as they can be read."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        lines, out = _offsets(text), []
        try:
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                if t.type == tokenize.NAME:
                    out.append((path, t.string, lines[t.start[0] - 1] + t.start[1]))
        except (tokenize.TokenError, SyntaxError, IndexError):
            return out
        return out

    schema = pa.schema([("path", _S), ("name", _S), ("at", _N)])
    return files.select("path", "text").mapInArrow(_parsed(emit, schema), "path string, name string, at long")


def module_level_runs(files: DataFrame) -> DataFrame:
    """(path) of the modules that run something when they are loaded: a bare call, or a main guard."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        calls = tree is not None and any(isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) for s in tree.body)
        return [(path,)] if calls or re.search(r"__name__\s*==\s*[\"']__main__[\"']", text) else []

    return files.select("path", "text").mapInArrow(_parsed(emit, pa.schema([("path", _S)])), "path string")


def dead_code(files: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, line, end_line, verdict, reason) of (path, text, is_test): every module-level definition of production.

    In order: excluded, undecidable, used by production, used by tests alone, named in words (bucket, word), dead.  The
    definitions of a module that no other names are used only if what runs reaches them."""
    production = files.where("NOT is_test")
    found, uses = definitions(production), names_used(files)
    own = uses.join(production.select("path"), "path", "left_semi")
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    lone = joins.islands(production.select("path", stem.alias("stem")), own)
    live = _island_live(found, own, lone, module_level_runs(production))
    candidates = found.where("status = 'candidate'")
    reached = candidates.join(lone.select("path"), "path", "left_anti").unionByName(candidates.join(lone.select("path"), "path", "left_semi").join(live.select(F.col("node").alias("name")), "name", "left_semi").select(candidates.columns))
    key = ["path", "name", "start"]
    by_production = joins.used(reached, own).select(*key).withColumn("_p", F.lit(True))
    by_tests = joins.used(candidates, uses.join(files.where("is_test").select("path"), "path", "left_semi")).select(*key).withColumn("_t", F.lit(True))
    told = found.join(by_production, key, "left").join(by_tests, key, "left")
    soft = F.lit(None).cast("string")
    if words is not None:
        told, soft = joins.soft_reference(told, words, ["config", "strings", "docs"]), F.col("found_in")
    verdict = F.when(F.col("status") != "candidate", F.col("status")).when(F.col("_p"), "used").when(F.col("_t"), "test-only").when(soft.isNotNull(), "undecidable").otherwise("dead")
    return told.select("path", "name", "kind", "line", "end_line", verdict.alias("verdict"), F.when(F.col("status") != "candidate", F.col("reason")).otherwise(soft).alias("reason"))


def _island_live(found: DataFrame, uses: DataFrame, lone: DataFrame, runs: DataFrame) -> DataFrame:
    """(node): the names that are reached in lone modules, from other modules and from what runs at module level."""
    here = found.join(lone.select("path", "stem"), "path")
    sees = uses.select(F.col("path").alias("site"), F.col("name").alias("stem")).distinct()
    sites = here.select(F.col("path").alias("home"), "name", "stem", "start", "end").join(uses.select(F.col("path").alias("site"), "name", "at"), "name")
    inside = (F.col("site") == F.col("home")) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("end"))
    sites = sites.where(~inside)
    sites = sites.where("site = home").unionByName(sites.where("site <> home").join(sees, ["site", "stem"], "left_semi").select(sites.columns))
    spans = here.select(F.col("path").alias("site"), F.col("name").alias("owner"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    owned = sites.alias("x").join(spans.alias("y"), (F.col("x.site") == F.col("y.site")) & (F.col("_s") <= F.col("at")) & (F.col("at") < F.col("_e")), "left")
    owned = owned.groupBy(F.col("x.site").alias("site"), "name", "at").agg(F.min_by("owner", F.col("_e") - F.col("_s")).alias("owner"))
    island = owned.join(lone.select(F.col("path").alias("site")), "site", "left_semi")
    outside = owned.join(lone.select(F.col("path").alias("site")), "site", "left_anti").select("name")
    top = island.where("owner IS NULL").join(runs.select(F.col("path").alias("site")), "site", "left_semi").select("name")
    edges = island.where("owner IS NOT NULL").select(F.col("owner").alias("u"), F.col("name").alias("v")).distinct()
    return joins.reachable(edges, outside.union(top).select(F.col("name").alias("node")))


def dead_ratio(files: DataFrame, words: DataFrame | None = None, least_parsed: float = 0.8) -> DataFrame:
    """(loc, flagged, parsed, value, band): distinct lines of dead definitions and unreachable statements per line of production.

    Refused where there are no lines, or fewer than `least_parsed` of the files parse."""
    production = files.where("NOT is_test")
    dead = dead_code(files, words).where("verdict = 'dead'").select("path", F.explode(F.sequence("line", "end_line")).alias("line"))
    rows = findings(production)
    flagged = dead.union(rows.where("kind = 'unreachable'").select("path", "line")).distinct().agg(F.count("*").alias("flagged"))
    parsed = production.agg(F.count("*").alias("n")).crossJoin(rows.where("kind = 'unreadable'").agg(F.count("*").alias("bad"))).select(F.try_divide(F.col("n") - F.col("bad"), F.col("n")).alias("parsed"))
    value = F.when(F.col("parsed") >= least_parsed, F.round(guarded(F.col("flagged"), F.col("loc")), 2))
    one = line_count(production).crossJoin(flagged).crossJoin(parsed)  # one row each
    return one.select("loc", "flagged", F.round("parsed", 6).alias("parsed"), value.alias("value"), band_of("L1.12", value).alias("band"))


# Escapes from types, and state.


def escapes_of(text: str, tree: ast.Module | None) -> Iterator[int]:
    """The lines of what opts out of types: the name Any but in imports, comments that begin with an ignore, strings in casts."""
    if tree is not None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and n.id == "Any" or isinstance(n, ast.Attribute) and n.attr == "Any":
                yield n.lineno
            elif isinstance(n, ast.Call) and ast.unparse(n.func) == "cast" and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str) and re.search(r"\bAny\b", n.args[0].value):
                yield n.lineno
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT and t.string.startswith("# type: ignore"):
                yield t.start[0]
    except (tokenize.TokenError, SyntaxError):
        return


def type_escapes(files: DataFrame) -> DataFrame:
    """(path, line), one row an escape."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        return [(path, n) for n in escapes_of(text, tree)]

    return files.select("path", "text").mapInArrow(_parsed(emit, pa.schema([("path", _S), ("line", _N)])), "path string, line long")


def escape_density(files: DataFrame) -> DataFrame:
    """(loc, escapes, value, band): escapes per thousand lines, with no floor under the number of lines; none of no lines."""
    value = guarded(F.col("escapes"), F.col("loc"), 1000.0)
    both = line_count(files).crossJoin(type_escapes(files).agg(F.count("*").alias("escapes")))  # one row each
    return both.select("loc", "escapes", F.round(value, 2).alias("value"), band_of("L1.15", value).alias("band"))


def state_ratio(files: DataFrame, bounded: DataFrame | None = None) -> DataFrame:
    """(functions, touching, value, band): the share of functions that refer to state of theirs that isn't bounded (path, state)."""
    rows = findings(files).where("kind = 'state'").select("path", F.substring_index("symbol", ":", 1).alias("func"), F.substring_index("symbol", ":", -1).alias("state"))
    refs = rows.where("state <> ''")
    refs = refs if bounded is None else joins.unbounded_references(refs, bounded)
    n = rows.where("state = ''").agg(F.count("*").alias("functions")).crossJoin(refs.agg(F.count_distinct("path", "func").alias("touching")))  # one row each
    value = guarded(F.col("touching"), F.col("functions"))
    return n.select("functions", "touching", F.round(value, 1).alias("value"), band_of("L1.18", value).alias("band"))


def call_map(files: DataFrame) -> DataFrame:
    """(path, function, role) of every function."""
    rows = findings(files).where("kind = 'role'")
    return rows.select("path", F.substring_index("symbol", ":", 1).alias("function"), F.substring_index("symbol", ":", -1).alias("role"))


