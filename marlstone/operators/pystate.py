"""What state a Python module keeps, and what its functions decide by it: one kernel a file, folds over its rows.

State is a module's name that some function writes, or an attribute of self written outside `__init__`: what is written once
is a constant.  Each read is followed to where it is used, through locals to a depth of three, and has one of these kinds:

* FINITE: a decision by a comparison with constants, by truth, by a literal key or the arms of a match; `classes` counts the cases;
* UNBOUNDED: a decision by a value that can be any, an open key, or a loop over the state;
* UNDECIDED: the value goes where this can't be read, with the reason;
* NONE: it reaches no decision.

This is a reading of fewer shapes than a syntax-directed classifier of all would have: what it doesn't know is UNDECIDED."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.clauses import FUNCTIONS, MUTATORS, last_name, written_names
from marlstone.operators.pysource import _parsed
from marlstone.operators.verdicts import partition_rollup, verdict_fold

REASONS = ["external_boundary", "unmodeled_callee", "dynamic_dispatch", "injected_slot", "unmodeled_construct", "unparsed_region", "mutable_alias"]
CARRIED = frozenset("bool int float str len abs round sorted list tuple set frozenset dict min max sum any all repr copy deepcopy".split())
SAID = frozenset("print debug info warning error exception format join write append add".split())
DEPTH = 3
Reach = tuple[str, str, int, bool, bool, str | None]  # kind, key, classes, ordered, counted, reason
NOTHING: Reach = ("NONE", "", 0, True, True, None)


def _finite(key: str, classes: int, ordered: bool) -> Reach:
    return "FINITE", key, classes, ordered, True, None


def _open(key: str) -> Reach:
    return "UNBOUNDED", key, 0, False, False, None


def _silent(reason: str) -> Reach:
    return "UNDECIDED", reason, 0, False, False, reason


class _Reader:
    """Follows reads in one function."""

    def __init__(self, function: ast.AST, parents: dict[ast.AST, ast.AST], known: set[str]):
        self.function, self.parents, self.known = function, parents, known

    def reach(self, node: ast.AST, key: str, depth: int) -> list[Reach]:
        """Where a value goes; `key` says by what literal key it was read."""
        while True:
            up = self.parents.get(node)
            if isinstance(up, ast.Subscript) and up.value is node:
                if not isinstance(up.ctx, ast.Load):
                    return [NOTHING]
                key = ast.unparse(up.slice) if isinstance(up.slice, ast.Constant) else "*"
            elif isinstance(up, ast.Attribute):
                call = self.parents.get(up)
                if isinstance(call, ast.Call) and call.func is up:
                    if up.attr in MUTATORS:
                        return [NOTHING]
                    if up.attr == "get" and call.args:
                        key = ast.unparse(call.args[0]) if isinstance(call.args[0], ast.Constant) else "*"
                    elif up.attr not in ("keys", "values", "items", "copy", "strip", "lower", "upper", "startswith", "endswith", "split"):
                        return [_silent("dynamic_dispatch")]
                    node = call
                    continue
            elif isinstance(up, ast.Compare):
                return [self._compared(up, node, key)]
            elif isinstance(up, (ast.If, ast.While, ast.IfExp, ast.Assert)) and up.test is node:
                return [_open("cell") if key == "*" else _finite(f"truth {key}", 2, False)]
            elif isinstance(up, ast.comprehension):
                return [_open("loop")] if up.iter is node else [_finite(f"truth {key}", 2, False)]
            elif isinstance(up, (ast.For, ast.AsyncFor)) and up.iter is node:
                return [_open("loop")]
            elif isinstance(up, ast.Match) and up.subject is node:
                return [_finite("match", len(up.cases) + 1, False)]
            elif isinstance(up, ast.Call):
                if up.func is node:
                    return [_silent("injected_slot")]
                name = last_name(up)
                if name in CARRIED and isinstance(up.func, ast.Name):
                    node = up
                    continue
                if name in SAID:
                    return [NOTHING]
                return [_silent("unmodeled_callee" if name in self.known else "external_boundary" if isinstance(up.func, ast.Name) else "dynamic_dispatch")]
            elif isinstance(up, (ast.Assign, ast.AnnAssign)) and up.value is node:
                target = up.targets[0] if isinstance(up, ast.Assign) else up.target
                if not isinstance(target, ast.Name):
                    return [_silent("mutable_alias")] if isinstance(node, (ast.Name, ast.Attribute)) else [NOTHING]
                if depth >= DEPTH:
                    return [_silent("unmodeled_construct")]
                uses = [n for n in ast.walk(self.function) if isinstance(n, ast.Name) and n.id == target.id and isinstance(n.ctx, ast.Load)]
                return [r for n in uses for r in self.reach(n, key, depth + 1)] or [NOTHING]
            elif isinstance(up, (ast.Return, ast.Expr, ast.Yield, ast.YieldFrom, ast.AugAssign, ast.Delete, ast.Raise)) or up is None:
                return [NOTHING]
            elif not isinstance(up, (ast.UnaryOp, ast.BoolOp, ast.BinOp, ast.JoinedStr, ast.FormattedValue, ast.Tuple, ast.List, ast.Set, ast.Dict, ast.Starred, ast.keyword, ast.IfExp, ast.Await, ast.NamedExpr)):
                return [_silent("unmodeled_construct")]
            elif isinstance(up, ast.keyword):
                node = up  # the call above decides
                continue
            node = up

    def _compared(self, up: ast.Compare, node: ast.AST, key: str) -> Reach:
        sides = [up.left, *up.comparators]
        others = [s for s in sides if s is not node]
        member = any(isinstance(o, (ast.In, ast.NotIn)) for o in up.ops)
        constants = [s for s in others if isinstance(s, ast.Constant) or isinstance(s, ast.UnaryOp) and isinstance(s.operand, ast.Constant)]
        closed = [s for s in others if isinstance(s, (ast.Tuple, ast.List, ast.Set)) and all(isinstance(e, ast.Constant) for e in s.elts)]
        if key == "*" or len(constants) + len(closed) < len(others):
            return _open("cell")
        if closed and member:
            return _finite(f"in {ast.unparse(closed[0])}", len(closed[0].elts) + 1, False)
        number = all(isinstance(getattr(c, "operand", c).value, (int, float)) and not isinstance(getattr(c, "operand", c).value, bool) for c in constants)
        return _finite(f"{key} {'member ' if member else ''}{','.join(ast.unparse(c) for c in constants)}", 2, number and not member)


def reads_of(tree: ast.Module) -> Iterator[tuple]:
    """(state, line, kind, key, classes, ordered, counted, reason) of every read of state."""
    parents = {child: node for node in ast.walk(tree) for child in ast.iter_child_nodes(node)}
    functions = [n for n in ast.walk(tree) if isinstance(n, FUNCTIONS)]
    names = {f.name for f in functions}
    held = {t.id for s in tree.body if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)}
    turned = {x for x in held & set().union(*(written_names(f) for f in functions)) if not x.startswith("__")} if functions else set()

    def owner(f: ast.AST) -> str:
        at = parents.get(f)
        while at is not None and not isinstance(at, ast.ClassDef):
            at = parents.get(at)
        return at.name if at else ""

    def touched(n: ast.AST) -> bool:
        """Whether an attribute is written here: stored, stored into, or changed by a method."""
        up = parents.get(n)
        stored = isinstance(n.ctx, (ast.Store, ast.Del)) or isinstance(up, ast.Subscript) and up.value is n and not isinstance(up.ctx, ast.Load)
        return stored or isinstance(up, ast.Attribute) and up.attr in MUTATORS and isinstance(parents.get(up), ast.Call)

    slots: set[tuple[str, str]] = set()
    for f in functions:
        for n in ast.walk(f) if f.name != "__init__" else []:
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and touched(n):
                slots.add((owner(f), n.attr))
    for f in functions:
        reader, made = _Reader(f, parents, names), {a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]}
        declared = {x for n in ast.walk(f) if isinstance(n, ast.Global) for x in n.names}
        made |= {n.id for n in ast.walk(f) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} - declared
        for n in ast.walk(f):
            if not isinstance(getattr(n, "ctx", None), ast.Load):
                continue
            if isinstance(n, ast.Name) and n.id in turned - made:
                state = n.id
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and (owner(f), n.attr) in slots:
                state = f"{owner(f)}.{n.attr}"
            else:
                continue
            yield from ((state, n.lineno, *r) for r in reader.reach(n, "", 0))


def declared_of(tree: ast.Module) -> Iterator[tuple]:
    """(kind, owner, name) of what declares state: module bindings, class slots, attributes of self."""
    for s in tree.body:
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
        if isinstance(target, ast.Name):
            yield "module_binding", "", target.id
    for c in (n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)):
        for s in c.body:
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            if isinstance(target, ast.Name):
                yield "class_slot", c.name, target.id
        held = {n.attr for n in ast.walk(c) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and isinstance(n.ctx, ast.Store)}
        yield from (("instance_attribute", c.name, name) for name in sorted(held))


_S, _N, _B = pa.string(), pa.int64(), pa.bool_()


def reads(files: DataFrame) -> DataFrame:
    """(path, state, ord, line, kind, key, classes, ordered, counted, reason) of (path, text), in source order."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        return [(path, r[0], i, *r[1:]) for i, r in enumerate(reads_of(tree))] if tree else []

    schema = pa.schema([("path", _S), ("state", _S), ("ord", _N), ("line", _N), ("kind", _S), ("key", _S), ("classes", _N), ("ordered", _B), ("counted", _B), ("reason", _S)])
    return files.select("path", "text").mapInArrow(_parsed(emit, schema), "path string, state string, ord long, line long, kind string, key string, classes long, ordered boolean, counted boolean, reason string")


def declarations(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name) of the declarations that a census counts."""

    def emit(path: str, text: str, tree: ast.Module | None) -> list[tuple]:
        return [(path, *d) for d in declared_of(tree)] if tree else []

    return files.select("path", "text").mapInArrow(_parsed(emit, pa.schema([("path", _S), ("kind", _S), ("owner", _S), ("name", _S)])), "path string, kind string, owner string, name string")


def classified(files: DataFrame) -> DataFrame:
    """(path, state, line, verdict, drives, classes, ordered, counted, reason): a row for each piece of state.

    The partition is that of its finite reads, the last of equal keys; `reason` is the first undecided read's."""
    rows = reads(files).withColumn("_k", F.concat_ws("\u0001", "path", "state"))
    folded = verdict_fold(rows, "_k")
    parts = partition_rollup(rows.where("kind = 'FINITE'").select("_k", F.col("key").alias("name"), "ord", "classes", "ordered", "counted"), "_k")
    where = rows.groupBy("_k", "path", "state").agg(F.min("line").alias("line"), F.min_by("reason", F.when(F.col("kind") == "UNDECIDED", F.col("ord"))).alias("reason"))
    joined = where.join(folded, "_k").join(parts, "_k", "left")
    return joined.select("path", "state", "line", "verdict", "drives", F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("ordered", F.lit(True)).alias("ordered"), F.coalesce("counted", F.lit(True)).alias("counted"), F.when(F.col("verdict") == "unresolved", F.col("reason")).alias("reason"))


def distribution(states: DataFrame, by: list[str]) -> DataFrame:
    """(by…, neutral, drives, promiscuous, unresolved, verdict, resolvable): counts, the worst verdict, and the share that was decided.

    The share is 1 over nothing: code without state has nothing that couldn't be read."""
    n = states.groupBy(*by).agg(
        F.count_if(F.col("verdict") == "neutral").alias("neutral"), F.count_if((F.col("verdict") == "neutral") & F.col("drives")).alias("drives"),
        F.count_if(F.col("verdict") == "promiscuous").alias("promiscuous"), F.count_if(F.col("verdict") == "unresolved").alias("unresolved"),
    )
    total = F.col("neutral") + F.col("promiscuous") + F.col("unresolved")
    worst = F.when(F.col("promiscuous") > 0, "promiscuous").when(F.col("unresolved") > 0, "unresolved").otherwise("neutral")
    return n.select("*", worst.alias("verdict"), F.round(F.coalesce(F.try_divide(F.col("neutral") + F.col("promiscuous"), total), F.lit(1.0)), 6).alias("resolvable"))


def bounded(states: DataFrame) -> DataFrame:
    """(path, state) whose decisions could be counted: a reference to them isn't one to unbounded state."""
    return states.where("verdict = 'neutral' AND drives AND counted").select("path", F.regexp_replace("state", r"^\w+\.", "self.").alias("state"))
