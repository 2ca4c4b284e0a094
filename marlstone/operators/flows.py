"""Ordered folds of edits, and minimum covers of flow graphs: the parts that are kernels over one group."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MANY = 10**9


def least_cover(edges: list[tuple[str, str]], entry: str = "entry", exit_: str = "exit") -> int:
    """How many walks from entry to exit cover every edge: a flow of at least 1 on each edge, made least; 1 without edges.

    First every edge is given 1 and what the nodes lack is sent along paths; then flow is pushed back from exit to entry."""
    if not edges:
        return 1
    cap: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    need: dict[str, int] = defaultdict(int)
    for u, v in edges:
        cap[u][v] += MANY
        cap[v][u] += 0
        need[v] += 1
        need[u] -= 1
    cap[exit_][entry] += MANY
    cap[entry][exit_] += 0

    def push(s: str, t: str) -> int:
        sent = 0
        while True:
            parent, queue = {s: s}, deque([s])
            while queue and t not in parent:
                x = queue.popleft()
                for y, c in cap[x].items():
                    if c > 0 and y not in parent:
                        parent[y] = x
                        queue.append(y)
            if t not in parent:
                return sent
            path, x = [], t
            while x != s:
                path.append((parent[x], x))
                x = parent[x]
            room = min(cap[a][b] for a, b in path)
            for a, b in path:
                cap[a][b] -= room
                cap[b][a] += room
            sent += room

    for node, n in list(need.items()):
        if n > 0:
            cap["\0s"][node] = n
            cap[node]["\0s"] = 0
        elif n < 0:
            cap[node]["\0t"] = -n
            cap["\0t"][node] = 0
    push("\0s", "\0t")
    total = MANY - cap[exit_][entry]
    cap[exit_][entry] = cap[entry][exit_] = 0
    return max(1, total - push(exit_, entry))


def path_cover(edges: DataFrame, key: str) -> DataFrame:
    """(key, paths) of (key, u, v): the least number of walks that cover each group's graph.

    Graphs recur, so each distinct one is solved once, many in a batch."""
    graphs = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [least_cover([(e["u"], e["v"]) for e in g]) for g in batch.column("edges").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(paths, pa.int64())], names=["h", "paths"])

    named = graphs.select(key, F.sha2(F.to_json("edges"), 256).alias("h"), "edges")
    distinct = named.groupBy("h").agg(F.first("edges").alias("edges"))
    return named.select(key, "h").join(distinct.mapInArrow(solve, "h string, paths long"), "h").select(key, "paths")


class Replay:
    """The state of one file under writes and edits, and the counts that say how far to trust it."""

    def __init__(self, current: str | None = None, tally: tuple[int, int, int, int] = (0, 0, 0, 0)):
        self.current = current
        self.writes, self.applied, self.divergences, self.unanchored = tally

    def take(self, kind: str, content: str | None, old: str | None, new: str | None, every: bool | None) -> None:
        if kind == "write":
            self.current = content or ""
            self.writes += 1
        elif self.current is None:
            self.unanchored += 1
        elif (old or "") not in self.current:
            self.divergences += 1
        else:
            self.current = self.current.replace(old or "", new or "") if every else self.current.replace(old or "", new or "", 1)
            self.applied += 1

    @property
    def tally(self) -> tuple[int, int, int, int]:
        return self.writes, self.applied, self.divergences, self.unanchored


EVENT = ["ord", "kind", "content", "old", "new", "replace_all"]


def edit_replay(events: DataFrame, key: str) -> DataFrame:
    """(key, writes, applied, divergences, unanchored, verified, spans, final) of (key, ord, kind, content, old, new, replace_all).

    A span between two writes is verified if its edits turn the first into the second.  Equal events (without replace_all) are
    one, the first by `seq` where there is such a column; those of one `ord` are applied in its order."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state, span, spans, verified = Replay(), None, 0, 0
        for row in frame.sort_values(["ord", "seq"], kind="stable").itertuples():
            if row.kind == "write" and span is not None:
                spans += 1
                verified += not span.divergences and span.current == (row.content or "")
            if row.kind == "write":
                span = Replay(row.content or "")
            elif span is not None:
                span.take(row.kind, row.content, row.old, row.new, row.replace_all)
            state.take(row.kind, row.content, row.old, row.new, row.replace_all)
        return pd.DataFrame([[frame[key].iloc[0], *state.tally, verified, spans, state.current]], columns=[key, "writes", "applied", "divergences", "unanchored", "verified", "spans", "final"])

    schema = f"{key} {dict(events.dtypes)[key]}, writes long, applied long, divergences long, unanchored long, verified long, spans long, final string"
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    first = events.select(key, *EVENT, seq.alias("seq")).groupBy(key, "ord", "kind", "content", "old", "new").agg(F.min(F.struct("seq", "replace_all")).alias("_first"))
    place = F.dense_rank().over(Window.partitionBy(key).orderBy("_first.seq")) if "seq" in events.columns else F.lit(0)
    rows = first.select(key, "ord", "kind", "content", "old", "new", F.col("_first.replace_all").alias("replace_all"), place.cast("long").alias("seq"))
    return rows.groupBy(key).applyInPandas(fold, schema)


def anchor_spans(events: DataFrame, key: str) -> DataFrame:
    """(key, span, edits): the events after each write up to the next, span 0 before the first."""
    number = F.sum((F.col("kind") == "write").cast("long")).over(Window.partitionBy(key).orderBy("ord"))
    return events.withColumn("span", number).groupBy(key, "span").agg(F.count_if(F.col("kind") != "write").alias("edits"))
