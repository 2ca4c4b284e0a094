"""Groups of things that meet under keys and pass an exact test, however many meet under one key.

A key's things are cut into blocks by a hash, so that no task holds more than a block or two of them.

1. Each block is compared: those already connected are not compared again, so a block of n copies takes
   about n comparisons, and what leaves the task connects the block just as all its pairs would.
2. Only keys of several blocks whose things are not all of one group by then have their blocks compared with
   each other, those of different groups alone.  So every link between any two things that meet is used.

The number of links of a thing is counted inside its group, where all its links are, block against block;
no pair leaves a task.  That takes the square of the largest group's distinct things in comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import components, saved, tidied

BLOCK = 4096
COUNT_BLOCK = 1024
ALL_PAIRS = 24


class Test(Protocol):
    """Says what is linked; `rows` makes the raw bytes (n, width) what the others compare."""

    def rows(self, raw: np.ndarray) -> np.ndarray: ...

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by `cell`, cut where a cell begins."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if tail is not None:
            table = pa.concat_tables([tail, table])
        table = table.combine_chunks()
        cells = table.column("cell").to_numpy()
        at = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        tail = table.slice(at)
        if at:
            yield table.slice(0, at).combine_chunks()
    if tail is not None and tail.num_rows:
        yield tail.combine_chunks()


def _by_width(table: pa.Table, test: Test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, what to compare) of the table's rows, for each width of their data."""
    column = table.column("data")
    column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    widths = np.diff(offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, test.rows(np.ascontiguousarray(raw[offsets[rows][:, None] + np.arange(width)]))


def _cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return starts, np.diff(np.append(starts, len(cells)))


def forest(x: np.ndarray, group: np.ndarray, test: Test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (places) that connect things just as all their links would, given groups known to be connected."""
    _, group = np.unique(group, return_inverse=True)
    left = np.arange(len(x))
    while len(left) > 1 and (group[left] != group[left[0]]).any():
        one, rest = left[0], left[1:]
        rest = rest[group[rest] != group[one]]
        found = rest[test.pairs(x[rest], x[one])]
        if len(found):
            yield np.full(len(found), one), found
            group[np.isin(group, group[found])] = group[one]
        left = left[1:]


def _compared(test: Test):
    def links(cells: np.ndarray, nodes: np.ndarray, groups: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts, sizes = _cells(cells)
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            if size > ALL_PAIRS:
                for s in at:
                    for a, b in forest(x[s : s + size], groups[s : s + size], test):
                        yield nodes[s + a], nodes[s + b]
                continue
            i, j = np.triu_indices(size, 1)
            each = max(1, 100_000 // len(i))
            for part in range(0, len(at), each):
                s = at[part : part + each]
                a, b = (s[:, None] + i).reshape(-1), (s[:, None] + j).reshape(-1)
                apart = groups[a] != groups[b]
                a, b = a[apart], b[apart]
                good = test.pairs(x[a], x[b])
                yield nodes[a[good]], nodes[b[good]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cells, nodes, groups = (table.column(c).to_numpy() for c in ("cell", "node", "group"))
            found = [np.stack(p, axis=1) for rows, x in _by_width(table, test) for p in links(cells[rows], nodes[rows], groups[rows], x)]
            both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            both = np.unique(np.sort(both, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return tidied(run)


def _block(size: Column, most: int) -> tuple[Column, Column]:
    """(block, number of blocks) of a row of a group of that size."""
    blocks = F.ceil(size / F.lit(most)).cast("long")
    return F.pmod(F.xxhash64("node"), blocks), blocks


def _sent(rows: DataFrame, data: DataFrame) -> DataFrame:
    """Rows (cell, node, …) with the data of their nodes, each cell's together."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.join(data, "node").repartition(parts, "cell").sortWithinPartitions("cell")


def links(posts: DataFrame, data: DataFrame, test: Test, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect the nodes of `posts` (key, node, n) as all links do of nodes that share a key.

    `n` is at least the number of the key's posts; `data` has (node, data BINARY)."""
    sub, blocks = _block(F.col("n"), block)
    posts, _ = saved(posts.withColumn("blocks", blocks).withColumn("sub", sub), "posts")
    edges_schema = "a long, b long"
    first = posts.select(F.xxhash64("key", "sub").alias("cell"), "node", F.col("node").alias("group"))
    found, _ = saved(_sent(first, data).mapInArrow(_compared(test), edges_schema), "links")
    if posts.where("blocks > 1").limit(1).count() == 0:
        return found
    hot = posts.where("blocks > 1").join(components(found), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    hot, _ = saved(hot, "hot-posts")
    apart = hot.groupBy("key").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high").select("key")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    crossed = hot.join(apart, "key", "left_semi").select("key", "node", "group", "sub", other).where("sub <> other")
    crossed = crossed.select(F.xxhash64("key", F.least("sub", "other"), F.greatest("sub", "other")).alias("cell"), "node", "group")
    more, _ = saved(_sent(crossed, data).mapInArrow(_compared(test), edges_schema), "links")
    return found.union(more)


def _counter(test: Test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cells, nodes, side, one = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "node", "side", "one"))
            n = np.zeros(len(nodes), np.int64)
            for rows, x in _by_width(table, test):
                starts, sizes = _cells(cells[rows])
                for s, size in zip(starts, sizes, strict=True):
                    mine = np.arange(s, s + size)
                    if one[rows[s]]:
                        n[rows[mine]] += test.matrix(x[mine], x[mine]).sum(axis=1) - 1
                    else:
                        a, b = mine[side[rows[mine]] == 0], mine[side[rows[mine]] == 1]
                        linked = test.matrix(x[a], x[b])
                        n[rows[a]] += linked.sum(axis=1)
                        n[rows[b]] += linked.sum(axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(n[some])], names=["node", "n_links"])

    return tidied(run)


def link_counts(roots: DataFrame, data: DataFrame, test: Test, block: int = COUNT_BLOCK) -> DataFrame:
    """(node, n_links): how many other nodes of its group (node, root) each is linked with; nodes without a link may lack."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    sub, blocks = _block(F.col("size"), block)
    rows = roots.join(sizes, "root").withColumn("blocks", blocks).withColumn("sub", sub)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("root", "node", "sub", other)
    cell = F.xxhash64("root", F.least("sub", "other"), F.greatest("sub", "other")).alias("cell")
    rows = rows.select(cell, "node", (F.col("sub") > F.col("other")).cast("int").alias("side"), (F.col("sub") == F.col("other")).alias("one"))
    return _sent(rows, data).mapInArrow(_counter(test), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
