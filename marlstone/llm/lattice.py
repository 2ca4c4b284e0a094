"""Embedding near-duplicates by E8 lattice hashing (operator 9).

A unit vector is projected at random to 8 dimensions per block, `blocks` blocks per table, and each block
is decoded to the nearest point of the lattice E8.  The points of its blocks are a vector's cell, in each
of `tables` tables.  A vector is posted in its own cells and probes these and neighbouring ones: those
reached by the lattice's 240 shortest steps that bring a block's point nearest to the projection, `near`
of them for each block, and the best step of all blocks at once.  Vectors met in a cell are verified by
their cosine, in blocks, and cells that are met in have no cap (see links): a cell of n near copies takes
about n comparisons, and no pair is written but those that connect a class.

Defined results: vectors that are null, empty, zero, or have a null or non-finite component are in no class;
vectors are compared with those of their own dimension only; vectors without an id are left out; a cosine
equal to the least one (a tie) is a link; rows that repeat an id are one vector if they are equal, and else
join the classes of both; equal vectors are a class; vectors of any dimension count whole; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import components, saved, tidied
from marlstone.llm.links import link_counts, links
from marlstone.llm.textvec import mix64

COSINE = 0.95
TABLES = 8
BLOCKS = 2
NEAR = 4
SCALE = 0.75
SEED = 20


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole numbers."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            found.append(v)
    found += [v for v in product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found, np.int64)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8, whole numbers with an even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - point[odd]
        worst = np.abs(off).argmax(axis=1)
        at = np.arange(len(odd))
        point[odd, worst] += np.where(off[at, worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to rows of 8 numbers, doubled: E8 is D8 and D8 moved by a half in all coordinates."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def _hash(points: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of doubled points (n, 8)."""
    with np.errstate(over="ignore"):
        total = np.full(len(points), np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15))
        for j in range(8):
            total = mix64(total + points[:, j].astype(np.uint64))
    return total


def cells(unit: np.ndarray, table: int, blocks: int, near: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(own, probes): the cell of each vector in a table, and the cells that it probes, its own first."""
    n, dim = unit.shape
    own, first = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    hashes, steps = [], []
    for block in range(blocks):
        rng = np.random.default_rng([SEED, dim, table, block])
        x = unit @ (rng.standard_normal((dim, 8)) * scale)
        point = decode(x)
        gain = (2 * x - point) @ roots().T
        best = np.argpartition(-gain, near - 1, axis=1)[:, :near] if near < 240 else np.tile(np.arange(240), (n, 1))
        top = gain.argmax(axis=1)
        hashes.append(_hash(point, table * blocks + block))
        steps.append([_hash(point + roots()[best[:, j]], table * blocks + block) for j in range(best.shape[1])])
        first = first + _hash(point + roots()[top], table * blocks + block)
    with np.errstate(over="ignore"):
        own = sum(hashes[1:], hashes[0])
        probes = [own, *(own - h + s for h, step in zip(hashes, steps, strict=True) for s in step)]
        if blocks > 1:
            probes.append(first)
    salt = mix64(np.array([dim * 1000 + table], np.uint64))[0]
    return mix64(own ^ salt), mix64(np.stack(probes, axis=1) ^ salt)


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each dimension, of the rows that have a direction."""
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.where(valid, size, 0)
    start = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = flat[start[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((x**2).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        if good.any():
            yield rows[good], x[good] / length[good, None]


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, unit in _unit(batch.column("v")):
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * unit.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(unit.reshape(-1).astype(np.float32)))], names=["id", "v"])


def _posts(tables: int, blocks: int, near: int, scale: float):
    """(node, key, own): every cell that a vector probes, and whether it is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            for lo in range(0, len(ids), 4096):
                for rows, unit in _unit(batch.column("v").slice(lo, 4096)):
                    mine = ids[lo + rows]
                    for table in range(tables):
                        _, probes = cells(unit, table, blocks, near, scale)
                        each = probes.shape[1]
                        own = np.tile(np.arange(each) == 0, len(mine))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, each)), pa.array(probes.reshape(-1).view(np.int64)), pa.array(own)], names=["node", "key", "own"])

    return tidied(run)


class Cosine:
    """Unit vectors of at least that cosine."""

    def __init__(self, least: float):
        self.least = least

    def rows(self, raw: np.ndarray) -> np.ndarray:
        return raw.view(np.float32).astype(np.float64)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x * y).sum(axis=-1) >= self.least

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x @ y.T >= self.least


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("v")
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        ends = np.asarray(column.offsets).astype(np.int64)
        ends = pa.array(((ends - ends[0]) * 4).astype(np.int32)) if len(ends) else pa.array([0], pa.int32())
        data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("node"), data], names=["node", "data"])


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, near: int = NEAR, scale: float = SCALE) -> DataFrame:
    """(vec_id, class_id, n_links, n_copies) of every vector that is in a class with another.

    `class_id` is the least id of the class; `n_copies` the number of ids of an equal vector; `n_links` the number of
    other vectors of the class, equal ones counted once, of at least that cosine.  Vectors without a row are alone."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    unit = rows.mapInArrow(_normal, "id long, v array<float>").withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    unit, _ = saved(unit.distinct(), "vectors")
    reps = unit.groupBy("h1", "h2").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("node"), F.count("*").alias("n_copies"))
    reps, _ = saved(reps, "representatives")
    posts, _ = saved(reps.mapInArrow(_posts(tables, blocks, near, scale), "node long, key long, own boolean"), "cells")
    # Cells in which nothing can meet are dropped before any vector is sent to one.
    met = posts.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("own").alias("owned")).where("n > 1 AND owned").select("key", "n")
    data = reps.select("node", "v").mapInArrow(_packed, "node long, data binary")
    found = links(posts.select("key", "node").join(met, "key"), data, Cosine(cosine))
    several = unit.select("id", "h1", "h2").join(reps.select("h1", "h2", "node"), ["h1", "h2"]).groupBy("id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    roots = components(found.union(several.select("a", F.explode("all").alias("b"))))
    groups = roots.join(link_counts(roots, data, Cosine(cosine)), "node", "left")
    kept = reps.select("h1", "h2", "node", "n_copies").join(groups, "node", "left").where("n_copies > 1 OR root IS NOT NULL")
    members = unit.select("id", "h1", "h2").join(kept, ["h1", "h2"])
    return members.groupBy(F.col("id").alias("vec_id")).agg(F.min(F.coalesce("root", "node")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.max("n_copies").alias("n_copies"))

