"""Line deduplication by probing a sharded minimal perfect hash (operator 6).

1. Documents are bundled, a file of the shared folder each.  A bundle posts its distinct line keys (64-bit
   hashes of the trimmed lines), sorted, each with the number of its documents that have it and the least doc_id.
2. The keys are split into shards by their leading bits, as many as they fill.  A shard's task counts its keys
   over all bundles and builds a minimal perfect hash by cascading bit arrays: of every level, the keys that are
   alone on their bit stay, the others go to the next.  Arrays in the order of the hash hold a 16-bit
   fingerprint, the count and the bundle of the least doc_id of each key.  A shard is a file of the shared folder.
3. The task probes its arrays for each bundle and sends bits back.  So each shard is read by one task, once,
   and no line travels: a bundle's task cuts lines by the bits.

A line that is the second or later one of its kind in its document goes, and so does one that at least
`least_docs` documents have, but for one occurrence in the corpus: the first in the document of the least
doc_id (a null one is the greatest; one row, any, of those that share it).  Blank lines stay.  No document is
exempt and no count is capped.

Defined results: a null text stays null, an empty one empty, with no lines dropped; a row without doc_id
is treated like any other row, as a document of its own; repeated rows are documents of their own; lines
end at a newline only; a text of any length is read whole; exactly `least_docs` documents (a tie) are enough
to drop a line; an empty table gives an empty one; other columns are kept as they are by `line_dedup`, whatever
their names, and ignored by `line_report`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import fresh, saved, scratch_path, tidied
from marlstone.llm.store import get, put
from marlstone.llm.textvec import PLAIN, chunks, mix64, span_hashes, utf8

LEAST_DOCS = 4
KEYS_PER_SHARD = 1 << 19
BUNDLE_BYTES = 1 << 23
MOST_TASKS = 100_000
GAMMA = 2.0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 11, 12, 13, 32]] = True
_NEWLINE = 10


class PerfectHash:
    """A minimal perfect hash of distinct uint64 keys with a fingerprint, a count and perhaps a place for each.

    Levels of one bit per cell, `gamma` cells for every key left; the rank of a key's bit is its index."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, places: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.words, self.places, self.prints, self.counts = sizes, words, places, prints, counts
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = mix64(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        return ((mixed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, places: np.ndarray | None = None, gamma: float = GAMMA) -> PerfectHash:
        sizes, bits, left, level = [], [], np.arange(len(keys)), 0
        while len(left):
            size = -(-max(64, int(gamma * len(left))) // 64) * 64
            cell = cls._cell(keys[left], level, size)
            alone = np.bincount(cell, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[cell]]
            level += 1
        cells = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(cells, bitorder="little").view(np.uint64) if len(cells) else np.zeros(0, np.uint64)
        kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
        made = cls(np.array(sizes, np.int64), words, np.zeros(0 if places is None else len(keys), np.int64), np.zeros(len(keys), np.uint16), np.zeros(len(keys), kind))
        at = made.index(keys)
        made.prints[at] = cls._print(keys)
        made.counts[at] = counts
        if places is not None:
            made.places[at] = places
        return made

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for one that no level has."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            cell = self._cell(keys[left], level, int(size)) + self.starts[level]
            word, bit = cell >> 6, (cell & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            word, bit = word[here], bit[here]
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = self.ranks[word] + below
            left = left[~here]
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 where the fingerprint says that it is another."""
        return self.found(keys)[0]

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, and its place: -1 where the count is 0 or the index has no places."""
        at = self.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == self._print(keys[known])
        out, places = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        out[known] = self.counts[at[known]]
        if len(self.places):
            places[known] = self.places[at[known]]
        return out, places

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.places), len(self.prints), self.counts.dtype.itemsize], np.int64)
        return b"".join(x.tobytes() for x in (head, self.sizes, self.words, self.places, self.prints, self.counts))

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        levels, words, places, keys, width = (int(x) for x in np.frombuffer(raw, np.int64, 5))
        at, parts = 40, []
        for n, kind in ((levels, np.int64), (words, np.uint64), (places, np.int64), (keys, np.uint16), (keys, np.dtype(f"u{width}"))):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*parts)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: starts, ends (with the newline), keys (0 for a blank one) and rows."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    some = offsets[:-1][np.diff(offsets) > 0]
    breaks = np.flatnonzero(data == _NEWLINE) + 1
    starts = np.union1d(some, breaks[breaks < n])
    ends = np.append(starts[1:], n)
    row = np.searchsorted(offsets, starts, side="right") - 1
    solid = ~_SPACE[data] & (data != _NEWLINE)
    place = np.flatnonzero(solid)
    first = np.searchsorted(place, starts)
    last = np.searchsorted(place, ends) - 1
    blank = last < first
    if len(place) == 0:
        return starts, ends, np.zeros(len(starts), np.uint64), row
    a = np.where(blank, starts, place[np.minimum(first, len(place) - 1)])
    b = np.where(blank, starts, place[np.maximum(last, 0)] + 1)
    with np.errstate(over="ignore"):
        keys = mix64(span_hashes(data, PLAIN, a, b) + (b - a).astype(np.uint64))
    keys[blank] = 0
    return starts, ends, keys, row


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): the distinct lines of each row, without blank ones."""
    data, offsets = utf8(column)
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in chunks(offsets):
        _, _, keys, row = lines_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        new = keys != 0
        new[1:] &= (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        found.append(keys[new])
        rows.append(row[new] + lo)
    return np.concatenate(found), np.concatenate(rows)


_POSTS = "bundle long, n long, keys binary, docs binary, first binary"
_ROUTED = "shard long, " + _POSTS.replace(" n long,", "")
_ANSWERS = "bundle long, shard long, n long, drop binary, own binary"


def _first_rows(keys: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, number of rows of each, its row of the least doc)."""
    order = np.lexsort((rows, doc[rows], keys))
    distinct, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
    return distinct, counts, rows[order[first]]


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return out.getvalue()


def _bundler(folder: str, doc: str, size: int):
    """Writes bundles of rows of about `size` bytes of text, and posts their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, size):
                part = batch.slice(lo, hi - lo)
                # A name of its own for each attempt: the posts of those that don't count are never read, nor are their files.
                bundle = int(np.random.default_rng().integers(1 << 62))
                put(folder, str(bundle), _ipc(part))
                ids = part.column(doc).to_numpy()
                keys, counts, first = _first_rows(*_held(part.column("text")), ids)
                values = ([bundle], [len(keys)], [keys.tobytes()], [counts.astype(np.uint32).tobytes()], [ids[first].tobytes()])
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["bundle", "n", "keys", "docs", "first"])

    return tidied(run)


def _router(shards: int):
    """A row for each bundle and shard; one at least for each bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                keys, docs, first = np.frombuffer(x["keys"], np.uint64), np.frombuffer(x["docs"], np.uint32), np.frombuffer(x["first"], np.int64)
                edges = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(edges)) if len(keys) else np.zeros(1, np.int64)
                cut = [[v[edges[s] : edges[s + 1]].tobytes() for s in some] for v in (keys, docs, first)]
                arrays = [pa.array(some.astype(np.int64)), pa.array([x["bundle"]] * len(some), pa.int64()), *(pa.array(c, pa.binary()) for c in cut)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "bundle", "keys", "docs", "first"])

    return run


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _prober(folder: str, least_docs: int):
    """Builds each shard's index, writes it, and probes it for every bundle."""

    def answers(shard: int, rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
        bundles = np.array([r[0] for r in rows], np.int64)
        each = [np.frombuffer(r[1], np.uint64) for r in rows]
        keys, docs, first = np.concatenate(each), np.frombuffer(b"".join(r[2] for r in rows), np.uint32), np.frombuffer(b"".join(r[3] for r in rows), np.int64)
        of = np.repeat(bundles, [len(k) for k in each])
        order = np.lexsort((of, first, keys))
        start = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])) if len(keys) else np.zeros(0, np.int64)
        totals = np.add.reduceat(docs[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        index = PerfectHash.build(keys[order[start]], totals, of[order[start]])
        put(folder, str(shard), index.dump())
        drops, owns = [], []
        for bundle, mine in zip(bundles, each, strict=True):
            count, keeper = index.found(mine)
            drop = count >= least_docs
            own = drop & (keeper == bundle)
            drops.append(np.packbits(drop).tobytes())
            owns.append(np.packbits(own).tobytes() if own.any() else b"")
        n = pa.array([len(k) for k in each], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(bundles), pa.array([shard] * len(rows), pa.int64()), n, pa.array(drops, pa.binary()), pa.array(owns, pa.binary())], names=["bundle", "shard", "n", "drop", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = -1, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "bundle", "keys", "docs", "first")), strict=True):
                if shard != current and rows:
                    yield answers(current, rows)
                    rows = []
                current = shard
                rows.append(tuple(row))
        if rows:
            yield answers(current, rows)

    return tidied(run)


class LineIndex:
    """The sharded index that a run leaves in the shared folder."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The number of documents that have each of the keys, one shard in memory at a time; 0 for unknown ones, but for 1 in 65,536."""
        out, shard = np.zeros(len(keys), np.int64), _shard(keys, self.shards)
        for s in np.unique(shard):
            raw = get(self.folder, str(s))
            if raw is not None:
                out[shard == s] = PerfectHash.load(raw).count(keys[shard == s])
        return out


def _without(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, drop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of rows without the lines to drop, and the new size of each row.

    A row whose last line goes, and had no newline, ends without that of the line before."""
    if not drop.any():
        return data.tobytes(), np.diff(offsets)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start[drop], 1)
    np.add.at(edge, end[drop], -1)
    kept = np.cumsum(edge, dtype=np.int8)[:-1] == 0
    last = offsets[1:][np.diff(offsets) > 0]
    begin = offsets[:-1][np.diff(offsets) > 0]
    cut = ~kept[last - 1] & (data[last - 1] != _NEWLINE)
    if cut.any():
        live = np.flatnonzero(kept)
        tail = np.searchsorted(live, last[cut]) - 1
        spot = live[np.maximum(tail, 0)] if len(live) else np.zeros(len(tail), np.int64)
        fix = (tail >= 0) & (spot >= begin[cut]) & (data[spot] == _NEWLINE)
        kept[spot[fix]] = False
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kept, out=total[1:])
    return data[kept].tobytes(), np.diff(total[offsets])


def _cleaned(table: pa.RecordBatch, doc: str, drop_key: np.ndarray, own_key: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without repeated lines, lines of each row, lines dropped of each) of a bundle, by the bits of its sorted keys."""
    column = table.column("text")
    data, offsets = utf8(column)
    starts, ends, keys, rows = [], [], [], []
    for lo, hi in chunks(offsets):
        a, b, k, r = lines_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        starts.append(a + offsets[lo])
        ends.append(b + offsets[lo])
        keys.append(k)
        rows.append(r + lo)
    n = len(column)
    if not starts:
        return column, np.zeros(n, np.int64), np.zeros(n, np.int64)
    start, end, key, row = (np.concatenate(x) for x in (starts, ends, keys, rows))
    solid = key != 0
    drop = np.zeros(len(key), bool)
    if solid.any():
        known, _, keeper = _first_rows(key[solid], row[solid], table.column(doc).to_numpy())
        at = np.searchsorted(known, key[solid])
        drop[solid] = drop_key[at] & ~(own_key[at] & (keeper[at] == row[solid]))
    order = np.lexsort((start, key, row))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    drop = (drop | again) & solid
    lines, dropped = np.bincount(row, minlength=n), np.bincount(row, weights=drop, minlength=n).astype(np.int64)
    if not drop.any():
        return column, lines, dropped
    parts, sizes = [], []
    for lo, hi in chunks(offsets):
        mine = slice(*np.searchsorted(row, [lo, hi]))
        base = offsets[lo]
        part, size = _without(data[base : offsets[hi]], offsets[lo : hi + 1] - base, start[mine] - base, end[mine] - base, drop[mine])
        parts.append(part)
        sizes.append(size)
    new = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    made = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(new.tobytes()), pa.py_buffer(b"".join(parts))])
    return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), made) if column.null_count else made, lines, dropped


def _cleaner(folder: str, doc: str, report: bool):
    def clean(bundle: int, drops: list[np.ndarray], owns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(get(folder, str(bundle))) as stream:
            for part in stream:
                text, lines, dropped = _cleaned(part, doc, np.concatenate(drops), np.concatenate(owns))
                names = [c for c in part.schema.names if c != doc]
                columns = [text.cast(pa.string()) if c == "text" else part.column(c) for c in names]
                if report:
                    names, columns = [*names, "lines", "dropped"], [*columns, pa.array(lines.astype(np.int64)), pa.array(dropped)]
                done = pa.RecordBatch.from_arrays(columns, names=names)
                for at in range(0, done.num_rows, 2000):
                    yield done.slice(at, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, drops, owns = None, [], []
        for batch in batches:
            for bundle, n, drop, own in zip(*(batch.column(c).to_pylist() for c in ("bundle", "n", "drop", "own")), strict=True):
                if bundle != current and drops:
                    yield from clean(current, drops, owns)
                    drops, owns = [], []
                current = bundle
                drops.append(np.unpackbits(np.frombuffer(drop, np.uint8), count=n).astype(bool))
                owns.append(np.unpackbits(np.frombuffer(own, np.uint8), count=n).astype(bool) if own else np.zeros(n, bool))
        if drops:
            yield from clean(current, drops, owns)

    return tidied(run)


def _run(docs: DataFrame, least_docs: int, keys_per_shard: int, bundle_bytes: int, report: bool) -> tuple[DataFrame, LineIndex]:
    spark = docs.sparkSession
    typed, doc = docs.withColumn("text", F.col("text").cast("string")), fresh("doc", docs)
    bundles, index = scratch_path(spark, "line-bundles"), scratch_path(spark, "line-index")
    rows = typed.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    posts, _ = saved(rows.mapInArrow(_bundler(bundles, doc, bundle_bytes), _POSTS), "line-posts")
    keys, n = posts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-keys // keys_per_shard))
    # As many tasks as there is work, which adaptive planning must not merge: a row stands for a shard's part or a whole bundle.
    routed = posts.mapInArrow(_router(shards), _ROUTED).repartitionById(min(shards, MOST_TASKS), (F.col("shard") % MOST_TASKS).cast("int")).sortWithinPartitions("shard")
    answers = routed.mapInArrow(_prober(index, least_docs), _ANSWERS)
    answers = answers.repartition(max(1, min(n, MOST_TASKS)), "bundle").sortWithinPartitions("bundle", "shard")
    more = [T.StructField("lines", T.LongType()), T.StructField("dropped", T.LongType())] if report else []
    return answers.mapInArrow(_cleaner(bundles, doc, report), T.StructType([*typed.schema.fields, *more])), LineIndex(index, shards)


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, keys_per_shard: int = KEYS_PER_SHARD, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """`docs`, with all its columns and rows, `text` without repeated lines: of those of many documents one occurrence stays."""
    return _run(docs, least_docs, keys_per_shard, bundle_bytes, False)[0]


def line_report(docs: DataFrame, least_docs: int = LEAST_DOCS, keys_per_shard: int = KEYS_PER_SHARD, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(doc_id, text, lines, dropped): the text without repeated lines, and the numbers of lines before and dropped."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(rows, least_docs, keys_per_shard, bundle_bytes, True)[0]


def sql(least_docs: int = LEAST_DOCS, table: str = "documents") -> str:
    """DuckDB SQL for `line_report`."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {table}),
pieces AS (
  SELECT rid, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM docs WHERE text IS NOT NULL AND text <> ''),
lines AS (
  SELECT rid, doc_id, i, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS k,
         i = max(i) OVER (PARTITION BY rid) AS final FROM pieces),
known AS (
  SELECT k, count(DISTINCT rid) AS n, first(rid ORDER BY doc_id NULLS LAST, rid) AS keeper FROM lines WHERE k <> '' GROUP BY k),
marked AS (
  SELECT l.rid, l.i, l.line, l.final,
         l.k <> '' AND (coalesce(n, 0) >= {least_docs} AND l.rid <> keeper OR row_number() OVER (PARTITION BY l.rid, l.k ORDER BY l.i) > 1) AS gone
  FROM lines l LEFT JOIN known ON l.k = known.k),
cleaned AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS dropped,
         count(*) FILTER (NOT (final AND line = '')) AS lines FROM marked GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       CAST(coalesce(c.lines, 0) AS BIGINT) AS lines, CAST(coalesce(c.dropped, 0) AS BIGINT) AS dropped
FROM docs d LEFT JOIN cleaned c ON d.rid = c.rid"""
