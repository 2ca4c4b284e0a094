"""Substring deduplication by level-wise doubling (operator 8).

Level 0 finds every window of `base` words that at least two documents have; a window of twice the length
can only repeat if both its halves do, so windows repeated at one length alone are extended to twice that
length, and so on until no candidates survive.  Windows start at every word.

Level 0 would post a hash for every word of the corpus.  Most are spared by an exact filter: two windows
of the same words have the same least hash over their runs of `gram` words, so first only these minima
are posted, a few for each `base` words, and then only windows whose minimum two documents have.

Posts travel packed.  Texts are bundled, a file of the shared folder each.  For each bucket of hashes a
bundle sends one row with its distinct hashes, sorted and coded by their differences; the bucket's task
finds those that two documents have and sends back one bit for each, a row for each bundle.  Between
levels a bundle's file keeps the places that survive and their hashes; the hash of a doubled window is
made from those of its halves, so that no later level reads texts.  Files of levels done with are removed.

The result has, for every document, the maximal runs of words covered by repeated windows of `least`
words; `longest` is the longest window in the run that repeats as a whole, by levels.

`without_repeats` cuts passages: of every repeated window of `least` words the first occurrence stays, in the
order in which the rows are read, and the words that any later one covers go, with what follows them up to the
next word.

Defined results: words are as in textvec, so case of ASCII letters, punctuation and space do not matter;
texts that are null, empty or shorter than `least` words have no passages; a text of any length is read
whole; exactly `least` words (a tie) are enough; a passage repeated only within one row does not count; each row
is a document, so a row that occurs twice repeats; rows without a doc_id are left out by `repeated_passages` and
treated as any other by `without_repeats`; an empty table gives an empty one; other columns, whatever their
names, are ignored by the first and kept by the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, remove, saved, scratch_path, texts, tidied
from marlstone.llm.store import get_arrays, put_arrays
from marlstone.llm.textvec import _powers, chunks, mix64, shingle_hashes, utf8, word_hashes, word_spans

BASE_WORDS = 25
GRAM_WORDS = 8
LEAST_WORDS = 50
BUNDLE_BYTES = 1 << 23
BUCKET_BYTES = 1 << 25
MOST_TASKS = 100_000
_DOUBLE = np.uint64(0xA24BAED4963EE407)


def _bundles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about `size` bytes of text."""
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for lo, hi in chunks(offsets, size):
            yield batch.slice(lo, hi - lo)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and where each row's begin."""
    parts, ends, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in chunks(offsets):
        words, of_row = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        parts.append(words)
        ends.append(of_row[1:] + total)
        total += len(words)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(ends)


def _minima(words: np.ndarray, of_row: np.ndarray, base: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, minima): the window starts of a row that have `base` words, and the least hash of their runs of `gram` words."""
    counts = np.diff(of_row)
    n = len(words)
    each = np.maximum(counts - base + 1, 0)
    if each.sum() == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, _ = shingle_hashes(words, np.array([0, n]), gram)
    span, width = base - gram + 1, 1
    low = grams
    while width * 2 <= span:  # the minimum over a span, by doubling widths
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    first = np.cumsum(each) - each
    places = np.arange(each.sum()) + np.repeat(of_row[:-1] - first, each)
    return places, low[places]


def _runs(words: np.ndarray, of_row: np.ndarray, base: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, run of each place, key of each run, row of each run): neighbouring windows of a row with one minimum are a run.

    The key is the minimum, mixed again: minima are small numbers, which would crowd into the first buckets."""
    places, minima = _minima(words, of_row, base, gram)
    row = np.searchsorted(of_row, places, side="right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (minima[1:] != minima[:-1]) | (row[1:] != row[:-1])
    return places, np.cumsum(new) - 1, mix64(minima[new]), row[new]


def packed(keys: np.ndarray) -> bytes:
    """Sorted uint64 as differences, byte by byte of all, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


class _Posts:
    """The distinct keys of a bundle's items, and which of them two rows of the bundle have."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.unique, self.first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        low = np.full(len(self.unique), np.iinfo(np.int64).max)
        high = np.full(len(self.unique), -1)
        np.minimum.at(low, self.inverse, rows)
        np.maximum.at(high, self.inverse, rows)
        self.multi = low < high

    def rows(self, bundle: int, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        bucket = self._bucket(buckets)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[b], edges[b + 1])
            yield int(b), bundle, packed(self.unique[mine]), np.packbits(self.multi[mine]).tobytes()

    def _bucket(self, buckets: int) -> np.ndarray:
        return ((self.unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def _flags(self, found: dict[str, np.ndarray] | None, buckets: int, prefix: str = "") -> np.ndarray:
        flags = np.zeros(len(self.unique), bool)
        if found:
            edges = np.searchsorted(self._bucket(buckets), np.arange(buckets + 1))
            for name, bits in found.items():
                if name.startswith(prefix) and name[len(prefix) :].isdigit():
                    b = int(name[len(prefix) :])
                    flags[edges[b] : edges[b + 1]] = np.unpackbits(bits, count=edges[b + 1] - edges[b]).astype(bool)
        return flags

    def repeated(self, found: dict[str, np.ndarray] | None, buckets: int) -> np.ndarray:
        """For each item whether its key repeats, by the bits that the buckets sent back."""
        return self._flags(found, buckets)[self.inverse]

    def first_of_all(self, found: dict[str, np.ndarray] | None, buckets: int) -> np.ndarray:
        """For each item whether it is the first of its key: of its bundle, and that one the first that has the key."""
        out = np.zeros(len(self.inverse), bool)
        out[self.first[self._flags(found, buckets, "own")]] = True
        return out


_POSTS = "bucket long, bundle long, keys binary, multi binary"


def _frame(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    bucket, bundle, keys, multi = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(bundle, pa.int64()), pa.array(keys, pa.binary()), pa.array(multi, pa.binary())], names=["bucket", "bundle", "keys", "multi"])


def _bundler(root: str, base: int, gram: int, buckets: int, size: int):
    """Writes the bundles and posts the minima of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = TaskContext.get().partitionId() << 24
        for batch in _bundles(batches, size):
            data, offsets = utf8(batch.column("text"))
            put_arrays(f"{root}/texts", str(bundle), ids=batch.column("doc_id").to_numpy(), offsets=offsets, raw=np.frombuffer(zstandard.compress(data.tobytes(), 3), np.uint8))
            words, of_row = _words(data, offsets)
            _, _, keys, rows = _runs(words, of_row, base, gram)
            posts = list(_Posts(keys, rows).rows(bundle, buckets))
            if posts:
                yield _frame(posts)
            bundle += 1

    return tidied(run)


def _bucket(mark: bool):
    """Sends back to every bundle which of its keys two documents have and, with `mark`, of which it is the first bundle."""

    def answers(rows: list[tuple[int, bytes, bytes]], bucket: int) -> pa.RecordBatch | None:
        rows = sorted(rows, key=lambda r: r[0])
        parts = [unpacked(k) for _, k, _ in rows]
        multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for p, (_, _, m) in zip(parts, rows, strict=True)]).astype(bool)
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(first) - 1
        flag = (np.bincount(group) > 1) | (np.bincount(group, weights=multi[order]) > 0)
        repeats = np.empty(len(keys), bool)
        repeats[order] = flag[group]
        own = np.zeros(len(keys), bool)
        own[order[first]] = mark
        edges = np.cumsum([0, *map(len, parts)])
        out = [(bundle, repeats[a:b], own[a:b]) for (bundle, _, _), a, b in zip(rows, edges[:-1], edges[1:], strict=True)]
        out = [(bundle, np.packbits(x).tobytes(), np.packbits(y).tobytes() if mark else b"", int(x.sum())) for bundle, x, y in out if x.any()]
        if not out:
            return None
        bundle, bits, firsts, n = zip(*out, strict=True)
        arrays = [pa.array(bundle, pa.int64()), pa.array([bucket] * len(bundle), pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, pa.binary()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["bundle", "bucket", "bits", "own", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = -1, []
        for batch in batches:
            for bucket, bundle, keys, multi in zip(*(batch.column(c).to_pylist() for c in ("bucket", "bundle", "keys", "multi")), strict=True):
                if bucket != current and rows:
                    done = answers(rows, current)
                    if done is not None:
                        yield done
                    rows = []
                current = bucket
                rows.append((bundle, keys, multi))
        if rows:
            done = answers(rows, current)
            if done is not None:
                yield done

    return tidied(run)


def _answer_writer(folder: str):
    """Writes the answers to each bundle as a file; (bundle, n): how many of its keys repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found, total, done = None, {}, 0, []
        for batch in batches:
            for bundle, bucket, bits, own, n in zip(*(batch.column(c).to_pylist() for c in ("bundle", "bucket", "bits", "own", "n")), strict=True):
                if bundle != current and found:
                    put_arrays(folder, str(current), **found)
                    done.append((current, total))
                    found, total = {}, 0
                current = bundle
                found[str(bucket)] = np.frombuffer(bits, np.uint8)
                if own:
                    found[f"own{bucket}"] = np.frombuffer(own, np.uint8)
                total += n
        if found:
            put_arrays(folder, str(current), **found)
            done.append((current, total))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=["bundle", "n"])

    return tidied(run)


def _first_windows(root: str, base: int, gram: int, buckets: int):
    """Posts the windows of `base` words whose minimum two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                held = get_arrays(f"{root}/texts", str(bundle))
                data = np.frombuffer(zstandard.decompress(held["raw"].tobytes()), np.uint8) if len(held["raw"]) else held["raw"]
                words, of_row = _words(data, held["offsets"])
                places, run_of, keys, rows = _runs(words, of_row, base, gram)
                keep = _Posts(keys, rows).repeated(get_arrays(f"{root}/answers-0", str(bundle)), buckets)
                places = places[keep[run_of]] if len(places) else places
                up, down = _powers(len(words) + 1)
                sums = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(words * up[: len(words)], out=sums[1:])
                hashes = mix64((sums[places + base] - sums[places]) * down[places])
                row = np.searchsorted(of_row, places, side="right") - 1
                put_arrays(f"{root}/state-{base}", str(bundle), ids=held["ids"], of_row=of_row, places=places, rows=row, hashes=hashes, spans=np.zeros((0, 4), np.int64), cuts=np.zeros((0, 4), np.int64))
                posts = list(_Posts(hashes, row).rows(bundle, buckets))
                if posts:
                    yield _frame(posts)

    return tidied(run)


def covered(places: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """(row, start, end, length) of the maximal runs that windows at sorted places cover."""
    if not len(places):
        return np.zeros((0, 4), np.int64)
    cut = np.flatnonzero((np.diff(places) > length) | (np.diff(rows) != 0))
    first, last = np.append(0, cut + 1), np.append(cut, len(places) - 1)
    return np.stack([rows[first], places[first], places[last] + length, np.full(len(first), length)], axis=1)


def _doubled(root: str, length: int, least: int, buckets: int):
    """Keeps the windows of `length` that repeat, and posts those of twice the length that both halves allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                state = get_arrays(f"{root}/state-{length}", str(bundle))
                places, rows, hashes, spans, cuts = (state[k] for k in ("places", "rows", "hashes", "spans", "cuts"))
                posts, found = _Posts(hashes, rows), get_arrays(f"{root}/answers-{length}", str(bundle))
                keep = posts.repeated(found, buckets)
                if length == least:
                    later = keep & ~posts.first_of_all(found, buckets)
                    cuts = covered(places[later], rows[later], length)
                places, rows, hashes = places[keep], rows[keep], hashes[keep]
                if length == least:
                    spans = covered(places, rows, length)
                elif length > least and len(places):
                    spans[np.searchsorted(spans[:, 1], places, side="right") - 1, 3] = length
                at = np.searchsorted(places, places + length)
                second = np.minimum(at, max(0, len(places) - 1))
                both = (places[second] == places + length) & (rows[second] == rows) if len(places) else np.zeros(0, bool)
                hashes = mix64(hashes[both] + hashes[second[both]] * _DOUBLE)
                places, rows = places[both], rows[both]
                put_arrays(f"{root}/state-{2 * length}", str(bundle), ids=state["ids"], of_row=state["of_row"], places=places, rows=rows, hashes=hashes, spans=spans, cuts=cuts)
                posts = list(_Posts(hashes, rows).rows(bundle, buckets))
                if posts:
                    yield _frame(posts)

    return tidied(run)


def _spans(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                state = get_arrays(folder, str(bundle))
                row, start, end, longest = state[name].T
                values = (state["ids"][row], start - state["of_row"][row], end - start, longest)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=["doc_id", "start_word", "n_words", "longest"])

    return tidied(run)


_SPANS = "doc_id long, start_word long, n_words long, longest long"


def _found(docs: DataFrame, base: int, gram: int, least: int, bundle_bytes: int, bucket_bytes: int, name: str) -> DataFrame:
    """The passages of (doc_id, text), `spans` or `cuts`."""
    steps = least // base if least % base == 0 else 0
    if not 1 <= gram <= base or steps < 1 or steps & (steps - 1):
        raise ValueError("gram is at most base, and least is base times a power of 2")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    root = scratch_path(spark, "passages")

    def answered(posts: DataFrame, level: int, tasks: int) -> DataFrame:
        """Brings the posts to their buckets and the answers back; (bundle, n) of those that have keys that repeat."""
        # A bucket is a task's work: hashing their numbers would give one task several.
        by_bucket = posts.repartitionById(min(buckets, MOST_TASKS), (F.col("bucket") % MOST_TASKS).cast("int")).sortWithinPartitions("bucket")
        answers = by_bucket.mapInArrow(_bucket(level == least), "bundle long, bucket long, bits binary, own binary, n long")
        by_bundle = answers.repartition(tasks, "bundle").sortWithinPartitions("bundle")
        return saved(by_bundle.mapInArrow(_answer_writer(f"{root}/answers-{level}"), "bundle long, n long"), "bundles")[0]

    bundles = answered(docs.mapInArrow(_bundler(root, base, gram, buckets, bundle_bytes), _POSTS), 0, min(buckets, MOST_TASKS))
    count = bundles.count()
    if not count:
        remove(spark, root)
        return spark.createDataFrame([], _SPANS)
    # One task a bundle, whose files are its only input, so adaptive planning must not merge them.
    tasks = min(count, MOST_TASKS)
    bundles = bundles.repartition(tasks, "bundle")
    some, length = answered(bundles.mapInArrow(_first_windows(root, base, gram, buckets), _POSTS), base, tasks).agg(F.sum("n")).first()[0], base
    remove(spark, f"{root}/texts")
    while some or length <= least:
        some = answered(bundles.mapInArrow(_doubled(root, length, least, buckets), _POSTS), 2 * length, tasks).agg(F.sum("n")).first()[0]
        for done in ("state", "answers"):
            remove(spark, f"{root}/{done}-{length}")
        length *= 2
    return bundles.mapInArrow(_spans(f"{root}/state-{length}", name), _SPANS)


def repeated_passages(docs: DataFrame, base: int = BASE_WORDS, gram: int = GRAM_WORDS, least: int = LEAST_WORDS, bundle_bytes: int = BUNDLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, start_word, n_words, longest) of the passages of at least `least` words that other documents have too.

    `least` is `base` times a power of 2.  Buckets are as many as the text fills; the driver gets a few numbers a level."""
    return _found(texts(docs), base, gram, least, bundle_bytes, bucket_bytes, "spans")


def _cutter(text: str, cuts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(text), batch.column(cuts).to_pylist(), strict=True):
                if not spans:
                    out.append(value.as_py())
                    continue
                data = np.frombuffer(value.as_py().encode(), np.uint8)
                starts, _, _ = word_spans(data, np.array([0, len(data)]))
                edges = np.append(starts, len(data))
                keep = np.ones(len(data), bool)
                for start, n in spans:
                    keep[edges[start] : edges[start + n]] = False
                out.append(data[keep].tobytes().decode())
            names = [c for c in batch.schema.names if c != cuts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return tidied(run)


def without_repeats(docs: DataFrame, base: int = BASE_WORDS, gram: int = GRAM_WORDS, least: int = LEAST_WORDS, bundle_bytes: int = BUNDLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs`, with all its columns and rows, `text` without the later occurrences of repeated passages."""
    key, cuts = fresh("_row", docs), fresh("_cuts", docs)
    rows, _ = saved(docs.withColumn("text", F.col("text").cast("string")).withColumn(key, F.monotonically_increasing_id()), "passage-rows")
    found = _found(rows.select(F.col(key).alias("doc_id"), "text").where("text IS NOT NULL"), base, gram, least, bundle_bytes, bucket_bytes, "cuts")
    mine = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(cuts))
    schema = rows.drop(key).schema
    plain = rows.join(mine, key, "left").drop(key).withColumn(cuts, F.transform(cuts, lambda x: F.array(x["start_word"], x["n_words"])))
    return plain.mapInArrow(_cutter("text", cuts), schema)
