"""MinHash near-duplicates by a signature-coordinate inverted join (operator 1).

Every document has a signature of `coordinates` minima over its word shingles.  It is posted under each
(coordinate, value) pair.  Two documents are near duplicates when at least `threshold` coordinates
collide, found as in the merging of inverted lists for the T-occurrence problem:

* documents of one and the same signature collide in every coordinate: they are collapsed to the least id first;
* prefix: a document's postings are ordered by list length, rarest first.  Two documents with T collisions
  of K share one of the first K - T + 1 postings of either, so only those are merged.  Postings that no
  other document shares come first in that order and take no work; a document with fewer than T shared
  postings is in no pair;
* skip: the longest lists, T - 1 of each document, are never merged.  They are probed, by comparing the
  signatures of the documents that met in a prefix list.

Lists are merged in blocks, so that no list is one task's, and within them documents already connected are
not compared again (see links): a list of n copies of one text takes about n comparisons, and the classes
are those of all pairs.

Defined results: a text that is null, empty or without words, or a row without doc_id, is in no class;
a text of fewer than `shingle` words has one shingle; a text of any length counts whole, by all its
shingles; exactly `threshold` collisions (a tie) are a link; rows that repeat a doc_id are one document, in
a class by any of its texts, and a doc_id alone in its class has no row however often it is repeated; of a
class the least doc_id is kept; an empty table gives an empty one; other columns are ignored, whatever
their names, and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import components, fresh, saved, texts, tidied
from marlstone.llm.links import link_counts, links
from marlstone.llm.textvec import chunks, mix64, shingle_hashes, utf8, word_hashes

SHINGLE_WORDS = 3
COORDINATES = 64
THRESHOLD = 30


def factors(coordinates: int) -> np.ndarray:
    """The odd multipliers, fixed for a coordinate, that make its hash function."""
    return mix64(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(column, shingle: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, signatures): a uint32 matrix for the rows of a string column that have a word."""
    data, offsets = utf8(column)
    factor = factors(coordinates)
    rows, out = [], []
    for lo, hi in chunks(offsets):
        words, of_row = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        hashes, at = shingle_hashes(words, of_row, shingle)
        some = np.flatnonzero(np.diff(at))
        if len(some) == 0:
            continue
        sig = np.empty((len(some), coordinates), dtype=np.uint32)
        for k in range(coordinates):
            sig[:, k] = np.minimum.reduceat(((hashes * factor[k]) >> np.uint64(32)).astype(np.uint32), at[some])
        rows.append(lo + some)
        out.append(sig)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, coordinates), np.uint32)
    return np.concatenate(rows), np.concatenate(out)


def _signed(shingle: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sig = signatures(batch.column("text"), shingle, coordinates)
            ids = batch.column("doc_id").take(pa.array(rows))
            flat = pa.array(sig.reshape(-1).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * coordinates), flat)
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "sig"])

    return tidied(run)


class Matches:
    """Signatures that agree in at least `threshold` whole coordinates."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def rows(self, raw: np.ndarray) -> np.ndarray:
        return raw.view(np.uint32)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x == y).sum(axis=-1) >= self.threshold

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        hits = np.zeros((len(x), len(y)), np.uint16)
        for k in range(x.shape[1]):
            hits += x[:, k : k + 1] == y[:, k]
        return hits >= self.threshold


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of whole signatures."""
    for batch in batches:
        flat = np.ascontiguousarray(batch.column("sig").flatten().to_numpy(zero_copy_only=False))
        each = flat.nbytes // max(1, batch.num_rows)
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * each)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())])], names=["node", "data"])


def _joined(docs: DataFrame, shingle: int, coordinates: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signed, reps, data, roots): documents with their signatures' hashes; of every signature the least document `node` and
    the number of its documents; the signatures of nodes; and the root of every node that is linked to another."""
    if not 1 <= threshold <= coordinates:
        raise ValueError("threshold is from 1 to coordinates")
    signed = texts(docs).mapInArrow(_signed(shingle, coordinates), "doc_id long, sig array<int>")
    signed = signed.select(F.col("doc_id").alias("doc"), "sig", F.xxhash64("sig").alias("h1"), F.hash("sig").alias("h2"))
    signed, _ = saved(signed, "signatures")
    reps = signed.groupBy("h1", "h2").agg(F.min_by("sig", "doc").alias("sig"), F.min("doc").alias("node"), F.count("*").alias("n_copies"))
    reps, _ = saved(reps, "representatives")
    key = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posts = reps.select("node", F.posexplode("sig").alias("c", "v")).select("node", key.alias("key"))
    # Counted with partial sums; the join back to the postings has one row a key on this side, so a hot key's postings can be split.
    shared = posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists")).where(F.size("lists") >= threshold)
    prefix = lists.select("node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (threshold - 1))).alias("p")).select("p.key", "node", "p.n")
    data = reps.select("node", "sig").mapInArrow(_packed, "node long, data binary")
    found = links(prefix, data, Matches(threshold))
    # Rows that repeat a doc_id are one document, so its texts' groups are one.
    several = signed.join(reps.select("h1", "h2", "node"), ["h1", "h2"]).groupBy("doc").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    bridges = several.select("a", F.explode("all").alias("b"))
    return signed, reps, data, components(found.union(bridges))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, coordinates: int = COORDINATES, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document that is in a class with another.

    `class_id` is the least id of the class; `n_copies` the number of rows of the document's signature; `n_links` the
    number of other signatures that collide with it in `threshold` coordinates.  Documents without a row are alone."""
    signed, reps, data, roots = _joined(docs, shingle, coordinates, threshold)
    counts = link_counts(roots, data, Matches(threshold))
    groups = roots.join(counts, "node", "left")
    kept = reps.select("h1", "h2", "node", "n_copies").join(groups, "node", "left").where("n_copies > 1 OR root IS NOT NULL")
    rows = signed.select("doc", "h1", "h2").join(kept, ["h1", "h2"])
    out = rows.groupBy(F.col("doc").alias("doc_id")).agg(F.min(F.coalesce("root", "node")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.max("n_copies").alias("n_copies"), F.bool_or(F.col("root").isNotNull() | (F.col("node") != F.col("doc"))).alias("_other"), F.count("*").alias("_rows"))
    return out.where("_other OR n_copies > _rows").drop("_other", "_rows")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE_WORDS, coordinates: int = COORDINATES, threshold: int = THRESHOLD) -> DataFrame:
    """`docs`, with all its columns, without the documents that another one stands for: the least id of each class stays."""
    signed, reps, _, roots = _joined(docs, shingle, coordinates, threshold)
    kept = reps.select("h1", "h2", "node", "n_copies").join(roots, "node", "left").where("n_copies > 1 OR root IS NOT NULL")
    own = signed.select("doc", "h1", "h2").join(kept, ["h1", "h2"]).select("doc", F.coalesce("root", "node").alias("first"))
    name = fresh("_dropped", docs)
    drop = own.where("doc <> first").select(F.col("doc").alias(name)).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop[name], "left_anti")
