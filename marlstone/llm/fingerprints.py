"""Threshold-scaled document fingerprints (operator 10).

The sketch of a document is the set of all its word-shingle hashes below a fixed fraction of the hash
range.  Since the threshold is the same for every document, the sketch of a union is the union of the
sketches, and the share of a small document's sketch found in a large one's estimates containment
without bias, however unequal the two are.

Defined results: a null or empty text, or one without words, has a sketch of no hashes and 0 shingles;
a text of fewer than `shingle` words has one shingle of all its words; a text of any length is sketched by all
its shingles; equal shingles (ties) are one hash; a row without doc_id keeps its null id; repeated rows are
sketched each; an empty table gives an empty one; columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textvec import chunks, shingle_hashes, utf8, word_hashes

SHINGLE_WORDS = 5
FRACTION = 1 / 2
SCHEMA = "doc_id long, n_shingles long, sketch array<long>"


def _sketches(shingle: int, fraction: float):
    limit = np.uint64(min(int(fraction * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts, values, sizes = [], [], []
            for lo, hi in chunks(offsets):
                words, of_row = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                hashes, at = shingle_hashes(words, of_row, shingle)
                counts.append(np.diff(at))
                kept = np.flatnonzero(hashes < limit)
                row = np.searchsorted(at, kept, side="right") - 1
                low = hashes[kept]
                order = np.lexsort((low, row))
                row, low = row[order], low[order]
                new = np.ones(len(low), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                values.append(low[new])
                sizes.append(np.bincount(row[new], minlength=hi - lo))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
            flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            n = pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), n, sketch], names=["doc_id", "n_shingles", "sketch"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_shingles, sketch): a narrow pass, no shuffle."""
    if shingle < 1 or not 0 < fraction <= 1:
        raise ValueError("shingle is at least 1 and fraction in (0, 1]")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketches(shingle, fraction), SCHEMA)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketch of all documents of a group as one: the union of theirs."""
    flat = sketches.select(*by, F.explode("sketch").alias("_h")).distinct()
    return flat.groupBy(*by).agg(F.array_sort(F.collect_list("_h")).alias("sketch"))


def containment(small: DataFrame, large: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared, containment) for documents a of `small` and b of `large` with at least that share of a's sketch in b's.

    An equi-join on the hashes.  Documents with an empty sketch estimate nothing and are in no pair."""
    a = small.where("size(sketch) > 0").select(F.col("doc_id").alias("a"), F.size("sketch").alias("_n"), F.explode("sketch").alias("_h"))
    b = large.select(F.col("doc_id").alias("b"), F.explode("sketch").alias("_h"))
    shared = a.join(b, "_h").groupBy("a", "b", "_n").agg(F.count("*").alias("shared"))
    return shared.withColumn("containment", F.col("shared") / F.col("_n")).where(F.col("containment") >= least).drop("_n")
