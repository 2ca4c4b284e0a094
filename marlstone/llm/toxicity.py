"""Toxicity by compression distance (operator 2).

Two zstandard dictionaries are trained apart: one on ordinary text, one on those spans of toxic text that
ordinary text lacks.  A window of a document is compressed twice, with the ordinary dictionary alone and
with the toxic one placed before it.  Everything in the ordinary dictionary is as far from the window
either way, so the second length is smaller only by what the toxic dictionary explains: the distance of
the window.  A document's score is the distance of its windows, where positive, per byte of text.
It is toxic when its score exceeds a threshold calibrated on labelled documents that the dictionaries
were not trained on, so that at most `false_rate` of ordinary ones pass it.

Fitting uses a bounded sample of the labelled documents, `toxic_docs` and `ordinary_docs` by a hash of
their id; the bound is the same at every size of corpus.  Scoring reads every window of every text.

Defined results: a null or empty text scores 0 and is not toxic; letter case counts for non-ASCII letters
only; labels other than 0 and 1, null labels, and doc_ids labelled both ways are not used; without a
toxic and an ordinary labelled document nothing is toxic; of several texts of a labelled id the least is fitted
on; repeated rows are scored each, alike; rows without a doc_id are scored too; a text of any length is scored
whole, window by window; a score equal to the threshold (a tie) is not toxic; an empty table gives an empty
one; other columns, whatever their names, are ignored by `scored` and kept by `without_toxic`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import tidied

WINDOW = 256
GRAM = 4
LEAST_DOCS = 6
MERGED_GRAMS = 1 << 20
ORDINARY_BYTES = 96 << 10
TOXIC_BYTES = 4 << 10
TOXIC_DOCS = 3000
ORDINARY_DOCS = 9000
FALSE_RATE = 0.003
LEAST_LENGTH = 100
LEAST_SCORE = 1e-4
SLACK = 0

_made: dict[bytes, tuple] = {}


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = _parameters()
    d = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters)


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content of a trained dictionary; with too few samples for the trainer, the samples' last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | a[j : n + j]
    return out


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of all texts and the number of texts that have each, merged a bounded number of bytes at a time."""
    grams, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for i, text in enumerate(texts, 1):
        held.append(np.unique(_grams(text)))
        size += len(held[-1])
        if size > MERGED_GRAMS or i == len(texts):
            both = np.concatenate([grams, *held])
            weight = np.concatenate([counts, np.ones(size, np.int64)])
            order = np.argsort(both, kind="stable")
            both = both[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            grams, counts = both[first], np.add.reduceat(weight[order], first) if len(first) else counts
            held, size = [], 0
    return grams, counts


def _counts_of(grams: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The number of texts that have each of the sorted runs."""
    times = np.zeros(len(grams), np.int64)
    for text in texts:
        mine = np.unique(_grams(text))
        at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
        times[at[grams[at] == mine]] += 1
    return times


def telling_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The spans of toxic texts made of byte runs that at least a few toxic texts have and ordinary ones lack.

    Lack: no more than a twentieth of the rate at which toxic texts have them."""
    grams, counts = _document_counts(toxic)
    some = counts >= min(LEAST_DOCS, 1 + len(toxic) // 50)
    grams, counts = grams[some], counts[some]
    if len(grams):
        grams = grams[_counts_of(grams, ordinary) * 20 * len(toxic) <= counts * len(ordinary)]
    if not len(grams):
        return []
    spans = []
    for text in toxic:
        mine = _grams(text)
        at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
        place = np.flatnonzero(grams[at] == mine)
        if len(place):
            cut = np.flatnonzero(np.diff(place) > 1)
            for s, e in zip(np.append(place[0], place[cut + 1]), np.append(place[cut], place[-1]), strict=True):
                spans.append(text[s : e + GRAM].ljust(8, b"\0"))
    return spans


class Model:
    """Both dictionaries and the calibrated threshold."""

    def __init__(self, ordinary: bytes, toxic: bytes, threshold: float):
        self.ordinary, self.toxic, self.threshold = ordinary, toxic, threshold

    @classmethod
    def fit(cls, toxic: list[bytes], ordinary: list[bytes], false_rate: float = FALSE_RATE) -> Model:
        """Trains on two of three documents of either kind and calibrates on the ordinary ones of the rest."""
        toxic, ordinary = [t.lower() for t in toxic], [t.lower() for t in ordinary]
        train = [x for i, x in enumerate(ordinary) if i % 3]
        spans = telling_spans([x for i, x in enumerate(toxic) if i % 3] or toxic, train or ordinary)
        if not spans:
            return cls(b"", b"", float("inf"))
        base = _trained([w for t in train or ordinary for w in windows(t)], ORDINARY_BYTES, 64, 8)
        model = cls(base, _trained(spans, TOXIC_BYTES, 16, 6), LEAST_SCORE)
        scores = np.sort([model.score(t)[0] for i, t in enumerate(ordinary) if i % 3 == 0])
        if len(scores):
            model.threshold = max(LEAST_SCORE, float(scores[len(scores) - 1 - int(false_rate * len(scores))]))
        return model

    def _pair(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        key = hashlib.blake2b(self.ordinary + b"|" + self.toxic).digest()
        if key not in _made:
            _made.clear()
            _made[key] = (_compressor(self.ordinary), _compressor(self.toxic + self.ordinary))
        return _made[key]

    def score(self, text: bytes) -> tuple[float, int]:
        """The score of a lower-case text and its number of windows."""
        if not self.toxic or not text:
            return 0.0, 0
        plain, both = (c.compress for c in self._pair())
        cut = windows(text)
        total = 0
        for w in cut:
            gain = len(plain(w)) - len(both(w)) - SLACK
            if gain > 0:
                total += gain
        return total / max(len(text), LEAST_LENGTH), len(cut)

    def dump(self) -> bytes:
        return np.array([len(self.ordinary), len(self.toxic)], np.int64).tobytes() + np.float64(self.threshold).tobytes() + self.ordinary + self.toxic

    @classmethod
    def load(cls, raw: bytes) -> Model:
        a, b = np.frombuffer(raw, np.int64, 2)
        return cls(raw[24 : 24 + a], raw[24 + a : 24 + a + b], float(np.frombuffer(raw, np.float64, 1, 16)[0]))


def _fitter(false_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True)
        rows = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).digest())
        toxic = [t.encode() for _, y, t in rows if y == 1]
        ordinary = [t.encode() for _, y, t in rows if y == 0]
        model = Model.fit(toxic, ordinary, false_rate)
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.dump()], pa.binary())})

    return tidied(run)


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, false_rate: float = FALSE_RATE) -> Model:
    """Fits in one task on a bounded sample; the driver gets the model of about 100 KB."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_high")).where("toxic = _high").drop("_high")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(toxic_docs).union(known.where("toxic = 0").orderBy(*order).limit(ordinary_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # The sample is at most toxic_docs + ordinary_docs rows of two numbers, so it can be broadcast at any size of corpus.
    # Of several texts of an id the least is used, so that the fit is the same each time.
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = chosen.coalesce(1).mapInArrow(_fitter(false_rate), "model binary").first()
    return Model.load(bytes(found["model"])) if found else Model(b"", b"", float("inf"))


def _scorer(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(raw)
        for batch in batches:
            scores, counts = [], []
            for text in batch.column("text"):
                score, n = model.score(text.as_py().encode().lower()) if text.is_valid else (0.0, 0)
                scores.append(score)
                counts.append(n)
            at = batch.schema.names.index("text")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], names=[*names, "score", "windows"])

    return tidied(run)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, windows) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model.dump()), "doc_id long, score double, windows long")


def toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, score, windows) of the documents rejected as toxic."""
    model = fit(docs, labels, **parameters)
    return scored(docs, model).where(F.col("score") > model.threshold)


def _keeper(raw: bytes, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(raw)
        for batch in batches:
            keep = [not t.is_valid or model.score(str(t.as_py()).encode().lower())[0] <= model.threshold for t in batch.column(column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return tidied(run)


def without_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """`docs`, with all its columns, without the documents rejected as toxic; one narrow pass."""
    model = fit(docs, labels, **parameters)
    return docs.mapInArrow(_keeper(model.dump(), "text"), docs.schema)
