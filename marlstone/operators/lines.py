"""Line-level densities and findings: trailing whitespace, large files, absolute paths, secrets, duplicated windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.bands import band_of, guarded
from marlstone.shared import release, remove, split, written

KEPT_WORDS = 1 << 18
#: Windows of a bundle of texts, bytes of text for each shard of hashes, and the most tasks for either.
BUNDLE_WINDOWS, SHARD_BYTES, MOST_TASKS = 1 << 19, 16 << 20, 4096

#: A path from a user's or machine's root, not inside a longer path, name or URL, or from a drive letter.
ABSOLUTE = r"(^|[^A-Za-z0-9._/:~-])(/(?:home|Users|root|tmp|opt|mnt|private|media)/[A-Za-z0-9._/-]+|[A-Za-z]:\\[A-Za-z0-9._\\-]{2,})"
SECRETS = {
    "cloud_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "source_host_token": r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    "chat_token": r"\b(xox[abprs]-[A-Za-z0-9-]{10,})\b",
    "payment_key": r"\b([rs]k_live_[A-Za-z0-9]{16,})\b",
    "maps_key": r"\b(AIza[A-Za-z0-9_-]{35})\b",
    "web_token": r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "private_key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)",
    "assignment": r"(?i)(?:password|passwd|api_key|apikey|secret|token)[ ]*[=:][ ]*[\"']([A-Za-z0-9_./+=-]{12,200})[\"']",
    "connection": r"://[A-Za-z0-9_]{1,64}:([^@ /]{3,100})@",
}
#: What a text must have for a rule to be able to match: a search for words is far cheaper than the rule.
HINTS = {
    "cloud_key": ["AKIA", "ASIA"], "source_host_token": ["gh"], "chat_token": ["xox"], "payment_key": ["k_live_"], "maps_key": ["AIza"], "web_token": ["eyJ"],
    "private_key": ["PRIVATE KEY-----"], "assignment": ["'", '"'], "connection": ["://"],
}
ENTROPY = 2.5


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line): a row for each line; a final newline makes no further one."""
    body = F.regexp_replace(F.col(text), r"\n$", "")
    return files.where(F.col(text) != "").select(key, F.explode(F.split(body, "\n")).alias("line"))


def whitespace_density(rows: DataFrame) -> DataFrame:
    """(lines, trailing, value, band): the share of lines that aren't blank and end in white space."""
    counted = rows.agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(r"[^ \t\r\f][ \t\r\f]+$")).alias("trailing"))
    value = guarded(F.col("trailing"), F.col("lines"))
    return counted.select("lines", "trailing", F.round(value, 6).alias("value"), band_of("L1.16", value).alias("band"))


def large_files(files: DataFrame, by: str, size: Column, large: int = 1000, huge: int = 4000) -> DataFrame:
    """(by, files, large, huge, value, band): the share of files beyond `large`; any beyond `huge` forces Slop."""
    counted = files.groupBy(by).agg(F.count("*").alias("files"), F.count_if(size > large).alias("large"), F.count_if(size > huge).alias("huge"))
    value = guarded(F.col("large"), F.col("files"))
    return counted.select(by, "files", "large", "huge", F.round(value, 6).alias("value"), F.when(F.col("huge") > 0, "Slop").otherwise(band_of("L1.17", value)).alias("band"))


def absolute_paths(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, n): the absolute paths in each file; any finding is Slop."""
    found = files.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(ABSOLUTE), 2)).alias("path"))
    return found.groupBy(key, "path").agg(F.count("*").alias("n"))


def entropy(text: Column) -> Column:
    """Bits a character, by the shares of the distinct ones."""
    letters = F.split(text, "")
    n = F.length(text)
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def secrets(files: DataFrame, key: str, text: str) -> DataFrame:
    """(rule, secrets, files): distinct credential-shaped strings by rule; placeholders and references to the environment don't
    count, nor assigned values of too little entropy to be one."""
    def found_by(name: str, rule: str) -> Column:
        hint = F.lit(False)
        for word in HINTS[name]:
            hint = hint | F.col(text).contains(word)
        return F.struct(F.lit(name).alias("rule"), F.when(hint, F.regexp_extract_all(F.col(text), F.lit(rule), 1)).alias("found"))

    rules = F.array(*(found_by(n, r) for n, r in SECRETS.items()))
    found = files.select(key, F.explode(rules).alias("r")).where("size(r.found) > 0").select(key, "r.rule", F.explode("r.found").alias("secret"))
    found = found.where(~F.lower("secret").rlike(r"(example|changeme|placeholder|your[_-]|xxxx|<|\$\{|environ|getenv)"))
    found = found.where((F.col("rule") != "assignment") | (entropy(F.col("secret")) >= ENTROPY))
    return found.groupBy("rule").agg(F.countDistinct("secret").alias("secrets"), F.countDistinct(key).alias("files"))


def secret_bands(found: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by…, secrets, band) of secrets (by…, secret) over files (by…): none, one or two, more; n/a of no files."""
    n = found.groupBy(*by).agg(F.count_distinct("secret").alias("secrets"))
    joined = files.groupBy(*by).agg(F.count("*").alias("_files")).join(n, by, "left").withColumn("secrets", F.coalesce("secrets", F.lit(0)))
    band = F.when(F.col("_files") == 0, "n/a").when(F.col("secrets") == 0, "Healthy").when(F.col("secrets") <= 2, "Not Healthy").otherwise("Slop")
    return joined.select(*by, "secrets", band.alias("band"))


def path_band(files: DataFrame, key: str, text: str) -> DataFrame:
    """(files, found, band): any absolute path is Slop; n/a of no files."""
    n = files.agg(F.count("*").alias("files")).crossJoin(absolute_paths(files, key, text).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found")))  # one row each
    return n.select("files", "found", F.when(F.col("files") == 0, "n/a").when(F.col("found") > 0, "Slop").otherwise("Healthy").alias("band"))


def _hashes(size: int):
    """A function of a text: (hash, first, last) of every window of words, by the numbers of its first and last lines among those
    with words, and how many such lines there are."""
    keys: dict[str, int] = {}
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def powers(of: np.uint64, n: int) -> np.ndarray:
        steps = np.full(n, of, np.uint64)
        steps[:1] = 1
        return np.multiply.accumulate(steps)

    def key(word: str) -> int:
        found = keys.get(word)
        if found is None:
            if len(keys) > KEPT_WORDS:
                keys.clear()
            found = keys[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return found

    def hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        held, line, n = [], [], 0
        for words in (re.findall("[A-Za-z]+", x) for x in text.split("\n")):
            held += [key(w.lower()) for w in words]
            line += [n] * len(words)
            n += bool(words)
        count = len(held) - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), n
        at = np.array(line, np.int32)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(held, np.uint64) * powers(base, len(held)), dtype=np.uint64)])
            return (sums[size:] - sums[: len(sums) - size]) * powers(inverse, count), at[:count], at[size - 1 :], n

    return hashes


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on: those of small numbers, or small steps, are mostly zeros, which any compression takes out."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _bundler(size: int, shards: int, most: int):
    """Rows (bundle, shard, lines, n, data) of bundles of some `most` windows: for each shard the n different hashes in its range, sorted,
    by their steps, and as shard -1 the bundle's n windows: for each the rank of its hash, or -1 if it starts on two lines of the bundle."""

    def bundled(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lines: int) -> pa.RecordBatch:
        hashes, first, last = (np.concatenate([t[i] for t in texts]) for i in range(3))
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], np.diff(hashes[order]) != 0])[: len(order)]
        start, rank = np.flatnonzero(new), np.empty(len(order), np.int32)
        rank[order] = np.cumsum(new) - 1
        ends = np.append(start[1:], len(order))[: len(start)] - 1
        rank[(first[order[start]] != first[order[ends]])[rank]] = -1  # lines only grow, so these are the least and the greatest
        unique = hashes[order[start]]
        edges = np.searchsorted((unique >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
        some = np.flatnonzero(np.diff(edges))
        own = np.concatenate([edges.astype(np.int32), rank, np.diff(first, prepend=np.int32(0)), np.diff(last, prepend=np.int32(0))])
        data = [_planes(np.diff(unique[edges[s] : edges[s + 1]], prepend=np.uint64(0))) for s in some] + [pa.compress(_planes(own), "zstd", asbytes=True)]
        bundle, rest = int(np.random.default_rng().integers(1 << 62)), [0] * len(some)
        columns = [[bundle] * len(data), [*some.tolist(), -1], [*rest, lines], [*np.diff(edges)[some].tolist(), len(hashes)]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(data, pa.binary())], names=["bundle", "shard", "lines", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts, lines, held = _hashes(size), [], 0, 0
        for batch in batches:
            for text in batch.column("text"):
                h, first, last, n = hashes(text.as_py() or "")
                texts.append((h, first + np.int32(lines), last + np.int32(lines)))
                lines, held = lines + n, held + len(h)
                if held >= most or lines >= most:
                    yield bundled(texts, lines)
                    texts, lines, held = [], 0, 0
        if lines:
            yield bundled(texts, lines)
        del texts
        release()

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of a column that they are sorted by."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[by] != current:
                yield current, rows
                rows = []
            current = row[by]
            rows.append(row)
    if rows:
        yield current, rows


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of a shard's hashes of each bundle: whether another bundle has the hash. A bundle without any has no row."""
    for shard, rows in _groups(batches, "shard"):
        each = [np.cumsum(_unplaned(r.pop("data"), np.uint64), dtype=np.uint64) for r in rows]
        every = np.sort(np.concatenate(each))
        again = every[1:][every[1:] == every[:-1]]
        found = []
        for row, mine in zip(rows, each, strict=True):
            at = np.searchsorted(again, mine)
            hit = again[np.minimum(at, len(again) - 1)] == mine if len(again) else np.zeros(0, bool)
            if hit.any():
                found.append((row["bundle"], shard, 0, row["n"], np.packbits(hit).tobytes()))
        if found:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["bundle", "shard", "lines", "n", "data"])
        del rows, each, every, again, found
    release()


def _covered(shards: int):
    """(n): a bundle's lines that are in a window which starts on two lines, by its windows and the bits of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bundle"):
            own = next(r for r in rows if r["shard"] < 0)
            n = own["n"]
            parts = _unplaned(pa.decompress(own["data"], 4 * (shards + 1 + 3 * n), "zstd", asbytes=True), np.int32)
            edges, rank, first, last = np.split(parts, [shards + 1, shards + 1 + n, shards + 1 + 2 * n])
            twice = np.zeros(edges[-1] + 1, bool)
            twice[-1] = True  # for rank -1
            for r in rows:
                if r["shard"] >= 0:
                    twice[edges[r["shard"]] : edges[r["shard"] + 1]] = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=r["n"])
            marked, size = twice[rank], own["lines"] + 1
            inside = np.bincount(np.cumsum(first)[marked], minlength=size) - np.bincount(np.cumsum(last)[marked] + 1, minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(np.cumsum(inside) > 0)], pa.int64())], names=["n"])
        release()

    return run


_PARTS = "bundle long, shard long, lines long, n long, data binary"


def clone_ratio(files: DataFrame, key: str, text: str, size: int, bundle_windows: int = BUNDLE_WINDOWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lines, duplicated, value, band): lines with words that are in a window of `size` words that starts on two lines.

    A row is a file. A bundle of texts sends each of its hashes once, packed, to the shard of the hash's range, and gets back a bit
    for each that another bundle has too: some 6 bytes a window go out, and 3 are kept to mark its lines. A shard is one task's
    work, and their number follows the text."""
    rows = files.where(F.col(key).isNotNull()).select(F.col(text).alias("text"))
    shards = max(1, -(-rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // shard_bytes))
    sent, own = split(rows.mapInArrow(_bundler(size, shards, bundle_windows), _PARTS), F.col("shard") < 0, "windows")
    lines_, bundles = own.agg(F.coalesce(F.sum("lines"), F.lit(0)), F.count("*")).first()
    # As many tasks as there is work, which adaptive planning must not merge: a row stands for a shard's part or a whole bundle.
    routed = sent.repartitionById(min(shards, MOST_TASKS), (F.col("shard") % MOST_TASKS).cast("int")).sortWithinPartitions("shard")
    bits = written(routed.mapInArrow(_met, _PARTS), "met")
    remove(sent)
    back = own.union(bits).repartition(max(1, min(bundles, MOST_TASKS)), "bundle").sortWithinPartitions("bundle")
    marked = back.mapInArrow(_covered(shards), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated"))
    value = guarded(F.col("duplicated"), F.col("lines"))
    return marked.select(F.lit(lines_).cast("long").alias("lines"), "duplicated").select("lines", "duplicated", F.round(value, 2).alias("value"), band_of("L1.13", F.round(value, 2)).alias("band"))
