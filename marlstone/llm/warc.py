"""WARC files: writing, and reading by boundary-chain verification (operator 5).

A WARC file is a chain: each record's header gives its length, so where the next one starts.  Files are cut
into byte ranges that any task can read.

1. Candidates.  A task finds all places of its range that look like a record: the magic and a header with
   a length in plain files, the magic of a member that unpacks to such a record in compressed ones.  It
   emits each one's successor, shortened within the range to the first place outside it.
2. Pointer jumping.  From the start of each file, the reached places and the squared pointers double the
   length of the chain known with each round, so a file of n ranges takes log2(n) rounds.  What only looks
   like a record inside a payload is reached by no chain from the start, and goes.
3. Reading.  Each range's task walks its part of the chain from where it is entered and emits the records.

Defined results: a file that is no WARC has no records; where a chain breaks (a truncated or damaged
record), the records before the break are kept and what follows is not; an empty file has no records.
Writing: a null url or html is a header less or an empty block with a mark, and reads as null again; a row
without page_id is kept with a null one; repeated rows are records each (there are no ties); fields of any
length are kept whole; other columns are ignored, whatever their names; an empty table makes no records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import remove, saved, scratch_path

SPLIT_BYTES = 64 << 20
MOST_TASKS = 100_000
_PLAIN, _PACKED = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"\x1f\x8b\x08")
_END = b"\r\n\r\n"
_QUOTED, _NULL = "X-Page-URI", "X-Page-Block"
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes."""
    lines = [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + _END + block + _END


def _page(page_id, url, html) -> bytes:
    headers = [("WARC-Type", "resource"), ("Content-Type", "text/html; charset=utf-8")]
    if page_id is not None:
        headers.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        quoted = quote(url, safe=":/?#[]@!$&'()*+,;=-._~")
        headers.append(("WARC-Target-URI", quoted))
        if quoted != url:
            headers.append((_QUOTED, "percent"))
    if html is None:
        headers.append((_NULL, "null"))
    return record(headers, b"" if html is None else html.encode())


def _packed(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _writer(folder: str, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        part = f"part-{TaskContext.get().partitionId():06d}.warc" + ".gz" * compress
        temporary = f"{base}/.{part}-{np.random.default_rng().integers(1 << 62)}"
        shape, n = _packed if compress else bytes, 0
        with where.open_output_stream(temporary, compression=None) as out:
            out.write(shape(record([("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    out.write(shape(_page(*row)))
                    n += 1
        where.move(temporary, f"{base}/{part}")  # a task that runs twice leaves one file
        yield pa.RecordBatch.from_pydict({"file": [part], "records": pa.array([n], pa.int64())})

    return run


def write_pages(pages: DataFrame, folder: str, compress: bool = True) -> int:
    """Writes a WARC file for each partition of (page_id, url, html); the number of records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_writer(folder, compress), "file string, records long").agg(F.sum("records")).first()[0] or 0


class Range:
    """Bytes of a file from a start on; what lies beyond `end` is read when it is asked for."""

    def __init__(self, where: fs.FileSystem, path: str, start: int, end: int, size: int):
        self.file = where.open_input_file(path)
        self.start, self.size = start, size
        self.data = self.file.read_at(min(end + 16, size) - start, start)

    def until(self, stop: int) -> None:
        """Holds the bytes before `stop`, as far as the file has them; grows by doubling."""
        have = self.start + len(self.data)
        if stop > have < self.size:
            more = min(self.size, max(stop, have + min(len(self.data), 1 << 20)))
            self.data += self.file.read_at(more - have, have)

    def bytes(self, a: int, b: int) -> bytes:
        self.until(b)
        return self.data[a - self.start : b - self.start]

    def close(self) -> None:
        self.file.close()


def _header(raw: bytes) -> tuple[int, int] | None:
    """(size of the header with its end, length of the block) of bytes that begin a record."""
    if not _PLAIN.match(raw):
        return None
    end = raw.find(_END)
    found = _LENGTH.search(raw, 0, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else None


def _plain(r: Range, at: int, whole: bool) -> tuple[int, bytes] | None:
    """(successor, record if `whole`) of the record at a place of a plain file."""
    size = 1024
    while True:
        raw = r.bytes(at, at + size)
        if _END in raw or len(raw) < size or not _PLAIN.match(raw):
            break
        size *= 4
    found = _header(raw)
    if found is None:
        return None
    after = at + found[0] + found[1] + 4
    if after > r.size:
        return None
    return after, r.bytes(at, after) if whole else b""


def _member(r: Range, at: int, whole: bool) -> tuple[int, bytes] | None:
    """The same in a compressed file: the member must unpack to exactly one record."""
    unpack, parts, place, step, n, head, ended = zlib.decompressobj(31), [], at, 1 << 13, 0, bytearray(), False
    try:
        while not unpack.eof:
            raw = r.bytes(place, place + step)
            if not raw:
                return None
            out = unpack.decompress(raw)
            place += len(raw)
            n += len(out)
            if not ended:
                seen = max(0, len(head) - 3)
                head += out
                if len(head) >= 10 and not _PLAIN.match(head):
                    return None
                ended = head.find(_END, seen) >= 0
            if whole:
                parts.append(out)
            step = min(step * 2, 1 << 20)
    except zlib.error:
        return None
    found = _header(head)
    if found is None or found[0] + found[1] + 4 != n:
        return None
    return place - len(unpack.unused_data), b"".join(parts)


def _kind(packed: bool):
    return (_PACKED, _member) if packed else (_PLAIN, _plain)


def _ranges(batch: pa.RecordBatch) -> Iterator[dict]:
    yield from batch.to_pylist()


def candidates(r: Range, start: int, end: int, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, exits): all that look like a record, and where each one's chain leaves the range, -1 if it breaks in it."""
    magic, parse = _kind(packed)
    places, after = [], []
    for m in magic.finditer(r.data[: end + 16 - start]):
        at = start + m.start()
        if at >= end:
            break
        found = parse(r, at, False)
        if found:
            places.append(at)
            after.append(found[0])
    place, exits = np.array(places, np.int64), np.array(after, np.int64)
    for i in range(len(place) - 1, -1, -1):  # successors lie ahead, so one pass from the end shortens all
        if exits[i] < end:
            j = np.searchsorted(place, exits[i])
            exits[i] = exits[j] if j < len(place) and place[j] == exits[i] else -1
    return place, exits


def _finder(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for x in _ranges(batch):
                r = Range(where, f"{base}/{x['file']}", x["start"], x["end"], x["size"])
                place, exits = candidates(r, x["start"], x["end"], x["packed"])
                r.close()
                yield pa.RecordBatch.from_arrays([pa.array([x["file"]] * len(place), pa.string()), pa.array(place), pa.array(exits)], names=["file", "at", "next"])

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for x in _ranges(batch):
                r = Range(where, f"{base}/{x['file']}", x["start"], x["end"], x["size"])
                at, (_, parse) = x["at"], _kind(x["packed"])
                rows, held = [], 0
                while at < x["end"]:
                    found = parse(r, at, True)
                    if not found:
                        break
                    after, raw = found
                    size, length = _header(raw)
                    rows.append((x["file"], at, raw[: size - 4].decode("utf-8", "replace"), raw[size : size + length]))
                    held += len(raw)
                    at = after
                    if held > 1 << 23:
                        yield _records(rows)
                        rows, held = [], 0
                r.close()
                if rows:
                    yield _records(rows)

    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    file, at, header, block = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(header, pa.string()), pa.array(block, pa.binary())], names=["file", "offset", "header", "block"])


def file_ranges(spark: SparkSession, folder: str, split_bytes: int) -> DataFrame:
    """(file, size, packed, start, end): the files of a folder, listed by the driver as any scan does, cut by tasks."""
    where, base = fs.FileSystem.from_uri(folder)
    found = where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    files = []
    for f in found:
        name = f.path[len(base.rstrip("/")) + 1 :]
        if f.is_file and f.size and not f.base_name.startswith((".", "_")):
            files.append((name, f.size, name.endswith(".gz")))
    listed = spark.createDataFrame(sorted(files), "file string, size long, packed boolean")
    cut = listed.withColumn("start", F.explode(F.expr(f"sequence(0L, size - 1, {int(split_bytes)}L)")))
    ranges = sum(-(-size // int(split_bytes)) for _, size, _ in files)
    # A row stands for a whole range of bytes, so the number of tasks is that of ranges, which adaptive planning must not merge.
    return cut.withColumn("end", F.least(F.col("start") + int(split_bytes), "size")).repartition(max(1, min(ranges, MOST_TASKS)))


def reached(pointers: DataFrame) -> DataFrame:
    """(file, at) of the pointers (file, at, next) that a chain from a file's start reaches, by pointer jumping."""
    heads = pointers.select("file", F.col("next").alias("at")).where("next >= 0").distinct()
    jumps, jump_path = saved(pointers.where("at = 0").union(pointers.where("at > 0").join(heads, ["file", "at"], "left_semi")), "warc-jumps")
    known, path = saved(jumps.where("at = 0").select("file", "at"), "warc-reached")
    size = known.count()
    while size:
        ahead = jumps.join(known, ["file", "at"], "left_semi").select("file", F.col("next").alias("at")).join(jumps.select("file", "at"), ["file", "at"], "left_semi")
        more, more_path = saved(known.union(ahead).distinct(), "warc-reached")
        remove(known.sparkSession, path)
        known, path, before, size = more, more_path, size, more.count()
        if size == before:
            break
        second = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("_then"))
        squared = jumps.join(second, ["file", "next"], "left").select("file", "at", F.coalesce("_then", F.lit(-1)).alias("next"))
        jumps, squared_path = saved(squared, "warc-jumps")
        remove(known.sparkSession, jump_path)
        jump_path = squared_path
    return known


def read_records(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, offset, header, block) of the records of all WARC files of a folder."""
    ranges = file_ranges(spark, folder, split_bytes)
    pointers, _ = saved(ranges.mapInArrow(_finder(folder), "file string, at long, next long"), "warc-candidates")
    step = int(split_bytes)
    entry = reached(pointers).withColumn("start", F.floor(F.col("at") / step) * step).groupBy("file", "start").agg(F.min("at").alias("at"))
    return ranges.join(entry, ["file", "start"]).mapInArrow(_reader(folder), "file string, offset long, header string, block binary")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, htmls = [], [], []
        for header, block in zip(batch.column("header").to_pylist(), batch.column("block"), strict=True):
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in header.split("\r\n")[1:])}
            kind, body = fields.get("warc-type"), block.as_py()
            if kind not in ("resource", "response"):
                continue
            if kind == "response" and body.startswith(b"HTTP/"):
                body = body.partition(_END)[2]
            found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-record-id", ""))
            ids.append(int(found[1]) if found else None)
            url = fields.get("warc-target-uri")
            urls.append(unquote(url) if url is not None and _QUOTED.lower() in fields else url)
            htmls.append(None if _NULL.lower() in fields else body.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(htmls, pa.string())], names=["page_id", "url", "html"])


def read_pages(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, html) of the resources and responses of WARC files, those of `write_pages` and any others.

    Of a response the HTTP head goes; a truncated record keeps what it has; a URL stays as it is written, but for
    those that `write_pages` quoted; page_id is null where the record's id is not one that it gave."""
    return read_records(spark, folder, split_bytes).mapInArrow(_parsed, "page_id long, url string, html string")


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES, compress: bool = True) -> DataFrame:
    """The pages, written as WARC files to the shared folder and read back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_pages(pages, folder, compress)
    return read_pages(spark, folder, split_bytes)


def sql(table: str = "pages") -> str:
    """DuckDB SQL for `round_trip`."""
    return f"SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM {table}"
