"""Byte-level BPE encoding and decoding by transducers (operator 4).

Encoding.  Of byte-level BPE it is known that a sequence of tokens is the encoding of its text exactly if
every two neighbours are the encoding of their own text, and that each prefix of a text has one encoding,
with one last token.  So the merges make a transducer over bytes.  A hypothesis is the last whole token,
the tokens before it that are not emitted yet, and a place in the trie of tokens, where the next one is
under way.  A byte moves every hypothesis down the trie; where a token ends there and its pair with the
last one is an encoding, a new hypothesis starts.  Tokens that all hypotheses begin with are emitted: the
lookahead ends as soon as no other way is open, at the latest after the longest token.  A set of
hypotheses is a state of the deterministic transducer; states and steps are made when first taken.

The transducer runs over pieces of text cut by the vocabulary's pattern.  Pieces recur, so those already
run are kept with their tokens, up to a bound, after which the memory starts anew: it saves time only.

Decoding.  Tokens move an automaton of UTF-8 (the states say how many bytes are awaited and their range);
its moves over the bytes of a whole token are made when first taken.  Characters leave as soon as they are
complete, so a stream can be decoded token by token; malformed bytes become U+FFFD, as in Python.

Defined results: an empty text has no tokens; a null text has null tokens and counts as 0; any Unicode is
encoded, special tokens have no meaning in a text; a text of any length is encoded whole, a bounded number of
bytes at a time; repeated rows are encoded each (there are no ties); a row without doc_id is encoded too; an
empty table gives an empty one; columns besides those used, whatever their names, are ignored by `encoded` and
kept by `tokenized`.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import fresh, tidied
from marlstone.llm.textvec import PLAIN, chunks, mix64, span_hashes, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 1 << 19
KEPT_STEPS = 400_000
ENCODED_BYTES = 1 << 18
EMITTED_BYTES = 1 << 21
_NONE = -1


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The tokens of a vocabulary file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The file's bytes, read by the driver and sent to executors, which need not have it: about 1 MB at any size of corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


class Transducer:
    """The lazily determinised transducer of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: the place after a place and a byte, whether a place has any after it, and the token that ends there.
        self.after: dict[int, int] = {}
        self.inner, self.ends = bytearray(1), array("i", [_NONE])
        for token, rank in ranks.items():
            at = 0
            for b in token:
                nxt = self.after.get(at << 8 | b)
                if nxt is None:
                    nxt = self.after[at << 8 | b] = len(self.ends)
                    self.inner[at] = 1
                    self.inner.append(0)
                    self.ends.append(_NONE)
                at = nxt
            self.ends[at] = rank
        self.whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is a set of (pending tokens, last whole token, trie place); state 0 is the start.
        # A step is kept as one number: the next state and, below it, the number of the tokens it emits.
        self.states: list[tuple] = [(((), _NONE, 0),)]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_numbers: dict[tuple[int, ...], int] = {(): 0}
        self.finals: dict[int, tuple[int, ...]] = {}
        self.joins: dict[int, bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a short text by its merges, lowest rank first: the definition."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _valid(self, last: int, token: int) -> bool:
        """Whether `token` may follow `last`, or be first."""
        if last == _NONE:
            known = self.whole.get(token)
            if known is None:
                known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
            return known
        pair = last << 32 | token
        known = self.joins.get(pair)
        if known is None:
            known = self._valid(_NONE, token) and self.merged(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
            self.joins[pair] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        moved = set()
        for pending, last, place in self.states[state]:
            nxt = self.after.get(place << 8 | byte)
            if nxt is None:
                continue
            if self.inner[nxt]:
                moved.add((pending, last, nxt))
            token = self.ends[nxt]
            if token != _NONE and self._valid(last, token):
                moved.add(((*pending, token), token, 0))
        if not moved:
            raise ValueError("the vocabulary lacks a byte of the text")
        shared = min(len(p) for p, _, _ in moved)
        first = next(iter(moved))[0]
        while shared and any(p[:shared] != first[:shared] for p, _, _ in moved):
            shared -= 1
        out = first[:shared]
        made = tuple(sorted((p[shared:], last, place) for p, last, place in moved)) if shared else tuple(sorted(moved))
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
        emits = self.output_numbers.get(out)
        if emits is None:
            emits = self.output_numbers[out] = len(self.outputs)
            self.outputs.append(out)
        return number << 24 | emits

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece of text."""
        if len(self.steps) > KEPT_STEPS:
            self._reset()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._step(state, byte)
            state = step >> 24
            if step & 0xFFFFFF:
                out += self.outputs[step & 0xFFFFFF]
        final = self.finals.get(state)
        if final is None:
            ended = [p for p, _, place in self.states[state] if place == 0]
            if len(ended) != 1:
                raise ValueError("a piece has no single encoding")
            final = self.finals[state] = ended[0]
        out += final
        return out


_KINDS: list[np.ndarray] = []
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _kinds() -> np.ndarray:
    """For every code point whether the pattern takes it as a letter, a number, a space or another."""
    if not _KINDS:
        kinds = np.zeros(0x110000, np.uint8)
        every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
        for kind, found in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(found, every):
                a, b = (ord(every[m.start()]), ord(every[m.end() - 1]))
                kinds[a : b + 1] = kind
        _KINDS.append(kinds)
    return _KINDS[0]


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN start in the UTF-8 bytes of rows; pieces cover all bytes.

    The pattern's alternatives as vector operations: runs of one kind; of the spaces before another kind the
    last one is apart, joined to what follows if it is U+0020; an apostrophe that starts a piece and the
    letters of a contraction are one piece."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kinds = _kinds()
    kind = kinds[data]
    head = np.ones(n, bool)
    if (data >= 0x80).any():
        head = (data & 0xC0) != 0x80
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead].astype(np.int64)
        size = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for j in (1, 2, 3):
            more = size > j
            code[more] = code[more] << 6 | (data[lead[more] + j] & 0x3F)
        mine = kinds[code]
        kind[lead] = mine
        for j in (1, 2, 3):
            more = size > j
            kind[lead[more] + j] = mine[more]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    start[begins] = True
    start &= head
    fresh_row = np.zeros(n + 1, bool)
    fresh_row[begins] = True
    fresh_row[n] = True
    after = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~fresh_row[1:-1]) + 1
    spot = after - 1
    for _ in range(3):
        spot = spot - ~head[spot]
    single = start.copy()
    start[spot] = True
    start[after[data[spot] == 0x20]] = False
    quote = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & single[1:] & (kind[1:] == _LETTER) & ~fresh_row[1:-1])
    if len(quote):
        one = data[quote + 1]
        two = np.where((quote + 2 < n) & ~fresh_row[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((quote[short], 2), (quote[long], 3)):
            start[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes texts: pattern, transducer, and pieces kept with their tokens under a 64-bit hash."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.transducer = Transducer(ranks)
        self.find = None if pattern == PATTERN else regex.compile(pattern).finditer
        self._forget()

    def _forget(self) -> None:
        self.flat = np.zeros(1 << 14, np.int32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.pieces = self.used = 0
        self.keys = np.zeros(1 << 14, np.uint64)
        self.numbers = np.zeros(1 << 14, np.int64)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Inserts new distinct keys, each at its next free slot."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            self.numbers[slot[free]] = numbers[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & int(mask)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 for a new one."""
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.numbers[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if self.pieces + len(keys) > len(self.keys) // 2:
            old, numbers = self.keys, self.numbers
            size = 1 << int(4 * (self.pieces + len(keys)) - 1).bit_length()
            self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int64)
            self._put(old[old != 0], numbers[old != 0])
        encode = self.transducer.encode_piece
        tokens = [encode(p) for p in pieces]
        flat = np.array([t for ts in tokens for t in ts], np.int32)
        ends = np.cumsum([len(t) for t in tokens]) + self.used
        if ends[-1] > len(self.flat):
            self.flat = np.resize(self.flat, 2 * int(ends[-1]))
        if self.pieces + len(keys) + 1 > len(self.begin):
            self.begin = np.resize(self.begin, 2 * (self.pieces + len(keys) + 1))
        self.flat[self.used : ends[-1]] = flat
        self.begin[self.pieces + 1 : self.pieces + 1 + len(keys)] = ends
        self._put(keys, np.arange(self.pieces, self.pieces + len(keys)))
        self.pieces += len(keys)
        self.used = int(ends[-1])

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.find is None:
            return split(data, offsets)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            at = int(a)
            for m in self.find(data[a:b].tobytes().decode()):
                out.append(at)
                at += len(m[0].encode())
        return np.array(out, np.int64)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all rows of UTF-8 bytes, and where each row's begin (rows + 1 values)."""
        if self.pieces > KEPT_PIECES:
            self._forget()
        starts = self._starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys = mix64(span_hashes(data, PLAIN, starts, ends) + (ends - starts).astype(np.uint64))
        keys[keys == 0] = 1
        number = self._find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            unique, first = np.unique(keys[new], return_index=True)
            at = new[first]
            raw = data.tobytes()
            self._learn(unique, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            number[new] = self._find(keys[new])
        begin = self.begin[number]
        sizes = self.begin[number + 1] - begin
        last = np.cumsum(sizes)
        place = np.arange(last[-1])
        place += np.repeat(begin - last + sizes, sizes)
        bounds = np.concatenate([[0], last])[np.searchsorted(starts, offsets)]
        return self.flat[place], bounds

    def encode(self, text: str) -> np.ndarray:
        """The tokens of a text, int32."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0]


# States of the UTF-8 automaton by the bytes awaited and the range of the next one; 0 accepts.
_AWAIT = {0: (0, 0, 0), 1: (1, 0x80, 0xBF), 2: (2, 0x80, 0xBF), 3: (3, 0x80, 0xBF), 4: (2, 0xA0, 0xBF), 5: (2, 0x80, 0x9F), 6: (3, 0x90, 0xBF), 7: (3, 0x80, 0x8F)}


def _lead(byte: int) -> int:
    """The state after a first byte, -1 for one that begins no character."""
    if byte < 0x80:
        return 0
    if 0xC2 <= byte <= 0xDF:
        return 1
    if 0xE0 <= byte <= 0xEF:
        return {0xE0: 4, 0xED: 5}.get(byte, 2)
    if 0xF0 <= byte <= 0xF4:
        return {0xF0: 6, 0xF4: 7}.get(byte, 3)
    return -1


class StreamDecoder:
    """Decodes a stream of tokens: `feed` returns the characters that are complete, `end` what is left."""

    def __init__(self, bytes_of: dict[int, bytes], moves: dict | None = None):
        self.bytes_of = bytes_of
        self.moves = {} if moves is None else moves
        self.state, self.held, self.good = 0, b"", True

    def _move(self, state: int, token: int) -> tuple[int, int, int, bool]:
        """Over a token from a state: the new state, bytes up to the last complete character, whether all is well formed."""
        good, done, raw = True, 0, self.bytes_of[token]
        for i, byte in enumerate(raw):
            if state:
                left, low, high = _AWAIT[state]
                if low <= byte <= high:
                    state = left - 1
                else:
                    good, state = False, max(0, _lead(byte))
            else:
                state = _lead(byte)
                if state < 0:
                    good, state = False, 0
            if state == 0:
                done = i + 1
        return state, done, len(raw), good

    def feed(self, tokens: Iterable[int]) -> str:
        """The characters completed by these tokens."""
        parts, moves, state, bytes_of = [], self.moves, self.state, self.bytes_of
        good, done, size = self.good, 0, len(self.held)
        for token in tokens:
            key = (token << 3) | state
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, token)
            if move[1]:
                done = size + move[1]
            size += move[2]
            good = good and move[3]
            state = move[0]
            parts.append(bytes_of[token])
        self.state = state
        raw = self.held + b"".join(parts)
        self.held = raw[done:]
        self.good = good or not self.held
        return raw[:done].decode("utf-8", "strict" if good else "replace")

    def end(self) -> str:
        out, self.state, self.held, self.good = self.held.decode("utf-8", "replace"), 0, b"", True
        return out


class Decoder:
    """Decodes whole token lists, with one memory of moves.

    Tokens that are whole characters by themselves keep the automaton in its accepting state, so it runs
    only where others are."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.moves: dict = {}
        most = max(ranks.values()) + 1
        size = np.zeros(most + 1, np.int64)
        self.plain = np.zeros(most, bool)
        for rank, token in self.bytes_of.items():
            size[rank + 1] = len(token)
            try:
                token.decode()
                self.plain[rank] = True
            except UnicodeDecodeError:
                self.plain[rank] = False
        self.begin = np.cumsum(size)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(most)), np.uint8)

    def raw(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens and where each token's end."""
        begin = self.begin[tokens]
        size = self.begin[tokens + 1] - begin
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, np.uint8), ends
        place = np.arange(ends[-1])
        place += np.repeat(begin - ends + size, size)
        return self.flat[place], ends

    def decode(self, tokens) -> str:
        tokens = np.asarray(tokens, np.int64)
        odd = np.flatnonzero(~self.plain[tokens])
        raw, ends = self.raw(tokens)
        if not len(odd):
            return raw.tobytes().decode()
        parts, at, byte = [], 0, 0
        stream = StreamDecoder(self.bytes_of, self.moves)
        cut = np.flatnonzero(np.diff(odd) > 1)
        for a, b in zip(np.append(odd[0], odd[cut + 1]).tolist(), np.append(odd[cut], odd[-1]).tolist(), strict=True):
            if stream.held:  # a character cut off before plain tokens
                parts.append(stream.end())
            begin = int(ends[a - 1]) if a else 0
            parts.append(raw[byte:begin].tobytes().decode())
            parts.append(stream.feed(tokens[a : b + 1].tolist()))
            byte = int(ends[b])
        parts.append(stream.end())
        parts.append(raw[byte:].tobytes().decode())
        return "".join(parts)


@lru_cache(maxsize=1)
def coder(raw: bytes, pattern: str = PATTERN) -> tuple[Encoder, Decoder]:
    """One encoder and decoder of a vocabulary for each Python worker."""
    ranks = read_ranks(raw)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode_column(column: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all rows, and where each row's begin (rows + 1 values); a null row has none."""
    data, offsets = utf8(column)
    parts, ends, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in chunks(offsets, ENCODED_BYTES):
        flat, at = encoder.encode_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        parts.append(flat)
        ends.append(at[1:] + total)
        total += len(flat)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate(ends)


def _lists(flat: np.ndarray, ends: np.ndarray, column: pa.Array) -> pa.Array:
    mask = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=mask)


def _encoded(raw: Broadcast, pattern: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(raw.value, pattern)
        for batch in batches:
            column = batch.column("text")
            _, offsets = utf8(column)
            for lo, hi in chunks(offsets, EMITTED_BYTES):
                part = column.slice(lo, hi - lo)
                flat, ends = encode_column(part, encoder)
                arrays = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ends)), _lists(flat, ends, part)]
                names = ["doc_id", "n_tokens", "tokens"]
                if check:
                    same = [decoder.decode(flat[a:b]) == t.as_py() if t.is_valid else None for a, b, t in zip(ends[:-1], ends[1:], part, strict=True)]
                    arrays.append(pa.array(same, pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return tidied(run)


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row and, with `check`, whether decoding them gives the text again; a narrow pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(vocabulary(docs.sparkSession, path), pattern, check), "doc_id long, n_tokens long, tokens array<int>" + ", round_trip boolean" * check)


def _tokenized(raw: Broadcast, pattern: str, text: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = coder(raw.value, pattern)
        for batch in batches:
            _, offsets = utf8(batch.column(text))
            for lo, hi in chunks(offsets, EMITTED_BYTES):
                part = batch.slice(lo, hi - lo)
                column = part.column(text)
                flat, ends = encode_column(column, encoder)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(ends)), _lists(flat, ends, column)], names=[*part.schema.names, *names])

    return tidied(run)


def tokenized(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`docs` with all its columns and `n_tokens` and `tokens`, underscores before those that it has."""
    typed = docs.withColumn("text", F.col("text").cast("string"))
    names = (fresh("n_tokens", typed), fresh("tokens", typed))
    schema = T.StructType([*typed.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType()))])
    return typed.mapInArrow(_tokenized(vocabulary(docs.sparkSession, path), pattern, "text", names), schema)


def _decoded(raw: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(raw.value)[1]
        for batch in batches:
            texts = [decoder.decode(t.as_py()) if t.is_valid else None for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tidied(run)


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of a table of (doc_id, tokens): the inverse of `encoded`; null tokens give a null text."""
    return tokens.select("doc_id", F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(_decoded(vocabulary(tokens.sparkSession, path)), "doc_id long, text string")
