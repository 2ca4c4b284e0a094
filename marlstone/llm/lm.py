"""Scoring by a causal self-attention language model trained in numpy (operator 3).

Texts become subword ids of a public vocabulary, kept packed in the shared folder.  All ids are counted.
The most frequent ones have a slot of the model each; the others share one slot, within which an id has
its share of their counts, so that the model gives every id a probability.  Slots in order of frequency
form `classes` classes: the model predicts the class and then the slot in it.

The model is one layer: embeddings of slot and place, one masked attention head, a residual, two softmaxes.
It is trained data-parallel on all windows of the corpus (`fraction` of them), shuffled by a hash of what they hold
into shards of about SHARD_WINDOWS, in the order of that hash.  So equal windows meet: they are computed once and
count as often as they occur, and a step is of as many occurrences as before.  In each round every shard of the round's
windows trains from the same parameters; these are averaged, weighted by tokens, block by block in a shuffle,
and the next round starts from the average.  The rounds are at least `rounds` and as many as the shards of
each: both grow with the square root of the corpus, so that more text makes more steps one after another.
The driver gets one set of parameters a round.

Scoring runs over windows of `window` ids that overlap: each scores its last `stride` ids, with those before
as context, so that every id is scored exactly once, many windows in one batch; of equal windows among
SCORED_WINDOWS one is computed, for all of them.  The last bits of float32 products depend on what else is in a
batch, so a window's loss is rounded to 1 / GRID: equal texts get equal scores, but where they are at a rounding's edge.  Long texts are scored a
bounded number of windows at a time.

Defined results: a null or empty text has 0 tokens, a `nll` of 0 and a null `mean_nll`; rows without a
doc_id and repeated rows are scored each, alike; a text of any length is scored whole; ids of equal counts
(ties) have slots in the order of the ids; the text of a special token is ordinary text; an empty table gives an
empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bpe import EMITTED_BYTES, PATTERN, VOCABULARY, Encoder, encode_column, read_ranks, vocabulary
from marlstone.llm.common import saved, tidied
from marlstone.llm.textvec import chunks, mix64, utf8

WIDTH = 16
CLASSES = 32
IN_CLASS = 64
WINDOW = 48
STRIDE = 32
FRACTION = 1.0
ROUNDS = 3
RATE = 0.01
STEP_WINDOWS = 128
BATCH_WINDOWS = 256
SCORED_WINDOWS = 1 << 17
GRID = 1 << 12
SHARD_WINDOWS = 1 << 14
SAMPLE_WINDOWS = 1 << 13
BUNDLED_WINDOWS = 1 << 18
PAGE_BUNDLES = 16
LONG_BYTES = 1 << 22
BLOCK = 4096
NONE = 0xFFFF


@lru_cache(maxsize=1)
def coder_of(raw: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(raw), special_tokens={})


def coder(path: str = VOCABULARY) -> tiktoken.Encoding:
    return coder_of(Path(path).read_bytes())


class Pieces(Encoder):
    """Encodes by pieces kept with their tokens, as operator 4 does; a new piece gets its tokens from the public library."""

    def __init__(self, coder: tiktoken.Encoding):
        self.transducer, self.find = self, None
        self.encode_text = coder.encode_ordinary
        self._forget()

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_text(piece.decode())


@lru_cache(maxsize=1)
def pieces_of(raw: bytes) -> Pieces:
    return Pieces(coder_of(raw))


def encode_texts(column: pa.Array, encoder: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and where each row's begin (rows + 1 values)."""
    if len(column) == 1 and column[0].is_valid and len(column[0].as_buffer()) > LONG_BYTES:  # the pieces' places would take too much memory
        flat = np.array(encoder.encode_text(column[0].as_py()), np.int32)
        return flat, np.array([0, len(flat)])
    return encode_column(column, encoder)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A packed column of the bytes of `data`, whose rows begin at `ends` (rows + 1 values)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _ids(raw: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces_of(raw.value)
        for batch in batches:
            column = batch.column("text")
            for lo, hi in chunks(utf8(column)[1], EMITTED_BYTES):
                flat, at = encode_texts(column.slice(lo, hi - lo), encoder)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), _binary(flat, at * 4)], names=["doc_id", "ids"])

    return tidied(run)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a packed column, and where each row's begin (rows + 1 values)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw), at - at[0]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a packed column, and where each row's begin (rows + 1 values)."""
    raw, at = _bytes(column)
    return raw.view(np.uint32), at // 4


def _counted(stride: int):
    """How often each id occurs and, as id -1, how many windows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = np.zeros(0, np.int64), 0
        for batch in batches:
            ids, at = _flat(batch.column("ids"))
            windows += int((-(-np.diff(at) // stride)).sum())
            more = np.bincount(ids)
            if len(more) > len(total):
                more[: len(total)] += total
                total = more
            else:
                total[: len(more)] += more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], windows))], names=["id", "n"])

    return run


class Shape:
    """Slots of ids, and where the parameters are in one vector."""

    def __init__(self, counts: dict[int, int], vocabulary: int, width: int = WIDTH, classes: int = CLASSES, in_class: int = IN_CLASS, window: int = WINDOW, stride: int = STRIDE):
        self.width, self.classes, self.in_class, self.window, self.stride = width, classes, in_class, window, stride
        slots = classes * in_class
        n = np.zeros(vocabulary, np.int64)
        n[list(counts)] = list(counts.values())
        order = np.lexsort((np.arange(vocabulary), -n))
        self.slot_of = np.full(vocabulary, slots - 1, np.int64)
        self.slot_of[order[: slots - 1]] = np.arange(min(slots - 1, vocabulary))
        rare = order[slots - 1 :]
        self.extra = np.zeros(vocabulary, np.float32)
        if len(rare):
            self.extra[rare] = -np.log((n[rare] + 1.0) / (n[rare] + 1.0).sum())
        self.slot_counts = np.bincount(self.slot_of, weights=n, minlength=slots) + 1.0
        self.sizes = {"E": (slots + 1, width), "P": (window, width), "Q": (width, width), "K": (width, width), "V": (width, width), "C": (classes, width), "c": (classes,), "D": (classes, in_class, width), "d": (classes, in_class)}
        self.total = sum(int(np.prod(s)) for s in self.sizes.values())

    def parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.sizes.items():
            n = int(np.prod(size))
            out[name] = vector[at : at + n].reshape(size)
            at += n
        return out

    def start(self) -> np.ndarray:
        """Small random parameters whose output biases are the slots' frequencies."""
        vector = (np.random.default_rng(7).standard_normal(self.total) * 0.1).astype(np.float32)
        p = self.parts(vector)
        n = self.slot_counts.reshape(self.classes, self.in_class)
        p["c"][:] = np.log(n.sum(axis=1) / n.sum())
        p["d"][:] = np.log(n / n.sum(axis=1, keepdims=True))
        return vector


def _causal(shape: Shape) -> np.ndarray:
    """1 where a scored place may attend: itself and those before it."""
    context = shape.window - shape.stride
    return (np.arange(shape.window)[None, :] <= np.arange(context, shape.window)[:, None]).astype(np.float32)


class Room:
    """Arrays that are used again: a step's are too large to ask for each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *size: int) -> np.ndarray:
        """An array of this size, with whatever it held before."""
        n = math.prod(size)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(size)


def _longest(m: np.ndarray) -> float:
    """The length of the longest row."""
    return math.sqrt(((m * m) @ np.ones(m.shape[1], np.float32)).max(initial=0))


def _softmax(z: np.ndarray, right: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Makes logits their exponentials; returns their sums and the loss of each row's right one.

    A logit counts as -80 at least and 80 at most: float32 holds no more, and no text has been seen to reach it.
    Where they are known to be `bounded` so they are not cut."""
    if not bounded:
        np.clip(z, -80, 80, out=z)
    chosen = z[np.arange(len(z)), right]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    return total, np.log(total) - chosen


def _scattered(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of `into` at places that repeat."""
    at = at.astype(np.uint16)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    into[at[first]] += np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)


def run_model(shape: Shape, p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, gradient: dict[str, np.ndarray] | None = None, room: Room | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """-log p of the targets (windows, stride); 0 where there is none.  With `gradient`, adds that of their mean, each window counted `times`.

    Inputs (windows, window) are slots of the ids before, `slots` for the start of a text, NONE outside it.
    The head's products are taken in the order that needs the fewest: Q K' and V are applied to the scored places
    only, and sums are divided by their norms where they are narrow."""
    room, root = room or Room(), np.float32(shape.width**-0.5)
    n, window, stride, width, context = len(inputs), shape.window, shape.stride, shape.width, shape.window - shape.stride
    flat = lambda m: m.reshape(-1, width)
    there = inputs != NONE
    whole = there.all()
    slots = inputs if whole else np.where(there, inputs, 0)
    x = np.take(p["E"], slots, axis=0, out=room("x", n, window, width), mode="clip")
    x += p["P"]
    xq = room("xq", n, stride, width)
    xq[:] = x[:, context:]
    both = p["Q"] @ p["K"].T * root
    high = stride if gradient is None else 2 * stride
    seen = room("seen", n, high, window)  # what each scored place sees of the others and, later, its gradient
    of_seen = room("of_seen", n, high, width)
    a, q = seen[:, :stride], of_seen[:, -stride:]
    flat_q = np.matmul(flat(xq), both, out=room("q", n * stride, width))
    q[:] = flat_q.reshape(q.shape)
    mask, ones = _causal(shape), np.ones(window, np.float32)
    bounded = _longest(flat_q) * _longest(flat(x)) < 80
    total, y = room("total", n, stride), room("y", n, stride, width)
    np.matmul(q, x.transpose(0, 2, 1), out=a)
    if not bounded:
        np.minimum(a, 80, out=a)
    np.exp(a, out=a)
    a *= mask
    if not whole:
        odd = np.flatnonzero(~there[:, :context].all(axis=1))  # after a text's end there is nothing to score, so only its start is masked
        a[odd] *= there[odd][:, None, :]
    np.matmul(a, ones, out=total)
    np.matmul(a, x, out=y)
    total[total == 0] = 1
    y /= total[:, :, None]
    out = np.matmul(flat(y), p["V"], out=room("out", n * stride, width))
    out += flat(xq)
    scored = np.flatnonzero(targets.reshape(-1) != NONE)
    target = targets.reshape(-1)[scored].astype(np.int64)
    order = np.argsort((target // shape.in_class).astype(np.uint16 if shape.classes > 256 else np.uint8), kind="stable")
    scored, target = scored[order], target[order]
    group, inner = target // shape.in_class, target % shape.in_class
    # A last column of ones takes the biases along.
    m, rows = len(scored), np.arange(len(scored))
    h = room("h", m, width + 1)
    h[:, :width] = np.take(out, scored, axis=0)
    h[:, width] = 1
    first = np.concatenate([p["C"], p["c"][:, None]], axis=1)
    then = np.concatenate([p["D"], p["d"][:, :, None]], axis=2)
    far = _longest(h)
    z = np.matmul(h, first.T, out=room("z", m, shape.classes))
    norm, loss = _softmax(z, group, far * _longest(first) < 80)
    edges = np.searchsorted(group, np.arange(shape.classes + 1)).tolist()
    some = [(g, slice(edges[g], edges[g + 1])) for g in range(shape.classes) if edges[g] < edges[g + 1]]
    w = room("w", m, shape.in_class)
    for g, s in some:
        np.matmul(h[s], then[g].T, out=w[s])
    inner_norm, more = _softmax(w, inner, far * _longest(then.reshape(-1, width + 1)) < 80)
    losses = np.zeros(targets.shape, np.float32)
    losses.reshape(-1)[scored] = loss + more
    if gradient is None:
        return losses
    scale = np.ones(m, np.float32) if times is None else times.astype(np.float32)[scored // stride]
    scale /= max(1, scale.sum())
    z[rows, group] -= norm
    w[rows, inner] -= inner_norm
    norm, inner_norm = (scale / norm)[:, None], (scale / inner_norm)[:, None]
    dfirst = z.T @ (h * norm)
    gradient["C"] += dfirst[:, :width]
    gradient["c"] += dfirst[:, width]
    dh, scaled = room("dh", m, width), np.multiply(h, inner_norm, out=room("scaled", m, width + 1))
    dthen = room("dthen", *then.shape)
    if len(some) < shape.classes:
        dthen[:] = 0
    for g, s in some:
        np.matmul(w[s], p["D"][g], out=dh[s])
        np.matmul(w[s].T, scaled[s], out=dthen[g])
    gradient["D"] += dthen[:, :, :width]
    gradient["d"] += dthen[:, :, width]
    dh *= inner_norm
    more = np.matmul(z, p["C"], out=room("more", m, width))
    more *= norm
    dh += more
    dout = room("dout", n * stride, width)
    if m < len(dout):
        dout[:] = 0
    dout[scored] = dh
    dy = np.matmul(dout, p["V"].T, out=room("dy", n * stride, width))
    gradient["V"] += flat(y).T @ dout
    dy, da = dy.reshape(y.shape), of_seen[:, :stride]
    np.divide(dy, total[:, :, None], out=da)
    common = np.einsum("nsw,nsw->ns", da, y)[:, :, None]
    ds, dq, dx = seen[:, stride:], room("dq", n, stride, width), room("dx", n, window, width)
    np.matmul(da, x.transpose(0, 2, 1), out=ds)
    ds -= common
    ds *= a
    np.matmul(ds, x, out=dq)
    np.matmul(seen.transpose(0, 2, 1), of_seen, out=dx)
    dboth = flat(xq).T @ flat(dq) * root
    gradient["Q"] += dboth @ p["K"]
    gradient["K"] += dboth.T @ p["Q"]
    dxq = np.matmul(flat(dq), both.T, out=flat(room("xq", n, stride, width)))
    dxq += dout
    dx[:, context:] += dxq.reshape(n, stride, width)
    if not whole:
        dx[odd] *= there[odd][:, :, None]
    gradient["P"] += dx.sum(axis=0)
    _scattered(gradient["E"], slots.reshape(-1), flat(dx))
    return losses


def steps_of(times: np.ndarray) -> list[tuple[int, int]]:
    """The windows of each step: STEP_WINDOWS occurrences, or up to the last window that begins among them."""
    step = (np.cumsum(times) - times) // STEP_WINDOWS
    edges = np.flatnonzero(np.diff(step, prepend=-1, append=-1)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def trained(shape: Shape, vector: np.ndarray, windows: np.ndarray, rate: float = RATE, times: np.ndarray | None = None) -> np.ndarray:
    """The parameters after one pass of Adam over windows (n, window + stride) of inputs and targets, each of which occurs `times`."""
    times = np.ones(len(windows), np.int64) if times is None else times
    vector = vector.copy()
    p, grad, room = shape.parts(vector), np.zeros_like(vector), Room()
    g = shape.parts(grad)
    first, second, step_of = np.zeros_like(vector), np.zeros_like(vector), np.empty_like(vector)
    for step, (lo, hi) in enumerate(steps_of(times), 1):
        grad[:] = 0
        part = windows[lo:hi]
        run_model(shape, p, part[:, : shape.window], part[:, shape.window :], g, room, times[lo:hi])
        first *= np.float32(0.9)
        second *= np.float32(0.99)
        np.multiply(grad, np.float32(0.1), out=step_of)
        first += step_of
        grad *= grad
        grad *= np.float32(0.01)
        second += grad
        np.divide(second, np.float32(1 - 0.99**step), out=grad)
        np.sqrt(grad, out=grad)
        grad += np.float32(1e-8)
        np.divide(first, grad, out=step_of)
        step_of *= np.float32(rate / (1 - 0.9**step))
        vector -= step_of
    return vector


def cut(shape: Shape, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, number): the windows of rows of ids, by the first id that each scores."""
    n = np.diff(at)
    each = -(-n // shape.stride)
    row = np.repeat(np.arange(len(n)), each)
    number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return row, at[row] + number * shape.stride, number


def laid(shape: Shape, slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows can be read off: from one place on, a window's inputs and then the last target.

    Of each row the places outside it before its start, the start, its ids, and places outside it up to the last
    window's end.  Returns all windows (a view) and the number of each row's first."""
    n, context = np.diff(at), shape.window - shape.stride
    size = context + 1 + -(-n // shape.stride) * shape.stride
    base = np.cumsum(size) - size
    line = np.full(int(size.sum()) + shape.window + 1, NONE, np.uint16)
    line[base + context] = shape.classes * shape.in_class
    line[np.arange(len(slots)) + np.repeat(base + context + 1 - at[:-1], n)] = slots
    return np.lib.stride_tricks.sliding_window_view(line, shape.window + 1), base


def _filled(shape: Shape, slots: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of windows."""
    every, base = laid(shape, slots, at)
    windows = every[base[row] + first - at[row]]
    return windows[:, : shape.window], windows[:, shape.window - shape.stride + 1 :]


def rounds_for(windows: float, least: int = ROUNDS) -> int:
    """The number of rounds for so many windows."""
    return max(least, math.isqrt(int(windows) // SHARD_WINDOWS))


def unpacked(shape: Shape, windows: np.ndarray) -> np.ndarray:
    """(n, window + stride) of packed windows, whose targets are the inputs after them.  The input after a text's last id is that id, where nothing is scored."""
    return np.concatenate([windows[:, : shape.window], windows[:, shape.window - shape.stride + 1 :]], axis=1)


def hashed(windows: np.ndarray) -> np.ndarray:
    """A hash of what each packed window holds."""
    factors = mix64(np.arange(1, windows.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return mix64(windows.astype(np.uint64) @ factors)


def distinct(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different packed windows in order, and for every window the number of the one that it equals."""
    hashes = np.concatenate([hashed(windows[lo : lo + SAMPLE_WINDOWS]) for lo in range(0, len(windows), SAMPLE_WINDOWS)])
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, np.diff(hashes[order]) != 0)
    same = np.flatnonzero(~new)
    new[same] = (windows[order[same]] != windows[order[same - 1]]).any(axis=1)
    firsts = order[new]  # of equal hashes the order is that of the windows
    number, which = np.empty(len(firsts), np.int64), np.empty(len(order), np.int64)
    number[np.argsort(firsts)] = np.arange(len(firsts))
    which[order] = number[np.cumsum(new) - 1]
    return windows[np.sort(firsts)], which


def _sampled(shape: Shape, fraction: float, rounds: int):
    limit = np.uint64(min(int(fraction * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = _flat(batch.column("ids"))
            if not len(ids):
                continue
            row, first, _ = cut(shape, at)
            every, base = laid(shape, shape.slot_of[ids], at)
            place = base[row] + first - at[row]
            for lo in range(0, len(place), SAMPLE_WINDOWS):
                raw = every[place[lo : lo + SAMPLE_WINDOWS]]
                hashes = hashed(raw)
                chosen = hashes <= limit
                raw, hashes = raw[chosen], hashes[chosen]
                if not len(raw):
                    continue
                turn = (mix64(hashes) % np.uint64(rounds)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(turn), pa.array(hashes.view(np.int64)), _binary(raw, np.arange(len(raw) + 1) * 2 * raw.shape[1])], names=["turn", "place", "ids"])

    return run


def _merged(raw: np.ndarray, place: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal windows begin, and how often each occurs."""
    new = np.append(True, np.diff(place) != 0)[: len(place)]
    same = np.flatnonzero(~new)
    new[same] = (raw[same] != raw[same - 1]).any(axis=1)
    starts = np.flatnonzero(new)
    times = np.ones(len(place), np.int64) if times is None else times
    return starts, np.add.reduceat(times, starts) if len(starts) else times


def _bundled(shape: Shape, fraction: float, rounds: int, shards: int):
    """The windows of a task by the shard that trains on them, about BUNDLED_WINDOWS at a time: a row for each, not for each window.

    Equal windows of a bundle travel once, with how often they occur, so that no shard gets all copies of a frequent one."""

    def bundle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        turn, place = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("turn", "place"))
        raw = np.concatenate([_bytes(b.column("ids"))[0] for b in held]).reshape(len(turn), -1)
        key = turn.astype(np.int64) * shards + (mix64(place.view(np.uint64)) // np.uint64(rounds) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((place, key))
        key, place, raw = key[order], place[order], raw[order]
        starts, times = _merged(raw, place)
        key, place, raw = key[starts], place[starts], raw[starts]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts, len(key))
        turn, shard = (key[starts] // shards).astype(np.int32), (key[starts] % shards).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(turn), pa.array(shard), _binary(place, ends * 8), _binary(times, ends * 8), _binary(raw, ends * raw.shape[1])], names=["turn", "shard", "places", "times", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of.cache_clear()  # all is encoded
        held, n = [], 0
        for batch in _sampled(shape, fraction, rounds)(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= BUNDLED_WINDOWS:
                yield bundle(held)
                held, n = [], 0
        if held:
            yield bundle(held)

    return tidied(run)


def _occurring(shape: Shape, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The different packed windows of bundles by their places, those of one place by what they hold, and how often each occurs."""
    places, counts, windows = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for batch in batches:
        places.append(_bytes(batch.column("places"))[0])
        counts.append(_bytes(batch.column("times"))[0])
        windows.append(_bytes(batch.column("ids"))[0])
    place, times = np.concatenate(places).view(np.int64), np.concatenate(counts).view(np.int64)
    raw = np.concatenate(windows).reshape(len(place), 2 * (shape.window + 1))
    order = np.lexsort((raw.view(f"S{raw.shape[1]}")[:, 0], place))
    raw = raw[order]
    starts, times = _merged(raw, place[order], times[order])
    return raw[starts].view(np.uint16), times


def _in_order(shape: Shape, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The packed windows of bundles in the same order, each as often as it occurs."""
    return np.repeat(*_occurring(shape, batches), axis=0)


def _trainer(shape: Shape, vector: np.ndarray, rate: float):
    """Trains on the windows of a shard, which is a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, times = _occurring(shape, batches)
        if not len(windows):
            return
        windows = unpacked(shape, windows)
        weight = float((windows[:, shape.window :] != NONE).sum(axis=1) @ times)
        after = trained(shape, vector, windows, rate, times)
        blocks = [(after[i : i + BLOCK].astype(np.float64) * weight).astype(np.float32).tobytes() for i in range(0, len(after), BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array([weight] * len(blocks)), pa.array(blocks, pa.binary())], names=["block", "weight", "sums"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    weights: dict[int, float] = {}
    for batch in batches:
        for block, weight, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "weight", "sums")), strict=True):
            more = np.frombuffer(raw, np.float32).astype(np.float64)
            sums[block] = sums[block] + more if block in sums else more
            weights[block] = weights.get(block, 0.0) + weight
    means = [(sums[b] / weights[b]).astype(np.float32).tobytes() for b in sums]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(means, pa.binary())], names=["block", "means"])


def fit(ids: DataFrame, shape: Shape, fraction: float = FRACTION, rounds: int = ROUNDS, rate: float = RATE, windows: int | None = None) -> np.ndarray:
    """The parameters, trained on `fraction` of all `windows` of the packed ids, in `rounds` rounds at least."""
    vector = shape.start()
    tokens = shape.slot_counts.sum() - len(shape.slot_counts)
    rounds = rounds_for(fraction * tokens / shape.stride, rounds)
    if windows is None:
        windows = ids.mapInArrow(_counted(shape.stride), "id long, n long").where("id = -1").agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(fraction * windows / rounds / SHARD_WINDOWS))
    bundles = ids.mapInArrow(_bundled(shape, fraction, rounds, shards), "turn int, shard int, places binary, times binary, ids binary")
    sample, _ = saved(bundles.sortWithinPartitions("turn"), "lm-windows", {"parquet.page.row.count.limit": str(PAGE_BUNDLES)})  # so that a round reads only its pages
    parts = max(1, min(-(-shape.total // BLOCK), int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for turn in range(rounds):
        mine = sample.where(F.col("turn") == turn).select("shard", "places", "times", "ids").repartitionById(shards, F.col("shard"))
        local = mine.mapInArrow(_trainer(shape, vector, rate / math.sqrt(1 + turn)), "block long, weight double, sums binary")
        means = local.repartition(parts, "block").mapInArrow(_averaged, "block long, means binary").collect()
        if means:
            vector = np.frombuffer(b"".join(bytes(r["means"]) for r in sorted(means, key=lambda r: r["block"])), np.float32)
    return vector


def losses(shape: Shape, p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, room: Room | None = None) -> np.ndarray:
    """The sum of -log p over the ids of each row."""
    out, room = np.zeros(len(at) - 1), room or Room()
    if not len(ids):
        return out
    every, base = laid(shape, shape.slot_of[ids], at)
    row, first, _ = cut(shape, at)
    place = base[row] + first - at[row]
    for lo in range(0, len(row), SCORED_WINDOWS):
        mine = slice(lo, lo + SCORED_WINDOWS)
        windows, which = distinct(every[place[mine]])
        found = np.zeros(len(windows), np.float32)
        for low in range(0, len(windows), BATCH_WINDOWS):
            part = windows[low : low + BATCH_WINDOWS]
            found[low : low + BATCH_WINDOWS] = run_model(shape, p, part[:, : shape.window], part[:, shape.window - shape.stride + 1 :], room=room).sum(axis=1)
        found = np.round(found.astype(np.float64) * GRID) / GRID
        out += np.bincount(row[mine], weights=found[which], minlength=len(out))
    return out + np.bincount(np.repeat(np.arange(len(out)), np.diff(at)), weights=shape.extra[ids], minlength=len(out))


def _scorer(shape: Shape, vector: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, room = shape.parts(vector), Room()
        for batch in batches:
            for lo, hi in chunks(_flat(batch.column("ids"))[1], SCORED_WINDOWS * shape.stride):
                part = batch.slice(lo, hi - lo)
                ids, at = _flat(part.column("ids"))
                n, nll = np.diff(at), losses(shape, p, ids, at, room)
                mean = pa.array(nll / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(nll), mean], names=["doc_id", "n_tokens", "nll", "mean_nll"])

    return run


def scores(docs: DataFrame, path: str = VOCABULARY, fraction: float = FRACTION, rounds: int = ROUNDS, **shape_of: int) -> DataFrame:
    """(doc_id, n_tokens, nll, mean_nll) of every row, in nats; the counts that the driver gets are bounded by the vocabulary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids, _ = saved(rows.mapInArrow(_ids(vocabulary(docs.sparkSession, path)), "doc_id long, ids binary"), "lm-ids")
    stride = shape_of.get("stride", STRIDE)
    counts = {r["id"]: r["n"] for r in ids.mapInArrow(_counted(stride), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    windows = counts.pop(-1, 0)
    shape = Shape(counts, coder(path).n_vocab, **shape_of)
    vector = fit(ids, shape, fraction, rounds, windows=windows)
    return ids.mapInArrow(_scorer(shape, vector), "doc_id long, n_tokens long, nll double, mean_nll double")
