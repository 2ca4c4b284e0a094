"""Language-model scoring, WARC and lattice hashing against brute-force versions."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import lattice, links, lm, minhash, warc
from marlstone.llm.common import components

TEXT = "doc_id long, text string, nll string, window int"


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    follow = {w: rng.choice(40, 2) for w in range(40)}
    out = []
    for _ in range(n):
        w, words = int(rng.integers(40)), []
        for _ in range(int(rng.integers(1, 120))):
            words.append(f"word{w}")
            w = int(rng.choice(follow[w]))
        out.append(" ".join(words))
    return out


def test_every_id_is_scored_once_as_by_one_window_at_a_time():
    texts = corpus(20)
    ids = [np.array(lm.coder().encode_ordinary(t), np.uint32) for t in texts] + [np.zeros(0, np.uint32)]
    flat, at = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    shape = lm.Shape(dict(enumerate(np.bincount(flat))), lm.coder().n_vocab, classes=4, in_class=8)
    p = shape.parts(shape.start())
    want = []
    for mine in ids:
        slots, total = shape.slot_of[mine], 0.0
        for t in range(len(mine)):
            first = t - t % shape.stride
            inputs, targets = np.full((1, shape.window), lm.NONE), np.full((1, shape.stride), lm.NONE)
            for j, place in enumerate(range(first + shape.stride - shape.window, t + 1)):
                if 0 <= place:
                    inputs[0, j] = slots[place - 1] if place else shape.classes * shape.in_class
            targets[0, t - first] = slots[t]
            total += lm.run_model(shape, p, inputs, targets).sum() + shape.extra[mine[t]]
        want.append(total)
    assert np.allclose(lm.losses(shape, p, flat, at), want, rtol=1e-4)


def test_probabilities_sum_to_one():
    shape = lm.Shape({1: 5, 2: 3, 9: 1}, 12, classes=2, in_class=2)
    p = shape.parts(shape.start())
    each = [lm.losses(shape, p, np.array([i], np.uint32), np.array([0, 1]))[0] for i in range(12)]
    assert np.exp(-np.array(each)).sum() == pytest.approx(1, abs=1e-4)


def test_held_out_text_is_likelier_than_by_frequency():
    ids = [np.array(lm.coder().encode_ordinary(t), np.uint32) for t in corpus(600)]
    flat, at = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    shape = lm.Shape({int(i): int(n) for i, n in enumerate(np.bincount(flat)) if n}, lm.coder().n_vocab, classes=8, in_class=8)
    half = 300
    row, first, _ = lm.cut(shape, at)
    train = row < half
    windows = np.concatenate(lm._filled(shape, shape.slot_of[flat], at, row[train], first[train]), axis=1).astype(np.uint16)
    before = lm.losses(shape, shape.parts(shape.start()), flat, at)[half:].sum()
    vector = shape.start()
    for _ in range(4):
        vector = lm.trained(shape, vector, windows)
    assert lm.losses(shape, shape.parts(vector), flat, at)[half:].sum() < 0.8 * before


def test_every_window_is_trained_on_and_rounds_grow():
    ids = [np.array(lm.coder().encode_ordinary(t), np.uint32) for t in corpus(80)]
    flat, at = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    shape = lm.Shape(dict(enumerate(np.bincount(flat))), lm.coder().n_vocab, classes=8, in_class=8)
    row, first, _ = lm.cut(shape, at)
    inputs, targets = lm._filled(shape, shape.slot_of[flat], at, row, first)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes() for x in ids], pa.binary())})
    made = [w for b in lm._sampled(shape, lm.FRACTION, 3)([batch]) for w in b.column("ids").to_pylist()]
    assert len(made) == len(row)
    whole = lm.unpacked(shape, np.frombuffer(b"".join(made), np.uint16).reshape(len(row), -1)).astype(np.int64)
    assert (whole[:, shape.window :] == targets).all()
    p = shape.parts(shape.start() * 3)
    assert np.allclose(lm.run_model(shape, p, whole[:, : shape.window], whole[:, shape.window :]), lm.run_model(shape, p, inputs, targets), atol=1e-5)
    assert lm.rounds_for(1000) == lm.ROUNDS and lm.rounds_for(400 * lm.SHARD_WINDOWS) == 20


def test_a_models_gradient_is_that_of_its_mean_loss():
    rng = np.random.default_rng(4)
    shape = lm.Shape({i: 40 - i for i in range(30)}, 40, width=5, classes=4, in_class=4, window=7, stride=4)
    slots, at = rng.integers(0, 16, 61), np.array([0, 1, 1, 18, 61])
    row, first, _ = lm.cut(shape, at)
    inputs, targets = lm._filled(shape, slots, at, row, first)
    for r, f, i, t in zip(row, first, inputs, targets, strict=True):
        for j, place in enumerate(range(f - 3, f + 4)):
            before = 16 if place == at[r] else slots[place - 1] if at[r] < place else lm.NONE
            assert i[j] == before or at[r + 1] < place
            assert j < 3 or t[j - 3] == (slots[place] if place < at[r + 1] else lm.NONE)
    room, vector = lm.Room(), shape.start() * 3
    lm.run_model(shape, shape.parts(vector), inputs[:3], targets[:3], shape.parts(np.zeros_like(vector)), room)  # leaves something in the room
    gradient = np.zeros_like(vector)
    found = lm.run_model(shape, shape.parts(vector), inputs, targets, shape.parts(gradient), room)
    assert np.allclose(found, lm.run_model(shape, shape.parts(vector), inputs, targets), atol=1e-5)
    mean = lambda v: lm.run_model(shape, shape.parts(v), inputs, targets).astype(float).sum() / (targets != lm.NONE).sum()
    for name in shape.sizes:
        there = np.zeros_like(vector)
        shape.parts(there)[name][:] = rng.standard_normal(shape.sizes[name])
        step = there * np.float32(2e-3)
        assert (mean(vector + step) - mean(vector - step)) / 4e-3 == pytest.approx(float(gradient @ there), rel=0.02, abs=2e-3), name


def test_windows_travel_in_bundles_and_none_is_lost(monkeypatch):
    texts = corpus(200) * 2
    ids = [np.array(lm.coder().encode_ordinary(t), np.int32) for t in texts]
    flat, at = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    shape = lm.Shape(dict(enumerate(np.bincount(flat))), lm.coder().n_vocab, classes=8, in_class=8)
    row, first, _ = lm.cut(shape, at)
    every, base = lm.laid(shape, shape.slot_of[flat], at)
    want = sorted(w.tobytes() for w in every[base[row] + first - at[row]])
    batches = [pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes() for x in part], pa.binary())}) for part in (ids[:150], ids[150:], [np.zeros(0, np.int32)])]

    def shards(batches, most):
        monkeypatch.setattr(lm, "BUNDLED_WINDOWS", most)
        made = list(lm._bundled(shape, lm.FRACTION, 3, 2)(iter(batches)))
        keys = {(t, s) for b in made for t, s in zip(b.column("turn").to_pylist(), b.column("shard").to_pylist(), strict=True)}
        mine = lambda b, k: b.filter(pa.array([(t, s) == k for t, s in zip(b.column("turn").to_pylist(), b.column("shard").to_pylist(), strict=True)]))
        return {k: lm._in_order(shape, iter([mine(b, k) for b in made])).tobytes() for k in keys}, sum(b.num_rows for b in made)

    one, rows = shards(batches, 1 << 18)
    size = 2 * (shape.window + 1)
    assert rows == len(one) == 6 and sorted(x[i : i + size] for x in one.values() for i in range(0, len(x), size)) == want
    assert shards(batches[::-1], 100)[0] == one
    assert len(lm._in_order(shape, iter([]))) == 0


def test_equal_windows_are_computed_once_and_count_as_often_as_they_occur(monkeypatch):
    ids = [np.array(lm.coder().encode_ordinary(t), np.uint32) for t in corpus(60)]
    ids = [*ids, *ids[:25], *ids[:10]]
    flat, at = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    shape = lm.Shape(dict(enumerate(np.bincount(flat))), lm.coder().n_vocab, classes=8, in_class=8)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes() for x in ids], pa.binary())})
    bundles = list(lm._bundled(shape, lm.FRACTION, 1, 1)(iter([batch])))
    windows, times = lm._occurring(shape, iter(bundles))
    every = lm._in_order(shape, iter(bundles))
    assert len(np.unique(every, axis=0)) == len(windows) < len(every) == times.sum() == len(lm.cut(shape, at)[0])
    assert sum(len(b.column("ids")[0].as_buffer()) for b in bundles) == windows.nbytes
    monkeypatch.setattr(lm, "STEP_WINDOWS", int(times.sum()))
    one, all_of = (lm.trained(shape, shape.start(), lm.unpacked(shape, w), 1e-3, t) for w, t in ((windows, times), (every, None)))
    assert np.quantile(abs(one - all_of), 0.99) < 1e-5 < abs(one - shape.start()).max()
    assert lm.steps_of(np.array([1] * 7)) == [(0, 7)]
    monkeypatch.setattr(lm, "STEP_WINDOWS", 4)
    assert lm.steps_of(np.array([1, 1, 3, 1, 9, 1])) == [(0, 3), (3, 5), (5, 6)]
    seen, model = [], lm.run_model
    monkeypatch.setattr(lm, "run_model", lambda shape, p, inputs, *more, **named: seen.append(len(inputs)) or model(shape, p, inputs, *more, **named))
    found = lm.losses(shape, shape.parts(all_of), flat, at)
    assert sum(seen) == len(windows) and (found[:25] == found[60:85]).all() and (found[:10] == found[85:]).all()


def test_ids_are_those_of_the_public_library(monkeypatch):
    texts = ["don't  stop \n\n\t now'll we're", "", None, "é€😀 ½٣ x" * 50, " '", "'s'S", "a" * 3000, "<|endoftext|>", "   ", "tail \n "]
    encoder = lm.pieces_of(open(lm.VOCABULARY, "rb").read())
    want = [lm.coder().encode_ordinary(t or "") for t in texts]
    for most in (lm.LONG_BYTES, 1):
        monkeypatch.setattr(lm, "LONG_BYTES", most)
        for part in ([texts], [[t] for t in texts]):
            found = [x for p in part for flat, at in [lm.encode_texts(pa.array(p, pa.string()), encoder)] for x in np.split(flat, at[1:-1])]
            assert [x.tolist() for x in found] == want


def test_scores_of_odd_rows(spark):
    rows = [(1, "some words here"), (1, "some words here"), (None, "x"), (2, None), (3, ""), (4, "long " * 20_000)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], TEXT)
    found = {}
    for r in lm.scores(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert found[1][0] == found[1][1] and found[None][0].n_tokens == 1
    assert [(found[d][0].n_tokens, found[d][0].nll, found[d][0].mean_nll) for d in (2, 3)] == [(0, 0.0, None)] * 2
    assert found[4][0].n_tokens > 19_000 and found[4][0].mean_nll > 0
    assert lm.scores(docs.limit(0)).collect() == []


PAGES = "page_id long, url string, html string, file string, at long"
FAKE = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:page:666>")], b"not a page").decode()


def pages(spark):
    nested = warc._packed(FAKE.encode()).decode("latin-1")
    rows = [(i, f"http://a/{i}?é=\r\n", "<p>" + "x" * (i * 37 % 900) + "\r\n\r\n" + FAKE * (i % 3) + "</p>") for i in range(120)]
    rows += [(500, None, "a"), (501, "", None), (502, "u", ""), (None, "n", "b"), (7, rows[7][1], rows[7][2]), (503, "z", "y" * 300_000 + FAKE), (504, "g", nested)]
    return rows, spark.createDataFrame([(*r, "clash", 0) for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize(("compress", "split"), [(False, 700), (False, 1 << 26), (True, 900), (True, 1 << 26)])
def test_pages_come_back_and_records_in_payloads_dont(spark, compress, split):
    rows, frame = pages(spark)
    found = [tuple(r) for r in warc.round_trip(frame, split, compress).collect()]
    assert sorted(found, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize(("compress", "split"), [(False, 900), (False, 1 << 26), (True, 900), (True, 1 << 26)])
def test_a_long_url_breaks_no_chain(spark, compress, split):
    rows = [(1, "a", "x"), (2, "http://a/" + "é%ж" * 30_000, "y"), (3, "b", FAKE), (4, "c" * 250_000, None), (5, "d", "z")]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], PAGES).coalesce(1)
    assert sorted(tuple(r) for r in warc.round_trip(frame, split, compress).collect()) == rows


def test_chains_that_break(spark, tmp_path):
    whole = b"".join(warc.record([("WARC-Type", "x"), ("N", str(i))], b"b" * i) for i in range(6))
    (tmp_path / "cut.warc").write_bytes(whole[:-20])
    (tmp_path / "none.warc").write_bytes(b"nothing")
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "late.warc").write_bytes(b"junk" + whole)
    (tmp_path / "ok.warc.gz").write_bytes(b"".join(zlib.compress(whole[:0]) * 0 + warc._packed(warc.record([("N", str(i))], b"c")) for i in range(4)))
    found = warc.read_records(spark, f"file://{tmp_path}", 64).groupBy("file").count().collect()
    assert {r["file"]: r["count"] for r in found} == {"cut.warc": 5, "ok.warc.gz": 4}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_decoding_is_to_the_nearest_point():
    x = np.random.default_rng(1).standard_normal((300, 8)) * 2
    near = lattice.decode(x)
    assert ((near % 2 == 0).all(axis=1) | (near % 2 == 1).all(axis=1)).all() and (near.sum(axis=1) % 4 == 0).all()
    off = ((near / 2 - x) ** 2).sum(axis=1)
    for step in lattice.roots():
        assert (off <= (((near + step) / 2 - x) ** 2).sum(axis=1) + 1e-9).all()


def test_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((250, 64))
    near = base[rng.integers(0, 250, 500)]
    near = near + rng.standard_normal(near.shape) * rng.uniform(0.02, 0.3, (500, 1))
    v = np.concatenate([base, near]).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(len(u)), 2) if u[i].astype(float) @ u[j].astype(float) >= 0.95}
    frame = spark.createDataFrame([(i, x.tolist(), "c", 1.0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, cell string, cosine double")
    found = lattice.near_vectors(frame).collect()
    of, n = {r.vec_id: r.class_id for r in found}, {r.vec_id: r.n_links for r in found}
    together = {(a, b) for a, b in want if of.get(a, a) == of.get(b, b)}
    assert len(want) > 300 and len(together) >= 0.9 * len(want)
    parent = list(range(len(u)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(want):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(i) == root(c) for i, c in of.items())
    exact = [i for i in of if all(of.get(j) == of[i] for j in range(len(u)) if root(j) == root(i))]
    assert len(exact) > 300 and all(n[i] == sum(i in p for p in want) for i in exact)


def test_hot_cells_and_lists_are_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (400, 8)).astype(np.uint32)
    posts = spark.createDataFrame([(k, i, 200) for i in range(400) for k in {i % 2, 7}], "key long, node long, n long")
    data = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "node long, data binary")
    found = components(links.links(posts, data, minhash.Matches(4), block=16)).collect()
    same = [(a, b) for a, b in itertools.combinations(range(400), 2) if (x[a] == x[b]).sum() >= 4]
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in same:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    of = {r.node: r.root for r in found}
    assert len(same) > 50 and all(of.get(i, i) == root(i) for i in range(400))
    counts = links.link_counts(spark.createDataFrame(list(of.items()), "node long, root long"), data, minhash.Matches(4), block=16)
    want = {i: sum(i in p for p in same) for i in of}
    assert {r.node: r.n_links for r in counts.collect()} == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (1, [1.0, 0.0])]
    rows += [(9, [0.0, 1.0] * 700), (10, [0.0, 1.0] * 699 + [0.0, 1.01])]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "vec_id long, embedding array<double>, node string, n_links int")
    assert sorted(tuple(r) for r in lattice.near_vectors(frame).collect()) == [(1, 1, 0, 2), (2, 1, 0, 2), (9, 9, 1, 1), (10, 9, 1, 1)]
    assert lattice.near_vectors(frame.limit(0)).collect() == []
