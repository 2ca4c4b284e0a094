"""MinHash, toxicity, BPE, line dedup, mixing and fingerprints against brute-force versions and SQL."""

import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import bpe, fingerprints, linededup, lm, minhash, mixing, textvec, toxicity

DOCS = "doc_id long, text string, source string, sig string, tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "clash", 1) for r in rows], DOCS)


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n))


def near_copies(seed=1):
    rng, rows = random.Random(seed), []
    for g in range(12):
        words = prose(rng, rng.choice([3, 40, 150])).split()
        for _ in range(rng.choice([1, 2, 4, 40])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 10**6)}"
            rows.append((len(rows) + 10, " ".join(copy)))
        rows.append((len(rows) + 10, " ".join(words).upper() + "!"))
    rng.shuffle(rows)
    return [*rows, (1, None), (2, ""), (3, "?!"), (None, rows[0][1]), (rows[0][0], rows[0][1])]


def groups_by_brute_force(rows):
    some = [(d, t) for d, t in rows if d is not None and t is not None]
    at, sig = minhash.signatures(pa.array([t for _, t in some]), minhash.SHINGLE_WORDS, minhash.COORDINATES)
    parent = {some[i][0]: some[i][0] for i in at}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(at)), 2):
        if (sig[i] == sig[j]).sum() >= minhash.THRESHOLD:
            a, b = sorted((root(some[at[i]][0]), root(some[at[j]][0])))
            parent[b] = a
    counts = {}
    for d in parent:
        counts[root(d)] = counts.get(root(d), 0) + 1
    return sorted((d, root(d)) for d in parent if counts[root(d)] > 1)


def links_by_brute_force(rows):
    """doc_id: the number of other signatures that collide with one of its."""
    some = [(d, t) for d, t in rows if d is not None and t is not None]
    at, sig = minhash.signatures(pa.array([t for _, t in some]), minhash.SHINGLE_WORDS, minhash.COORDINATES)
    distinct = np.unique(sig, axis=0)
    return {some[i][0]: int(((distinct == s).sum(axis=1) >= minhash.THRESHOLD).sum()) - 1 for i, s in zip(at, sig, strict=True)}


def test_minhash_groups(spark):
    rows = near_copies()
    want = groups_by_brute_force(rows)
    assert len(want) > 30
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == want
    links = links_by_brute_force(rows)
    assert all(r.n_links == links[r.doc_id] for r in found) and max(links.values()) > 3
    kept = minhash.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "sig", "tokens"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in rows if dict(want).get(d, d) == d)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(5)
    bad = ["zkworp", "vlimqag", "xuttbop", "qwazzik"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("the of and in to that was his with for".split()) + rng.choice("abcdefgh") for _ in range(rng.randint(30, 200))]
        if i % 4 == 0:
            for _ in range(1 + len(words) // 12):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(i % 4 == 0)))
    labels += [(1, 1), (2, None), (None, 1), (9999, 1)]
    rows += [(700, None), (701, ""), (None, "zkworp " * 50), (0, rows[0][1]), (702, "fine words " * 60_000)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = {r.doc_id for r in toxicity.without_toxic(docs, known).collect()}
    held = [i for i in range(0, 600, 3)]
    assert np.mean([i not in kept for i in held if i % 4 == 0]) > 0.95 and np.mean([i in kept for i in held if i % 4]) > 0.97
    assert {700, 701, 702} <= kept and None not in kept
    found = [r.doc_id for r in toxicity.toxic(docs, known).collect()]
    assert found.count(0) == 2
    assert toxicity.toxic(docs, known.limit(0)).collect() == [] and toxicity.without_toxic(docs.limit(0), known).collect() == []


ODD = ["", " ", "a", "don't we'll I'VE 'twas 's", "  two  spaces \n\n tabs\t\tend  ", "éèß 日本語 🙂🙃  x ½ ²", "<|endoftext|>", "x" * 5000, "1234567 12,5", "‍́á", "'" * 9, "a\r\nb\x00c"]


def test_bpe_is_that_of_another_implementation(spark):
    rng = random.Random(2)
    pool = "abc'stXYZ 0129.,!\n\téß日🙂́"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(900, None), (None, "n"), (3, texts[3])]
    found = bpe.encoded(frame(spark, rows)).collect()
    want = {d: lm.coder().encode_ordinary(t) for d, t in enumerate(texts)}
    assert all(r.tokens == want[r.doc_id] and r.round_trip and r.n_tokens == len(r.tokens) for r in found if r.doc_id not in (900, None))
    assert [(r.n_tokens, r.tokens) for r in found if r.doc_id == 900] == [(0, None)]
    back = bpe.decoded(bpe.encoded(frame(spark, rows))).collect()
    assert {r.doc_id: r.text for r in back} == dict(rows)
    both = bpe.tokenized(frame(spark, rows))
    assert both.columns[-2:] == ["n_tokens", "_tokens"] and both.count() == len(rows)


def test_streams_decode_as_a_whole():
    bytes_of = {i: bytes([i]) for i in range(256)}
    rng = random.Random(4)
    for _ in range(300):
        raw = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xED, 0xA0, 0xFF]) for _ in range(rng.randint(0, 12)))
        stream = bpe.StreamDecoder(bytes_of)
        assert "".join(stream.feed([b]) for b in raw) + stream.end() == raw.decode("utf-8", "replace")


def in_duckdb(sql, rows):
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())})
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(sql).fetchall()


def test_line_dedup_is_its_sql(spark):
    rng = random.Random(6)
    lines = [prose(rng, 4) for _ in range(60)] + ["", "  ", "menu", " menu", "menu\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) + "\n" * rng.randint(0, 2), "s") for i in range(150)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "\n\n", None), (None, "menu\nown line of this", "s"), (7, rows[7][1], "s"), (203, "\n".join(f"l{i}" for i in range(30_000)), "s")]
    want = sorted(map(str, in_duckdb(linededup.sql(), rows)))
    assert sorted(str(tuple(r)) for r in linededup.line_report(frame(spark, rows).repartition(3), keys_per_shard=5000, bundle_bytes=3000).collect()) == want
    kept = linededup.line_dedup(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "sig", "tokens"] and kept.count() == len(rows)
    assert linededup.line_dedup(frame(spark, rows).limit(0)).collect() == []


def test_of_repeated_lines_one_stays_in_the_corpus(spark):
    rng = random.Random(16)
    lines = [prose(rng, 4) for _ in range(50)] + ["", "  ", "menu", " menu"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))), "s") for i in range(140)]
    rows += [(300, "again\n" * 9 + "once", "s"), (301, None, "s"), (302, "", "s"), (None, "menu\nno other has this", "s"), (303, "no\nother", "s")]
    rows += [(i, "a copy of\na page that\nfour have", "s") for i in (407, 405, 406, 408)] + [(7, rows[7][1], "s")]
    rng.shuffle(rows)
    by = {}
    for d, text, _ in rows:
        for k in {x.strip() for x in (text or "").split("\n")} - {""}:
            by.setdefault(k, []).append(2**63 if d is None else d)
    want = []
    for d, text, _ in rows:
        seen, kept = set(), []
        for line in (text or "").split("\n"):
            k = line.strip()
            many = k and len(by[k]) >= linededup.LEAST_DOCS and (2**63 if d is None else d) != min(by[k])
            if k in seen or many:
                continue
            kept.append(line)
            seen |= {k} - {""}
        want.append((d, None if text is None else "\n".join(kept)))
    found = [(r.doc_id, r.text) for r in linededup.line_dedup(frame(spark, rows).repartition(3), keys_per_shard=60, bundle_bytes=500).collect()]
    once = lambda pairs: sorted(map(str, (p for p in pairs if p[0] != 7)))
    assert once(found) == once(want)
    sevens = [t.split("\n") for d, t in found if d == 7]  # two rows have this doc_id: one of them holds what both would keep
    assert len(sevens) == 2
    left = [x.strip() for _, t in found for x in (t or "").split("\n") if x.strip()]
    assert set(left) == set(by) and all(left.count(k) == 1 for k in by if len(by[k]) >= linededup.LEAST_DOCS)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 63, 20_000, dtype=np.uint64))
    made = linededup.PerfectHash.load(linededup.PerfectHash.build(keys, np.arange(len(keys))).dump())
    assert sorted(made.index(keys)) == list(range(len(keys))) and (made.count(keys) == np.arange(len(keys))).all()
    assert (made.count(keys + np.uint64(1 << 40)) > 0).mean() < 0.001


@pytest.mark.parametrize("weights", [{"a": 3.0, "b": 1.0, "c": 0.0}, {None: 2.0}, {}])
def test_mixing_is_its_sql(spark, weights):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(300)]
    rows += [(300, None, "a"), (None, "x y", "b"), (5, rows[5][1], rows[5][2]), (301, "t " * 500, "b")]
    want = sorted(map(str, in_duckdb(mixing.sql(weights), rows)))
    assert sorted(str(tuple(r)) for r in mixing.mixed(frame(spark, rows), weights).collect()) == want
    taken = {r.doc_id for r in mixing.mixed(frame(spark, rows), weights).collect()}
    assert {r.doc_id for r in mixing.mixture(frame(spark, rows), weights=weights).collect()} == taken
    assert mixing.mixed(frame(spark, rows).limit(0), weights).collect() == []


def test_fingerprints(spark):
    rng = random.Random(9)
    big = prose(rng, 4000)
    rows = [(1, big), (2, " ".join(big.split()[500:1500])), (3, prose(rng, 800)), (4, None), (5, ""), (6, "one two"), (None, big), (1, big)]
    made = fingerprints.fingerprints(frame(spark, rows), fraction=1 / 8).collect()
    for r, (_, text) in zip(made, rows, strict=True):
        data, offsets = textvec.utf8(pa.array([text], pa.string()))
        hashes, _ = textvec.shingle_hashes(*textvec.word_hashes(data, offsets), fingerprints.SHINGLE_WORDS)
        assert r.n_shingles == len(hashes) and r.sketch == sorted(int(h) for h in set(hashes.tolist()) if h < 1 << 61)
    sketches = fingerprints.fingerprints(frame(spark, rows[:6]), fraction=1 / 8)
    found = {(r.a, r.b): r.containment for r in fingerprints.containment(sketches, sketches).collect()}
    assert found[2, 1] == 1.0 and (3, 1) not in found and (1, 2) not in found
    union = fingerprints.merged(sketches.where("doc_id IN (1, 3)").selectExpr("'g' AS g", "sketch"), "g").first()
    assert set(union.sketch) == set(made[0].sketch) | set(made[2].sketch)
    assert fingerprints.fingerprints(frame(spark, rows).limit(0)).collect() == []


def test_short_documents_have_a_sketch_of_the_fraction_in_use(spark):
    rng = random.Random(19)
    words = prose(rng, 3000).split()
    short = [(i, " ".join(words[i * 40 : i * 40 + 20])) for i in range(60)]
    sketches = fingerprints.fingerprints(frame(spark, [*short, (100, " ".join(words))])).cache()
    assert sketches.where("size(sketch) = 0").count() == 0
    found = fingerprints.containment(sketches.where("doc_id < 100"), sketches.where("doc_id = 100")).collect()
    assert {r.a for r in found if r.containment == 1.0} == set(range(60))
