"""Independent versions of hashing and scoring, whole passages cut, budgets with repeated ids, and odd rows through every stage."""

import random
import re

import corpus_pipeline
import pyarrow as pa
import pytest
import zstandard

from marlstone.llm import fingerprints, linededup, minhash, mixing, substrings, textvec, toxicity, warc
from tests.llm.test_text_operators import DOCS, frame, prose

MASK = (1 << 64) - 1


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def mix(x):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x


def shingles(text, k):
    """The hashes of a text's shingles, one number at a time."""
    base, step = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    each = [mix(sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w.encode())) & MASK) for w in words(text)]
    runs = [each[i : i + k] for i in range(len(each) - k + 1)] if len(each) >= k else [each] if each else []
    return [mix(sum(h * pow(step, i, 1 << 64) for i, h in enumerate(r)) & MASK) for r in runs]


TEXTS = ["One two THREE four", "a", "", "?!", "naïve café naïve café x1", "word " * 300, "z" * 3000 + " end of it all", "x" * (textvec.BLOCK_BYTES + 5) + " y " * 40]


def test_hashes_are_those_of_plain_arithmetic(spark):
    for k in (minhash.SHINGLE_WORDS, fingerprints.SHINGLE_WORDS):
        data, offsets = textvec.utf8(pa.array(TEXTS[:7]))
        hashes, at = textvec.shingle_hashes(*textvec.word_hashes(data, offsets), k)
        assert [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [shingles(t, k) for t in TEXTS[:7]]
    made = fingerprints.fingerprints(frame(spark, list(enumerate(TEXTS[:7])))).collect()
    for r in made:
        h = shingles(TEXTS[r.doc_id], fingerprints.SHINGLE_WORDS)
        assert r.n_shingles == len(h) and sorted(x & MASK for x in r.sketch) == sorted({x for x in h if x < 1 << 63})
    factors = [mix(i * 0x9E3779B97F4A7C15 & MASK) | 1 for i in range(1, minhash.COORDINATES + 1)]
    at, sig = minhash.signatures(pa.array(TEXTS[:7]), minhash.SHINGLE_WORDS, minhash.COORDINATES)
    for row, s in zip(at, sig, strict=True):
        h = shingles(TEXTS[row], minhash.SHINGLE_WORDS)
        assert s.tolist() == [min((x * f & MASK) >> 32 for x in h) for f in factors]


def test_a_word_longer_than_a_block():
    data, offsets = textvec.utf8(pa.array([TEXTS[7], "ab"]))
    hashes, _ = textvec.word_hashes(data, offsets)
    assert int(hashes[0]) == mix(sum((ord("x") + 1) * p for p in powers(len(words(TEXTS[7])[0]))) & MASK) and int(hashes[-1]) == mix((98 + 99 * 0x9E3779B97F4A7C15) & MASK)


def powers(n):
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x = x * 0x9E3779B97F4A7C15 & MASK
    return out


def test_toxicity_is_its_definition(spark):
    """Every document scored by compressing its windows one by one, with compressors made anew."""
    rng = random.Random(7)
    bad = ["zkworp", "vlimqag", "xuttbop"]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice("the of and in to that was".split()) + rng.choice("abcd") for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            for _ in range(1 + len(text) // 10):
                text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels += [(i, int(i % 4 == 0))] if i % 3 else []
    rows += [(500, None), (501, ""), (502, "zkworp vlimqag " * 3000), (500, "clean")]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    parameters = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def length(content, piece):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=parameters)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress(piece))

    want = []
    for doc, text in rows:
        raw, gain = (text or "").encode().lower(), 0
        for at in range(0, len(raw), toxicity.WINDOW):
            piece = raw[at : at + toxicity.WINDOW]
            gain += max(0, length(model.ordinary, piece) - length(model.toxic + model.ordinary, piece))
        score = gain / max(len(raw), toxicity.LEAST_LENGTH)
        if score > model.threshold:
            want.append((doc, round(score, 9), -(-len(raw) // toxicity.WINDOW)))
    found = sorted((r.doc_id, round(r.score, 9), r.windows) for r in toxicity.toxic(docs, known).collect())
    assert found == sorted(want) and 40 < len(want) < 90 and 502 in {d for d, _, _ in want}


def test_the_fit_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(i // 2, prose(rng, 30) + (" zkworp" * 4 if i % 4 < 2 else "")) for i in range(120)]
    known = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.fit(frame(spark, order).repartition(n), known) for n, order in ((1, rows), (3, rows[::-1]))]
    assert models[0].dump() == models[1].dump()


def test_a_mixture_with_repeated_ids_stays_within_its_budget(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9) if i % 3 else None, " ".join(["w"] * rng.randint(0, 12)), rng.choice(["a", "a", "b", None])) for i in range(200)]
    docs = frame(spark, rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    out = mixing.mixture(docs, {"a": 2.0})
    assert out.columns == docs.columns
    taken = mixing.mixed(docs, {"a": 2.0}).collect()
    used = sum(len(r.text.split()) for r in out.collect())
    assert used == sum(r.tokens for r in taken) <= int(total * mixing.SHARE) and out.count() == len(taken)
    assert mixing.mixture(docs.limit(0), {"a": 2.0}).collect() == []


def test_later_occurrences_of_passages_are_cut(spark):
    rng = random.Random(3)
    passage = prose(rng, 70)
    own = [prose(rng, 30) for _ in range(4)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]}, {passage.upper()}; {own[3]}"), (3, "short text"), (None, passage), (4, None), (5, "")]
    out = {r.doc_id: r.text for r in substrings.without_repeats(frame(spark, rows).coalesce(1)).collect()}
    assert out[1] == rows[0][1] and out[2] == f"{own[2]}, {own[3]}" and out[None] == "" and (out[3], out[4], out[5]) == ("short text", None, "")
    assert substrings.without_repeats(frame(spark, rows).limit(0)).collect() == []
    alone = [(1, f"{passage} middle {passage}"), (2, "x y z")]
    assert sorted(r.text for r in substrings.without_repeats(frame(spark, alone)).collect()) == sorted(t for _, t in alone)


def test_line_counts_have_no_cap_and_the_index_can_be_asked(spark):
    lines = [(i, "menu\nown " + str(i)) for i in range(70)]
    out, index = linededup._run(frame(spark, lines), 4, 8, 400, True)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] == "menu\nown 0" and kept[69] == "own 69"
    data, offsets = textvec.utf8(pa.array(["menu\nown 3\nunknown"]))
    assert index.counts(linededup.lines_of(data, offsets)[2]).tolist() == [70, 1, 0]
    made = linededup.PerfectHash.load(linededup.PerfectHash.build(linededup.lines_of(data, offsets)[2], pa.array([1, 70_000, 5_000_000_000]).to_numpy()).dump())
    assert sorted(made.count(linededup.lines_of(data, offsets)[2]).tolist()) == [1, 70_000, 5_000_000_000]


def test_other_writers_records(spark, tmp_path):
    response = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    parts = [
        warc.record([("WARC-Type", "warcinfo")], b"x"),
        warc.record([("WARC-Type", "response"), ("WARC-Target-URI", "http://a/b%2Fc"), ("WARC-Record-ID", "<urn:uuid:1>")], response),
        warc.record([("WARC-Type", "resource"), ("WARC-Target-URI", "http://d"), ("WARC-Truncated", "length")], b"cut"),
        warc.record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    assert sorted((tuple(r) for r in warc.read_pages(spark, f"file://{tmp_path}", 100).collect()), key=str) == [(None, "http://a/b%2Fc", "<p>hi</p>"), (None, "http://d", "cut")]


def odd(spark):
    rng = random.Random(11)
    long = "\n".join(prose(rng, 12) for _ in range(4000))
    rows = [(1, None, "src0"), (2, "", "src0"), (None, "no id at all", None), (3, "a tie", "src1"), (4, "a tie", "src1"), (5, "a tie", "src1"), (5, "a tie", "src1"), (6, long, "src2"), (7, long + "\nand more", ""), (8, "  \n\n", "src0"), (9, "é🙂 \x00 x", "src9")]
    rows += [(20 + i, prose(rng, 25), "src0") for i in range(20)]
    return frame(spark, rows)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = odd(spark)
    out = run(spark, docs, "/root/testdata/sf0.001")
    assert out.columns[: len(docs.columns)] == docs.columns if name == "byte-level bpe" else out.schema == docs.schema
    before, after = docs.collect(), out.collect()
    if name in ("toxicity", "byte-level bpe"):
        assert sorted(map(str, (r.doc_id for r in after))) == sorted(str(r.doc_id) for r in before)
    if name == "line dedup":
        texts = [r.text for r in after if r.doc_id in (3, 4, 5)]
        assert len(after) == len(before) and texts.count("a tie") == 1 and [r.text for r in after if r.doc_id == 1] == [None]
    if name == "minhash near-dedup":
        assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.doc_id not in (4, 5, 7))
    if name == "mixing":
        tokens = [sum(len(re.findall(r"[^ \t\n\r]+", r.text or "")) for r in rows) for rows in (before, after)]
        assert 0 < tokens[1] <= int(tokens[0] * mixing.SHARE)
    if name == "byte-level bpe":
        assert out.columns[-2:] == ["n_tokens", "_tokens"]
        assert {r.doc_id: (r.n_tokens, r._tokens) for r in after if r.doc_id in (1, 2)} == {1: (0, None), 2: (0, [])}
    assert run(spark, spark.createDataFrame([], DOCS), "/root/testdata/sf0.001").collect() == []
