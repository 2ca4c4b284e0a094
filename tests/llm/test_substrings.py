"""Repeated passages against a brute-force search."""

import random
import re
from collections import defaultdict

import pytest

from marlstone.llm import substrings

SCHEMA = "doc_id long, text string, bundle string, places int"


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(rows, least):
    """(doc_id, start, n) of the runs covered by windows of `least` words that another row has."""
    where = defaultdict(set)
    for i, (_, text) in enumerate(rows):
        w = words(text)
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add(i)
    out = []
    for doc, text in rows:
        w, end = words(text), -1
        for p in range(len(w) - least + 1):
            if doc is not None and len(where[tuple(w[p : p + least])]) > 1:
                if p > end:
                    out.append([doc, p, least])
                else:
                    out[-1][2] = p + least - out[-1][1]
                end = p + least
    return sorted(map(tuple, out))


def run(spark, rows, **parameters):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    found = substrings.repeated_passages(docs, **parameters).collect()
    return sorted((r.doc_id, r.start_word, r.n_words) for r in found), found


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([9, 12, 30, 70]))] for _ in range(5)]
    rows = []
    for i in range(30):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        rows.append((i, " ".join(text).title() if i % 2 else ",  ".join(text)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "same " * 40)]
    found, full = run(spark, rows, base=5, gram=3, least=10, bundle_bytes=700)
    assert found == brute(rows, 10)
    assert all(r.longest <= r.n_words and r.longest % 10 == 0 for r in full)


def test_nothing_to_find(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "a b c " * 30)], [(1, " ".join(map(str, range(90)))), (2, "short")]):
        assert run(spark, rows, base=5, gram=3, least=10)[0] == []


def test_repeated_rows_ties_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    assert run(spark, [(7, text), (7, text)])[0] == [(7, 0, 60), (7, 0, 60)]
    assert run(spark, [(7, text), (None, text)])[0] == []


def test_a_very_long_text(spark):
    long = " ".join(f"n{i}" for i in range(40_000))
    found, full = run(spark, [(1, long), (2, "before " + long + " after")])
    assert found == [(1, 0, 40_000), (2, 1, 40_000)]
    assert {r.longest for r in full} == {25_600}


def test_parameters(spark):
    with pytest.raises(ValueError):
        run(spark, [], base=20, least=50)
