"""The operators outside the training-data subpackage: queries against DuckDB, kernels against small cases."""

import datetime
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import bands, paths
from marlstone.operators import control, flows, history, joins, lines, verdicts
from marlstone.plans import catalogue, surveys  # noqa: F401 - registers its queries
from marlstone.sources import logs
from marlstone.streaming import replay

SF = "/root/testdata/sf0.001"


def norm(v):
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(str(norm(tuple(r[c] for c in columns))) for r in found.collect())
    if name not in catalogue.SQL:
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(catalogue.SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert rows == sorted(str(norm(tuple(r[order.index(c)] for c in columns))) for r in cursor.fetchall())


def changes(spark, *commits):
    rows = [(str(i), k, a, d) for i, files in enumerate(commits) for k, a, d in files]
    return spark.createDataFrame(rows, "sha string, kind string, added long, deleted long")


def panel(spark, *commits):
    return {r.code: (r.value, r.band) for r in history.history_panel(changes(spark, *commits)).collect()}


def test_history_bands(spark):
    doc, code = ("doc", 30, 0), ("code", 70, 0)
    assert panel(spark, *[[doc]] * 2, *[[code]] * 8)["L1.1"] == (20.0, "Healthy")
    assert panel(spark, [code])["L1.1"] == (0.0, "Slop")
    assert panel(spark, *[[code]] * 17, *[[doc]] * 3)["L1.2"] == (85.0, "Slop")
    assert panel(spark, *[[doc, code]] * 3, *[[code]] * 17)["L1.3"] == (15.0, "Healthy")
    assert panel(spark, [doc], [code])["L1.4"] == (30.0, "Healthy")
    assert panel(spark, [("code", 100, 70)])["L1.5"] == (70.0, "Healthy")
    assert panel(spark, [("code", 0, 5)], [("code", 10, 0)])["L1.6"] == (50.0, "Healthy")
    assert panel(spark, [("code", 0, 5)], [("code", 10, 5)])["L1.7"] == (50.0, "Healthy")
    assert panel(spark, [("code", None, None)])["L1.5"] == (None, "n/a")
    assert panel(spark)["L1.1"] == (None, "n/a")


def test_scalars(spark):
    cases = {"README.md": "doc", "a/Dockerfile": "code", "x.PY": "code", "a.png": "other", "spec.feature": "doc"}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.file_kind(F.col("p")).alias("k"))
    assert {r.p: r.k for r in got.collect()} == cases
    tests = {"tests/a.py": True, "src/test_a.py": True, "a/FooTest.java": True, "a/latest.py": False, "contest/a.py": False, "x.spec.ts": True}
    got = spark.createDataFrame([(p,) for p in tests], "p string").select("p", paths.is_test_file(F.col("p")).alias("k"))
    assert {r.p: r.k for r in got.collect()} == tests
    row = spark.range(1).select(bands.guarded(F.lit(1), F.lit(0)).alias("none"), bands.coverage_band(F.lit(90.0)).alias("c"), bands.tally_band(F.lit(4), F.lit(5)).alias("t"), paths.bucket(F.lit("docs/a.py"), F.lit(True)).alias("b")).first()
    assert (row.none, row.c, row.t, row.b) == (None, "Not Healthy", "Not Healthy", "docs")


def test_lines(spark):
    body = "\n".join(["x = 1 "] * 4 + ["y"] * 95 + ["  "]) + "\n"
    files = spark.createDataFrame([(1, body), (2, ""), (3, None)], "id int, text string")
    assert tuple(lines.whitespace_density(lines.lines(files, "id", "text")).first()) == (100, 4, 4.0, "Slop")
    key = "AKIA" + "Q7" * 8
    found = spark.createDataFrame([(1, f"a {key} b {key}"), (2, "pass" + "word = 'hunter2hunter2'"), (3, "api_key = 'changeme-changeme'")], "id int, text string")
    assert {r.rule: (r.secrets, r.files) for r in lines.secrets(found, "id", "text").collect()} == {"cloud_key": (1, 1), "assignment": (1, 1)}
    where = spark.createDataFrame([(1, "see /home/me/x and http://a.b/home/me, ./tmp/x")], "id int, text string")
    assert [r.path for r in lines.absolute_paths(where, "id", "text").collect()] == ["/home/me/x"]
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    twice = spark.createDataFrame([("a", words + "\nonly here"), ("b", words), ("c", None)], "path string, text string")
    row = lines.clone_ratio(twice, "path", "text", 20).first()
    assert (row.lines, row.duplicated) == (3, 2)
    assert lines.clone_ratio(twice.limit(0), "path", "text", 20).first().band == "n/a"


def test_clones_in_any_bundles_and_few_bytes_a_window(spark, tmp_path):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["Ab", "b", "cd-3"][: rng.choice([2, 3])]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += [texts[7], "", None, "12 34\n--\n", "one\n" * 30, " ".join("abcdefgh") + "\n" + " ".join("abcdefgh")]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3).cache()
    for size in (1, 4, 8):
        starts, spans, total = {}, [], 0
        for d, text in enumerate(texts):
            told = [w for w in ([x.lower() for x in re.findall("[A-Za-z]+", line)] for line in (text or "").split("\n")) if w]
            words, total = [(i, w) for i, line in enumerate(told) for w in line], total + len(told)
            for at in range(len(words) - size + 1):
                window = words[at : at + size]
                starts.setdefault(tuple(w for _, w in window), set()).add((d, window[0][0]))
                spans.append((tuple(w for _, w in window), {(d, i) for i, _ in window}))
        want = (total, len(set().union(*(s for w, s in spans if len(starts[w]) > 1))))
        for bundle, shard in ((1 << 21, 1 << 24), (40, 300), (1, 4000)):
            row = lines.clone_ratio(frame, "id", "text", size, bundle, shard).first()
            assert (row.lines, row.duplicated) == want, (size, bundle, shard)
    frame.unpersist()
    many = [(i, "\n".join(" ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(12)) for _ in range(100))) for i in range(80)]
    spark.createDataFrame(many, "id long, text string").coalesce(2).write.parquet(f"{tmp_path}/d")

    def moved() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = moved()
    assert lines.clone_ratio(spark.read.parquet(f"{tmp_path}/d"), "id", "text", 50).first().lines == 8000
    assert moved() - before < 12 * 80 * 1200


@pytest.mark.parametrize(
    ("edges", "paths_"),
    [
        ([], 1), (["entry a", "a exit"], 1), (["entry a", "entry b", "a exit", "b exit"], 2), (["entry a", "a exit", "entry exit"], 2),
        (["entry a", "a m", "entry m", "m b", "b exit", "m exit"], 2), (["entry a", "a b", "a c", "b d", "c d", "d exit", "entry exit"], 3),
        (["entry a", "entry b", "entry c", "a exit", "b exit", "c exit"], 3), (["entry a", "a a", "a exit"], 1),
    ],
)
def test_least_cover(edges, paths_):
    assert flows.least_cover([tuple(e.split()) for e in edges]) == paths_


EVENTS = "f string, ord long, kind string, content string, old string, new string, replace_all boolean"
EDITS = [("a", 0, "edit", None, "x", "y", False), ("a", 1, "write", "one two one", None, None, False), ("a", 2, "edit", None, "one", "1", False), ("a", 2, "edit", None, "one", "1", False), ("a", 3, "edit", None, "zzz", "1", False), ("a", 4, "write", "1 two one", None, None, False), ("a", 5, "edit", None, "1", "2", True), ("a", 6, "write", "2 two one", None, None, False)]


def test_edit_replay(spark):
    row = flows.edit_replay(spark.createDataFrame(EDITS, EVENTS), "f").first()
    assert tuple(row) == ("a", 3, 2, 1, 1, 1, 2, "2 two one")


def test_streams_give_what_batches_do(spark, tmp_path):
    spark.createDataFrame(EDITS, EVENTS).dropDuplicates().coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).json(f"{tmp_path}/in")
    q = replay.stream_replay(stream, "f").writeStream.format("memory").queryName("replayed").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("replayed").collect()] == [("a", 3, 2, 1, 1)]
    when = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(when, "x"), (when, "x"), (when + datetime.timedelta(days=1), "y"), (when + datetime.timedelta(days=9), "z")], "ts timestamp, k string").coalesce(1).write.parquet(f"{tmp_path}/p")
    q = replay.stream_panel(spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/p"), "ts", "k").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("counted").collect()} >= {("x", 2), ("y", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "log.txt").write_text("COMMIT aaa\n\n1\t2\tsrc/a.py\n-\t-\tb.png\nCOMMIT bbb\n\n3\t0\tx => y\n")
    assert sorted(map(tuple, logs.numstat(spark, f"{tmp_path}/log.txt").collect()), key=str) == [("aaa", None, 1, 2, "src/a.py"), ("aaa", None, None, None, "b.png"), ("bbb", None, 3, 0, "x => y")]
    use = '{"timestamp":"t%d","message":{"content":[{"type":"tool_use","name":"%s","input":{"file_path":"/r/a.py","%s":"x"}}]}}'
    (tmp_path / "t.jsonl").write_text("\n".join([use % (1, "Write", "content"), use % (2, "Edit", "old_string"), use % (3, "Read", "content"), '{"tool_use broken', use % (1, "Write", "content")]))
    assert sorted((r.ts, r.kind) for r in logs.transcripts(spark, f"{tmp_path}/t.jsonl", "a.py").collect()) == [("t1", "write"), ("t2", "edit")]
    (tmp_path / "p.tsv").write_text("# c\nrepository\twindow\tu\tv\nr\t2015\t1.5\tn/a\n")
    assert [tuple(r) for r in logs.panel_tsv(spark, f"{tmp_path}/p.tsv").collect()] == [("r", "2015", "u", 1.5)]
    (tmp_path / "l.info").write_text("SF:a.c\nDA:1,4\nDA:2,0\nend_of_record\nSF:b.c\nDA:1,1\nend_of_record\n")
    assert sorted(map(tuple, logs.lcov(spark, f"{tmp_path}/l.info").collect())) == [("a.c", 1, 4), ("a.c", 2, 0), ("b.c", 1, 1)]


def test_refusals(spark):
    short = spark.createDataFrame([("k", i, float(i)) for i in range(5)], "k string, t int, v double")
    chart = control.xmr_chart(short, "k", "t", "v")
    assert {r.centre for r in chart.collect()} == {None}
    assert control.capability(chart, control.xmr_signals(chart, "k", "t"), "k", 0, 1, 0, 1).first().verdict == "insufficient signal"
    none = spark.createDataFrame([("r", "L1.1", "n/a")], "r string, code string, band string")
    assert verdicts.hygiene(none, ["r"]).first().score is None and verdicts.slop_signals(none, ["r"]).first().verdict == "n/a"
    gap = joins.parity(spark.createDataFrame([(1, None), (2, 3)], "k int, v int"), spark.createDataFrame([(1, None), (3, 3)], "k int, v int"), "k", "v")
    assert {r.k: r.status for r in gap.collect()} == {1: "EQUAL", 2: "GAP", 3: "GAP"}
