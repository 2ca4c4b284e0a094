"""Failed tests, host predicates, proposals, manifests, rendered reports and ordered streams."""

import datetime
import json

from pyspark.sql import functions as F

from marlstone.operators import gates, reports, verdicts
from marlstone.streaming import replay

HOST = ["unix", 'target_os="linux"', 'target_arch = "x86_64"', 'feature="std"']


def test_predicates_have_three_values(spark):
    cases = {
        "unix": True, "windows": False, 'target_os = "linux"': True, 'target_os = "macos"': False, 'feature = "x"': None, "debug": None, "not(windows)": True, 'not(feature = "x")': None,
        'all(unix, target_os = "macos")': False, 'all(unix, feature = "x")': None, 'any(windows, feature = "std")': True, 'any(windows, feature = "x")': None, 'any(windows, target_os="macos")': False,
        'all(not(any(windows, target_arch = "arm")), unix)': True, "all()": True, "any()": False, "": True, None: True,
    }
    got = gates.compiled(spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, cfg string"), HOST)
    assert [r.compiled for r in got.orderBy("i").collect()] == list(cases.values())


def test_failures_and_proposals(spark):
    rows = [
        ('assert!(f(1) == 2, "sum is off")', "i32", "sum is off"), ('assert!(x, "late")', "impl Future<Output = i32>", "late"), ('let p = mem::zeroed(); assert!(p, "m")', "i32", "null pointer"),
        ('assert!(f(), "m")', None, "index out of bounds"), ("assert!(f())", "i32", "x"), ('assert!(f(), "m")', "i32", None),
    ]
    got = gates.failures(spark.createDataFrame(rows, "body string, return_type string, message string")).collect()
    assert [r.bucket for r in got] == ["divergence", "wrong_channel", "invalid_fixture", "incidental_panic", "incidental_panic", "incidental_panic"]
    offers = [("1, x=2", "result == 3", "adds"), ("", "r", "e"), ("1", "x = 2", "e"), ("open('f')", "r", "e"), ("1", "r", " "), ("1" * 3000, "r", "e"), (None, None, None)]
    got = gates.validated(spark.createDataFrame(offers, "concrete_input string, expected_property string, plain_explanation string")).collect()
    assert [r.fault for r in got] == ["", "concrete_input is empty", "expected_property is no expression", "concrete_input reaches out", "plain_explanation is empty", "concrete_input is too long", "concrete_input is empty"]


def test_manifest_card_and_envelope(spark, tmp_path):
    (tmp_path / "corpus.toml").write_text('[[repo]]\nslug = "a/b"\nlang = "go"\ncommit = "c0"\n')
    assert [tuple(r) for r in gates.manifest(spark, f"{tmp_path}/corpus.toml").collect()] == [("a/b", "go", "c0", None)]
    panel = spark.createDataFrame([("r", "L1.2", None, "n/a"), ("r", "L1.1", 3.5, "Slop")], "repo string, code string, value double, band string")
    assert reports.card(panel, "repo").first().markdown.split("\n")[2:] == ["| L1.1 | 3.5 | Slop |", "| L1.2 | n/a | n/a |"]
    assert json.loads(reports.envelope(panel, "repo").first().json)["L1.1"] == {"value": 3.5, "band": "Slop"}


def test_runs_races_and_grades(spark):
    runs = spark.createDataFrame([("a", 1, 0, True), ("a", 2, 1, True), ("b", 1, 0, False), ("b", 2, 124, True), ("c", 1, 0, True)], "k string, run int, code int, ran boolean")
    got = {r.k: (r.tally, r.band, r.reason) for r in verdicts.run_tally(runs, "k").collect()}
    assert got == {"a": ("1/2", "Not Healthy", None), "b": ("n/a", "n/a", "did not run"), "c": ("1/1", "Healthy", None)}
    assert {r.k: r.verdict for r in reports.stress(runs, ["k"]).collect()} == {"a": "race-observed", "b": "n/a", "c": "no-race-in-stress"}
    columns = "neutral long, promiscuous long, unresolved long, meter_ran boolean, declared long, visited long, admitted long, widest long, score double"
    rows = [(5, 0, 0, True, 1, 1, 1, 3, 0.9), (5, 1, 9, True, 1, 1, 1, 3, 0.9), (1, 0, 9, True, 1, 1, 1, 3, 0.9), (5, 0, 0, True, 1, 1, 1, 50, 0.1), (0, 0, 0, True, 4, 0, 0, None, None), (0, 0, 0, False, 0, 0, 0, None, None), (0, 0, 0, True, 0, 0, 0, None, 0.5)]
    got = verdicts.graded(spark.createDataFrame(rows, columns), 20).collect()
    assert [(r.basis, r.grade) for r in got] == [("measured", "A"), ("measured", "F"), ("silent", None), ("measured", "D"), ("unread", None), ("no-source", None), ("measured", "C")]


def test_a_stream_applies_late_events_in_their_order(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "f string, ord long, kind string, content string, old string, new string, replace_all boolean, ts timestamp"
    batches = [
        [("a", 2, "edit", None, "one", "two", False, at(20)), ("a", 2, "edit", None, "one", "two", False, at(20))],
        [("a", 1, "write", "one", None, None, False, at(10))],
        [("a", 3, "write", "end", None, None, False, at(9000)), ("b", 1, "write", "x", None, None, False, at(9000))],
        [("b", 9, "edit", None, "x", "y", False, at(30000))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    q = replay.stream_replay(stream, "f", "ts", "1 hour").writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("late").collect():
        last[r.f] = max(last.get(r.f, (0, 0, 0, 0)), (r.writes, r.applied, r.divergences, r.unanchored))
    assert last["a"][1] == 1 and last["a"][3] == 0


def test_hook_reports_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a.py", "def f(x=1): pass\n"), ("b.py", "x = 1\n")], "path string, text string").coalesce(1).write.json(f"{tmp_path}/in")
    seen = []
    files = spark.readStream.schema("path string, text string").json(f"{tmp_path}/in")
    replay.stream_hook(files, lambda batch, number: seen.extend(r.report for r in batch.collect())).trigger(availableNow=True).start().awaitTermination()
    assert seen == ["a.py:1 L1.21.14 f(x)"]


def test_open_modes_and_ranks(spark):
    listed = reports.listed(spark.createDataFrame([("g", i) for i in range(5)], "k string, v int"), ["k"], [F.col("v").desc()], 2).collect()
    assert [(r.v, r.rank, r.more) for r in listed] == [(4, 1, 3), (3, 2, 3)]
