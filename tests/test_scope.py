"""Paths, trees of files, coverage reports and logs against small cases."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import lexical, paths
from marlstone.sources import coverage, files, logs


def put(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_names(spark):
    cases = {
        "Foo.Tests/a.cs": (True, False), "src/LatestTests.cs": (True, True), "src/Latest.java": (False, False), "test-tcp.c": (False, True), "a/test.sh": (False, True),
        "a_test.go": (True, True), "x.spec.ts": (True, True), "spec/x.rb": (True, False), "a/UserSpecs.cs": (True, True), "contest/a.py": (False, False), "env/a.py": (False, False),
    }
    p = F.col("p")
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.is_test_file(p).alias("a"), paths.is_test_name(p).alias("b"), paths.is_vendored(p).alias("v"))
    found = {r.p: (r.a, r.b) for r in got.collect()}
    assert found == cases
    assert {r.p for r in got.where("v").collect()} == {"env/a.py"}


def test_a_tree_is_listed_without_links_and_nested_checkouts(spark, tmp_path):
    put(tmp_path, {"a.py": "x = 1\n", "pkg/__init__.py": "", "pkg/b.py": "y = 2\n", "sub/.git": "gitdir: x\n", "sub/c.py": "z", "clone/.git/config": "", "clone/deep/d.py": "", ".git/HEAD": "ref", "far/e.py": ""})
    (tmp_path / "link").symlink_to(tmp_path / "far")
    own = files.own_files(files.listed(spark, str(tmp_path), "r"))
    assert {r.path for r in own.collect()} == {"a.py", "pkg/__init__.py", "pkg/b.py", ".git/HEAD", "far/e.py"}
    read = {r.path: r for r in files.read(own.union(spark.createDataFrame([("r", "gone.py", 1, False)], own.schema)), str(tmp_path)).collect()}
    assert bytes(read["a.py"].content) == b"x = 1\n" and read["gone.py"].error == "FileNotFoundError" and read["gone.py"].content is None


def test_only_folders_that_hold_tests_are_out_of_scope(spark):
    tree = {
        "src/a.py": "x", "tests/test_a.py": "x", "tests/data.json": "{}", "Core.Tests/Helper.cs": "class Helper {}", "Real.Tests/Helper.cs": "using Xunit;", "vendor/v.py": "x",
        "docs/conf.py": "x", "setup.py": "x", "run.py": "x", "pkg/__init__.py": "", "conformance/law.py": "x", "a/test/b.py": "plain",
    }
    frame = spark.createDataFrame([("r", p, t) for p, t in tree.items()], "repo string, path string, text string")
    reasons = {r.path: r.reason for r in files.scoped(frame, "production-without-conformance").collect()}
    assert reasons == {
        "src/a.py": None, "tests/test_a.py": "tests", "tests/data.json": "tests", "Core.Tests/Helper.cs": None, "Real.Tests/Helper.cs": "tests", "vendor/v.py": "vendored",
        "docs/conf.py": "docs", "setup.py": "tooling", "run.py": "root-script", "pkg/__init__.py": None, "conformance/law.py": "conformance", "a/test/b.py": None,
    }
    told = files.disclosure(files.scoped(frame)).collect()
    assert {r.reason: (r.files, r.listed) for r in told} == {"tests": (3, []), "vendored": (1, []), "docs": (1, ["docs/conf.py"]), "tooling": (1, ["setup.py"]), "root-script": (1, ["run.py"])}
    assert {r.path for r in files.source_files(files.scoped(frame), [".py"]).collect()} == {"src/a.py", "pkg/__init__.py", "conformance/law.py", "a/test/b.py"}
    assert files.scoped(frame.limit(0)).collect() == []
    flat = frame.where("path IN ('run.py', 'src/a.py')")
    assert {r.reason for r in files.scoped(flat).collect()} == {None}


def test_corpus_config_and_packages(spark):
    rows = [("a.py", "x1 = foo(x1)"), ("README.md", "foo foo bar"), ("ci.yml", "run: foo"), ("bin.py", "a\0b"), ("big.py", "q " * 600_000), ("package.json", json.dumps({"main": "./lib/a.js", "bin": {"x": "cli.js"}, "types": 3})), ("sub/package.json", "{broken")]
    frame = spark.createDataFrame([("r", p, t) for p, t in rows], "repo string, path string, text string")
    words = files.corpus(frame).collect()
    assert sorted((r.word, r.at) for r in words if r.path == "a.py") == [("foo", 1), ("x1", 0), ("x1", 2)]
    assert sorted(r.word for r in words if r.bucket == "docs") == ["bar", "foo"] and not {r.path for r in words} & {"bin.py", "big.py"}
    assert {r.path for r in files.package_entries(frame).collect()} >= {"lib/a.js", "cli.js"}
    config = spark.createDataFrame([("a", ".husky/pre-commit"), ("a", ".github/workflows/x.yml"), ("b", "deep/Dockerfile")], "repo string, path string")
    assert {tuple(r) for r in files.config_presence(config).collect()} == {("a", True, 1, False), ("b", False, 0, False)}


REPORTS = {
    "coverage_json": ('{"totals": {"num_branches": 8, "covered_branches": 6}}', 6, 8),
    "cobertura": ('<?xml version="1.0"?><coverage line-rate="1" branches-covered="3" branches-valid="4"><packages/></coverage>', 3, 4),
    "jacoco": ('<report><package name="p"><counter type="BRANCH" missed="9" covered="9"/></package><counter type="LINE" missed="1" covered="1"/><counter type="BRANCH" missed="2" covered="8"/></report>', 8, 10),
    "c8_summary": ('{"total": {"branches": {"total": 5, "covered": 4, "skipped": 0, "pct": 80}}}', 4, 5),
    "simplecov": ('{"rspec": {"coverage": {"/a.rb": {"lines": [1], "branches": {"[:if, 0]": {"[:then, 1]": 3, "[:else, 2]": 0}}}, "/b.rb": {"lines": [null]}}}}', 1, 2),
    "lcov_summary": ("Summary coverage rate:\n  lines......: 75.0% (3 of 4 lines)\n", 3, 4),
    "go_func": ("a.go:3:\tF\t100.0%\ntotal:\t(statements)\t62.5%\n", 625, 1000),
    "llvm_export": ('{"data": [{"totals": {"regions": {"count": 9, "covered": 9}}}]}', 9, 9),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_coverage_reports(spark, tmp_path, name):
    text, covered, total = REPORTS[name]
    (tmp_path / "good").write_text(text)
    (tmp_path / "empty").write_text("{}" if text[0] == "{" else "nothing")
    reader = getattr(coverage, name)
    assert tuple(reader(spark, f"{tmp_path}/good").first())[2:] == (covered, total)
    good = coverage.verdict(reader(spark, f"{tmp_path}/good"), ["report"]).first()
    assert good.value == round(covered / total * 100, 1) and good.reason is None
    bad = coverage.verdict(reader(spark, f"{tmp_path}/empty"), ["report"]).first()
    assert bad.value is None and bad.band == "n/a" and bad.reason
    late = coverage.verdict(reader(spark, f"{tmp_path}/good"), ["report"], F.lit(124)).first()
    assert (late.value, late.band, late.reason) == (None, "n/a", "timed out")


def test_uncovered_branches(spark):
    lines = spark.createDataFrame([("a", 3, 0), ("a", 5, 2)], "file string, line long, hits long")
    got = coverage.uncovered(spark.createDataFrame([("a", 3, "if"), ("a", 5, "for")], "file string, line long, kind string"), lines)
    assert [r.kind for r in got.collect()] == ["if"]


TSAN = """noise
WARNING: ThreadSanitizer: data race (pid=1)
  Write of size 8 at 0x7b by thread T1:
    #0 std::ops<T> (binary+0x1)
    #1 wal::push::h12 src/wal.rs:1955:24 (binary+0x2)

  Previous read of size 8 at 0x7b by main thread:
    #0 wal::len src/wal.rs:88:9 (binary+0x3)

SUMMARY: ThreadSanitizer: data race src/wal.rs:1955:24 in wal::push
WARNING: ThreadSanitizer: data race (pid=1)
  Write of size 8 at"""
PANIC = "running\nthread 'a::b' panicked at src/x.rs:10:5:\nassertion failed: n == 1\nthread 'main' panicked at 'old style', src/y.rs:3\n"


def test_race_and_panic_logs(spark):
    frame = spark.createDataFrame([(1, TSAN), (2, PANIC), (3, "")], "id int, text string")
    assert [tuple(r) for r in logs.races(frame).collect()] == [(1, "src/wal.rs", 1955, "wal::push", ["src/wal.rs:1955", "src/wal.rs:88"])]
    assert [tuple(r)[2:] for r in logs.panics(frame).orderBy("ord").collect()] == [("src/x.rs", 10, "a::b", "assertion failed: n == 1"), ("src/y.rs", 3, "main", "old style")]


def test_history_with_dates_and_many_commits(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"COMMIT {i:040x} 20{10 + i % 10}-01-01\n\n{i}\t1\ta{i}.py\n" for i in range(500)))
    assert logs.numstat(spark, f"{tmp_path}/log").count() == 500
    some = logs.numstat(spark, f"{tmp_path}/log", "2012-01-01", "2013-12-31").collect()
    assert len(some) == 100 and {r.date[:4] for r in some} == {"2012", "2013"}
    (tmp_path / "none").write_text("")
    assert logs.numstat(spark, f"{tmp_path}/none").collect() == []
    (tmp_path / "map.hd").write_text("module m\n  # --- pure\n  fn f : (x) -> int\n  boundary_out fn g : () side_effect writes \"file\"\n")
    assert {tuple(r) for r in logs.call_roles(spark, f"{tmp_path}/map.hd").collect()} == {("f", "pure"), ("g", "boundary_out")}
    panel = spark.createDataFrame([("r", 1, "a", 1.0), ("r", 1, "b", None), ("r", 2, "a", 2.0), ("r", 2, "b", 3.0)], "repo string, y int, code string, value double")
    assert [tuple(r) for r in logs.wide_panel(panel, ["repo", "y"], ["a", "b"]).collect()] == [("r", 2, 2.0, 3.0)]


def test_other_languages_by_words(spark):
    rows = [
        ("a.rs", 'static mut N: i32 = 0;\nunsafe impl Send for X {}\n// static mut M\nfn f() { if a { match b { 1 => x, _ => "if" } } }\npub struct S;'),
        ("b.ts", "import {any} from 'x';\n// @ts-ignore\nlet a: any = 1; const s = 'any'; /* any */ if (a) { b ? c : d }\nexport function go() {}"),
        ("C.java", "class C { static List<String> xs = null; static final Map<A, B> m = null; Object o; }\n@SuppressWarnings(\"x\") class D {}"),
        ("d.rb", "Thread.new { @@n += 1 }\nif x then y end unless z\ndef foo; end\nclass_eval"),
        ("e.txt", "if any"),
    ]
    t, g = F.col("text"), F.col("g")
    got = spark.createDataFrame(rows, "path string, text string").withColumn("g", lexical.language_of(F.col("path"))).select("path", lexical.decisions(t, g).alias("d"), lexical.escapes(t, g).alias("e"), lexical.surface(t, g).alias("s"), lexical.declared(t, g).alias("n"), lexical.refused(t, g).alias("r"))
    by = {r.path: r for r in got.collect()}
    assert {p: r.d for p, r in by.items()} == {"a.rs": 3, "b.ts": 2, "C.java": 0, "d.rb": 2, "e.txt": None}
    assert {p: r.e for p, r in by.items()} == {"a.rs": None, "b.ts": 2, "C.java": 2, "d.rb": None, "e.txt": None}
    assert [(x.severity, x.kind, x.name) for x in by["a.rs"].s] == [("exposed", "unsafe_impl", "Send"), ("exposed", "static_mut", "N")]
    assert [x.name for x in by["C.java"].s] == ["xs"] and [x.name for x in by["d.rb"].s] == ["@@n"] and by["e.txt"].s is None
    assert by["a.rs"].n == ["N", "f", "S"] and by["b.ts"].n == ["a", "s", "go"] or "go" in by["b.ts"].n
    assert by["d.rb"].r == "metaprogramming" and by["a.rs"].r is None
