"""Queries for scope, findings, joins and reports over surrogates of their tables, with SQL of the same results.

A document is a file of its source's checkout, whose path follows from its id; an event is a finding, a run or a call."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexical, paths
from marlstone.operators import clauses, control, joins, lines, pysource, pystate, reports, verdicts
from marlstone.plans.catalogue import PANEL, _panel, query, table
from marlstone.shared import written
from marlstone.sources import files as tree
from marlstone.streaming import replay

FOLDERS = ["src/", "tests/", "docs/", "vendor/lib/", "pkg/Core.Tests/", "q{}/tests/", "conformance/", ""]
NAMES = ["test_a.py", "b_test.go", "CTests.cs", "README.md", "setup.py", "__init__.py", "d.spec.ts", "latest.java", "conftest.py", "Dockerfile", "e.py", "main.py", "f.rs"]
LANGUAGES = ["rust", "go", "java", "csharp", "javascript", "typescript", "c", "ruby", "python"]


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.concat(F.regexp_replace(_pick(FOLDERS, d), r"\{\}", d.cast("string")), F.when(d % 8 == 7, F.concat(F.lit("r"), d.cast("string"), F.lit("_"))).otherwise(F.concat(F.lit("m"), d.cast("string"), F.lit("/"))), _pick(NAMES, d))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), path.alias("path"), "text")


FILES = f"""WITH files AS (
  SELECT doc_id, source AS repo, text, replace({FOLDERS}[doc_id % {len(FOLDERS)} + 1], '{{}}', CAST(doc_id AS VARCHAR))
    || CASE WHEN doc_id % 8 = 7 THEN 'r' || doc_id || '_' ELSE 'm' || doc_id || '/' END || {NAMES}[doc_id % {len(NAMES)} + 1] AS path FROM documents),
parts AS (SELECT *, string_split(path, '/') AS p, string_split(path, '/')[-1] AS name, regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM files)"""
_VENDORED = "list_has_any(p, [" + ", ".join(f"'{v}'" for v in paths.VENDORED) + "])"
_TESTNAME = "(regexp_matches(lower(name), '^test[_.-]') OR regexp_matches(lower(stem), '([_-]test|\\.test|\\.spec|[_-]spec)$') OR regexp_matches(stem, '(Tests?|Specs?)$'))"
_FRAMEWORK = "(" + " OR ".join("contains(substr(coalesce(text, ''), 1, 4096), '" + m.replace("'", "''") + "')" for m in paths.FRAMEWORKS) + ")"
SCOPED = (
    FILES
    + f""",
above AS (SELECT doc_id, repo, path, p, name, stem, text, unnest(range(1, len(p))) AS i FROM parts WHERE len(p) > 1),
claims AS (SELECT doc_id, repo, path, array_to_string(p[1:i], '/') AS folder, CASE WHEN lower(p[i]) = 'tests' OR lower(p[i]) LIKE '%.tests' THEN 0 ELSE 1 END AS place
  FROM above WHERE lower(p[i]) IN ('tests', 'test') OR lower(p[i]) LIKE '%.tests' OR lower(p[i]) LIKE '%.test'),
proven AS (SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS folder FROM above WHERE {_TESTNAME} OR {_FRAMEWORK}),
marked AS (SELECT doc_id, min(place) AS place FROM claims JOIN proven USING (repo, folder) GROUP BY 1),
packages AS (SELECT repo, bool_or(name = '__init__.py' AND NOT {_VENDORED}) AS has_packages, bool_or(path = '__init__.py') AS root_is_package FROM parts GROUP BY 1),
scoped AS (SELECT parts.doc_id, parts.repo, path, CASE WHEN {_VENDORED} THEN 'vendored' WHEN place = 0 THEN 'tests' WHEN place = 1 THEN 'test' WHEN list_contains(p, 'docs') THEN 'docs'
  WHEN name IN ('{"', '".join(paths.TOOLING)}') THEN 'tooling' WHEN len(p) = 1 AND path LIKE '%.py' AND has_packages AND NOT root_is_package THEN 'root-script' END AS reason
  FROM parts JOIN packages USING (repo) LEFT JOIN marked USING (doc_id))"""
)


@query(SCOPED + " SELECT doc_id, path, reason FROM scoped")
def scope_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.scoped(_files(spark, sf_dir)).select("doc_id", "path", "reason")


@query(SCOPED + " SELECT repo, reason, count(*) AS files, count(*) FILTER (reason IN ('docs', 'tooling', 'root-script')) AS n_listed FROM scoped WHERE reason IS NOT NULL GROUP BY 1, 2")
def scope_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.disclosure(tree.scoped(_files(spark, sf_dir))).select("repo", "reason", "files", F.size("listed").cast("long").alias("n_listed"))


@query(SCOPED + " SELECT doc_id, path FROM scoped WHERE reason IS NULL AND regexp_matches(path, '(\\.py|\\.rs|\\.java)$')")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.source_files(tree.scoped(_files(spark, sf_dir)), [".py", ".rs", ".java"]).select("doc_id", "path")


@query(FILES + f" SELECT doc_id, path FROM parts WHERE regexp_matches(lower(path), '(\\.py|\\.md)$') AND NOT {_VENDORED} AND NOT list_bool_or(list_transform(p, lambda x: lower(x) IN ('tests', 'test') OR lower(x) LIKE '%.tests' OR lower(x) LIKE '%.test' OR x = 'conformance'))")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.text_files(_files(spark, sf_dir), [".py", ".md"], "production-without-conformance").select("doc_id", "path")


@query(
    FILES
    + """ SELECT doc_id, CASE WHEN regexp_matches(lower(path), '\\.(md|rst|adoc|txt|feature)$') THEN 'doc' WHEN regexp_matches(lower(path), '(\\.(py|rs|go|js|jsx|ts|tsx|java|cs|rb|c|h|cc|cpp|hpp|sh|sql|yml|yaml|json|toml)|(^|/)dockerfile)$') THEN 'code' ELSE 'other' END AS kind,
  list_bool_or(list_transform(p, lambda x: regexp_matches(lower(x), '^(tests?|specs?|__tests__)$|\\.(tests?|specs?)$'))) OR regexp_matches(lower(name), '^test_|(_test|\\.test|\\.spec)(\\.[^.]*)?$') OR regexp_matches(stem, '(Tests?|Specs?)$') AS is_test, """
    + _TESTNAME
    + f" AS test_name, {_VENDORED} AS vendored, coalesce(contains(substr(text, 1, 2048), '@generated') OR contains(substr(text, 1, 2048), 'Code generated by') OR contains(substr(text, 1, 2048), 'Generated by the protocol buffer compiler'), false) AS generated FROM parts"
)
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("doc_id", paths.file_kind(p).alias("kind"), paths.is_test_file(p).alias("is_test"), paths.is_test_name(p).alias("test_name"), paths.is_vendored(p).alias("vendored"), paths.is_generated(F.col("text")).alias("generated"))


CONFIG = ["src/a.py", ".pre-commit-config.yaml", ".husky/run", ".github/workflows/w.yml", ".github/workflows/v.yaml", ".github/workflows/deep/x.yml", "Dockerfile", "docker-compose.yml", "src/Dockerfile"]


@query(f"""
WITH f AS (SELECT source || '-' || doc_id % 97 AS repo, {CONFIG}[doc_id % {len(CONFIG)} + 1] AS path FROM documents)
SELECT repo, bool_or(path = '.pre-commit-config.yaml' OR path LIKE '.husky/%' OR path = '.husky') AS precommit,
  count(*) FILTER (regexp_matches(path, '^\\.github/workflows/[^/]+\\.ya?ml$')) AS workflows, bool_or(path IN ('Dockerfile', 'docker-compose.yml')) AS container FROM f GROUP BY 1""")
def config_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return tree.config_presence(d.select(F.concat_ws("-", "source", (F.col("doc_id") % 97).cast("string")).alias("repo"), _pick(CONFIG, F.col("doc_id")).alias("path")))


@query(
    FILES
    + f""", r AS (SELECT *, CASE WHEN regexp_matches(lower(path), '{tree.SOURCE}') THEN 'source' WHEN regexp_matches(lower(path), '\\.(md|rst|txt|adoc|org)$') THEN 'docs' ELSE 'config' END AS bucket
  FROM parts WHERE strlen(text) <= 1048576 AND NOT contains(substr(text, 1, 8192), chr(0)) AND NOT {_VENDORED}),
w AS (SELECT bucket, doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM r)
SELECT bucket, count(*) AS words, count(DISTINCT word) AS kinds FROM (SELECT bucket, doc_id, word FROM w WHERE bucket = 'source' UNION ALL SELECT DISTINCT bucket, doc_id, word FROM w WHERE bucket <> 'source') GROUP BY 1"""
)
def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.corpus(_files(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("words"), F.count_distinct("word").alias("kinds"))


def _code_sql(text: str, language: str) -> str:
    slash, hash_ = (p.replace("'", "''") for p in (lexical.SLASH_NOISE, lexical.HASH_NOISE))
    langs = ", ".join(f"'{x}'" for x in lexical.SLASHES)
    return f"CASE WHEN {language} IN ({langs}) THEN regexp_replace({text}, '{slash}', ' ', 'g') ELSE regexp_replace({text}, '{hash_}', ' ', 'g') END"


_LANGUAGE = f"{LANGUAGES}[page_id % 9 + 1]"
_COUNTS = lambda rules, body: "CASE language " + " ".join(f"WHEN '{n}' THEN len(regexp_extract_all({body}, '{r.replace(chr(39), chr(39) * 2)}'))" for n, r in rules.items()) + " END"


@query(f"""
WITH f AS (SELECT page_id, html AS text, {_LANGUAGE} AS language FROM pages), c AS (SELECT *, {_code_sql("text", "language")} AS code FROM f),
i AS (SELECT *, regexp_replace(code, '{lexical.IMPORTS}', ' ', 'g') AS body FROM c)
SELECT language, count(*) AS files, CAST(sum({_COUNTS(lexical.DECISIONS, "code")}) AS BIGINT) AS decisions,
  CAST(sum({_COUNTS(lexical.ESCAPES, "body")} + CASE WHEN language IN ({", ".join(f"'{x}'" for x in lexical.ESCAPES)}) THEN len(regexp_extract_all(text, '(?://|/\\*)\\s?@ts-ignore|# type: ignore')) END) AS BIGINT) AS escapes FROM i GROUP BY 1""")
def lexical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and type escapes by language, over all pages as if they were source."""
    f = table(spark, sf_dir, "pages").select(F.col("html").alias("text"), _pick(LANGUAGES, F.col("page_id")).alias("language"))
    n = f.select("language", lexical.decisions(F.col("text"), F.col("language")).alias("d"), lexical.escapes(F.col("text"), F.col("language")).alias("e"))
    return n.groupBy("language").agg(F.count("*").alias("files"), F.sum("d").alias("decisions"), F.sum("e").alias("escapes"))


@query("SELECT count(*) AS files, CAST(coalesce(sum(len(regexp_extract_all(text, '" + lines.ABSOLUTE + "'))), 0) AS BIGINT) AS found, CASE WHEN count(*) = 0 THEN 'n/a' WHEN coalesce(sum(len(regexp_extract_all(text, '" + lines.ABSOLUTE + "'))), 0) > 0 THEN 'Slop' ELSE 'Healthy' END AS band FROM (SELECT doc_id, text || ' /home/' || source || '/x ' || text AS text FROM documents WHERE lang = 'en')")
def path_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return lines.path_band(d.select("doc_id", F.concat("text", F.lit(" /home/"), "source", F.lit("/x "), "text").alias("text")), "doc_id", "text")


# Joins.


@query("""
WITH d AS (SELECT event_id, user_id AS path, event_type AS name, event_id AS start, event_id + 500 AS e FROM events WHERE value > 80),
u AS (SELECT user_id AS path, event_type AS name, event_id AS "at" FROM events WHERE event_type <> 'view')
SELECT event_id FROM d WHERE EXISTS (SELECT 1 FROM u WHERE u.name = d.name AND u.path = d.path + 1 AND NOT (u.path = d.path AND d.start <= u."at" AND u."at" < d.e))""")
def used_outside_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with a use of the same name by the next user: the span only matters within a file."""
    e = table(spark, sf_dir, "events")
    name = lambda p: F.concat_ws(":", p.cast("string"), "event_type")
    d = e.where("value > 80").select("event_id", F.col("user_id").alias("path"), name(F.col("user_id") + 1).alias("name"), F.col("event_id").alias("start"), (F.col("event_id") + 500).alias("end"))
    u = e.where("event_type <> 'view'").select(F.col("user_id").alias("path"), name(F.col("user_id")).alias("name"), F.col("event_id").alias("at"))
    return joins.used(d, u).select("event_id")


@query("""
WITH s AS (SELECT DISTINCT user_id % 40 AS path, event_type AS kind, 'u' || user_id % 3 AS owner, 'n' || event_id % 11 AS name FROM events),
d AS (SELECT kind, count(*) AS d, count(*) FILTER (path % 2 = 0) AS v, count(*) FILTER (path % 4 = 0) AS j FROM s GROUP BY 1), k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'none']) AS kind)
SELECT k.kind, coalesce(d, 0) AS declared, coalesce(v, 0) AS visited, coalesce(j, 0) AS judged, round(v / d, 6) AS visited_share, round(j / d, 6) AS judged_share FROM k LEFT JOIN d ON k.kind = d.kind""")
def state_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.select((F.col("user_id") % 40).alias("path"), F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("owner"), F.concat(F.lit("n"), F.col("event_id") % 11).alias("name"))
    kinds = spark.createDataFrame([(k,) for k in ("click", "error", "purchase", "signup", "view", "none")], "kind string")
    return joins.census(s, s.where("path % 2 = 0"), s.where("path % 4 = 0"), kinds)


@query("""
WITH f AS (SELECT event_id, user_id AS path, CAST(epoch_us(ts) // 1000000 % 20000 AS BIGINT) AS line, event_id % 5 AS clause FROM events WHERE event_type = 'error'),
n AS (SELECT user_id AS path, event_id % 5 AS clause, CAST(epoch_us(ts) // 1000000 % 20000 AS BIGINT) AS line, CASE WHEN value < 20 THEN ' ' ELSE 'r' || CAST(floor(value) AS BIGINT) END AS reason FROM events WHERE event_type IN ('signup', 'view'))
SELECT f.event_id, f.path, f.clause, f.line, min_by(reason, struct_pack(o := f.line - n.line, r := reason)) AS reason FROM f LEFT JOIN n ON f.path = n.path AND f.clause = n.clause AND n.line BETWEEN f.line - 300 AND f.line AND trim(reason) <> '' GROUP BY 1, 2, 3, 4""")
def allowed_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as findings, sign-ups and views as notes that reach 300 lines (seconds) down."""
    e = table(spark, sf_dir, "events").withColumn("line", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 20000).withColumn("clause", F.col("event_id") % 5).withColumnRenamed("user_id", "path")
    reason = F.when(F.col("value") < 20, " ").otherwise(F.concat(F.lit("r"), F.floor("value").cast("string")))
    found = e.where("event_type = 'error'").select("event_id", "path", "clause", "line")
    return joins.allowed(found, e.where("event_type IN ('signup', 'view')").select("path", "clause", "line", reason.alias("reason")), 300).select("event_id", "path", "clause", "line", "reason")


@query("""
WITH c AS (SELECT DISTINCT user_id AS path, event_type AS func, CASE event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'other' END AS callee FROM events)
SELECT path, func, callee FROM c WHERE func <> callee AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.path AND e.event_type = c.callee)""")
def sibling_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("func"), "event_id")
    callee = _pick(["click", "error", "other"], F.col("event_id"))
    return joins.siblings_called(e.withColumn("callee", callee), e.select("path", "func").distinct())


@query("""
WITH s AS (SELECT DISTINCT p_partkey % 500 AS path, string_split(p_name, ' ')[1] AS stem FROM part), m AS (SELECT doc_id AS path, text FROM documents WHERE doc_id % 3 = 0),
w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS stem FROM m), x AS (SELECT path, stem, path IN (SELECT path FROM m) AS own, stem IN (SELECT stem FROM w) AS named FROM s)
SELECT path, CASE WHEN own THEN 'in-file' WHEN named THEN 'elsewhere' ELSE 'unmodelled' END AS model FROM x""")
def model_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("path"), F.split("p_name", " ")[0].alias("stem"))
    return joins.modelled(surface, table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("path"), "text"))


@query("""
WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'crate/src/' ELSE '' END || event_type || user_id % 60 || '.rs' AS file FROM events WHERE value > 60), s AS (SELECT DISTINCT 'src/' || event_type || user_id % 25 || '.rs' AS file FROM events)
SELECT id, file FROM r WHERE EXISTS (SELECT 1 FROM s WHERE ends_with(r.file, s.file) OR ends_with(s.file, r.file))""")
def confirmed_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = lambda n: F.concat("event_type", (F.col("user_id") % n).cast("string"), F.lit(".rs"))
    races = e.where("value > 60").select(F.col("event_id").alias("id"), F.concat(F.when(F.col("event_id") % 2 == 0, "crate/src/").otherwise(""), name(60)).alias("file"))
    return joins.confirmed(races, e.select(F.concat(F.lit("src/"), name(25)).alias("file")))


@query("""
WITH f AS (SELECT event_id, user_id AS func, event_type AS facet, 'n' || event_id % 7 AS name, event_id % 4 AS place FROM events WHERE value < 40),
v AS (SELECT user_id AS func, event_type AS facet, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id % 5 END AS name, event_id % 3 AS place FROM events WHERE value > 70),
x AS (SELECT f.*, EXISTS (SELECT 1 FROM v WHERE v.func = f.func AND v.facet = f.facet AND (v.name = f.name OR v.name IS NULL AND v.place = f.place)) AS shown FROM f)
SELECT func, count(*) AS facets, count(*) FILTER (NOT shown) AS silent, round(count(*) FILTER (NOT shown) / count(*), 6) AS index FROM x GROUP BY 1""")
def silence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("func"), F.col("event_type").alias("facet"), "event_id", "value")
    facets = e.where("value < 40").select("event_id", "func", "facet", F.concat(F.lit("n"), F.col("event_id") % 7).alias("name"), (F.col("event_id") % 4).alias("place"))
    evidence = e.where("value > 70").select("func", "facet", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n"), F.col("event_id") % 5)).alias("name"), (F.col("event_id") % 3).alias("place"))
    return reports.silence_index(joins.evidenced(facets, evidence), ["func"])


@query("""
WITH a AS (SELECT 'c' || user_id AS code, CASE WHEN min(value) > 1 THEN min(value) END AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT 'c' || user_id AS code, CASE WHEN min(value) > 2 THEN min(value) END AS v FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'missing left' WHEN b.code IS NULL THEN 'missing right' WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'shared' ELSE 'unmeasured' END AS status FROM a FULL JOIN b ON a.code = b.code""")
def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str, floor: int) -> DataFrame:
        least = F.min("value")
        return table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy(F.concat(F.lit("c"), "user_id").alias("code")).agg(F.when(least > floor, least).alias("value"))

    return joins.code_sets(of("click", 1), of("error", 2), "value")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS u, c_custkey + 1 AS v FROM customer WHERE c_custkey % 100 <> 0 UNION ALL SELECT c_custkey, c_custkey + 8 FROM customer WHERE c_custkey % 8 = 0 AND c_custkey % 100 < 88 UNION ALL SELECT c_custkey + 3, c_custkey FROM customer WHERE c_custkey % 11 = 0),
r(node) AS (SELECT CAST(102 AS BIGINT) UNION SELECT CAST(v AS BIGINT) FROM r JOIN e ON e.u = r.node) SELECT node FROM r""")
def deep_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some twenty steps, with many ways and cycles."""
    c = F.col("c_custkey").cast("long")
    customers = table(spark, sf_dir, "customer")
    step = lambda where, u, v: customers.where(where).select(u.alias("u"), v.alias("v"))
    edges = step("c_custkey % 100 <> 0", c, c + 1).union(step("c_custkey % 8 = 0 AND c_custkey % 100 < 88", c, c + 8)).union(step("c_custkey % 11 = 0", c + 3, c))
    return joins.reachable(edges, spark.createDataFrame([(102,)], "node long"))


# Reports.


@query("""
WITH f AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'promiscuous' WHEN 'click' THEN 'neutral' ELSE 'unresolved' END AS verdict, value > 50 AS drives, event_id % 13 AS file FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE verdict WHEN 'promiscuous' THEN 1 WHEN 'unresolved' THEN 2 ELSE 3 END, drives DESC, file, event_id) AS rank, greatest(count(*) OVER (PARTITION BY user_id) - 12, 0) AS more FROM f)
SELECT user_id, event_id, verdict, rank, more FROM r WHERE rank <= 12""")
def listed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lists are cut at a cap, and say how many more there are."""
    verdict = F.when(F.col("event_type") == "error", "promiscuous").when(F.col("event_type") == "click", "neutral").otherwise("unresolved")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", verdict.alias("verdict"), (F.col("value") > 50).alias("drives"), (F.col("event_id") % 13).alias("file"), F.col("event_id").alias("line"))
    return reports.by_verdict(e, ["user_id"], 12).select("user_id", "event_id", "verdict", "rank", "more")


@query("""
WITH f AS (SELECT user_id, CASE WHEN value > 99 THEN 'exposed' WHEN value > 96 THEN 'review' ELSE 'candidate' END AS severity FROM events WHERE value > 93), r AS (SELECT user_id, count(*) FILTER (event_type <> 'view') AS parsed FROM events GROUP BY 1),
n AS (SELECT user_id, count(*) FILTER (severity = 'exposed') AS exposed, count(*) FILTER (severity = 'review') AS review, count(*) FILTER (severity = 'candidate') AS candidate FROM f GROUP BY 1)
SELECT user_id, coalesce(exposed, 0) AS exposed, coalesce(review, 0) AS review, coalesce(candidate, 0) AS candidate,
  CASE WHEN exposed > 0 THEN 'exposed' WHEN review > 0 THEN 'review' WHEN candidate > 0 THEN 'candidate' WHEN parsed = 0 THEN 'unread' ELSE 'clean' END AS verdict FROM r LEFT JOIN n USING (user_id)""")
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("value") > 99, "exposed").when(F.col("value") > 96, "review").otherwise("candidate")
    return reports.worst(e.where("value > 93").select("user_id", severity.alias("severity")), e.select("user_id", (F.col("event_type") != "view").alias("parsed")), ["user_id"])


_CODE = "CASE WHEN value > 98 THEN 124 WHEN value > 70 THEN 1 ELSE 0 END"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("value") > 98, 124).when(F.col("value") > 70, 1).otherwise(0)
    return table(spark, sf_dir, "events").where("event_id % 20 = user_id % 20").select("user_id", F.col("event_id").alias("run"), code.alias("code"), (F.col("value") >= 3).alias("ran"))


@query(f"""
WITH r AS (SELECT user_id, {_CODE} AS code FROM events WHERE event_id % 20 = user_id % 20), n AS (SELECT user_id, count(*) FILTER (code = 0) AS passed, count(*) AS runs, bool_or(code = 124) AS late FROM r GROUP BY 1)
SELECT user_id, passed, runs, CASE WHEN late OR passed = 0 THEN 'n/a' WHEN passed = runs THEN 'no-race-in-stress' ELSE 'race-observed' END AS verdict, CASE WHEN late OR passed = 0 THEN 'n/a' WHEN passed = runs THEN 'Healthy' ELSE 'Slop' END AS band FROM n""")
def stress_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stress(_runs(spark, sf_dir), ["user_id"])


@query(f"""
WITH r AS (SELECT user_id, event_id AS run, {_CODE} AS code, value >= 3 AS ran FROM events WHERE event_id % 20 = user_id % 20),
n AS (SELECT user_id, count(*) FILTER (code = 0) AS passed, count(*) AS runs, arg_min(CASE WHEN code = 124 THEN 'timed out' ELSE 'did not run' END, run) FILTER (code = 124 OR NOT ran) AS reason FROM r GROUP BY 1)
SELECT user_id, passed, runs, CASE WHEN reason IS NOT NULL THEN 'n/a' ELSE passed || '/' || runs END AS tally, CASE WHEN reason IS NOT NULL THEN 'n/a' WHEN passed = runs THEN 'Healthy' WHEN passed = runs - 1 THEN 'Not Healthy' ELSE 'Slop' END AS band, reason FROM n""")
def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.run_tally(_runs(spark, sf_dir), "user_id")


_STATES = "SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 9 AS classes, event_id % 2 = 0 AS ordered, value < 90 AS counted, event_type <> 'view' AS drives, CASE WHEN event_type IN ('click', 'error', 'view') THEN 'neutral' ELSE 'unresolved' END AS verdict FROM events"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_type").isin("click", "error", "view"), "neutral").otherwise("unresolved")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 9).alias("classes"), (F.col("event_id") % 2 == 0).alias("ordered"), (F.col("value") < 90).alias("counted"), (F.col("event_type") != "view").alias("drives"), verdict.alias("verdict"))


@query(f"SELECT ordered, classes, count(*) AS n FROM ({_STATES}) WHERE drives AND counted AND classes > 0 GROUP BY 1, 2")
def cardinality_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pooled(_states(spark, sf_dir))


@query(f"""
SELECT user_id, count(*) AS deciding, count(*) FILTER (NOT counted) AS uncounted, coalesce(array_to_string(list_sort(list(classes) FILTER (counted AND ordered)), ','), '') AS ordered_classes,
  coalesce(array_to_string(list_sort(list(classes) FILTER (counted AND NOT ordered)), ','), '') AS unordered_classes FROM ({_STATES}) WHERE verdict = 'neutral' AND drives GROUP BY 1""")
def partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.partition_summary(_states(spark, sf_dir), ["user_id"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("user_id", "deciding", "uncounted", text("ordered_classes"), text("unordered_classes"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY classes DESC, event_id) AS rank, greatest(count(*) OVER (PARTITION BY user_id) - 20, 0) AS more FROM ({_STATES}) WHERE counted AND drives AND NOT ordered AND classes > 5)
SELECT user_id, event_id, classes, rank, more FROM r WHERE rank <= 20""")
def coarse_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir).withColumn("file", F.lit("f")).withColumnRenamed("event_id", "line")
    return reports.coarse(s, ["user_id"], 5).select("user_id", F.col("line").alias("event_id"), "classes", "rank", "more")


@query("SELECT user_id, CASE WHEN bool_or(value > 99) THEN NULL ELSE CAST(sum(CAST(floor(value) AS BIGINT) % 5) AS BIGINT) END AS bound FROM events GROUP BY 1")
def write_key_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_bound(table(spark, sf_dir, "events").select("user_id", (F.floor("value") % 5).alias("cells"), (F.col("value") > 99).alias("open")), ["user_id"])


@query("""
WITH k AS (SELECT unnest(['click', 'error', 'retained', 'unbuildable']) AS outcome) SELECT outcome, count(event_id) AS n FROM k LEFT JOIN events ON event_type = outcome GROUP BY 1""")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("click", "error", "retained", "unbuildable")], "outcome string")
    return reports.tally(table(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome"), kinds, "outcome")


_COUNTED = "SELECT user_id, count(*) FILTER (event_type = 'click' AND value > 60) AS neutral, count(*) FILTER (event_type = 'error' AND value > 97) AS promiscuous, count(*) FILTER (value < 50) AS unresolved, max(value) FILTER (event_type = 'signup') > 90 AS touched, min(value) < 8 AS meter_ran, CAST(count(*) AS BIGINT) AS declared, count(*) FILTER (value > 90) AS visited FROM events GROUP BY 1"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = F.col("value"), F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if((t == "click") & (v > 60)).alias("neutral"), F.count_if((t == "error") & (v > 97)).alias("promiscuous"), F.count_if(v < 50).alias("unresolved"),
        (F.max(F.when(t == "signup", v)) > 90).alias("touched"), (F.min("value") < 8).alias("meter_ran"), F.count("*").alias("declared"), F.count_if(v > 90).alias("visited"),
    )


@query(f"""
WITH c AS (SELECT *, CASE WHEN touched THEN 12.5 ELSE 0.0 END AS touching FROM ({_COUNTED}))
SELECT user_id, CASE WHEN neutral + promiscuous = 0 AND touching > 0 THEN NULL WHEN neutral + promiscuous = 0 THEN 100 ELSE CAST(round(neutral / (neutral + promiscuous) * 100) AS BIGINT) END AS testable, neutral + promiscuous = 0 AND touching > 0 AS refused FROM c""")
def testable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counted(spark, sf_dir).withColumn("touching", F.when(F.col("touched"), 12.5).otherwise(0.0))
    return reports.testable_share(c).select("user_id", "testable", "refused")


@query(f"""
WITH c AS (SELECT *, neutral + promiscuous + unresolved AS total, CASE WHEN user_id % 3 > 0 THEN (user_id % 10) / 10 END AS score, user_id % 30 AS widest FROM ({_COUNTED})),
b AS (SELECT *, coalesce(unresolved / nullif(total, 0), 0) AS silence, CASE WHEN NOT meter_ran THEN 'no-source' WHEN declared > 0 AND visited = 0 AND promiscuous = 0 THEN 'unread' WHEN promiscuous > 0 THEN 'measured' WHEN coalesce(unresolved / nullif(total, 0), 0) > 0.52 THEN 'silent' ELSE 'measured' END AS basis FROM c),
s AS (SELECT *, CASE WHEN basis <> 'measured' THEN 'na' WHEN promiscuous > 0 THEN 'cannot' WHEN widest > 20 THEN 'coarse' ELSE 'can' END AS status FROM b)
SELECT user_id, round(silence, 6) AS silence, basis, status, CASE status WHEN 'cannot' THEN 'F' WHEN 'coarse' THEN 'D' WHEN 'can' THEN CASE WHEN score IS NULL OR score >= 0.85 THEN 'A' WHEN score >= 0.6 THEN 'B' ELSE 'C' END END AS grade FROM s""")
def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counted(spark, sf_dir).withColumn("score", F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 10 / 10)).withColumn("widest", F.col("user_id") % 30).withColumn("admitted", F.col("promiscuous"))
    return verdicts.graded(c, 20).select("user_id", "silence", "basis", "status", "grade")


@query("""
WITH a AS (SELECT 'u' || user_id % 60 AS metric, count(*) AS actual FROM events WHERE value > 99 GROUP BY 1), b AS (SELECT DISTINCT 'u' || user_id % 80 AS metric, CAST(user_id % 80 % 3 AS BIGINT) AS baseline FROM events)
SELECT coalesce(a.metric, b.metric) AS metric, coalesce(actual, 0) AS actual, baseline, CASE WHEN coalesce(actual, 0) > coalesce(baseline, 0) THEN 'fail' WHEN coalesce(actual, 0) < coalesce(baseline, 0) THEN 'slack' ELSE 'pass' END AS verdict FROM a FULL JOIN b ON a.metric = b.metric""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = lambda n: F.concat(F.lit("u"), (F.col("user_id") % n).cast("string")).alias("metric")
    return reports.gate(e.where("value > 99").groupBy(name(60)).agg(F.count("*").alias("actual")), e.select(name(80), (F.col("user_id") % 80 % 3).alias("baseline")).distinct(), "metric")


_CALLS = "SELECT user_id, event_id AS ord, CAST(CAST(floor(value / 9) AS BIGINT) AS VARCHAR) AS before, CAST(CAST(floor((value + CASE WHEN value > 97 THEN 9 ELSE 0 END) / 9) AS BIGINT) AS VARCHAR) AS after, CAST(CAST(floor(value / 11) AS BIGINT) AS VARCHAR) AS result, event_type = 'error' AS raised, event_type = 'signup' OR user_id % 17 = 0 AS opaque, CASE WHEN event_type <> 'view' THEN 's' END AS state_before, CASE WHEN value > 99 THEN 't' WHEN event_type <> 'view' THEN 's' END AS state_after FROM events"


@query(f"""
WITH c AS ({_CALLS}), t AS (SELECT * FROM c WHERE NOT opaque AND NOT raised),
m AS (SELECT user_id, bool_or(NOT opaque) AS r, bool_or(NOT opaque AND before <> after) AS m, bool_or(state_before IS NOT NULL AND state_after IS NOT NULL) AS s, bool_or(coalesce(state_before <> state_after, false)) AS p FROM c GROUP BY 1),
d AS (SELECT user_id, max(k) = 1 AS d FROM (SELECT user_id, before, count(*) AS n, count(DISTINCT result) AS k FROM t GROUP BY 1, 2) WHERE n > 1 GROUP BY 1),
i AS (SELECT t.user_id, bool_and(t.result = t.before) AS i FROM t JOIN (SELECT user_id, result AS before, min(ord) AS f FROM t GROUP BY 1, 2) e ON t.user_id = e.user_id AND t.before = e.before WHERE t.ord > e.f GROUP BY 1)
SELECT m.user_id, CASE WHEN NOT r THEN 'unverified' WHEN m THEN 'breaks' ELSE 'holds' END AS mutation, CASE WHEN NOT s THEN 'unverified' WHEN p THEN 'breaks' ELSE 'holds' END AS purity,
  CASE WHEN NOT r THEN 'unverified' WHEN d IS NULL THEN 'unobserved' WHEN d THEN 'holds' ELSE 'breaks' END AS determinism, CASE WHEN NOT r THEN 'unverified' WHEN i IS NULL THEN 'unobserved' WHEN i THEN 'holds' ELSE 'breaks' END AS idempotency
FROM m LEFT JOIN d ON m.user_id = d.user_id LEFT JOIN i ON m.user_id = i.user_id""")
def observed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = F.col("value"), F.col("event_type")
    text = lambda x: F.floor(x).cast("string")
    calls = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("ord"), text(v / 9).alias("before"), text((v + F.when(v > 97, 9).otherwise(0)) / 9).alias("after"), text(v / 11).alias("result"), (t == "error").alias("raised"),
        ((t == "signup") | (F.col("user_id") % 17 == 0)).alias("opaque"), F.when(t != "view", "s").alias("state_before"), F.when(v > 99, "t").when(t != "view", "s").alias("state_after"),
    )
    return verdicts.observed(calls, "user_id")


@query("""
SELECT user_id, concat_ws('; ', 'measured', CASE WHEN s > 0 THEN s || ' file(s) unreadable and excluded' END, CASE WHEN n > 20 THEN '20 of them listed below' END) AS details
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value > 99) AS s FROM events GROUP BY 1)""")
def disclosed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 99).alias("s"))
    return n.select("user_id", reports.noted(F.lit("measured"), F.col("s"), F.lit(20), F.col("n")).alias("details"))


@query("""
SELECT CAST(user_id % 7 AS VARCHAR) AS repo, '| code | value | band |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || CASE WHEN n > 50 THEN 'Slop' ELSE 'Healthy' END || ' |', chr(10) ORDER BY event_type) AS markdown
FROM (SELECT user_id % 7 AS user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def markdown_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).cast("string").alias("repo"), F.col("event_type").alias("code")).agg(F.count("*").alias("value"))
    return reports.card(n.withColumn("band", F.when(F.col("value") > 50, "Slop").otherwise("Healthy")), "repo")


@query()
def exact_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.f_interval(_panel(spark, sf_dir), "c_nationkey", "v")


@query(f"WITH p AS ({PANEL}) SELECT c_nationkey, CAST(y AS INTEGER) AS y, round(log10(v + 1), 6) AS v FROM p")
def log_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.transformed(_panel(spark, sf_dir), "v", "log10").withColumn("v", F.round("v", 6)).select("c_nationkey", "y", "v")


# Streams.


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts by a stream over the table's files, as its last micro-batch left them."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = replay.stream_panel(events, "ts", "event_type")
    last: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        last[:] = [written(batch, "stream-panel")]

    counted.writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    found = last[0] if last else replay.stream_panel(table(spark, sf_dir, "events").limit(0), "ts", "event_type")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


# Source: the tables hold none, so the kernels read this library's own.


def _source(spark: SparkSession) -> DataFrame:
    root = Path(__file__).resolve().parent.parent
    folders = ("functions", "operators", "plans", "sources", "streaming")
    rows = [("marlstone", f"{d}/{p.name}", p.read_text(encoding="utf8"), False) for d in folders for p in sorted((root / d).glob("*.py"))]
    return spark.createDataFrame(rows, "repo string, path string, text string, is_test boolean").repartition(4, "path")


@query()
def own_conformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.conformity(_source(spark), ["repo"])


@query()
def own_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.clauses(_source(spark)).groupBy("clause", "status").agg(F.count("*").alias("n"))


@query()
def own_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pysource.dead_code(_source(spark)).groupBy("verdict").agg(F.count("*").alias("n"))


@query()
def own_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pystate.classified(_source(spark))


@query()
def own_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pysource.function_covers(_source(spark))


@query()
def own_call_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rendered_map(pysource.call_map(_source(spark)))
