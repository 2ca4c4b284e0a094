"""All queries over the given tables by name, and the SQL that has the same result.

The tables hold no source code, so each operator runs over a surrogate of its schema: an order is a commit
and a line item a changed file, a day of events a point of a panel, a conversation a file under edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.bands import band_of_sql, band_sql
from marlstone.operators import control, flows, history, joins, lines, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Version history: order = commit, line item = changed file; the return flag is its kind, the line status whether lines came or went.

CHANGES = """SELECT {by}l_orderkey AS sha, CASE l_returnflag WHEN 'A' THEN 'doc' WHEN 'N' THEN 'code' ELSE 'other' END AS kind,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END AS added, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END AS deleted FROM lineitem{join}"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    kind = F.when(F.col("l_returnflag") == "A", "doc").when(F.col("l_returnflag") == "N", "code").otherwise("other")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), kind.alias("kind"), F.when(F.col("l_linestatus") == "O", n).alias("added"), F.when(F.col("l_linestatus") == "F", n).alias("deleted"))


@query(history.history_sql(CHANGES.format(by="", join="")))
def commit_kind_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_panel(_changes(spark, sf_dir))


@query(history.history_sql(CHANGES.format(by="CAST(year(o_orderdate) AS INTEGER) AS year, ", join=" JOIN orders ON l_orderkey = o_orderkey"), "year"))
def history_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.year("o_orderdate").alias("year"))
    return history.history_panel(_changes(spark, sf_dir).join(years, "sha"), ["year"])


# Control charts and variance components.

SERIES = "SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2"
CHART = f"""
WITH s AS ({SERIES}),
m AS (SELECT *, row_number() OVER w AS rn, abs(n - lag(n) OVER w) AS mr FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)),
l AS (SELECT event_type, avg(n) FILTER (rn <= 8) AS c, median(mr) FILTER (rn <= 8) AS md FROM m GROUP BY 1 HAVING count(*) >= 8),
chart AS (SELECT m.event_type, day, round(n, 6) AS value, round(mr, 6) AS mr, round(c, 6) AS centre, round(c - 3.145 * md, 6) AS lower, round(c + 3.145 * md, 6) AS upper,
  round(3.865 * md, 6) AS range_limit FROM m LEFT JOIN l ON m.event_type = l.event_type)"""
SIGNALS = (
    CHART
    + """,
sided AS (SELECT *, CAST(sign(value - centre) AS INTEGER) AS side FROM chart),
turned AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY event_type ORDER BY day) THEN 0 ELSE 1 END AS t FROM sided),
runs AS (SELECT *, sum(t) OVER (PARTITION BY event_type ORDER BY day) AS turn FROM turned),
signals AS (SELECT event_type, day, value, NOT (value BETWEEN lower AND upper) AS outside, mr > range_limit AS range_signal,
  row_number() OVER (PARTITION BY event_type, turn ORDER BY day) >= 8 AND side <> 0 AS shift FROM runs)"""
)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.xmr_chart(_series(spark, sf_dir), "event_type", "day", "n")


@query(CHART + " SELECT * FROM chart")
def xmr_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chart(spark, sf_dir)


@query(SIGNALS + " SELECT * FROM signals")
def xmr_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.xmr_signals(_chart(spark, sf_dir), "event_type", "day")


@query(
    SIGNALS
    + """,
c AS (SELECT event_type, NOT bool_or(coalesce(outside OR range_signal OR shift, false)) AS in_control FROM signals GROUP BY 1),
a AS (SELECT event_type, max(centre) AS centre, max(lower) AS lower, max(upper) AS upper FROM chart GROUP BY 1)
SELECT a.event_type, in_control, centre BETWEEN 50 AND 1000 AS in_specification, CASE WHEN centre IS NULL OR (lower <= 0 AND upper >= 100000) THEN 'insufficient signal'
  WHEN in_control AND centre BETWEEN 50 AND 1000 THEN 'ideal' WHEN in_control THEN 'threshold' WHEN centre BETWEEN 50 AND 1000 THEN 'brink' ELSE 'chaos' END AS verdict
FROM a JOIN c ON a.event_type = c.event_type"""
)
def capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = _chart(spark, sf_dir)
    return control.capability(chart, control.xmr_signals(chart, "event_type", "day"), "event_type", 50, 1000, 0, 100000)


@query("""
WITH n AS (SELECT l_returnflag, l_quantity, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) // 500 AS subgroup FROM lineitem)
SELECT l_returnflag, subgroup, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM n GROUP BY 1, 2""")
def subgroup_fixed_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return control.subgroups(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 500, "l_quantity")


PANEL = "SELECT c_nationkey, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))


@query(f"""
WITH p AS ({PANEL}), g AS (SELECT c_nationkey, avg(v) AS m, CASE WHEN count(v) > 1 THEN stddev_pop(v) END AS s FROM p GROUP BY 1),
t AS (SELECT pow(stddev_pop(m), 2) AS b, pow(avg(s), 2) AS w FROM g) SELECT round(b / nullif(b + w, 0), 6) AS icc FROM t""")
def icc_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.icc_moment(_panel(spark, sf_dir), "c_nationkey", "v")


@query(f"""
WITH p AS ({PANEL}), g AS (SELECT c_nationkey, count(v) AS n, avg(v) AS m, var_pop(v) AS vv FROM p GROUP BY 1),
a AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
t AS (SELECT sum(n * pow(m - gm, 2)) / (count(*) - 1) AS msb, sum(n * vv) / (sum(n) - count(*)) AS msw, min(n) AS least FROM g, a)
SELECT round((msb - msw) / (msb + (least - 1) * msw), 6) AS icc, round(msb / 1e6, 4) AS msb_millions, round(msw / 1e6, 4) AS msw_millions FROM t""")
def icc_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.icc_anova(_panel(spark, sf_dir), "c_nationkey", "v")


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.bootstrap(_panel(spark, sf_dir), "c_nationkey", "v")


@query("SELECT p_partkey, p_brand, p_retailprice, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS INTEGER) AS rank0 FROM part")
def rank_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.ranks(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice")


# Lines of files.


@query(f"""
WITH n AS (SELECT sum(CASE WHEN source IN ('src0', 'src1') THEN n_lines ELSE 0 END) AS t, sum(CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE n_lines END) AS p
  FROM (SELECT source, len(text) - len(replace(text, chr(10), '')) + 1 AS n_lines FROM documents WHERE text <> ''))
SELECT CAST(t AS BIGINT) AS test_lines, CAST(p AS BIGINT) AS production_lines, round(t / nullif(p, 0), 6) AS value, {band_of_sql("L1.8", "t / nullif(p, 0)")} AS band FROM n""")
def test_prod_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.functions.bands import band_of, guarded

    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    test = F.col("source").isin("src0", "src1")
    t = table(spark, sf_dir, "documents").where("text <> ''").agg(F.sum(F.when(test, n).otherwise(0)).alias("test_lines"), F.sum(F.when(~test, n).otherwise(0)).alias("production_lines"))
    value = guarded(F.col("test_lines"), F.col("production_lines"), 1.0)
    return t.select("test_lines", "production_lines", F.round(value, 6).alias("value"), band_of("L1.8", value).alias("band"))


@query(f"""
WITH l AS (SELECT unnest(string_split(regexp_replace(html, '\\n$', ''), chr(10))) AS line FROM pages WHERE html <> ''),
c AS (SELECT count(*) AS lines, count(*) FILTER (regexp_matches(line, '[^ \\t\\r\\f][ \\t\\r\\f]+$')) AS t FROM l)
SELECT lines, t AS "trailing", round(t * 100.0::DOUBLE / nullif(lines, 0), 6) AS value, {band_of_sql("L1.16", "t * 100.0::DOUBLE / nullif(lines, 0)")} AS band FROM c""")
def whitespace_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.whitespace_density(lines.lines(table(spark, sf_dir, "pages"), "page_id", "html"))


@query(f"""
WITH w AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n FROM documents),
c AS (SELECT source, count(*) AS files, count(*) FILTER (n > 1000) AS large, count(*) FILTER (n > 4000) AS huge FROM w GROUP BY 1)
SELECT source, files, large, huge, round(large * 100.0::DOUBLE / files, 6) AS value, CASE WHEN huge > 0 THEN 'Slop' ELSE {band_of_sql("L1.17", "large * 100.0::DOUBLE / files")} END AS band FROM c""")
def large_file_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n\\r]+"))
    return lines.large_files(table(spark, sf_dir, "documents"), "source", size)


PLACED = "SELECT page_id, html || chr(10) || regexp_replace(url, '^https?://[^/]+', '/home/u') AS text FROM pages"


@query(f"SELECT page_id, path, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(text, '{lines.ABSOLUTE}', 2)) AS path FROM ({PLACED})) GROUP BY 1, 2")
def absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with its address as a place in a home folder."""
    text = F.concat("html", F.lit("\n"), F.regexp_replace("url", "^https?://[^/]+", "/home/u"))
    return lines.absolute_paths(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id", "text")


@query(
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, unnest(regexp_extract_all(text, '{r.replace(chr(39), chr(39) * 2)}', 1)) AS secret FROM documents" for n, r in lines.SECRETS.items())
    + ") SELECT rule, count(DISTINCT secret) AS secrets, count(DISTINCT doc_id) AS files FROM f WHERE NOT regexp_matches(lower(secret), '(example|changeme|placeholder|your[_-]|xxxx|<|\\$\\{|environ|getenv)') AND (rule <> 'assignment' OR list_aggregate(string_split(secret, ''), 'entropy') >= 2.5) GROUP BY 1"
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.secrets(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT source, count(*) FILTER (regexp_matches(lower(text), 'licen[sc]e|copyright')) AS licensed, count(*) AS files FROM documents GROUP BY 1")
def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.lower("text").rlike("licen[sc]e|copyright")).alias("licensed"), F.count("*").alias("files"))


CLONE_WORDS = 50


@query(f"""
WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT path, line, unnest(regexp_extract_all(l, '[A-Za-z]+')) AS symbol, generate_subscripts(regexp_extract_all(l, '[A-Za-z]+'), 1) AS i FROM l),
t AS (SELECT path, line, lower(symbol) AS symbol, line * 1000000 + i AS pos FROM w),
g AS (SELECT path, line, list(symbol) OVER v AS s, list(line) OVER v AS ls FROM t WINDOW v AS (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND {CLONE_WORDS - 1} FOLLOWING)),
h AS (SELECT path, line, array_to_string(s, ' ') AS h, list_distinct(ls) AS ls FROM g WHERE len(s) = {CLONE_WORDS}),
twice AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT (path, line)) > 1),
d AS (SELECT count(*) AS duplicated FROM (SELECT DISTINCT path, unnest(ls) AS line FROM h WHERE h IN (SELECT h FROM twice))),
n AS (SELECT count(*) AS lines FROM (SELECT DISTINCT path, line FROM t))
SELECT lines, duplicated, round(duplicated * 100.0::DOUBLE / nullif(lines, 0), 2) AS value, {band_of_sql("L1.13", "round(duplicated * 100.0::DOUBLE / nullif(lines, 0), 2)")} AS band FROM n, d""")
def clone_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clone_ratio(table(spark, sf_dir, "documents"), "doc_id", "text", CLONE_WORDS)


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS i FROM n)
SELECT source, lang, n AS files FROM r WHERE i = 1""")
def language_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("k"), "lang", "n")).alias("r")).select("source", "r.lang", F.col("r.n").alias("files"))


# References, intervals, reconciliation.


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998)")
def dead_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1998).select(F.col("o_custkey").alias("c_custkey"))
    return joins.unreferenced(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), uses, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus = 'F'))")
def test_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return joins.only_from(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), uses, "c_custkey", F.col("o_orderstatus") == "F")


@query("""
WITH n AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part),
c AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS name FROM benchmark), s AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS name FROM conversations),
d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS name FROM documents)
SELECT name, CASE WHEN name IN (SELECT name FROM c) THEN 'config' WHEN name IN (SELECT name FROM s) THEN 'strings' WHEN name IN (SELECT name FROM d) THEN 'docs' ELSE 'dead' END AS found_in FROM n""")
def soft_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()

    def words(bucket: str, name: str) -> DataFrame:
        each = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), lambda w: F.lower(w)))
        return table(spark, sf_dir, name).select(F.lit(bucket).alias("bucket"), F.explode(each).alias("word"))

    every = words("config", "benchmark").union(words("strings", "conversations")).union(words("docs", "documents"))
    found = joins.soft_reference(names, every.join(names.select(F.col("name").alias("word")), "word", "left_semi").select("bucket", "word"), ["config", "strings", "docs"])
    return found.select("name", F.coalesce("found_in", F.lit("dead")).alias("found_in"))


@query("""
WITH s AS (SELECT user_id, event_id AS owner, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 86400 AS e FROM events WHERE event_type = 'purchase'),
p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS "at" FROM events WHERE event_type = 'click')
SELECT event_id, p.user_id, p."at", min(owner) AS owner FROM p LEFT JOIN s ON p.user_id = s.user_id AND s.start <= p."at" AND p."at" < s.e GROUP BY 1, 2, 3""")
def interval_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("owner"), F.col("at").alias("start"), (F.col("at") + 86400).alias("end"))
    return joins.interval_owner(e.where("event_type = 'click'").select("event_id", "user_id", "at"), spans, "user_id", "at", 86400)


@query("""
WITH e AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS signup FROM events)
SELECT event_id, user_id, signup FROM e WHERE event_type = 'error'""")
def asof_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return joins.latest_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", {"signup": "event_id"}, 3).where("event_type = 'error'").select("event_id", "user_id", "signup")


@query("""
SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2""")
def reconcile_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    kinds = e.select("event_type").distinct()  # the closed set of types, a few rows
    return joins.reconciled(e, e.select("user_id").distinct().crossJoin(kinds), ["user_id", "event_type"])


@query("""
WITH a AS (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.v AS left_value, b.v AS right_value,
  CASE WHEN a.l_suppkey IS NULL OR b.l_suppkey IS NULL THEN 'GAP' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'EQUAL' ELSE 'DIFF' END AS status FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey""")
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("v"))
    return joins.parity(of("A"), of("R"), "l_suppkey", "v")


@query("""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996)
SELECT o_custkey, 'new' AS verdict FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b) UNION ALL SELECT o_custkey, 'gone' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda y: table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).select("o_custkey").distinct()
    return joins.ratchet(of(1997), of(1996), "o_custkey")


@query("""
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS u, 'n' || n_nationkey AS v FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
r(node) AS (SELECT 'r1' UNION SELECT v FROM r JOIN e ON e.u = r.node) SELECT node FROM r""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("u"), name("n", "n_nationkey").alias("v"))
    down = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("u"), name("c", "c_custkey").alias("v"))
    return joins.reachable(up.union(down), spark.createDataFrame([("r1",)], "node string"))


# Verdicts, scores, budgets.

BY_YEAR = history.history_sql(CHANGES.format(by="CAST(year(o_orderdate) AS INTEGER) AS year, ", join=" JOIN orders ON l_orderkey = o_orderkey"), "year")
REACH = "SELECT user_id, CASE event_type WHEN 'error' THEN CASE WHEN value > 80 THEN 'UNDECIDED' ELSE 'FINITE' END WHEN 'purchase' THEN CASE WHEN value > 90 THEN 'UNBOUNDED' ELSE 'FINITE' END WHEN 'click' THEN 'FINITE' ELSE 'NONE' END AS kind FROM events"
VERDICT = f"(SELECT user_id, CASE WHEN bool_or(kind = 'UNDECIDED') THEN 'unresolved' WHEN bool_or(kind = 'UNBOUNDED') THEN 'promiscuous' ELSE 'neutral' END AS verdict FROM ({REACH}) GROUP BY 1)"
SCORE = f"""SELECT year, round(sum(w * p) / sum(w), 6) AS score FROM (SELECT year, CASE band WHEN 'Healthy' THEN 1.0::DOUBLE WHEN 'Not Healthy' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS p,
  CASE code WHEN 'L1.1' THEN 3 WHEN 'L1.2' THEN 3 WHEN 'L1.3' THEN 2 ELSE 1 END AS w FROM ({BY_YEAR}) WHERE code <> 'L1.7' AND band <> 'n/a') GROUP BY 1"""


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    kind = F.when((t == "error") & (v > 80), "UNDECIDED").when((t == "purchase") & (v > 90), "UNBOUNDED").when(t.isin("error", "purchase", "click"), "FINITE").otherwise("NONE")
    return table(spark, sf_dir, "events").select("user_id", kind.alias("kind"))


@query(f"SELECT year, count(*) FILTER (band = 'Slop') AS slop, count(*) FILTER (band <> 'n/a') AS measured, CASE WHEN count(*) FILTER (band <> 'n/a') = 0 THEN 'n/a' WHEN count(*) FILTER (band = 'Slop') * 20 / count(*) FILTER (band <> 'n/a') < 5 THEN 'Structured' WHEN count(*) FILTER (band = 'Slop') * 20 / count(*) FILTER (band <> 'n/a') < 11 THEN 'Mixed' ELSE 'Unstructured' END AS verdict FROM ({BY_YEAR}) GROUP BY 1")
def slop_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.slop_signals(history_by_year(spark, sf_dir), ["year"])


@query(SCORE)
def hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.hygiene(history_by_year(spark, sf_dir), ["year"])


@query(f"""
WITH s AS (SELECT CAST(1993 + user_id % 5 AS INTEGER) AS year, verdict FROM {VERDICT}), g AS (SELECT year, round(count(*) FILTER (verdict = 'unresolved') / count(*), 6) AS silence, bool_or(verdict = 'promiscuous') AS p FROM s GROUP BY 1), h AS ({SCORE})
SELECT g.year, silence, score, CASE WHEN p THEN 'F' WHEN silence > 0.52 OR score IS NULL THEN 'n/a' WHEN score >= 0.85 THEN 'A' WHEN score >= 0.6 THEN 'B' ELSE 'C' END AS grade FROM g LEFT JOIN h ON g.year = h.year""")
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = verdicts.verdict_fold(_reach(spark, sf_dir), "user_id").withColumn("year", (1993 + F.col("user_id") % 5).cast("int"))
    return verdicts.grade(states, hygiene(spark, sf_dir), ["year"])


@query(f"SELECT user_id, CASE WHEN bool_or(kind = 'UNDECIDED') THEN 'unresolved' WHEN bool_or(kind = 'UNBOUNDED') THEN 'promiscuous' ELSE 'neutral' END AS verdict, NOT bool_or(kind = 'UNDECIDED') AND NOT bool_or(kind = 'UNBOUNDED') AND bool_or(kind = 'FINITE') AS drives FROM ({REACH}) GROUP BY 1")
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdict_fold(_reach(spark, sf_dir), "user_id")


@query("""
WITH l AS (SELECT user_id, event_type AS name, arg_max(CAST(floor(value) AS BIGINT) % 7 + 1, event_id) AS c, arg_max(value < 50, event_id) AS o, arg_max(value < 200, event_id) AS k FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN bool_and(k) THEN CAST(1 + sum(c - 1) AS BIGINT) ELSE 0 END AS classes, bool_and(k) AND bool_and(o) AS ordered, bool_and(k) AS counted FROM l GROUP BY 1""")
def partition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("event_type").alias("name"), F.col("event_id").alias("ord"), (F.floor("value") % 7 + 1).alias("classes"), (F.col("value") < 50).alias("ordered"), (F.col("value") < 200).alias("counted"))
    return verdicts.partition_rollup(rows, "user_id")


REASONS = ["click", "error", "purchase", "signup", "view", "unmeasured", "opaque"]


@query(f"""
WITH r AS (SELECT unnest({REASONS}) AS reason), t AS (SELECT count(*) AS total FROM events)
SELECT r.reason, count(e.event_id) AS n, round(count(e.event_id) / any_value(total), 6) AS fraction FROM t, r LEFT JOIN events e ON e.event_type = r.reason AND e.value < 10 GROUP BY 1""")
def silence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    return verdicts.silence_summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "reason"), reasons, F.col("value") < 10)


@query("""
WITH r AS (SELECT user_id, event_id % 5 AS run, bool_or(event_type = 'error' AND value > 90) AS failed FROM events GROUP BY 1, 2), t AS (SELECT user_id, count(*) FILTER (NOT failed) AS passed, count(*) AS runs FROM r GROUP BY 1)
SELECT user_id, passed, runs, passed || '/' || runs AS tally, CASE WHEN passed = runs THEN 'Healthy' WHEN passed = runs - 1 THEN 'Not Healthy' ELSE 'Slop' END AS band FROM t""")
def determinism_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.groupBy("user_id", (F.col("event_id") % 5).alias("run")).agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("failed"))
    return verdicts.determinism(runs, "user_id")


@query("SELECT o_custkey, o_orderkey, greatest(0.0::DOUBLE, least(12.0::DOUBLE, 100.0::DOUBLE - 12.0::DOUBLE * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1))) AS allowance FROM orders")
def budget_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return verdicts.allowances(units, "o_custkey", ["o_orderdate", "o_orderkey"], 12.0, 100.0).select("o_custkey", "o_orderkey", "allowance")


@query("SELECT o_custkey, count(*) AS units, CAST(ceil(100 / count(*)) AS BIGINT) AS share FROM orders GROUP BY 1")
def fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("units")).withColumn("share", F.ceil(100 / F.col("units")).cast("long"))


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(floor(value / 20) AS BIGINT)) AS r FROM events GROUP BY 1, 2 HAVING count(*) > 1)
SELECT user_id, count(*) AS repeated, count(*) FILTER (r > 1) AS broken, CASE WHEN count(*) FILTER (r > 1) = 0 THEN 'holds' ELSE 'broken' END AS verdict FROM s GROUP BY 1""")
def property_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("result", F.floor(F.col("value") / 20))
    return verdicts.properties(calls, "user_id", ["event_type"], "result")


@query(f"SELECT n_regionkey, count(*) AS files, round(avg(s_acctbal), 6) AS value, {band_sql('avg(s_acctbal)', 5000, 3000, True)} AS band FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), ())")
def rollup_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.functions.bands import band

    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    value = F.avg("s_acctbal")
    return s.rollup("n_regionkey").agg(F.count("*").alias("files"), F.round(value, 6).alias("value"), band(value, 5000, 3000, True).alias("band"))


# Flows and edits.


@query()
def path_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of each user's graph of event types: a day is a session from entry through its moves to exit."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    moves = e.select("user_id", F.coalesce(F.lag("event_type").over(w), F.lit("entry")).alias("u"), F.col("event_type").alias("v"), F.lead("event_id").over(w).isNull().alias("last"))
    ends = moves.where("last").select("user_id", F.col("v").alias("u"), F.lit("exit").alias("v"))
    return flows.path_cover(moves.select("user_id", "u", "v").union(ends).distinct(), "user_id")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a file: what the user says replaces its first word by the last one, all else writes it anew."""
    c = table(spark, sf_dir, "conversations")
    words = F.split(F.trim(F.col("text")), r"\s+")
    return c.select("conv_id", F.col("turn").alias("ord"), F.when(F.col("role") == "user", "edit").otherwise("write").alias("kind"), F.col("text").alias("content"), F.try_element_at(words, F.lit(1)).alias("old"), F.try_element_at(words, F.lit(-1)).alias("new"), F.lit(False).alias("replace_all"))


@query()
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.edit_replay(_edits(spark, sf_dir), "conv_id")


@query("""
WITH s AS (SELECT conv_id, role, CAST(sum(CASE WHEN coalesce(role, '') <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS span FROM conversations)
SELECT conv_id, span, count(*) FILTER (role = 'user') AS edits FROM s GROUP BY 1, 2""")
def anchor_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.anchor_spans(_edits(spark, sf_dir), "conv_id")
