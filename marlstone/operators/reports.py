"""What a report says of rows: orders, cut lists with what was cut, worst cases, tallies with zeros, gates and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.bands import guarded

VERDICTS = ["promiscuous", "unresolved", "neutral"]
SEVERITIES = ["exposed", "review", "candidate"]


def ranked(value: Column, order: list[str]) -> Column:
    """The place of a value in a closed order, after all of it if it isn't there."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def listed(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first `cap` rows of each group with `rank`, and `more`: how many others there are; counts are never cut."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - cap, F.lit(0)).cast("long"))
    return out.where(F.col("rank") <= cap)


def by_verdict(findings: DataFrame, by: list[str], cap: int = 50) -> DataFrame:
    """Findings (verdict, drives, file, line): the worst verdict first, of these what drives a decision, then by place."""
    return listed(findings, by, [ranked(F.col("verdict"), VERDICTS), F.col("drives").desc(), F.col("file"), F.col("line")], cap)


def coarse(states: DataFrame, by: list[str], bound: int, cap: int = 20) -> DataFrame:
    """States (classes, ordered, counted, drives, file, line) of more than `bound` classes without an order, the most first."""
    wide = states.where(F.col("counted") & F.col("drives") & ~F.col("ordered") & (F.col("classes") > bound))
    return listed(wide, by, [F.col("classes").desc(), F.col("file"), F.col("line")], cap)


def worst(findings: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by…, exposed, review, candidate, verdict) of findings (by…, severity) over files (by…, parsed).

    A finding outranks what wasn't read; without any, nothing parsed is `unread` and not clean."""
    n = findings.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    read = files.groupBy(*by).agg(F.count_if("parsed").alias("_parsed"))
    joined = read.join(n, by, "full_outer").na.fill(0, [*SEVERITIES, "_parsed"])
    verdict = F.when(F.col("exposed") > 0, "exposed").when(F.col("review") > 0, "review").when(F.col("candidate") > 0, "candidate").when(F.col("_parsed") == 0, "unread").otherwise("clean")
    return joined.select(*by, *SEVERITIES, verdict.alias("verdict"))


def stress(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by…, passed, runs, verdict, band) of runs (by…, code): some failing is a race, all failing is not; a timeout refuses."""
    n = runs.groupBy(*by).agg(F.count_if(F.col("code") == 0).alias("passed"), F.count("*").alias("runs"), F.bool_or(F.col("code") == 124).alias("_late"))
    verdict = F.when(F.col("_late") | (F.col("passed") == 0), "n/a").when(F.col("passed") == F.col("runs"), "no-race-in-stress").otherwise("race-observed")
    band = F.when(verdict == "n/a", "n/a").when(verdict == "race-observed", "Slop").otherwise("Healthy")
    return n.select(*by, "passed", "runs", verdict.alias("verdict"), band.alias("band"))


def panics(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each place (file, line) of a group: the last message."""
    return rows.groupBy(*by, "file", "line").agg(F.max_by("message", order).alias("message"))


def tally(rows: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """(key, n) for every known kind, zero where there is none."""
    return kinds.select(key).join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def pooled(states: DataFrame) -> DataFrame:
    """(ordered, classes, n): how often states that decide something and could be counted have each number of classes."""
    return states.where("drives AND counted AND classes > 0").groupBy("ordered", "classes").agg(F.count("*").alias("n"))


def partition_summary(states: DataFrame, by: list[str]) -> DataFrame:
    """(by…, deciding, uncounted, ordered_classes, unordered_classes): sorted lists of the classes of neutral states that decide."""
    d = states.where("verdict = 'neutral' AND drives")
    kept = lambda o: F.sort_array(F.collect_list(F.when(F.col("counted") & (F.col("ordered") == o), F.col("classes"))))
    return d.groupBy(*by).agg(F.count("*").alias("deciding"), F.count_if(~F.col("counted")).alias("uncounted"), kept(True).alias("ordered_classes"), kept(False).alias("unordered_classes"))


def key_bound(stores: DataFrame, by: list[str]) -> DataFrame:
    """(by…, bound) of stores (by…, cells, open): the sum of the cells; NULL if any store's key is open and unguarded."""
    return stores.groupBy(*by).agg(F.when(F.bool_or("open"), F.lit(None)).otherwise(F.sum("cells")).cast("long").alias("bound"))


def silence_index(facets: DataFrame, by: list[str]) -> DataFrame:
    """(by…, facets, silent, index): the share of facets that no test shows; NULL of none."""
    n = facets.groupBy(*by).agg(F.count("facet").alias("facets"), F.count_if(F.col("facet").isNotNull() & ~F.col("shown")).alias("silent"))
    return n.select(*by, "facets", "silent", F.round(guarded(F.col("silent"), F.col("facets"), 1.0), 6).alias("index"))


def testable_share(counts: DataFrame) -> DataFrame:
    """`counts` (neutral, promiscuous, touching) with `testable` and `refused`.

    100 where nothing was decided; refused where nothing was, while functions do touch unbounded state: then a rule is missing."""
    decided = F.col("neutral") + F.col("promiscuous")
    refused = (decided == 0) & (F.coalesce("touching", F.lit(0.0)) > 0)
    share = F.when(refused, F.lit(None)).when(decided == 0, 100).otherwise(F.round(F.col("neutral") / decided * 100)).cast("long")
    return counts.withColumn("testable", share).withColumn("refused", refused)


def gate(counts: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """(key, actual, baseline, verdict): above its baseline fails, below it is slack and fails too; without one any is a failure."""
    joined = counts.select(key, "actual").join(baselines.select(key, "baseline"), key, "full_outer").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    limit = F.coalesce("baseline", F.lit(0))
    verdict = F.when(F.col("actual") > limit, "fail").when(F.col("actual") < limit, "slack").otherwise("pass")
    return joined.select(key, "actual", "baseline", verdict.alias("verdict"))


def noted(details: Column, skipped: Column, shown: Column, total: Column) -> Column:
    """The details, what was unreadable, and that a list was cut: each only where it is so."""
    unread = F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" file(s) unreadable and excluded")))
    cut = F.when(total > shown, F.concat(shown.cast("string"), F.lit(" of them listed below")))
    return F.concat_ws("; ", details, unread, cut)


def card(panel: DataFrame, by: str) -> DataFrame:
    """(by, markdown): the panel (by, code, value, band) as a table of text; a group's panel is a few dozen rows."""
    line = F.format_string("| %s | %s | %s |", F.col("code"), F.coalesce(F.col("value").cast("string"), F.lit("n/a")), F.col("band"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", line.alias("line")))), lambda x: x["line"]), "\n")
    return panel.groupBy(by).agg(F.concat(F.lit("| code | value | band |\n|---|---|---|\n"), body).alias("markdown"))


def envelope(panel: DataFrame, by: str) -> DataFrame:
    """(by, json): the panel as one object of codes."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("code"), F.struct("value", "band")))))
    return panel.groupBy(by).agg(F.to_json(entries).alias("json"))


def rendered_map(roles: DataFrame) -> DataFrame:
    """(path, text): the functions of each module (path, function, role), by role, as lines `role fn name :`; pure ones have no role."""
    line = F.concat(F.when(F.col("role") == "pure", "").otherwise(F.concat(F.col("role"), F.lit(" "))), F.lit("fn "), F.col("function"), F.lit(" :"))
    place = ranked(F.col("role"), ["boundary_in", "pure", "orchestrator", "boundary_out"])
    return roles.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("function"), line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
