"""Folds of verdicts, partitions, silences, run tallies, scores, grades and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENCE_FLOOR = 0.52
WEIGHTS = {"L1.1": 3, "L1.2": 3, "L1.3": 2, "L1.4": 1, "L1.5": 1, "L1.6": 1}


def verdict_fold(reaches: DataFrame, key: str) -> DataFrame:
    """(key, verdict, drives) of (key, kind): undecided before unbounded before finite."""
    any_ = lambda k: F.bool_or(F.col("kind") == k)
    folded = reaches.groupBy(key).agg(any_("UNDECIDED").alias("u"), any_("UNBOUNDED").alias("p"), any_("FINITE").alias("f"))
    return folded.select(key, F.when(F.col("u"), "unresolved").when(F.col("p"), "promiscuous").otherwise("neutral").alias("verdict"), (~F.col("u") & ~F.col("p") & F.col("f")).alias("drives"))


def partition_rollup(reaches: DataFrame, key: str) -> DataFrame:
    """(key, classes, ordered, counted) of (key, name, ord, classes, ordered, counted): of a name the last row wins; one uncounted makes all unknown."""
    last = reaches.groupBy(key, "name").agg(F.max_by(F.struct("classes", "ordered", "counted"), "ord").alias("r")).select(key, "r.*")
    total = last.groupBy(key).agg((1 + F.sum(F.col("classes") - 1)).alias("c"), F.bool_and("ordered").alias("o"), F.bool_and("counted").alias("k"))
    return total.select(key, F.when(F.col("k"), F.col("c")).otherwise(F.lit(0)).cast("long").alias("classes"), (F.col("k") & F.col("o")).alias("ordered"), F.col("k").alias("counted"))


def silence_summary(findings: DataFrame, reasons: DataFrame, silent: Column) -> DataFrame:
    """(reason, n, fraction): silent findings by every known reason, zero where there is none."""
    total = findings.agg(F.count("*").alias("total"))
    by = findings.where(silent).groupBy("reason").agg(F.count("*").alias("n"))
    joined = reasons.join(by, "reason", "left").crossJoin(total)  # one row
    return joined.select("reason", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")), F.lit(0.0)), 6).alias("fraction"))


def determinism(runs: DataFrame, key: str) -> DataFrame:
    """(key, passed, runs, tally, band) of (key, run, failed)."""
    return run_tally(runs.select(key, "run", F.when(F.col("failed"), 1).otherwise(0).alias("code"), F.lit(True).alias("ran")), key).drop("reason")


def run_tally(runs: DataFrame, key: str) -> DataFrame:
    """(key, passed, runs, tally, band, reason) of (key, run, code, ran), in the order of `run`.

    A timeout (code 124) or a run without tests refuses the whole, by the first one that is either."""
    first = F.min_by(F.when(F.col("code") == 124, "timed out").otherwise("did not run"), F.when((F.col("code") == 124) | ~F.col("ran"), F.col("run")))
    n = runs.groupBy(key).agg(F.count_if(F.col("code") == 0).alias("passed"), F.count("*").alias("runs"), F.when(F.bool_or((F.col("code") == 124) | ~F.col("ran")), first).alias("reason"))
    band = F.when(F.col("reason").isNotNull(), "n/a").when(F.col("passed") == F.col("runs"), "Healthy").when(F.col("passed") == F.col("runs") - 1, "Not Healthy").otherwise("Slop")
    said = F.when(F.col("reason").isNotNull(), "n/a").otherwise(F.concat_ws("/", F.col("passed").cast("string"), F.col("runs").cast("string")))
    return n.select(key, "passed", "runs", said.alias("tally"), band.alias("band"), "reason")


def slop_signals(panel: DataFrame, by: list[str]) -> DataFrame:
    """(by…, slop, measured, verdict): refused rows are in neither number; bounds scale from 5 and 11 of 20."""
    n = panel.groupBy(*by).agg(F.count_if(F.col("band") == "Slop").alias("slop"), F.count_if(F.col("band") != "n/a").alias("measured"))
    share = F.try_divide(F.col("slop") * 20, F.col("measured"))
    return n.select(*by, "slop", "measured", F.when(share.isNull(), "n/a").when(share < 5, "Structured").when(share < 11, "Mixed").otherwise("Unstructured").alias("verdict"))


def hygiene(panel: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(by…, score): the weighted mean of 1, 0.5 and 0 of the bands; what was refused takes its weight out."""
    weight = F.create_map(*(F.lit(x) for c, w in (weights or WEIGHTS).items() for x in (c, float(w))))
    points = F.when(F.col("band") == "Healthy", 1.0).when(F.col("band") == "Not Healthy", 0.5).when(F.col("band") == "Slop", 0.0)
    rows = panel.where(F.col("code").isin(*(weights or WEIGHTS))).withColumn("p", points).withColumn("w", F.when(F.col("p").isNotNull(), F.try_element_at(weight, "code")))
    return rows.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("w")), F.sum("w")), 6).alias("score"))


def grade(states: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """(by…, silence, score, grade): promiscuous first, then too much silence, then A, B or C by the score; nothing known is n/a."""
    s = states.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "unresolved").alias("u"), F.bool_or(F.col("verdict") == "promiscuous").alias("p"))
    j = s.join(scores, by, "left").withColumn("silence", F.round(F.try_divide(F.col("u"), F.col("n")), 6))
    g = F.when(F.col("p"), "F").when(F.col("silence") > SILENCE_FLOOR, "n/a").when(F.col("score").isNull(), "n/a").when(F.col("score") >= 0.85, "A").when(F.col("score") >= 0.6, "B").otherwise("C")
    return j.select(*by, "silence", "score", g.alias("grade"))


def graded(summary: DataFrame, bound: int | None = None) -> DataFrame:
    """`summary` (neutral, promiscuous, unresolved, meter_ran, declared, visited, admitted, widest, score) with basis, status, grade.

    Basis: no-source, unread (declarations, none of them visited and none admitted), a promiscuous proof, silent beyond the
    floor, or measured.  Status: na, cannot (F), coarse (D: an unordered partition wider than `bound`), can (A, B or C)."""
    total = F.col("neutral") + F.col("promiscuous") + F.col("unresolved")
    silence = F.coalesce(F.try_divide(F.col("unresolved"), total), F.lit(0.0))
    unread = (F.col("declared") > 0) & (F.col("visited") == 0) & (F.col("admitted") == 0)
    basis = F.when(~F.col("meter_ran"), "no-source").when(F.coalesce(unread, F.lit(False)), "unread").when(F.col("promiscuous") > 0, "measured").when(silence > SILENCE_FLOOR, "silent").otherwise("measured")
    wide = F.lit(False) if bound is None else F.coalesce(F.col("widest") > bound, F.lit(False))
    status = F.when(basis != "measured", "na").when(F.col("promiscuous") > 0, "cannot").when(wide, "coarse").otherwise("can")
    letter = F.when(F.col("score").isNull() | (F.col("score") >= 0.85), "A").when(F.col("score") >= 0.6, "B").otherwise("C")
    grade_ = F.when(status == "cannot", "F").when(status == "coarse", "D").when(status == "can", letter)
    return summary.withColumns({"silence": F.round(silence, 6), "basis": basis, "status": status, "grade": grade_})


def allowances(units: DataFrame, key: str, order: list[str], cap: float, ceiling: float) -> DataFrame:
    """`units` with `allowance`: at most `cap` each while the key's `ceiling` lasts, in order."""
    spent = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return units.withColumn("allowance", F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.lit(float(ceiling)) - spent * float(cap))))


def properties(calls: DataFrame, key: str, signature: list[str], result: str) -> DataFrame:
    """(key, repeated, broken, verdict): whether a signature seen twice always had one result."""
    per = calls.groupBy(key, *signature).agg(F.count("*").alias("n"), F.count_distinct(result).alias("results")).where("n > 1")
    judged = per.groupBy(key).agg(F.count("*").alias("repeated"), F.count_if(F.col("results") > 1).alias("broken"))
    return judged.select(key, "repeated", "broken", F.when(F.col("broken") == 0, "holds").otherwise("broken").alias("verdict"))


def observed(calls: DataFrame, key: str) -> DataFrame:
    """(key, mutation, purity, determinism, idempotency), each holds, breaks, unobserved or unverified, of calls
    (key, ord, before, after, result, raised, opaque, state_before, state_after): texts, of which `before` is all that was passed.

    One change breaks the first two.  Determinism needs a signature twice; idempotency a call of what an earlier one returned."""
    readable = ~F.col("opaque")
    stated = F.col("state_before").isNotNull() & F.col("state_after").isNotNull()
    some = calls.groupBy(key).agg(
        F.bool_or(readable).alias("_r"), F.bool_or(readable & (F.col("before") != F.col("after"))).alias("_m"),
        F.bool_or(stated).alias("_s"), F.bool_or(stated & (F.col("state_before") != F.col("state_after"))).alias("_p"),
    )
    told = calls.where(readable & ~F.col("raised"))
    same = told.groupBy(key, "before").agg(F.count("*").alias("n"), F.count_distinct("result").alias("d")).where("n > 1").groupBy(key).agg((F.max("d") == 1).alias("_d"))
    earliest = told.groupBy(key, F.col("result").alias("before")).agg(F.min("ord").alias("_first"))
    again = told.join(earliest, [key, "before"]).where("ord > _first").groupBy(key).agg(F.bool_and(F.col("result") == F.col("before")).alias("_i"))
    j = some.join(same, key, "left").join(again, key, "left")
    shown = lambda c: F.when(~F.col("_r"), "unverified").when(F.col(c).isNull(), "unobserved").when(F.col(c), "holds").otherwise("breaks")
    mutation = F.when(~F.col("_r"), "unverified").when(F.col("_m"), "breaks").otherwise("holds")
    purity = F.when(~F.col("_s"), "unverified").when(F.col("_p"), "breaks").otherwise("holds")
    return j.select(key, mutation.alias("mutation"), purity.alias("purity"), shown("_d").alias("determinism"), shown("_i").alias("idempotency"))
