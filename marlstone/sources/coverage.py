"""Coverage reports of eight tools as one table (report, metric, covered, total), and the verdict over it.

A report that lacks what it must have has NULL counts, and NULL or no counts are refused, never graded as 0 %."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.bands import coverage_band

#: Exit codes after which a suite's figure would be about a run that never was.
INVALID = {2: "interrupted", 3: "internal error", 4: "usage or collection error", 5: "no tests", 124: "timed out"}


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One row a report.  Reports are summaries of bounded size, so each is read whole."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("report"), F.col("value").alias("t"))


def _counted(rows: DataFrame, metric: str, covered: Column, total: Column) -> DataFrame:
    return rows.select("report", F.lit(metric).alias("metric"), covered.cast("long").alias("covered"), total.cast("long").alias("total"))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """Python's coverage JSON: branch totals; a total without a covered count stays NULL."""
    get = lambda k: F.get_json_object("t", f"$.totals.{k}").try_cast("long")
    return _counted(_whole(spark, path), "branches", get("covered_branches"), F.coalesce(get("num_branches"), F.lit(0)))


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    root = F.regexp_extract("t", r"(?s)<coverage\b([^>]*)>", 1)
    get = lambda k: F.nullif(F.regexp_extract(root, rf'\b{k}="(\d+)"', 1), F.lit("")).try_cast("long")
    return _counted(_whole(spark, path), "branches", get("branches-covered"), get("branches-valid"))


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """The report's own BRANCH counter, a child of the root: those of packages are its parts."""
    outer = F.regexp_replace("t", r"(?s)<(package|group)\b.*</\1>", "")
    tag = F.regexp_extract(outer, r'<counter\b([^>]*type="BRANCH"[^>]*)/?>', 1)
    get = lambda k: F.nullif(F.regexp_extract(tag, rf'\b{k}="(\d+)"', 1), F.lit("")).try_cast("long")
    none = tag == ""
    return _counted(_whole(spark, path), "branches", F.when(none, 0).otherwise(get("covered")), F.when(none, 0).otherwise(get("covered") + get("missed")))


def c8_summary(spark: SparkSession, path: str) -> DataFrame:
    get = lambda k: F.get_json_object("t", f"$.total.branches.{k}").try_cast("long")
    return _counted(_whole(spark, path), "branches", get("covered"), get("total"))


def simplecov(spark: SparkSession, path: str) -> DataFrame:
    """All branches of all commands and files; files in the old form of lines only have none."""
    shape = "map<string, struct<coverage: map<string, struct<branches: map<string, map<string, long>>>>>>"
    files = F.flatten(F.transform(F.map_values(F.from_json("t", shape)), lambda c: F.coalesce(F.map_values(c["coverage"]), F.array())))
    groups = F.flatten(F.transform(files, lambda f: F.coalesce(F.map_values(f["branches"]), F.array())))
    hits = F.flatten(F.transform(groups, lambda g: F.map_values(g)))
    return _counted(_whole(spark, path), "branches", F.size(F.filter(hits, lambda n: n > 0)), F.size(hits))


def lcov_summary(spark: SparkSession, path: str) -> DataFrame:
    """Lines, since C's tools have no convention for branches."""
    get = lambda i: F.nullif(F.regexp_extract("t", r"lines\.*: *[\d.]+% *\((\d+) of (\d+) lines?\)", i), F.lit("")).try_cast("long")
    return _counted(_whole(spark, path), "lines", get(1), get(2))


def go_func(spark: SparkSession, path: str) -> DataFrame:
    """Statements: the total in tenths of a percent."""
    share = F.nullif(F.regexp_extract("t", r"(?m)^total:.*?([\d.]+)%", 1), F.lit("")).try_cast("double")
    return _counted(_whole(spark, path), "statements", F.round(share * 10), F.when(share.isNotNull(), F.lit(1000)))


def llvm_export(spark: SparkSession, path: str) -> DataFrame:
    get = lambda k: F.get_json_object("t", f"$.data[0].totals.regions.{k}").try_cast("long")
    return _counted(_whole(spark, path), "regions", get("covered"), get("count"))


READERS = {"python": coverage_json, "csharp": cobertura, "java": jacoco, "javascript": c8_summary, "typescript": c8_summary, "ruby": simplecov, "c": lcov_summary, "go": go_func, "rust": llvm_export}


def verdict(reports: DataFrame, by: list[str], exit_code: Column | None = None) -> DataFrame:
    """(by…, value, band, reason): the share covered in percent, or why there is none."""
    code = exit_code if exit_code is not None else F.lit(0)
    invalid = F.create_map(*(F.lit(x) for kv in INVALID.items() for x in kv))
    share = F.when((F.col("total") > 0) & code.isin(0, 1), F.col("covered") / F.col("total") * 100)
    reason = (
        F.when(~code.isin(0, 1), F.coalesce(F.try_element_at(invalid, code), F.concat(F.lit("exit "), code.cast("string"))))
        .when(F.col("total").isNull() | F.col("covered").isNull(), "malformed report").when(F.col("total") == 0, "nothing to cover")
    )
    return reports.select(*by, F.round(share, 1).alias("value"), coverage_band(share).alias("band"), reason.alias("reason"))


def uncovered(branches: DataFrame, lines: DataFrame) -> DataFrame:
    """Branches (file, line, …) whose first line is among the lines (file, line, hits) never run."""
    return branches.join(lines.where("hits = 0").select("file", "line").distinct(), ["file", "line"], "left_semi")
