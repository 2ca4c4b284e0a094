"""Readers that turn exported logs and reports into tables.

Logs of records are split at the records' marks, so that one large file is many tasks' work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numstat(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(sha, date, added, deleted, path) of an exported history: lines `COMMIT <sha>`, with a date after a space if it was
    exported, and then `added TAB deleted TAB path`.

    `-` is a binary file, with NULL lines.  Bounds on the date are inclusive and leave out commits without one."""
    blocks = spark.read.option("lineSep", "\nCOMMIT ").text(path).select(F.regexp_replace("value", "^COMMIT ", "").alias("b"))
    head = F.trim(F.substring_index("b", "\n", 1))
    parts = blocks.where(head.rlike("^[0-9A-Za-z]+( |$)")).select(F.split(head, " ")[0].alias("sha"), F.try_element_at(F.split(head, " "), F.lit(2)).alias("date"), F.explode(F.split("b", "\n")).alias("line"))
    rows = parts.where(F.col("line").contains("\t"))
    if since is not None:
        rows = rows.where(F.col("date") >= since)
    if until is not None:
        rows = rows.where(F.col("date") <= until)
    part = F.split("line", "\t", 3)
    return rows.select("sha", "date", part[0].try_cast("long").alias("added"), part[1].try_cast("long").alias("deleted"), part[2].alias("path"))


def transcripts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(ts, file_path, kind, content, old, new, replace_all, seq) of Write and Edit uses in JSON lines; broken lines are passed over.

    Lines are filtered by a substring before any is parsed.  Of equal events (without replace_all) the first is kept;
    `seq` is the order of the source, by which events of one time are replayed."""
    use = "type string, name string, input struct<file_path: string, content: string, old_string: string, new_string: string, replace_all: boolean>"
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()).where(F.col("value").contains("tool_use"))
    parsed = lines.select("_line", F.from_json("value", f"timestamp string, message struct<content: array<struct<{use}>>>").alias("j"))
    uses = parsed.select("_line", F.col("j.timestamp").alias("ts"), F.posexplode("j.message.content").alias("_at", "u")).where("u.type = 'tool_use' AND u.name IN ('Write', 'Edit')")
    x = F.col("u.input")
    rows = uses.select("ts", x["file_path"].alias("file_path"), F.lower("u.name").alias("kind"), x["content"].alias("content"), x["old_string"].alias("old"), x["new_string"].alias("new"), F.coalesce(x["replace_all"], F.lit(False)).alias("replace_all"), F.struct("_line", "_at").alias("seq"))
    kept = rows.where(F.col("file_path").endswith(suffix)).groupBy("ts", "kind", "content", "old", "new").agg(F.min_by(F.struct("file_path", "replace_all", "seq"), "seq").alias("f"))
    return kept.select("ts", "f.file_path", "kind", "content", "old", "new", "f.replace_all", "f.seq")


def panel_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(repository, window, indicator, value) of a wide table of tab-separated values; what is no number is dropped."""
    wide = spark.read.csv(path, sep="\t", comment="#", header=True)
    values = [c for c in wide.columns if c not in ("repository", "window")]
    return wide.unpivot(["repository", "window"], values, "indicator", "raw").select("repository", "window", "indicator", F.col("raw").try_cast("double").alias("value")).where("value IS NOT NULL")


def wide_panel(panel: DataFrame, by: list[str], indicators: list[str]) -> DataFrame:
    """(by…, one column an indicator) of (by…, code, value): rows that lack any of the wanted ones go."""
    wide = panel.where(F.col("code").isin(*indicators)).groupBy(*by).pivot("code", indicators).agg(F.first("value"))
    return wide.na.drop(subset=indicators)


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of an lcov trace."""
    records = spark.read.option("lineSep", "end_of_record").text(path).select(F.col("value").alias("r"))
    rows = records.select(F.regexp_extract("r", r"SF:([^\n]+)", 1).alias("file"), F.explode(F.regexp_extract_all("r", F.lit(r"DA:(\d+,\d+)"), 1)).alias("d"))
    return rows.select("file", F.split("d", ",")[0].cast("long").alias("line"), F.split("d", ",")[1].cast("long").alias("hits"))


def call_roles(spark: SparkSession, path: str) -> DataFrame:
    """(function, role) read back from a rendered call map of lines `role fn name : …`; without a role it is pure."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    form = r"^(?:(\w+)\s+)?fn\s+(\w+)\s*(?::|$)"
    rows = spark.read.text(path).select(F.regexp_extract(line, form, 2).alias("function"), F.regexp_extract(line, form, 1).alias("role"))
    return rows.where("function <> ''").select("function", F.when(F.col("role") == "", "pure").otherwise(F.col("role")).alias("role"))


def ordered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `ord`, their place in the key by a total order."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


RACE = "WARNING: ThreadSanitizer: data race"


def races(logs: DataFrame) -> DataFrame:
    """(id, file, line, symbol, accesses) of sanitizer logs (id, text): a row for each report that has its summary.

    `accesses` are file:line of the first source frame within five lines of each access."""
    blocks = logs.where(F.col("text").contains(RACE)).select("id", F.posexplode(F.split("text", RACE)).alias("_n", "b")).where("_n > 0")
    summary = r"SUMMARY: ThreadSanitizer: data race ([^:\s]+):(\d+)(?::\d+)? in ([^\n]+)"
    frame = r"(?:[Ww]rite|[Rr]ead) of size[^\n]*\n(?:[^\n]*\n){0,4}?[^\n]*#\d+ [^\n]*?\s([^\s:]+\.\w+:\d+)"
    got = lambda i: F.regexp_extract("b", summary, i)
    return blocks.where(got(1) != "").select("id", got(1).alias("file"), got(2).cast("long").alias("line"), F.trim(got(3)).alias("symbol"), F.regexp_extract_all("b", F.lit(frame), 1).alias("accesses"))


def panics(logs: DataFrame) -> DataFrame:
    """(id, ord, file, line, thread, message) of test output (id, text): the message is quoted, or the line below."""
    form = r"thread '([^']*)' panicked at (?:'([^']*)', )?([^\s:,]+\.\w+):(\d+)"
    rows = logs.select("id", F.split("text", "\n").alias("ls")).select("id", "ls", F.posexplode("ls").alias("ord", "l")).where(F.col("l").rlike(form))
    got = lambda i: F.regexp_extract("l", form, i)
    below = F.trim(F.coalesce(F.try_element_at("ls", F.col("ord") + 2), F.lit("")))
    return rows.select("id", "ord", got(3).alias("file"), got(4).cast("long").alias("line"), got(1).alias("thread"), F.substring(F.when(got(2) != "", got(2)).otherwise(below), 1, 200).alias("message"))
