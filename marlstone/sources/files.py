"""A tree of files as a table (repo, path, size, text): what is read, what is out of scope, and what is said about it.

Files are listed once by the driver, as any scan does, and read by tasks.  Everything else is relational."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths

MOST_BYTES = 1 << 20
DOCS = ["md", "rst", "txt", "adoc", "org"]
SOURCE = r"\.(py|rs|go|js|jsx|mjs|cjs|ts|tsx|java|cs|rb|c|h)$"


def listed(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, path, size, linked) of all files and linked folders below a folder; linked folders are listed, not entered."""
    rows = []
    for folder, names, files in os.walk(root, followlinks=False):
        for name in names:
            if os.path.islink(os.path.join(folder, name)):
                rows.append((repo, os.path.relpath(os.path.join(folder, name), root), None, True))
        for name in files:
            full = os.path.join(folder, name)
            rows.append((repo, os.path.relpath(full, root), os.path.getsize(full) if os.path.isfile(full) else None, False))
    return spark.createDataFrame(rows, "repo string, path string, size long, linked boolean")


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        raw, error = f.read(), None
                except OSError as e:
                    raw, error = None, type(e).__name__
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([raw], pa.binary()), pa.array([error], pa.string())], names=[*row.schema.names, "content", "error"])

    return run


def read(files: DataFrame, root: str) -> DataFrame:
    """`files` with `content` and `error`: what can't be read is a row with an error, not a clean file."""
    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInArrow(_reader(root), f"{schema}, content binary, error string")


def ancestors(path: Column) -> Column:
    """The paths of all folders above a path, the root left out."""
    split = paths.parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda n: F.array_join(F.slice(split, 1, n), "/"))


def without_below(files: DataFrame, folders: DataFrame) -> DataFrame:
    """`files` (repo, path, …) that are under none of `folders` (repo, path)."""
    above = files.where(F.size(paths.parts(F.col("path"))) > 1).select("repo", "path", F.explode(ancestors(F.col("path"))).alias("_above"))
    under = above.join(folders.select("repo", F.col("path").alias("_above")).distinct(), ["repo", "_above"], "left_semi").select("repo", "path").distinct()
    return files.join(under, ["repo", "path"], "left_anti")


def own_files(files: DataFrame) -> DataFrame:
    """The files of the checkout itself: none under a linked folder, none of a checkout nested in it.

    A nested checkout has an entry `.git` of its own below the root, a folder in a clone and a file in a worktree."""
    nested = files.where(F.col("path").rlike(r"/\.git(/|$)")).select("repo", F.regexp_extract("path", r"^(.*?)/\.git(?:/|$)", 1).alias("path"))
    links = files.where("linked").select("repo", "path")
    return without_below(files.where("NOT linked"), nested.union(links))


def has_packages(files: DataFrame) -> DataFrame:
    """(repo, has_packages, root_is_package): any package marker outside vendored folders, and one at the root."""
    mark = (paths.name_of(F.col("path")) == "__init__.py") & ~paths.is_vendored(F.col("path"))
    return files.groupBy("repo").agg(F.bool_or(mark).alias("has_packages"), F.bool_or(F.col("path") == "__init__.py").alias("root_is_package"))


def claimed(files: DataFrame, scope: str) -> DataFrame:
    """(repo, path, place, marker, folder): the folders above each file that a scope's markers name, in the order of the markers."""
    folders = paths.parts(paths.folder_of(F.col("path")))

    def claims(place: int, marker: str) -> Column:
        named = F.transform(folders, lambda p, n: F.when(paths.matches(p, marker), F.array_join(F.slice(folders, 1, n + 1), "/")))
        return F.transform(F.filter(named, lambda x: x.isNotNull()), lambda f: F.struct(F.lit(place).alias("place"), F.lit(marker).alias("marker"), f.alias("folder")))

    rows = [claims(i, marker) for i, marker in enumerate(paths.SCOPES[scope])]
    every = F.flatten(F.array(*rows)) if rows else F.array().cast("array<struct<place:int,marker:string,folder:string>>")
    return files.select("repo", "path", F.explode(every).alias("c")).select("repo", "path", "c.place", "c.marker", "c.folder")


def corroborated(files: DataFrame, scope: str) -> DataFrame:
    """(repo, folder) of the folders named like test folders that hold a file with a test's name or a framework's.

    One pass over the files and one join: a folder's files are those that have it above them."""
    named = claimed(files, scope).where(F.col("marker").isin(*paths.TEST_MARKERS)).select("repo", "folder").distinct()
    evidence = files.where(paths.is_test_name(F.col("path")) | paths.names_framework(F.col("text"))).where(F.size(paths.parts(F.col("path"))) > 1)
    proven = evidence.select("repo", F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    return named.join(proven, ["repo", "folder"], "left_semi")


def scoped(files: DataFrame, scope: str = "production") -> DataFrame:
    """`files` with `reason`: why each is out of the scope, NULL for one in it.

    A test folder that nothing vouches for is measured, so that a rename can't take code out of the audit."""
    claims = claimed(files, scope)
    believed = corroborated(files, scope).withColumn("_seen", F.lit(True))
    kept = claims.join(believed, ["repo", "folder"], "left").where(~F.col("marker").isin(*paths.TEST_MARKERS) | F.col("_seen"))
    first = kept.groupBy("repo", "path").agg(F.min_by("marker", "place").alias("_marker"))
    joined = files.join(first, ["repo", "path"], "left").join(has_packages(files), "repo")
    reason = paths.bucket(F.col("path"), F.col("has_packages"), F.col("_marker"), F.col("root_is_package"))
    return joined.withColumn("reason", reason).drop("_marker", "has_packages", "root_is_package")


def source_files(scoped_files: DataFrame, extensions: list[str]) -> DataFrame:
    """The files in scope with one of the suffixes: what is measured."""
    return scoped_files.where(F.col("reason").isNull() & F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))


def text_files(files: DataFrame, extensions: list[str], scope: str) -> DataFrame:
    """The looser reader: suffixes in lower case, and only vendored and scope folders left out, vouched for or not."""
    low = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    def under(marker: str) -> Column:
        return F.exists(paths.parts(F.col("path")), lambda p: paths.matches(p, marker))

    out = F.lit(False)
    for marker in paths.SCOPES[scope]:
        out = out | under(marker)
    return files.where(low & ~paths.is_vendored(F.col("path")) & ~out)


def disclosure(scoped_files: DataFrame) -> DataFrame:
    """(repo, reason, files, listed): what was not measured; only judgement calls are listed by path."""
    show = F.when(F.col("reason").isin("docs", "tooling", "root-script"), F.col("path"))
    return scoped_files.where("reason IS NOT NULL").groupBy("repo", "reason").agg(F.count("*").alias("files"), F.sort_array(F.collect_list(show)).alias("listed"))


def corpus(files: DataFrame) -> DataFrame:
    """(repo, path, bucket, word, at): every name of the files of at most 1 MiB without a NUL in their first 8 KiB.

    The bucket is `source`, where `at` is the place of the name, or `docs` or `config`, where each word counts once."""
    read_ = files.where((F.octet_length("text") <= MOST_BYTES) & ~F.substring("text", 1, 8192).contains("\0") & ~paths.is_vendored(F.col("path")))
    low = F.lower("path")
    kind = F.when(low.rlike(SOURCE), "source").when(low.rlike(r"\.(" + "|".join(DOCS) + ")$"), "docs").otherwise("config")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    rows = read_.withColumn("bucket", kind)
    soft = rows.where("bucket <> 'source'").select("repo", "path", "bucket", F.explode(F.array_distinct(words)).alias("word")).withColumn("at", F.lit(None).cast("int"))
    hard = rows.where("bucket = 'source'").select("repo", "path", "bucket", F.posexplode(words).alias("at", "word")).select("repo", "path", "bucket", "word", "at")
    return hard.unionByName(soft)


def config_presence(files: DataFrame) -> DataFrame:
    """(repo, precommit, workflows, container): what a checkout has of hooks, workflow files and container files."""
    p = F.col("path")
    return files.groupBy("repo").agg(
        F.bool_or((p == ".pre-commit-config.yaml") | p.rlike(r"^\.husky(/|$)")).alias("precommit"),
        F.count_if(p.rlike(r"^\.github/workflows/[^/]+\.ya?ml$")).alias("workflows"),
        F.bool_or(p.isin("Dockerfile", "docker-compose.yml")).alias("container"),
    )


def package_entries(files: DataFrame) -> DataFrame:
    """(repo, path): the files that package manifests name as entries; manifests that don't parse name none."""
    manifest = files.where((paths.name_of(F.col("path")) == "package.json") & ~paths.is_vendored(F.col("path")))
    keys = ["main", "module", "browser", "types", "typings"]
    one = F.array(*(F.get_json_object("text", f"$.{k}") for k in keys))
    many = F.map_values(F.coalesce(F.from_json(F.get_json_object("text", "$.bin"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    found = manifest.select("repo", paths.folder_of(F.col("path")).alias("base"), F.explode(F.concat(one, many)).alias("entry")).where("entry IS NOT NULL AND NOT entry LIKE '{%'")
    clean = F.regexp_replace("entry", r"^(\./)+", "")
    return found.select("repo", F.when(F.col("base") == "", clean).otherwise(F.concat_ws("/", "base", clean)).alias("path")).distinct()
