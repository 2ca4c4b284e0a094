"""Mixing sources to target weights by weighted fair queueing (operator 7).

The documents of each source are shuffled, that is ordered by a hash of seed and doc_id.  A document's
virtual finish time is its source's tokens up to and including it, divided by the source's weight.  All
documents, range-sorted by that time, are taken while their cumulative tokens stay within the budget.

Both cumulative sums are distributed: rows are range-partitioned, every partition is summed, and each
partition adds what the ones before it hold.  No source or total order is in one task's hands, so a hot
source costs no more than the same rows in many.  Only narrow columns are sorted, not the texts.

Tokens are maximal runs of anything but space, tab, newline and carriage return.

Defined results: a source without a weight has `other`; a null source is one of its own, the source ''
another; a weight of 0 or less takes its documents out; a null or empty text has 0 tokens and takes none
of the budget, but has its place in the order; a text of any length is counted whole; a null doc_id counts
as -1 in the shuffle; equal times (ties) are ordered by source and then shuffle order, doc_id and tokens,
repeated rows after one another, of which as many are taken as fit; the order ends with the first document
that would exceed the budget, so the rows taken never do; an empty table gives an empty one; other columns,
whatever their names, are ignored by `mixed` and kept by `mixture`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import fresh, saved

SEED = "mix-1"
SHARE = 0.6
OTHER = 1.0


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def weight_of(source: Column, weights: Mapping[str | None, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, weight in sorted(weights.items(), key=lambda x: (x[0] is not None, x[0] or "")):
        out = F.when(source.eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(out)
    return out


def _running(by: str | None):
    """Adds the partition's own running sum of `tokens` per `by` as `_sum`, and rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, int] = {}
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            if by is None:
                total = np.cumsum(tokens) + sums.get(None, 0)
                if len(total):
                    sums[None] = int(total[-1])
            else:
                codes = batch.column(by).dictionary_encode()
                code = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
                names = [*codes.dictionary.to_pylist(), None]
                total = np.zeros(len(tokens), np.int64)
                for c in np.unique(code):
                    mine = code == c
                    total[mine] = np.cumsum(tokens[mine]) + sums.get(names[c], 0)
                    sums[names[c]] = int(total[mine][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "_sum"])

    return run


def _cumulated(rows: DataFrame, order: list[Column], by: str | None, what: str) -> DataFrame:
    """`rows`, written in global order, with `_sum`, the running sum of `tokens` over that order (within `by`)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType())])
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    done, _ = saved(sorted_.mapInArrow(_running(by), schema), what)
    group = ["_part"] if by is None else ["_part", by]
    ends = done.groupBy(*group).agg(F.max("_sum").alias("_own"))
    before = Window.orderBy("_part") if by is None else Window.partitionBy(by).orderBy("_part")
    ends = ends.withColumn("_before", F.sum("_own").over(before) - F.col("_own"))
    ends = ends.select(F.col("_part").alias("_p"), "_before", *([F.col(by).alias("_by")] if by else []))
    same = F.col("_part") == F.col("_p")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("_by"))
    return done.join(ends, same).withColumn("_sum", F.col("_sum") + F.col("_before")).drop("_p", "_by", "_before", "_part")


def _taken(docs: DataFrame, weights: Mapping[str | None, float] | None, share: float | None, budget: int | None, seed: str, other: float, key: str | None) -> DataFrame:
    """The rows taken, with `_key`, that of their row of `docs`; 0 where `key` is None."""
    source = F.col("source").cast("string")
    mark = F.lit(0).cast("long") if key is None else F.col(key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), token_count(F.col("text").cast("string")).alias("tokens"), mark.alias("_key"))
    rows = rows.withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string"))))
    rows = rows.withColumn("_weight", weight_of(F.col("source"), weights or {}, other)).where("_weight > 0")
    rows, _ = saved(rows, "mix-rows")
    if budget is None:
        total = rows.agg(F.sum("tokens")).first()[0] or 0
        budget = int(total * share)
    ends = [F.col("source"), F.col("shuffle"), F.col("doc_id"), F.col("tokens"), F.col("_key")]
    timed = _cumulated(rows, ends, "source", "mix-sources").withColumn("finish", F.col("_sum") / F.col("_weight")).drop("_sum")
    placed = _cumulated(timed, [F.col("finish"), *ends], None, "mix-order")
    return placed.where(F.col("_sum") <= budget).withColumnRenamed("_sum", "position")


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, share: float | None = SHARE, budget: int | None = None, seed: str = SEED, other: float = OTHER) -> DataFrame:
    """(doc_id, source, tokens, finish, position) of the documents taken; `position` is the cumulative tokens.

    `budget` is in tokens; where it is None it is `share` of all tokens of documents with a positive weight."""
    return _taken(docs, weights, share, budget, seed, other, None).select("doc_id", "source", "tokens", "finish", "position")


def mixture(docs: DataFrame, weights: Mapping[str | None, float] | None = None, share: float | None = SHARE, budget: int | None = None, seed: str = SEED, other: float = OTHER) -> DataFrame:
    """The rows that `mixed` takes, with all columns of `docs`, range-sorted by finish time.

    Rows are known by a key of their own, written with them, so that of rows that repeat a doc_id only those taken come."""
    key, finish, position = (fresh(n, docs) for n in ("_row", "_finish", "_position"))
    rows, _ = saved(docs.withColumn(key, F.monotonically_increasing_id()), "mix-documents")
    order = _taken(rows, weights, share, budget, seed, other, key).select("_key", "finish", "position").toDF(key, finish, position)
    kept = rows.join(order, key)
    return kept.repartitionByRange(finish, position).sortWithinPartitions(finish, position).drop(key, finish, position)


def sql(weights: Mapping[str | None, float] | None = None, share: float = SHARE, seed: str = SEED, other: float = OTHER, table: str = "documents") -> str:
    """DuckDB SQL for `mixed` with a budget by share."""
    cases = " ".join(f"WHEN source IS NOT DISTINCT FROM {'NULL' if n is None else chr(39) + n.replace(chr(39), chr(39) * 2) + chr(39)} THEN {float(w)!r}" for n, w in (weights or {}).items())
    weight = f"CASE {cases} ELSE {float(other)!r} END" if cases else repr(float(other))
    return f"""
WITH counted AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS tokens,
         md5('{seed}:' || CAST(coalesce(doc_id, -1) AS VARCHAR)) AS shuffle, CAST({weight} AS DOUBLE) AS weight FROM {table}),
taken AS (SELECT * FROM counted WHERE weight > 0),
timed AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY shuffle, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) / weight AS finish FROM taken),
placed AS (
  SELECT *, CAST(sum(tokens) OVER (ORDER BY finish, source NULLS FIRST, shuffle, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM timed)
SELECT doc_id, source, tokens, finish, position FROM placed
WHERE position <= (SELECT CAST(floor(sum(tokens) * {share!r}::DOUBLE) AS BIGINT) FROM taken)"""
