"""The training-data pipeline over `documents`: stages that each take and return the table, and a run of all of them.

Every stage takes any table with doc_id, text and source: other columns are kept whatever their names, an empty
table gives an empty one, a text of any length counts whole, and nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, linededup, minhash, mixing, toxicity
from marlstone.llm.common import scratch_path
from marlstone.llm.queries import WEIGHTS


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected as toxic go.

    Null and empty texts stay; so do scores equal to the threshold (ties); rows that repeat share their fate; a null
    doc_id is judged like any other; without labels of both kinds nothing goes."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents have go but for one occurrence in the corpus; those that a document repeats but for the first in it.

    Null and empty texts stay as they are; rows that repeat are documents each; of rows of one least doc_id (ties) any
    keeps the line, a null doc_id being the greatest."""
    return linededup.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id.

    Rows without doc_id, and null, empty or wordless texts, stay; rows that repeat a doc_id are one document and stay or
    go together; a tie at the threshold is a near duplicate."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the sources' weighted mixture, up to its budget.

    A null source is one of its own; null and empty texts have no tokens but a place in the order; ties are ordered by
    source, hash, doc_id and tokens; of rows that repeat as many are taken as fit the budget."""
    return mixing.mixture(docs, weights=WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its tokens, in columns `n_tokens` and `tokens` (with underscores before where it has such).

    A null text has null tokens and counts 0, an empty one has none; rows that repeat are encoded each; there are no ties."""
    return bpe.tokenized(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing", mix),
    ("byte-level bpe", encode),
]
#: Training a compression dictionary is not SQL; the tests hold the run against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's result written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
