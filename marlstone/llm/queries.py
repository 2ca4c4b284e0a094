"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, fingerprints, lattice, linededup, lm, minhash, mixing, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents.  Null, empty and wordless texts and null ids are in none; ties link; see minhash."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rejected as toxic, with scores.  Null and empty texts never are, nor ties; repeated rows are judged alike; see toxicity."""
    return toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's loss on every document.  Null and empty texts have 0 tokens and a null mean; repeated rows are scored each; see lm."""
    return lm.scores(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to it.  A null text has null tokens, an empty one none; see bpe."""
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files and read back.  Nulls, empty and long fields and repeated rows come back as they were; see warc."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated lines.  Null and empty texts stay as they are, repeated rows are documents each; see linededup."""
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the weighted mixture of all sources.  Null sources are one of their own, ties are ordered; see mixing."""
    return mixing.mixed(_table(spark, sf_dir, "documents"), WEIGHTS)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that documents share.  Null, empty and short texts and null ids have none; see substrings."""
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors.  Null, empty, zero and non-finite vectors and null ids are in none; ties link; see lattice."""
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch of every document.  Null and empty texts have an empty one, repeated rows are sketched each; see fingerprints."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


WEIGHTS = {"src0": 4.0, "src1": 2.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_document_fingerprints": op10_document_fingerprints,
}

SQL: dict[str, str] = {
    "op5_warc": warc.sql(),
    "op6_line_dedup": linededup.sql(),
    "op7_mixing": mixing.sql(WEIGHTS),
}
