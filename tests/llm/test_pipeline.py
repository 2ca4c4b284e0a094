"""The pipeline stage by stage on the smallest tables, and the queries of the subpackage."""

import corpus_pipeline
from marlstone.llm import queries

from tests.llm.test_text_operators import groups_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{i}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    before, after = seen["minhash near-dedup"]
    gone = {d for d, first in groups_by_brute_force([(r.doc_id, r.text) for r in before]) if d != first}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - gone
    before, after = seen["line dedup"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    before, after = seen["mixing"]
    assert 0 < len(after) < len(before)
    assert all(r.n_tokens == len(r.tokens) for r in seen["byte-level bpe"][1])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in after)


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
