"""The pipeline's stages one after another, and its entry."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.cases import SCHEMA, corpus

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_keep_the_columns_and_lose_what_they_should(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, docs, DATA).schema)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before
        before = after
    assert {1, 2, 3} & before == set()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.where("not exact").count() == 0 and out.count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert 0.7 * n < out.count() < n


def test_entry_registers_all(spark):
    names = set(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op4_imatch_fingerprints", "op5_lm_scoring", "op7_suffix_array_dedup", "op9_substring_dedup", "op10_minhash_near_dedup", "op12_ranked_lexical_search", "op13_centroid_clustering"])
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(r[x] for x in cols) for r in df.collect())
    out = c.sql(__spark_entry__.oracle_sql()[name])
    want = sorted(tuple(dict(zip(out.columns, r, strict=True))[x] for x in cols) for r in out.fetchall())
    assert got == want
