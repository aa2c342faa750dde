"""Registered queries: SQL where there is some, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from fleetcast.llm.queries import ORACLES, QUERIES

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_document(spark, folder, name):
    n = QUERIES[name](spark, folder).count()
    if name not in ("op4_template_leaks", "op7_poisson_mix"):
        conversations = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id").distinct().count()
        assert n == {"op6_stretch_text": 50, "op11_auction_repair": conversations}.get(name, 200)
    assert n > 0


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, nothing = stage(spark, docs, folder), stage(spark, empty, folder)
        assert out.columns[:5] == DOCS and nothing.count() == 0
        assert (len(out.columns) == 5) == (k < 4)
    shards = {r.shard for r in out.collect()}
    assert shards == set(range(24))


def test_stage_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    similar = {r.doc_id for r in corpus_pipeline.drop_similar(spark, docs, folder).collect()}
    groups = QUERIES["op2_partition_jaccard"](spark, folder).collect()
    assert {r.component_id for r in groups} >= similar and len(similar) < 200
    leaks = {r.doc_id for r in QUERIES["op4_template_leaks"](spark, folder).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, folder).collect()} == {r.doc_id for r in docs.collect()} - leaks
