"""Stages and operators on tables whose further columns have the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetcast.llm import exact, html, jaccard, langid, lm, mixing, pii, sharding, suffixes, toxicity

NAMES = ("score predicted lang_guess shard slot virtual_slot vslot size rank first mix_copy mix_copies mix_rate mix_source mix_key mix_order row th id key y "
         "entry cls label n sketch component item words spans text_sha256 kept bucket held lang_pred rejected n_email base_sha256 n_tokens base_score n_chars_x").split()
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals watch from the far side of a river and wait for"
ROWS = [(i, f"{PROSE} number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", f"src{i % 3}", 100) for i in range(40)]
ROWS += [(40, None, None, None, None), (41, "", "en", "src0", 0), (None, PROSE, "en", "src1", 5), (42, ROWS[0][1], "en", "src0", 100), (42, ROWS[0][1], "en", "src0", 100)]
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *[F.lit(f"user {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module", params=["full", "empty"])
def folder(spark, request, tmp_path_factory):
    """Labels and benchmark, with rows or without."""
    where = str(tmp_path_factory.mktemp(request.param))
    some = request.param == "full"
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] if some else [], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a question that none of the texts above has and no one asks here at all")] if some else [], "item_id long, text string")
    labels.write.parquet(f"{where}/labels.parquet")
    items.write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_the_columns(spark, docs, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, folder)
    added = ["shard", "slot", "virtual_slot"] if name == "sharding" else []
    assert out.columns == [c for c in docs.columns if c not in added] + added
    rows = out.collect()
    assert rows and all(r[c] == f"user {c}" for r in rows for c in NAMES if c not in added)
    if name == "sharding":
        assert len(rows) == len(ROWS) and {type(r.slot) for r in rows} == {int}
    assert run(spark, docs.limit(0), folder).count() == 0


def test_operators_replace_columns_of_their_own(spark, docs):
    keep = [c for c in docs.columns if c != "text"]
    for out in (langid.identify(docs, langid.fit(docs), keep), pii.find(docs, keep), toxicity.classify(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic"))), keep),
                lm.score(docs, lm.fit(docs), keep), html.extract(docs.withColumn("html", F.col("text")), {}, keep)):
        assert len(set(out.columns)) == len(out.columns) and out.count() == len(ROWS)
    for out in (exact.dedup(docs), jaccard.join(docs), suffixes.dedup(docs)):
        assert out.count() == len(ROWS)
    placed = sharding.assign(docs.withColumn("vslot", F.lit(1)), sharding.even_map(spark, 2), spark.createDataFrame([(1, 10, len(ROWS))], "vslot int, bytes long, n long"), [F.col("doc_id")])
    assert sorted(r.slot for r in placed.collect()) == list(range(len(ROWS))) and placed.where("size <> 'user size'").count() == 0
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    assert mixing.shuffled(mixing.replicate(rows, mixing.rates(rows), ["row"])).select("row.*").columns == docs.columns
