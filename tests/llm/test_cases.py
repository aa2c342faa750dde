"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fleetcast.llm import decontaminate, exact, html, jaccard, langid, mixing, pii, sharding, suffixes, toxicity

PROSE = "the quick brown fox jumps over the lazy dog while seven other animals watch from the far side of a river"
SCHEMA = "doc_id long, text string, lang string, source string, id long, th string, n int, score string, shard string, size string"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE.upper(), "en", "a"), (2, PROSE.upper(), "en", "a"), (3, "", None, "b"), (4, None, None, None), (None, PROSE, "en", None),
    (5, "   \t\n", None, "b"), (6, "x", "en", "b"), (7, LONG, None, "a"), (8, "123 456", None, "b"), (9, "un petit texte en langue française, avec des mots", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "t", 1, "s", "q", "z") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    got = {(r.doc_id, r.text_sha256): r for r in exact.dedup(docs).collect()}
    rows = exact.dedup(docs).collect()
    assert len(rows) == len(ROWS)
    prose = [r for r in rows if r.text_sha256 == hashlib.sha256(PROSE.encode()).hexdigest()]
    assert len(prose) == 4 and {r.keep_id for r in prose} == {2} and {r.group_size for r in prose} == {4} and sum(r.kept for r in prose) == 1
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in empty} == {3, 4} and [r.doc_id for r in empty if r.kept] == [4]
    assert got[7, hashlib.sha256(LONG.encode()).hexdigest()].group_size == 1
    assert exact.dedup(none).count() == 0


@pytest.mark.parametrize("size", [3, 7, 64])
def test_exact_names_of_many_blocks(spark, size):
    texts = ["a" * 20, "a" * 21, "a" * 20, "ab" * 10, "b" + "a" * 19, "a" * 19 + "b", "", "a" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.dedup(docs, size=size).collect()}
    assert got == {i: (max(j for j, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)}


def test_jaccard(docs, none):
    rows = jaccard.join(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == 1 and by[2].component_id == 1 and by[None].component_id == 1
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].component_id == 3
    assert by[6].n_shingles == 1 and by[7].component_id == 7
    assert jaccard.join(none).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9"])
    assert jaccard.representatives(none).count() == 0


def test_suffixes(docs, none):
    got = suffixes.dedup(docs, keep_text=True).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_removed == 0 and by[2].n_removed == 0 and bytes(by[1].kept) == PROSE.encode()
    assert by[4].n_bytes == 0 and by[3].kept_sha256 == by[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert suffixes.dedup(none).count() == 0


def test_langid(docs, none):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[8].lang_pred == "und" and got[8].score == 0
    assert got[1].lang_pred == "en" and got[9].lang_pred == "fr" and 0 <= got[7].score <= 1
    assert langid.identify(none, model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none), ["doc_id"]).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, None), (2, 1, None), (2, 0, None), (6, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, toxic int, text int")
    net = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, net, docs.columns[:4]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.classify(none, net, ["doc_id"]).count() == 0
    untaught = toxicity.fit(none, labels.limit(0))
    assert {r.predicted for r in toxicity.classify(docs, untaught, ["doc_id"]).collect()} == {0}


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (5, PROSE, "y")], "item_id long, text string, id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(i, j) for i in (1, 2, None) for j in (1, 5)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS) and decontaminate.contaminated(none, items).count() == 0


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.find(docs, ["doc_id", "n", "score"]).collect()}
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].n_email == 0
    assert pii.find(none, ["doc_id"]).count() == 0


def test_html(spark):
    page = "<nav><a href=/>Menu</a></nav><article><h1>Title</h1><p>One  &amp;\n two<p>three</article><div class='comments'>No</div>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, "<p>" + "many words here " * 20_000), (5, "<script>var x = '<p>'"), (None, "plain words")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in html.extract(pages, html.learn(pages), ["page_id"]).collect()]
    assert got[0] == got[1] == (1, "Title\n\nOne & two\n\nthree") and got[2:4] == [(2, ""), (3, "")]
    assert got[4][1] == " ".join(["many words here"] * 20_000) and got[5:] == [(5, ""), (None, "plain words")]
    assert html.extract(pages.limit(0), html.learn(pages.limit(0)), ["page_id"]).count() == 0


def test_mixing(docs, none):
    table = mixing.rates(docs)
    assert {r.source for r in table.collect()} == {"a", "b", None}
    got = mixing.shuffled(mixing.replicate(docs, table, docs.columns)).collect()
    counts = {}
    for r in got:
        counts.setdefault((r.doc_id, r.text), []).append(r)
    assert all(len(v) == v[0].mix_copies * (2 if k[0] == 2 else 1) for k, v in counts.items())
    assert [r.mix_order for r in got] == sorted(r.mix_order for r in got)
    assert mixing.replicate(docs, mixing.rates(docs, {"a": 1.0}), ["source"]).filter("source IS NULL OR source <> 'a'").count() == 0
    assert mixing.shuffled(mixing.replicate(none, mixing.rates(none), ["doc_id"])).count() == 0


def test_sharding(spark, docs, none, tmp_path):
    for table, name in ((docs, "a"), (none, "b")):
        rows = table.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), sharding.slot_of([F.col("doc_id"), F.col("text")]).alias("vslot"))
        sizes = sharding.slot_sizes(rows)
        placed = sharding.assign(rows, sharding.balanced(sizes, 3, str(tmp_path / name)), sizes, [F.col("doc_id")]).collect()
        assert len(placed) == table.count()
        for s in range(3):
            mine = sorted(r.slot for r in placed if r.shard == s)
            assert mine == list(range(len(mine)))
