"""Toxicity learns from every labelled row and whole text: weights, counts, thresholds and languages."""

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetcast.llm import langid, toxicity


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]


def test_texts_of_any_length_are_learned(spark, words):
    rng = random.Random(5)
    rows = [(i, " ".join(["zzbad" if i % 4 == 0 else rng.choice(words)] + [rng.choice(words) for _ in range(30_000 if i % 4 == 0 else 20)])) for i in range(120)]
    assert all(len(t) > 200_000 for i, t in rows if i % 4 == 0)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.classify(docs, toxicity.fit(docs, labels, lang_col=None), ["doc_id"]).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.9


def test_every_label_is_counted(spark, words):
    rng = random.Random(6)
    rows = [(i, f"{rng.choice(words)} {rng.choice(words)} own{i}", int(rng.random() < 0.6)) for i in range(9000)]  # more than 8,000, and than 3,000 of a label
    frame = spark.createDataFrame([*rows, *rows[:50], (9001, None, 1), (None, "x", 1), (9002, "y", None)], "doc_id long, text string, toxic int")
    sample = toxicity.labelled(frame, frame, "doc_id", "text", "toxic")
    assert sample.count() == len(rows) and sample.filter("y = 1").count() == sum(y for *_, y in rows)
    assert 2000 < sample.filter("held").count() < 2500
    got = toxicity.weighed(sample)
    for y in (0, 1):
        mine = toxicity.words(pa.array([t for _, t, label in rows if label == y]))
        expected = np.zeros(toxicity.BUCKETS + 1, int)
        for a, b in zip(mine.at, mine.at[1:]):
            expected[np.unique(mine.features[mine.ids[a:b]])] += 1
        assert (got[y] == expected).all()


def test_a_round_averages_all_copies(spark, words):
    rng = random.Random(7)
    rows = [(" ".join([rng.choice(words) for _ in range(10)] + ["zzbad"] * (i % 2)), i % 2) for i in range(600)]
    sample = spark.createDataFrame(rows, "text string, y int").repartition(3)
    net = toxicity.begun()
    for _ in range(8):
        net = toxicity.averaged(sample, net, 0.5)
    p = toxicity.settled(net).raw(pa.array([t for t, _ in rows]))
    assert np.mean((p >= 0.5) == [y == 1 for _, y in rows]) > 0.95
    alone, copied = pickle.loads(pickle.dumps(toxicity.begun())), toxicity.begun()  # as it travels to a task
    adam = toxicity.Adam(0.01)
    for g in toxicity.groups_of([pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "y": pa.array([y for _, y in rows], pa.int32())})]):
        toxicity.step(alone, g, adam, 0.5)
    copied = toxicity.averaged(spark.createDataFrame(rows, "text string, y int").coalesce(1), copied, 0.5)
    assert np.abs(alone.embedding - copied.embedding).max() < 1e-3 and all(np.abs(a - b).max() < 1e-3 for a, b in zip(alone.dense(), copied.dense()))


def test_thresholds_count_every_row(spark):
    n = 12_000
    judged = spark.range(n).select(  # English is cut at 0.3, French at 0.7
        (F.col("id") / n).alias("p"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"),
        (F.col("id") / n >= F.when(F.col("id") % 2 == 0, 0.3).otherwise(0.7)).cast("int").alias("y"))
    got = toxicity.calibrated(judged)
    assert set(got) == {"", "en", "fr"} and abs(got["en"] - 0.3) < 2e-4 and abs(got["fr"] - 0.7) < 2e-4
    assert toxicity.calibrated(judged.limit(0)) == {}


def test_languages_of_all_rows(spark):
    rng = random.Random(8)
    kinds = {"xx": "abcd", "yy": "efgh", "zz": "ijkl"}
    rows = [(i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(5)) for _ in range(8)), lang) for i in range(600) for lang in kinds]
    docs = spark.createDataFrame([*rows, (7, None, "xx"), (8, "12", "yy"), (9, "abcd", None)], "doc_id long, text string, lang string")
    start = langid.fit(docs.filter("lang != 'zz'"), per_language=50)
    model = langid.refined(start, docs)
    tf = langid.counts(pa.array([t for _, t, _ in rows]))
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (0.5 + (tf > 0).sum(0))), atol=1e-5)
    assert model.languages == ["xx", "yy", "zz"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    assert model.predict(pa.array([t for _, t, _ in rows]))[0] == [lang for *_, lang in rows]
    x = langid.vectors(tf, model.idf)[[lang == "zz" for *_, lang in rows]].sum(0)
    assert np.allclose(model.centroids[-1], x / np.linalg.norm(x), atol=1e-4)
