"""What the corpus pipeline leaves on disk while it runs: no shuffled files of written tables, no tables that were read for the last time."""

import os
import random
import time

from fleetcast.llm import jaccard, toxicity
from fleetcast.session import materialize, owned_tables


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")}


def families(count, size):
    """Texts of which those of a family share most lines, some above and some below four fifths of their shingles."""
    rng, out = random.Random(5), []
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(200)]
    for f in range(count):
        own = rng.sample(lines, 14)
        out += [[*own, *rng.sample(lines, k % 5)] for k in range(size)]
    return list(enumerate("\n".join(x) for x in out))


def smallest_of_component(rows, words=5, percent=80):
    sets = {i: {tuple(t.split()[k:k + words]) for k in range(len(t.split()) - words + 1)} for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in sets}


def test_a_written_table_leaves_no_shuffled_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, had = shuffled(spark), spark.conf.get(setting, None)
    rows = spark.range(20_000).selectExpr("id % 5000 AS k", "id").groupBy("k").sum("id").repartition(7, "k")
    with owned_tables(spark):
        table = materialize(rows, "sums")
        until = time.time() + 20
        while (left := shuffled(spark) - before) and time.time() < until:
            time.sleep(0.2)
        assert not left
        assert table.count() == rows.count() == 5000
    assert spark.conf.get(setting, None) == had


def test_the_join_in_waves_and_groups_finds_every_link_and_deletes_its_tables(spark, monkeypatch):
    rows, labels = families(5, 12), []
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    for name, value in (("WAVE", 1), ("GROUP", 300), ("BLOCK", 4), ("ROUNDS", 0)):  # without rounds all pairs are compared at once
        monkeypatch.setattr(jaccard, name, value)
    with owned_tables(spark) as folder:
        got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()}
        left = {name.rpartition("-")[0] for name in os.listdir(folder.removeprefix("file:"))}
    assert got == smallest_of_component(rows) and 1 < len(set(got.values())) < len(rows)
    assert labels.count("wave") > 2
    assert "fingerprints" in left
    assert not left & {"shared-entries", "distinct-entries", "near-pairs", "need", "texts", "labelled", "open-entries", "links", "lower"}


def test_a_class_is_sent_to_groups_and_not_to_pairs(spark, monkeypatch):
    """All pairs of 40 near copies: each text once and not once for each of its 39 pairs."""
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{base} x{i} y{i}") for i in range(40)], "doc_id long, text string")
    rows = materialize(jaccard.fingerprints(docs, "doc_id", "text", 5, 0), "fingerprints")
    classes = rows.selectExpr("cls", "n", "sketch", "struct(id, th) AS first")
    pairs = classes.selectExpr("cls AS a").crossJoin(classes.selectExpr("cls AS b")).filter("a < b")
    groups, plain = [], jaccard.materialize

    def seen(df, label):
        out = plain(df, label)
        if label == "met-groups":
            groups.extend(out.collect())
        return out

    monkeypatch.setattr(jaccard, "materialize", seen)
    assert jaccard.verified(pairs, classes, docs, "doc_id", "text", 5, 80, False).count() == 40 * 39 // 2
    assert len({(g.p, g.q, c) for g in groups for c in (g.a, g.b)}) == 40


def test_training_deletes_the_texts_it_learned_from(spark):
    rows = [(i, f"word{i % 50} other{i % 7}" + " zzbad" * (i % 2), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    for one in (labels, labels.filter("toxic = 1")):
        with owned_tables(spark) as folder:
            toxicity.fit(docs, one)
            assert not [x for x in os.listdir(folder.removeprefix("file:")) if x.startswith("toxicity-labelled")]
