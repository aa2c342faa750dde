"""What the corpus pipeline keeps in the driver: one network at a time, and no rounds of the join that cannot find anything."""

import os
import random

import pytest
from pyspark import SparkContext

from fleetcast.llm import graph, jaccard, toxicity

LARGE = 1_000_000  # bytes; a network before training is larger


@pytest.fixture
def sent(monkeypatch):
    """Files of all that is broadcast from Python."""
    files, plain = [], SparkContext.broadcast

    def recorded(self, value):
        out = plain(self, value)
        files.append((out._path, os.path.getsize(out._path)))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", recorded)
    return files


def test_a_round_takes_its_network_back(spark, sent):
    rows = [(f"word{i % 50} other{i % 7}" + " zzbad" * (i % 2), i % 2) for i in range(200)]
    sample, net = spark.createDataFrame(rows, "text string, y int").coalesce(1), toxicity.begun()
    for _ in range(3):
        net = toxicity.averaged(sample, net, 0.5)
    large = [path for path, size in sent if size > LARGE]
    assert len(large) == 3 and not any(os.path.exists(path) for path in large)


def test_the_join_stops_where_no_link_is_new(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    near = [f"{t} end{j}" for t in texts[:10] for j in range(3)]
    rows = list(enumerate(texts + near))
    calls, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda links: calls.append(1) or plain(links))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 40 else (i - 40) // 3 for i, _ in rows}
    assert len(calls) < jaccard.ROUNDS + 2
