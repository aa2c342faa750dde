"""Toxicity by a convolutional text classifier, trained by numpy in Spark's tasks on every labelled text.

Words become hashed embeddings: the mean over the whole word and its leading parts, so that inflected forms share
weights. Filters of several widths run over the words, each filter keeps its maximum over the whole text, and a linear
layer turns the maxima into a probability. Since only the place of the maximum passes gradient back, training costs
little more than scoring. In each round every task trains a copy of the network on its texts, and Spark averages what the
copies changed. Thresholds are calibrated per language, where the language is found from the text itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from fleetcast.llm import langid
from fleetcast.llm.texts import LETTER, SENT_ROWS, SpanHash, buffers, mixed, pieces, runs
from fleetcast.session import discard, materialize

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8, 10)  # bytes
BATCH = 64  # texts of a training step
SHARD_ROWS = 8192  # labelled texts in a file, about; a task, which reads one or several, trains a copy of the network
STEPS = 350  # steps a copy takes in all rounds together, within the bounds of ROUNDS
ROUNDS = (3, 10)
GRID = 10_000  # cells of probability in which the texts that set thresholds are counted
NEUTRAL = 0.1  # embeddings that training left smaller than this are 0; only the others travel to the tasks


@dataclass
class Words:
    """Words of several texts: the text's bounds in ``at``, each word as an index into the rows of ``features``."""

    at: np.ndarray  # bounds by text
    ids: np.ndarray
    features: np.ndarray  # distinct words x (whole word and prefixes); BUCKETS where a word is too short


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = runs(LETTER[data], offsets)
    hashes = SpanHash(data)
    whole = hashes.of(starts, ends)
    distinct, first, ids = np.unique(whole, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    features = np.full((len(distinct), 1 + len(PREFIXES)), BUCKETS, np.int32)
    features[:, 0] = distinct % np.uint64(BUCKETS)
    for j, n in enumerate(PREFIXES, 1):
        long = e - s > n
        features[long, j] = mixed(hashes.of(s[long], s[long] + n) + np.uint64(n)) % np.uint64(BUCKETS)
    return Words(np.searchsorted(starts, offsets), ids.reshape(-1), features)


@dataclass
class Network:
    embedding: np.ndarray  # BUCKETS + 1 rows; the last is zero
    filters: list[np.ndarray]  # by width: width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: langid.CentroidModel | None = None

    def __getstate__(self) -> dict:
        rows = np.flatnonzero(self.embedding.any(1))
        return self.__dict__ | {"embedding": (rows.astype(np.int32), self.embedding[rows].astype(np.float16), self.embedding.shape)}

    def __setstate__(self, state: dict) -> None:
        rows, values, shape = state["embedding"]
        self.__dict__.update(state)
        self.embedding = np.zeros(shape, np.float32)
        self.embedding[rows] = values

    def word_vectors(self, features: np.ndarray) -> np.ndarray:
        total = self.embedding[features[:, 0]]
        for j in range(1, features.shape[1]):
            total += self.embedding[features[:, j]]
        return total / (features < BUCKETS).sum(1)[:, None].astype(np.float32)

    def maxima(self, w: Words, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Filter maxima (after a ramp) of each text and the places where they were found."""
        n = len(w.at) - 1
        found, places = [], []
        for weights, bias in zip(self.filters, self.bias):
            width, _, k = weights.shape
            top, place = np.zeros((n, k), np.float32), np.full((n, k), -1)
            parts = [vectors @ weights[j] for j in range(width)]
            count = len(w.ids) - width + 1
            if count > 0:
                value = parts[0][w.ids[:count]]
                for j in range(1, width):
                    value += parts[j][w.ids[j:count + j]]
                for i in range(n):
                    a, b = w.at[i], min(w.at[i + 1] - width + 1, count)
                    if b > a:
                        best = value[a:b].argmax(0)
                        v = value[a + best, np.arange(k)] + bias
                        place[i] = np.where(v > 0, a + best, -1)
                        top[i] = np.maximum(v, 0)
            found.append(top)
            places.append(place)
        return np.concatenate(found, 1), places

    def dense(self) -> list[np.ndarray]:
        """All weights but the embeddings."""
        return [*self.filters, *self.bias, self.out]

    def raw(self, texts: pa.Array) -> np.ndarray:
        w = words(texts)
        top, _ = self.maxima(w, self.word_vectors(w.features))
        return 1 / (1 + np.exp(-(top @ self.out + self.out_bias).astype(float)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Probability after calibration: the threshold of the text's language is moved to 0.5."""
        p = self.raw(texts)
        langs = self.languages.predict(texts)[0] if self.languages else [""] * len(p)
        t = np.array([self.thresholds.get(x, self.thresholds.get("", 0.5)) for x in langs])
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)), langs


@dataclass
class Group:
    """A batch of the sample as it is learned: words, and labels of 0 and 1."""

    words: Words
    labels: np.ndarray


def seen(groups: Iterable[Group]) -> np.ndarray:
    """Texts that have a feature, by class and bucket."""
    out, stamp = np.zeros((2, BUCKETS + 1), np.int64), np.zeros(BUCKETS + 1, np.int64)
    for g in groups:
        part = g.words
        for i, y in enumerate(g.labels):
            found = part.features[part.ids[part.at[i]:part.at[i + 1]]].ravel()
            stamp[found] = np.arange(len(found))
            out[int(y), found[stamp[found] == np.arange(len(found))]] += 1
    return out


def evidence(counted: np.ndarray, held: np.ndarray, floor: float = 0.01) -> np.ndarray:
    """Log ratio of a feature's share of toxic texts to its share of the others, by bucket; near 0 where it is rare."""
    share = (counted / np.maximum(np.asarray(held, float), 1)[:, None]).astype(np.float32)
    out = np.log((share[1] + floor) / (share[0] + floor))
    out[BUCKETS] = 0
    return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        if name not in self.state:
            self.state[name] = np.zeros_like(value), np.zeros_like(value)
        m, v = self.state[name]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        value[rows] -= self.rate * (m[rows] / (1 - 0.9**self.t)) / (np.sqrt(v[rows] / (1 - 0.99**self.t)) + 1e-7)


def begun(dim: int = 12, count: int = 12, widths: tuple[int, ...] = (1, 2, 3), seed: int = 3) -> Network:
    """Network before training: embeddings near zero, so unseen words stay neutral."""
    rng = np.random.default_rng(seed)
    embedding = rng.standard_normal((BUCKETS + 1, dim), np.float32)
    embedding *= 0.02
    embedding[BUCKETS] = 0
    return Network(
        embedding, [rng.normal(0, 0.3, (w, dim, count)).astype(np.float32) for w in widths], [np.zeros(count, np.float32) for _ in widths],
        rng.normal(0, 0.3, count * len(widths)).astype(np.float32), 0.0)


def step(net: Network, g: Group, adam: Adam, share: float) -> np.ndarray:
    """One step of training; the embeddings that it changed. ``share`` of the texts are toxic, and classes are weighed alike."""
    w, y = g.words, g.labels
    dim, count = net.embedding.shape[1], net.filters[0].shape[2]
    adam.t += 1
    vectors = net.word_vectors(w.features)
    top, places = net.maxima(w, vectors)
    p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias)))
    err = ((p - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)).astype(np.float32)
    d_top = err[:, None] * net.out[None, :]
    touched, grads, filters = [], [], []
    for j, (weights, place) in enumerate(zip(net.filters, places)):
        doc, f = np.nonzero(place >= 0)
        d = np.where(place >= 0, d_top[:, j * count:(j + 1) * count], 0)
        g_weights = np.zeros_like(weights)
        for o in range(len(weights) if len(w.ids) else 0):
            at = np.minimum(np.maximum(place, 0) + o, len(w.ids) - 1)  # d is 0 where there is no place
            g_weights[o] = np.einsum("nk,nkd->dk", d, vectors[w.ids[at]])
            touched.append(w.ids[place[doc, f] + o])
            grads.append(d[doc, f][:, None] * weights[o].T[f])
        filters.append((g_weights, d.sum(0)))
    ids, inverse = np.unique(np.concatenate(touched) if touched else np.zeros(0, int), return_inverse=True)
    dv = totals(inverse, np.concatenate(grads), len(ids)) if touched else np.zeros((0, dim))
    feats = w.features[ids]
    used = feats < BUCKETS
    rows, inverse = np.unique(feats[used], return_inverse=True)
    g_rows = totals(inverse, np.repeat(dv / np.maximum(used.sum(1), 1)[:, None], used.sum(1), axis=0), len(rows)).astype(np.float32)
    g_out = top.T @ err
    for j, (g_weights, g_bias) in enumerate(filters):
        adam.step(f"filter{j}", net.filters[j], g_weights)
        adam.step(f"bias{j}", net.bias[j], g_bias)
    adam.step("out", net.out, g_out.astype(np.float32))
    out_bias = np.array([net.out_bias], np.float32)
    adam.step("out_bias", out_bias, np.array([err.sum()], np.float32))
    net.out_bias = float(out_bias[0])
    if len(rows):
        adam.step("embedding", net.embedding, g_rows, rows)
    return rows


def totals(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group."""
    return np.stack([np.bincount(group.reshape(-1), values[:, j], minlength=n) for j in range(values.shape[1])], 1)


def settled(net: Network) -> Network:
    """The network after training: words of little weight become neutral."""
    net.embedding[np.abs(net.embedding).max(1) < NEUTRAL] = 0
    return net


def learn(groups: list[Group], epochs: int = 10, rate: float = 0.01, seed: int = 3, **shape) -> Network:
    """Minimise the logistic loss by Adam over shuffled batches at hand, the class evidence in the first dimension of the embeddings.

    Without groups the network is left as it starts.
    """
    rng = np.random.default_rng(seed)
    net = begun(seed=seed, **shape)
    labels = np.concatenate([g.labels for g in groups]) if groups else np.zeros(1, np.float32)
    if groups and epochs:
        net.embedding[:, 0] += evidence(seen(groups), np.array([(labels == 0).sum(), (labels > 0).sum()]))
    adam = Adam(rate)
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            step(net, groups[g], adam, float(np.clip(labels.mean(), 0.02, 0.98)))
    return settled(net)


def best_threshold(p: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Middle of the widest gap with the fewest weighed errors between neighbouring probabilities, which ascend.

    ``toxic`` and ``clean`` count the texts of each probability.
    """
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(toxic.sum(), 1)
    false = (clean.sum() - np.concatenate([[0], np.cumsum(clean)])) / max(clean.sum(), 1)
    edges = np.concatenate([[0.0], p, [1.0]])
    cost = missed + 2 * false
    gaps = np.where(cost <= cost.min() + 1e-9, edges[1:] - edges[:-1], -1)
    k = gaps.argmax()
    return float(np.clip((edges[k] + edges[k + 1]) / 2, 0.01, 0.99))


def train(texts: pa.Array, labels: np.ndarray, seed: int = 3, **options) -> Network:
    """Network of texts at hand, in shuffled batches."""
    order = np.random.default_rng(seed).permutation(len(labels))
    at = [np.sort(order[i:i + BATCH]) for i in range(0, len(order), BATCH)]
    return learn([Group(words(texts.take(pa.array(g))), labels[g]) for g in at], seed=seed, **options)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Batches of training from rows ``text, y``."""
    for batch in batches:
        for part in pieces(batch, "text", rows=BATCH):
            yield Group(words(part.column(0)), part.column(1).to_numpy().astype(np.float32))


def weighed(sample: DataFrame) -> np.ndarray:
    """``seen`` of all sample rows: each task counts its texts, Spark adds the counts up by bucket."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = seen(groups_of(batches))
        at = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[0, at]), pa.array(found[1, at])], ["bucket", "clean", "toxic"])

    added = sample.select("text", "y").mapInArrow(scan, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    out[:, added.column(0).to_numpy()] = [added.column(1).to_numpy(), added.column(2).to_numpy()]
    return out


def averaged(sample: DataFrame, net: Network, share: float, rate: float = 0.01) -> Network:
    """The network after a round: every task trains a copy of it on all its texts, and Spark averages what the copies changed.

    A change weighs as many steps as made it, so that an embedding keeps what the tasks that have its words learned.
    Only changes reach the driver, one row an embedding. The network is sent to the tasks for one round and then taken back, so that the
    driver holds one copy of it, however many rounds there are.
    """
    sent = sample.sparkSession.sparkContext.broadcast(net.__getstate__())
    dim = net.embedding.shape[1]
    names = [f"d{i}" for i in range(dim)]

    def changes(copy: Network, start: Network, steps: np.ndarray, done: int) -> pa.RecordBatch:
        rows = np.flatnonzero(steps)
        flat = np.concatenate([(a - b).ravel() for a, b in zip(copy.dense(), start.dense())] + [[copy.out_bias - start.out_bias]])
        flat = np.pad(flat, (0, -len(flat) % dim)).reshape(-1, dim)
        change = np.concatenate([copy.embedding[rows] - start.embedding[rows], flat]).astype(float)
        at = np.concatenate([rows, BUCKETS + 1 + np.arange(len(flat))]).astype(np.int32)
        weight = np.concatenate([steps[rows], np.full(len(flat), done)]).astype(float)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight), *[pa.array(c) for c in (change * weight[:, None]).T]], ["row", "weight", *names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = Network.__new__(Network)
        start.__setstate__(sent.value)
        copy, adam, steps = deepcopy(start), Adam(rate), np.zeros(BUCKETS + 1, np.int64)
        for g in groups_of(batches):
            steps[step(copy, g, adam, share)] += 1
        if adam.t:
            yield changes(copy, start, steps, adam.t)

    schema = "row int, weight double, " + ", ".join(f"{c} double" for c in names)
    mean = [(F.sum(c) / F.sum("weight")).cast("float").alias(c) for c in names]
    try:
        got = sample.select("text", "y").mapInArrow(scan, schema).groupBy("row").agg(*mean).toArrow()
    finally:
        sent.destroy()
    at, by_dim = got.column(0).to_numpy(), [got.column(c).to_numpy() for c in names]
    inner = np.flatnonzero(at <= BUCKETS)
    for j, change in enumerate(by_dim):
        net.embedding[at[inner], j] += change[inner]
    last = np.flatnonzero(at > BUCKETS)
    last = last[at[last].argsort()]
    flat = np.stack([change[last] for change in by_dim], 1).ravel()
    for weights in net.dense():
        weights += flat[:weights.size].reshape(weights.shape)
        flat = flat[weights.size:]
    net.out_bias += float(flat[0])
    return net


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, y, held`` of every labelled text, where ``held`` marks the quarter that sets the thresholds; in order of a hash, in files of ``SHARD_ROWS``."""
    known = labels.groupBy(F.col(id_col).alias("key")).agg((F.max(label_col) > 0).cast("int").alias("y")).filter("key IS NOT NULL AND y IS NOT NULL")
    n = known.count()
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(known) if n <= SENT_ROWS else known, "key").repartition(max(1, -(-n // SHARD_ROWS)), "key", "text")
    rows = rows.groupBy("key", "text").agg(F.max("y").alias("y")).sortWithinPartitions(F.xxhash64("key", "text"), "key")
    held = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(4)) == 0
    return materialize(rows.select("text", "y", held.alias("held")), "toxicity-labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang") -> Network:
    """Network from ``labels`` (id, 0/1), with thresholds per language if ``lang_col`` names a column to learn languages from.

    Every labelled row is used, with its whole text; the caller leaves out rows that must not be learned. Three quarters, by a hash of the
    id, train the network in the tasks, and the other quarter sets the thresholds, counted by probability in ``GRID`` cells.
    Weights, counts by bucket and counts by cell reach the driver, whose sizes do not grow with the rows. Labels repeated for an id count
    once, as their maximum; NULL labels, ids and texts are left out, a row that repeats an id and a text counts once. If only one class is
    there, every text gets that class.
    """
    sample = labelled(docs, labels, id_col, text_col, label_col)
    n = {(r.held, r.y): r["count"] for r in sample.groupBy("held", "y").count().collect()}
    classes = {y for _, y in n}
    if len(classes) < 2:
        discard(sample)
        net = settled(begun())
        net.out[:], net.out_bias = 0, (4.0 if classes == {1} else -4.0)
        return net
    net, taught = begun(), np.array([n.get((False, 0), 0), n.get((False, 1), 0)])
    if taught.sum():
        mine = sample.filter("NOT held")
        net.embedding[:, 0] += evidence(weighed(mine), taught)
        copies = np.ceil(sum(n.values()) / SHARD_ROWS)
        rounds = int(np.clip(np.ceil(STEPS * BATCH * copies / taught.sum()), *ROUNDS))
        for r in range(rounds):  # a copy's first steps are the largest, so later rounds take smaller ones
            net = averaged(mine, net, float(np.clip(taught[1] / taught.sum(), 0.02, 0.98)), 0.01 / (1 + r))
    net = settled(net)
    if lang_col:
        named = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        net.languages = langid.refined(langid.fit(named, "text", "lang", "key"), named, "text", "lang")
    net.thresholds = calibrated(_judged(sample.filter("held").select("text", "y"), net))
    discard(sample)
    return net


def calibrated(judged: DataFrame) -> dict[str, float]:
    """Thresholds from all rows ``p, y, lang``: for "" of all languages, and for each with 8 texts of both classes.

    Rows are counted by language and cell of probability, and the counts reach the driver.
    """
    cells = judged.groupBy("lang", F.round(F.col("p") * GRID).cast("int").alias("cell")).agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    found = cells.orderBy("lang", "cell").toPandas()
    if not len(found):
        return {}

    def best(rows: pd.DataFrame) -> float:
        added = rows.groupby("cell")[["toxic", "clean"]].sum()
        return best_threshold(added.index.to_numpy() / GRID, added.toxic.to_numpy(float), added.clean.to_numpy(float))

    enough = {lang: rows for lang, rows in found.groupby("lang") if rows.toxic.sum() >= 8 and rows.clean.sum() > 8}
    return {"": best(found)} | {lang: best(rows) for lang, rows in enough.items()}


def _judged(sample: DataFrame, net: Network) -> DataFrame:
    """``(p, y, lang)`` of sample rows: probability before calibration, label and language found."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", rows=256):
                langs = net.languages.predict(part.column(0))[0] if net.languages else [""] * part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(net.raw(part.column(0))), part.column(1), pa.array(langs, pa.string())], ["p", "y", "lang"])

    return sample.mapInArrow(scan, "p double, y int, lang string")


def classify(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``score, predicted, lang_guess`` of every row, from its whole text; NULL and empty texts get a score too.

    The result's columns replace kept ones of the same name; repeated rows are scored alike. An empty table gives an empty result.
    """
    keep = [c for c in keep if c not in ("score", "predicted", "lang_guess")]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = StructType([*rows.schema.fields[:len(keep)]]).add("score", DoubleType()).add("predicted", IntegerType()).add("lang_guess", StringType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", rows=256):
                p, langs = net.score(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(langs, pa.string())], schema.names)

    return rows.mapInArrow(scored, schema)
