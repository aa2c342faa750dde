"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector of hashed byte trigrams, square-root term frequency times inverse document frequency, of length 1.
Each language has several centroids, found by spherical k-means among its sampled texts; a text gets the language of
the centroid with the largest cosine, and is marked as rejected if it is farther from it than nearly all sampled texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fleetcast.llm.texts import LETTER, bounded_sample, buffers, pieces

BINS = 4096
UNKNOWN = "und"


def counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts by hashed bin, one row per text. Whatever is not a letter counts as a space."""
    padded = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(pc.fill_null(texts, "")), pa.scalar(" "), "")
    data, offsets = buffers(padded)
    data = np.where(LETTER[data], data, np.uint8(32)).astype(np.uint32)
    code = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)) if len(data) > 2 else np.zeros(0, np.uint32)
    blank = code == 0x202020
    bins = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(offsets))[:len(code)]
    inside = (np.arange(len(code)) + 2 < offsets[doc + 1]) & ~blank
    return np.bincount((doc * BINS + bins)[inside], minlength=n * BINS).reshape(n, BINS)


@dataclass(frozen=True)
class CentroidModel:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray  # centroids x bins, of length 1
    floor: np.ndarray  # cosine below which a text is rejected, by centroid
    idf: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``(language, cosine, rejected)`` of each text; every text must have a letter to get a language."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(counts(texts), self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(float)
        return [self.languages[k] for k in self.owner[best]], score, score < self.floor[best]


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; starts with the texts that are farthest from the centroids so far."""
    found = [x.mean(0)]
    while len(found) < min(k, len(x)):
        found.append(x[(x @ np.array(found).T).max(1).argmin()])
    c = np.array(found)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
        nearest = (x @ c.T).argmax(1)
        c = np.array([x[nearest == j].mean(0) if (nearest == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", per_language: int = 400,
        most: int = 8000, clusters: int = 4, reject: float = 0.005) -> CentroidModel:
    """Model from labelled rows; ``per_language`` and ``most`` bound the sample that is learned from.

    The sample reaches the driver as 8 KB vectors. Rows without text or language are left out.
    """
    known = rows.select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    chosen = bounded_sample(known.select("key", "lang"), "lang", per_language, "key").distinct().orderBy(F.xxhash64("key", "lang"), "key", "lang").limit(most)  # bounded, so it is sent to the texts
    sample = known.join(F.broadcast(chosen), ["key", "lang"]).filter(F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", rows=256):
                found = np.sqrt(counts(part.column(1)), dtype=np.float32).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in found])], ["lang", "root"])

    got = sample.mapInArrow(encode, "lang string, root binary").limit(most).toPandas().sort_values(["lang", "root"])
    languages = sorted(set(got.lang))
    if not languages:
        return CentroidModel([], np.zeros(0, int), np.zeros((0, BINS), np.float32), np.zeros(0), np.zeros(BINS, np.float32))
    x = np.frombuffer(b"".join(got.root), np.float16).reshape(len(got), BINS).astype(np.float32)
    got = got[["lang"]]  # the vectors are held once, and weighed in place
    idf = np.log((1 + len(x)) / (0.5 + (x > 0).sum(0))).astype(np.float32)
    x *= idf
    for i in range(0, len(x), 256):
        x[i:i + 256] /= np.maximum(np.linalg.norm(x[i:i + 256], axis=1), 1e-9)[:, None]
    owner, centroids, floor = [], [], []
    for i, lang in enumerate(languages):
        own = x[(got.lang == lang).to_numpy()]
        c = clustered(own, clusters)
        cos = own @ c.T
        for j in range(len(c)):
            near = cos[cos.argmax(1) == j, j]
            owner.append(i)
            centroids.append(c[j])
            floor.append(np.quantile(near, reject) if len(near) else 1.0)
    return CentroidModel(languages, np.array(owner), np.array(centroids, np.float32), np.array(floor), idf)


def refined(model: CentroidModel, rows: DataFrame, text_col: str = "text", lang_col: str = "lang", rounds: int = 1) -> CentroidModel:
    """The model with weights and centroids of all labelled rows, started from the given centroids; it rejects nothing.

    Counts of texts by bin give the weights. In each round of spherical k-means every text joins the nearest centroid of its language, and
    Spark adds the texts up by centroid and bin. A language that the model lacks starts with the mean of its texts. Sums, as many as the
    model has numbers, reach the driver. Rows without text, letter or language are left out.
    """
    known = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def added(values: Callable[[pa.Array, list[str]], Iterator[tuple[str, int, np.ndarray]]]) -> dict[tuple[str, int], np.ndarray]:
        """Sums of the vectors that ``values`` gives for ``(language, number)`` in each part of the rows."""
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for part in pieces(batch, "text", rows=256):
                    for lang, j, v in values(part.column(1), part.column(0).to_pylist()):
                        sums[lang, j] = sums[lang, j] + v if (lang, j) in sums else v
            for (lang, j), v in sums.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), j, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])],
                                                 ["lang", "number", "bin", "value"])

        got = known.mapInArrow(scan, "lang string, number int, bin int, value double").groupBy("lang", "number", "bin").agg(F.sum("value").alias("value")).toArrow().to_pandas()
        out = {}
        for (lang, j), part in got.groupby(["lang", "number"]):
            out[lang, int(j)] = np.zeros(BINS + 1)
            out[lang, int(j)][part["bin"].to_numpy()] = part["value"].to_numpy()
        return out

    def counted(texts: pa.Array, langs: list[str]) -> Iterator[tuple[str, int, np.ndarray]]:
        """0: texts with a bin, and in the last place all; 1: sums of the unit vectors before weights."""
        tf, owner = counts(texts), np.array(langs, object)
        root = vectors(tf, np.ones(BINS, np.float32)) if not set(langs) <= started else None
        for lang in set(langs):
            own = owner == lang
            yield lang, 0, np.append((tf[own] > 0).sum(0), own.sum()).astype(float)
            if lang not in started:
                yield lang, 1, np.append(root[own].sum(0), 0).astype(float)

    started = set(model.languages)
    found = added(counted)
    if not found:
        return model
    n = sum(v for (_, j), v in found.items() if j == 0)
    idf = np.log((1 + n[BINS]) / (0.5 + n[:BINS])).astype(np.float32)
    centroids = {lang: model.centroids[model.owner == i] for i, lang in enumerate(model.languages)}
    for (lang, j), v in found.items():
        if j == 1:
            c = (v[:BINS] * idf)[None, :]
            centroids[lang] = (c / max(np.linalg.norm(c), 1e-9)).astype(np.float32)
    for _ in range(rounds):
        def joined(texts: pa.Array, langs: list[str]) -> Iterator[tuple[str, int, np.ndarray]]:
            x, owner = vectors(counts(texts), idf), np.array(langs, object)
            for lang in set(langs):
                own = x[owner == lang]
                nearest = (own @ centroids[lang].T).argmax(1)
                for j in np.unique(nearest):
                    yield lang, int(j), np.append(own[nearest == j].sum(0), 0).astype(float)

        for (lang, j), v in added(joined).items():
            c = centroids[lang].copy()
            c[j] = v[:BINS] / max(np.linalg.norm(v[:BINS]), 1e-9)
            centroids[lang] = c
    languages = sorted(centroids)
    owner = np.repeat(np.arange(len(languages)), [len(centroids[x]) for x in languages])
    return CentroidModel(languages, owner, np.concatenate([centroids[x] for x in languages]), np.zeros(len(owner)), idf)


def identify(docs: DataFrame, model: CentroidModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``lang_pred, score, rejected`` of every row, from its whole text.

    NULL text and text without a letter is ``und`` with score 0. The model is a few hundred KB per language. Of languages with equal cosine the
    first in the alphabet is taken; repeated rows get equal results, texts of any length are read whole. The result's columns replace kept ones of
    the same name; an empty table gives an empty result.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    rows = docs.select(*keep, F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = StructType([*rows.schema.fields[:len(keep)]]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", rows=256):
                langs, score, far = model.predict(part.column(len(keep)))
                letters = part.column(len(keep) + 1).to_numpy(zero_copy_only=False).astype(bool)
                langs = [x if ok else UNKNOWN for x, ok in zip(langs, letters)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)],
                    schema.names)

    return rows.mapInArrow(scored, schema)
