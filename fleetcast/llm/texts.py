"""Arrow columns of texts as byte buffers, and hashes of their words, for work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fleetcast.session import materialize

MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
BYTE_CODE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; NULL has no bytes."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, size: int = 1 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` text bytes and ``rows`` rows; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross the boundaries of texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Powers:
    """``MULT**i`` and its inverse for ``i < n``, computed where they are needed: in a pickled function they take no room."""

    def __init__(self):
        self.tables = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __reduce__(self) -> tuple:
        return Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << 12 if n <= 1 << 12 else max(n, 1 << 21)
            out = []
            for base in (MULT, np.uint64(pow(int(MULT), -1, 2**64))):
                p = np.full(size, base, np.uint64)
                p[:1] = 1
                out.append(np.multiply.accumulate(p))
            self.tables = tuple(out)
        return self.tables


class SpanHash:
    """Hashes of any spans of a buffer from one pass of prefix sums; equal contents have equal hashes anywhere."""

    powers = Powers()

    def __init__(self, data: np.ndarray):
        up, self.down = SpanHash.powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str, seed: int = 7) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key`` among all rows; fewer where a label has fewer.

    The counts, one row for each of a classifier's classes, are sent to the rows.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("label_n"))
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(2**53))
    return rows.join(F.broadcast(counts), label).filter(share < per_label / F.col("label_n")).drop("label_n")


SENT_ROWS = 1_000_000  # rows of 16 bytes: a list of at most this many is sent to every task


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows named by ``gone``: ``id`` and ``th``, which is ``xxhash64(text)``. NULL ids are equal here."""
    gone = materialize(gone.distinct().select(F.col("id").alias("__id"), F.col("th").alias("__th")), "gone")
    small = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone
    return docs.join(small, docs[id_col].eqNullSafe(small["__id"]) & (F.xxhash64(docs[text_col]) == small["__th"]), "left_anti")
