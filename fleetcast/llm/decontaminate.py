"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents become sequences of canonical words: numbers, names and units are typed placeholders, so a question
with other figures or other people keeps its template. Windows of the template are hashed and joined; along each diagonal of matching
windows the slots must be consistent: equal values of the item stand for equal values of the document, and unequal ones for unequal ones.

A capital that opens a sentence may be a name's or the sentence's. So there are two forms of a text, with such words as names and as
plain words; items and documents are compared form by form. A window of few plain words fits too much prose when its placeholders are left open, so it
is hashed with its values: it counts where an item stands as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetcast.llm.texts import ASCII_LOWER, LETTER, SpanHash, buffers, mixed, pieces, runs, without
from fleetcast.session import materialize

WINDOW = 8  # canonical words
FIXED = 4  # words of a window that must not be placeholders, else its values are hashed
FORMS = (0, 1)  # capitals that open a sentence are plain words, or names
SHORTEST = 5  # fixed words that an item shorter than a window must have; less cannot be told from prose
COVERED = 13  # words of an item that must match, or all of a shorter one
BROADCAST_WINDOWS = 1_000_000  # benchmark windows sent to every task at once; more are joined in blocks of this many

# Units that follow a number, and number words.
UNITS = ("mm cm m km in ft yd mi miles mile inch inches feet foot yards metres meters kilometres kilometers g kg mg lb lbs oz pounds ounces grams kilograms tons tonnes "
         "s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year ms l ml litres liters gallons "
         "km/h mph kph percent pct dollars dollar euros euro pounds cents cent usd eur gbp degrees kw kwh mw w v hz khz mhz ghz kb mb gb tb").split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
NUM, NAME, UNIT = (np.uint64(x) for x in (101, 103, 107))  # hashes of the placeholders

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[10, 13, 33, 46, 58, 59, 63]] = True  # after these a capital letter says nothing


def hashes_of(words: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(words, pa.string()))
    return np.sort(SpanHash(data).of(offsets[:-1], offsets[1:]))


def within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


UNIT_HASHES, NUMBER_HASHES = hashes_of(UNITS), hashes_of(NUMBER_WORDS)


class Templates:
    """Canonical words of several texts: ``word`` (hash or placeholder), ``value`` (hash of what stands there), bounds ``at``."""

    def __init__(self, texts: pa.Array, form: int):
        self.form = form
        raw, offsets = buffers(texts)
        low = ASCII_LOWER[raw]
        wide = np.zeros(len(raw), bool)  # second byte of a capital letter from À to Þ
        wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low = np.where(wide, low + 0x20, low).astype(np.uint8)
        digit, letter = DIGIT[raw], LETTER[raw]
        inner = np.zeros(len(raw), bool)  # a point or comma between digits belongs to the number
        if len(raw) > 2:
            inner[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
        starts, ends = runs(digit | letter | inner, offsets)
        self.value = SpanHash(low).of(starts, ends)
        digits = np.concatenate([[0], np.cumsum(digit)])
        number = (digits[ends] > digits[starts]) & digit[starts] | within(NUMBER_HASHES, self.value)
        capital = np.zeros(len(starts), bool)
        if len(starts):
            big = (raw >= 65) & (raw <= 90)
            upper = np.concatenate([big[:-1] | wide[1:], big[-1:], np.zeros(2, bool)])  # a capital starts here
            second = starts + 1 + (raw[starts] == 0xC3)
            capital = upper[starts] & ~upper[second] & (ends > second)  # words in capitals only are no names
        bounds = np.searchsorted(starts, offsets)
        opening = np.zeros(len(starts), bool)
        opening[bounds[:-1][bounds[:-1] < len(starts)]] = True
        stops = np.concatenate([[0], np.cumsum(STOP[raw] & ~inner)])
        after = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        opening |= stops[starts] > stops[np.minimum(after, starts)]
        name = capital & ~number
        if not form:
            name &= ~opening
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & within(UNIT_HASHES, self.value[1:])
        unit &= ~opening & ~name
        self.word = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, self.value)))
        self.slot = number | unit | name
        # Adjacent names are one name: "New York" and "Paris" fill the same slot.
        follows = np.zeros(len(starts), bool)
        follows[1:] = name[1:] & name[:-1] & ~opening[:-1]  # but a word that opens a sentence may not be one
        keep = ~follows
        parts = np.cumsum(keep) - 1
        value = np.zeros(int(keep.sum()), np.uint64)
        np.add.at(value, parts, mixed(self.value + np.arange(len(starts), dtype=np.uint64) - np.flatnonzero(keep)[parts].astype(np.uint64)) if len(starts) else self.value)
        self.word, self.slot, self.value = self.word[keep], self.slot[keep], value
        self.at = np.concatenate([[0], np.cumsum(keep)])[bounds]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, usable)`` of the window at each word; windows never cross texts."""
        n = max(len(self.word) - length + 1, 0)
        fixed = np.concatenate([[0], np.cumsum(~self.slot)])
        rich = fixed[length:n + length] - fixed[:n] >= (FIXED if length == WINDOW else SHORTEST)
        h, as_is = np.full(n, np.uint64(length + 64 * self.form)), np.full(n, np.uint64(length + 64 * self.form + 32))
        for k in range(length):
            h = mixed(h ^ self.word[k:n + k])
            as_is = mixed(as_is ^ self.value[k:n + k])
        text = np.searchsorted(self.at, np.arange(n), "right") - 1
        inside = np.arange(n) + length <= self.at[np.minimum(text + 1, len(self.at) - 1)]
        return np.where(rich, h, as_is), inside & (rich | (length == WINDOW))


WINDOW_FIELDS = "form int, length int, pos int, hash long, slots array<struct<o:int,v:long>>"


def rows_of(t: Templates, i: np.ndarray, length: int, h: np.ndarray, names: list[pa.Array], labels: list[str], text: np.ndarray) -> pa.RecordBatch:
    """The windows ``i`` as rows with their place in the text and their slot values."""
    slots = [[{"o": int(k), "v": int(v)} for k, v in zip(np.flatnonzero(t.slot[a:a + length]), t.value[a:a + length][t.slot[a:a + length]].view(np.int64))] for a in i]
    owner = pa.array(text)
    return pa.RecordBatch.from_arrays(
        [*[x.take(owner) for x in names], pa.array(np.full(len(i), t.form, np.int32)), pa.array(np.full(len(i), length, np.int32)), pa.array((i - t.at[text]).astype(np.int32)), pa.array(h[i].view(np.int64)),
         pa.array(slots, pa.list_(pa.struct([("o", pa.int32()), ("v", pa.int64())])))], [*labels, "form", "length", "pos", "hash", "slots"])


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All windows of all items as ``(item, words, length, pos, hash, slots)``; an item shorter than a window is one window."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, form in ((p, f) for p in pieces(batch, "text") for f in FORMS):
                t = Templates(part.column(1), form)
                count = np.diff(t.at)
                for length in range(SHORTEST, WINDOW + 1):
                    h, ok = t.windows(length)
                    text = np.searchsorted(t.at, np.arange(len(h)), "right") - 1
                    ok &= (count[text] == length) | ((length == WINDOW) & (count[text] >= WINDOW))
                    i = np.flatnonzero(ok)
                    if len(i):
                        yield rows_of(t, i, length, h, [part.column(0), pa.array(count.astype(np.int32))], ["item", "words"], text[i])

    return rows.mapInArrow(cut, f"item {kind}, words int, {WINDOW_FIELDS}")


def matching_windows(docs: DataFrame, id_col: str, text_col: str, known: dict[int, np.ndarray]) -> DataFrame:
    """Windows of the documents whose hash is among ``known`` (sorted hashes by window length)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, form in ((p, f) for p in pieces(batch, "text") for f in FORMS):
                t = Templates(part.column(2), form)
                for length, hashes in known.items():
                    h, ok = t.windows(length)
                    i = np.flatnonzero(ok & within(hashes, h))
                    if len(i):
                        text = np.searchsorted(t.at, i, "right") - 1
                        yield rows_of(t, i, length, h, [part.column(0), part.column(1)], ["id", "th"], text)

    return rows.mapInArrow(probe, f"id {kind}, th long, {WINDOW_FIELDS}")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, th, item, covered_words, item_words, kind)``: one row per document and item that it holds, verbatim or re-parameterised.

    ``th`` is ``xxhash64(text)``, which tells rows of one id apart. A document holds an item if consistent windows on one diagonal cover
    13 canonical words of it, or all of a shorter item. NULL and empty texts hold nothing; items of fewer than 8 words of which less than 5 are
    plain words in both forms cannot be found. Repeated rows and items give one row; of several places the one that covers most, verbatim before
    re-parameterised. Texts of any length are read whole; an empty benchmark gives no rows. Further columns are not read.
    """
    windows = materialize(benchmark_windows(items, item_col, item_text).distinct(), "benchmark-windows")
    distinct = windows.select("length", "hash").distinct()
    blocks = max(1, -(-distinct.count() // BROADCAST_WINDOWS))
    hits = None
    for block in range(blocks):
        got = distinct.filter(F.pmod("hash", F.lit(blocks)) == block).toPandas()
        known = {int(n): np.sort(g.hash.to_numpy().astype(np.int64).view(np.uint64)) for n, g in got.groupby("length")}
        part = matching_windows(docs, id_col, text_col, known)
        hits = part if hits is None else hits.unionByName(part)
    hits = materialize(hits, "matching-windows")
    aligned = hits.distinct().select("id", "th", "form", "length", "hash", F.col("pos").alias("dpos"), F.col("slots").alias("dslots")).join(windows, ["form", "length", "hash"])
    diagonal = ["id", "th", "item", "form", (F.col("dpos") - F.col("pos")).alias("shift")]
    aligned = materialize(aligned.select(*diagonal, "words", "length", "pos", F.arrays_zip(F.col("slots").alias("i"), F.col("dslots").alias("d")).alias("slots")), "aligned-windows")
    keys = ["id", "th", "item", "form", "shift"]
    cover = aligned.groupBy(*keys).agg(F.first("words").alias("words"), F.first("length").alias("length"), F.array_sort(F.collect_set("pos")).alias("at"))
    step = F.aggregate("at", F.struct(F.lit(-1_000_000).alias("last"), F.lit(0).alias("n")),
                       lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.col("length"), p - acc["last"])).alias("n")))
    cover = cover.withColumn("covered", step["n"]).filter(F.col("covered") >= F.least(F.lit(COVERED), F.col("words")))
    slots = aligned.select(*keys, "pos", F.explode("slots").alias("s")).select(*keys, (F.col("pos") + F.col("s.i.o")).alias("o"), F.col("s.i.v").alias("iv"), F.col("s.d.v").alias("dv")).distinct()
    judged = slots.groupBy(*keys).agg(F.countDistinct("iv").alias("n_i"), F.countDistinct("dv").alias("n_d"), F.countDistinct("iv", "dv").alias("n_pairs"), F.min(F.col("iv") == F.col("dv")).alias("same"))
    same = reduce(lambda x, y: x & y, [F.col(f"c.{k}").eqNullSafe(F.col(f"j.{k}")) for k in keys])
    found = cover.alias("c").join(judged.alias("j"), same, "left").filter("n_pairs IS NULL OR (n_pairs = n_i AND n_pairs = n_d)")
    best = F.max(F.struct(F.col("covered"), F.coalesce("same", F.lit(True)).alias("same"), "words"))
    return found.groupBy("c.id", "c.th", "c.item").agg(best.alias("b")).select(
        F.col("id").alias(id_col), "th", F.col("item").alias(item_col), F.col("b.covered").alias("covered_words"), F.col("b.words").alias("item_words"),
        F.when(F.col("b.same"), "verbatim").otherwise("reparameterised").alias("kind"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    return without(docs, contaminated(docs, items, id_col, text_col).select(F.col(id_col).alias("id"), "th"), id_col, text_col)
