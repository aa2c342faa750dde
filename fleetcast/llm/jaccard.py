"""Exact Jaccard join of word shingle sets by universe partitioning (the pigeonhole principle).

Sets fall into size bands in which only neighbouring bands can hold similar sets. For each band the shingle universe is cut
into segments by a hash. Two sets whose symmetric difference is at most H agree on a segment, or differ there by one shingle, once
the weights of the segments exceed H: a segment has weight 1 if its subset is indexed as it is, weight 2 if
the subsets with one shingle deleted are indexed too. How many segments a band gets, and of which weight, is chosen by cost from
the number of sets in the band. A set with few empty segments leaves these out: the weights exceed H by a slack that
the others make up for. Candidates are pruned by a bound on the difference and then compared exactly.

Equal sets are one class before anything is joined. Candidates come in rounds: each class with the first class of its
index entries; then, within entries that still hold several components, each class with one of another component; at last all
pairs across components. So a group of near copies costs its size and not its square, and no link between components is lost.

On disk: index entries of open entries meet in waves, each of which shuffles at most a few bytes for a shingle of the corpus; texts go to
groups of classes that are compared among each other, not to pairs; tables go when nothing reads them any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fleetcast.llm import graph
from fleetcast.llm.texts import ASCII_LOWER, SPACE, SpanHash, buffers, mixed, pieces, runs, without
from fleetcast.session import discard, materialize

WORDS = 4
PERCENT = 85
SKETCH = 128
WIDE, LARGE = 1024, 1500  # buckets of the sketches of larger sets, whose differences in few buckets would cancel out
BROADCAST_ROWS = 1_000_000  # ids of 16 bytes: a list of at most this many is sent to every task
SLACKS = (*range(9), *range(10, 24, 2), *range(24, 65, 8), *range(96, 193, 32))  # weights beyond the difference that the allocation chooses from
BLOCK = 4096  # classes of an entry that are compared at once
ROUNDS = 2  # in which each index row meets one of another component, before all pairs that are left are compared
FIRST = 32  # entries that a class lists
WAVE = 4  # bytes that a wave of index rows shuffles, for each shingle of the corpus
GROUP = 1 << 18  # shingles of the classes whose texts are compared at once
REMEMBERED = 1 << 18  # classes a task remembers, so that copies are indexed about once per task


class ShingleSets:
    """Distinct shingle hashes of each text: ``tokens[at[i]:at[i + 1]]``, sorted."""

    def __init__(self, texts: pa.Array, words: int, salt: int = 0):
        data, offsets = buffers(texts)
        data = ASCII_LOWER[data]
        starts, ends = runs(~SPACE[data], offsets)
        h = SpanHash(data).of(starts, ends) + np.uint64(salt)
        bounds = np.searchsorted(starts, offsets)
        odd = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 3, 2**64)) for k in range(words)]
        count = max(len(h) - words + 1, 0)
        rolled = np.zeros(count, np.uint64)
        for k in range(words):
            rolled += mixed(h[k:k + count] ^ odd[k]) * odd[k]
        rolled = mixed(rolled)
        sets = []
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= words:
                sets.append(np.unique(rolled[a:b - words + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(b - a):
                    short = mixed(short ^ h[a + k]) * odd[k]
                sets.append(short)
            else:
                sets.append(np.zeros(0, np.uint64))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    def sums(self, of: np.ndarray) -> np.ndarray:
        return np.array([of[a:b].sum(dtype=np.uint64) for a, b in zip(self.at[:-1], self.at[1:])], np.uint64)


class Bands:
    """Size bands ``[low, high]`` with ``percent * high <= 100 * low``: similar sets are in the same band or in neighbouring ones."""

    def __init__(self, percent: int, largest: int):
        self.percent, low = percent, 1
        self.low, self.high = [], []
        while low <= max(largest, 1):
            self.low.append(low)
            self.high.append(low * 100 // percent)
            low = self.high[-1] + 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def difference(self, band: int) -> int:
        """Largest symmetric difference of similar sets of which the larger is in the band."""
        return 2 * self.high[band] * (100 - self.percent) // (100 + self.percent)


def allocation(size: float, difference: int, sets: int) -> tuple[int, int, int]:
    """``(segments, segments of weight 2, slack)`` of least cost for a band of ``sets`` sets of about ``size`` shingles.

    Cost of a set: its index entries, and its share of the comparisons among sets that must index empty segments because
    their segments of too few shingles weigh more than the slack.
    """
    best = (float("inf"), 1, 0, 0)
    for slack in (x for x in SLACKS if x <= max(8, difference // 2)):
        weight = difference + 1 + slack
        for twos in sorted({0, 1, 2, 3, weight // 4, weight // 2} & set(range(weight // 2 + 1))):
            segments = weight - twos
            load = size / segments
            empty, single = np.exp(-load), load * np.exp(-load)
            poor = np.exp(-twos * (empty + single)) * np.exp(-(segments - twos) * empty)
            upto, p2 = 0.0, poor  # the chance that poor segments weigh at most the slack, as Poisson sums
            for k2 in range(slack // 2 + 1):
                p1 = p2
                for k1 in range(slack - 2 * k2 + 1):
                    upto += p1
                    p1 *= (segments - twos) * empty / (k1 + 1)
                p2 *= twos * (empty + single) / (k2 + 1)
            over = max(0.0, 1 - upto)
            cost = segments + twos * load + sets * over * over * segments * 0.1
            if cost < best[0]:
                best = (cost, segments, twos, slack)
    return best[1:]


class Index:
    """Index entries of sets: for each band the number of segments, how many have weight 2, and the slack."""

    def __init__(self, bands: Bands, sets_by_band: dict[int, int]):
        self.bands = bands
        plans = []
        for band in range(len(bands.low)):
            held = sets_by_band.get(band, 0) + sets_by_band.get(band - 1, 0)
            plans.append(allocation((bands.low[band] + bands.high[band]) / 2, bands.difference(band), held))
        self.segments, self.twos, self.slack = (np.array(x, np.int64) for x in zip(*plans))
        self.used = np.array([sets_by_band.get(b, 0) > 0 for b in range(len(plans))])

    def entries(self, sets: ShingleSets) -> tuple[np.ndarray, np.ndarray]:
        """``(set, entry)``: each set is indexed in its own band, and in the next one if a similar set may be there."""
        own = self.bands.of(sets.sizes)
        found = []
        for step in (0, 1):
            band = own + step
            ok = (sets.sizes > 0) & (band < len(self.segments))
            band = np.where(ok, band, 0)
            low = np.array(self.bands.low)[band]
            ok &= self.used[band] & ((step == 0) | (100 * sets.sizes >= self.bands.percent * low))
            found.append(self._entries(sets, np.flatnonzero(ok), band))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _entries(self, sets: ShingleSets, chosen: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sizes, bands = sets.sizes[chosen], band[chosen]
        segments, twos, slack = self.segments[bands], self.twos[bands], self.slack[bands]
        token = np.concatenate([sets.tokens[sets.at[i]:sets.at[i + 1]] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), sizes)
        first = np.concatenate([[0], np.cumsum(segments)])
        place = first[owner] + ((token >> np.uint64(32)) * segments[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        value = mixed(token + np.uint64(1))
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, place, value)
        count = np.bincount(place, minlength=first[-1])
        of = np.repeat(np.arange(len(chosen)), segments)
        segment = np.arange(first[-1]) - first[of]
        weight = np.where(segment < twos[of], 2, 1)
        poor = np.bincount(of, np.where(count < weight, weight, 0), len(chosen))
        whole = (poor > slack)[of]  # such a set indexes its empty segments too
        mark = mixed((bands[of].astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(1))
        keep = (count > 0) | whole
        less = (weight[place] == 2) & ((count[place] > 1) | whole[place])
        entry = np.concatenate([mixed(total[keep] + mark[keep]), mixed(total[place[less]] - value[less] + mark[place[less]])])
        return chosen[np.concatenate([of[keep], owner[less]])], entry


def sketches(sets: ShingleSets) -> list[bytes]:
    """Counts by hash bucket, at most 255; the sum of their differences is never above the symmetric difference."""
    out = []
    for a, b in zip(sets.at[:-1], sets.at[1:]):
        width = WIDE if b - a >= LARGE else SKETCH
        bucket = (sets.tokens[a:b] & np.uint64(width - 1)).astype(np.int64)
        out.append(np.minimum(np.bincount(bucket, minlength=width), 255).astype(np.uint8).tobytes())
    return out


class Sketches:
    """Sketches side by side: all of them narrow, those of large sets also wide."""

    def __init__(self, values: list[bytes]):
        counts = [np.frombuffer(v, np.uint8).astype(np.int16) for v in values]
        self.narrow = np.array([np.minimum(c.reshape(-1, SKETCH).sum(0), 255) for c in counts], np.int16).reshape(-1, SKETCH)
        large = [i for i, c in enumerate(counts) if len(c) == WIDE]
        self.wide = np.array([counts[i] for i in large], np.int16).reshape(-1, WIDE)
        self.place = np.full(len(counts), -1)
        self.place[large] = np.arange(len(large))

    def gaps(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """For each ``i`` and ``j`` the difference of two sets that are both large by their wide sketches, else 0."""
        p, q = self.place[i], other.place[j]
        out = np.zeros(len(p), np.int64)
        both = np.flatnonzero((p >= 0) & (q >= 0))
        for k in range(0, len(both), 1024):
            at = both[k:k + 1024]
            out[at] = np.abs(self.wide[p[at]] - other.wide[q[at]]).sum(1)
        return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, salt: int) -> DataFrame:
    """``(id, th, n, cls, other, sketch)`` per row: size and two independent 64-bit names of the shingle set."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s = ShingleSets(part.column(2), words, salt)
                a, b = mixed(s.sums(mixed(s.tokens ^ np.uint64(0xA5A5)))), mixed(s.sums(mixed(s.tokens + np.uint64(77))) + np.uint64(9))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s.sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.array(sketches(s), pa.binary())], ["id", "th", "n", "cls", "other", "sketch"])

    return rows.mapInArrow(scan, f"id {id_type}, th long, n long, cls long, other long, sketch binary")


def indexed(docs: DataFrame, text_col: str, index: Index, words: int, salt: int) -> DataFrame:
    """``(entry, cls)`` of all rows; of copies that a task meets again it drops the entries."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                s = ShingleSets(part.column(0), words, salt)
                cls = mixed(s.sums(mixed(s.tokens ^ np.uint64(0xA5A5)))).view(np.int64)
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in met:
                        fresh[i] = True
                        met.add(c)
                        if len(met) > REMEMBERED:
                            met.clear()
                s.sizes = np.where(fresh, s.sizes, 0)  # rows of size 0 are not indexed
                owner, entry = index.entries(s)
                for i in range(0, len(owner), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(entry[i:i + (1 << 18)].view(np.int64)), pa.array(cls[owner[i:i + (1 << 18)]])], ["entry", "cls"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(scan, "entry long, cls long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, repeated: bool) -> DataFrame:
    """Those ``(a, b)`` of the distinct class pairs whose shingle sets are similar; first by sketch, then by their texts.

    ``repeated`` says that rows repeat an id and a text, so that a class may find its text several times.
    """
    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                x, y = (Sketches(batch.column(k).to_pylist()) for k in (4, 5))
                gap = np.maximum(np.abs(x.narrow - y.narrow).sum(1), x.gaps(np.arange(len(n)), y, np.arange(len(n))))
                ok = gap * (100 + percent) <= n * (100 - percent)
                yield batch.select([0, 1]).filter(pa.array(ok))

    kept = materialize(near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(bounded, "a long, b long"), "near-pairs")
    ends = kept.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(kept.select("b", "a"))
    leaders = ends.groupBy("cls").agg(F.least(F.min("other"), F.col("cls")).alias("leader"))
    need = materialize(leaders.join(classes.select("cls", "n", "first"), "cls").select("cls", "leader", "n", F.col("first.id").alias("id"), F.col("first.th").alias("th")), "need")
    parts = need.groupBy("leader").agg(F.ceil(F.sum("n") / GROUP).alias("parts"))
    group = F.xxhash64("leader", F.pmod(F.xxhash64("cls"), F.col("parts")))
    groups = need.join(parts, "leader").select("cls", group.alias("group"))
    met = kept.join(groups.select(F.col("cls").alias("a"), F.col("group").alias("p")), "a").join(groups.select(F.col("cls").alias("b"), F.col("group").alias("q")), "b")
    met = materialize(met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "a", "b"), "met-groups")
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    wanted = need.select("cls", F.col("id").alias("__id"), F.col("th").alias("__th"))
    wanted = F.broadcast(wanted) if need.count() <= BROADCAST_ROWS else wanted
    texts = named.join(wanted, named["th"].eqNullSafe(wanted["__th"]) & named["id"].eqNullSafe(wanted["__id"])).select("cls", "text")
    texts = materialize(texts.dropDuplicates(["cls"]) if repeated else texts, "texts")
    sent = met.select("p", "q", F.col("a").alias("cls")).union(met.select("p", "q", "b")).distinct().join(texts, "cls")
    none = F.lit(None)
    rows = sent.select("p", "q", F.col("cls").alias("a"), none.cast("long").alias("b"), "text").union(met.select("p", "q", "a", "b", none.cast("string")))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)  # few bytes, but many comparisons

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets = None, {}
        for batch in batches:
            for part in pieces(batch, "text"):
                s = ShingleSets(part.column(4), words)
                ok = np.zeros(part.num_rows, bool)
                for i, (p, q, a, b) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)))):
                    if (p, q) != here:
                        here, sets = (p, q), {}
                    if b is None:
                        sets[a] = s.tokens[s.at[i]:s.at[i + 1]].copy()
                        continue
                    x, y = sets[a], sets[b]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * same >= percent * (len(x) + len(y) - same)
                yield part.select([2, 3]).filter(pa.array(ok))

    similar = materialize(rows.repartition(tasks, "p", "q").sortWithinPartitions("p", "q", F.col("b").asc_nulls_first()).mapInArrow(compared, "a long, b long"), "similar")
    discard(kept, need, met, texts)
    return similar


def distinct_entries(shared: DataFrame) -> DataFrame:
    """Without entries that hold the same classes as another one; families of near copies share most of their entries."""
    held = shared.groupBy("entry").agg(F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"), F.count("*").alias("k"))
    return materialize(shared.join(held.groupBy("x", "y", "k").agg(F.min("entry").alias("entry")).select("entry", "k"), "entry"), "distinct-entries")


def with_labels(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Index rows with the component of their class so far."""
    rows = shared.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("entry", "cls", "k", F.coalesce("label", "cls").alias("label"))
    return materialize(rows, "labelled")


def across(labelled: DataFrame) -> DataFrame:
    """Pairs ``a < b``, one per index row: a class and one of another component, where its entry has any."""
    ends = labelled.groupBy("entry").agg(F.min(F.struct("label", "cls")).alias("lo"), F.max(F.struct("label", "cls")).alias("hi")).filter("lo.label <> hi.label")
    other = F.when(F.col("label") == F.col("lo.label"), F.col("hi.cls")).otherwise(F.col("lo.cls"))
    met = labelled.join(ends, "entry").select("cls", other.alias("other"))
    return met.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def crossing(labelled: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` of an entry's classes in different components that sizes and sketches do not rule out.

    Entries are compared inside tasks, block against block, so that a task's rows do not grow with the square of an entry, and in waves, as
    the rows carry sketches and may be many for each class.
    Similar sets share most of their entries. So that a pair is not named once for each, classes carry the first ``FIRST`` of their open entries, and
    an entry leaves a pair out if both lists have an earlier one: if two lists meet at all, their first meeting is the pair's first common entry, which names it.
    """
    open_entries = labelled.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("entry")
    rows = materialize(labelled.join(open_entries, "entry"), "open-entries")
    order = W.partitionBy("cls").orderBy("entry")
    lists = rows.select("cls", "entry").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FIRST)
    lists = lists.groupBy("cls").agg(F.sort_array(F.collect_list("entry")).alias("firsts"))
    facts = materialize(classes.select("cls", "n", "sketch").join(lists, "cls"), "open-classes")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    carried = F.octet_length("sketch") + 8 * F.size("firsts") + 64
    most = rows.groupBy("cls").agg(F.sum(blocks).alias("rows")).join(facts.select("cls", carried.alias("bytes")), "cls").agg(F.sum(F.col("rows") * F.col("bytes"))).first()[0]
    waves = -(-(most or 0) // (WAVE * (classes.agg(F.sum("n")).first()[0] or 1))) or 1
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    spread = rows.withColumn("mine", mine).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("entry", F.least("mine", "j").alias("i"), F.greatest("mine", "j").alias("j"), "mine", "cls", "label")

    def compare(unit: list[np.ndarray], sketches: list[bytes], firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        entry, i, j, mine, cls, label, n = unit
        both = Sketches(sketches)
        sketch = both.narrow
        left, right = (np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0]))
        for start in range(0, len(left), 16):
            x = left[start:start + 16]
            gap = np.abs(sketch[x][:, None, :] - sketch[right][None, :, :]).sum(2)
            small, large = np.minimum(n[x][:, None], n[right][None, :]), np.maximum(n[x][:, None], n[right][None, :])
            ok = (label[x][:, None] != label[right][None, :]) & (100 * small >= percent * large) & (gap * (100 + percent) <= (small + large) * (100 - percent))
            r, c = np.nonzero(ok)
            near = both.gaps(x[r], both, right[c]) * (100 + percent) <= (small + large)[r, c] * (100 - percent)
            p, q = x[r[near]], right[c[near]]
            for s in range(0, len(p), 1024):
                a, b = firsts[p[s:s + 1024]], firsts[q[s:s + 1024]]
                earlier = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < entry[0])).any((1, 2))
                mine_p, mine_q = cls[p[s:s + 1024][~earlier]], cls[q[s:s + 1024][~earlier]]
                yield np.minimum(mine_p, mine_q), np.maximum(mine_p, mine_q)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            yield from flush(held, batch)
        if held:
            yield from emit(pa.Table.from_batches(held))

    def flush(held: list[pa.RecordBatch], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        key = [batch.column(k).to_numpy() for k in range(3)]
        change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        last = int(change[-1]) if len(change) else 0
        if held and last == 0:
            before = held[-1]
            if any(before.column(k)[-1].as_py() != key[k][0] for k in range(3)):
                yield from emit(pa.Table.from_batches(held))
                held.clear()
        if last:
            yield from emit(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held.clear()
        held.append(batch.slice(last))

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [table.column(k).to_numpy() for k in range(7)]
        sketch = table.column(7).to_pylist()
        lists = pa.chunked_array(table.column(8)).combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        first = np.full((len(lengths), FIRST), np.iinfo(np.int64).max)  # places that are not filled are never earlier than an entry
        first[np.arange(FIRST) < lengths[:, None]] = lists.flatten().to_numpy()
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        found, count = [], 0
        for lo, hi in zip([0, *cuts], [*cuts, len(cols[0])]):
            for pair in compare([c[lo:hi] for c in cols], sketch[lo:hi], first[lo:hi]):
                found.append(pair)
                count += len(pair[0])
                if count >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])
                    found, count = [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    parts = []
    for w in range(waves):
        wave = spread.filter(F.pmod(F.xxhash64("entry", "i", "j"), F.lit(waves)) == w).join(facts, "cls").select("entry", "i", "j", "mine", "cls", "label", "n", "sketch", "firsts")
        parts.append(materialize(wave.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j").mapInArrow(scan, "a long, b long"), "wave"))
    found = materialize(reduce(DataFrame.union, parts).distinct(), "met-pairs")
    discard(rows, facts, *parts)
    return found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(id, th, n_shingles, component, component_id)`` per row, where ``th`` is ``xxhash64(text)`` and ``component`` tells components apart.

    Rows link when ``100 * common >= percent * union`` of their sets of distinct ``words``-word shingles; ``component_id`` is the smallest id that
    links reach. A text of fewer words is one shingle. NULL, empty and blank texts have no shingles and link with nothing. NULL ids are
    never the smallest unless alone (then NULL); repeated rows are equal sets. Shingles are compared as 64-bit hashes.
    """
    salt = 0
    while True:
        rows = materialize(fingerprints(docs, id_col, text_col, words, salt), "fingerprints")
        filled = rows.filter("n > 0")
        classes = filled.groupBy("cls", "other", "n").agg(F.min("id").alias("id"), F.min(F.struct("id", "th")).alias("first"), F.min("sketch").alias("sketch"))
        classes = materialize(classes, "classes")
        most, largest = classes.groupBy("cls").agg(F.count("*").alias("k"), F.max("n").alias("n")).agg(F.max("k"), F.max("n")).first()
        if (most or 0) <= 1:
            break
        discard(rows, classes)
        salt += 1
    bands = Bands(percent, largest or 1)
    edges = F.lit(0)
    for low in bands.low[1:]:
        edges = edges + (F.col("n") >= low).cast("int")
    by_band = {r.band: r["count"] for r in classes.groupBy(edges.alias("band")).count().collect()}
    index = Index(bands, by_band)
    group = W.partitionBy("entry")
    shared = indexed(docs, text_col, index, words, salt).select("entry", "cls", F.min("cls").over(group).alias("a"), F.max("cls").over(group).alias("z"))
    every = materialize(shared.filter("a <> z").select("entry", "cls").distinct(), "shared-entries")
    shared = distinct_entries(every)
    discard(every)
    first = shared.groupBy("entry").agg(F.min("cls").alias("a"))
    pairs = materialize(shared.join(first, "entry").filter("cls <> a").groupBy(F.col("cls").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    repeated = (filled.groupBy("id", "th").count().agg(F.max("count")).first()[0] or 0) > 1
    links, tried, found, labelled, step = None, pairs, None, None, 0
    while True:
        similar = verified(pairs, classes, docs, id_col, text_col, words, percent, repeated) if pairs.head(1) else pairs
        new = links is None or bool(similar.head(1))
        if new:  # else the components stay, and what they have across has been tried
            links = similar if links is None else links.unionByName(similar)
            found = graph.components(links)
            if labelled:
                discard(labelled)
            labelled = with_labels(shared, found) if step <= ROUNDS else None
        if step > ROUNDS:
            break
        step = step + 1 if new and step < ROUNDS else ROUNDS + 1
        pairs = across(labelled) if step <= ROUNDS else crossing(labelled, classes, percent)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "crossing-pairs")
        tried = tried.unionByName(pairs)
    discard(shared, *([labelled] if labelled else []))
    ids = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "id", F.coalesce("label", "cls").alias("label"))
    smallest = materialize(ids.groupBy("label").agg(F.min("id").alias("component_id")), "component-ids")
    of_class = materialize(materialize(ids.select("cls", "label"), "class-labels").join(smallest, "label").select("cls", F.col("label").alias("component"), "component_id"), "class-components")
    return rows.select("id", "th", "n", "cls").join(of_class, "cls", "left").select(
        F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, with all their columns: of each component the row with the smallest id, NULL last; every row without shingles.

    Of rows that repeat an id and a text one stays.
    """
    rows = materialize(join(docs, id_col, text_col, words, percent).withColumnRenamed(id_col, "id").filter("n_shingles > 0").select("id", "th", "component"), "joined")
    stay = materialize(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("th"))).alias("s")).select(
        "component", F.col("s.id").alias("sid"), F.col("s.th").alias("sth")), "stay")
    gone = rows.join(stay, "component").filter(~(F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")))).select("id", "th")
    kept = without(docs, gone, id_col, text_col)
    repeated = materialize(rows.groupBy("id", "th").count().filter("count > 1").select("id", "th"), "repeated")
    if not repeated.head(1):
        return kept
    again = kept.join(repeated.select(F.col("id").alias("__id"), F.col("th").alias("__th")), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left_semi")
    return without(kept, repeated, id_col, text_col).unionByName(again.dropDuplicates([id_col, text_col]))
