"""Repeated byte strings across documents by a partitioned, sampled suffix array.

Every string of ``length`` bytes holds a sampled suffix start, chosen by its content alone (the smallest hash of a window of
``lead``-byte tokens), so equal strings hold it at the same place. A sampled suffix stands for all strings that chose it: the stretch around it.

1. Suffixes are range-partitioned by their leading token with splitters from a sample of documents; a token that fills several ranges is
   dealt over them by document, and such tokens are compared across the boundaries of their buckets.
2. A bucket sorts its suffixes by multikey quicksort (token, then the stretch among equal tokens, then the document) and compares neighbours:
   a stretch that also stands in a smaller document is covered as a whole.
3. Stretches that share a token but differ, at the edges of repeats, are read again and compared string by string.

Stretches are compared by 104 bits of hash (64 of the leading token, 40 of the whole). Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from fleetcast.llm.texts import SpanHash, buffers, mixed, pieces, runs
from fleetcast.session import materialize

LENGTH, LEAD = 50, 24
BUCKET_BYTES = 4 << 20  # text bytes whose suffixes make one bucket, about 8 MB
SAMPLE_DOCS = 2000  # documents from which splitters are taken
PART = 50_000  # edge stretches of one token that a task compares; a token with more is split by the hash of the strings
STRETCH_BYTES = 5
PACK = np.dtype([("u", "<u4"), ("n", "u1")])  # a span: start and length


class Sampled:
    """Sampled suffixes of several texts: text, stretch ``[u, e)``, place ``p`` of the token, its hash and the stretch's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, lead: int):
        self.hash = SpanHash(data)
        n = len(data) - lead + 1
        empty = np.zeros(0, np.int64)
        self.text = self.u = self.e = self.p = empty
        self.token = self.stretch = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        at = np.arange(n, dtype=np.int64)
        value, place, span, width = self.hash.of(at, at + lead), at.astype(np.int32), 1, length - lead + 1
        own = value
        while span < width:  # leftmost minimum of growing windows
            step = min(span, width - span)
            first = value[:-step] <= value[step:]
            place = np.where(first, place[:-step], place[step:])
            value = np.minimum(value[:-step], value[step:])
            span += step
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
        start = np.flatnonzero(np.arange(len(place)) + length <= offsets[text + 1])
        if not len(start):
            return
        new = np.ones(len(start), bool)
        new[1:] = (place[start[1:]] != place[start[:-1]]) | (text[start[1:]] != text[start[:-1]])
        head = np.flatnonzero(new)
        self.u, self.e = start[head], start[np.append(head[1:], len(start)) - 1] + length
        self.p, self.text = place[self.u].astype(np.int64), text[self.u]
        self.token, self.stretch = own[self.p], self.hash.of(self.u, self.e)


def multikey_order(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Sorted order by three keys: each key sorts only the rows that are equal in the keys before it."""
    order = np.argsort(first, kind="stable")
    for before, key in (((first,), second), ((first, second), third)):
        tied = np.ones(max(len(order) - 1, 0), bool)
        for b in before:
            tied &= b[order[1:]] == b[order[:-1]]
        if not tied.any():
            continue
        group = np.concatenate([[0], np.cumsum(~tied)])
        rows = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
        inner = np.lexsort((key[order[rows]], group[rows]))
        order[rows] = order[rows][inner]
    return order


def _splitters(keyed: DataFrame, buckets: int, length: int, lead: int) -> np.ndarray:
    """Tokens that cut a sample of all suffixes into equal parts."""
    n = max(keyed.count(), 1)
    chosen = keyed.filter(F.shiftrightunsigned(F.xxhash64(F.lit(5), "id", "th"), 11) / F.lit(float(2**53)) < SAMPLE_DOCS / n).select("text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s = Sampled(*buffers(part.column(0)), length, lead)
                few = s.token[::max(1, len(s.token) // 2000)]  # evenly spaced ones of each piece
                yield pa.RecordBatch.from_arrays([pa.array([np.sort(few).tobytes()], pa.binary())], ["t"])

    got = chosen.mapInArrow(tokens, "t binary").limit(4000).collect()
    all_tokens = np.sort(np.concatenate([np.frombuffer(r.t, np.uint64) for r in got])) if got else np.zeros(0, np.uint64)
    if not len(all_tokens):
        return np.zeros(0, np.uint64)
    return all_tokens[np.linspace(0, len(all_tokens), buckets + 1).astype(int)[1:-1]]


def _suffixes(keyed: DataFrame, splitters: np.ndarray, length: int, lead: int) -> DataFrame:
    """``(bucket, rows)``: packed suffixes by bucket, column by column: token, stretch hash, and compressed document, start and length."""
    values, times = np.unique(splitters, return_counts=True)
    ranges = {int(t): (int(np.searchsorted(splitters, t, "left")), int(np.searchsorted(splitters, t, "right"))) for t in values[times > 1]}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", size=1 << 23, rows=60_000):
                ids, ths = part.column(0).to_numpy(), part.column(1).to_numpy()
                found: list[tuple] = []
                for sub, base in _offsets(part):
                    s = Sampled(*buffers(sub.column(2)), length, lead)
                    start = buffers(sub.column(2))[1]
                    found.append((s.token, s.stretch, s.text + base, s.u - start[s.text], s.e - s.u))
                token, stretch, text, u, n = (np.concatenate(x) for x in zip(*found))
                bucket = np.searchsorted(splitters, token, "right")
                for t, (a, b) in ranges.items():  # a token with ranges of its own is dealt over them by document
                    mine = np.flatnonzero(token == np.uint64(t))
                    bucket[mine] = a + 1 + (mixed(ids[text[mine]].view(np.uint64)) % np.uint64(b - a)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(len(splitters) + 2))
                blobs, names = [], []
                for k in np.flatnonzero(np.diff(cuts)):
                    o = order[cuts[k]:cuts[k + 1]]
                    used, local = np.unique(text[o], return_inverse=True)
                    small = zlib.compress(b"".join(map(planes, (ids[used], ths[used], np.diff(local.reshape(-1), prepend=0).astype(np.uint8), u[o].astype(np.uint32), n[o].astype(np.uint8)))), 1)
                    blobs.append(np.array([len(o), len(used)]).tobytes() + token[o].tobytes() + planes(stretch[o])[:STRETCH_BYTES * len(o)] + small)
                    names.append(k)
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    return keyed.select("id", "th", "text").mapInArrow(pack, "bucket int, rows binary")


def _offsets(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    base = 0
    for sub in pieces(part, "text", size=1 << 20):
        yield sub, base
        base += sub.num_rows


def planes(x: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes, and so on: high bytes compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    k, d = np.frombuffer(blob, np.int64, 2)
    token = np.frombuffer(blob, np.uint64, k, 16)
    stretch = np.zeros((k, 8), np.uint8)
    stretch[:, :STRETCH_BYTES] = np.frombuffer(blob, np.uint8, STRETCH_BYTES * k, 16 + 8 * k).reshape(-1, k).T
    small, at = zlib.decompress(blob[16 + (8 + STRETCH_BYTES) * k:]), 0

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * count
        out = np.ascontiguousarray(np.frombuffer(small, np.uint8, size, at).reshape(-1, count).T).view(kind).reshape(-1)
        at += size
        return out

    ids, ths, local, u, n = take(np.int64, d), take(np.int64, d), np.cumsum(take(np.uint8, k)), take(np.uint32, k), take(np.uint8, k)
    return token, stretch.view(np.uint64)[:, 0], ids[local], ths[local], u, n


def _compared(bucketed: DataFrame, several: set[int]) -> DataFrame:
    """Neighbour comparison of sorted buckets: ``(kind, id, th, at, token, stretch)``.

    Kinds: 0 covered stretch; 1 stretch that shares its token with a different one of another document; 2 suffix of a token of several buckets,
    for which the comparison goes across boundaries. ``at`` packs start and length.
    """
    split = np.array(sorted(several), np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b.as_py() for batch in batches for b in batch.column(1)]
        if not blobs:
            return
        token, stretch, doc, th, u, n = (np.concatenate(x) for x in zip(*map(_unpacked, blobs)))
        del blobs
        apart = np.isin(token, split)
        order = multikey_order(token, stretch, doc)
        token, stretch, doc, th, u, n, apart = (x[order] for x in (token, stretch, doc, th, u, n, apart))
        new_token = np.append(True, token[1:] != token[:-1])
        new = new_token | np.append(True, stretch[1:] != stretch[:-1])
        smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        covered = doc > smallest
        group = np.cumsum(new_token) - 1
        low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group[~covered], doc[~covered])
        np.maximum.at(high, group[~covered], doc[~covered])
        edge = ~covered & (low != high)[group]
        kind = np.where(apart, 2, np.where(covered, 0, np.where(edge, 1, -1)))
        rows = np.flatnonzero(kind >= 0)
        at = u.astype(np.int64) << 8 | n
        for i in range(0, len(rows), 1 << 17):
            r = rows[i:i + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[r].astype(np.int32)), pa.array(doc[r]), pa.array(th[r]), pa.array(at[r]), pa.array(token[r].view(np.int64)), pa.array(stretch[r].view(np.int64))],
                ["kind", "id", "th", "at", "token", "stretch"])

    return bucketed.mapInArrow(compare, "kind int, id long, th long, at long, token long, stretch long")


def _with_spans(keyed: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    return keyed.join(spans.withColumnRenamed("id", "sid").withColumnRenamed("th", "sth"), (F.col("id") == F.col("sid")) & (F.col("th") == F.col("sth")), how)


def _packed(rows: DataFrame) -> DataFrame:
    """One binary of ``at`` values per document, a number of spans that its length bounds."""
    lists = rows.groupBy("id", "th").agg(F.collect_list("at").alias("ats"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                at = np.sort(np.array(x.values.to_numpy(), np.int64))
                block = np.zeros(len(at), PACK)
                block["u"], block["n"] = at >> 8, at & 255
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "th", "spans"])

    return lists.mapInArrow(pack, "id long, th long, spans binary")


def _edges(keyed: DataFrame, flagged: DataFrame, length: int, lead: int) -> DataFrame:
    """``(id, th, at)`` of strings in edge stretches that a smaller document holds too."""
    packed = materialize(_packed(flagged), "edge-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = buffers(part.column(2))
                spans = [np.frombuffer(x.as_py(), PACK) for x in part.column(3)]
                count = np.array([len(x) for x in spans])
                row = np.repeat(np.arange(len(spans)), count)
                s = np.concatenate(spans)
                u = s["u"].astype(np.int64) + offsets[row]
                hashes, n = SpanHash(data), s["n"].astype(np.int64) - lead + 1
                inner = np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(u, n) + np.arange(len(inner)) - inner
                token = np.minimum.reduceat(hashes.of(at, at + lead), np.cumsum(n) - n)  # the stretch's smallest hash, by which it was chosen
                raw = data.tobytes()
                owner = pa.array(row)
                at = s["u"].astype(np.int64) << 8 | s["n"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(token.view(np.int64)), pa.array(at),
                     pa.array([raw[a:a + k] for a, k in zip(u.tolist(), s["n"].tolist())], pa.binary())], ["id", "th", "token", "at", "bytes"])

    rows = materialize(_with_spans(keyed, packed, "inner").select("id", "th", "text", "spans").mapInArrow(cut, "id long, th long, token long, at long, bytes binary"), "edge-stretches")
    large = rows.groupBy("token").count().filter(F.col("count") > PART).select("token", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    dealt = rows.join(large, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            token, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (token[0], part[0]) and size > 4000:
                yield from strings(pa.Table.from_batches(held))
                held, size = [], 0
            if size + batch.num_rows > 8000 and len(cuts):
                yield from strings(pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]))
                held, size, batch = [], 0, batch.slice(int(cuts[-1]))
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from strings(pa.Table.from_batches(held))

    def strings(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        token, part, parts, doc, th, at = (table.column(k).to_numpy() for k in range(6))
        data, offsets = buffers(table.column(6).chunk(0))
        hashes = SpanHash(data)
        count = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        a = offsets[row] + inside
        h = hashes.of(a, a + length)
        mine = (h % parts[row].astype(np.uint64)).astype(np.int64) == part[row]
        row, inside, h = row[mine], inside[mine], h[mine]
        order = np.lexsort((doc[row], h, token[row]))
        t, hs, d = token[row][order], h[order], doc[row][order]
        new = np.append(True, (t[1:] != t[:-1]) | (hs[1:] != hs[:-1]))[:len(t)]
        smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = order[d > smallest]
        hit.sort()
        row, inside = row[hit], inside[hit]
        if len(row):  # neighbouring strings of a stretch are one span
            start = np.append(True, (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1))
            f = np.flatnonzero(start)
            last = np.append(f[1:], len(row)) - 1
            u = (at[row[f]] >> 8) + inside[f]
            n = inside[last] - inside[f] + length
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[f]]), pa.array(th[row[f]]), pa.array(u << 8 | n)], ["id", "th", "at"])

    return (dealt.select("token", "part", "parts", "id", "th", "at", "bytes").repartition("token", "part").sortWithinPartitions("token", "part")
            .mapInArrow(match, "id long, th long, at long"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, lead: int = LEAD, keep_text: bool = False) -> DataFrame:
    """Per row ``id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``, the bytes that are left as ``kept``.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id, judged on the input. NULL text is empty.
    Rows that repeat an id do not count as smaller than each other; a row with a NULL id is kept whole and removes nothing. Ids are integers.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Texts are told apart by their hash only where an id has several; else a constant takes its place, which packs to nothing.
    alike = named.groupBy("id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("id IS NOT NULL AND lo <> hi")
    keyed = named if alike.head(1) else named.withColumn("th", F.lit(0).cast("long"))
    usable = keyed.filter(f"id IS NOT NULL AND octet_length(text) >= {length}")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    splitters = _splitters(usable, buckets, length, lead)
    values, times = np.unique(splitters, return_counts=True)
    several = {int(t) for t in values[times > 1]}
    bucketed = _suffixes(usable, splitters, length, lead).repartitionById(len(splitters) + 1, "bucket")
    found = materialize(_compared(bucketed, several), "compared-suffixes")
    covered, flagged = found.filter("kind = 0").select("id", "th", "at"), found.filter("kind = 1").select("id", "th", "at")
    if several:  # across boundaries: the smallest document of each stretch, over all buckets of its token
        wide = found.filter("kind = 2")
        smallest = materialize(wide.groupBy("token", "stretch").agg(F.min("id").alias("smallest")), "smallest")
        judged = wide.join(smallest, ["token", "stretch"])
        covered = covered.unionByName(judged.filter("id > smallest").select("id", "th", "at"))
        flagged = flagged.unionByName(judged.filter("id = smallest").select("id", "th", "at"))
    spans = _packed(covered.unionByName(_edges(usable, flagged, length, lead)))
    spans = materialize(spans, "covered-spans")
    schema = StructType().add(id_col, LongType()).add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType()).add("kept_sha256", StringType())
    schema = schema.add("kept", BinaryType()) if keep_text else schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = buffers(part.column(1))
                change = np.zeros(len(data) + 1, np.int32)
                for i, x in enumerate(part.column(2)):
                    if x.is_valid:
                        s = np.frombuffer(x.as_py(), PACK)
                        u = s["u"].astype(np.int64) + offsets[i]
                        np.add.at(change, u, 1)
                        np.add.at(change, u + s["n"], -1)
                gone = np.cumsum(change)[:-1] > 0
                starts, _ = runs(gone, offsets)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                n_spans = np.diff(np.searchsorted(starts, offsets))
                left = data[~gone].tobytes()
                at = (offsets - total[offsets]).tolist()
                kept = [left[a:b] for a, b in zip(at[:-1], at[1:])]
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * keep_text], schema.names)

    return _with_spans(keyed, spans, "left").select("id", "text", "spans").mapInArrow(remove, schema)
