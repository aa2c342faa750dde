"""Scores of documents under a bigram language model that lies in Elias-Fano tries.

The model is a hierarchy of Dirichlet priors: ``P(w | v) = (c(v, w) + mu P(w)) / (c(v) + mu)`` and ``P(w) = (c(w) + 1/2) / (N + (V + 1) / 2)``, which sums to one
over all words and one unknown word. Its logarithm is the numerator's minus the denominator's: the numerator needs the counts of ``w`` and of
the pair, the denominator only the count of ``v``, itself a word. So tries are cut by words: a shard holds a range of word hashes and all their
contexts, and answers for each occurrence of its words both the numerator and, as the next token's context, the denominator.

Tasks gather tokens in chunks of documents; of a chunk each shard gets one message with the chunk's distinct pairs. ``fit`` merges
the messages of training documents into tries; ``score`` meets the messages of any documents with the tries and adds up answers by chunk. A word with
so many occurrences that it would outgrow a shard is spread over all shards by its contexts; its total is summed in between. All counts cover
all training documents; nothing is pruned. Words are told apart by 64-bit hashes, the contexts of a word by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetcast.llm.texts import ASCII_LOWER, SPACE, SpanHash, buffers, mixed, pieces, runs
from fleetcast.llm.trie import Trie
from fleetcast.session import materialize

MU = 500.0
CHUNK = 1_200_000  # tokens whose pairs are gathered before they are sent
SHARD_BYTES = 20_000_000  # training text per shard
HEAVY = 24  # a word is spread if it has one occurrence per so many bytes of a shard's text
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
CONTEXT_BITS = np.uint64(16)  # dropped from a context's hash


@dataclass(frozen=True)
class Model:
    """Tries as rows ``(shard, trie)`` and the sums over all of them."""

    tries: DataFrame
    shards: int
    tokens: int
    words: int
    documents: int
    heavy: tuple[np.ndarray, np.ndarray]  # hashes in order, and counts
    mu: float

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)


class Tokens:
    """Word hashes of a chunk of documents, each ended by END."""

    def __init__(self):
        self.parts, self.lengths, self.metas, self.count = [], [], [], 0

    def add(self, texts: pa.Array, meta: pa.RecordBatch) -> None:
        data, offsets = buffers(texts)
        data = ASCII_LOWER[data]
        starts, ends = runs(~SPACE[data], offsets)
        words = mixed(SpanHash(data).of(starts, ends))
        bounds = np.searchsorted(starts, offsets)
        out = np.insert(words, bounds[1:], END)
        self.parts.append(out)
        self.lengths.append(np.diff(bounds) + 1)
        self.metas.append(meta)
        self.count += len(out)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, context, document)`` of each token."""
        word = np.concatenate(self.parts)
        lengths = np.concatenate(self.lengths)
        context = np.concatenate([[BEGIN], word[:-1]])
        context[np.cumsum(lengths)[:-1]] = BEGIN
        return word, context >> CONTEXT_BITS, np.repeat(np.arange(len(lengths)), lengths)


def shard_of(word: np.ndarray, context: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    """Shards are ranges of word hashes; pairs of heavy words are spread by both hashes."""
    key = word.copy()
    spread = np.isin(word, heavy)
    key[spread] = mixed(word[spread] ^ mixed(context[spread]))
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """Tokens of the first column's texts; the other columns go along."""
    held = Tokens()
    for batch in batches:
        for part in pieces(batch, batch.schema.names[0]):
            held.add(part.column(0), part.select(list(range(1, part.num_columns))))
            if held.count >= CHUNK:
                yield held
                held = Tokens()
    if held.metas:
        yield held


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of hashes in their order, and how many there are."""
    codes, distinct = pd.factorize(hashes)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(distinct)] = np.arange(len(distinct))
    return rank[codes], len(distinct)


def grouped(tokens: Tokens, shards: int, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens in the order of shard, word, context and document, as ``(shard, word, context, document)``."""
    word, context, doc = tokens.pairs()
    (w, words), (v, contexts) = numbered(word), numbered(context)
    shard = shard_of(word, context, shards, heavy)
    order = np.argsort((shard * words + w) * contexts + v, kind="stable")
    return shard[order], word[order], context[order], doc[order]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Places at which any key changes."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _short(values: np.ndarray) -> bytes:
    """Small integers, compressed."""
    values = values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32)
    return bytes([values.itemsize]) + len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _long(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    kind = np.uint16 if size == 2 else np.uint32
    return np.frombuffer(pa.decompress(data[9:], n * size, codec="zstd", asbytes=True), kind).astype(np.int64)


def _contexts(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


#: A message: words, contexts of each word, contexts, and counts or documents of each pair.
MESSAGE = "shard long, chunk long, words binary, sizes binary, contexts binary, counts binary, docs binary, times binary, meta binary"


def message(shard: int, chunk: int, word: np.ndarray, context: np.ndarray, counts: np.ndarray, docs: bytes = b"", times: bytes = b"") -> tuple:
    """One row of ``MESSAGE`` for distinct pairs in order."""
    first = starts_of(word)
    sizes = np.diff(np.append(first, len(word)))
    return shard, chunk, word[first].tobytes(), _short(sizes), _contexts(context), _short(counts), docs, times, b""


def read(words: bytes, sizes: bytes, contexts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, place of each pair's word, contexts)``."""
    return np.frombuffer(words, np.uint64), np.repeat(np.arange(len(words) // 8), _long(sizes)), _wide(contexts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def heavy_words(texts: DataFrame, shards: int, n_bytes: int) -> np.ndarray:
    """Hashes of words that fill a shard on their own: those that do so in some chunk, as far as they do in all. At most ``HEAVY / 2`` a shard."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in chunks(batches):
            word, count = np.unique(np.concatenate(tokens.parts), return_counts=True)
            often = count * (HEAVY * shards) > tokens.count * 2  # a token has two bytes at least
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(count[often])], ["word", "n"])

    found = texts.mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * (HEAVY * shards) > n_bytes)
    return np.sort(np.array([r.word for r in found.collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, text_col: str = "text", mu: float = MU) -> Model:
    """The model of all rows of ``docs``.

    NULL and empty texts are documents of END alone; repeated rows count again. An empty table gives a model without words, in which every word has
    the unknown word's probability. Further columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes")).first()
    documents, n_bytes = size.n, size.bytes or 0
    shards = max(int(spark.sparkContext.defaultParallelism), -(-n_bytes // SHARD_BYTES))
    heavy = heavy_words(texts, shards, n_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in chunks(batches):
            shard, word, context, _ = grouped(tokens, shards, heavy)
            first = starts_of(shard, word, context)
            counts = np.diff(np.append(first, len(word)))
            shard, word, context = shard[first], word[first], context[first]
            cuts = [*starts_of(shard).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                yield _batch([message(int(shard[a]), 0, word[a:b], context[a:b], counts[a:b])])

    def build(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        word, context, count = [], [], []
        for words, sizes, contexts, counts in zip(*(table[c].to_pylist() for c in ("words", "sizes", "contexts", "counts"))):
            hashes, place, v = read(words, sizes, contexts)
            word.append(hashes[place])
            context.append(v)
            count.append(_long(counts))
        word, context, count = map(np.concatenate, (word, context, count))
        order = np.lexsort((context, word))
        word, context, count = word[order], context[order], count[order]
        first = starts_of(word, context)
        count = np.add.reduceat(count, first)
        word, context = word[first], context[first]
        trie = Trie.counted(word, context, count)
        own = ~np.isin(np.unique(word), heavy)
        shared = np.isin(word, heavy)
        spread, place = np.unique(word[shared], return_inverse=True)
        partial = np.bincount(place, count[shared], len(spread)).astype(np.int64)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        row = [shard, trie, int(count.sum()), int(own.sum()), spread.view(np.int64).tolist(), partial.tolist()]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["shard", "trie", "tokens", "words", "heavy", "partial"])

    sent = texts.mapInArrow(send, MESSAGE).select("shard", "words", "sizes", "contexts", "counts")
    counted = materialize(sent.groupBy("shard").applyInArrow(build, "shard long, trie binary, tokens long, words long, heavy array<long>, partial array<long>"), "counted-tries")
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    totals = counted.select(F.inline(F.arrays_zip("heavy", "partial"))).groupBy("heavy").agg(F.sum("partial").alias("n")).collect()
    by_hash = {np.int64(r.heavy).view(np.uint64): r.n for r in totals}
    hashes = np.sort(np.array(list(by_hash), np.uint64))
    model = Model(counted.select("shard", "trie"), shards, sums.tokens or 0, (sums.words or 0) + len(hashes), documents,
                  (hashes, np.array([by_hash[h] for h in hashes], np.int64)), mu)
    facts = Facts(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                trie = Trie(blob.as_buffer())
                prior = facts.prior(facts.counts(trie, trie.words.all(), np.arange(len(trie.words)), np.ones(len(trie.words), bool)))
                pointers = trie.pointers.all().astype(np.int64)
                logs = np.log10(trie.child_counts() + np.repeat(prior, np.diff(pointers)))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([trie.weighed(logs)], pa.binary())], ["shard", "trie"])

    tries = materialize(counted.select("shard", "trie").mapInArrow(weigh, "shard long, trie binary"), "tries")
    return Model(tries, shards, model.tokens, model.words, documents, model.heavy, mu)


class Facts:
    """The numbers of a model that tasks need."""

    def __init__(self, model: Model):
        self.mass, self.mu, (self.hashes, self.totals) = model.mass, model.mu, model.heavy

    def counts(self, trie: Trie, words: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Training counts of words; those of heavy words are totals over all shards."""
        out = np.where(known, trie.word_counts(place) if len(trie.words) else 0, 0)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == words, self.totals[at], out)
        return out

    def prior(self, counts: np.ndarray) -> np.ndarray:
        """``mu P(w)``."""
        return self.mu * (counts + 0.5) / self.mass


def answer(facts: Facts, trie: Trie, row: dict) -> tuple[np.ndarray, ...]:
    """``(document, base, score, known)`` sums of a message's tokens."""
    words, place, contexts = read(row["words"], row["sizes"], row["contexts"])
    at, known = trie.words.find(words)
    counts = facts.counts(trie, words, at, known)
    logs = np.log10(facts.prior(counts))[place]
    if len(trie.words):
        child, found = trie.find_children(at, known, place, contexts)
        logs[found] = trie.codebook[trie.codes[child[found]]]
    logs -= np.where(words == END, 0.0, np.log10(counts + facts.mu))[place]  # what follows this occurrence
    pair = np.repeat(np.arange(len(place)), _long(row["counts"]))
    docs, times = _long(row["docs"]), _long(row["times"]).astype(np.float64)
    token = place[pair]

    def total(each: np.ndarray) -> np.ndarray:
        return np.bincount(docs, times * each)

    there = np.flatnonzero(np.bincount(docs))
    return there, total(np.log10(counts + 0.5)[token])[there], total(logs[pair])[there], np.rint(total((counts > 0)[token])[there]).astype(np.int64)


ANSWER = "chunk long, docs binary, base binary, score binary, known binary, meta binary"


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities of the text) per row.

    NULL and empty texts are END alone; repeated rows are scored each; texts of any length are scored whole. The columns of the result replace kept ones
    of the same name. ``docs`` has to be a table as it is read, as lost tasks must meet the same rows again. An empty table gives an empty result.
    """
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in keep if c not in results]
    rows = docs.select(F.col(text_col).alias("__text"), *keep)
    shards, facts, heavy = model.shards, Facts(model), model.heavy[0]
    first, log_mass, tokens_seen = np.log10(model.documents + model.mu), np.log10(model.mass), model.tokens

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, tokens in enumerate(chunks(batches)):
            lengths = np.concatenate(tokens.lengths)
            meta = pa.Table.from_batches(tokens.metas).append_column("n_tokens", pa.array(lengths))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as writer:
                writer.write_table(meta)
            yield _batch([(-1 - base - k, base + k, *[b""] * 6, sink.getvalue().to_pybytes())])
            shard, word, context, doc = grouped(tokens, shards, heavy)
            entry = starts_of(shard, word, context, doc)
            times = np.diff(np.append(entry, len(word)))
            shard, word, context, doc = shard[entry], word[entry], context[entry], doc[entry]
            cuts = [*starts_of(shard).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                pair = starts_of(word[a:b], context[a:b])
                held = np.diff(np.append(pair, b - a))
                yield _batch([message(int(shard[a]), base + k, word[a:b][pair], context[a:b][pair], held, _short(doc[a:b]), _short(times[a:b]))])

    def reply(sent: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        trie = Trie(known["trie"][0].as_buffer()) if known.num_rows else Trie(Trie(Trie.counted(*[np.zeros(0, np.uint64)] * 3)).weighed(np.zeros(0)))
        for batch in sent.to_batches():
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["meta"]:
                    out.append((row["chunk"], b"", b"", b"", b"", row["meta"]))
                else:
                    there, base, total, seen = answer(facts, trie, row)
                    out.append((row["chunk"], _short(there), base.tobytes(), total.astype(np.float32).tobytes(), _short(seen), b""))
        names = [x.split()[0] for x in ANSWER.split(", ")]
        return pa.Table.from_arrays([pa.array(c, pa.int64() if n == "chunk" else pa.binary()) for n, c in zip(names, zip(*out))] if out else
                                    [pa.array([], pa.int64() if n == "chunk" else pa.binary()) for n in names], names)

    def add(table: pa.Table) -> pa.Table:
        metas = [m for m in table["meta"].to_pylist() if m]
        meta = pa.ipc.open_stream(metas[0]).read_all()
        n = meta.num_rows
        base, total, seen = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for row in table.select(["docs", "base", "score", "known"]).to_pylist():
            if row["docs"]:
                at = _long(row["docs"])
                base[at] += np.frombuffer(row["base"], np.float64)
                total[at] += np.frombuffer(row["score"], np.float32)
                seen[at] += _long(row["known"])
        lengths = meta["n_tokens"].to_numpy()
        out = meta.append_column("n_known", pa.array(seen)).append_column("train_tokens", pa.array(np.full(n, tokens_seen, np.int64)))
        return out.append_column("base_score", pa.array(base - lengths * log_mass)).append_column("score", pa.array(total - first))

    sent = rows.mapInArrow(send, MESSAGE)
    replies = sent.groupBy("shard").cogroup(model.tries.groupBy("shard")).applyInArrow(reply, ANSWER)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    schema = ", ".join([*kept, "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return replies.groupBy("chunk").applyInArrow(add, schema)
