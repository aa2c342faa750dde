"""Conversation repair, language model and Merkle manifest against brute force, and their special cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast.llm import dialogue, lm, merkle, ranks, trie
from fleetcast.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- places

def test_ranks_and_running_sums(spark):
    rows = [(None if g == 3 else f"g{g}", i % 7 if i % 11 else None, i) for g in range(4) for i in range(50 + 400 * (g == 1))]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], ["v"], "t").collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.rank, -1 if r.v is None else r.v) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)
    placed = spark.range(1000).select(F.col("id").alias("rank"), (F.col("id") % 5 + 1).alias("w"))
    assert {r.rank: r.before for r in ranks.running(placed, "w", "before").collect()} == {i: sum(j % 5 + 1 for j in range(i)) for i in range(1000)}


# --- conversations

def crc(x) -> int:
    return zlib.crc32(x.encode())


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def mended(rows):
    """The whole row of one conversation, by a table of the cheapest and first edits for each state."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in "ua":
                    if (state, role) in follow:
                        new = (cost + 2, audit + "I", lines + [names[role] + ":"])
                        best[role] = min(best.get(role, (math.inf, "", [])), new, key=lambda x: x[:2])
        return best

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def put(state, new):
            after[state] = min(after.get(state, (math.inf, "", [])), new, key=lambda x: x[:2])

        for state, (cost, audit, lines) in inserts(best).items():
            put(state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, role[:1]) in follow:
                    put(follow[state, role[:1]], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                for r in "ua":
                    if (state, r) in follow:
                        put(r, (cost + 2 + extra, audit + "R", lines + [f"{names[r]}:{text}"]))
        best = after
    best = inserts(best)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [(x[2][:1] + y[2][:1]) for x, y in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_mended(rows):
    damaged = hurt(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        out[conv] = mended([r for r in damaged if r[0] == conv])
    return out


def test_repair_of_given_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_auction_repair"](spark, folder).collect()}
    assert got == all_mended(rows) and len(got) > 10


CONV = "conv_id long, turn long, role string, text string, conv string, at int, rank string, code string"


def test_repair_of_odd_conversations(spark):
    rng = np.random.default_rng(5)
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "User"]
    texts = ["Yes.", "no", "  ", "", None, "What?", "half a ", "end. \t\n", "x!" * 3]
    rows = [(c, None if rng.random() < 0.05 else int(t), roles[rng.integers(8) if rng.random() < 0.4 else rng.integers(3)], texts[rng.integers(9)])
            for c in range(60) for t in rng.integers(0, 12, rng.integers(1, 12))]
    rows += [(None, int(t), "user", "Null conversation.") for t in range(4)] + [(777, 0, "user", "y" * 300_000 + "."), (777, 1, "assistant", "z" * 300_000)]
    # more turns than a stretch of stretches holds
    rows += [(999, int(t), roles[rng.integers(3)], f"{t} {texts[rng.integers(9)]}") for t in range(1500)]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(64)]
    frame = spark.createDataFrame([(*r, "q", 1, "w", "e") for r in rows], CONV)
    got = {r[0]: tuple(r)[1:] for r in dialogue.repair(dialogue.damaged(frame).drop("twin"), frame).collect()}
    want = all_mended(rows)
    assert got.keys() == want.keys()
    assert not [(k, got[k], want[k]) for k in want if got[k] != want[k]]
    empty = spark.createDataFrame([], CONV)
    assert dialogue.repair(dialogue.damaged(empty).drop("twin"), empty).count() == 0


def test_conversations_without_rows(spark):
    lost = [c for c in range(200) if crc(f"{c}:0") % 20 == 0]
    frame = spark.createDataFrame([(c, 0, "user", "Hm.") for c in lost], "conv_id long, turn long, role string, text string")
    got = dialogue.repair(dialogue.damaged(frame).drop("twin"), frame).collect()
    assert len(got) == len(lost) > 0 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_auction_prices():
    arcs = {0: [(1, "a", 1), (4, "b", 2)], 1: [(2, "a", 2), (6, "c", 3)], 2: [(3, "a", 3)], 3: []}
    price: dict[int, int] = {}
    assert dialogue.auction(arcs.__getitem__, 0, 3, price) == 6
    assert all(price.get(i, 0) <= c + price.get(j, 0) for i, out in arcs.items() for c, _, j in out)
    assert dialogue.tight_path(arcs.__getitem__, 0, 3, price) == "aaa"


# --- language model

@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 1, 2, 700, 2**40], list(range(0, 90_000, 7)), [2**63, 2**64 - 1]])
def test_elias_fano(values):
    seq = trie.EliasFano(trie.EliasFano.encode(np.array(values, np.uint64)))
    assert seq.all().tolist() == values
    rng = np.random.default_rng(1)
    probes = np.unique(np.concatenate([np.array([0, 1, 2**62], np.uint64), np.array(values, np.uint64), rng.integers(0, 10**5, 300).astype(np.uint64)]))
    assert seq.successor(probes).tolist() == np.searchsorted(np.array(values, np.uint64), probes).tolist()


def test_trie_finds_pairs(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0).astype(np.uint64) * np.uint64(2**57)
    counts = rng.integers(1, 9, len(pairs))
    blob = trie.Trie.counted(pairs[:, 0], pairs[:, 1], counts)
    (tmp_path / "t").write_bytes(trie.Trie(blob).weighed(np.log10(counts)))
    there = trie.Trie.mapped(str(tmp_path / "t"))
    known = {tuple(p): c for p, c in zip(pairs.tolist(), counts.tolist())}
    probes = rng.integers(0, 64, (2000, 2)).astype(np.uint64) * np.uint64(2**57)
    place, word_known = there.words.find(probes[:, 0])
    child, found = there.find_children(place, word_known, np.arange(len(probes)), probes[:, 1])
    assert found.tolist() == [tuple(p) in known for p in probes.tolist()]
    logs = there.codebook[there.codes[child[found]]]
    assert np.allclose(logs, [math.log10(known[tuple(p)]) for p in probes[found].tolist()])
    assert trie.Trie(blob).child_counts().tolist() == counts.tolist()


def test_quantised_bins():
    values = np.random.default_rng(3).normal(size=20_000)
    codes, book = trie.quantised(values)
    assert np.abs(book[codes] - values).mean() < 0.02 and len(np.unique(codes)) == 256


def words(text):
    return "".join(" " if c in SPACES else c for c in (text or "").translate(LOWER)).split(" ")


def tokens(text):
    return [w for w in words(text) if w] + [None]


def brute_scores(texts, learned, mu=lm.MU):
    uni, pair, ctx = Counter(), Counter(), Counter()
    for t, use in zip(texts, learned):
        if use:
            ts = tokens(t)
            uni.update(ts)
            pair.update(zip([0, *ts], ts))
            ctx.update([0, *ts[:-1]])
    n, v = sum(uni.values()), len(uni)
    mass = n + 0.5 * (v + 1)
    out = []
    for t in texts:
        ts = tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / mass) for w in ts)
        full = sum(math.log10((pair[u, w] + mu * (uni[w] + 0.5) / mass) / (ctx[u] + mu)) for u, w in zip([0, *ts], ts))
        out.append((len(ts), sum(uni[w] > 0 for w in ts), n, base, full))
    return out


def test_model_of_given_documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    held = [crc(str(r.doc_id)) % 5 == 1 for r in rows]
    want = dict(zip([r.doc_id for r in rows], brute_scores([r.text for r in rows], [not h for h in held])))
    got = {r.doc_id: r for r in QUERIES["op12_elias_fano_lm"](spark, folder).collect()}
    assert got.keys() == want.keys()
    for (doc, (n, known, total, base, full)), h in zip(want.items(), held):
        r = got[doc]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, h)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(full, rel=2e-3, abs=0.02 * math.sqrt(n))
    assert sum(r.score > r.base_score for r in got.values()) > 0.9 * len(got)


DOCS = "doc_id long, text string, n_tokens string, score string, word int, shard string, chunk int, meta string"


@pytest.mark.parametrize("chunk, heavy", [(1, 24), (50, 10**9), (10**6, 24)])
def test_model_special_cases(spark, monkeypatch, chunk, heavy):
    """Small chunks, and every word spread over the shards, change no result."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "HEAVY", heavy)
    texts = ["a a b a", "A\tB\x0bc", None, "", "  \n", "new words only", "a a b a", "é É", "x " * 30_000, "b a", "b a b a b a b a"]
    learned = [True, True, True, True, True, False, True, True, False, True, True]
    frame = spark.createDataFrame([(i if i else None, t, "n", "s", 1, "h", 2, "m") for i, t in enumerate(texts)], DOCS)
    model = lm.fit(frame.filter(F.coalesce("doc_id", F.lit(0)).isin([i for i, u in enumerate(learned) if u])))
    assert heavy != 10**9 or len(model.heavy[0]) > 3
    got = lm.score(frame, model, ["doc_id", "score", "word", "chunk"])
    assert got.columns == ["doc_id", "word", "chunk", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r.doc_id or 0: r for r in got.collect()}
    for i, (n, known, total, base, full) in enumerate(brute_scores(texts, learned)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(full, rel=1e-5)
    assert lm.score(frame.limit(0), model, ["doc_id"]).count() == 0
    blank = lm.fit(frame.limit(0))
    assert (blank.tokens, blank.words, blank.documents) == (0, 0, 0)
    lone = lm.score(frame.filter("doc_id = 1"), blank, ["doc_id"]).first()
    assert (lone.n_known, lone.train_tokens, lone.base_score) == (0, 0, 0.0) and lone.n_tokens == 4


# --- manifest

def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves, fanout):
    """``(root, proofs)``: a proof is a list of (place, siblings)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for p, k in zip(proofs, at):
            run = runs[k // fanout]
            p.append((k % fanout, run[:k % fanout] + run[k % fanout + 1:]))
        at, nodes = [k // fanout for k in at], [digest(r) for r in runs]
    return nodes[0], proofs


def brute_manifest(rows, fanout=16):
    by_source: dict = {}
    for doc_id, source, lang, n_chars, text in rows:
        changed = doc_id is not None and crc(str(doc_id)) % 5 == 0
        seen = text.translate(LOWER) if changed and text is not None else text
        leaf, other = (digest(map(field, (doc_id, source, lang, n_chars, t))) for t in (text, seen))
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort()
        trees[s] = tree([x[2] for x in by_source[s]], fanout)
    root, above = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, above):
        for (_, _, leaf, other, doc_id), inner in zip(by_source[s], trees[s][1]):
            acc = other
            for at, others in inner + up:
                acc = digest([*others[:at], acc, *others[at:]])
            out.append((doc_id, leaf, trees[s][0], root, digest(x for _, o in inner + up for x in o), acc, acc == root))
    return sorted(out, key=str)


LEAF = "doc_id long, source string, lang string, n_chars long, text string, leaf string, b int, first int, subroot string, more int"


@pytest.mark.parametrize("fanout, inside", [(16, 3), (2, 1), (3, 2)])
def test_manifest(spark, monkeypatch, fanout, inside):
    """Small fanouts give many rounds, ragged groups and sources of all sizes."""
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "INSIDE", inside)
    monkeypatch.setattr(merkle, "SPREAD", 2)
    rows = [(i, f"s{i % 7}" if i % 3 else "big", "en", i * 3, f"Text {i}") for i in range(140)]
    rows += [(1000, None, None, None, None), (None, "big", None, 4, "No id"), (5, "big", "en", 1, ""), (5, "big", "en", 1, ""), (1001, "", "fr", 2, "É" * 50_000), (1003, "lone", "x", 0, "ALL CAPS")]
    frame = spark.createDataFrame([(*r, "l", 1, 2, "s", 3) for r in rows], LEAF)
    got = sorted((tuple(r) for r in merkle.audit(frame).collect()), key=str)
    assert got == brute_manifest(rows, fanout)
    assert 0 < sum(not r[-1] for r in got) < len(rows)
    assert merkle.audit(frame.limit(0)).count() == 0
    lone = merkle.audit(frame.filter("doc_id = 1003")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == hashlib.sha256(b"").hexdigest()
    leaves = frame.select("source", F.col("doc_id").alias("id"), merkle.leaf([F.col("doc_id"), F.col("text")]).alias("leaf"), "b", F.lit(1).alias("rank"))
    whole = merkle.manifest(leaves)
    assert whole.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0 and whole.select("more.b", "more.rank").count() == len(rows)
