"""Merkle manifest of a dataset by butterfly exchange.

The rows of a source, in the order of their ids, are the leaves of a tree of fanout 16; the roots of the sources are the leaves of
one more such tree. Leaves are dealt out in aligned blocks of 4,096, whose trees are hashed inside tasks. Then blocks swap roots round by round:
in a round, sixteen adjacent groups of blocks send their common root to one another, so that each block of each group
holds all sixteen, writes down the others as its next proof step, and hashes the parent itself. All blocks of a group hash
the same ancestors; in exchange no block waits for a pass down the tree: after the last round each holds its whole upper proof and the root.
A group of fewer blocks than its neighbours sends each of its copies to several partners. The sources' tree is climbed the same way,
with the blocks of whole sources as groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetcast.llm.ranks import ranked, running
from fleetcast.session import materialize

FANOUT = 16
INSIDE = 3  # levels hashed within a block, which has FANOUT ** INSIDE leaves
PROOF = "array<struct<at:int,siblings:binary>>"
SPREAD = 4096  # partners that one row of an exchange names at once


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest (32 bytes) of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(start: Column, proof: Column) -> Column:
    """The root (lowercase hex) that a leaf and a proof lead to: at each step the digest takes its place among its siblings."""
    def climb(acc: Column, step: Column) -> Column:
        text = hexed(step["siblings"])
        run = F.concat(F.substring(text, F.lit(1), step["at"] * 64), acc, F.substring(text, step["at"] * 64 + 1, F.length(text)))
        return F.sha2(run.cast("binary"), 256)
    return F.aggregate(proof, hexed(start), climb)


def siblings_of(proof: Column) -> Column:
    """All siblings of a proof as one lowercase hex text, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda s: hexed(s["siblings"])))


def _climb(leaves: list[bytes], count: int) -> tuple[list[list[bytes]], bytes]:
    """Levels of a block of a source of ``count`` leaves, below its top node, and that node."""
    levels, nodes = [], leaves
    for _ in range(INSIDE):
        if count <= 1:
            break
        levels.append(nodes)
        nodes = [hashlib.sha256(b"".join(nodes[i:i + FANOUT]).hex().encode()).digest() for i in range(0, len(nodes), FANOUT)]
        count = -(-count // FANOUT)
    return levels, nodes[0]


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("rank").combine_chunks()


def _block_node(table: pa.Table) -> pa.Table:
    table = _sorted(table)
    _, node = _climb(table["leaf"].to_pylist(), table["count"][0].as_py())
    head = table.slice(0, 1).select(["b", "first", "k", "blocks", "source_rank"])
    return head.append_column("node", pa.array([node], pa.binary()))


def _with_proofs(table: pa.Table, upper: pa.Table) -> pa.Table:
    table = _sorted(table)
    levels, _ = _climb(table["leaf"].to_pylist(), table["count"][0].as_py())
    above = upper["upper"][0].as_py()
    runs = [[b"".join(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)] for level in levels]
    at, siblings = [], []
    for i in range(table.num_rows):
        for run in runs:
            i, place = divmod(i, FANOUT)
            at.append(place)
            siblings.append(run[i][:32 * place] + run[i][32 * place + 32:])
        for step in above:
            at.append(step["at"])
            siblings.append(step["siblings"])
    steps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(siblings, pa.binary())], ["at", "siblings"])
    offsets = np.arange(table.num_rows + 1, dtype=np.int32) * (len(runs) + len(above))
    for name in ("subroot", "root"):
        table = table.append_column(name, pa.array([upper[name][0].as_py()] * table.num_rows, pa.string()))
    return table.append_column("proof", pa.ListArray.from_arrays(pa.array(offsets), steps))


def _swap(state: DataFrame, peers: Column, active: Column) -> DataFrame:
    """One round. ``peers`` are the groups of a row's parent, ``array<struct<at, first, m, mine>>`` in order; rows that are not active keep their node."""
    me = F.filter(peers, lambda p: p["mine"])[0]
    rows = state.select("*", active.alias("active"), me["at"].alias("my_at"), me["first"].alias("my_first"), me["m"].alias("my_m"),
                        F.inline(F.when(active, peers).otherwise(F.array(me))).alias("peer_at", "peer_first", "peer_m", "peer_mine"))
    q, m, top = F.col("b") - F.col("my_first"), F.col("my_m"), F.col("peer_m")
    # every m-th partner from q on, named in stretches, so that one row of a small group does not name millions at once
    rows = rows.withColumn("from", F.explode(F.when(q < top, F.sequence(q, top - 1, m * SPREAD))))
    rows = rows.withColumn("to", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + m * (SPREAD - 1), top - 1), m)))
    rows = rows.withColumn("to", F.col("to") + F.col("peer_first"))
    own = F.when(F.col("to") == F.col("b"), F.struct("first", "k", "blocks", "source_rank", "subroot", "upper", "active", F.col("my_at").alias("at")))
    got = rows.groupBy(F.col("to").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("my_at").alias("at"), "node"))).alias("run"), F.first(own, ignorenulls=True).alias("own"))
    text = F.concat_ws("", F.transform("run", lambda x: hexed(x["node"])))
    others = F.unhex(F.concat_ws("", F.transform(F.filter("run", lambda x: x["at"] != F.col("own.at")), lambda x: F.hex(x["node"]))))
    step = F.array(F.struct(F.col("own.at").cast("int").alias("at"), others.alias("siblings")))
    return got.select(
        "b", "own.first", "own.k", "own.blocks", "own.source_rank", "own.subroot",
        F.when(F.col("own.active"), F.unhex(F.sha2(text.cast("binary"), 256))).otherwise(F.col("run")[0]["node"]).alias("node"),
        F.when(F.col("own.active"), F.concat("own.upper", step)).otherwise(F.col("own.upper")).alias("upper"))


def _levels(count: int) -> int:
    n = 0
    while count > 1:
        count, n = -(-count // FANOUT), n + 1
    return n


def _up_a_source(state: DataFrame, rounds: int) -> DataFrame:
    """Rounds among the blocks of a source; afterwards every block has the source's root as ``node``."""
    for r in range(rounds):
        span = FANOUT ** r
        groups = F.ceil(F.col("blocks") / span)
        mine = F.floor(F.col("k") / span)
        start = F.floor(mine / FANOUT) * FANOUT
        peers = F.transform(F.sequence(start, F.least(start + FANOUT, groups) - 1), lambda j: F.struct(
            (j % FANOUT).alias("at"), (F.col("first") + j * span).alias("first"), F.least(F.lit(span).cast("long"), F.col("blocks") - j * span).alias("m"), (j == mine).alias("mine")))
        state = _swap(state, peers, groups > 1)
    return state


def _up_the_sources(state: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """Rounds among groups of whole sources."""
    for r in range(rounds):
        span = FANOUT ** r
        groups = sources.groupBy(F.floor(F.col("source_rank") / span).alias("g")).agg(F.min("first").alias("first"), F.sum("blocks").alias("m"))
        families = groups.groupBy(F.floor(F.col("g") / FANOUT).alias("family")).agg(F.sort_array(F.collect_list(F.struct("g", "first", "m"))).alias("members"))
        joined = state.withColumn("family", F.floor(F.col("source_rank") / (span * FANOUT))).join(families, "family")
        mine = F.floor(F.col("source_rank") / span)
        peers = F.transform("members", lambda x: F.struct((x["g"] % FANOUT).alias("at"), x["first"].alias("first"), x["m"].alias("m"), (x["g"] == mine).alias("mine")))
        state = _swap(joined, peers, F.lit(True))
    return state


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``rank``, ``source_rank``, ``subroot``, ``root`` (hex) and ``proof``, steps of own place and sibling digests, from the leaf to the root.

    ``leaves`` has ``source``, ``id`` and ``leaf`` (32 bytes); further columns, whatever their names, come back in one struct ``more``. NULL is a
    source of its own, before all others; NULL ids come first in a source. Rows that repeat an id are ordered by their digest; repeated rows are leaves
    of their own. The length of texts does not matter here. A lone leaf is its source's root, a lone source's root is the root; an empty table has no rows.
    """
    more = [c for c in leaves.columns if c not in ("source", "id", "leaf")]
    leaves = leaves.select("source", "id", "leaf", *([F.struct(*more).alias("more")] if more else []))
    placed = ranked(leaves, ["source"], ["id", "leaf"], "leaves")
    counts = placed.groupBy("source").agg((F.max("rank") + 1).alias("count"))
    sources = ranked(counts, [], ["source"], "sources").withColumn("blocks", F.ceil(F.col("count") / FANOUT ** INSIDE))
    sources = materialize(running(sources, "blocks", "first").withColumnRenamed("rank", "source_rank"), "source-table")
    top = sources.agg(F.max("blocks").alias("blocks"), F.count("*").alias("sources")).first()
    facts = sources.withColumnRenamed("source", "__source")
    rows = placed.join(facts, placed["source"].eqNullSafe(facts["__source"])).drop("__source").withColumn("k", F.floor(F.col("rank") / FANOUT ** INSIDE))
    rows = materialize(rows.withColumn("b", F.col("first") + F.col("k")), "placed")
    blocks = rows.select("b", "first", "k", "blocks", "source_rank", "rank", "count", "leaf").groupBy("b").applyInArrow(
        _block_node, "b long, first long, k long, blocks long, source_rank long, node binary")
    state = materialize(blocks, "blocks").withColumn("subroot", F.lit(None).cast("binary")).withColumn("upper", F.array().cast(PROOF))
    state = _up_a_source(state, _levels(top.blocks or 0)).withColumn("subroot", F.col("node"))
    state = _up_the_sources(state, sources, _levels(top.sources))
    state = materialize(state.select(F.col("b").alias("block"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("node")).alias("root"), "upper"), "uppers")
    kept = [f for f in rows.schema.fields if f.name not in ("first", "k", "blocks")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["subroot string", "root string", f"proof {PROOF}"])
    whole = rows.select([f.name for f in kept]).groupBy("b").cogroup(state.groupBy("block")).applyInArrow(_with_proofs, schema)
    return whole.drop("b", "count")


def lowered(text: Column) -> Column:
    """A-Z in lower case: the change that the query tampers with."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of documents, and what a check against rows with changed texts says.

    Rows whose id has a CRC-32 divisible by five get their text in lower case before they are checked; a NULL id is not among them. NULL and empty values differ.
    """
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("source", F.col("doc_id").alias("id"), leaf(c).alias("leaf"),
                         F.when(changed & F.col("text").isNotNull(), leaf([*c[:4], lowered(c[4])])).alias("seen"))
    whole = manifest(leaves).withColumn("folded_root", fold(F.coalesce("more.seen", "leaf"), F.col("proof")))
    return whole.select(F.col("id").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), "subroot", "root",
                        F.sha2(siblings_of(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

