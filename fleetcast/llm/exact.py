"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed size. The distinct blocks are sorted and their places become integer names;
names of adjacent blocks form pairs, the distinct pairs get names, and so on until each text has one name. Equal
names at equal depth mean equal texts: names are handed out to whole contents, never to hashes.

Contents cross the network once, when distinct blocks are gathered. Rows find the name of a block by a 128-bit
digest of its content, and a digest is only used after a count has shown that no two distinct blocks share it;
if any do, the digests are taken again with another salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetcast.session import materialize

BLOCK = 16384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: str) -> Column:
    """Text with A-Z in lower case; NULL counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def blocks(content: Column, size: int) -> Column:
    """Binary pieces of ``size`` bytes; the last one may be shorter, an empty content is one empty piece."""
    last = F.greatest(F.ceil(F.octet_length(content) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * size + 1, F.lit(size)))


def digest(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(salt), block).alias("a"), F.xxhash64(block, F.lit(salt + 1)).alias("b"))


def _named(distinct: DataFrame, order: list[str], keep: list[str], label: str) -> DataFrame:
    """Names in sorted order within each hash partition; written, so that they are the same for every reader."""
    return materialize(distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name")), label)


def _block_names(texts: DataFrame, size: int, salt: int) -> DataFrame | None:
    pieces = texts.select(F.explode(blocks(F.col("content"), size)).alias("block")).select("block", digest(F.col("block"), salt).alias("d"))
    names = _named(pieces.distinct(), ["block"], ["d"], "block-names")
    return None if names.groupBy("d").count().filter("count > 1").head(1) else names


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """``(row, id, text_sha256, depth, name)``: rows have equal ``(depth, name)`` exactly if their normalised texts are equal.

    ``row`` numbers the rows, so NULL or repeated ids do no harm. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalized(text_col).cast("binary").alias("content"))
    salt = 0
    while True:
        rows = materialize(texts.select(
            F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.sha2("content", 256)).alias("sha"),
            F.transform(blocks(F.col("content"), size), lambda b: digest(b, salt)).alias("digests")), "blocks")
        names = _block_names(texts, size, salt)
        if names is not None:
            break
        salt += 2
    parts = rows.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("at", "d")).join(names, "d").select("row", "n", "at", "name")
    done, depth = [], 0
    longest = rows.agg(F.max(F.size("digests"))).first()[0] or 0
    while True:
        parts = materialize(parts, "names")
        done.append(parts.filter("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
        if longest <= 1:
            break
        pairs = parts.filter("n > 1").groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
            F.first("n").alias("n"), F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("x"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("y"))
        pairs = materialize(pairs, "pairs")
        named = _named(pairs.select("x", "y").distinct(), ["x", "y"], ["x", "y"], "pair-names")
        parts = pairs.join(named, ["x", "y"]).select("row", F.ceil(F.col("n") / 2).alias("n"), "at", "name")
        depth, longest = depth + 1, (longest + 1) // 2
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.select("row", "id", "sha").join(found, "row").select("row", "id", F.lower(F.hex("sha")).alias("text_sha256"), "depth", "name")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``; the row with the largest id of equal texts stays.

    NULL text counts as empty and equals it. A NULL id is smaller than any other; of rows that repeat an id with an
    equal text one stays. Other columns of ``docs`` are not read.
    """
    rows = materialize(identities(docs, id_col, text_col, size), "identities")
    groups = rows.groupBy("depth", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return rows.join(groups, ["depth", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
