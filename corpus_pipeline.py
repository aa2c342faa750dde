"""Corpus pipeline: toxic documents go, one document of each group of similar ones stays, benchmark leaks go, sources are mixed, shards are dealt.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next one's ``docs``.
All but the last return the columns of ``docs``; the last adds ``shard``, ``slot`` and ``virtual_slot``. Every stage takes NULLs in any column,
empty texts, repeated rows and empty tables; the operators' docstrings state what happens to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetcast.llm import decontaminate, jaccard, mixing, sharding, toxicity
from fleetcast.session import materialize, scratch_folder

SHARDS = 24


def whole(docs: DataFrame, *names: str) -> DataFrame:
    """Rows of ``docs`` in one column ``row``, beside the columns named, so that no column of theirs can meet one that an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("row"), *names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; a fifth of the labels, by hash of the id, is not learned.

    Repeated rows are judged alike, NULL and empty texts like a text without known words; empty tables pass as they are.
    """
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    net = toxicity.fit(docs.filter(learned), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learned))
    return toxicity.classify(whole(docs, "text"), net, ["row"]).filter(F.col("predicted") == 0).select("row.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar five-word shingle sets (Jaccard 0.8 or more).

    NULL, empty and blank texts are similar to nothing and all stay; of rows that repeat an id and a text one stays; a NULL id goes before any other.
    """
    return jaccard.representatives(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised. NULL and empty texts hold none; repeated rows stay or go together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that a source's share of the bytes is proportional to the square root of its bytes, in random order.

    NULL is a source; empty texts count their overhead of no bytes; repeated rows draw their copies alike.
    """
    rows = whole(docs, "doc_id", "text", "source")
    table = materialize(mixing.rates(rows), "rates")
    return mixing.shuffled(mixing.replicate(rows, table, ["row"])).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of near equal bytes, its place in the shard and its virtual slot, which replace columns of these names.

    NULL and empty texts have a size of eight bytes; repeated rows share a virtual slot and get places of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    added = ("shard", "slot", "virtual_slot")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in added]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"),
                       sharding.slot_of([F.col("doc_id"), F.col("text")]).alias("vslot"), (F.octet_length(text) + sharding.ROW_OVERHEAD).cast("long").alias("size"))
    sizes = materialize(sharding.slot_sizes(rows), "slot-sizes")
    placed = sharding.assign(rows, sharding.balanced(sizes, SHARDS, scratch_folder(spark, "slot-map")), sizes, [F.col("id"), F.col("th")])
    return placed.select("row.*", "shard", "slot", F.col("vslot").alias("virtual_slot"))


STAGES = [("toxicity", drop_toxic), ("jaccard join", drop_similar), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
