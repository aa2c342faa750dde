"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetcast.llm import decontaminate, dialogue, exact, html, jaccard, langid, lm, merkle, mixing, pii, sharding, suffixes, toxicity
from fleetcast.session import materialize, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def crc_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters as an expression that DuckDB knows."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda z: ord(z)::BIGINT)), lambda c, b: {bits}), 4294967295)"


@query
def op1_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket(3) == 1)
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


@query
def op2_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similar 4-word shingle sets."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op3_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, by an even first map and its edited second version."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + sharding.ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        sharding.slot_of([F.col("doc_id"), F.col("text")]).alias("vslot")), "slots")
    sizes = materialize(sharding.slot_sizes(rows), "slot-sizes")
    placed = sharding.assign(rows, sharding.balanced(sizes, 24, scratch_folder(spark, "slot-map")), sizes, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         F.col("vslot").alias("virtual_slot"))


@query
def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered_words", "item_words", "kind")


@query
def op5_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, plain and disguised."""
    return pii.find(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op6_stretch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights learned from pages that mark their article."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.learn(pages), ["page_id", "url"])


@query
def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, in the order of the mix: shares proportional to the square root of a source's bytes."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.replicate(docs, materialize(mixing.rates(docs), "rates"), ["doc_id", "source", F.octet_length("text").alias("n_bytes")])
    return mixing.shuffled(mixed).select("doc_id", "source", "n_bytes", F.col("mix_copy").alias("copy"), F.col("mix_copies").alias("copies"),
                                         F.col("mix_rate").alias("rate"), F.col("mix_order").alias("position"))


@query
def op8_sampled_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a smaller document, over at least 50 bytes."""
    return suffixes.dedup(table(spark, sf_dir, "documents"))


@query
def op9_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts."""
    return exact.dedup(table(spark, sf_dir, "documents"))


ORACLES["op9_block_names"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{exact.UPPER}', '{exact.LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""


@query
def op10_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket(5) == 0)
    net = toxicity.fit(docs.filter("NOT held_out"), table(spark, sf_dir, "labels").filter(bucket(5) != 0))
    return toxicity.classify(docs, net, ["doc_id", "held_out"])


@query
def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair to a legal order of roles."""
    rows = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damaged(rows).drop("twin"), rows)


@query
def op12_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a model of four fifths of them, and under single words."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket(5) == 1)
    model = lm.fit(docs.filter(~F.coalesce("held_out", F.lit(False))))
    return lm.score(docs, model, ["doc_id", "held_out"])


@query
def op13_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the row as found still folds to the root."""
    return merkle.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_butterfly_manifest"] = f"""
WITH RECURSIVE field AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, '{exact.UPPER}', '{exact.LOWER}') AS low FROM documents),
d AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low FROM field)),
inner_nodes AS (
  SELECT source, 0 AS lvl, r, leaf AS h, n FROM d
  UNION ALL
  SELECT source, lvl + 1, r // 16, sha256(string_agg(h, '' ORDER BY r)), (n + 15) // 16 FROM inner_nodes WHERE n > 1 GROUP BY source, lvl, r // 16, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 1000 AS lvl, r, h, n FROM s
  UNION ALL
  SELECT lvl + 1, r // 16, sha256(string_agg(h, '' ORDER BY r)), (n + 15) // 16 FROM outer_nodes WHERE n > 1 GROUP BY lvl, r // 16, n),
path AS (
  SELECT d.doc_id, d.leaf, CASE WHEN {crc_sql('CAST(d.doc_id AS VARCHAR)')} % 5 = 0 THEN d.low ELSE d.leaf END AS seen, d.r, s.r AS sr, s.h AS subroot, d.source FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
sib AS (
  SELECT p.doc_id, p.leaf, i.lvl, i.r, i.h, i.r = p.r // CAST(power(16, i.lvl) AS BIGINT) AS own
  FROM path p JOIN inner_nodes i ON p.source IS NOT DISTINCT FROM i.source AND i.n > 1 AND i.r // 16 = p.r // CAST(power(16, i.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, o.lvl, o.r, o.h, o.r = p.sr // CAST(power(16, o.lvl - 1000) AS BIGINT)
  FROM path p JOIN outer_nodes o ON o.n > 1 AND o.r // 16 = p.sr // CAST(power(16, o.lvl - 999) AS BIGINT)),
step AS (
  SELECT doc_id, leaf, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lvl) AS k, coalesce(string_agg(h, '' ORDER BY r) FILTER (NOT own AND r < mine), '') AS lo,
    coalesce(string_agg(h, '' ORDER BY r) FILTER (NOT own AND r > mine), '') AS hi
  FROM (SELECT *, max(r) FILTER (own) OVER (PARTITION BY doc_id, leaf, lvl) AS mine FROM sib) GROUP BY doc_id, leaf, lvl),
fold AS (
  SELECT doc_id, leaf, 0 AS k, seen AS h FROM path
  UNION ALL
  SELECT f.doc_id, f.leaf, f.k + 1, sha256(x.lo || f.h || x.hi) FROM fold f JOIN step x ON f.doc_id IS NOT DISTINCT FROM x.doc_id AND f.leaf = x.leaf AND x.k = f.k + 1),
proof AS (SELECT doc_id, leaf, sha256(string_agg(lo || hi, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY doc_id, leaf),
last AS (SELECT doc_id, leaf, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, p.subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM path p CROSS JOIN (SELECT h FROM outer_nodes WHERE n = 1) root
JOIN last ON p.doc_id IS NOT DISTINCT FROM last.doc_id AND p.leaf = last.leaf
LEFT JOIN proof ON p.doc_id IS NOT DISTINCT FROM proof.doc_id AND p.leaf = proof.leaf"""
