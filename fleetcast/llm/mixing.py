"""Mixing sources to target weights by Poisson replication.

A source with target share ``w`` and present size ``s`` has the mean repetition rate ``w * total / s``. Every document
inverts the Poisson distribution of that mean at a number drawn from a hash of its content, is exploded by the count,
and all copies are put into one global random order. Counts do not depend on partitioning, and a document's count
changes only if its source's rate does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEP = 16.0  # a larger mean is a sum of independent Poisson variables of at most this mean
TERMS = 96  # of the distribution: for a mean of 16 the rest is below 1e-30
SEED = 20


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(2**53))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, epochs: float = 1.0,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, bytes, rate, parts, cdf)``, one row per source.

    ``weights`` gives target shares of the bytes; a source it leaves out has weight 0. Without it, the share is proportional to
    ``bytes ** exponent``. The result has about ``epochs`` times the bytes of the input. NULL is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("double")).alias("bytes"))
    if weights is None:
        raw = F.when(F.col("bytes") > 0, F.pow("bytes", F.lit(exponent))).otherwise(0.0)
    else:
        raw = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    weighed = sizes.withColumn("raw", raw)
    total = weighed.agg(F.sum("bytes").alias("all_bytes"), F.sum("raw").alias("all_raw"))
    rate = F.when(F.col("bytes") > 0, F.col("raw") / F.col("all_raw") * F.col("all_bytes") * epochs / F.col("bytes")).otherwise(float(epochs))
    found = weighed.crossJoin(F.broadcast(total)).select("source", "bytes", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # total is one row
    found = found.withColumn("parts", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    grow = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf")))
    return found.withColumn("cdf", grow["cdf"])


def copies(key: Column, parts: Column, cdf: Column, seed: int = SEED) -> Column:
    """How often a row appears: for each part the number of distribution values at or below its uniform number."""
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), j, key)))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, j: acc + draw(j))


def replicate(docs: DataFrame, table: DataFrame, columns: list[str], seed: int = SEED, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``columns`` of every copy with ``mix_copy`` (from 1), ``mix_copies``, ``mix_rate`` and ``mix_order``, not yet in order.

    Rows that repeat an id with an equal text draw the same count. NULL texts, ids and sources take part like others.
    The table of rates has one row per source; the optimizer broadcasts it only under its size limit, and else joins by
    source, where adaptive execution splits a large source.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    drawn = docs.join(table.select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), F.col("parts").alias("mix_parts"), F.col("cdf").alias("mix_cdf")),
                      F.col(source_col).eqNullSafe(F.col("mix_source")))
    drawn = drawn.select(*columns, "mix_rate", key.alias("mix_key"), copies(key, F.col("mix_parts"), F.col("mix_cdf"), seed).alias("mix_copies"))
    several = drawn.filter("mix_copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    return several.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), F.col("mix_key"), F.col("mix_copy"))).drop("mix_key")


def shuffled(mixed: DataFrame) -> DataFrame:
    """Global random order. The key is a uniform hash, so equal ranges of it are even: its high bits name the partition, which is then sorted."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor((F.shiftright("mix_order", 32) + F.lit(2**31)) * n / F.lit(2.0**32)).cast("int")
    return mixed.repartitionById(n, place).sortWithinPartitions("mix_order")
