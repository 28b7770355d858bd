"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealgrid.llm.common import land

#: A rate table is broadcast up to this many sources and distribution entries together; a larger one joins by salted source.
BROADCAST_ENTRIES = 1_000_000
SALTS = 32


def _row_key() -> Column:
    """What a document's draws hang on: its id, or its text where the id is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, from the first 52 bits of the parts' MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """Per source: its characters, weight and mean repetition rate (source, chars, weight, rate).

    A source's rate is epochs * (its share of the weights) / (its share of the characters), so the expected volume of
    each source follows the weights and the whole has `epochs` times the input's volume. Each document counts one
    character more than it has, so a source of empty texts has a rate too. A null source is the source named ''.
    """
    source = F.coalesce(F.col("source"), F.lit(""))
    stats = docs.groupBy(source.alias("_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars"))
    weight = F.lit(float(default_weight))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(weight)
    stats = land(stats.withColumn("weight", weight), "sources")
    total = stats.agg(F.sum("chars").alias("c"), F.sum("weight").alias("w")).first()
    chars, mass = float(total["c"] or 1), float(total["w"] or 1) or 1.0
    return stats.withColumn("rate", F.lit(float(epochs) * chars / mass) * F.col("weight") / F.col("chars"))


def _distributions(rates: DataFrame) -> DataFrame:
    """The Poisson distribution function of each source's rate, up to where it is 1 in double precision."""
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    upto = W.partitionBy("_source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    steps = rates.where("rate > 0").select("_source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    steps = steps.withColumn("_f", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(upto))
    steps = steps.withColumn("_p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("_f")))
    steps = steps.withColumn("_c", F.sum("_p").over(upto))
    return steps.groupBy("_source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_c"))), lambda x: x["_c"]).alias("_cdf"))


def replicate(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 0
) -> DataFrame:
    """Every document as often as its draw says, in a seeded global order: the columns of `docs`, replica, shuffle_key.

    The number of copies is the inverse of the Poisson distribution with the rate of the document's source, at a number
    between 0 and 1 that is hashed from the seed and doc_id; it may be 0, and no cap applies. Rows with the same doc_id share a draw;
    a null doc_id draws by its text. Null and empty texts are documents like others. A source of weight 0 leaves.
    Copies go to partitions by the hash of seed, document and replica and are sorted by it there. Columns named replica
    or shuffle_key are replaced.
    """
    columns = [c for c in docs.columns if c.lower() not in ("replica", "shuffle_key")]
    cdfs = land(_distributions(source_rates(docs, weights, default_weight, epochs)), "rates")
    entries = cdfs.agg(F.sum(F.size("_cdf") + 1)).first()[0] or 0
    rows = docs.withColumns({"_source": F.coalesce(F.col("source"), F.lit("")), "_key": _row_key()})
    if entries <= BROADCAST_ENTRIES:
        drawn = rows.join(F.broadcast(cdfs), "_source")
    else:
        salted = cdfs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("_salt", (F.crc32(F.col("_key").cast("binary")) % SALTS).cast("int")).join(salted, ["_source", "_salt"])
    drawn = drawn.withColumn("_u", uniform(F.lit(str(seed)), F.col("_key")))
    drawn = drawn.withColumn("_copies", F.size(F.filter("_cdf", lambda c: c < F.col("_u")))).where("_copies > 0")
    copies = drawn.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return _shuffled(copies, columns, seed)


def _shuffled(copies: DataFrame, columns: list[str], seed: int) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key"), F.col("replica").cast("string")))
    out = copies.withColumn("shuffle_key", key).select(*columns, "replica", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def numbered(copies: DataFrame, seed: int = 0) -> DataFrame:
    """The rows with a replica, from 1 on among equal rows, in the order of `replicate`.

    Equal rows fold to a count in each task before they move, so no document's copies are one task's work.
    """
    folded = copies.groupBy(*copies.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = folded.withColumns({"_key": _row_key(), "replica": F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))})
    return _shuffled(rows, copies.columns, seed).drop("shuffle_key")
