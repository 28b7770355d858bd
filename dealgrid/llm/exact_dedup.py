"""Exact duplicates by block naming: sorted blocks get integer names, adjacent names are named in pairs until one is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealgrid.llm.common import SPACES, land

#: Code points in a block.
BLOCK_CHARS = 4096
#: Sort ranges that number their names on their own; a name is the range, then the place in it.
RANGES = 1 << 16
#: Stands for the missing right half of an odd pair; names start at 1.
PAD = 0


def normalised(text: Column) -> Column:
    """The text whose equality counts: each run of white space as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _blocks(text: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(F.size(cut) == 0, F.array(F.lit(""))).otherwise(cut)


def _name(seq: DataFrame) -> DataFrame:
    """Replace the two halves (a, b) of each item by one integer: the place of the pair in its sorted range."""
    in_range = W.partitionBy("_range").orderBy("a", "b")
    pairs = seq.select("a", "b").distinct().withColumn("_range", F.pmod(F.xxhash64("a", "b"), F.lit(RANGES)))
    names = pairs.select("a", "b", (F.col("_range") * (1 << 40) + F.row_number().over(in_range)).alias("name"))
    return seq.join(names, ["a", "b"]).select("row", "pos", "n", "name")


def _keyed_blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """One landed row per document with a 128-bit key for each block.

    The keys are proven free of collisions: the distinct blocks are counted by key, and the keys are drawn anew with
    another salt if two blocks ever share one.
    """
    texts = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_t"))
    salt = 1
    while True:
        key = lambda b, s=salt: F.struct(F.xxhash64(b, F.lit(s)).alias("a"), F.xxhash64(F.lit(s), b).alias("b"))
        blocks = texts.select(F.explode(_blocks(F.col("_t"), block_chars)).alias("_b"))
        shared = blocks.select(key(F.col("_b")).alias("k"), "_b").distinct().groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
        if shared.isEmpty():
            break
        salt += 1
    keyed = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("_t", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("_t"), block_chars), key).alias("keys"),
    )
    return land(keyed, "block-keys")


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after replacing each run of white space by one space; a null text counts as
    empty, and all empty texts are one group. The row with the smallest doc_id of a group stays; a null doc_id counts as
    larger than any other, and of repeated rows with that doc_id exactly one stays. No two different texts ever get
    the same identity, and an empty table gives an empty result. Other columns are not read.

    Whole texts move once, as distinct blocks; each naming step moves a few integers per block, and a text of b blocks takes
    log2(b) steps. A block that very many documents share is one row after map-side folding.
    """
    rows = _keyed_blocks(docs, block_chars)
    seq = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k")).select("row", "n", "pos", "k.a", "k.b")
    named = land(_name(seq), "names")
    done = [named.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    level = 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        left, right = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = (
            named.where("n > 1")
            .groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(left).alias("a"), F.coalesce(F.max(right), F.lit(PAD)).alias("b"), F.max(F.floor((F.col("n") + 1) / 2).cast("int")).alias("n"))
        )
        named = land(_name(pairs), "names")
        done.append(named.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    identity = reduce(DataFrame.unionByName, done)
    known = land(rows.select("row", "doc_id", "text_sha256").join(identity, "row"), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    # Landed, so that both sides of the join are exchanges of its own and a group of very many rows can be split.
    groups = land(known.groupBy("level", "name").agg(first.alias("f"), F.count("*").alias("group_size")), "groups")
    return known.join(groups, ["level", "name"]).select(
        "doc_id", F.col("f.id").alias("keep_id"), "group_size", (F.col("row") == F.col("f.row")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all their columns, without the copies that `exact_duplicates` drops; one row of each group stays."""
    stay = exact_duplicates(docs, block_chars).where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    marked = docs.withColumn("_own_sha", F.sha2(normalised(F.col("text")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_own_sha") == F.col("_keep_sha"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_own_sha"]).drop("_own_sha")
