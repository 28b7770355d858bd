"""Merkle manifest of a dataset: bitmap ranks give each row its leaf, keyed slot arrays reduce the levels, proofs come back down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealgrid.llm.common import land

#: Nodes that share a parent.
ARITY = 16
#: A doc_id is cut into a directory path of 16, 16, 16 and 10 bits and the place in a 64-bit word. The signed top part keeps the order.
PARTS = ("l0", "l1", "l2", "l3")
_NULL_PART = -(1 << 15) - 1
#: Copies that one row unfolds at once.
UNFOLD = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Hex sha256 of a row's doc_id, source, lang, n_chars and the given text, each `-` if null, else its byte count, `:` and value."""
    return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)


def lower_cased(docs: DataFrame) -> Column:
    """The tampered text: A-Z lower-cased where 5 divides the crc32 of the decimal doc_id; null where the row is left as it is."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf_digest(F.translate("text", UPPER, LOWER)))


def _part(i: int) -> Column:
    key = F.coalesce(F.col("doc_id"), F.lit(0))
    if i == 0:
        return F.coalesce(F.shiftright("doc_id", 48).cast("int"), F.lit(_NULL_PART))
    if i < 3:
        return F.shiftright(key, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return F.shiftright(key, 6).bitwiseAND(F.lit(0x3FF)).cast("int")


def _before(w, value: str = "n") -> Column:
    return F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def bitmap_directory(entries: DataFrame) -> DataFrame:
    """Bitmaps of each group's ids with their popcounts summed: key, l0..l3, bits, more, before, total.

    `entries` holds key, l0..l3, bit and copies. A row is one 64-bit word with a bit for every id in it; empty words aren't kept. `more` lists
    the ids that several rows have, `before` counts the group's rows below the word, `total` all of them. Counts are added by prefix and carried down,
    so a window or a join key holds 65,537 rows at most, however many ids a group has and wherever they lie.
    """
    ids = entries.groupBy("key", *PARTS, "bit").agg(F.sum("copies").alias("n"))
    more = F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more"))))
    words = ids.groupBy("key", *PARTS).agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), more.alias("more"), F.sum("n").alias("n")
    )
    words = land(words, "bitmap-words")
    counts = [words]
    for depth in (3, 2, 1):
        counts.insert(0, counts[0].groupBy("key", *PARTS[:depth]).agg(F.sum("n").alias("n")))
    base = None
    for depth, level in enumerate(counts):
        level = level.withColumn("before", _before(W.partitionBy("key", *PARTS[:depth]).orderBy(PARTS[depth])))
        if base is None:
            level = level.withColumn("total", F.sum("n").over(W.partitionBy("key")))
        else:
            level = level.join(base, ["key", *PARTS[:depth]]).withColumn("before", F.col("before") + F.col("_above"))
        base = level.select("key", *PARTS[: depth + 1], F.col("before").alias("_above"), "total")
    return land(level.select("key", *PARTS, "bits", "more", "before", "total"), "bitmap-directory")


def _tie_ranks(entries: DataFrame) -> DataFrame:
    """(leaf, ahead) for entries that share their id: rows of that id whose leaf is smaller, counted by ranges of the leaf's first 16 bits."""
    same = ["key", *PARTS, "bit"]
    many = land(entries.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same), "tied-ids")
    tied = entries.join(many, same).withColumn("shelf", F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int"))
    shelves = tied.groupBy(*same, "shelf").agg(F.sum("copies").alias("n"))
    shelves = land(shelves.select(*same, "shelf", _before(W.partitionBy(*same).orderBy("shelf")).alias("lower")), "tied-shelves")
    inside = tied.withColumn("inside", _before(W.partitionBy(*same, "shelf").orderBy("leaf"), "copies"))
    return inside.join(shelves, [*same, "shelf"]).select("leaf", (F.col("lower") + F.col("inside")).alias("ahead"))


def leaf_places(rows: DataFrame) -> DataFrame:
    """The place of every row within its group, by doc_id and then leaf: key, pos, total, digest, doc_id, tampered.

    `rows` holds key, doc_id, leaf and tampered. Null ids come first. Rows that agree in everything are counted once and unfolded at the end.
    """
    parts = [_part(i).alias(p) for i, p in enumerate(PARTS)]
    bit = F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseAND(F.lit(63)).cast("int").alias("bit")
    entries = rows.groupBy("key", "doc_id", "leaf", "tampered").agg(F.count("*").alias("copies"))
    entries = land(entries.select("*", *parts, bit), "manifest-entries")
    directory = bitmap_directory(entries)
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))).cast("long")
    repeats = F.expr("aggregate(filter(more, x -> x.bit < bit), 0L, (n, x) -> n + x.more)")
    ranked = entries.join(directory, ["key", *PARTS]).join(_tie_ranks(entries), "leaf", "left")
    ranked = ranked.withColumn("pos", F.col("before") + below + repeats + F.coalesce("ahead", F.lit(0)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / UNFOLD)))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(UNFOLD), F.col("copies") - F.col("_c") * UNFOLD) - 1))
    ranked = ranked.withColumn("_c", chunk).withColumn("_i", place)
    return ranked.select("key", (F.col("pos") + F.col("_c") * UNFOLD + F.col("_i")).alias("pos"), "total", F.col("leaf").alias("digest"), "doc_id", "tampered")


def _reduced(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every level (key, run, total, slots), and the one node left of each key (key, digest).

    `nodes` holds key, pos, total, digest and whatever goes along. Children find their parent by key and pos / ARITY alone.
    """
    payload = [c for c in nodes.columns if c not in ("key", "total")]
    levels, left = [], []
    while True:
        left.append(nodes.where("total = 1").select("key", "digest"))
        run = F.floor(F.col("pos") / ARITY).alias("run")
        runs = nodes.where("total > 1").groupBy("key", run).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct(*payload))).alias("slots"))
        runs = land(runs, name)
        if runs.isEmpty():
            return levels, reduce(DataFrame.unionByName, left)
        levels.append(runs)
        parent = F.sha2(F.array_join(F.col("slots.digest"), ""), 256).alias("digest")
        nodes = runs.select("key", F.col("run").alias("pos"), F.ceil(F.col("total") / ARITY).alias("total"), parent)
        payload = ["pos", "digest"]


def _beside(i: Column) -> Column:
    """What stands left and right of slot i of its run, as two texts of joined digests."""
    digests = F.col("slots.digest")
    return F.struct(F.array_join(F.slice(digests, 1, i), "").alias("l"), F.array_join(F.slice(digests, i + 2, ARITY), "").alias("r"))


def _downward(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's runs, each with the path above it: siblings level by level up to the end of the path of its key's top node.

    `tops` holds key, path and columns that all nodes of the key get.
    """
    goes_along = [c for c in tops.columns if c != "key"]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        runs = levels[depth]
        at = runs.where(F.col("total") <= ARITY).join(tops, "key")
        if above is not None:
            at = at.unionByName(runs.where(F.col("total") > ARITY).join(above, ["key", "run"]))
        if depth:
            child = at.select("*", F.posexplode("slots").alias("i", "slot"))
            rest = [c for c in goes_along if c != "path"]
            above = child.select("key", F.col("slot.pos").alias("run"), F.concat(F.array(_beside(F.col("i"))), "path").alias("path"), *rest)
    return at


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaves of a source ascend by doc_id; every 16 consecutive nodes become the sha256 of their joined digests until one is left, the
    source's subroot; the subroots, by source, become the root in the same way. proof_sha256 covers all siblings on the way from the leaf to
    the root, folded_root is what the leaf (of the tampered row, where there is one) and those siblings give, verified says whether it is the root.

    Leaves find their place by rank in bitmaps of doc_ids (`bitmap_directory`); the documents are never sorted. Null ids come
    first and are never tampered, rows of one id follow each other by leaf, repeated rows are leaves of their own, a null source is a source and
    comes first. An empty table gives an empty result. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")
    rows = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("leaf"), lower_cased(docs).alias("tampered"))
    leaves = land(leaf_places(rows), "leaves")
    levels, subroots = _reduced(leaves, "slots")
    upper, root = _reduced(_in_order(subroots), "source-slots")
    root = root.first()
    root = F.lit(root.digest if root else None).cast("string")

    # From the root down: the path of every subroot, then of every run of leaves.
    no_path = F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path")
    if upper:
        top = subroots.limit(1).select(F.lit("").alias("key"), no_path)
        found = _downward(upper, top).select("*", F.posexplode("slots").alias("i", "slot"))
        tops = found.select(F.col("slot.source").alias("key"), F.concat(F.array(_beside(F.col("i"))), "path").alias("path"), F.col("slot.digest").alias("subroot"))
    else:
        tops = subroots.select("key", no_path, F.col("digest").alias("subroot"))
    lone = leaves.where("total = 1").join(tops, "key").select("doc_id", "digest", "tampered", "subroot", "path")
    paths = lone
    if levels:
        runs = _downward(levels, tops).select("*", F.posexplode("slots").alias("i", "slot"))
        whole = F.concat(F.array(_beside(F.col("i"))), "path").alias("path")
        paths = paths.unionByName(runs.select("slot.doc_id", "slot.digest", "slot.tampered", "subroot", whole))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda x, s: F.sha2(F.concat(s.l, x, s.r), 256))
    out = paths.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _in_order(subroots: DataFrame) -> DataFrame:
    """The subroots as nodes of one tree, in the order of their sources, numbered within sort ranges and then across them."""
    ranged = subroots.repartitionByRange("key").sortWithinPartitions("key").withColumn("_at", F.monotonically_increasing_id())
    ranged = land(ranged, "subroots").withColumn("_range", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    starts = sizes.select("_range", _before(W.partitionBy(F.lit(0)).orderBy("_range")).alias("_start"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    pos = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(starts, "_range").select(F.lit("").alias("key"), pos.alias("pos"), "total", "digest", F.col("key").alias("source"))
