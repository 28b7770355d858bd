"""Near duplicates: MinHash bands name candidates, odd sketches sort them out, full sets confirm them, components group them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.llm.common import as_bytes, connected_components, land, list_array, small_batches

#: MinHash samples of a set; the first BANDS * ROWS of them form bands, all are folded into the odd sketch.
SAMPLES = 256
BANDS, ROWS = 40, 5
#: Bits of an odd sketch, held in words of 64.
SKETCH_BITS = 1024
WORDS = SKETCH_BITS // 64
#: Standard deviations of the estimate that a true link may lie below the threshold before its sketch rules it out.
SIGMAS = 6.0
#: Similarity from which a node counts as an acquaintance of the first node of its bucket: their sets' difference is kept.
ACQUAINTED = 0.35
#: Members of a group that meet as many others at once in one task; larger groups are cut and each two cuts meet.
CUT = 256
BATCH_BYTES = 4 << 20

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SALT = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` words, A-Z lower-cased; with fewer words, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        run = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + own[k : len(words) - width + 1 + k])
    return np.unique(run)


def _minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 1024):
            part = (hashes[start : start + 1024][None, :] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
            np.minimum(out, part.min(axis=1), out=out)
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of samples: sample j of value v flips the bit that (j, v) hashes to."""
    with np.errstate(over="ignore"):
        bit = (_mixed(minima * _SALT + np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    flat = bit + np.arange(len(minima))[:, None] * SKETCH_BITS
    parity = (np.bincount(flat.ravel(), minlength=len(minima) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(minima), SKETCH_BITS), axis=1).view(np.uint64)


def _expected_bits(likeness: float) -> float:
    """Bits in which the sketches of two sets of this similarity differ, on average."""
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - likeness)))


def max_differing_bits(threshold: float) -> int:
    """Sketches of sets as similar as `threshold` differ in no more bits, but for a chance far beyond SIGMAS deviations."""
    expected = _expected_bits(threshold)
    slope = 1 - 2 * expected / SKETCH_BITS
    samples = 2 * math.sqrt(SAMPLES * threshold * (1 - threshold)) * slope
    parity = math.sqrt(SKETCH_BITS / 4 * (1 - slope * slope))
    return math.ceil(expected + SIGMAS * math.hypot(samples, parity))


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """Per document: doc_id, text_key, n (set size), node (digest of the set, null if empty), bands, s0..s15."""
    names = [f"s{i}" for i in range(WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES, "text"):
            sets = [shingles(t, size) for t in as_bytes(batch.column("text"))]
            minima = np.stack([_minima(s) for s in sets])
            kept = minima[:, : BANDS * ROWS].reshape(len(sets), BANDS, ROWS)
            with np.errstate(over="ignore"):
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
                for r in range(ROWS):
                    band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + kept[:, :, r])
            bits = odd_sketches(minima).view(np.int64)
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [
                batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()),
                list_array(band.view(np.int64).ravel(), np.full(len(sets), BANDS), pa.int64()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WORDS)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "node", "bands", *names])

    schema = "doc_id long, text_key long, n long, node binary, bands array<long>, " + ", ".join(f"{s} long" for s in names)
    texts = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "text")
    return texts.mapInArrow(sketch, schema)


def _differing(a: str = "", b: str = "_b") -> Column:
    """Bits in which two sketches differ."""
    return reduce(add, (F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(WORDS)))


def _alike(threshold: float) -> Column:
    """Sizes and sketches of two sets allow the similarity."""
    low, high = F.least("n", "n_b"), F.greatest("n", "n_b")
    return (100 * low >= round(100 * threshold) * high) & (_differing() <= max_differing_bits(threshold))


def compared_texts(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, linked, apart) of pairs of whole texts; few bytes of texts are taken at once, as a bucket's members may all be long."""
    last: dict[bytes, np.ndarray] = {}
    for batch in small_batches(batches, BATCH_BYTES, "text_a", "text_b"):
        linked, apart = [], []
        for left, right in zip(as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))):
            sets = []
            for text in (left, right):
                if text not in last:
                    if len(last) > 16:
                        last.clear()
                    last[text] = shingles(text, size)
                sets.append(last[text])
            only = np.setxor1d(*sets, assume_unique=True)
            linked.append(linked_by(len(sets[0]), len(sets[1]), len(only), percent))
            apart.append(only.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(apart, pa.binary())], ["a", "b", "linked", "apart"])


def _compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Per pair (a, b) of nodes: whether their full shingle sets are as similar as the threshold, and the hashes in only one of them."""
    percent = round(100 * threshold)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", "rep_id", "rep_key"), "nid")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")))
    texts = texts.select("doc_id", "text_key", "nid", "text").dropDuplicates(["doc_id", "text_key", "nid"]).select("nid", "text")
    both = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compared_texts(batches, size, percent)

    return both.mapInArrow(compared, "a long, b long, linked boolean, apart binary")


def linked_by(n_a, n_b, apart, percent: int):
    """Whether sets of these sizes that differ in so many members have a similarity of `percent` percent."""
    return 100 * (n_a + n_b - apart) >= percent * (n_a + n_b + apart)


def _links_in_groups(members: DataFrame, percent: int) -> DataFrame:
    """Links between members of a group that lie in different components, from their differences to the group's head alone.

    `members` holds head, nid, n, apart and component. The sets of x and y differ in just those hashes in which their differences to the
    head differ, so this is exact. Members outside the group's main component meet all others, cut by cut; of the links of a member to
    one component one is returned.
    """
    shares = members.groupBy("head", "component").agg(F.count("*").alias("m"))
    mixed = shares.groupBy("head").agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("all"), F.count("*").alias("k")).where("k > 1")
    # Landed, so that both sides of the join are exchanges of its own and a head of very many members can be split.
    mixed = land(mixed.select("head", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.m")) / CUT).cast("int").alias("cuts_a"), F.ceil(F.col("all") / CUT).cast("int").alias("cuts_b")), "mixed-heads")
    own = members.join(mixed, "head")
    cut = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["head", "i", "j", "nid", "n", "apart", "component"]
    a = own.where("component <> main").withColumn("i", cut("cuts_a")).withColumn("j", every("cuts_b")).select(*columns, F.lit(True).alias("outside"))
    b = own.withColumn("j", cut("cuts_b")).withColumn("i", every("cuts_a")).select(*columns, F.lit(False).alias("outside"))

    def meet(group: pa.Table) -> pa.Table:
        side = group.column("outside").to_numpy(zero_copy_only=False)
        nid, n, component = (group.column(c).to_numpy() for c in ("nid", "n", "component"))
        lists = [np.frombuffer(x, np.uint64) for x in group.column("apart").to_pylist()]
        rows_a, rows_b = np.flatnonzero(side), np.flatnonzero(~side)
        found = []
        if len(rows_a) and len(rows_b):
            sizes = np.array([len(lists[r]) for r in rows_b])
            hashes, place = np.concatenate([lists[r] for r in rows_b]), np.repeat(np.arange(len(rows_b)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, place = hashes[order], place[order]
            for r in rows_a.tolist():
                low, high = np.searchsorted(hashes, lists[r], "left"), np.searchsorted(hashes, lists[r], "right")
                count = high - low
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                common = np.bincount(place[at], minlength=len(rows_b))
                apart = len(lists[r]) + sizes - 2 * common
                ok = rows_b[linked_by(n[r], n[rows_b], apart, percent) & (component[rows_b] != component[r])]
                _, first = np.unique(component[ok], return_index=True)
                found += [(int(nid[r]), int(nid[x])) for x in ok[first]]
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return a.unionByName(b).groupBy("head", "i", "j").applyInArrow(meet, "a long, b long")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(nid, component) for every node."""
    found = connected_components(links, "near-components").withColumnRenamed("node", "nid")
    return nodes.select("nid").join(found, "nid", "left").select("nid", F.coalesce("component", "nid").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key.

    Two documents are linked if the sets of their runs of `size` words, A-Z lower-cased, have a Jaccard similarity of `threshold` or more,
    checked on the full sets; a document of fewer words has its whole sequence as its one run. component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have no runs and are linked with nothing. Equal sets are one node, so
    copies are never paired. Null ids take part, but name a component only when it has no other id. Rows with the same id and set share their result;
    text_key is a hash of the text.

    Every node of a bucket is compared with the bucket's first node, its head, unless their sketches are far apart. Nodes that know the same
    head but lie in different components of these links are then compared with each other, exactly, by their differences to the head;
    nodes that are strangers to the head meet the other members of the bucket whose sketches allow a link. Large groups are cut, so no task
    holds a whole one, and only links are returned. A link of similarity 0.8 shares a bucket but for a chance of (1 - 0.8^5)^40, about 1e-7.
    """
    words = [f"s{i}" for i in range(WORDS)]
    rows = land(_sketched(docs, size), "sketches")
    first = lambda c: F.first(c).alias(c)
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "text_key")).alias("rep"), *(first(c) for c in ("n", "bands", *words))
    )
    nodes = land(nodes.select(F.monotonically_increasing_id().alias("nid"), "node", "min_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "n", "bands", *words), "nodes")

    places = nodes.select("nid", F.explode("bands").alias("key"))
    buckets = land(places.groupBy("key").agg(F.min("nid").alias("head"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = land(places.join(buckets, "key").where("nid <> head").select("key", "nid", "head", "size"), "members")
    facts = nodes.select("nid", "n", *words)
    other = facts.select(F.col("nid").alias("nid_b"), *(F.col(c).alias(f"{c}_b") for c in ("n", *words)))
    known = members.select("nid", "head").distinct().join(facts, "nid").join(other, F.col("head") == F.col("nid_b"))
    known = land(known.where(_differing() <= max_differing_bits(ACQUAINTED)).select(F.col("nid").alias("a"), F.col("head").alias("b")), "acquainted")
    compared = land(_compared(docs, nodes, known, size, threshold), "compared")
    links = compared.where("linked").select("a", "b")
    label = land(_labelled(nodes, links), "labels")

    # Acquaintances of one head, in different components.
    groups = compared.select(F.col("a").alias("nid"), F.col("b").alias("head"), "apart").join(nodes.select("nid", "n"), "nid").join(label, "nid")
    near = _links_in_groups(groups, round(100 * threshold))

    # Strangers to the head of their bucket, against all its other members.
    crowd = members.where("size > 2").withColumn("cuts", F.ceil(F.col("size") / CUT).cast("int")).withColumn("cut", F.pmod(F.xxhash64("nid"), F.col("cuts")).cast("int"))
    crowd = land(crowd.join(known.select(F.col("a").alias("nid"), F.col("b").alias("head"), F.lit(True).alias("known")), ["nid", "head"], "left"), "crowd")
    strange = crowd.where("known is null").select("key", "nid", F.col("cut").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("j"))
    where = strange.select("key").distinct()
    others = crowd.join(where, "key", "left_semi").select("key", F.col("nid").alias("nid_b"), F.col("cut").alias("j"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"))
    across = (F.col("nid") != F.col("nid_b")) & _alike(threshold)
    met = strange.join(facts, "nid").join(others.join(other, "nid_b"), ["key", "i", "j"]).where(across)
    met = land(met.select(F.least("nid", "nid_b").alias("a"), F.greatest("nid", "nid_b").alias("b")).distinct(), "strangers")
    rest = _compared(docs, nodes, met, size, threshold).where("linked").select("a", "b")
    label = _labelled(nodes, links.unionByName(near).unionByName(rest))

    named = nodes.select("nid", "node", "min_id").join(label, "nid")
    named = land(named, "named")
    smallest = land(named.groupBy("component").agg(F.min("min_id").alias("component_id")), "smallest")
    named = named.join(smallest, "component").select(F.col("node").alias("_node"), "component_id")
    out = rows.select("doc_id", "text_key", "n", "node").join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key"
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents, all their columns, with one row of each component: that of the smallest doc_id; blank texts all stay.

    Of rows with that id and different texts of the component, the one with the smallest text hash stays; rows that agree
    in id and text count as one.
    """
    found = near_duplicates(docs, size, threshold)
    blank = found.where("n_shingles = 0").select("doc_id", "text_key")
    first = found.where("kept and n_shingles > 0").groupBy("doc_id", "component_id").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    stay = blank.unionByName(first).distinct().select(F.col("doc_id").alias("_keep_id"), F.col("text_key").alias("_keep_key"))
    marked = docs.withColumn("_text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text_key") == F.col("_keep_key"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
