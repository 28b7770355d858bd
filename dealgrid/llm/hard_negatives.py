"""Hard negatives by an inverted multi-index: two codebooks over half vectors form cells, visited by falling bounds until a window is certified."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealgrid.llm.common import land, list_array

#: Rows, in the order of a hash, that the codebooks are fitted on at most.
SAMPLE = 20_000
ITERATIONS = 8
#: Codes of a half: the square root of the rows over CELL_ROWS, at most MAX_CODES.
CELL_ROWS, MAX_CODES = 256, 256
#: Rows of a shard, about. A code of the first half with more rows is cut by a hash.
SHARD_ROWS = 8192
#: Anchors that meet a shard in one task, about.
ANCHOR_BLOCK = 1 << 17
#: Rows that are scored at once.
SCORE_ROWS = 1024
#: Steps of a component: floor(SCALE * x).
SCALE = 256

_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Codebooks:
    """Centroids of both halves, the largest distance of a row to each, and the shards of each code of the first half."""

    split: int
    dims: int
    first: np.ndarray
    second: np.ndarray
    radius_1: np.ndarray
    radius_2: np.ndarray
    shard_of: np.ndarray
    shards_of: np.ndarray


def usable(rows: DataFrame) -> DataFrame:
    """Distinct rows with vec_id, label and whole vectors as integers: vec_id, label, vec; all vectors get the length of the longest by zeros.

    Rows with a null id, label or vector, or any null or non-finite component are left out. Integers are bounded so that a
    score can't leave 62 bits; for 64 components the bound is 2^28, that is x beyond a million.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("_x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_x").isNotNull())
    rows = rows.where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    dims = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    bound = 1 << ((62 - max(dims, 1).bit_length()) // 2)
    padded = F.concat("_x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("_x"))) if dims else F.expr("cast(array() as array<double>)")
    whole = F.transform(padded, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(bound))), F.lit(float(-bound)))).cast("int"))
    return rows.select("vec_id", "label", whole.alias("vec")).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), dims)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    code = gap.argmin(axis=1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(axis=1))


def k_means(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centroids after a few rounds of Lloyd's algorithm from distinct rows of `x`; fewer where `x` has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(ITERATIONS):
        code, _ = _nearest(x, centres)
        count = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def index(rows: DataFrame, seed: int = 11) -> tuple[DataFrame, Codebooks | None]:
    """Every row with its codes and shard: rid, vec_id, label, vec, c1, c2, d1, d2, shard; and the codebooks (None without rows).

    The codebooks are fitted on SAMPLE rows at most; all rows are coded, and the radii come from all rows.
    """
    rows = land(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    if not n:
        return rows, None
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).toArrow()
    dims = len(sample.column("vec")[0])
    x, split = _matrix(sample.column("vec"), dims), (dims + 1) // 2
    codes = max(1, min(MAX_CODES, round(math.sqrt(n / CELL_ROWS))))
    first, second = k_means(x[:, :split], codes, seed), k_means(x[:, split:], codes, seed + 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dims)
            (c1, d1), (c2, d2) = _nearest(x[:, :split], first), _nearest(x[:, split:], second)
            own = [pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32)), pa.array(d1), pa.array(d2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "c1", "c2", "d1", "d2"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    coded = land(rows.mapInArrow(code, f"{schema}, c1 int, c2 int, d1 double, d2 double"), "coded")
    radius_1, radius_2, count = np.zeros(len(first)), np.zeros(len(second)), np.zeros(len(first), dtype=np.int64)
    for r in coded.groupBy("c1").agg(F.max("d1").alias("r"), F.count("*").alias("n")).collect():
        radius_1[r.c1], count[r.c1] = r.r, r.n
    for r in coded.groupBy("c2").agg(F.max("d2").alias("r")).collect():
        radius_2[r.c2] = r.r
    # Codes fill shards one after the other; a code larger than a shard has shards of its own.
    shard_of, shards_of, shard, room = np.zeros(len(first), np.int64), np.ones(len(first), np.int64), 0, SHARD_ROWS
    for c, rows_of in enumerate(count.tolist()):
        if rows_of > room:
            shard, room = shard + (room < SHARD_ROWS), SHARD_ROWS
        shard_of[c], shards_of[c] = shard, -(-rows_of // SHARD_ROWS) or 1
        room -= rows_of
        if room <= 0:
            shard, room = shard + int(shards_of[c]), SHARD_ROWS
    books = Codebooks(split, dims, first, second, radius_1, radius_2, shard_of, shards_of)
    pick = lambda values: F.array(*(F.lit(int(v)) for v in values))[F.col("c1")]
    return coded.withColumn("shard", pick(shard_of) + F.pmod(F.xxhash64("rid"), pick(shards_of))), books


def _bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest inner product that a half vector within `radius` of each centre can have with q, rounded up."""
    high = centres @ q + math.sqrt(float(q @ q)) * radius
    return high + 1e-9 * (1 + np.abs(high))


def _visits(upper_1: np.ndarray, upper_2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Cells (bound, i, j) of two lists of half bounds by falling sum: a heap over the two sorted lists, each cell pushed once."""
    by_1, by_2 = np.argsort(-upper_1), np.argsort(-upper_2)
    high_1, high_2 = upper_1[by_1].tolist(), upper_2[by_2].tolist()
    heap, seen = [(-(high_1[0] + high_2[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(by_1[i]), int(by_2[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(high_1) and b < len(high_2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(high_1[a] + high_2[b]), a, b))


class _Shard:
    """The rows of a shard by cell, with radii of their own."""

    def __init__(self, rows: pa.Table, books: Codebooks):
        c1, c2 = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
        order = np.lexsort((c2, c1))
        self.x = _matrix(rows.column("vec"), books.dims)[order]
        self.label, self.vec_id, self.rid = (rows.column(c).to_numpy()[order] for c in ("label", "vec_id", "rid"))
        self.size = float(np.abs(self.x).max(initial=0))
        codes_1, at_1 = np.unique(c1[order], return_inverse=True)
        codes_2, at_2 = np.unique(c2[order], return_inverse=True)
        self.cells: dict[tuple[int, int], tuple[int, int]] = {}
        edges = np.flatnonzero(np.append(True, (np.diff(at_1) != 0) | (np.diff(at_2) != 0))).tolist()
        for start, end in zip(edges, [*edges[1:], len(order)]):
            self.cells[int(at_1[start]), int(at_2[start])] = (start, end)
        radius_1, radius_2 = np.zeros(len(codes_1)), np.zeros(len(codes_2))
        np.maximum.at(radius_1, at_1, rows.column("d1").to_numpy()[order])
        np.maximum.at(radius_2, at_2, rows.column("d2").to_numpy()[order])
        self.halves = (books.first[codes_1], radius_1, books.second[codes_2], radius_2)
        self.split = books.split

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.size * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2.0**53:
            return (self.x[at] @ q).astype(np.int64)
        return self.x[at].astype(np.int64) @ q.astype(np.int64)

    def search(self, q: np.ndarray, fits: Callable[[np.ndarray], np.ndarray], windows: list[dict], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the first k rows that fit: their places and scores, by falling score, then vec_id.

        Cells are visited by falling bound. A window is certified when the next bound is below its low end or below its k-th score.
        """
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        need = [w["low"] for w in windows]
        centres_1, radius_1, centres_2, radius_2 = self.halves
        visits = _visits(_bounds(q[: self.split], centres_1, radius_1), _bounds(q[self.split :], centres_2, radius_2))
        waiting, rows = [], 0
        for bound, i, j in visits:
            if bound < min(need):
                break
            cell = self.cells.get((i, j))
            if cell:
                waiting.append(np.arange(*cell))
                rows += cell[1] - cell[0]
            if rows >= SCORE_ROWS:
                self._take(np.concatenate(waiting), q, fits, windows, k, found, need)
                waiting, rows = [], 0
        if waiting:
            self._take(np.concatenate(waiting), q, fits, windows, k, found, need)
        return found

    def _take(self, at, q, fits, windows, k, found, need) -> None:
        score = self.scores(at, q)
        ok = fits(at) & (score >= min(need))
        at, score = at[ok], score[ok]
        for w, window in enumerate(windows):
            own = (score >= need[w]) & (score <= window["high"])
            places, scores = np.concatenate([found[w][0], at[own]]), np.concatenate([found[w][1], score[own]])
            first = np.lexsort((self.vec_id[places], -scores))[:k]
            found[w] = (places[first], scores[first])
            if len(first) == k:
                need[w] = int(scores[first[-1]])


def _scan(coded: DataFrame, probes: DataFrame, books: Codebooks, same_label: bool, k: int, blocks: int) -> DataFrame:
    """(aid, tag, rid, vec_id, score): for every probe (aid, label, vec, windows, shard) the first k rows of its shard in each window."""
    rows = coded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else coded.withColumn("block", F.lit(0))
    probes = probes.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("aid", "tag", "rid", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            shard = _Shard(left, books)
            vectors = _matrix(right.column("vec"), books.dims)
            for q, aid, label, windows in zip(vectors, *(right.column(c).to_pylist() for c in ("aid", "label", "windows"))):
                fits = lambda at: ((shard.label[at] == label) == same_label) & (shard.rid[at] != aid)  # noqa: B023, E731
                for window, (at, score) in zip(windows, shard.search(q, fits, windows, k)):
                    for c, v in zip(out, (np.full(len(at), aid), np.full(len(at), window["tag"]), shard.rid[at], shard.vec_id[at], score)):
                        out[c].append(v.astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for c, v in out.items()})

    keys = ["shard", "block"]
    sides = rows.select(*keys, "rid", "vec_id", "label", "vec", "c1", "c2", "d1", "d2").groupBy(*keys), probes.select(*keys, "aid", "label", "vec", "windows").groupBy(*keys)
    return sides[0].cogroup(sides[1]).applyInArrow(meet, "aid long, tag long, rid long, vec_id long, score long")


def _routed(wanted: DataFrame, books: Codebooks) -> DataFrame:
    """The probes of every other shard whose cells can hold a row that one of the anchor's windows still needs."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"), books.dims)
            shards, lengths = [], []
            for q, windows, home in zip(vectors, batch.column("windows").to_pylist(), batch.column("home").to_pylist()):
                top = _bounds(q[: books.split], books.first, books.radius_1) + _bounds(q[books.split :], books.second, books.radius_2).max()
                codes = np.flatnonzero(top >= min(w["low"] for w in windows))
                own = [np.arange(books.shard_of[c], books.shard_of[c] + books.shards_of[c]) for c in codes.tolist()]
                reached = np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
                reached = reached[reached != home]
                shards.append(reached)
                lengths.append(len(reached))
            flat = np.concatenate(shards) if shards else np.empty(0, np.int64)
            columns = [batch.column(c) for c in ("aid", "label", "vec", "windows")]
            yield pa.RecordBatch.from_arrays([*columns, list_array(flat, np.array(lengths), pa.int64())], ["aid", "label", "vec", "windows", "shards"])

    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("aid", "label", "vec", "windows")) + ", shards array<long>"
    routed = wanted.select("aid", "label", "vec", "windows", "home").mapInArrow(route, schema)
    return routed.select("aid", "label", "vec", "windows", F.explode("shards").alias("shard"))


def first_in_windows(coded: DataFrame, books: Codebooks, wanted: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(aid, tag, rid, vec_id, score, rank): the first k rows in every window of every anchor, by falling score, then vec_id.

    `wanted` holds aid, label, vec, home and windows (tag, low, high). Each anchor first searches its own shard. What it finds there is the least that
    other shards must offer, so only shards with a cell above that are asked; results are exact whatever the index looks like.
    """
    blocks = max(1, -(-wanted.count() // ANCHOR_BLOCK))
    near = land(_scan(coded, wanted.withColumn("shard", F.col("home")), books, same_label, k, blocks), "own-shard")
    least = near.groupBy("aid", "tag").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
    least = least.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("tag", "s"))).alias("least"))
    raised = wanted.join(least, "aid", "left").withColumn(
        "windows", F.transform("windows", lambda w: F.struct(w.tag.alias("tag"), F.greatest(w.low, F.col("least")[w.tag]).alias("low"), w.high.alias("high")))
    )
    far = _scan(coded, _routed(raised.drop("least"), books), books, same_label, k, blocks)
    rank = F.row_number().over(W.partitionBy("aid", "tag").orderBy(F.desc("score"), "vec_id", "rid"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)


def _hundredths(factor: int, up: bool) -> Column:
    """score * factor / 100, rounded to a whole number, exactly."""
    product = F.col("score").cast("decimal(20,0)") * F.lit(factor).cast("decimal(3,0)")
    rest = F.pmod(product, F.lit(100).cast("decimal(3,0)"))
    down = (product - rest) / F.lit(100).cast("decimal(3,0)")
    return (down + F.when(rest > 0, F.lit(1)).otherwise(F.lit(0)) if up else down).cast("decimal(22,0)").cast("long")


def mine_hard_negatives(
    rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90
) -> DataFrame:
    """For each anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` holds vec_id, label and embedding. A row's score is its integer inner product with the anchor, components as floor(256 x). Anchors are the
    rows whose vec_id is divisible by `anchor_every`; an anchor's positives are its first other rows of the same label, its negatives, for each
    positive, the first rows of other labels whose score is between `low_percent` and `high_percent` of the positive's. Higher scores come first,
    ties by smaller vec_id. A positive with a negative score has an empty window.

    Rows with a null vec_id, label, vector, or a null or non-finite component take no part; shorter vectors are filled with zeros; rows that agree in
    vec_id, label and vector count once, other rows of one vec_id are rows of their own. Other columns are not read. An empty table, or one
    without anchors, gives an empty result.
    """
    coded, books = index(usable(rows))
    if books is None:
        return coded.select(*(F.lit(None).cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(_LOWEST).alias("low"), F.lit(_HIGHEST).alias("high")))
    anchors = coded.where(F.col("vec_id") % anchor_every == 0)
    anchors = land(anchors.select(F.col("rid").alias("aid"), F.col("vec_id").alias("anchor_id"), "label", "vec", F.col("shard").alias("home")), "anchors")
    alike = first_in_windows(coded, books, anchors.withColumn("windows", everything), True, positives)
    windows = alike.withColumn("low", _hundredths(low_percent, True)).withColumn("high", _hundredths(high_percent, False))
    windows = windows.select("aid", F.col("rank").cast("long").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "low", "high")
    windows = land(windows.where("low <= high"), "positives")
    wanted = anchors.join(windows.groupBy("aid").agg(F.collect_list(F.struct("tag", "low", "high")).alias("windows")), "aid")
    found = first_in_windows(coded, books, land(wanted, "wanted"), False, negatives)
    found = found.select("aid", "tag", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(windows, ["aid", "tag"]).join(anchors.select("aid", "anchor_id"), "aid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
