"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a quantile of the labelled scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.llm.common import as_bytes, crc_mod, land

#: Preference pairs each training document takes part in, at least.
PAIRS_PER_ROW = 4
#: Training documents that are paired with each other, about, and documents of each class among them, at least.
GROUP_ROWS, LEAST_OF_CLASS = 512, 32
#: Steps of the fit at most, and bins and values that the search for a quantile looks at in one go.
MOST_STEPS, BINS, FEW = 25, 1024, 10_000
#: Score at the quantile where documents begin to be accepted.
ACCEPT = 0.7

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"#$%&*@^~=+", b"|<>{}[]\\/_", b".,;:?", b" \t\n\r\x0b\x0c", b"\n")
_RATES = ("upper", "lower", "digit", "bang", "symbol", "bracket", "stop", "blank", "line", "other")
FEATURES = (*_RATES, *(f"root_{r}" for r in _RATES), "repeat_word", "repeat_pair", "distinct", "top_word", "repeat_line", "word_length", "log_words", "capital_runs", "odd_tails")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)), dtype=np.int64)
    for k, chars in enumerate(_CLASSES):
        table[list(chars), k] = 1
    return table


_TABLE = _class_table()
_UPPER, _ODD, _BLANK = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(_CLASSES[0])], _KIND[list(b"!#$%&*|")], _KIND[list(_CLASSES[7])] = _UPPER, _ODD, _BLANK


def features(text: bytes) -> list[float]:
    """What the score sees of one whole text: rates of kinds of characters, repetition and word shapes. Empty texts are all 0."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256) @ _TABLE
    n = len(text)
    rates = [*(counts / n).tolist(), 1.0 - min(1.0, counts[:8].sum() / n)]
    words = text.lower().split()
    if not words:
        return [*rates, *np.sqrt(rates).tolist(), *([0.0] * (len(FEATURES) - 2 * len(rates)))]
    m = len(words)
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=m)
    pairs = codes[:-1] * len(ids) + codes[1:]
    lines = [x for x in text.split(b"\n") if x]
    kind = _KIND[raw]
    return [
        *rates, *np.sqrt(rates).tolist(),
        np.count_nonzero(codes[1:] == codes[:-1]) / m,
        1.0 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0,
        len(ids) / m,
        float(np.bincount(codes).max()) / m if m > 20 else 0.0,
        1.0 - len(set(lines)) / len(lines),
        min(n / m, 60.0) / 10.0,
        float(np.log1p(m)) / 10.0,
        np.count_nonzero((kind[1:] == _UPPER) & (kind[:-1] == _UPPER)) / n,
        np.count_nonzero((kind[1:] == _BLANK) & (kind[:-1] == _ODD)) / m,
    ]


@dataclass(frozen=True)
class Ranker:
    """Weights on features, the raw score where acceptance begins, and the raw scores' spread."""

    weights: tuple[float, ...]
    threshold: float
    spread: float
    pairs: int

    def score(self, matrix: np.ndarray) -> np.ndarray:
        """Between 0 and 1, `ACCEPT` at the threshold; the order of the raw scores is kept. Without any pair every text is accepted."""
        if not self.pairs:
            return np.full(len(matrix), ACCEPT)
        z = (np.sum(matrix * np.array(self.weights), axis=1) - self.threshold) / self.spread
        return 1.0 / (1.0 + np.exp(-np.clip(z + np.log(ACCEPT / (1 - ACCEPT)), -500, 500)))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(id, label, x): features of all training documents with their class. Texts are measured where they lie; only the features move."""
    votes = labels.where("doc_id is not null and quality is not null").where(train)
    votes = votes.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg(F.col("quality").cast("double")).alias("_q")).where("_q <> 0.5")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, type=pa.list_(pa.float64()))], ["id", "x"])

    known = docs.select("doc_id", "text").where("doc_id is not null").where(train).mapInArrow(measured, "id long, x array<double>")
    return known.join(votes, "id").select("id", (F.col("_q") > 0.5).cast("int").alias("label"), "x")


def _grouped(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(group, good, bad): the features of a group's documents of both classes, packed. Every document is in a group, a rare class in several, so that no group lacks it."""
    groups = -(-sum(counts.values()) // GROUP_ROWS)
    copies = {k: min(groups, max(1, -(-LEAST_OF_CLASS * groups // n))) for k, n in counts.items()}
    turns = F.when(F.col("label") == 1, copies[1]).otherwise(copies[0])
    dealt = rows.withColumn("_turns", turns).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    group = F.pmod(F.xxhash64("id", "x") % groups + F.col("_turn") * F.floor(F.lit(groups) / F.col("_turns")), F.lit(groups))

    def pack(table: pa.Table) -> pa.Table:
        x, label, ids = np.array(table.column("x").to_pylist()), table.column("label").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort([*x.T, ids])
        x, label = x[order], label[order]
        return pa.table([table.column("group").slice(0, 1), pa.array([x[label == 1].tobytes()], pa.binary()), pa.array([x[label == 0].tobytes()], pa.binary())], names=["group", "good", "bad"])

    return dealt.select(group.alias("group"), "id", "label", "x").groupBy("group").applyInArrow(pack, "group long, good binary, bad binary")


def _pairs(group: int, good: bytes, bad: bytes, scale: np.ndarray) -> np.ndarray:
    """Scaled feature differences of a group's preference pairs: the same draw at every step."""
    best, worst = (np.frombuffer(b, np.float64).reshape(-1, len(FEATURES)) for b in (good, bad))
    if not len(best) or not len(worst):
        return np.empty((0, len(FEATURES)))
    turns = np.arange(max(len(best), len(worst)) * PAIRS_PER_ROW)
    rng = np.random.default_rng(group)
    # The class of fewer documents is drawn, the other one goes round.
    round_, drawn = (best, worst) if len(best) >= len(worst) else (worst, best)
    first, second = round_[rng.permutation(len(round_))[turns % len(round_)]], drawn[rng.integers(0, len(drawn), len(turns))]
    return (first - second if round_ is best else second - first) / scale


def _slope_and_curve(groups: DataFrame, w: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over the pairs of all groups, each task adding up its own: slope and curvature of the loss at `w`, and the number of pairs."""
    k = len(w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + k * k + 1)
        for batch in batches:
            for group, good, bad in zip(*(batch.column(c).to_pylist() for c in ("group", "good", "bad"))):
                difference = _pairs(group, good, bad, scale)
                p = 1.0 / (1.0 + np.exp(np.clip(difference @ w, -500, 500)))
                sums[:k] -= (difference * p[:, None]).sum(axis=0)
                sums[k:-1] += ((difference * (p * (1 - p))[:, None]).T @ difference).ravel()
                sums[-1] += len(difference)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["i", "v"])

    sums = np.zeros(k + k * k + 1)
    for r in groups.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    return sums[:k], sums[k:-1].reshape(k, k), int(sums[-1])


def _nth(values: DataFrame, n: int) -> float:
    """The `n`-th smallest of column `v`, from 1: bins are narrowed until few values are left."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high and (width := (high - low) / BINS) > 0:
        inside = values.where(F.col("v").between(low, high))
        bins = inside.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["b"]):
            if below + r["n"] >= n:
                break
            below += r["n"]
        if r["n"] <= FEW:
            return sorted(x["v"] for x in values.where(F.col("v").between(r["low"], r["high"])).collect())[n - below - 1]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high = r["low"], r["high"]
    return low


def _digits(x: float) -> float:
    """Nine digits: sums that Spark adds up in another order the next time give the same."""
    return float(f"{x:.9g}")


def fit(docs: DataFrame, labels: DataFrame, train: Column, ridge: float = 1e-3) -> Ranker:
    """Fit the ranker on all labelled documents for which `train`, a condition on doc_id, holds.

    Documents are dealt into groups by a hash, and in each group those of label 1 are preferred to those of label 0, every document in `PAIRS_PER_ROW` pairs or more; the
    logistic loss of the weighted feature differences is minimised by Newton steps, whose sums the tasks add up. The threshold is the quantile of the raw scores of
    all training documents at the share of label 0. Null labels and evenly split repeated labels are left out; without both classes there is no pair and nothing is rejected.
    """
    rows = land(_labelled(docs, labels, train), "quality-features")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Ranker((0.0,) * len(FEATURES), 0.0, 1.0, 0)
    scale = np.ones(len(FEATURES))
    for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("s")).collect():
        scale[r["i"]] = _digits(r["s"]) if r["s"] >= 1e-9 else 1.0
    groups = land(_grouped(rows, counts), "quality-groups")
    w = np.zeros(len(FEATURES))
    for _ in range(MOST_STEPS):
        slope, curve, pairs = _slope_and_curve(groups, w, scale)
        step = np.linalg.solve(curve / pairs + ridge * np.eye(len(w)), slope / pairs + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = np.array([_digits(x) for x in np.round(w, 9) / scale])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(np.sum(x * weights, axis=1))], ["v"])

    raw = land(rows.select("x").mapInArrow(weighed, "v double"), "quality-raw")
    low = _nth(raw, counts[0])
    # The next one: the same value once more, or the least above it.
    upto, above, spread = raw.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v"))), F.stddev_pop("v")).first()
    high = low if upto > counts[0] or above is None else above
    return Ranker(tuple(weights.tolist()), (low + high) / 2, max(_digits(spread) / 2, 1e-9), pairs)


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """One row per document: doc_id, score, predicted. Only the whole text counts; null is empty, equal texts score the same."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = ranker.score(np.array([features(t) for t in as_bytes(batch.column("text"))]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, predicted int")


def training_rows(key: Column) -> Column:
    """The rows labels may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return crc_mod(key, 4) != 2


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The documents, all their columns, whose score is at least `ACCEPT`; the other columns pass through unread."""

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([features((t or "").encode()) for t in texts]).reshape(-1, len(FEATURES))) >= ACCEPT)

    return docs.where(accepted(F.col("text")))
