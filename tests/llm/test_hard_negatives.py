"""Hard negatives against all scores, whatever the index, and the index's bounds and visits."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from dealgrid.llm import hard_negatives as hn
from dealgrid.llm.common import table
from dealgrid.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, rank int, score double, shard long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, 7, 0.5, 7) for i, v, label in rows], SCHEMA)


def plain(rows, every=100, positives=5, negatives=10):
    dims = max((len(v) for _, v, _ in rows if v is not None), default=0)
    clean = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v))
            clean[i, label, tuple(x)] = None
    clean = list(clean)
    out = []
    for a in clean:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r) for r in clean if r is not a))
        for p, pid, _ in [s for s in scored if s[2][1] == a[1]][:positives]:
            ok = [s for s in scored if s[2][1] != a[1] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(ok)]
    return out


def check(spark, rows, **kw):
    want = plain(rows, kw.get("anchor_every", 100))
    got = [tuple(r) for r in hn.mine_hard_negatives(vectors(spark, rows), **kw).collect()]
    assert Counter(got) == Counter(want)
    return got


def clustered(n, dims, seed, labels=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("cell_rows", "shard_rows", "block"), [(256, 8192, 1 << 17), (4, 50, 3)])
def test_all_scores(spark, monkeypatch, cell_rows, shard_rows, block):
    """With the production index and with many small cells, shards and blocks of anchors; a hot vector fills several shards."""
    for name, value in (("CELL_ROWS", cell_rows), ("SHARD_ROWS", shard_rows), ("ANCHOR_BLOCK", block)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(500, 16, 1)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(250)]
    assert len(check(spark, rows, anchor_every=50)) > 100


def test_messy(spark):
    """Nulls in every column, non-finite and null components, uneven, empty and zero vectors, ties, repeated rows and ids, large components."""
    rows = clustered(60, 6, 2, labels=3)
    bad = [None, [math.nan] * 6, [math.inf, 0.0], [-math.inf], [None, 1.0]]
    odd = [[], [0.0] * 6, [1.0], [0.5, 0.5], [-0.001] * 6, [1e6, 0.0], [3000.0] * 6]
    rows += [(200 + i, v, 1) for i, v in enumerate(bad + odd)] + [(None, rows[0][1], 1), (300, rows[1][1], None)]
    rows += [(400, v, i % 2) for i, v in enumerate(odd)] + rows[:30] + [(500 + i, rows[3][1], i % 2) for i in range(20)]
    check(spark, rows, anchor_every=20)


def test_empty(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0], 1)], [(100, [], 1), (200, [], 2)]):
        out = hn.mine_hard_negatives(vectors(spark, rows))
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    got = [tuple(r) for r in QUERIES["op11_multi_index_negatives"](spark, sf_dir).collect()]
    assert Counter(got) == Counter(plain(rows)) and got


def test_cells_come_by_falling_bound():
    rng = random.Random(4)
    a, b = (np.array([rng.uniform(-5, 5) for _ in range(n)]) for n in (7, 9))
    seen = list(hn._visits(a, b))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(7) for j in range(9)]
    assert all(x >= y for (x, *_), (y, *_) in zip(seen, seen[1:])) and all(abs(s - a[i] - b[j]) < 1e-12 for s, i, j in seen)


def test_far_cells_are_left_out(spark, monkeypatch):
    """On well separated vectors a search reads few rows, and finds the same as reading all."""
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(32) * 100, 40, axis=0) + rng.integers(0, 3, (1280, 32))
    rows = vectors(spark, [(i, [float(c) / 256 for c in v], 0) for i, v in enumerate(x)])
    monkeypatch.setattr(hn, "CELL_ROWS", 5)
    coded, books = hn.index(hn.usable(rows))
    shard = hn._Shard(coded.toArrow(), books)
    read = []
    score = shard.scores
    shard.scores = lambda at, q: read.append(len(at)) or score(at, q)
    monkeypatch.setattr(hn, "SCORE_ROWS", 1)
    (places, scores), = shard.search(x[0], lambda at: np.ones(len(at), bool), [{"low": hn._LOWEST, "high": hn._HIGHEST}], 5)
    assert sum(read) < 400 and scores.tolist() == sorted((x @ x[0]).astype(int).tolist())[::-1][:5]
