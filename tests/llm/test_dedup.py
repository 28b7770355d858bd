"""Exact and near duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from dealgrid.llm import exact_dedup, near_dedup
from dealgrid.llm.common import connected_components, table

from .conftest import frame, texts


def same(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[same(t)].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("block_chars", [1, 3, 4096])
def test_exact_duplicates(spark, messy, block_chars):
    rows = [(i, t) for i, t, *_ in texts()]
    if block_chars < 4096:
        rows = [(i, t) for i, t in rows if len(t or "") < 1000]
    groups = plain_groups(rows)
    got = exact_dedup.exact_duplicates(frame(spark, [(i, t, None, None) for i, t in rows]), block_chars).collect()
    want = sorted([(str(i), str(groups[same(t)][0]), groups[same(t)][1], hashlib.sha256(same(t).encode()).hexdigest()) for i, t in rows])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_names_never_meet(spark):
    """Many texts over a tiny alphabet, so that blocks and pairs repeat at all levels."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(14)))) for i in range(1500)]
    groups = plain_groups(rows)
    got = exact_dedup.exact_duplicates(frame(spark, [(i, t, None, None) for i, t in rows]), 2).collect()
    by_id = dict(rows)
    assert all((r.keep_id, r.group_size) == groups[by_id[r.doc_id]] for r in got) and len(got) == len(rows)


def test_exact_stage(messy, no_docs):
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = plain_groups([(i, t) for i, t, *_ in texts()])
    assert sorted(same(t) for _, t in got) == sorted(groups)
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0 and exact_dedup.exact_duplicates(no_docs).count() == 0


def sets_of(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    width = min(size, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def plain_near(rows, size):
    """component of each row's index, by all pairs."""
    sets, parent = [sets_of(t, size) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    return [(i, len(sets[k]), min((x for x in ids[root(k)] if x is not None), default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_copies(seed=5):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 6, 30, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 15)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.3 else "\n".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = near_copies() + [(1000 + (i or 0), t) for i, t, *_ in texts()]
    got = near_dedup.near_duplicates(frame(spark, [(i, t, None, None) for i, t in rows]), size).collect()
    want = plain_near(rows, size)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_cut_buckets(spark, monkeypatch):
    """Large buckets meet cut by cut; nothing is lost."""
    monkeypatch.setattr(near_dedup, "CUT", 3)
    rows = near_copies(9)
    got = near_dedup.near_duplicates(frame(spark, [(i, t, None, None) for i, t in rows]), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_near(rows, 2))


def test_long_texts_are_compared_few_at_a_time():
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(50_000))
    other = text.replace("word25000 ", "another ")
    pairs = pa.RecordBatch.from_pydict({"a": list(range(30)), "b": list(range(30, 60)), "text_a": [text] * 30, "text_b": [other, text, None] * 10})
    out = list(near_dedup.compared_texts(iter([pairs]), 2, 80))
    assert max(b.nbytes for b in out) < near_dedup.BATCH_BYTES and len(out) > 3 and sum(b.num_rows for b in out) == 30
    got = pa.Table.from_batches(out)
    assert got.column("a").to_pylist() == list(range(30)) and got.column("linked").to_pylist() == [True, True, False] * 10
    assert [len(x) // 8 for x in got.column("apart").to_pylist()[:3]] == [4, 0, len(near_dedup.shingles(text.encode(), 2))]
    assert np.frombuffer(got.column("apart")[2].as_py(), np.uint64).tolist() == near_dedup.shingles(text.encode(), 2).tolist()


def test_near_stage(spark, messy, no_docs):
    kept = near_dedup.drop_near_duplicates(messy, 2)
    assert kept.columns == messy.columns
    rows = [(i, t) for i, t, *_ in texts()]
    got = {(r.doc_id, r.text) for r in kept.collect()}
    blank = {(i, t) for i, t in rows if not sets_of(t, 2)}
    assert blank <= got
    components = {c for (_, t), (_, _, c) in zip(rows, plain_near(rows, 2)) if sets_of(t, 2)}
    assert len(got - blank) == len(components)
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.drop_near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_the_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_near(rows, 2))


def test_odd_sketches_rule_out_no_link():
    """Sets around the threshold: sketches of links never differ in too many bits, those of unlike sets nearly always do."""
    import numpy as np

    rng = np.random.default_rng(1)
    limit = near_dedup.max_differing_bits(0.8)
    likes = {0.8: [], 0.3: []}
    for target, found in likes.items():
        for _ in range(150):
            n = 300
            common = round(2 * n * target / (1 + target))
            base = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = base[:n], np.concatenate([base[:common], base[n:]])
            rows = near_dedup.odd_sketches(np.stack([near_dedup._minima(a), near_dedup._minima(b)]))
            found.append(int(np.unpackbits((rows[0] ^ rows[1]).view(np.uint8)).sum()))
    assert max(likes[0.8]) <= limit and np.mean(np.array(likes[0.3]) > limit) > 0.95


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)] + [(7, 7), (100, 101)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
