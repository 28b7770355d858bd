"""The Merkle manifest against a plain tree, and bitmap ranks against sorting."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from dealgrid.llm import manifest
from dealgrid.llm.common import table
from dealgrid.llm.queries import QUERIES

from .conftest import frame


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_tree(nodes):
    """The root, and for each node the texts left and right of it on every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            start = p // 16 * 16
            paths[i].append(("".join(level[start:p]), "".join(level[p + 1 : start + 16])))
        level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for d, source, lang, n, text in rows:
        leaf = sha(*map(field, (d, source, lang, n, text)))
        other = sha(*map(field, (d, source, lang, n, lower(text)))) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
        groups[source].append((d is not None, d or 0, leaf, d, other))
    trees = {s: plain_tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for s, v in groups.items()}
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = plain_tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, up in zip(order, upper):
        for (_, _, leaf, d, x), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            for left, right in path + up:
                x = sha(left, x, right)
            out.append((d, leaf, trees[s][0], root, sha(*(a + b for a, b in path + up)), x, x == root))
    return out


def check(docs):
    want = plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    got = [tuple(r) for r in manifest.manifest(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


def test_messy_and_empty(messy, no_docs):
    check(messy)
    out = manifest.manifest(no_docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_all_tables(spark, sf_dir):
    got = check(table(spark, sf_dir, "documents"))
    assert QUERIES["op13_bitmap_manifest"](spark, sf_dir).where("not verified").count() == sum(not r[-1] for r in got) > 0


def test_one_leaf(spark):
    (row,) = check(frame(spark, [(5, "Lone", "en", "a")]))
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_many_sources_ties_and_far_ids(spark):
    """More sources than a run holds, ids over the whole range, null ids, ids of several rows, repeated rows."""
    rng = random.Random(5)
    ids = [None, -(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, 1 << 16, -(1 << 40), *(rng.getrandbits(64) - (1 << 63) for _ in range(40)), *range(200, 330)]
    rows = [(i, f"Text {rng.randrange(9)}", "en", rng.choice(["é", "Z", "z", None, "hot", "hot", "hot", *(f"s{k}" for k in range(30))])) for i in ids * 3]
    check(frame(spark, rows + rows[:50]))


def test_unfolded_copies(spark, monkeypatch):
    """A row repeated far more often than one step unfolds, between other leaves."""
    monkeypatch.setattr(manifest, "UNFOLD", 7)
    check(frame(spark, [(2, "same", "en", "a")] * 40 + [(i, "other", "en", "a") for i in range(5)]))


def test_ranks_follow_order(spark):
    rows = spark.range(3000).select(F.lit("a").alias("key"), (F.xxhash64("id") % 10_000_000_000).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("tampered"))
    got = sorted((r.pos, r.doc_id) for r in manifest.leaf_places(rows).collect())
    assert [p for p, _ in got] == list(range(3000)) and [d for _, d in got] == sorted(d for _, d in got)
