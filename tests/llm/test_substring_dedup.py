"""Repeated passages against plain window sets, and the consistency of window keys."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from dealgrid.llm import substring_dedup as sd
from dealgrid.llm.common import table
from dealgrid.llm.queries import QUERIES

from .conftest import frame, texts


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain_repeats(rows, size):
    """(doc_id, n_words, n_removed, kept_sha256) of every row, window by window."""
    last = (1 << 63) - 1
    lowest = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            lowest[key] = min(lowest.get(key, last), last if i is None else i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for p in range(len(w) - size + 1):
            if lowest[tuple(w[p : p + size])] < (last if i is None else i):
                gone.update(range(p, p + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(docs, size=sd.WINDOW):
    want = plain_repeats([(r.doc_id, r.text) for r in docs.collect()], size)
    got = [tuple(r) for r in sd.remove_repeats(docs, size).collect()]
    assert Counter(got) == Counter(want)
    return want


def test_messy_and_empty(messy, no_docs, spark):
    check(frame(spark, [t for t in texts() if len(t[1] or "") < 1000]), 4)
    assert sum(n for _, _, n, _ in sd.remove_repeats(messy).collect()) == 0
    out = sd.remove_repeats(no_docs)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == 0


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = check(docs)
    assert sum(r.n_removed for r in QUERIES["op12_recompression_repeats"](spark, sf_dir).collect()) == sum(n for _, _, n, _ in want) > 0


@pytest.mark.parametrize("alphabet", [1, 2, 30])
def test_small_alphabets(spark, alphabet):
    """Runs, periods and overlapping repeats; copies, repeated ids, null ids and a passage that most texts hold."""
    rng = random.Random(alphabet)
    draw = lambda n: " ".join(f"w{rng.randrange(alphabet)}" for _ in range(n))
    passage = draw(9)
    bodies = [draw(rng.randrange(40)) for _ in range(60)]
    bodies += [f"{draw(rng.randrange(9))} {passage}  {draw(rng.randrange(9))}" for _ in range(60)] + bodies[:20]
    ids = [rng.choice([None, *range(100)]) for _ in bodies]
    check(frame(spark, [(i, b, None, None) for i, b in zip(ids, bodies)]), 7)


@pytest.mark.parametrize("size", [3, 8, 50])
def test_equal_windows_have_equal_keys(size):
    rng = random.Random(size)
    for alphabet in (1, 2, 5, 100):
        parts = [[b"%d" % rng.randrange(alphabet) for _ in range(rng.randrange(150))] for _ in range(12)]
        lists = parts + [a[: rng.randrange(len(a) + 1)] + rng.choice(parts) + a[rng.randrange(len(a) + 1) :] for a in parts]
        keys = sd.anchor_keys(*sd._walled([sd._hashes(t) for t in lists]), size)
        seen, at = {}, 1
        for t in lists:
            for p in range(len(t) - size + 1):
                assert keys[at + p] != 0 and seen.setdefault(tuple(t[p : p + size]), keys[at + p]) == keys[at + p]
            at += len(t) + 1


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(0)
    lists = [[b"%d" % rng.randrange(9) for _ in range(n)] for n in (0, 7, 8, 300)]
    whole = sd.text_keys(lists, 8)
    monkeypatch.setattr(sd, "PIECE", 20)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, sd.text_keys(lists, 8)))


def test_keys_follow_the_text():
    """Few keys for many windows: neighbours share the symbol that they hold."""
    rng = random.Random(1)
    text = [b"%d" % rng.randrange(5000) for _ in range(20_000)]
    assert len(sd.text_keys([text], 50)[0]) < len(text) / 4
