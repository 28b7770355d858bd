"""URL verdicts, mixing, archives, token counts and subword encoding against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealgrid.llm import mixing, pieces, queries, subword, token_counts, url_filter, warc
from dealgrid.session import shared_folder

from .conftest import frame, texts

PAGES = "page_id long, url string, html string, host string, verdict string, node string, record string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "h", "v", "n", "r") for r in rows], PAGES)


def link(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


URLS = [
    (1, "https://Shop.Example.COM/en/x?q=1#top", None),
    (2, "http://www.example.com/en/", ""),
    (3, "http://b.example.com/de/", ""),
    (4, "http://x.net/es/1", ""),
    (5, "http://alias.org/one", link("http://x.net/es/1?utm_source=mail")),
    (6, "https://alias.org/two#frag", '<META http-equiv="refresh" content="0; url=/one">'),
    (7, "http://www.example.com/en/page", link("http://alias.org/one")),
    (8, "http://clean.org/a", link("http://clean.org/b")),
    (9, None, link("http://x.net/es/1")),
    (10, "no scheme/es/", ""),
    (11, "", ""),
    (12, "http://alias.org/two?ref=home", None),
    (13, "ftp://net/fr/", ""),
    (13, "ftp://net/fr/", ""),
    (14, "http://net/fr", ""),
    (None, "http://deep.x.net/fr/" + "a" * 5000, ""),
]


def plain_rule(host, path):
    fits = [(len(r), v, r) for v, r in queries.URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_aliases(spark):
    got = url_filter.judge_urls(pages_of(spark, URLS), queries.URL_RULES).collect()
    assert len(got) == len(URLS)
    by_id = {r.page_id: r for r in got}
    for page_id, url, _ in URLS:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        r = by_id[page_id]
        verdict, rule = plain_rule(host.lower(), path)
        assert (r.host, r.path, r.rule) == (host.lower(), path, rule)
        if rule:
            assert r.verdict == verdict
    # The blocked page, the page that links to it, and the redirect to that one are a class; an explicit allow stays.
    assert [by_id[k].verdict for k in (4, 5, 6, 12, 7, 8, 9, 10, 11)] == ["block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert url_filter.judge_urls(pages_of(spark, []), queries.URL_RULES).count() == 0


def test_blocks_reach_every_kind_of_link(spark):
    """Targets relative to the document or a base, entities, and links after the first one."""
    refresh = '<meta http-equiv=refresh content="{}">'
    cases = [
        ("http://a.x.net/fr/", "http://s.org/up/one", link("two?id=1&amp;b=2"), "http://s.org/up/two?id=1&b=2"),
        ("http://b.x.net/fr/", "http://t.org/a/b/c", link("../x"), "http://t.org/a/x"),
        ("http://c.x.net/fr/", "http://u.org/p", link("?id=3"), "http://u.org/p?id=3"),
        ("http://d.x.net/fr/", "http://v.org/p", "<base href='http://w.org/q/'>" + link("r"), "http://w.org/q/r"),
        ("http://e.x.net/fr/", "http://y.org/p", refresh.format("5") + refresh.format("0; url='z&#46;html'"), "http://y.org/z.html"),
        ("http://f.x.net/fr/", "http://z.org/p", link("") + link("http://z.org/first") + "<LINK href=/second rel='nofollow Canonical'>", "http://z.org/second"),
    ]
    rows = [(10 * k, blocked, link(to)) for k, (blocked, _, _, to) in enumerate(cases)] + [(10 * k + 1, url, html) for k, (_, url, html, _) in enumerate(cases)]
    rows += [(98, "http://free.org/a", "<!-- " + link("http://a.x.net/fr/") + " -->" + link("http://[x/") + link("mailto:x")), (99, "http://free.org/b", link("a"))]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages_of(spark, rows), queries.URL_RULES).collect()}
    assert {k: v for k, v in got.items() if k % 10 == 1} == {10 * k + 1: "block" for k in range(len(cases))}
    assert got[98] == got[99] == "allow"


def test_redirect_table(spark):
    pages = pages_of(spark, [(1, "http://a.org/1", ""), (2, "http://b.org/2", "")])
    moved = spark.createDataFrame([("http://a.org/1", "http://c.org/3"), ("http://c.org/3", "http://y.net/fr/"), (None, "http://b.org/2")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, queries.URL_RULES, moved).collect()}
    assert got == {1: "block", 2: "allow"}


def plain_copies(rows, weights, seed, epochs=1.0):
    chars = Counter()
    for _, t, _, s in rows:
        chars[s or ""] += len(t or "") + 1
    total, mass = sum(chars.values()), sum(weights.get(s, 1.0) for s in chars)
    out = Counter()
    for i, t, _, s in rows:
        key = str(i) if i is not None else "null:" + hashlib.md5((t or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate = epochs * total * weights.get(s or "", 1.0) / mass / chars[s or ""]
        k, below = 0, 0.0
        while rate > 0 and (below := below + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) < u:
            k += 1
        out[(i, t)] += k
    return +out


@pytest.mark.parametrize("entries", [10**6, 0])
def test_poisson_copies(spark, messy, no_docs, monkeypatch, entries):
    """Both joins with the rates give the same copies, very high rates too."""
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", entries)
    weights = {"src0": 3.0, "src1": 0.25, "src3": 0.0, "src2": 40.0}
    got = mixing.replicate(messy, weights, epochs=2.0, seed=4)
    assert got.columns == [c for c in messy.columns if c != "replica"] + ["replica", "shuffle_key"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == plain_copies(texts(), weights, 4, 2.0)
    assert not any(r.source == "src3" for r in rows) and any(r.replica > 1000 for r in rows)
    assert mixing.replicate(no_docs, weights).count() == 0


def test_mixture_shares(spark):
    """Over many documents the copies' volume follows the weights."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 7 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source")
    weights = {"hot": 1.0, "s0": 3.0}
    got = mixing.replicate(docs, weights).selectExpr("source", "length(text) + 1 as n").groupBy("source").sum("n").collect()
    volume = {r[0]: r[1] for r in got}
    mass = sum(volume.values())
    for s in volume:
        assert abs(volume[s] / mass - weights.get(s, 1.0) / 8.0) < 0.015


def test_archives_round_trip(spark):
    html = ["", None, "same", "same", "same", "é" * 20_000 + "\r\n\r\nWARC/1.1\r\n" + "z" * 50_000, "long" * 9_000, "long" * 9_000, "a\r\n\r\nb", "0\r\n\r\n"]
    rows = [(k, f"http://x/{k} y\r\n" if k % 2 else None, h) for k, h in enumerate(html)] + [(None, "u", "same"), (3, "again", "other")]
    path = shared_folder(spark, "warc-test")
    warc.write_archives(pages_of(spark, rows), path)
    got = warc.read_archives(spark, path).collect()
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        kind = "response" if i == newest[h or ""] else "revisit"
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, str(newest[h or ""] if kind == "revisit" else None), "ok", data if kind == "response" else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.status, r.payload and bytes(r.payload) if r.payload else (b"" if r.record_type == "response" else None)) for r in got) == sorted(want, key=lambda w: w[:6])
    files = list(Path(path.removeprefix("file:")).rglob("*.gz"))
    assert b"WARC-Type: continuation" in b"".join(gzip.decompress(f.read_bytes()) for f in files)


def test_broken_archives(spark, tmp_path):
    """A missing segment, a wrong total, broken framing and a wrong digest are told, and cost no other record."""
    payload = b"q" * 100_000
    whole = list(warc._records(1, "u", payload, None, "a"))
    assert len(whole) > 3
    short = list(warc._records(2, "u", payload, None, "b"))
    del short[1]
    wrong = [r.replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9") for r in warc._records(3, "u", payload, None, "c")]
    framing = [r.replace(b"\r\n\r\n3\r\nabc", b"\r\n\r\n4\r\nabc") for r in warc._records(4, "u", b"abc", None, "d")]
    digest = [r.replace(warc.base32_sha1(b"abc").encode(), b"A" * 32) for r in warc._records(5, "u", b"abc", None, "e")]
    # Segments in any order and in several files.
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(r + warc.END for r in (*whole[::-2], *short, *framing))))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"".join(r + warc.END for r in (*wrong, *whole[-2::-2], *digest))))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b""))
    got = {r.page_id: (r.status, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {1: ("ok", payload), 2: ("segments incomplete", None), 3: ("segments incomplete", None), 4: ("framing broken", None), 5: ("digest differs", b"abc")}


def test_no_pages(spark):
    path = shared_folder(spark, "warc-empty")
    warc.write_archives(pages_of(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20_000))
def test_chunks(data):
    assert warc.unchunked(warc.chunked(data)) == data


def test_token_counts(messy, no_docs):
    unigram = token_counts.Unigram(pieces.default_model())
    got = token_counts.count_tokens(messy).collect()
    want = []
    for i, t, *_ in texts():
        words = pieces.PRETOKEN.findall(t or "")
        plain = {w: unigram.plain(w.replace(" ", pieces.MARK)) for w in set(words)}
        want.append((str(i), len(words), sum(plain[w][1] for w in words), round(sum(plain[w][0] for w in words), 4)))
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens, round(r.score, 4)) for r in got) == sorted(want)
    assert token_counts.count_tokens(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="theaboning▁é日\x00 ", max_size=60), max_size=30))
def test_trie_agrees_with_plain(words):
    unigram = token_counts._unigram(pieces.default_model())
    words = sorted({w for w in words if w})
    score, tokens = unigram.insert(words) if words else ([], [])
    assert [(s, n) for s, n in zip(score, tokens)] == [unigram.plain(w) for w in words]


def lists(merger, words, variant):
    flat, count = merger.encode_words(words, variant)
    ends = count.cumsum()
    return [flat[e - n : e].tolist() for e, n in zip(ends, count)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=90), min_size=1, max_size=20), st.integers(0, 3))
def test_arrays_agree_with_heap(words, variant):
    merger = subword._merger(pieces.default_model(), 0.2, 11)
    got = lists(merger, words, variant)
    assert got == [merger._spelled(merger._by_heap(w, int(merger.keys_of([w], variant)[0]))) for w in words]
    assert [merger.decode(ids) for ids in got] == [w.encode() for w in words]


def test_no_dropout_is_plain_merging():
    from sentencepiece import SentencePieceProcessor

    sp, merger = SentencePieceProcessor(model_file=pieces.default_model()), subword._merger(pieces.default_model(), 0.0, 0)
    words = ["hello", "internationalisation", "naïve", "Übergrößenträger", "zzzzqqq", "the", "3.14159", "ción", "日本語", "a_b-c"]
    assert lists(merger, [" " + w for w in words], 0) == [sp.encode(w) for w in words]


def test_encoding_is_lossless_and_varies(messy, no_docs):
    coded = subword.encode(messy, dropout=0.3, seed=1).cache()
    back = subword.decode(coded).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in texts())
    assert all(r.n_pieces == len(r.pieces) for r in coded.collect())
    other, plain = subword.encode(messy, dropout=0.3, seed=2).collect(), subword.encode(messy, dropout=0.0).collect()
    count = lambda rows: sum(r.n_pieces for r in rows)
    assert {tuple(r.pieces) for r in other} != {tuple(r.pieces) for r in coded.collect()} and count(plain) < count(other)
    again = subword.encode(messy, dropout=0.3, seed=1).collect()
    assert Counter((r.doc_id, tuple(r.pieces)) for r in again) == Counter((r.doc_id, tuple(r.pieces)) for r in coded.collect())
    assert subword.encode(no_docs).count() == 0 and subword.decode(subword.encode(no_docs)).count() == 0


def test_each_occurrence_draws_its_own_merges(spark):
    """Against the heap, occurrence by occurrence; a word of a document, and the copies of one, are cut in many ways."""
    import numpy as np

    rows = [(k, t, None, None) for k, t in enumerate(["internationalisation " * 300, "the cat sat on the mat " * 40 + "x" * 70 + " 日本語 é", "", "a"])]
    copies = frame(spark, rows).drop("replica").selectExpr("*", "explode(array(1, 2)) as replica")
    got = subword.encode(copies, dropout=0.2, seed=3, replica="replica")
    keys = {(r.doc_id, r.replica): r.k for r in copies.select("doc_id", "replica", subword.document_key(copies.doc_id, copies.replica).alias("k")).collect()}
    merger = subword._merger(pieces.default_model(), 0.2, 3)
    cuts, whole = set(), {}
    for r in got.collect():
        words, want = pieces.PRETOKEN.findall(rows[r.doc_id][1]), []
        marks = subword.occurrence_marks(np.array([keys[r.doc_id, r.replica]]), np.array([len(words)]))
        for w, mark in zip(words, marks):
            own = merger._spelled(merger._by_heap(w, int(merger.marked(merger.keys_of([w], 0), np.array([mark]))[0])))
            want += own
            cuts.add((r.doc_id, r.replica, tuple(own)))
        assert r.pieces == want
        whole.setdefault(r.doc_id, set()).add(tuple(r.pieces))
    assert len([c for c in cuts if c[:2] == (0, 1)]) > 10
    assert len(whole[0]) == len(whole[1]) == 2


def test_pieces_are_decoded_again(messy):
    got = subword.encode(messy, seed=1).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in texts())
    assert all(r.lossless for r in got)


def test_words_are_remembered_when_they_come_again():
    import numpy as np

    merger, documents = subword._merger(pieces.default_model(), 0.2, 7), np.array([5, 9])
    texts = ["the quick brown fox jumps over a lazy dog and the quick cat", "Überraschung im Wald: the quick cat " + "x" * 70]
    memo, cold = subword._Memo(merger), subword._Memo(merger)
    cold.encode([" and so on"], documents[:1])
    assert not cold.at and cold.once == {" and", " so", " on"}
    for turn in range(3):
        ids, counts = memo.encode(texts, documents)
        assert (" quick" in memo.at, " brown" in memo.at) == (True, turn > 0)
        words = [pieces.PRETOKEN.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        plain, n = merger.encode_words([w for x in words for w in x], 0, subword.occurrence_marks(documents, sizes))
        assert ids.tolist() == plain.tolist() and counts.sum() == n.sum()


def test_every_pair_is_found_in_its_slot():
    import numpy as np

    merger = subword._merger(pieces.default_model(), 0.0, 0)
    pairs = np.array(list(merger.table), dtype=np.int64)
    left, right = pairs >> subword.SYMBOL_BITS, pairs & ((1 << subword.SYMBOL_BITS) - 1)
    assert merger._rank(pairs, pairs, left, right).tolist() == list(merger.table.values())
    strangers = [(a, b) for a, b in zip(left.tolist(), np.roll(right, 1).tolist()) if a << subword.SYMBOL_BITS | b not in merger.table]
    a, b = (np.array(x) for x in zip(*strangers))
    assert (merger._rank(a, a, a, b) == subword._NONE).all()


def test_copies_are_numbered(spark):
    docs = frame(spark, [(1, "a", None, "s"), (1, "a", None, "s"), (1, "b", None, "s"), (None, None, None, None), (None, None, None, None)]).drop("replica")
    got = mixing.numbered(docs, 5)
    assert got.columns == [*docs.columns, "replica"]
    assert Counter((r.doc_id, r.text, r.replica) for r in got.collect()) == Counter([(1, "a", 1), (1, "a", 2), (1, "b", 1), (None, None, 1), (None, None, 2)])


def test_dropout_rate():
    """About the asked share of candidates is skipped."""
    import numpy as np

    merger, n = subword._merger(pieces.default_model(), 0.1, 5), 200_000
    rng = np.random.default_rng(0)
    skipped = merger._skipped(rng.integers(0, 1 << 62, n), rng.integers(0, 20, n), rng.integers(0, 32000, n), rng.integers(0, 32000, n))
    assert abs(skipped.mean() - 0.1) < 0.005
