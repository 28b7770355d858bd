"""Quality ranking, language-model scores, fingerprints and the pipeline against plain versions or held-out truth."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from dealgrid.llm import fingerprints, lm_scoring, quality
from dealgrid.llm.common import table

from .conftest import LONG, frame, texts


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


@pytest.fixture(scope="module")
def labelled():
    from pathlib import Path

    path = "/root/testdata/sf0.1"
    if not Path(path).exists():
        pytest.skip("no test tables on this machine")
    return path


def test_quality_of_held_out_documents(spark, labelled):
    docs, labels = table(spark, labelled, "documents"), table(spark, labelled, "labels")
    ranker = quality.fit(docs, labels, quality.training_rows(F.col("doc_id")))
    scored = quality.score_quality(docs, ranker).join(labels, "doc_id").where(~quality.training_rows(F.col("doc_id"))).collect()
    good = sorted(r.score for r in scored if r.quality == 1)
    bad = sorted(r.score for r in scored if r.quality == 0)
    auc = np.mean([np.searchsorted(good, b, "right") < 0.02 * len(good) for b in bad])
    assert len(scored) > 500 and auc > 0.95
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.98
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in scored)


def test_quality_of_odd_rows(spark, messy, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (11, 0, 0), (8, 0, 0), (8, 0, 1), (9, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.fit(messy, labels, F.lit(True))
    got = quality.score_quality(messy, ranker).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(messy, ranker)
    assert kept.columns == messy.columns
    assert Counter(str(r.doc_id) for r in kept.collect()) == Counter(str(r.doc_id) for r in got if r.predicted)
    # Equal texts score the same; empty and null texts too.
    scores = {}
    for (i, t, *_), s in zip(sorted(texts(), key=lambda x: str(x[:2])), sorted(got, key=lambda r: str(r.doc_id))):
        assert str(i) == str(s.doc_id)
    by_text = quality.score_quality(frame(spark, [(k, t, None, None) for k, (_, t, *_) in enumerate(texts())]), ranker).collect()
    for r in by_text:
        t = texts()[r.doc_id][1] or ""
        assert scores.setdefault(t, r.score) == r.score
    # Without both classes nothing is rejected.
    none = quality.fit(messy, labels.where("quality = 1"), F.lit(True))
    assert {r.predicted for r in quality.score_quality(messy, none).collect()} == {1}
    assert quality.score_quality(no_docs, none).count() == 0 and quality.fit(no_docs, labels, F.lit(True)).pairs == 0


def test_quality_learns_from_every_label(spark, monkeypatch):
    """However many labelled documents there are, each is in a pair, the rarer class in every group, and the threshold is a quantile of them all."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(["spam", "!!", "BUY", "now", "word", "plain"], 20) if k % 50 == 0 else rng.choice(["calm", "even", "plain", "word"], 20)), None, None) for k in range(1, 3001)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(k, int(k % 50 != 0), 0) for k, *_ in rows], "doc_id long, quality int, toxic int")
    seen = []
    pack = quality._grouped
    monkeypatch.setattr(quality, "_grouped", lambda rows, counts: seen.append((rows, counts, pack(rows, counts))) or seen[-1][-1])
    ranker = quality.fit(docs, labels, F.lit(True))
    packed = seen[0][2].collect()
    size = 8 * len(quality.FEATURES)
    assert seen[0][1] == {0: 60, 1: 2940} and len(packed) == 6 and sum(len(r.good) for r in packed) == 2940 * size
    assert all(len(r.bad) >= 10 * size for r in packed) and sum(len(r.bad) for r in packed) >= 60 * 3 * size
    assert ranker.pairs >= 4 * 2940 and ranker == quality.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in quality.score_quality(docs, ranker).collect()}
    assert all(got[k] == int(k % 50 != 0) for k, *_ in rows)
    values = spark.range(50_000).select(F.floor(F.col("id") / 7).cast("double").alias("v"))
    monkeypatch.setattr(quality, "FEW", 5)
    assert [quality._nth(values, n) for n in (1, 7, 8, 25_000, 50_000)] == [0.0, 0.0, 1.0, 3571.0, 7142.0]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)] + [b""]


def plain_base(rows):
    counts = Counter()
    for i, t in rows:
        if crc(i) % 10:
            counts.update(words_of(t))
    n, v = counts.total(), len(counts)
    out = []
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((str(i), crc(i) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), n, round(base, 5)))
    return sorted(out)


def shape(r):
    return (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))


def test_scores_of_odd_rows(messy, no_docs):
    got = lm_scoring.score_documents(messy).collect()
    assert sorted(map(shape, got)) == plain_base([(i, t) for i, t, *_ in texts()])
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert lm_scoring.score_documents(no_docs).count() == 0


def test_scores_without_training_rows(spark):
    held_out = [(i, "some text here", "en", "s") for i in range(200) if crc(i) % 10 == 0]
    got = lm_scoring.score_documents(frame(spark, held_out)).collect()
    assert len(got) == len(held_out) and all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) for r in got)
    assert all(r.score < -1 for r in got)


def test_scores_beat_the_base_on_held_out_documents(spark, labelled):
    got = lm_scoring.score_documents(table(spark, labelled, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > 0.97 * got[1] and got[0] / got[2] > -4.2


def test_chances_add_up():
    """After any beginning of a word, the chances of all next bytes sum to one."""
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 60, (2, lm_scoring.SLOTS), dtype=np.uint8)
    curve = np.sort(rng.random((lm_scoring.GATES, lm_scoring.CURVE)), axis=1)
    model = lm_scoring.Model(levels, rng.random((lm_scoring.GATES, lm_scoring.INPUTS)), curve)
    free = [bytes([b]) for b in range(256)]
    first = sum(10.0 ** lp for lp in [one_byte(model, b"", b) for b in free])
    after = sum(10.0 ** (one_byte(model, b"th", b) ) for b in free)
    assert abs(first - 1) < 1e-6 and abs(after - 1) < 1e-6


def one_byte(model, before, byte):
    """log10 chance of a byte after the bytes before it, from the model's own slices."""
    flat, owner, contexts = lm_scoring._laid_out([before + byte])
    bits, slots = lm_scoring._bits_and_slots(flat[len(before) : len(before) + 1], contexts[len(before) : len(before) + 1])
    gate = lm_scoring._gate(lm_scoring.LEVELS[model.levels[0, slots[-1]]] + lm_scoring.LEVELS[model.levels[1, slots[-1]]])
    x = model.weights[gate, -1]
    for k in range(len(lm_scoring.TABLE_BITS)):
        x = x + model.weights[gate, k] * (lm_scoring._LOGS[model.levels[1, slots[k]]] - lm_scoring._LOGS[model.levels[0, slots[k]]])
    at = (np.clip(x, -8, 8) + 8) * 2
    low = np.minimum(at.astype(int), lm_scoring.CURVE - 2)
    refined = model.curve[gate, low] * (1 - at + low) + model.curve[gate, low + 1] * (at - low)
    p = np.clip((lm_scoring._squash(x) + refined) / 2, 1e-6, 1 - 1e-6)
    return float(np.log10(np.where(bits == 1, p, 1 - p)).sum())


def test_adapting_is_reading_word_by_word():
    chance, times = np.array([[0.01, 1e-9, 0.2], [0.3, 1e-5, 1e-4]]), np.array([3, 1, 40])
    order = [k for k, n in enumerate(times) for _ in range(n)]
    random.Random(0).shuffle(order)
    for row, got in zip(chance, lm_scoring.adapted(chance, times)):
        seen, total = [0, 0, 0], 0.0
        for n, k in enumerate(order):
            total += math.log10((lm_scoring.URN * row[k] + seen[k]) / (lm_scoring.URN + n))
            seen[k] += 1
        assert abs(total - got) < 1e-6


def test_word_mixer_learns_and_its_chances_add_up():
    """In each class the chances of known words and the share of all others sum to one; steps make occurrences likelier, each predicted without itself."""
    rng = np.random.default_rng(5)
    true = rng.dirichlet(np.full(3000, 0.2))
    counts = np.stack([rng.multinomial(n, true) for n in (4000, 60_000)])
    log10 = np.log10(0.8 * (true + 1e-5) / (true + 1e-5).sum())
    known = counts.any(axis=0)
    unknown = 1 - (10.0 ** log10[known]).sum()
    weights = np.tile(lm_scoring.WORD_START, (lm_scoring.WORD_GATES, 1))
    weights[0] = 1, 0, 0
    gains = []
    for _ in range(4):
        sums = lm_scoring.word_sums(log10, counts, weights)
        mixer = lm_scoring.word_mixer(weights, sums, unknown)
        chances = mixer.chances(log10, counts)
        share = mixer.chances(np.array([np.log10(unknown)]), np.zeros((2, 1), np.int64))[:, 0]
        assert np.allclose(chances[:, known].sum(axis=1) + share, 1)
        gains.append(float((true * np.log(chances)).sum()))
        weights = lm_scoring.newton_step(weights, sums)
    assert gains[-1] > gains[0]


def test_bit_chances_weigh_however_large_the_corpus_is():
    """The words' learned weights don't fade as counts grow: with a hundred times the counts, the bits' chance still parts words of one count."""
    rng = np.random.default_rng(6)
    true = rng.dirichlet(np.full(2000, 0.3))
    log10 = np.log10(true + 1e-6)
    parted = []
    for scale in (1, 100):
        counts = np.full((1, 2000), 20 * scale)
        weights = np.tile(lm_scoring.WORD_START, (lm_scoring.WORD_GATES, 1))
        chances = lm_scoring.word_mixer(weights, lm_scoring.word_sums(log10, counts, weights), 0.1).chances(log10, counts)[0]
        parted.append(chances.max() / chances.min())
    assert parted[0] > 1.5 and np.isclose(*parted)


def test_batches_and_slices_give_the_same_scores(monkeypatch):
    rng = np.random.default_rng(2)
    model = lm_scoring.Model(rng.integers(0, 90, (2, lm_scoring.SLOTS), dtype=np.uint8), rng.random((lm_scoring.GATES, lm_scoring.INPUTS)), np.sort(rng.random((lm_scoring.GATES, lm_scoring.CURVE)), axis=1))
    words = [b"", b"a", b"the", "ción".encode(), b"x" * 5000, b"the"]
    whole = model.log10(words)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 7)
    assert np.allclose(whole, model.log10(words)) and np.allclose(whole, [model.log10([w])[0] for w in words])


def test_very_frequent_words_keep_their_odds(spark):
    """Counts beyond the top level are scaled together; cut off one by one, they would be equal."""
    words = spark.createDataFrame([(bytearray(b"a"), 10**9), (bytearray(b"q"), 2 * 10**10)], "word binary, c long")
    levels = lm_scoring.train(words, 2)[0].value
    flat, _, contexts = lm_scoring._laid_out([b"a"])
    # The two letters part at their fourth bit.
    slots = lm_scoring._bits_and_slots(flat[:1], contexts[:1])[1][:, 3]
    odds = lm_scoring.LEVELS[levels[1, slots]] / lm_scoring.LEVELS[levels[0, slots]]
    assert np.allclose(odds, 20, rtol=0.1)


BLANK = r"[ \t\n\x0b\f\r\p{Z}]+"
ENDS = r"[.!?\u2026\u037E\u0589\u061F\u06D4\u0964\u0965\u1362\u104B\u17D4]"
CLOSERS = r"[\p{Pe}\p{Pf}\p{Pi}\"'*]"


def paragraphs(text):
    """The parts of a text: sentences of any script, and the word runs of long ones."""
    marked = regex.sub(rf"({ENDS}{CLOSERS}{{0,3}}){BLANK}|([\u3002\uFF0E\uFF01\uFF1F\uFF61])(?![\p{{Pe}}\p{{Pf}}\p{{Po}}])|[\n\r\x0b\x0c\x85\u2028\u2029]+", lambda m: (m[1] or "") + (m[2] or "") + "\x01", text)
    out = set()
    for sentence in filter(None, marked.split("\x01")):
        words = regex.split(BLANK, sentence)
        if len(sentence) > 48 and any(len(w) >= 64 for w in words):
            words = [w[i : i + 64] for w in words for i in range(0, max(len(w), 1), 64)]
            cut = len(words) > 24
        else:
            cut = len(sentence) > 48 and len(words) > 24
            if not cut:
                out.add(sentence)
                continue
        if not cut:
            out.update(filter(None, words))
            continue
        run = []
        for i, w in enumerate(words):
            run.append(w)
            if xxhash.xxh64_intdigest(w.encode(), 42) % 8 == 0 or i == len(words) - 1:
                out.update(filter(None, (" ".join(run[k : k + 32]) for k in range(0, len(run), 32))))
                run = []
    return out


def plain_versions(rows):
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + ([None] if any(i is None for i, _ in rows) else [])
    out = []
    for i, t in rows:
        following = ids[(ids.index(i) + 1) % len(ids)]
        half = len(t or "") // 2
        longest = max(len(x or "") for k, x in rows if k == i) // 2
        pieces = min(((x or "")[:longest], sorted(signed(p) for p in paragraphs(x or "")), x or "") for k, x in rows if k == following)
        edited = (t or "")[: len(t or "") - half] + pieces[0][:half]
        out.append((i, t or "", edited, paragraphs(pieces[2])))
    return out


def signed(part):
    """The digest of a part, as the sketches hold it."""
    h = xxhash.xxh64_intdigest(part.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, messy, no_docs):
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) + rng.choice([".", "e.", "o! More", ""]) for _ in range(300)]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.choice([1, 3, 8, 40, 250])))) for k in range(40)] + [(100 + i if i is not None else None, t) for i, t, *_ in texts() if i != 11 and i != 1]
    got = fingerprints.fingerprint_versions(frame(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert len(got) == len(rows)
    nulls = sorted(hashlib.sha256(e.encode()).hexdigest() for i, _, e, _ in plain_versions(rows) if i is None)
    assert sorted(r.edited_sha256 for r in got if r.doc_id is None) == nulls
    by_id = {r.doc_id: r for r in got}
    same = {}
    for i, t, edited, following in plain_versions(rows):
        if i is None:
            continue
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert math.isclose(r.near_edited, like(paragraphs(t), paragraphs(edited))) and math.isclose(r.near_next, like(paragraphs(t), following)), i
        assert same.setdefault(t, r.fingerprint) == r.fingerprint and same.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(same.values())) == len({frozenset(paragraphs(t)) for t in same})
    assert fingerprints.fingerprint_versions(no_docs).count() == 0


def test_every_text_of_some_length_has_parts(spark):
    """An edit of the last words leaves something in common, whatever the script, the case and the marks."""
    kinds = [
        "THE CAT SAT. THE DOG RAN. THE COW SLEPT. ", "Il est allé. Puis il a mangé. Tout est passé. ", "(She said no!) And left!! \"Why?\" he asked. ",
        "猫が座った。犬が走った。牛が寝た。", "कुत्ता भागा। बिल्ली बैठी। गाय सोई। ", " ".join(f"word{k}" for k in range(120)) + " ", "same " * 200, "x" * 1000,
    ]
    rows = [(2 * k, t + "end of it") for k, t in enumerate(kinds)] + [(2 * k + 1, t + "another end") for k, t in enumerate(kinds)]
    got = spark.createDataFrame(rows, "id long, t string").select("id", fingerprints.part_digests(F.col("t")).alias("d")).collect()
    digests = {r.id: set(r.d) for r in got}
    assert all(digests[i] == {signed(p) for p in paragraphs(t)} for i, t in rows)
    assert all(0 < like(digests[2 * k], digests[2 * k + 1]) < 1 for k in range(len(kinds)))
    assert all(len(digests[2 * k]) > 2 for k in range(6))
    versions = fingerprints.fingerprint_versions(frame(spark, [(2, kinds[0] * 2, None, None), (1, kinds[5], None, None)])).collect()
    assert all(0 < r.near_edited < 1 for r in versions)


def test_repeated_ids_have_rows_of_their_own(messy):
    rows = [(i, t) for i, t, *_ in texts()]
    got = fingerprints.fingerprint_versions(messy).collect()
    assert Counter((str(r.doc_id), r.n_chars) for r in got) == Counter((str(i), len(t or "")) for i, t in rows)
    want = Counter((str(i), hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in plain_versions(rows))
    assert Counter((str(r.doc_id), r.edited_sha256) for r in got) == want


def test_registered_fingerprints(spark, sf_dir):
    """The query on a whole table against plain sets of parts."""
    from dealgrid.llm.common import table
    from dealgrid.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: r for r in QUERIES["op8_iblt_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, t, edited, following in plain_versions(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(r.near_edited, like(paragraphs(t), paragraphs(edited))) and math.isclose(r.near_next, like(paragraphs(t), following))


def test_sketches_too_small_are_tried_again(spark, monkeypatch):
    """With hardly any cells the first sketches fail, and the result is the same."""
    rng = random.Random(1)
    rows = [(k, "\n".join(f"line {rng.randrange(60)}" for _ in range(rng.randrange(60)))) for k in range(30)]
    whole = {r.doc_id: r for r in fingerprints.fingerprint_versions(frame(spark, [(i, t, None, None) for i, t in rows])).collect()}
    monkeypatch.setattr(fingerprints, "SPACE", 0.3)
    for r in fingerprints.fingerprint_versions(frame(spark, [(i, t, None, None) for i, t in rows])).collect():
        assert tuple(r) == tuple(whole[r.doc_id])


def test_one_document_follows_itself(spark):
    r = fingerprints.fingerprint_versions(frame(spark, [(5, "ab\ncd", None, None)])).first()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (5, hashlib.sha256(b"ab\nab").hexdigest(), 1.0)


def test_peeling_recovers_and_fails_honestly(spark):
    """A sketch of few cells recovers few digests; one of many that fails says so, and the retry finds them all."""
    rows = spark.range(60).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.col("id") + 1), lambda x: F.xxhash64(x, F.col("id"))).alias("d"))
    rows = rows.select("id", fingerprints._items(F.col("d")).alias("a"), fingerprints._items(F.slice("d", 1, F.greatest(F.lit(0), (F.col("id") / 2).cast("int")))).alias("b"))
    four = F.lit(fingerprints.CELLS).cast("long")
    apart = fingerprints.subtract(fingerprints.sketch(F.col("a"), four), fingerprints.sketch(F.col("b"), four))
    signed = F.expr("concat(transform(a, d -> struct(d.k as k, d.x as x, d.h as h, 1 as s)), transform(b, d -> struct(d.k as k, d.x as x, d.h as h, -1 as s)))")
    assert rows.where(apart != fingerprints.difference_sketch(signed, four)).count() == 0
    got = rows.select("id", fingerprints.peel(apart, four).alias("p"), fingerprints.differing(F.col("a"), F.col("b")).alias("n"), F.expr("transform(a, x -> x.k)").alias("ka"), F.expr("transform(b, x -> x.k)").alias("kb")).collect()
    for r in got:
        wanted = set(r.ka) ^ set(r.kb)
        assert r.n == len(wanted)
        if r.p.ok:
            assert set(r.p.found) == wanted
    assert all(r.p.ok for r in got if r.id < 3) and not all(r.p.ok for r in got)


def test_pipeline(spark, sf_dir, tmp_path):
    """Every stage against a plain version on the rows its predecessor kept; the decisions take effect."""
    import corpus_pipeline as cp

    from dealgrid.llm import queries, subword
    from dealgrid.llm.common import land

    from .test_dedup import plain_groups, plain_near, same
    from .test_text import plain_copies

    docs = table(spark, sf_dir, "documents")
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), quality.training_rows(F.col("doc_id")))
    good = {r.doc_id for r in quality.score_quality(docs, ranker).where("predicted = 1").collect()}
    one = land(stages["quality"](spark, docs, sf_dir), "t1")
    assert one.columns == columns and sorted(i for i, _ in pairs(one)) == sorted(good) and 0 < len(good) < docs.count()

    two = land(stages["exact_dedup"](spark, one, sf_dir), "t2")
    groups = plain_groups(pairs(one))
    assert two.columns == columns and sorted(i for i, _ in pairs(two)) == sorted(i for i, _ in groups.values())
    assert {same(t) for _, t in pairs(two)} == set(groups)

    three = land(stages["near_dedup"](spark, two, sf_dir), "t3")
    rows = pairs(two)
    assert three.columns == columns and sorted(i for i, _ in pairs(three)) == sorted(i for i, _, c in plain_near(rows, cp.NEAR_WORDS) if i == c)

    four = land(stages["mixing"](spark, three, sf_dir), "t4")
    full = [(r.doc_id, r.text, r.lang, r.source) for r in three.collect()]
    assert four.columns == columns and Counter(pairs(four)) == plain_copies(full, queries.SOURCE_WEIGHTS, queries.MIX_SEED, queries.MIX_EPOCHS)

    five = stages["encoding"](spark, four, sf_dir)
    assert Counter((r.doc_id, r.text) for r in subword.decode(five).collect()) == Counter(pairs(four))
    whole = cp.run(spark, sf_dir)
    assert Counter((r.doc_id, tuple(r.pieces)) for r in whole.collect()) == Counter((r.doc_id, tuple(r.pieces)) for r in five.collect())
    assert LONG


def test_queries_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from dealgrid.llm import queries
    from tools.check import compare

    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    assert len(queries.QUERIES) == 10
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
        message, _ = compare(df, con, sql)
        assert not message, (name, message)


def test_native_queries_run_no_python(spark, sf_dir):
    from dealgrid.llm import queries

    for name in ("op3_poisson_mixing", "op7_block_naming", "op8_iblt_fingerprints"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
