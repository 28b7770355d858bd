"""Substring duplicates by recompression: rounds name word runs and pairs; symbols that several texts share reveal long repeats, windows verify them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.llm.common import as_bytes, land, list_array, small_batches

#: Words of a window.
WINDOW = 50
#: Rounds of pair naming. By then the words that fix a symbol are more than any window holds.
ROUNDS = 24
#: Words that are parsed at once; a longer text is cut into pieces that overlap by a window less one word, which changes nothing.
PIECE = 1 << 18
BATCH_BYTES = 2 << 20
#: Order of a null doc_id: behind all others.
LAST_ID = (1 << 63) - 1

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_RUN, _PAIR, _PLAIN = (np.uint64(x) for x in (0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(text: bytes) -> list[bytes]:
    return text.split()


def _walled(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several word sequences as one, with a wall before, between and after them."""
    n = sum(map(len, hashes)) + len(hashes) + 1
    flat, wall = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    wall[0], at = True, 1
    for h in hashes:
        flat[at : at + len(h)] = h
        at += len(h)
        wall[at] = True
        at += 1
    return flat, wall


class _Digests:
    """Polynomial digests of any range of a sequence of word hashes."""

    def __init__(self, flat: np.ndarray, base: int):
        powers = self._powers(base, len(flat))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(flat * powers, dtype=np.uint64)])
        self.inverse = self._powers(pow(base, -1, 1 << 64), len(flat))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.inverse[low]


def window_starts(wall: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of `size` words starts at each place, walls outside."""
    walls = np.cumsum(wall)
    out = np.zeros(len(wall), dtype=bool)
    if len(wall) >= size:
        out[: len(wall) - size + 1] = walls[size - 1 :] == walls[: len(wall) - size + 1]
    return out & ~wall


def anchor_keys(flat: np.ndarray, wall: np.ndarray, size: int) -> np.ndarray:
    """For every window, the key of its highest symbol that the window's own words fix; equal windows get equal keys.

    Round 0 names maximal runs of a word by word and length. Each further round splits the symbols by a bit of their name and names every pair
    of a 0-symbol and the 1-symbol after it. [low, high) are the words that fix a symbol: a pair needs what fixes its parts, an
    unpaired 0-symbol also what fixes its right neighbour, an unpaired 1-symbol its left one, a run the words on both sides. Of the symbols that lie in
    a window together with what fixes them, the one named last counts, then the leftmost. Its key holds its name and all words that fix it. A
    window inside two runs holds no such symbol; it is its own key.
    """
    with np.errstate(over="ignore"):
        digests = _Digests(flat, _BASES[0])
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = (flat[1:] != flat[:-1]) | wall[1:] | wall[:-1]
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(flat))
        runs = (end - start).astype(np.uint64)
        name, walls = flat[start], wall[start]
        name = np.where(runs > 1, _mixed(name * _RUN + runs), name)
        low, high = np.where(walls, start, start - 1), np.where(walls, end, end + 1)
        keys = np.zeros(len(flat), dtype=np.uint64)
        for level in range(ROUNDS + 1):
            inside = np.flatnonzero(~walls & (high - low <= size))
            if not len(inside):
                break
            first = np.maximum(low[inside - 1] + 1, high[inside] - size)
            count = low[inside] + 1 - first
            inside, first, count = (x[count > 0] for x in (inside, first, count))
            symbol = _mixed(name[inside] * _PAIR + digests.of(low[inside], high[inside])) + np.uint64(level)
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            keys[at] = np.repeat(symbol, count)
            # The next round: bits of the names part them, a 0 and a 1 next to each other become one.
            one = (_mixed(name + np.uint64(level + 1) * _RUN) >> np.uint64(63)).astype(bool)
            left, right = ~one & ~walls, one & ~walls
            a = np.flatnonzero(left[:-1] & right[1:])
            paired = np.zeros(len(name), dtype=bool)
            paired[a] = paired[a + 1] = True
            open_left, open_right = np.flatnonzero(left & ~paired), np.flatnonzero(right & ~paired)
            new_low, new_high = low.copy(), high.copy()
            new_high[open_left] = high[open_left + 1]
            new_low[open_right] = low[open_right - 1]
            new_high[a] = high[a + 1]
            name = name.copy()
            name[a] = _mixed(_mixed(name[a] + _PAIR) * _PLAIN + name[a + 1])
            stays = np.ones(len(name), dtype=bool)
            stays[a + 1] = False
            name, walls, low, high = name[stays], walls[stays], new_low[stays], new_high[stays]
        starts = window_starts(wall, size)
        bare = np.flatnonzero(starts & (keys == 0))
        keys[bare] = _mixed(digests.of(bare, bare + size) ^ _PLAIN)
        keys[~starts] = 0
        return keys


def _pieces(words: list, size: int) -> Iterator[tuple[int, list]]:
    """(offset, words) of pieces that together hold each window once."""
    step = max(PIECE - size + 1, 1)
    for at in range(0, max(len(words) - size + 1, 1), step):
        yield at, words[at : at + step + size - 1]


def _hashes(words: list[bytes], digest=xxhash.xxh3_64_intdigest) -> np.ndarray:
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def text_keys(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """The distinct window keys of each text."""
    parts = [(i, _hashes(piece)) for i, words in enumerate(texts) if len(words) >= size for _, piece in _pieces(words, size)]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    if parts:
        keys = anchor_keys(*_walled([h for _, h in parts]), size)
        at = 1
        for i, h in parts:
            own = keys[at : at + len(h) - size + 1]
            out[i].append(own[np.flatnonzero(np.append(True, own[1:] != own[:-1]))])
            at += len(h) + 1
    return [np.unique(np.concatenate(k)) if k else np.empty(0, dtype=np.uint64) for k in out]


def _parsed(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, text_key, n_words, identity (sha256 of the words joined by one space), keys of its windows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES, "text"):
            texts = [words_of(t) for t in as_bytes(batch.column("text"))]
            keys = text_keys(texts, size)
            flat = np.concatenate(keys).view(np.int64)
            columns = [
                batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(t)).digest() for t in texts], pa.binary()), list_array(flat, np.array([len(k) for k in keys]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "identity", "keys"])

    return _keyed(docs).mapInArrow(parse, "doc_id long, text_key long, n_words long, identity binary, keys array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "text")


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """(cid, ord, pos, a, b): the windows of the texts whose key is among `shared`, each with a digest of 128 bits of its words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES, "text"):
            shared = batch.column("shared").to_pylist()
            texts = [words_of(t) for t in as_bytes(batch.column("text"))]
            parts = [(i, at, piece) for i, words in enumerate(texts) if len(words) >= size for at, piece in _pieces(words, size)]
            if not parts:
                continue
            flat, wall = _walled([_hashes(p) for _, _, p in parts])
            other, _ = _walled([_hashes(p, xxhash.xxh64_intdigest) for _, _, p in parts])
            keys = anchor_keys(flat, wall, size)
            rows, places, spots = [], [], []
            at = 1
            for i, offset, piece in parts:
                found = np.flatnonzero(np.isin(keys[at : at + len(piece) - size + 1], np.array(shared[i], dtype=np.int64).view(np.uint64)))
                rows.append(np.full(len(found), i))
                places.append(found + offset)
                spots.append(found + at)
                at += len(piece) + 1
            row, place, spot = (np.concatenate(x) for x in (rows, places, spots))
            with np.errstate(over="ignore"):
                a, b = (_Digests(h, base).of(spot, spot + size).view(np.int64) for h, base in zip((flat, other), _BASES))
            take = pa.array(row)
            columns = [batch.column("cid").take(take), batch.column("ord").take(take), pa.array(place.astype(np.int32)), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "ord", "pos", "a", "b"])

    return texts.select("cid", "ord", "text", "shared").mapInArrow(digest, "cid long, ord long, pos int, a long, b long")


def kept_words(words: list[bytes], starts: list[int], size: int) -> list[bytes]:
    """The words that no window starting at one of `starts` covers."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, np.array(starts, dtype=np.int64), 1)
    np.add.at(change, np.array(starts, dtype=np.int64) + size, -1)
    return [w for w, covered in zip(words, np.cumsum(change)[:-1].tolist()) if not covered]


def _cut(texts: DataFrame, size: int) -> DataFrame:
    """(identity, n_removed, kept_text): what is left of each text without its windows at `starts`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES, "text"):
            removed, kept = [], []
            for text, starts in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist()):
                words = words_of(text)
                left = kept_words(words, starts, size)
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("identity"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["identity", "n_removed", "kept_text"])

    return texts.select("identity", "text", "starts").mapInArrow(cut, "identity binary, n_removed long, kept_text string")


def repeated_passages(docs: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, firsts, cuts): per document doc_id, ord, n_words, identity; per text of `size` words or more identity and first_ord; per text with removed words
    identity, n_removed, kept_text.

    A window is `size` consecutive words. A word goes if it lies in a window whose words also start in a document with a smaller doc_id. A document that
    comes after the first of its identity loses all of its words; the others have the cut of their identity, or none. `ord` is the doc_id, a
    null one larger than any other; rows of one doc_id take nothing from each other.

    Names are 64-bit hashes of what they name (word and length of a run, both parts of a pair), so tasks agree on them without moving
    the corpus in every round. A key met in one text only can't belong to a repeat; this is counted over all distinct texts. Windows of shared keys
    are compared by 128-bit digests of all their words, so a collision of names costs a comparison and no word. No pairs are formed: a digest
    keeps its smallest doc_id, and windows look theirs up.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("ord")
    rows = land(_parsed(docs, size), "parsed").withColumn("ord", order)
    long_rows = rows.where(F.col("n_words") >= size)
    first = F.min(F.struct("ord", "doc_id", "text_key", "keys"))
    texts = land(long_rows.groupBy("identity").agg(first.alias("first")).select("identity", "first.*"), "texts")
    places = texts.select("identity", F.explode("keys").alias("key"))
    shared = land(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    marked = places.join(shared, "key").groupBy("identity").agg(F.collect_list("key").alias("shared"))
    marked = marked.join(texts.drop("keys"), "identity").withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    found = _keyed(docs).join(marked, same).select(F.monotonically_increasing_id().alias("cid"), "identity", "ord", "text", "shared")
    found = land(found, "revealed")

    windows = _windows(found, size)
    firsts = windows.groupBy("a", "b").agg(F.min("ord").alias("lowest"), F.max("ord").alias("highest")).where("lowest < highest")
    firsts = land(firsts.select("a", "b", "lowest"), "window-firsts")
    taken = windows.join(firsts, ["a", "b"]).where("ord > lowest").groupBy("cid").agg(F.collect_list("pos").alias("starts"))
    cuts = land(_cut(found.join(taken, "cid"), size).dropDuplicates(["identity"]), "cuts")

    return rows, texts.select("identity", F.col("ord").alias("first_ord")), cuts


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), see `repeated_passages`.

    Null, empty and blank texts have no words. Rows that agree in doc_id and text have equal results. An empty table gives an empty
    result. Other columns are not read.
    """
    rows, firsts, cuts = repeated_passages(docs, size)
    left = cuts.select("identity", "n_removed", F.sha2("kept_text", 256).alias("kept"))
    # One landed row per text, so that the join with a text of very many copies can be split.
    texts = land(firsts.join(left, "identity", "left"), "text-results")
    out = rows.join(texts, "identity", "left")
    copy = F.coalesce(F.col("ord") > F.col("first_ord"), F.lit(False))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("identity"))))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
