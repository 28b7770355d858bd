"""Lossless subword encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.llm import pieces
from dealgrid.llm.common import as_bytes, list_array, small_batches

#: Chance that a candidate merge is skipped.
DROPOUT = 0.1
#: Pre-tokens up to this length are merged together in arrays; longer ones each by a heap.
MAX_WIDTH = 64
#: Pre-tokens that a task remembers before it starts afresh; results don't depend on it.
MAX_WORDS = 400_000
#: Occurrences whose candidates are drawn at once.
DRAW_WORDS = 1 << 14
BATCH_BYTES = 2 << 20
#: Bits of a symbol in a pair of two, and slots that pairs of symbols with a piece are dealt into.
SYMBOL_BITS = 21
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
_NONE = np.int64(1) << 40


class Merger:
    """Merges adjacent symbols into pieces, the piece of the lowest id first, then the leftmost; skipped candidates never merge.

    A symbol is a piece id, or the number of pieces plus a code point for a character without a piece. Whether a
    candidate, two symbols at a place of a pre-token, is skipped depends on a keyed hash of seed, variant, pre-token, the
    occurrence's mark, place and both symbols alone, so arrays and heap, and every task, give the same pieces.
    """

    def __init__(self, model: str, dropout: float, seed: int):
        self.vocabulary = pieces.load(model)
        ids = self.vocabulary.ids
        self.size = len(self.vocabulary.pieces)
        self.limit = int(dropout * (1 << 32))
        self.seed = seed
        found = sorted(
            (ids[p[:cut]] << SYMBOL_BITS | ids[p[cut:]], i) for p, i in ids.items() for cut in range(1, len(p)) if p[:cut] in ids and p[cut:] in ids
        )
        # Ordered by slot: a pair is looked for from its slot's first key on, in as many places as the fullest slot has keys.
        keys, made = np.array([k for k, _ in found], dtype=np.int64), np.array([m for _, m in found], dtype=np.int64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        filled = np.bincount(slot.astype(np.int64), minlength=SLOTS)
        self.probes = int(filled.max())
        self.keys, self.made = np.concatenate([keys[order], np.full(self.probes, -2)]), np.concatenate([made[order], np.full(self.probes, _NONE)])
        self.slot_start = np.where(filled > 0, np.cumsum(filled) - filled, -1).astype(np.int32)
        self.table = dict(found)
        self.bytes_of = [p.replace(pieces.MARK, " ").encode() for p in self.vocabulary.pieces]
        for value, i in enumerate(self.vocabulary.byte_ids):
            self.bytes_of[i] = bytes([value])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_bytes = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.piece_start = np.cumsum(self.piece_bytes) - self.piece_bytes

        # Symbol of each character below the last one that has a piece; a space is the mark, and a literal mark has no piece.
        top = max(ord(p) for p in ids if len(p) == 1) + 1
        self.symbol_of = self.size + np.arange(top, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1 and p != pieces.MARK:
                self.symbol_of[ord(p)] = i
        self.symbol_of[ord(" ")] = ids[pieces.MARK]

    @staticmethod
    def _chars(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Symbols of pre-tokens of one length, a row each."""
        chars = self._chars(words).astype(np.int64)
        known = chars < len(self.symbol_of)
        return np.where(known, self.symbol_of[np.where(known, chars, 0)], self.size + chars)

    def keys_of(self, words: list[str], variant: int) -> np.ndarray:
        """What the skips of pre-tokens of one length hang on."""
        chars = self._chars(words).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.full(len(words), (self.seed * 0x9E3779B97F4A7C15 + (variant + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for k in range(chars.shape[1]):
                key = (key ^ chars[:, k]) * np.uint64(0x100000001B3)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)

    @staticmethod
    def marked(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """What the skips of single occurrences hang on: the pre-token's key and the occurrence's mark."""
        with np.errstate(over="ignore"):
            h = key.view(np.uint64) ^ mark.view(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(27))).view(np.int64)

    @staticmethod
    def codes_of(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What of a skip hangs on the candidate."""
        with np.errstate(over="ignore"):
            return (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64))

    def _skipped(self, key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.skips(key.astype(np.uint64) ^ self.codes_of(place, left, right))

    def skips(self, h: np.ndarray) -> np.ndarray:
        """Whether candidates are skipped, from their key and code combined; `h` is overwritten."""
        with np.errstate(over="ignore"):
            h ^= h >> np.uint64(30)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
            h *= np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(32)) < np.uint64(self.limit)

    def _rank(self, key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, seen: list | None = None) -> np.ndarray:
        """The piece two symbols make, or _NONE if there is none or the candidate is skipped; with `seen`, none is skipped and all are noted there."""
        out = np.full(left.shape, _NONE)
        pair = left << SYMBOL_BITS | right
        at = self.slot_start[self._slot(pair)]
        r = np.nonzero(at >= 0)
        pair, at = pair[r], at[r]
        hit = self.keys[at] == pair
        for _ in range(self.probes - 1):
            miss = np.flatnonzero(~hit)
            at[miss] += 1
            hit[miss] = self.keys[at[miss]] == pair[miss]
        if seen is not None:
            seen.append((key[r][hit], place[r][hit], left[r][hit], right[r][hit]))
        elif self.limit:
            hit &= ~self._skipped(key[r], place[r], left[r], right[r])
        out[tuple(x[hit] for x in r)] = self.made[at[hit]]
        return out

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _merged(self, rows: np.ndarray, keys: np.ndarray, seen: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pieces of pre-tokens of one length: (row numbers, their symbols) for each number of pieces left."""
        out, number = [], np.arange(len(rows))
        place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape).copy()
        rank = self._rank(np.repeat(keys[:, None], rows.shape[1] - 1, 1), place[:, :-1], rows[:, :-1], rows[:, 1:], seen) if rows.shape[1] > 1 else np.empty((len(rows), 0), dtype=np.int64)
        while len(number):
            width = rows.shape[1]
            if width == 1:
                out.append((number, rows))
                break
            best = rank.argmin(axis=1)
            each = np.arange(len(rows))
            piece = rank[each, best]
            over = piece == _NONE
            if over.any():
                out.append((number[over], rows[over]))
                go = ~over
                rows, place, rank, number, keys, best, piece = rows[go], place[go], rank[go], number[go], keys[go], best[go], piece[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            rows[each, best] = piece
            columns = np.arange(width - 1)
            take = columns + (columns > best[:, None])
            rows, place = np.take_along_axis(rows, take, 1), np.take_along_axis(place, take, 1)
            # The rank at a place belongs to the symbol and the next: that of the merged symbol and that before it are new.
            columns = np.arange(width - 2)
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), 1)
            for at, ok in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = each[ok], at[ok]
                rank[r, c] = self._rank(keys[r], place[r, c], rows[r, c], rows[r, c + 1], seen)
        return out

    def _by_heap(self, word: str, key: int) -> list[int]:
        """The same pieces for one pre-token of any length, by an agenda of candidates."""
        symbol = self.rows_of([word])[0].tolist()
        n = len(symbol)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and symbol[i] < self.size and symbol[j] < self.size:
                made = self.table.get(symbol[i] << SYMBOL_BITS | symbol[j])
                if made is not None:
                    a = np.array
                    if not self.limit or not self._skipped(a([key]), a([i]), a([symbol[i]]), a([symbol[j]]))[0]:
                        heapq.heappush(agenda, (made, i, symbol[i], symbol[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            made, i, left, right = heapq.heappop(agenda)
            j = after[i] if alive[i] else n
            if j >= n or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, a in zip(symbol, alive) if a]

    def _spelled(self, symbols: list[int]) -> list[int]:
        """Symbols without a piece as the pieces of their UTF-8 bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass"))
        return out

    def encode_words(self, words: list[str], variant: int, marks: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of the pre-tokens, and how many each has.

        `marks` tells occurrences of a pre-token apart. With `seen`, no candidate is skipped, and (number of the pre-token, place, left, right)
        of all candidates of pre-tokens up to MAX_WIDTH are noted there.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        count, groups, single = np.zeros(len(words), np.int64), [], []
        for length in np.unique(lengths).tolist():
            numbers = np.flatnonzero(lengths == length)
            if not length:
                continue
            own = [words[i] for i in numbers.tolist()]
            keys = self.keys_of(own, variant)
            if marks is not None:
                keys = self.marked(keys, marks[numbers])
            if length > MAX_WIDTH:
                single += [(i, self._spelled(self._by_heap(words[i], k))) for i, k in zip(numbers.tolist(), keys.tolist())]
            else:
                for which, symbols in self._merged(self.rows_of(own), numbers if seen is not None else keys, seen):
                    odd = (symbols >= self.size).any(axis=1)
                    single += [(i, self._spelled(s)) for i, s in zip(numbers[which[odd]].tolist(), symbols[odd].tolist())]
                    groups.append((numbers[which[~odd]], symbols[~odd]))
                    count[groups[-1][0]] = symbols.shape[1]
        for i, ids in single:
            count[i] = len(ids)
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for which, symbols in groups:
            flat[start[which][:, None] + np.arange(symbols.shape[1])] = symbols
        for i, ids in single:
            flat[start[i] : start[i] + len(ids)] = ids
        return flat, count

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of flat piece ids, `counts` of them each."""
        lengths = self.piece_bytes[ids]
        ends = np.cumsum(lengths)
        flat = self.all_bytes[np.repeat(self.piece_start[ids] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def _merger(model: str, dropout: float, seed: int) -> Merger:
    return Merger(model, dropout, seed)


class _Memo:
    """Plain piece ids of the pre-tokens seen twice, and the candidates that plain merging meets, flat, with each pre-token's place.

    An occurrence of which no such candidate is skipped has the plain pieces; all others are merged anew, as are those of pre-tokens seen once.
    """

    def __init__(self, merger: Merger):
        self.merger = merger
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.once: set[str] = set()
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.keys, self.first, self.tries = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.candidates = np.empty(0, np.uint64)

    def _learn(self, short: list[str]) -> None:
        seen: list[tuple[np.ndarray, ...]] = []
        ids, count = self.merger.encode_words(short, 0, seen=seen)
        owner, *found = (np.concatenate(x) for x in zip(*seen)) if seen else np.empty((4, 0), np.int64)
        order = np.argsort(owner, kind="stable")
        tries = np.bincount(owner, minlength=len(short))
        keys = np.empty(len(short), np.int64)
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        for length in np.unique(lengths).tolist():
            numbers = np.flatnonzero(lengths == length)
            keys[numbers] = self.merger.keys_of([short[i] for i in numbers.tolist()], 0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.first = np.concatenate([self.first, len(self.candidates) + np.cumsum(tries) - tries])
        self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, ids])
        self.tries, self.keys = np.concatenate([self.tries, tries]), np.concatenate([self.keys, keys])
        self.candidates = np.concatenate([self.candidates, self.merger.codes_of(*(x[order] for x in found))])
        self.at.update(zip(short, range(len(self.at), len(self.at) + len(short))))

    def _drawn(self, index: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The occurrences of which a candidate is skipped, some at a time so that their candidates stay in the cache."""
        tried = np.flatnonzero(self.tries[index])
        out = [tried[:0]]
        for at in range(0, len(tried), DRAW_WORDS):
            own = tried[at : at + DRAW_WORDS]
            which = index[own]
            tries = self.tries[which]
            start = np.cumsum(tries) - tries
            codes = self.candidates[np.repeat(self.first[which] - start, tries) + np.arange(int(tries.sum()))]
            codes ^= np.repeat(self.merger.marked(self.keys[which], marks[own]).view(np.uint64), tries)
            out.append(own[np.logical_or.reduceat(self.merger.skips(codes), start)])
        return np.concatenate(out)

    def encode(self, texts: list[str], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of the texts, and how many each has; `documents` holds what a text's draws hang on besides the seed."""
        words = [pieces.PRETOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        index = np.fromiter(map(self.at.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(index < 0).tolist()
        if unknown:
            met = Counter([flat[i] for i in unknown])
            again = sorted(w for w, n in met.items() if (n > 1 or w in self.once) and len(w) <= MAX_WIDTH)
            self.once.update(w for w, n in met.items() if n == 1 and len(w) <= MAX_WIDTH)
            self.once.difference_update(again)
            if again:
                self._learn(again)
                index[unknown] = [self.at.get(flat[i], -1) for i in unknown]
        marks = occurrence_marks(documents, sizes)
        # Long pre-tokens and those seen once are not remembered.
        known = np.flatnonzero(index >= 0)
        skips = np.concatenate([np.flatnonzero(index < 0), known[self._drawn(index[known], marks[known])] if self.merger.limit else known[:0]])
        own, count = self.merger.encode_words([flat[i] for i in skips.tolist()], 0, marks[skips])
        starts, counts = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        starts[known], counts[known] = self.start[index[known]], self.count[index[known]]
        starts[skips], counts[skips] = len(self.flat) + np.cumsum(count) - count, count
        ends = np.cumsum(counts)
        ids = np.concatenate([self.flat, own])[np.repeat(starts - (ends - counts), counts) + np.arange(int(counts.sum()))]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        if len(self.at) + len(self.once) > MAX_WORDS:
            self.clear()
        return ids, np.diff(bounds)


def occurrence_marks(documents: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A mark of each pre-token of texts with these numbers of pre-tokens, by the text's document and its place in the text."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        h = np.repeat(documents, sizes).view(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def document_key(doc_id: Column, replica: Column) -> Column:
    """What a document's draws hang on besides the seed: its id, a null one as the empty text, and the number of the copy."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), replica.cast("long"))


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = 0, replica: str | None = None) -> DataFrame:
    """One row per document: doc_id, replica, n_pieces, pieces (ids), decoded_sha256, lossless, from its whole text.

    Each occurrence of a pre-token is cut on its own, by skipping candidate merges with chance `dropout`; the draws hang on seed, doc_id, the
    number in the column `replica` (0 without one), the pre-token and its place in the text. Characters without a piece become byte pieces, so every
    text decodes to itself. Null and empty texts have no piece; rows with the same id, replica and text get the same ids. With `dropout` 0 there
    is one segmentation, that of plain merging. decoded_sha256 is the digest of the text that the pieces decode to, and lossless tells whether
    that is the document's.
    """
    path = model or pieces.default_model()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path, dropout, seed)
        memo = _Memo(merger)
        for batch in small_batches(batches, BATCH_BYTES, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, counts = memo.encode(texts, batch.column("key").to_numpy(zero_copy_only=False))
            back = merger.decode_all(ids, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("replica").cast(pa.int32()), pa.array(counts, pa.int64()), list_array(ids, counts, pa.int32()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([b == t for b, t in zip(back, as_bytes(batch.column("text")))]),
                ],
                ["doc_id", "replica", "n_pieces", "pieces", "decoded_sha256", "lossless"],
            )

    number = F.col(replica) if replica else F.lit(0)
    keyed = docs.select("doc_id", "text", number.cast("int").alias("replica"), document_key(F.col("doc_id"), number).alias("key"))
    return keyed.mapInArrow(coded, "doc_id long, replica int, n_pieces long, pieces array<int>, decoded_sha256 string, lossless boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents; no pieces give the empty text, null pieces a null text."""
    path = model or pieces.default_model()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path, 0.0, 0)
        for batch in batches:
            got = [None if ids is None else merger.decode(ids).decode("utf-8", "surrogatepass") for ids in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(got, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(texts, "doc_id long, text string")
