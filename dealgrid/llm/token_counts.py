"""Token counts by unigram dynamic programming, run once per shared prefix in a trie of the distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dealgrid.llm import pieces
from dealgrid.llm.common import small_batches

#: Pre-tokens a task remembers before it starts afresh; results don't depend on it.
MAX_WORDS = 400_000
#: Longer pre-tokens run through the same recurrence without entering the trie.
MAX_DEPTH = 48
BATCH_BYTES = 8 << 20
_BASE = np.uint64(0x100000001B3)


class Unigram:
    """Best segmentation scores of strings under a vocabulary: the pieces' log probabilities fall with their rank.

    A piece of rank r has the score -ln(r + 1) - ln(H), H normalising over the vocabulary. A character without a piece
    counts as its UTF-8 bytes, each with the lowest score. The best score wins, and of equal scores the fewest tokens.
    """

    def __init__(self, model: str):
        vocabulary = pieces.load(model)
        order = sorted(vocabulary.ids.items(), key=lambda x: x[1])
        norm = math.log(sum(1.0 / (r + 1) for r in range(len(order) + 1)))
        self.scores = {p: -math.log(r + 1) - norm for r, (p, _) in enumerate(order)}
        self.floor = -math.log(len(order) + 1) - norm
        self.longest = vocabulary.longest
        #: By length: sorted hashes of the pieces, their scores, and the top bits that occur. Two pieces of a length never share a hash.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            own = [p for p in self.scores if len(p) == size] or ["\0" * size]
            hashes = self._hashes(np.array([[ord(c) for c in p] for p in own], dtype=np.uint64).reshape(len(own), size))
            by = np.argsort(hashes)
            if len(np.unique(hashes)) < len(own):
                raise ValueError("pieces share a hash")
            maybe = np.zeros(1 << 18, dtype=bool)
            maybe[hashes >> np.uint64(46)] = True
            self.by_length.append((hashes[by], np.array([self.scores.get(p, -np.inf) for p in own])[by], maybe))

    @staticmethod
    def _hashes(chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(chars.shape[1]):
                out = out * _BASE + chars[:, k] * np.uint64(0x9E3779B97F4A7C15)
        return out

    def plain(self, text: str) -> tuple[float, int]:
        """Score and token count of one string, without a trie."""
        path = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            found = [(path[s][0] + self.scores[text[s:end]], path[s][1] - 1) for s in range(max(0, end - self.longest), end) if text[s:end] in self.scores]
            if text[end - 1] not in self.scores:
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                found.append((path[end - 1][0] + size * self.floor, path[end - 1][1] - size))
            path.append(max(found))
        return path[-1][0], -path[-1][1]

    def insert(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and token counts of distinct sorted strings: their trie is walked level by level, each prefix once."""
        score, tokens = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
        aside = [i for i, w in enumerate(words) if len(w) > MAX_DEPTH or "\0" in w]
        for i in aside:
            score[i], tokens[i] = self.plain(words[i])
        inside = np.setdiff1d(np.arange(len(words)), aside)
        if not len(inside):
            return score, tokens
        size = np.array([len(words[i]) for i in inside])
        chars = np.array([words[i] for i in inside], dtype=f"U{max(1, size.max())}").view(np.uint32).reshape(len(inside), -1)
        k = self.longest
        # Per node of the level above: hashes of its last characters, and the states of its nearest ancestors, itself first.
        hashes = np.zeros((1, k), dtype=np.uint64)
        best, count = np.full((1, k), -np.inf), np.zeros((1, k), dtype=np.int64)
        best[0, 0] = 0.0
        node, rows = np.zeros(len(inside), dtype=np.int64), np.arange(len(inside))
        fork = np.zeros(len(inside), dtype=bool)
        fork[0] = True
        for depth in range(chars.shape[1]):
            fork[1:] |= chars[1:, depth] != chars[:-1, depth]
            rows = rows[size[rows] > depth]
            first = fork[rows]
            parent, letter = node[rows[first]], chars[rows[first], depth]
            node[rows] = np.cumsum(first) - 1
            with np.errstate(over="ignore"):
                own = letter.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                hashes = np.concatenate([own[:, None], hashes[parent, : k - 1] * _BASE + own[:, None]], axis=1)
            best, count = best[parent], count[parent]
            top, fewest = np.full(len(parent), -np.inf), np.zeros(len(parent), dtype=np.int64)
            for length in range(1, min(k, depth + 1) + 1):
                table, scores, maybe = self.by_length[length - 1]
                own = hashes[:, length - 1]
                r = np.flatnonzero(maybe[own >> np.uint64(46)])
                at = np.minimum(np.searchsorted(table, own[r]), len(table) - 1)
                real = table[at] == own[r]
                r, at = r[real], at[real]
                found, used = best[r, length - 1] + scores[at], count[r, length - 1] + 1
                better = (found > top[r]) | ((found == top[r]) & (used < fewest[r]))
                r = r[better]
                top[r], fewest[r] = found[better], used[better]
                if length == 1:
                    for r in np.setdiff1d(np.arange(len(parent)), r, assume_unique=True).tolist():
                        width = len(chr(int(letter[r])).encode("utf-8", "surrogatepass"))
                        top[r], fewest[r] = best[r, 0] + width * self.floor, count[r, 0] + width
            best = np.concatenate([top[:, None], best[:, : k - 1]], axis=1)
            count = np.concatenate([fewest[:, None], count[:, : k - 1]], axis=1)
            ends = rows[size[rows] == depth + 1]
            score[inside[ends]], tokens[inside[ends]] = top[node[ends]], fewest[node[ends]]
        return score, tokens


@lru_cache(maxsize=2)
def _unigram(model: str) -> Unigram:
    return Unigram(model)


class _Memo:
    """Scores and token counts of the pre-tokens seen."""

    def __init__(self, unigram: Unigram):
        self.unigram = unigram
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.score, self.tokens = np.empty(0), np.empty(0, np.int64)

    def lookup(self, words: list[str]) -> np.ndarray:
        index = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(index < 0)
        if len(unknown):
            fresh = sorted({words[i].replace(" ", pieces.MARK) for i in unknown})
            score, tokens = self.unigram.insert(fresh)
            self.at.update((w.replace(pieces.MARK, " "), len(self.score) + i) for i, w in enumerate(fresh))
            self.score, self.tokens = np.concatenate([self.score, score]), np.concatenate([self.tokens, tokens])
            index[unknown] = [self.at[words[i].replace(pieces.MARK, " ")] for i in unknown]
        return index


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, score (natural log of the best segmentation).

    Whole texts are cut into pre-tokens, a run of spaces with the word after it or one line break. Each task inserts its
    distinct pre-tokens in a trie, computes forward scores once per prefix and keeps the scores and counts of the pre-tokens. No row
    is shuffled. A mark character counts as a space. Null and empty texts have 0 tokens and score 0; repeated rows are counted
    each. `model` is a SentencePiece model file.
    """
    path = model or pieces.default_model()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(_unigram(path))
        for batch in small_batches(batches, BATCH_BYTES, "text"):
            words = [pieces.PRETOKEN.findall(t or "") for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            index, row = memo.lookup(list(chain.from_iterable(words))), np.repeat(np.arange(len(words)), sizes)
            tokens = np.bincount(row, memo.tokens[index], len(words)).astype(np.int64)
            score = np.bincount(row, memo.score[index], len(words)).astype(np.float64)
            if len(memo.at) > MAX_WORDS:
                memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(tokens), pa.array(score)], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_pretokens long, n_tokens long, score double")
