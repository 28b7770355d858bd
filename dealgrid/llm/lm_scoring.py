"""Language-model scores by logistic context mixing: hashed-context bit predictors, gated weights, adaptive refinement."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.llm.common import as_bytes, crc_mod, land, small_batches

#: Texts of about this size share a dictionary while their words are looked up.
CHUNK_BYTES = 32 << 20
#: Distinct words a task learns from.
WORDS_PER_TASK = 700_000
#: Characters of input for each bucket of words; words meet their counts bucket by bucket. Least and most buckets.
CHARS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 48, 16384
#: Words in an online step, and bytes whose bits are predicted at once.
STEP_WORDS, SLICE_BYTES = 512, 1 << 15
#: log2 of the slots of each predictor: one, two, three and four bytes before, and the word so far.
TABLE_BITS = (16, 18, 20, 21, 22)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
SLOTS = int(OFFSETS[-1])
SEGMENT = 1 << 13
INPUTS = len(TABLE_BITS) + 1
#: A gate is one of 8 bits and 6 degrees of evidence for the word so far; each has its own weights and refinement curve.
EVIDENCE = np.array([0.5, 3.0, 30.0, 300.0, 3000.0])
GATES, CURVE = 48, 33
RIDGE, START_WEIGHT, PRIOR = 20.0, 0.3, 0.4
#: Tokens of prior belief that a document's own words are weighed against as it is read.
URN = 2000.0
#: Languages of the training documents that are classes of their own, the most frequent first; the rest is one more class.
MAX_LANGUAGES = 8
#: Counts of a word in a class from which on its degree is the next; a degree and whether other classes have the word are a gate of the word mixer.
COUNT_EDGES = np.array([1, 2, 3, 5, 9, 17, 65, 513])
WORD_GATES = 2 * (len(COUNT_EDGES) + 1)
#: Weights that the word mixer starts from, for the bits' chance, the class's count and the other classes' count, and its Newton steps.
WORD_START, WORD_STEPS = np.array([0.3, 0.7, 0.0]), 3
#: Counts are kept in a byte each: as they are up to 32, then in steps of 7 percent.
LEVELS = np.concatenate([np.arange(33.0), 32 * 1.07 ** np.arange(1, 224)])
_BOUNDS = (LEVELS[1:] + LEVELS[:-1]) / 2
_LOGS = np.log(LEVELS + PRIOR)
#: Stretched chance and degree of evidence of a slot, by its levels of zeros (low byte) and ones; below that for a slot without one zero, and without one one.
_ZEROS, _ONES = LEVELS[np.arange(1 << 16) & 255], LEVELS[np.arange(1 << 16) >> 8]
_LESS = (np.stack([np.maximum(_ZEROS - 1, 0), _ZEROS]).ravel(), np.stack([_ONES, np.maximum(_ONES - 1, 0)]).ravel())
_STRETCH, _DEGREE = np.log((_ONES + PRIOR) / (_ZEROS + PRIOR)), np.searchsorted(EVIDENCE, _ZEROS + _ONES, side="right").astype(np.uint8)
_STRETCH_LESS, _DEGREE_LESS = np.log((_LESS[1] + PRIOR) / (_LESS[0] + PRIOR)), np.searchsorted(EVIDENCE, _LESS[0] + _LESS[1], side="right").astype(np.uint8)
#: Word end and text end; neither is part of a word.
SPACE, END = 0x20, 0x0A
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words one after the other with their ends, each byte's word, and the hashed contexts before each byte.

    The empty word stands for the end of a text.
    """
    flat = np.frombuffer(b"".join(w + b" " if w else b"\n" for w in words), dtype=np.uint8)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - starts[owner]
    wide = flat.astype(np.uint64)
    contexts = np.empty((len(flat), len(TABLE_BITS)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        recent = np.zeros(len(flat), dtype=np.uint64)
        for back in range(1, len(TABLE_BITS)):
            before = np.where(place >= back, np.concatenate([np.zeros(back, np.uint64), wide[:-back]])[: len(flat)], np.uint64(SPACE))
            recent = recent | (before << np.uint64(8 * (back - 1)))
            contexts[:, back - 1] = _mixed(recent * np.uint64(0x9E3779B97F4A7C15) + np.uint64(back))
        terms = np.cumsum((wide + np.uint64(1)) * _POWERS[place % len(_POWERS)], dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), terms])
        contexts[:, -1] = _mixed(sums[:-1] - sums[starts][owner] + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return flat, owner, contexts


def _bits_and_slots(flat: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 bits of each byte, high first, and the slot of each predictor for each bit: (bits, slots of shape predictors x bits)."""
    shift = np.arange(8)
    bits = (flat[:, None] >> (7 - shift)) & 1
    node = ((1 << shift) | (flat[:, None].astype(np.int64) >> (8 - shift))).astype(np.uint64)
    slots = np.empty((len(TABLE_BITS), flat.size * 8), dtype=np.int64)
    with np.errstate(over="ignore"):
        node *= np.uint64(0xD6E8FEB86659FD93)
        for k, width in enumerate(TABLE_BITS):
            mixed = contexts[:, k][:, None] + node
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed >>= np.uint64(64 - width)
            np.add(mixed.view(np.int64).ravel(), OFFSETS[k], out=slots[k])
    return bits.ravel(), slots


def _slices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, slots, word of each bit) of a list of words, in slices of bounded size; a very long word spans several."""
    flat, owner, contexts = _laid_out(words)
    for start in range(0, len(flat), SLICE_BYTES):
        part = slice(start, start + SLICE_BYTES)
        bits, slots = _bits_and_slots(flat[part], contexts[part])
        yield bits, slots, np.repeat(owner[part], 8)


def _groups(words: list[bytes], size: int) -> Iterator[slice]:
    for start in range(0, len(words), size):
        yield slice(start, start + size)


def _gate(evidence: np.ndarray) -> np.ndarray:
    return np.searchsorted(EVIDENCE, evidence, side="right") * 8 + np.arange(len(evidence)) % 8


def _codes(levels: np.ndarray) -> np.ndarray:
    """Both levels of each slot as one number, zeros in the low byte."""
    return np.ascontiguousarray(levels.T).view("<u2")[:, 0]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -20, 20)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x of 1 and more."""
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def adapted(chance: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log10 probability, for each class, of a text whose distinct words have these chances (a row a class) and occur so often.

    Read word by word, a word has the chance (URN * chance + its occurrences so far) / (URN + all words so far); the product doesn't
    depend on the order.
    """
    prior = URN * chance
    again, often = (times > 1) & (times <= 8), times > 8
    own, some = prior[:, again], times[again]
    rising = own + 1
    for j in range(2, some.max(initial=0)):
        rising *= np.where(some > j, own + j, 1.0)
    more = np.log(rising).sum(axis=1)
    if often.any():
        more += (_log_gamma(prior[:, often] + times[often]) - _log_gamma(prior[:, often] + 1)).sum(axis=1)
    spent = np.subtract(*_log_gamma(np.array([URN + times.sum(), URN])))
    return np.log10(prior).sum(axis=1) + (more - spent) / np.log(10)


def word_gates(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Gate of words that occur so often in a class and in the other classes; gate 0 is that of words nobody has."""
    return 2 * np.searchsorted(COUNT_EDGES, own, side="right") + (others > 0)


def word_inputs(log10: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What the word mixer weighs, in logs: the bits' chance of a word, its count in the class and that in the other classes."""
    return np.stack([np.broadcast_to(log10 * np.log(10), own.shape), np.log(np.maximum(own, 1)), np.log(np.maximum(others, 1))], axis=-1)


@dataclass
class WordMixer:
    """Chances of words in each class, mixed in the log domain by the weights of their gate.

    A class spends the share of each gate (`offsets`, in logs, less the log of the sum over the gate's words) on that gate's words. Words nobody has are
    gate 0 and share what the bit mixer leaves to them, so the chances of a class add up to one.
    """

    weights: np.ndarray
    offsets: np.ndarray

    def chances(self, log10: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Chances of words (a row a class) from the bit mixer's log10 chances and the words' counts in each class."""
        others = counts.sum(axis=0) - counts
        gate = word_gates(counts, others)
        x = np.einsum("cwi,cwi->cw", word_inputs(log10, counts, others), self.weights[gate])
        return np.exp(x + np.take_along_axis(self.offsets, gate, axis=1))


def word_sums(log10: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over known words for each class and gate: (classes, gates, 17).

    In order: the words' unnormalised chances, those times the inputs (3) and their products (9); then the occurrences, each in the gate that the word has
    without it, and those times the inputs it has without it (3).
    """
    others = counts.sum(axis=0) - counts
    classes = np.arange(len(counts))[:, None] * WORD_GATES

    def added(gate: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.bincount((classes + gate)[which], values[which], classes.size * WORD_GATES).reshape(-1, WORD_GATES)

    gate, inputs, known = word_gates(counts, others), word_inputs(log10, counts, others), np.broadcast_to(counts.sum(axis=0) > 0, counts.shape)
    e = np.exp(np.einsum("cwi,cwi->cw", inputs, weights[gate]))
    sums = [added(gate, v, known) for v in (e, *(e * inputs[..., i] for i in range(3)), *(e * inputs[..., i] * inputs[..., j] for i in range(3) for j in range(3)))]
    left = np.maximum(counts - 1, 0)
    gate, inputs, seen = word_gates(left, others), word_inputs(log10, left, others), counts > 0
    sums += [added(gate, v, seen) for v in (counts.astype(np.float64), *(counts * inputs[..., i] for i in range(3)))]
    return np.stack(sums, axis=-1)


def newton_step(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weights of the word mixer after a step towards the likeliest ones, from `word_sums` under the weights given; gate 0 stays."""
    out = weights.copy()
    total = np.where(sums[..., 0] > 0, sums[..., 0], 1.0)
    mean = sums[..., 1:4] / total[..., None]
    spread = sums[..., 4:13].reshape(*total.shape, 3, 3) / total[..., None, None] - mean[..., :, None] * mean[..., None, :]
    mass = np.where(sums[..., 0] > 0, sums[..., 13], 0.0)
    slope = (np.where(sums[..., :1] > 0, sums[..., 14:17], 0.0) - mass[..., None] * mean).sum(axis=0)
    curvature = (mass[..., None, None] * spread).sum(axis=0) + RIDGE * np.eye(3)
    step = np.linalg.solve(curvature, (slope - RIDGE * (weights - WORD_START))[..., None])[..., 0]
    out[1:] += (step / np.maximum(1.0, np.linalg.norm(step, axis=-1, keepdims=True)))[1:]
    return out


def word_mixer(weights: np.ndarray, sums: np.ndarray, unknown: float) -> WordMixer:
    """The mixer with these weights: shares of the gates are those of the occurrences, each counted without itself; `unknown` is the bits' chance of all words nobody has."""
    total = sums[..., 0].copy()
    total[:, 0] = unknown
    there = total > 0
    share = np.where(there, sums[..., 13] + 0.5, 0.0)
    share /= share.sum(axis=1, keepdims=True)
    return WordMixer(weights, np.log(np.where(there, share, 1.0) / np.where(there, total, 1.0)))


def mixed_classes(log10: np.ndarray, shares: np.ndarray) -> float:
    """log10 probability of a text whose class is not known: the classes' probabilities, weighed by their shares."""
    top = log10.max()
    return float(top + np.log10((shares * 10.0 ** (log10 - top)).sum()))


@dataclass
class Model:
    """Count levels of zeros and ones per slot, mixing weights per gate, and the refinement curve of each gate."""

    levels: np.ndarray
    weights: np.ndarray
    curve: np.ndarray

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, its end included; the empty word is the end of a text."""
        out, codes, weights, curve = np.zeros(len(words)), _codes(self.levels), np.ascontiguousarray(self.weights.T), self.curve.ravel()
        for part in _groups(words, 4096):
            for bits, slots, owner in _slices(words[part]):
                found = [codes[own] for own in slots]
                gate = _DEGREE[found[-1]].astype(np.int64) * 8 + np.arange(len(bits)) % 8
                x = weights[-1][gate]
                for own, code in zip(weights, found):
                    x += own[gate] * _STRETCH[code]
                at = (np.clip(x, -8, 8) + 8) * 2
                low = np.minimum(at.astype(np.int64), CURVE - 2)
                at -= low
                low += gate * CURVE
                refined = curve[low] * (1 - at) + curve[low + 1] * at
                p = np.clip((_squash(x) + refined) / 2, 1e-6, 1 - 1e-6)
                out[part] += np.bincount(owner, np.log10(np.where(bits == 1, p, 1 - p)), len(out[part]))
        return out


def pack_bag(ids: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct word numbers and how often each occurs, in few bytes."""
    order = np.argsort(ids)
    steps, times = np.diff(ids[order], prepend=0), times[order]
    if steps.max(initial=0) < 1 << 16 and times.max(initial=0) < 1 << 8:
        return b"\0" + steps.astype(np.uint16).tobytes() + times.astype(np.uint8).tobytes()
    return b"\1" + steps.astype(np.uint32).tobytes() + times.astype(np.uint32).tobytes()


def unpack_bag(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, kinds = packed[0], ((np.uint16, np.uint8), (np.uint32, np.uint32))[packed[0]]
    n = (len(packed) - 1) // (8 if wide else 3)
    steps = np.frombuffer(packed, kinds[0], n, 1)
    times = np.frombuffer(packed, kinds[1], n, 1 + n * steps.itemsize)
    return np.cumsum(steps.astype(np.int64)), times.astype(np.int64)


_CODED = {
    "chunk": ("long", pa.int64()), "kind": ("int", pa.int32()), "doc_id": ("long", pa.int64()), "held_out": ("boolean", pa.bool_()), "class": ("int", pa.int32()),
    "n_bytes": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "bag": ("binary", pa.binary()),
    "bucket": ("int", pa.int32()), "words": ("binary", pa.binary()), "numbers": ("binary", pa.binary()), "counts": ("binary", pa.binary()),
}


def _coded(docs: DataFrame, classes: int, buckets: int) -> DataFrame:
    """Documents as bags of word numbers of a chunk's dictionary (kind 0), and the dictionaries in buckets of words (kind 1).

    A bucket's row holds the words, their numbers, and their counts in the chunk's training documents of each class.
    """

    def rows(n: int, **own: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own.get(k, pa.nulls(n, t)) for k, (_, t) in _CODED.items()], list(_CODED))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, held = TaskContext.get().partitionId(), 0, 0
        numbers: dict[bytes, int] = {b"": 0}
        counts = np.zeros((classes, 1 << 16), dtype=np.int64)

        def dictionary() -> pa.RecordBatch:
            words = list(numbers)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
            return rows(
                len(groups), chunk=pa.array(np.full(len(groups), (task << 32) | chunk)), kind=pa.array(np.ones(len(groups), np.int32)),
                bucket=pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), words=pa.array([b"\n".join([words[i] for i in g.tolist()]) for g in groups], pa.binary()),
                numbers=pa.array([g.astype(np.uint32).tobytes() for g in groups], pa.binary()), counts=pa.array([counts[:, g].astype(np.uint32).tobytes() for g in groups], pa.binary()),
            )

        for batch in small_batches(batches, 4 << 20, "text"):
            bags, tokens, sizes = [], [], []
            for text, held_out, group in zip(as_bytes(batch.column("text")), batch.column("held_out").to_pylist(), batch.column("class").to_pylist()):
                found = Counter(text.lower().split())
                found[b""] = 1
                own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
                often = np.fromiter(found.values(), np.int64, len(found))
                if len(numbers) > counts.shape[1]:
                    counts = np.concatenate([counts, np.zeros((classes, max(counts.shape[1], len(numbers))), np.int64)], axis=1)
                if not held_out:
                    counts[group, own] += often
                bags.append(pack_bag(own, often))
                tokens.append(int(often.sum()))
                sizes.append(sum((len(w) + 1) * n for w, n in found.items()))
                held += len(text)
            n = len(bags)
            yield rows(
                n, chunk=pa.array(np.full(n, (task << 32) | chunk)), kind=pa.array(np.zeros(n, np.int32)), doc_id=batch.column("doc_id").cast(pa.int64()), held_out=batch.column("held_out"),
                **{"class": batch.column("class").cast(pa.int32())}, n_bytes=pa.array(sizes, pa.int64()), n_tokens=pa.array(tokens, pa.int64()), bag=pa.array(bags, pa.binary()),
            )
            if held >= CHUNK_BYTES:
                yield dictionary()
                chunk, held, numbers, counts = chunk + 1, 0, {b"": 0}, np.zeros((classes, 1 << 16), dtype=np.int64)
        yield dictionary()

    return docs.mapInArrow(code, ", ".join(f"`{k}` {t}" for k, (t, _) in _CODED.items()))


def _totals(table: pa.Table, classes: int) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """The distinct words of a bucket, their counts in each class over all chunks, and each row's words as places among them."""
    at: dict[bytes, int] = {}
    places = []
    for blob in table.column("words").to_pylist():
        own = blob.split(b"\n")
        places.append(np.fromiter((at.setdefault(w, len(at)) for w in own), np.int64, len(own)))
    counts = np.zeros((classes, len(at)), dtype=np.int64)
    for place, blob in zip(places, table.column("counts").to_pylist()):
        counts[:, place] += np.frombuffer(blob, np.uint32).reshape(classes, -1)
    return list(at), counts, places


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        yield as_bytes(batch.column("word")), batch.column("c").to_numpy()


def _count_tables(words: DataFrame) -> DataFrame:
    """(segment, zeros, ones): weighted bit counts of all slots, added up over the tasks in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * SLOTS)
        for own, c in _word_lists(batches):
            for part in _groups(own, 4096):
                for bits, slots, owner in _slices(own[part]):
                    weight = c[part][owner].astype(np.float64)
                    for k in range(len(TABLE_BITS)):
                        np.add.at(counts, 2 * slots[k] + bits, weight)
        zeros, ones = counts[::2], counts[1::2]
        used = [s for s in range(0, SLOTS, SEGMENT) if zeros[s : s + SEGMENT].any() or ones[s : s + SEGMENT].any()]
        salt = TaskContext.get().partitionId() % 16
        yield pa.RecordBatch.from_arrays(
            [pa.array([s // SEGMENT for s in used], pa.int32()), pa.array([salt] * len(used), pa.int32())]
            + [pa.array([t[s : s + SEGMENT].astype(np.float32).tobytes() for s in used], pa.binary()) for t in (zeros, ones)],
            ["segment", "salt", "zeros", "ones"],
        )

    def total(table: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table.column(c).to_pylist()).astype(np.float32).tobytes() for c in ("zeros", "ones")]
        head = table.slice(0, 1)
        return pa.table([head.column("segment"), head.column("salt"), pa.array(sums[:1], pa.binary()), pa.array(sums[1:], pa.binary())], names=["segment", "salt", "zeros", "ones"])

    schema = "segment int, salt int, zeros binary, ones binary"
    parts = words.mapInArrow(count, schema).groupBy("segment", "salt").applyInArrow(total, schema)
    return parts.groupBy("segment").applyInArrow(total, schema).select("segment", "zeros", "ones")


def _learned(words: DataFrame, tables) -> DataFrame:
    """(kind, gate, i, value, mass): sums for the weights (kind 0) and the refinement curves (kind 1), learned online in each task.

    Each occurrence of a word is predicted from the counts without itself.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(tables.value)
        weights = np.full((GATES, INPUTS), START_WEIGHT)
        weights[:, -1] = 0.0
        curvature, mass = np.tile(RIDGE * np.eye(INPUTS), (GATES, 1, 1)), np.zeros(GATES)
        hits, seen = np.zeros((GATES, CURVE)), np.zeros((GATES, CURVE))
        for own, c in _word_lists(batches):
            for part in _groups(own, STEP_WORDS):
                for bits, slots, owner in _slices(own[part]):
                    weight = c[part][owner].astype(np.float64)
                    x = np.empty((len(bits), INPUTS))
                    x[:, -1] = 0.3
                    less = bits.astype(np.int64) << 16
                    for k in range(len(TABLE_BITS)):
                        code = codes[slots[k]] + less
                        x[:, k] = _STRETCH_LESS[code]
                    gate = _DEGREE_LESS[code] * np.uint8(8) + (np.arange(len(bits)) % 8).astype(np.uint8)
                    z = np.einsum("ij,ij->i", weights[gate], x)
                    p = _squash(z)
                    at = np.rint((np.clip(z, -8, 8) + 8) * 2).astype(np.int64)
                    at += gate.astype(np.int64) * CURVE
                    hits += np.bincount(at, weight * bits, GATES * CURVE).reshape(GATES, CURVE)
                    seen += np.bincount(at, weight, GATES * CURVE).reshape(GATES, CURVE)
                    mass += np.bincount(gate, weight, GATES)
                    # An online Newton step: the curvature of all bits so far scales the slope of these.
                    order = np.argsort(gate, kind="stable")
                    ends = np.cumsum(np.bincount(gate, minlength=GATES))
                    inputs, slope, bend = x[order], (weight * (bits - p))[order], (weight * p * (1 - p))[order]
                    for g, (start, end) in enumerate(zip(ends - np.bincount(gate, minlength=GATES), ends)):
                        if end > start:
                            own_inputs = inputs[start:end]
                            curvature[g] += (own_inputs * bend[start:end, None]).T @ own_inputs
                            weights[g] += np.linalg.solve(curvature[g], slope[start:end] @ own_inputs)
        gate, i = np.divmod(np.arange(GATES * INPUTS), INPUTS)
        yield batch(0, gate, i, (weights * mass[:, None]).ravel(), np.repeat(mass, INPUTS))
        gate, i = np.divmod(np.arange(GATES * CURVE), CURVE)
        yield batch(1, gate, i, hits.ravel(), seen.ravel())

    def batch(kind: int, gate: np.ndarray, i: np.ndarray, value: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(gate), kind, np.int32)), pa.array(gate.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(value), pa.array(mass)], ["kind", "gate", "i", "value", "mass"])

    sums = words.mapInArrow(learn, "kind int, gate int, i int, value double, mass double")
    return sums.groupBy("kind", "gate", "i").agg(F.sum("value").alias("value"), F.sum("mass").alias("mass"))


def count_levels(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Levels of the counts of zeros and ones, a row each. A slot beyond the top level is scaled as a whole, so that it keeps its odds."""
    counts = np.stack([zeros, ones]).astype(np.float64)
    return np.searchsorted(_BOUNDS, counts * (LEVELS[-1] / np.maximum(counts.max(axis=0), LEVELS[-1]))).astype(np.uint8)


def train(words: DataFrame, n_words: int) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """Count levels, weights and curves from training words (word, c > 0). All of them are counted and learned from, in tasks of a bounded number of words.

    The tables have a fixed number of slots: 8 bytes a slot come to the driver and 2 go to the tasks, at any input.
    """
    # Every task hands in tables of all slots, so their number follows the words and nothing else.
    spread = words.repartition(max(1, -(-n_words // WORDS_PER_TASK)))
    levels = np.zeros((2, SLOTS), np.uint8)
    for row in _count_tables(spread).toLocalIterator():
        found = count_levels(*(np.frombuffer(row[name], np.float32) for name in ("zeros", "ones")))
        levels[:, row["segment"] * SEGMENT : row["segment"] * SEGMENT + found.shape[1]] = found
    weights, curve = np.full((GATES, INPUTS), START_WEIGHT), np.tile(_squash(np.arange(CURVE) / 2 - 8), (GATES, 1))
    weights[:, -1] = 0.0
    tables = words.sparkSession.sparkContext.broadcast(levels)
    for r in _learned(spread, tables).collect() if n_words else ():
        if r["kind"] == 0 and r["mass"] > 0:
            weights[r["gate"], r["i"]] = r["value"] / r["mass"]
        elif r["kind"] == 1:
            curve[r["gate"], r["i"]] = (r["value"] + 2 * curve[r["gate"], r["i"]]) / (r["mass"] + 2)
    weights[:, -1] *= 0.3
    return tables, weights, curve


def _learned_words(words: DataFrame, classes: int) -> WordMixer:
    """The word mixer, from the known words' counts in each class and the bit mixer's log10 chances (a row a bucket). Each occurrence is predicted from the counts without itself.

    Only sums by class and gate come to the driver.
    """
    weights = np.tile(WORD_START, (WORD_GATES, 1))
    weights[0] = 1.0, 0.0, 0.0

    def sums_under(weights: np.ndarray) -> tuple[np.ndarray, float]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, known = np.zeros((classes, WORD_GATES, 17)), 0.0
            for batch in batches:
                for counts, log10 in zip(batch.column("counts").to_pylist(), batch.column("log10").to_pylist()):
                    counts, log10 = np.frombuffer(counts, np.int64).reshape(classes, -1), np.frombuffer(log10, np.float32).astype(np.float64)
                    sums += word_sums(log10, counts, weights)
                    known += (10.0**log10).sum()
            flat = np.append(sums.ravel(), known)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "value"])

        flat = np.zeros(classes * WORD_GATES * 17 + 1)
        for r in words.mapInArrow(add, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
            flat[r["i"]] = r["value"]
        return flat[:-1].reshape(classes, WORD_GATES, 17), max(1 - flat[-1], 1e-6)

    for _ in range(WORD_STEPS):
        weights = newton_step(weights, sums_under(weights)[0])
    return word_mixer(weights, *sums_under(weights))


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A text's tokens are its words, A-Z lower-cased, and one end; null and empty texts have the end alone. Documents whose
    crc32(doc_id as text) modulo 10 is 0 are held out, all others are learned from; a null id counts as the empty text. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens. score is the model's log10 probability of the tokens, spelled in bytes with a
    space after each word: every bit is predicted from hashed contexts of one to four bytes and the word so far, mixed by the weights of
    its gate and refined by the gate's curve. That chance and the word's counts in each language of the training documents are the inputs of a second
    mixer, over words, with learned weights by gate. Its chances are adapted to the words of the text before; as a text's language is not given, the
    languages are summed over by their shares.
    bits_per_byte is the score by the bytes spelled. Without training documents every bit has
    probability one half. Repeated rows are scored each.

    Texts are coded once. Each chunk of texts sends its distinct words, packed by bucket, to where the bucket's words are counted and scored,
    and the answers go back to the chunk.
    """
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    language = F.coalesce(F.col("lang"), F.lit(""))
    seen = docs.where(~held_out).groupBy(language.alias("l")).agg(F.count("*").alias("n"))
    trained = seen.agg(F.sum("n")).first()[0] or 0
    top = seen.orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()
    shares = np.array([trained - sum(r["n"] for r in top), *(r["n"] for r in top)], dtype=np.float64)
    shares = shares / shares.sum() if trained else np.ones(1)
    group = F.lit(0)
    for k, r in enumerate(top, 1):
        group = F.when(language == r["l"], k).otherwise(group)

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(max(chars // CHARS_PER_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)
    classes = len(shares)
    coded = land(_coded(docs.select("doc_id", held_out.alias("held_out"), group.cast("int").alias("class"), "text"), classes, buckets), "coded")
    lists = coded.where("kind = 1").select("bucket", "chunk", "words", "numbers", "counts")
    class_totals = np.zeros(classes)
    for r in coded.where("kind = 0 and not held_out").groupBy("class").agg(F.sum("n_tokens").alias("n")).collect():
        class_totals[r["class"]] = r["n"]

    def known_words(table: pa.Table) -> pa.Table:
        words, counts, _ = _totals(table, classes)
        c = counts.sum(axis=0)
        return pa.table([pa.array([words[i] for i in np.flatnonzero(c).tolist()], pa.binary()), pa.array(c[c > 0], pa.int64())], names=["word", "c"])

    known = land(lists.groupBy("bucket").applyInArrow(known_words, "word binary, c long"), "words")
    v, n = known.count(), int(class_totals.sum())
    tables, weights, curve = train(known, v)

    live = np.flatnonzero(shares)
    shares = shares[live]

    def answers(table: pa.Table) -> pa.Table:
        words, counts, places = _totals(table, classes)
        log10, counts = Model(tables.value, weights, curve).log10(words).astype(np.float32), counts[live]
        # The bucket's own words, which the word mixer learns from, are the last row.
        places = [*places, np.flatnonzero(counts.any(axis=0))]
        chunks, numbers = ([*table.column(c).to_pylist(), None] for c in ("chunk", "numbers"))
        return pa.table(
            [pa.array(chunks, pa.int64()), pa.array(numbers, pa.binary()), pa.array([counts[:, p].tobytes() for p in places], pa.binary()), pa.array([log10[p].tobytes() for p in places], pa.binary())],
            names=["of_chunk", "numbers", "counts", "log10"],
        )

    answered = land(lists.groupBy("bucket").applyInArrow(answers, "of_chunk long, numbers binary, counts binary, log10 binary"), "answers")
    found = answered.where("of_chunk is not null")
    mixer = _learned_words(answered.where("of_chunk is null").select("counts", "log10"), len(live))
    texts = coded.where("kind = 0").select("chunk", "doc_id", "held_out", "n_bytes", "n_tokens", "bag")
    floor = n + 0.1 * (v + 1)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = np.concatenate([np.frombuffer(b, np.uint32) for b in right.column("numbers").to_pylist()] or [np.empty(0, np.uint32)])
        own, common = np.zeros((len(live), len(numbers)), np.int64), np.zeros(len(numbers))
        if len(numbers):
            own[:, numbers] = np.concatenate([np.frombuffer(b, np.int64).reshape(len(live), -1) for b in right.column("counts").to_pylist()], axis=1)
            common[numbers] = np.concatenate([np.frombuffer(b, np.float32) for b in right.column("log10").to_pylist()])
        c = own.sum(axis=0)
        base, chance = np.log10((c + 0.1) / floor), mixer.chances(common, own)
        out = []
        for bag in left.column("bag").to_pylist():
            ids, times = unpack_bag(bag)
            score = mixed_classes(adapted(chance[:, ids], times), shares)
            out.append((int(times[c[ids] > 0].sum()), float((times * base[ids]).sum()), score))
        seen, low, high = (list(x) for x in zip(*out)) if out else ([], [], [])
        bits = -np.array(high, np.float64) * np.log2(10) / left.column("n_bytes").to_numpy()
        return pa.table(
            [left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), pa.array(seen, pa.int64()), pa.array([n] * len(out), pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(bits, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(summed, schema)
