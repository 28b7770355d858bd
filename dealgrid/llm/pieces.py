"""Vocabulary of a SentencePiece model file: pieces, their order, and how texts split into pre-tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.util import find_spec
from pathlib import Path

#: The space mark inside pieces.
MARK = "▁"
#: A run of spaces goes with the word after it; a line break stands alone. No piece crosses these borders.
PRETOKEN = re.compile(r"[ ]*[^ \n]+|[ ]+|\n")


def default_model() -> str:
    """The 32k piece model among the public tokenizer files of this machine."""
    return str(Path(find_spec("public_tokenizers").origin).parent / "piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, ids of the mergeable pieces, and the id of each byte's fallback piece."""

    pieces: tuple[str, ...]
    ids: dict[str, int] = field(repr=False)
    byte_ids: tuple[int, ...] = field(repr=False)
    longest: int = 0


@lru_cache(maxsize=4)
def load(model: str) -> Vocabulary:
    """Read a model file; it lies on every machine that runs tasks, and its path is a parameter."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    pieces = tuple(sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    special = {i for i in range(len(pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
    ids = {p: i for i, p in enumerate(pieces) if i not in special and not sp.is_byte(i)}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece crosses a word border")
    return Vocabulary(pieces, ids, tuple(byte_ids[b] for b in range(256)), max(map(len, ids)))
