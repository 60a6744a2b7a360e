"""Reading of a SentencePiece model file: a protocol buffer of pieces with scores, of trainer settings and of normaliser settings."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

#: Fixed values of the public model format: the field numbers that are read here and the kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    #: What an unknown piece is decoded to.
    unknown_surface: str = " ⁇ "

    @property
    def unknown(self) -> int:
        return next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def plain(self) -> dict[str, int]:
        """Pieces that text can become, with their ids."""
        return {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}

    @cached_property
    def splits_before_mark(self) -> bool:
        """Whether no piece has the white space mark after another character, so that a text can be cut there."""
        return not any(MARK in p.lstrip(MARK) for p in self.plain())


@lru_cache(maxsize=8)
def parse(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == TRAINER:
            own = dict(fields(value))
            model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            model.unknown_surface = own[44].decode() if 44 in own else model.unknown_surface
        elif number == NORMALIZER:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
    return model


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
