"""Whitespace tokens of whole Arrow text columns as numpy arrays.

Word boundaries are the bytes 0x20 and 0x09-0x0D, A-Z is lower-cased, everything else is kept byte by byte. Texts are
joined into blocks of about two megabytes; a longer text is cut at white space into several pieces of one row, so
memory is bounded whatever the length of a text is (a single word is never cut).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes between words; and the bytes between runs of letters and digits, where every byte above 0x7F counts as a letter.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers(list):
    """The powers worked out so far. They are megabytes, and do not go to the tasks with the functions."""

    def __reduce__(self) -> tuple:
        return _Powers, ([np.ones(1, np.uint64), np.ones(1, np.uint64)],)


_powers = _Powers([np.ones(1, np.uint64), np.ones(1, np.uint64)])


class Block(NamedTuple):
    rows: np.ndarray  # row of the column for each piece
    sizes: np.ndarray  # bytes of each piece with its space
    data: np.ndarray  # the bytes of all pieces, lower-cased if asked for, each followed by one space
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    piece: np.ndarray  # piece of each word
    last: np.ndarray  # whether a piece is the last of its row


def _pieces(column: pa.Array, lower: bool) -> Iterator[tuple[int, bytes, bool]]:
    for row, value in enumerate(column):
        text = value.as_buffer().to_pybytes() if value.is_valid else b""
        text = text.lower() if lower else text
        at = 0
        while len(text) - at > BLOCK:
            cut = _SPACE.search(text, at + BLOCK)
            if cut is None:
                break
            yield row, text[at : cut.start()], False
            at = cut.end()
        yield row, text[at:] if at else text, True


def _block(held: list[tuple[int, bytes, bool]], between: np.ndarray) -> Block:
    data = np.frombuffer(b" ".join(p for _, p, _ in held) + b" ", np.uint8)
    sizes = np.fromiter((len(p) + 1 for _, p, _ in held), np.int64, len(held))
    space = between[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    begin = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    piece = np.searchsorted(np.cumsum(sizes), begin, side="right")
    return Block(
        np.fromiter((r for r, _, _ in held), np.int64, len(held)),
        sizes,
        data,
        begin,
        end,
        piece,
        np.fromiter((x for _, _, x in held), bool, len(held)),
    )


def blocks(column: pa.Array, lower: bool = True, between: np.ndarray = SPACE_BYTES) -> Iterator[Block]:
    """The rows of a text column in order; null counts as empty. ``between``: which bytes stand between words."""
    held: list[tuple[int, bytes, bool]] = []
    size = 0
    for piece in _pieces(column, lower):
        held.append(piece)
        size += len(piece[1]) + 1
        if size >= BLOCK:
            yield _block(held, between)
            held, size = [], 0
    if held:
        yield _block(held, between)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK + (BLOCK >> 2)), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """64-bit hashes of spans of one block, by differences of prefix sums: the same for the same bytes everywhere."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def word_hashes(block: Block) -> np.ndarray:
    return Hasher(block.data).spans(block.begin, block.end)
