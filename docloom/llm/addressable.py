"""Directly addressable codes: integers cut into levels of chunks, each read alone without decoding its neighbours.

Level 0 holds the low bits of every number.  A bitmap beside each level but the last
says which numbers go on, and a directory holds how many went on before each 512
bits, so the place of a number's next chunk is a directory entry and a count of at
most 512 bits.  Chunk widths are chosen by the numbers' bit lengths, so that the file
is as small as levels of this kind allow.

File, all integers little-endian: ``DACF``, version, number of documents and of tokens,
number of levels, level widths and lengths; ids of the documents and a flag for each
that has none; first token of each document and the end; then for each level its packed
chunks and, but for the last, its bitmap and directory.  Every part is padded to 8 bytes.
"""

from __future__ import annotations

from itertools import combinations
from typing import BinaryIO

import numpy as np

MAGIC, VERSION = b"DACF", 1
HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("docs", "<u8"), ("tokens", "<u8"), ("levels", "<u8")])
LEVEL = np.dtype([("width", "<u8"), ("length", "<u8")])
RANK_BITS = 512
MOST_LEVELS = 4
#: Numbers that are packed at one time, a multiple of 64.
BLOCK = 1 << 19


def widths_for(values: np.ndarray) -> list[int]:
    """Chunk widths with the fewest bits for these numbers, in at most ``MOST_LEVELS`` levels."""
    lengths = np.zeros(65, np.int64)
    for i in range(0, len(values), BLOCK):  # bit lengths, exact below 2^53
        lengths += np.bincount(np.frexp(values[i : i + BLOCK].astype(np.float64))[1], minlength=65)
    top = max(1, int(np.flatnonzero(lengths).max(initial=0)))
    longer = [int(lengths[b + 1 :].sum()) for b in range(top + 1)]  # numbers that need more than b bits
    best = None
    for n in range(MOST_LEVELS):
        for cuts in combinations(range(1, top), n):
            edges = [0, *cuts, top]
            bits = sum((len(values) if a == 0 else longer[a]) * (b - a + (b < top)) for a, b in zip(edges, edges[1:], strict=False))
            if best is None or bits < best[0]:
                best = bits, [b - a for a, b in zip(edges, edges[1:], strict=False)]
    return best[1]


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def packed(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits one after another, low bits first, with a spare word at the end."""
    parts = [_packed(values[i : i + BLOCK], width) for i in range(0, len(values), BLOCK)]
    return b"".join(parts) + bytes(8)


def _packed(values: np.ndarray, width: int) -> bytes:
    groups = np.zeros((-(-len(values) // 64), 64), np.uint64)
    groups.ravel()[: len(values)] = values
    words = np.zeros((len(groups), width + 1), np.uint64)
    for j in range(64):  # 64 numbers fill ``width`` words, so the j-th of each such group lies alike
        word, shift = divmod(j * width, 64)
        words[:, word] |= groups[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return words[:, :width].ravel()[: -(-len(values) * width // 64)].astype("<u8").tobytes()


def unpacked(words: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Numbers ``start`` to ``stop`` of a packed level whose words begin at the one that holds ``start``."""
    at = np.arange(start, stop, dtype=np.uint64) * np.uint64(width) - np.uint64((start * width // 64) * 64)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << width) - 1)


def encoded(ids: np.ndarray, first: np.ndarray, docs: list[int | None]) -> bytes:
    """The file of some documents: all their tokens, where each document's begin (and the end), and their ids."""
    widths, parts = widths_for(ids), []
    levels, rest = [], ids
    for k, width in enumerate(widths):
        levels.append((width, len(rest)))
        parts.append(packed(rest & rest.dtype.type((1 << width) - 1), width))
        more = rest >> rest.dtype.type(width)
        if k + 1 < len(widths):
            on = more > 0
            bits = np.packbits(on, bitorder="little").tobytes()
            bits += bytes(-len(bits) % (RANK_BITS // 8))
            ranks = np.concatenate([[0], np.bitwise_count(np.frombuffer(bits, np.uint8)).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64).cumsum()])
            parts += [bits, ranks.astype("<u8").tobytes()]
            rest = more[on]
    head = np.zeros(1, HEAD)
    head[0] = (MAGIC, VERSION, len(docs), len(ids), len(levels))
    names = np.array([0 if d is None else d for d in docs], "<i8")
    unnamed = np.array([d is None for d in docs], np.uint8)
    return b"".join(map(padded, (head.tobytes(), np.array(levels, LEVEL).tobytes(), names.tobytes(), unnamed.tobytes(), first.astype("<u8").tobytes(), *parts)))


class Tokens:
    """Reads a file of this kind; ``f`` needs only ``seek`` and ``read``."""

    def __init__(self, f: BinaryIO):
        self.f = f
        head = self._read(0, HEAD.itemsize, HEAD)[0]
        if head["magic"] != MAGIC or head["version"] != VERSION:
            raise ValueError("no file of directly addressable codes")
        self.docs, self.tokens = int(head["docs"]), int(head["tokens"])
        at = HEAD.itemsize + -HEAD.itemsize % 8
        told = self._read(at, int(head["levels"]) * LEVEL.itemsize, LEVEL)
        at += told.nbytes
        self.names_at, at = at, at + 8 * self.docs
        self.unnamed_at, at = at, at + self.docs + -self.docs % 8
        self.first_at, at = at, at + 8 * (self.docs + 1)
        self.levels = []
        for k, (width, length) in enumerate(told):
            width, length = int(width), int(length)
            chunks, at = at, at + 8 * (-(-length * width // 64) + 1)
            bits = ranks = None
            if k + 1 < len(told):
                blocks = -(-length // RANK_BITS)
                bits, at = at, at + blocks * RANK_BITS // 8
                ranks, at = at, at + 8 * (blocks + 1)
            self.levels.append((width, chunks, bits, ranks))

    def _read(self, at: int, size: int, kind: np.dtype | str) -> np.ndarray:
        self.f.seek(at)
        return np.frombuffer(self.f.read(size), kind)

    def names(self, start: int, stop: int) -> list[int | None]:
        names = self._read(self.names_at + 8 * start, 8 * (stop - start), "<i8").tolist()
        return [None if gone else n for n, gone in zip(names, self._read(self.unnamed_at + start, stop - start, np.uint8), strict=True)]

    def first(self, start: int, stop: int) -> np.ndarray:
        """First tokens of documents ``start`` to ``stop``; the one after the last is the end."""
        return self._read(self.first_at + 8 * start, 8 * (stop - start), "<u8").astype(np.int64)

    def rank(self, level: int, i: int) -> int:
        """How many of the first ``i`` numbers of a level go on."""
        _, _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        before = int(self._read(ranks + 8 * block, 8, "<u8")[0])
        inside = i - block * RANK_BITS
        here = np.unpackbits(self._read(bits + block * RANK_BITS // 8, -(-inside // 8), np.uint8), bitorder="little")[:inside] if inside else []
        return before + int(np.sum(here, dtype=np.int64))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop``: each level's chunks of this range, placed by rank."""
        out = np.zeros(stop - start, np.uint64)
        where, shift = np.arange(stop - start), 0
        for level, (width, chunks, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            word = start * width // 64
            words = self._read(chunks + 8 * word, 8 * (-(-stop * width // 64) + 1 - word), "<u8")
            out[where] |= unpacked(words, width, start, stop) << np.uint64(shift)
            if bits is None:
                break
            byte = start // 8
            on = np.unpackbits(self._read(bits + byte, -(-stop // 8) - byte, np.uint8), bitorder="little")[start - 8 * byte : stop - 8 * byte] > 0
            where, shift = where[on], shift + width
            start = self.rank(level, start)
            stop = start + len(where)
        return out

    def token(self, i: int) -> int:
        """Token ``i`` by one chunk and one rank a level; nothing beside it is decoded."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (width, chunks, bits, _) in enumerate(self.levels):
            word = i * width // 64
            value |= int(unpacked(self._read(chunks + 8 * word, 16, "<u8"), width, i, i + 1)[0]) << shift
            if bits is None or not self._read(bits + i // 8, 1, np.uint8)[0] >> (i % 8) & 1:
                return value
            i, shift = self.rank(level, i), shift + width
        return value
