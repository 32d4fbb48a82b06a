"""Word and word-window hashing shared by the text operators.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text, which is what ``bytes.split()`` yields.  A word's hash is 64 bits of
its BLAKE2b digest (kept for the words seen lately), so no rule of arithmetic
makes two words collide; hashes of windows are folded from these by a mixing
function, with numpy over a whole block of texts at once.  All hashes are the
same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

U64 = np.uint64
_FOLD = U64(0xD1B54A32D192ED03)
#: Words whose hashes are kept; beyond that the store starts afresh, which costs time and nothing else.
KEPT_WORDS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Hashes(dict):
    """Word -> hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = found
        return found


_hashes = _Hashes()


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbouring spans from theirs; order matters."""
    return mix(a * _FOLD + b)


class Words:
    """Words of a block of texts: ``hash``, ``start``, ``end`` (byte places), ``doc`` (text number), ``first`` (of each text)."""

    def __init__(self, texts: list[bytes]):
        self.buf = b" ".join(texts)
        raw = np.frombuffer(self.buf, np.uint8)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = np.fromiter(map(_hashes.__getitem__, self.buf.split()), U64, len(self.start))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def prefixes(self, size: int) -> np.ndarray:
        """A hash of each word's first ``size`` bytes, 8 at most (of all, if it has fewer)."""
        eights = np.ndarray((len(self.buf) + 1,), "<u8", self.buf + bytes(8), strides=(1,))
        length = np.minimum(self.end - self.start, size)
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
        return mix((eights[self.start] & masks[length]) + length.astype(U64))

    def windows(self, width: int) -> np.ndarray:
        """A hash for the ``width`` words from each word on, folded from spans of 1, 2, 4, ... words; entries that leave their text are meaningless."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, U64)
        out, done, span, size = None, 0, self.hash, 1
        while True:
            if width & size:
                out = span if out is None else fold(out[: n - done - size + 1], span[done:])
                done += size
            if done == width:
                return out
            span, size = fold(span[:-size], span[size:]), size * 2

    def whole(self, width: int) -> np.ndarray:
        """Which windows of ``width`` words lie inside one text."""
        n = len(self.hash)
        return self.doc[: n - width + 1] == self.doc[width - 1 :] if n >= width else np.zeros(0, bool)


def blocks(texts: Iterable[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a sequence of texts into blocks of about ``limit`` bytes (a longer text is a block of its own); gives each block's first number."""
    block: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        if block and size + len(text) > limit:
            yield first, block
            block, size, first = [], 0, i
        block.append(text)
        size += len(text) + 1
    if block:
        yield first, block
