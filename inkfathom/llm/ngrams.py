"""Letters and hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters handled at once; longer texts go through in pieces, with the same result.
PIECE = 1 << 18
#: The longest n-gram whose parts may lie on both sides of a piece's edge.
LONGEST = 6

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The text's lower-cased letters as code points, each run of others as one
    0, with a 0 before the first and after the last, in pieces. The second value
    says how many codes at a piece's head repeat the end of the one before."""
    table, low = letter_table(), text.lower()
    tail = np.zeros(0, np.uint32)
    for at in range(0, len(low), PIECE):
        codes = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(table[codes], codes, 0)
        first, last = at == 0, at + PIECE >= len(low)
        padded = np.concatenate(([0] if first else tail[-1:], codes, [0] if last else [])).astype(np.uint32)
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
        new = padded[keep] if first else padded[keep][1:]
        whole = np.concatenate((tail, new))
        yield whole, len(tail)
        tail = whole[-(LONGEST - 1) :]


def new_letters(codes: np.ndarray, seen: int) -> int:
    return int(np.count_nonzero(codes[seen:]))


def words_ended(codes: np.ndarray, seen: int) -> int:
    """How many words end in a piece: letters with a new 0 after them."""
    own = codes[max(seen - 1, 0) :]
    return int(np.count_nonzero((own[1:] == 0) & (own[:-1] != 0)))


def hashed(codes: np.ndarray, seen: int, order: int, bits: int, inner: bool = False) -> np.ndarray:
    """Bucket of each n-gram of ``order`` code points that ends in the piece's new
    codes. ``inner``: only n-grams within a word, which may take in the 0 before
    and the 0 after it."""
    codes = codes[max(seen - order + 1, 0) :]
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x2545F491 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
    if inner:
        whole = np.ones(n, bool)
        for k in range(1, order - 1):
            whole &= codes[k : k + n] != 0
        h = h[whole]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)
