"""Sets of 5-word shingles as sorted 64-bit hashes, computed for blocks of texts at once.

A word is told by xxh3 of its bytes, a shingle by a sum of its words' hashes with a multiplier for each place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SIZE = 5
BLOCK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    split = [t.translate(_LOWER).split() for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    words = np.empty(int(bounds[-1]), np.uint64)
    for at, ws in zip(bounds.tolist(), split, strict=False):
        words[at : at + len(ws)] = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = len(words) - SIZE + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(SIZE):
        grams += words[k : k + len(grams)] * _PLACE[k]
    grams = mixed(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SIZE:
            yield np.unique(grams[a : b - SIZE + 1])
        elif b > a:  # the whole sequence; its length tells it from longer ones
            yield mixed(np.array([(words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a null text or one without words."""
    block, size = [], 0
    for t in texts:
        block.append(t or b"")
        size += len(t or b"")
        if size >= BLOCK:
            yield from _sets(block)
            block, size = [], 0
    if block:
        yield from _sets(block)
