"""Word shingles as sets of 64-bit fingerprints, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """The distinct shingles of some texts: `flat` in rising order within each text, `offset` per text."""

    def __init__(self, texts: list[bytes], words: int) -> None:
        index: dict[bytes, int] = {}
        lens, ids = np.zeros(len(texts), np.int64), []
        for k, text in enumerate(texts):
            own = text.lower().split()
            lens[k] = len(own)
            ids.extend([index.setdefault(w, len(index)) for w in own])
        word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
        # A shingle's fingerprint: a polynomial over its words. A shorter text is one shingle by itself.
        count = np.where(lens >= words, lens - words + 1, np.minimum(lens, 1))
        start = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(texts)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        size = np.minimum(lens, words)[owner]
        h = size.astype(np.uint64) * M1
        for j in range(words):
            inside = j < size
            h = np.where(inside, mix(h * M1 + word[np.minimum(at + j, max(0, len(word) - 1))] if len(word) else h), h)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.flat, self.owner = h[first], owner[first]
        self.size = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.key = self._keys()

    def _keys(self) -> np.ndarray:
        """One fingerprint for each whole set; 0 for an empty one."""
        key = np.zeros(len(self.size), np.int64)
        for k in np.flatnonzero(self.size):
            key[k] = np.int64(xxhash.xxh3_64_intdigest(self.flat[self.offset[k] : self.offset[k + 1]].tobytes()) >> 1) | 1
        return key

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.offset[k] : self.offset[k + 1]]
