"""Sets of word shingles as sorted 64-bit hashes, made for whole batches at once.

Words are the runs between ASCII white space of the text with A-Z lower-cased.
A word's hash is a polynomial of its bytes modulo 2**64, read off prefix sums,
and mixed; a shingle's hash mixes its words' hashes by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 18  # bytes hashed at once: each takes some 40 more meanwhile
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] = _LOWER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers without special structure, and those of the splitmix64 finaliser.
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, at least ``n`` of each."""
        if len(self.up) < n:
            size = max(n, SEGMENT + 4096)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def _hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, where no word crosses one of ``breaks``; and how many words start before each break."""
    up, down = _POWERS.get(len(data) + 1)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, breaks)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= SEGMENT:
            j += 1
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= SEGMENT:
            hashes, cuts = _hash_words(data[low:high], offsets[i : j + 1] - low)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield hashes[a:b]
        else:  # one long text, cut at white space
            parts, at = [], low
            while at < high:
                end = min(high, at + SEGMENT)
                while end < high and not _SPACE[data[end]]:
                    more = np.flatnonzero(_SPACE[data[end : end + 4096]])
                    end = end + int(more[0]) if len(more) else min(high, end + 4096)
                parts.append(_hash_words(data[at:end], np.array([0, end - at]))[0])
                at = end
            yield np.concatenate(parts)
        i = j


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``k`` words; a shorter sequence is one shingle, an empty one none."""
    if len(words) >= k:
        total = words[: len(words) - k + 1] * _PLACE[0]
        for i in range(1, k):
            total = total + words[i : len(words) - k + 1 + i] * _PLACE[i]
        return np.unique(mix(total))
    if not len(words):
        return words
    return mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[5] * np.uint64(len(words)))
