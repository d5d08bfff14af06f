"""64-bit hashes of words and of windows of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import WORD

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; a memory of bounded size, refilled when full."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive hashes, by joining windows of doubled sizes."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out, have, block, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out, have = block, width
            else:
                n = min(len(out), len(block) - have)
                out, have = scramble(out[:n] * _ODD + block[have : have + n] + np.uint64(width)), have + width
        width *= 2
        if width > size:
            return out[: len(h) - size + 1]
        half = width // 2
        block = scramble(block[:-half] * _ODD + block[half:] + np.uint64(width))
