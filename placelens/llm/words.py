"""Words of a text and their hashes, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Runs of bytes that are no blank, tab or line break; ``lower`` applies to A-Z. Bytes methods treat
    exactly the six ASCII characters as white space and exactly A-Z as capitals."""
    content = (text or "").encode()
    return (content.lower() if lower else content).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of each 64-bit value; one to one."""
    x = (x ^ (x >> np.uint64(31))) * _FACTOR
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words, or of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < width:
        width = len(h)
    x = mixed(h[: len(h) - width + 1] + np.uint64(width))
    for k in range(1, width):
        x = mixed(x ^ h[k: len(h) - width + 1 + k])
    return np.unique(x)


class GramHashes:
    """Hash of every run of ``width`` word hashes, by differences of prefix sums of a polynomial."""

    def __init__(self, width: int) -> None:
        self.width = width
        self._powers = self._inverses = np.ones(1, np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.width:
            return np.empty(0, np.uint64)
        if len(self._powers) < n + 1:
            self._powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)])
            self._inverses = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _INVERSE, np.uint64)])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h) * self._powers[:n])))
        return mixed((sums[self.width:] - sums[: -self.width]) * self._inverses[: n - self.width + 1])


def pack48(x: np.ndarray) -> bytes:
    """Six bytes for each value under 2**48."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(content, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)
