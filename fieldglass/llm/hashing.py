"""Hashes of words by whole-array arithmetic."""

from __future__ import annotations

import numpy as np

#: Bytes of a text that are hashed at a time (cut at white space).
PIECE = 1 << 20

P = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD6E8FEB86659FD93)
_R_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


with np.errstate(over="ignore"):
    _CODE = mix(np.arange(1, 257, dtype=np.uint64) * P)
_CODE[65:91] = _CODE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


class WordHashes:
    """64-bit hashes of the words of texts, in order; ASCII white space separates, A-Z are a-z.

    A word's hash is a polynomial of random codes of its bytes, read off
    running sums.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _R)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _R_INVERSE)]))

    def _piece(self, data: np.ndarray) -> np.ndarray:
        edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODE[data] * self.up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * P)

    def of_bytes(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, dtype=np.uint8)
        found, at = [], 0
        with np.errstate(over="ignore"):
            while at < len(data):
                end = min(at + PIECE, len(data))
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                found.append(self._piece(data[at:end]))
                at = end
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        return self.of_bytes((text or "").encode("utf-8", "surrogatepass"))
