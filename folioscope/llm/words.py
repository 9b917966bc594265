"""Words as numbers of a growing table of features, for models that score words once and look them up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' character n-grams, with marks at both ends, and the number of each one's word."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(chars == 2) - 1
    hashes, owners = [], []
    for k in orders:
        n = len(chars) - k + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h = (h ^ chars[i : i + n]) * _STEP
            h ^= h >> np.uint64(31)
        inside = owner[:n] == owner[k - 1 :]
        hashes.append(h[inside])
        owners.append(owner[:n][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


class WordTable:
    """Numbers of words, and their rows of features; cleared between batches when over ``limit`` words."""

    def __init__(self, features: Callable[[list[str]], np.ndarray], limit: int = 500_000):
        self.features, self.limit = features, limit
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.used, self.table = 0, np.zeros((0, 0), np.float32)

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The words' rows in ``table``; rows stay valid until the next call."""
        if self.used > self.limit:
            self._clear()
        new = list(set().union(*texts).difference(self.numbers)) if texts else []
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            rows = self.features(part)
            if self.used + len(part) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), self.used + len(part), 1 << 16), rows.shape[1]), np.float32)
                if self.used:
                    grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : self.used + len(part)] = rows
            self.numbers.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)
        return [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)) for words in texts]
