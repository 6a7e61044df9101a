"""Heaps of the best scored rows under a key, which merge in any order."""

from __future__ import annotations

from collections.abc import Hashable

import numpy as np


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > k:
        enough = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= enough)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Heaps:
    """The best ``k`` rows seen so far under each key."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key: Hashable, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.held:
            scores, ids = (np.concatenate(x) for x in zip(self.held[key], (scores, ids)))
        top = best(scores, ids, self.k)
        self.held[key] = scores[top], ids[top]

    def weakest(self, key: Hashable) -> int | None:
        """The last score of a full heap."""
        scores = self.held[key][0] if key in self.held else ()
        return int(scores[-1]) if len(scores) == self.k else None

    def rows(self) -> list[tuple[Hashable, int, int]]:
        return [(key, score, i) for key, held in self.held.items() for score, i in zip(held[0].tolist(), held[1].tolist())]
