"""Byte strings by number, joined for whole arrays of numbers at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Strings:
    """``join`` writes the strings of many numbers one after the other; ``lengths`` are their bytes."""

    def __init__(self, strings: Sequence[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each string ends when they stand one after the other."""
        return np.cumsum(self.lengths[ids])

    def join(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.blob[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])]
