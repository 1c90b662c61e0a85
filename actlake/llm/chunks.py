"""Distinct-chunk tables: texts cut where no token can cross, each distinct chunk worked on once, results put back by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from actlake.llm.common import LOWER, WHITE, buffers, steps

#: A table that has this many chunks is emptied; it only saves work, so results don't depend on it.
TABLE_ROWS = 400_000
STEP = 2 << 20


def at_spaces(data: np.ndarray) -> np.ndarray:
    """Starts of chunks at each space after another character, and on both sides of a line feed."""
    space, feed = data == 0x20, data == 0x0A
    cut = feed.copy()
    cut[1:] |= space[1:] & ~space[:-1]
    cut[1:] |= feed[:-1]
    return cut


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER & ~_DIGIT
#: An apostrophe may start a contraction, and "<|" a special token: nothing is cut next to these.
_MARK[[0x27, 0x3C, 0x7C, 0x3E]] = False
_KIND = np.zeros(256, np.uint8)
_KIND[_LETTER], _KIND[_DIGIT], _KIND[_MARK] = 1, 2, 3


def at_words(data: np.ndarray) -> np.ndarray:
    """Starts of chunks at white space after other characters, and where two kinds of ASCII characters meet."""
    white, kind = WHITE[data], _KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = white[1:] & ~white[:-1]
    cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return cut


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, but for letters before other than ASCII: these may compose with what follows."""
    low = LOWER[data]
    low[:-1] = np.where(data[1:] < 0x80, low[:-1], data[:-1])
    return low


class Table:
    """Results by chunk. ``work`` takes a list of distinct chunks and gives a list of byte strings for each output.

    ``fold`` may make bytes equal that the results can't tell apart, so that fewer chunks are distinct.
    """

    def __init__(
        self,
        work: Callable[[list[bytes]], list[list[bytes]]],
        cuts: Callable[[np.ndarray], np.ndarray],
        fold: Callable[[np.ndarray], np.ndarray] | None = None,
        rows: int = TABLE_ROWS,
    ):
        self.work, self.cuts, self.fold, self.rows, self.known = work, cuts, fold, rows, {}

    def _values(self, chunks: list[bytes]) -> list[tuple[bytes, ...]]:
        new = [c for c in chunks if c not in self.known]
        if new:
            if len(self.known) + len(new) > self.rows:
                self.known.clear()
                new = chunks
            self.known.update(zip(new, zip(*self.work(new), strict=True), strict=True))
        return [self.known[c] for c in chunks]

    def apply(self, texts: pa.Array, lead: bytes = b"") -> Iterator[tuple[int, int, list[tuple[np.ndarray, memoryview]]]]:
        """For consecutive ranges of documents: for each output, offsets (one more than documents) and the joined bytes.

        ``lead`` goes before each text that isn't empty.
        """
        offsets, data = buffers(texts)
        for i, j in steps(offsets, STEP):
            at, body = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            if lead:
                full = at[:-1] < at[1:]
                body = np.insert(body, at[:-1][full], lead[0])
                at = at + np.concatenate([[0], np.cumsum(full)])
            body = np.ascontiguousarray(self.fold(body) if self.fold else body)
            cut = self.cuts(body)
            cut[at[:-1][at[:-1] < at[1:]]] = True
            starts = np.flatnonzero(cut)
            edges = np.append(starts, len(body)).astype(np.int64)
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(body)])
            coded = chunks.dictionary_encode()
            values = self._values(coded.dictionary.to_pylist())
            first = np.searchsorted(starts, at)
            outputs = []
            for k in range(len(values[0]) if values else 0):
                taken = pa.array([v[k] for v in values], pa.large_binary()).take(coded.indices)
                _, ends, joined = taken.buffers()
                ends = np.frombuffer(ends, np.int64)[: len(taken) + 1]
                outputs.append((ends[first] if len(taken) else np.zeros(j - i + 1, np.int64), memoryview(joined) if joined is not None else memoryview(b"")))
            yield i, j, outputs
