"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens.

The vocabulary file's pieces and scores are read as a unigram model: a text's segmentation is the one with the largest sum of
scores. Pre-tokens are the chunks that no piece crosses. A task puts the distinct ones it meets into a trie, level by level;
the best forward score and its number of tokens are computed once for each node, that is once for each shared prefix, and
the nodes where pre-tokens end hold their counts. Each level is one vectorised step over all its nodes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.chunks import Table, at_spaces
from actlake.llm.common import mix

_SPACE = "▁"
#: Longer pre-tokens share hardly any prefix; each gets the same recurrence by itself.
DEPTH = 40
_BASE = 0xD6E8FEB86659FD93
_UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with scores; an unknown character costs more than any piece and counts as its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - _UNKNOWN_PENALTY
        self.longest = max(map(len, scores), default=1)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.array([1] + [_BASE] * (DEPTH + self.longest), np.uint64), dtype=np.uint64)
            self.down = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * (DEPTH + self.longest), np.uint64), dtype=np.uint64)
        keys = np.array([self._hash(p) for p in scores], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(scores.values()))[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have the same hash")

    def _hash(self, piece: str) -> int:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return int((mix(codes + np.uint64(1)) * self.up[: len(codes)]).sum(dtype=np.uint64))

    def one(self, text: str) -> tuple[int, float]:
        """Count and score of a single pre-token."""
        best, count = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                s = self.scores.get(text[start:end])
                if s is not None and best[start] + s > best[end]:
                    best[end], count[end] = best[start] + s, count[start] + 1
            if text[end - 1] not in self.scores and best[end - 1] + self.unknown > best[end]:
                best[end], count[end] = best[end - 1] + self.unknown, count[end - 1] + len(text[end - 1].encode())
        return count[-1], best[-1]

    def trie(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and scores of distinct pre-tokens of at most ``DEPTH`` characters, from one trie."""
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        node = np.zeros(len(texts), np.int64)  # where each pre-token stands
        parent, sums = np.zeros(1, np.int64), np.zeros(1, np.uint64)
        best, count = np.zeros(1), np.zeros(1, np.int64)
        alive = np.arange(len(texts))
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[lengths[alive] >= depth]
            code = codes[starts[alive] + depth - 1]
            key, where = np.unique((node[alive] << 21) | code, return_inverse=True)
            above, code = key >> 21, key & ((1 << 21) - 1)
            node[alive] = len(parent) + where
            total = sums[above] + mix(code.astype(np.uint64) + np.uint64(1)) * self.up[depth - 1]
            steps, at = [], above
            for _ in range(min(depth, self.longest)):
                steps.append(at)
                at = parent[at]
            top, tokens = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
            for size in range(len(steps), 0, -1):  # the longest piece first, which ties go to
                start = steps[size - 1]
                found, hit = self._find((total - sums[start]) * self.down[depth - size])
                value = np.where(hit, best[start] + self.values[found], -np.inf)
                if size == 1:
                    value = np.where(hit, value, best[start] + self.unknown)
                    width = np.where(hit, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
                better = value > top
                top = np.where(better, value, top)
                tokens = np.where(better, count[start] + (width if size == 1 else 1), tokens)
            parent, sums = np.concatenate([parent, above]), np.concatenate([sums, total])
            best, count = np.concatenate([best, top]), np.concatenate([count, tokens])
        return count[node], best[node]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def work(self, chunks: list[bytes]) -> list[list[bytes]]:
        texts = [c.decode().replace(" ", _SPACE) for c in chunks]
        counts, scores = np.zeros(len(texts), np.uint32), np.zeros(len(texts))
        short = [k for k, t in enumerate(texts) if len(t) <= DEPTH]
        counts[short], scores[short] = self.trie([texts[k] for k in short])
        for k, t in enumerate(texts):
            if len(t) > DEPTH:
                counts[k], scores[k] = self.one(t)
        return [[c.tobytes() for c in counts], [s.tobytes() for s in scores]]


@functools.lru_cache(maxsize=2)
def _table(path: str) -> Table:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = {p.piece: p.score for p in proto.pieces if p.type == proto.SentencePiece.NORMAL}
    if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
        raise ValueError("this vocabulary's pieces cross white space")
    return Table(Vocabulary(pieces).work, at_spaces)


def count_column(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive ranges of texts: tokens, pre-tokens and unigram score of each."""
    for i, j, outputs in _table(path).apply(texts, b" "):
        if not outputs:
            yield np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros(j - i)
            continue
        (counts_at, counts), (scores_at, scores) = outputs
        tokens = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32)[: counts_at[-1] // 4], dtype=np.int64)])
        values = np.frombuffer(scores, np.float64)[: scores_at[-1] // 8]
        first = counts_at // 4
        score = np.array([values[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)])
        yield np.diff(tokens[first]), np.diff(first), score


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_pretokens, score (natural units of the vocabulary's scores).

    Null and empty texts count nothing; rows that repeat are counted each; a null id stays null; an empty table gives an empty
    one; no other column is read. Of equally good segmentations the one whose last piece is longest counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = list(count_column(b["text"], path))
            tokens, chunks, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(tokens.astype(np.int64)), pa.array(chunks.astype(np.int64)), pa.array(score.astype(float))],
                ["doc_id", "n_tokens", "n_pretokens", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, score double")
