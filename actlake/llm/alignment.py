"""Alignment of two tokenizers' ids over the same bytes, by an event sweep.

Both tokenizers' ends of tokens are events on a document's byte offsets. A task emits them as rows of ids for each side and window
of offsets; an id's end follows from the bytes its token has. The union of both sides is repartitioned by document and sorted by
offset inside partitions, and one pass over that order cuts groups where both sides end and links the tokens whose bytes
overlap. The pass keeps the open group and the counters of one document. How many documents hold a linked pair of ids is then counted
over the whole corpus and joined back to the documents' pairs.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm import byte_bpe, pieces
from actlake.llm.chunks import Table, at_spaces
from actlake.llm.common import cut, stored
from actlake.llm.spelling import Strings

#: Bytes of a text whose token ends make one row of a side.
WINDOW_BYTES = 1 << 14
#: Compressed bytes of events that one numpy step of the sweep works on.
STEP_BYTES = 1 << 20
#: Pairs of ids whose counts are broadcast (about 40 bytes each); more are joined by a shuffle. Same result either way.
BROADCAST_PAIRS = 1 << 20
#: Parts of a pair's rows in that shuffle, as one pair may be in a third of all documents.
SALT = 16
_ENDS = "row long, doc_id long, offset long, side byte, ids binary"
_SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


@functools.lru_cache(maxsize=2)
def _piece_strings(path: str) -> Strings:
    """Bytes of each piece: the marker is a space, a byte piece its byte."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    byte = proto.SentencePiece.BYTE
    return Strings([bytes([int(p.piece[1:-1], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in proto.pieces])


@functools.lru_cache(maxsize=2)
def _piece_table(path: str) -> Table:
    ids_of = pieces._table(path).work
    return Table(lambda chunks: [[np.array(x.split()).astype("<u2").tobytes() for x in ids_of(chunks)[0]]], at_spaces)


def _strings(path_a: str, path_b: str) -> tuple[Strings, Strings]:
    strings = byte_bpe.from_json(path_a).tokens, _piece_strings(path_b)
    if max(len(s.lengths) for s in strings) > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    return strings


def _ids_a(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of documents: ids, where each document's begin, and the bytes of space and text with their places."""
    for _, _, ids, first, body, at in byte_bpe.from_json(path).apply(texts, b" "):
        yield ids.astype(np.uint16), first, body, at


def _ids_b(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j, outputs in _piece_table(path).apply(texts, b" "):
        at, raw = outputs[0] if outputs else (np.zeros(j - i + 1, np.int64), b"")
        yield np.frombuffer(raw, "<u2")[: at[-1] // 2], at // 2


def _joined(ranges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and places of consecutive ranges as one."""
    base = np.cumsum([0, *(len(ids) for ids, _ in ranges)])
    at = np.concatenate([[0], *(first[1:] + b for (_, first), b in zip(ranges, base, strict=False))])
    return np.concatenate([ids for ids, _ in ranges]), at.astype(np.int64)


def _spells(strings: Strings, ids: np.ndarray, at: np.ndarray, body: np.ndarray, body_at: np.ndarray) -> np.ndarray:
    """For each document whether its ids' bytes are those of the text."""
    said, ends = strings.join(ids), np.concatenate([[0], strings.ends(ids)])[at]
    if np.array_equal(ends, body_at) and np.array_equal(said, body):
        return np.ones(len(at) - 1, bool)
    return np.array([np.array_equal(said[ends[k] : ends[k + 1]], body[body_at[k] : body_at[k + 1]]) for k in range(len(at) - 1)], bool)


def ends(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The union of both sides' token ends: row (a number for each row of ``docs``), doc_id, offset (of the window), side (0 or 1), ids.

    A document without tokens has one row without ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path_a, path_b)
        for b in batches:
            for part in range(0, b.num_rows, 512):
                rows, doc_ids, texts = (b[name].slice(part, 512) for name in ("row", "doc_id", "text"))
                a = list(_ids_a(texts, path_a))
                body, body_at = _joined([x[2:] for x in a])
                sides = _joined([x[:2] for x in a]), _joined(list(_ids_b(texts, path_b)))
                good = np.diff(body_at) > 0
                for s, (ids, at) in zip(strings, sides, strict=True):
                    good &= _spells(s, ids, at, body, body_at)
                found = [(k, 0, 0, b"") for k in np.flatnonzero(~good).tolist()]
                for side, (s, (ids, at)) in enumerate(zip(strings, sides, strict=True)):
                    stops = s.ends(ids)
                    for k in np.flatnonzero(good).tolist():
                        first, last = at[k], at[k + 1]
                        window = (stops[first:last] - 1 - body_at[k]) // WINDOW_BYTES if body_at[k + 1] - body_at[k] > WINDOW_BYTES else None
                        marks = [first, last] if window is None else [first, *(first + 1 + np.flatnonzero(np.diff(window))), last]
                        for x, y in zip(marks, marks[1:], strict=False):
                            offset = 0 if window is None else int(window[x - first]) * WINDOW_BYTES
                            found.append((k, offset, side, zlib.compress(ids[x:y].tobytes(), 1)))
                k, offset, side, raw = zip(*found, strict=True)
                k = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.take(k), doc_ids.take(k), pa.array(offset, pa.int64()), pa.array(side, pa.int8()), pa.array(raw, pa.binary())],
                    ["row", "doc_id", "offset", "side", "ids"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _ENDS)


class _Document:
    """What the sweep holds of a document: its counters, the pairs so far, and the ids after the last place where both sides end."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id = row, doc_id
        self.counts = [0, 0, 0, 0]
        self.sha = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.open = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]

    def result(self) -> tuple[list, np.ndarray, np.ndarray]:
        if len(self.open[0]) or len(self.open[1]):
            raise AssertionError("both sides end with the text")
        digest = self.sha.hexdigest() if self.counts[0] else ""
        if len(self.pairs) == 1:
            pairs, times = self.pairs[0]
        else:
            none = np.zeros(0, np.int64)
            pairs, place = np.unique(np.concatenate([none, *(p for p, _ in self.pairs)]), return_inverse=True)
            times = np.bincount(place, np.concatenate([none, *(t for _, t in self.pairs)]), len(pairs)).astype(np.int64)
        return [self.row, self.doc_id, *self.counts, digest], pairs, times


@functools.cache
def _marked(n: int) -> Strings:
    """Decimal ids after each of the marks: the next group, the other side of a group, the next id of a side."""
    return Strings([b"%s%d" % (mark, i) for mark in (b";", b"|", b",") for i in range(n)])


def _sweep(documents: list[_Document], ids: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], strings: tuple[Strings, Strings]) -> None:
    """Sweeps the events of consecutive documents: ``ids`` by side, ``of`` the document of each. What is open at the end stays in the last."""
    n = len(documents)
    lengths = [s.lengths[x] for s, x in zip(strings, ids, strict=True)]
    totals = np.maximum(*(np.bincount(o, x, n).astype(np.int64) for o, x in zip(of, lengths, strict=True)))
    base = np.cumsum(totals) - totals
    a_end, b_end = (np.cumsum(x) - np.concatenate([[0], np.cumsum(np.bincount(o, x, n).astype(np.int64))[:-1]])[o] + base[o] for o, x in zip(of, lengths, strict=True))
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    stop = both[-1] if len(both) else 0
    for side, end in enumerate((a_end, b_end)):
        documents[-1].open[side] = ids[side][end > stop].copy()
    (a, a_end, a_of), (b, b_end, b_of) = ((x[end <= stop], end[end <= stop], o[end <= stop]) for x, end, o in zip(ids, (a_end, b_end), of, strict=True))
    edges = np.append(base, base[-1] + totals[-1])
    union = np.union1d(a_end, b_end)
    pair = a[np.searchsorted(a_end, union)].astype(np.int64) << 16 | b[np.searchsorted(b_end, union)]
    key, times = np.unique(np.searchsorted(edges, union, "left") - 1 << 32 | pair, return_counts=True)
    key_at = np.searchsorted(key >> 32, np.arange(n + 1))
    # ids in the order of groups, A before B; a place is what stands before it on both sides
    a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
    marks = len(strings[0].lengths), len(strings[1].lengths)
    v = max(marks)
    words = np.zeros(len(a) + len(b), np.int64)
    a_first = np.append(True, a_group[1:] != a_group[:-1])[: len(a)]
    b_first = np.append(True, b_group[1:] != b_group[:-1])[: len(b)]
    words[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = np.where(a_first, 0, 2 * v) + a
    words[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = np.where(b_first, v, 2 * v) + b
    spelled = _marked(v)
    text, text_at = spelled.join(words), np.concatenate([[0], spelled.ends(words)])
    counts = [np.bincount(x, minlength=n) for x in (a_of, b_of)]
    word_at = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
    counts += [np.diff(np.searchsorted(x, edges, "right")) for x in (both, union)]
    table = np.stack(counts, 1).tolist()
    for k, d in enumerate(documents):
        if not table[k][2]:
            continue
        d.sha.update(text[text_at[word_at[k]] + (d.counts[0] == 0) : text_at[word_at[k + 1]]])
        d.counts = [x + y for x, y in zip(d.counts, table[k], strict=True)]
        d.pairs.append((key[key_at[k] : key_at[k + 1]] & 0xFFFFFFFF, times[key_at[k] : key_at[k + 1]]))


def _batch(found: list[_Document]) -> pa.RecordBatch:
    rows, pairs, times = zip(*(d.result() for d in found), strict=True)
    at = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    flat = np.concatenate(pairs).astype(np.uint32).view(np.int32), np.concatenate(times).astype(np.int32)
    columns = [pa.array(x, pa.string() if k == 6 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))]
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    return pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(at, pa.array(x)) for x in flat)], names)


def sweep(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: its counts, the digest of its groups, its distinct linked pairs (A id << 16 | B id) and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path_a, path_b)
        now: _Document | None = None
        for b in batches:
            sizes = np.cumsum([len(x) for x in b["ids"].to_pylist()]) if b.num_rows else np.zeros(0, np.int64)
            first = 0
            while first < b.num_rows:
                base = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, base + STEP_BYTES, "right")))
                part = b.slice(first, last - first)
                first = last
                documents: list[_Document] = [now] if now else []
                runs: tuple[list, list] = ([], [])
                for side in (0, 1):
                    if now:
                        runs[side].append((0, now.open[side]))
                for row, doc_id, side, raw in zip(*(part[c].to_pylist() for c in ("row", "doc_id", "side", "ids")), strict=True):
                    if not documents or documents[-1].row != row:
                        documents.append(_Document(row, doc_id))
                    runs[side].append((len(documents) - 1, np.frombuffer(zlib.decompress(raw), "<u2") if raw else np.zeros(0, np.uint16)))
                for d in documents:
                    d.open = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
                ids = tuple(np.concatenate([np.zeros(0, np.uint16), *(x for _, x in r)]) for r in runs)
                of = tuple(np.repeat(np.array([k for k, _ in r], np.int64), [len(x) for _, x in r]) for r in runs)
                _sweep(documents, ids, of, strings)
                now = documents.pop()
                if documents:
                    yield _batch(documents)
        if now:
            yield _batch([now])

    return events.repartition("row").sortWithinPartitions("row", "offset", "side").mapInArrow(run, _SWEPT)


def pair_counts(swept: DataFrame) -> DataFrame:
    """Each linked pair of ids, ``documents`` that hold it linked, and whether no pair of its A id is in more (``best``)."""
    counts = cut(swept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")))
    most = F.max("documents").over(Window.partitionBy(F.shiftrightunsigned("pair", 16)))
    return cut(counts.select("pair", "documents", (F.col("documents") == most).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer file and reads a space before the text; B a piece model that adds one. Without tokens (zeros and an
    empty groups_sha256) are null and empty texts, and those whose tokens' bytes aren't the space and the text on one of the sides. Each
    repeated row counts as a document; a null id stays null; an empty table gives an empty one; other columns are not read. A very
    long text takes many rows of events, of which the sweep holds the open group.
    """
    swept = stored(sweep(ends(docs, path_a, path_b), path_a, path_b))
    counts = pair_counts(swept)
    links = swept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    if counts.count() <= broadcast_pairs:
        known = links.join(F.broadcast(counts), "pair")
    else:
        spread = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        known = links.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(spread, ["pair", "part"])
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    sums = sums.select("row", F.coalesce("n_best", F.lit(0)).alias("n_best"), "count_sum")
    whole = swept.drop("pairs", "times").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The linked pairs of each row of ``docs``: doc_id, a_id, b_id, times (occurrences whose bytes overlap)."""
    swept = sweep(ends(docs, path_a, path_b), path_a, path_b)
    each = swept.select("doc_id", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    pair = F.col("link.pairs")
    return each.select("doc_id", F.shiftrightunsigned(pair, 16).alias("a_id"), pair.bitwiseAND(0xFFFF).alias("b_id"), F.col("link.times").alias("times"))
