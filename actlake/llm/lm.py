"""Scoring by a bigram language model whose counts sit in a log-frequency Bloom filter.

After D. Talbot and M. Osborne, Smoothed Bloom filter language models (EMNLP 2007): an n-gram with quantised log count q is entered
q times, once for each level, and its count is read by probing level after level until one is missing. The filter is built once,
from training counts only, and holds every training bigram's count and every context's number of different successors, from which
Witten-Bell smoothing follows. A context's tokens need no entry: they are the exact count of its word, which the base score needs anyway.

The filter is cut into segments by ranges of the keys' hashes, each built in its range's task. A key has at most as many levels as
its count, so the number of tokens bounds the filter's size. While that bound is at most ``FILTER_BYTES`` the segments are
broadcast and the tasks that score texts probe them. Beyond it the blocks' keys, which meet in the ranges' tasks to be counted, are
probed there, once a segment is made, and the levels go back. Bits and answers are the same, only the transport differs.

An entry takes k / 0.69 bits for k probes, half of the bits are set, and a key that isn't held is found with a chance of 2^-k. A
context could so be followed by V / 2^k words too many, V the vocabulary; k is such that this is at most an eighth. Counts are
taken as the least of their level, and the expected false successors count in the denominator: the chances of one context
sum to at most 1 in expectation. The score differs from exact Witten-Bell by what rounding down to a level loses.

Texts are tokenised once, into blocks of documents: a block holds the hashes of its distinct words and its tokens as places in
that list. Words' exact counts come back to the blocks that asked for them: each block sends its sorted hashes, cut by ranges, to the
ranges' tasks and gets the counts in the same order. So a word crosses the network once for each block, not for each token.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import Words, buffers, cut, mix, steps

BLOCK_BYTES = 12 << 20
#: Tokens that one range of hashes gets, on average.
RANGE_TOKENS = 6_000_000
#: All segments together may be broadcast up to this size.
FILTER_BYTES = 128 << 20
LEAST_PROBES = 8
#: Keys that one numpy step enters.
STEP_KEYS = 1 << 18
#: Share of set bits that a segment is sized for is a half.
FULL = 0.69
BIGRAM_BASE, CONTEXT_BASE = 1.5, 1.2
END, START = np.uint64(0xE17D), np.uint64(0x57A7)  # hashes of the marks around a text
_BLOCK = "block long, docs array<long>, held array<boolean>, lengths array<int>, tokens binary, words binary, counts binary"
_ZSTD = pa.Codec("zstd")


def _packed(values: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane so that small numbers compress."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return len(values).to_bytes(8, "little") + (_ZSTD.compress(planes.T.tobytes(), asbytes=True) if len(values) else b"")


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=n * width), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Tokenised blocks of documents: a token is a word or the end of a text; counts are those of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for b in batches:
            offsets, data = buffers(b["text"])
            for i, j in steps(offsets, BLOCK_BYTES):
                own = offsets[i : j + 1]
                hashes, lengths = [], []
                for x, y in steps(own):
                    words = Words(own[x : y + 1] - own[x], data[own[x] : own[y]])
                    hashes.append(np.insert(words.hashes, words.first[1:], END))
                    lengths.append(np.diff(words.first) + 1)
                length = np.concatenate(lengths)
                held = b["held"].slice(i, j - i).fill_null(False)
                words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                trained = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), length)
                counts = np.bincount(tokens[trained], minlength=len(words)).astype(np.uint32)
                row = [
                    TaskContext.get().partitionId() << 32 | made,
                    b["doc_id"].slice(i, j - i).to_pylist(), b["held"].slice(i, j - i).to_pylist(), length.tolist(),
                    _packed(tokens.astype(np.uint32)), _packed(_gaps(words)), _packed(counts),
                ]
                made += 1
                names, kinds = zip(*(x.split(" ") for x in _BLOCK.split(", ")), strict=True)
                types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([v], types[k]) for v, k in zip(row, kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.cast("boolean").alias("held")).mapInArrow(run, _BLOCK)


def _rows(df: DataFrame, of: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """One call of ``of`` for each row, with its columns as arguments; it yields tuples of the schema."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                made = list(of(*(c[k].as_py() for c in b.columns)))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _types(schema), strict=True)], names)

    return df.mapInArrow(run, schema)


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return [kinds[x.split(" ")[1]] for x in schema.split(", ")]


def _grouped(df: DataFrame, key: str, of: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """``of`` gets the columns of each group as lists and yields tuples of the schema."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        made = list(zip(*of(table.to_pydict()), strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(made, _types(schema), strict=True)], names)

    return df.groupBy(key).applyInArrow(run, schema)


def _edges(ranges: int) -> np.ndarray:
    """Upper ends of about equal ranges of 64-bit hashes, without the last; a key's 32 high bits tell its range."""
    return np.array([((k << 32) // ranges) << 32 for k in range(1, ranges)], np.uint64)


def _cuts(sorted_hashes: np.ndarray, ranges: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(sorted_hashes, _edges(ranges)), [len(sorted_hashes)]])


def _words(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed, np.uint64), dtype=np.uint64)


def counts_for_blocks(found: DataFrame, ranges: int) -> DataFrame:
    """(block, range, counts, n, v): the corpus counts of each block's words in the order of their hashes.

    A row with block -1 per range has the training tokens and distinct training words.
    """

    def ask(block: int, words: bytes, counts: bytes) -> Iterator[tuple]:
        hashes, own = _words(words), _unpacked(counts, np.uint32)
        at = _cuts(hashes, ranges)
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                yield block, k, _packed(_gaps(hashes[a:b])), _packed(own[a:b])

    def answer(g: dict) -> Iterator[tuple]:
        hashes = [_words(x) for x in g["hashes"]]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpacked(x, np.uint32) for x in g["counts"]]), len(words)).astype(np.int64)
        yield -1, g["range"][0], b"", int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(h) for h in hashes])
        for block, a, b in zip(g["block"], np.concatenate([[0], ends[:-1]]), ends, strict=True):
            yield block, g["range"][0], _packed(total[at[a:b]]), 0, 0

    asked = _rows(found.select("block", "words", "counts"), ask, "block long, range int, hashes binary, counts binary")
    return _grouped(asked, "range", answer, "block long, range int, counts binary, n long, v long")


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits that stand for a bigram: 32 bits of each hash, mixed by a bijection."""
    return mix((before & ~np.uint64(0xFFFFFFFF)) | (word >> np.uint64(32)))


def _unshift(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(33))  # its own inverse, as 2 * 33 > 64


def contexts_of(keys: np.ndarray) -> np.ndarray:
    """The first word's 32 bits of each key (the inverse of ``mix``)."""
    h = _unshift(keys) * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h = _unshift(h) * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return _unshift(h) >> np.uint64(32)


def _before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each, START before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return before


def _merged(items: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The distinct items of all arrays, each item's place among them, and the sums of each value by item."""
    own, at = np.unique(np.concatenate(items), return_inverse=True)
    return own, at, *(np.bincount(at, np.concatenate(v), len(own)).astype(np.int64) for v in values)


def probes_for(words: int) -> int:
    """Probes with which a context has at most an eighth of a false successor among ``words`` words, on average."""
    return max(LEAST_PROBES, int(np.ceil(np.log2(8 * (words + 1)))))


def _sized(keys: np.ndarray, level: np.ndarray, probes: int) -> bytes:
    return segment(keys, level, int(int(level.sum()) * probes / FULL) // 64 * 64 + 64, probes)


def filter_bound(tokens: int, ranges: int, probes: int) -> int:
    """Bytes that all segments together can't exceed: bigrams and successors have no more levels than the training texts have tokens."""
    return int(2 * tokens * probes / FULL) // 8 + 16 * ranges


def segments(found: DataFrame, ranges: int, probes: int, answer: bool) -> DataFrame:
    """(kind, range, block, data): the filter's segments, of bigrams (kind 0) and of contexts (kind 1), from training documents.

    With ``answer`` ``data`` are, in the place of the bits, what they say of each block's distinct keys of the kind and range.
    """

    def cut_up(block: int, kind: int, keys: np.ndarray, items: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        ends = _cuts(keys, ranges)
        for r, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                yield block, kind, r, _packed(_gaps(items[a:b])), _packed(counts[a:b].astype(np.uint32))

    def counted(block: int, held: list, lengths: list, tokens: bytes, words: bytes) -> Iterator[tuple]:
        length = np.array(lengths)
        flat = _words(words)[_unpacked(tokens, np.uint32)]
        keys, at = np.unique(pair_keys(_before(flat, length), flat), return_inverse=True)
        n = np.bincount(at[np.repeat(~np.array([bool(h) for h in held]), length)], minlength=len(keys))
        sent = slice(None) if answer else n > 0
        yield from cut_up(block, 0, keys[sent], keys[sent], n[sent])

    def named(block: int, words: bytes) -> Iterator[tuple]:
        own, _ = _contexts(_words(words))
        yield from cut_up(block, 1, context_keys(own), own, np.zeros(len(own)))

    def built(g: dict, keys_of: Callable, base: float) -> tuple[np.ndarray, Iterator[tuple]]:
        asked = [_words(x) for x in g["keys"]]
        own, at, n = _merged(asked, [_unpacked(x, np.uint32) for x in g["counts"]])
        keys, known = keys_of(own), n > 0
        bits = _sized(keys[known], levels(n[known], base), probes)

        def rows() -> Iterator[tuple]:
            if not answer:
                yield g["kind"][0], g["range"][0], -1, bits
                return
            level = probe_segment(np.frombuffer(bits, np.uint8), keys, probes).astype(np.uint8)
            for block, places in zip(g["block"], np.split(at, np.cumsum([len(x) for x in asked])[:-1]), strict=True):
                if block >= 0:
                    yield g["kind"][0], g["range"][0], block, _packed(level[places])

        return own[known], rows()

    def bigrams(g: dict) -> Iterator[tuple]:
        keys, rows = built(g, lambda x: x, BIGRAM_BASE)
        for row in rows:
            yield *row, b""
        own, types = np.unique(contexts_of(keys), return_counts=True)
        for _, kind, r, *rest in cut_up(-1, 1, context_keys(own), own, types):
            yield kind, r, -1, *rest

    def contexts(g: dict) -> Iterator[tuple]:
        yield from built(g, context_keys, CONTEXT_BASE)[1]

    message = "block long, kind int, range int, keys binary, counts binary"
    sent = _rows(found.select("block", "held", "lengths", "tokens", "words"), counted, message)
    made = cut(_grouped(sent, "range", bigrams, "kind int, range int, block long, data binary, counts binary"))
    of_contexts = made.where("kind = 1").selectExpr("block", "kind", "range", "data AS keys", "counts")
    if answer:
        of_contexts = of_contexts.unionByName(_rows(found.select("block", "words"), named, message))
    made = made.where("kind = 0").drop("counts")
    return made.unionByName(_grouped(of_contexts, "range", contexts, "kind int, range int, block long, data binary"))


def _contexts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of a block, 32 bits each, and the place of every word and of START among them."""
    return np.unique(np.append(words, START) >> np.uint64(32), return_inverse=True)


def _asked(words: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A block's distinct keys of each kind, and the places among them: of its tokens' bigrams, of its words' (and START's) contexts."""
    flat = words[at]
    pairs, of_pair = np.unique(pair_keys(_before(flat, length), flat), return_inverse=True)
    own, of_context = _contexts(words)
    return [pairs, context_keys(own)], [of_pair, of_context]


def levels(counts: np.ndarray, base: float, least: int = 1) -> np.ndarray:
    """Quantised log count: 1 from ``least``, one more for each factor ``base``; 0 below."""
    return np.where(counts >= least, 1 + np.floor(np.log(np.maximum(counts, least) / least) / np.log(base) + 1e-9), 0).astype(np.int64)


def least_of(level: np.ndarray, base: float) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(base ** (level - 1.0) - 1e-9), 0.0)


def context_keys(context: np.ndarray) -> np.ndarray:
    """Keys of contexts' successors; the low bits only are set, so that the keys are in the contexts' order."""
    return (context << np.uint64(32)) | np.uint64(1)


def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of a key begin at a level, and the step from each to the next."""
    h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return h, mix(h) | np.uint64(1)


def _place(h: np.ndarray, size: int) -> np.ndarray:
    return ((h >> np.uint64(1)) % np.uint64(size)).astype(np.int64)


def segment(keys: np.ndarray, level: np.ndarray, size: int, probes: int) -> bytes:
    """Bloom filter of ``size`` bits that holds each key once for each level up to its own."""
    data = np.zeros(-(-size // 8), np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        entered = keys[level >= j]
        for i in range(0, len(entered), STEP_KEYS):
            h, step = _hashes(entered[i : i + STEP_KEYS], j)
            for _ in range(probes):
                at = _place(h, size)
                np.bitwise_or.at(data, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
                h += step
    return data.tobytes()


def probe_segment(data: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    """Level of each key: levels are probed upwards until one is missing. A segment without bytes holds nothing."""
    level, alive, size, j = np.zeros(len(keys), np.int64), np.arange(len(keys) if len(data) else 0), 8 * len(data), 0
    while len(alive):
        j += 1
        h, step = _hashes(keys[alive], j)
        for _ in range(probes):
            at = _place(h, size)
            hit = (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive, step = alive[hit], step[hit]
            h = h[hit] + step
            if not len(alive):
                break
        level[alive] = j
    return level


@dataclasses.dataclass
class Filter:
    """The segments of each kind and range, as bytes."""

    made: dict[tuple[int, int], np.ndarray]
    ranges: int
    probes: int

    def probe(self, kind: int, sorted_keys: np.ndarray) -> np.ndarray:
        ends, none = _cuts(sorted_keys, self.ranges), np.zeros(0, np.uint8)
        parts = [probe_segment(self.made.get((kind, k), none), sorted_keys[a:b], self.probes) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        return np.concatenate(parts)


def score(docs: DataFrame, held_out: Column, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are one end token; repeated rows each count and are scored each; a row whose fold is unknown (null id) is
    trained on and has a null held_out; an empty table gives an empty one; other columns are not read. A filter that could
    exceed ``filter_bytes`` bytes is not broadcast.
    """
    found = cut(blocks(docs, held_out))
    total = found.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = max(8, -(-total // RANGE_TOKENS))
    answers = cut(counts_for_blocks(found, ranges))
    n, v = answers.where("block = -1").agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    probes = probes_for(v)
    false_successors = (v + 1) / 2.0**probes
    whole = filter_bound(total, ranges, probes) <= filter_bytes
    made = segments(found, ranges, probes, not whole)
    held_filter = None
    if whole:
        own = {(r.kind, r.range): np.frombuffer(r.data, np.uint8) for r in made.collect()}
        held_filter = docs.sparkSession.sparkContext.broadcast(Filter(own, ranges, probes))

    def scored(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        kinds, at_range = replies["kind"].to_numpy(), replies["range"].to_numpy()

        def reply(kind: int, of: type) -> np.ndarray:
            mine = np.flatnonzero(kinds == kind)
            return np.concatenate([_unpacked(replies["data"][int(k)].as_py(), of) for k in mine[np.argsort(at_range[mine])]])

        counts = reply(-1, np.int64)
        words, at, length = _words(row["words"]), _unpacked(row["tokens"], np.uint32), np.array(row["lengths"])
        keys, (of_pair, of_context) = _asked(words, at, length)
        pair, types = (held_filter.value.probe(k, x) if whole else reply(k, np.uint8).astype(np.int64) for k, x in enumerate(keys))
        pair, types = least_of(pair, BIGRAM_BASE)[of_pair], least_of(types, CONTEXT_BASE)[of_context]
        unigram = (counts + 0.1) / (n + 0.1 * (v + 1))
        place = np.empty(len(at), np.int64)
        place[1:] = at[:-1]
        place[np.cumsum(length) - length] = len(words)
        # END is no context, so its count stands for that of START: both occur once in a text
        context_count = np.append(counts, counts[np.searchsorted(words, END)])
        seen, new = context_count[place], types[place]
        bigram = (np.minimum(pair, seen) + new * unigram[at]) / np.maximum(seen + new + false_successors, 1e-9)
        chance = np.where(seen > 0, bigram, unigram[at])
        total = lambda x: np.add.reduceat(x, np.cumsum(length) - length)  # noqa: E731  every text has its end token
        return pa.table(
            [
                pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(length, pa.int64()), pa.array(total((counts[at] > 0).astype(np.int64))),
                pa.array(np.full(len(length), n, np.int64)), pa.array(total(np.log10(unigram)[at])), pa.array(total(np.log10(chance))),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = answers.where("block >= 0").selectExpr("block", "-1 AS kind", "range", "counts AS data")
    if not whole:
        replies = replies.unionByName(made.select("block", "kind", "range", "data"))
    return found.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scored, schema)
