"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

Where a text is split before merging is found without a regular expression. Each code point gets a symbol: its class (letter,
number, white space, other), and for white space and apostrophes what the pattern asks of the next one or two code points. A
symbol is a function from the automaton's state before a code point to the state after it. These functions are closed under
composition, which is associative, so the states of a whole buffer of documents follow from one scan over numbers of functions
with a table of their products, in blocks side by side. A first code point maps every state alike, which keeps documents apart.
The slices between the places found are merged once each while a bounded table remembers them; their ids are joined by position.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import buffers, steps
from actlake.llm.spelling import Strings

STEP = 2 << 20
#: A table of slices that holds more bytes than this is emptied; it only saves work, so results don't depend on it.
TABLE_BYTES = 64 << 20
#: Bytes that an entry takes besides its slice and ids.
ENTRY_BYTES = 200

OTHER, LETTER, NUMBER, WHITE = range(4)
#: Code points beyond these planes are neither letters, numbers nor white space.
PLANES = 0x40000

# symbols: a letter, a number, another mark, an apostrophe that may start a contraction of 2 or 3 code points, white space before
# white space or the end, a space and other white space before something else; with FIRST at the start of a document
L, N, O, SHORT, LONG, RUN, SPACE, LAST = range(8)  # noqa: E741
FIRST = 8
# states: a token ended for good, within letters, numbers, marks, white space, after a space that the next run takes in,
# two or one code points of a contraction to come
ENDED, IN_L, IN_N, IN_O, IN_W, AFTER_SPACE, TWO, ONE = range(8)

_OPENS = {L: IN_L, N: IN_N, O: IN_O, SHORT: ONE, LONG: TWO, RUN: IN_W, SPACE: AFTER_SPACE, LAST: ENDED}
_GOES_ON = {
    (IN_L, L): IN_L, (IN_N, N): IN_N, (IN_W, RUN): IN_W,
    **{(s, x): IN_O for s in (IN_O, AFTER_SPACE) for x in (O, SHORT, LONG)}, (AFTER_SPACE, L): IN_L, (AFTER_SPACE, N): IN_N,
    **{(TWO, x): ONE for x in range(8)}, **{(ONE, x): ENDED for x in range(8)},
}


class Automaton:
    """``products[f, g]``: number of the function f, then g. ``ends``: the state after each function at the start of a buffer.
    ``opens[state, symbol]``: a token starts here. ``numbers``: the function of each symbol. ``same``: the number of the identity.
    """

    def __init__(self):
        self.opens = np.ones((8, 16), bool)
        steps_of = []
        for x in range(16):
            to = [_OPENS[x % 8]] * 8
            for s in range(8):
                if x < FIRST and (s, x) in _GOES_ON:
                    to[s], self.opens[s, x] = _GOES_ON[s, x], False
            steps_of.append(tuple(to))
        known = list(dict.fromkeys([tuple(range(8)), *steps_of]))
        number = {f: k for k, f in enumerate(known)}
        for f in known:  # grows until it is closed
            for g in steps_of:
                if (h := tuple(g[s] for s in f)) not in number:
                    number[h] = len(known)
                    known.append(h)
        self.same, self.numbers = 0, np.array([number[f] for f in steps_of], np.uint16)
        self.products = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
        self.ends = np.array(known, np.uint8)[:, ENDED]


@functools.cache
def automaton() -> Automaton:
    return Automaton()


def states(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """The state after each symbol: a scan of the symbols' functions, inside blocks side by side, then over the blocks."""
    machine = automaton()
    products = machine.products

    def scan(f: np.ndarray) -> np.ndarray:
        if len(f) <= block:
            out = f.copy()
            for i in range(1, len(out)):
                out[i] = products[out[i - 1], out[i]]
            return out
        rows = -(-len(f) // block)
        grid = np.full(rows * block, machine.same, np.uint16)
        grid[: len(f)] = f
        grid = np.ascontiguousarray(grid.reshape(rows, block).T)
        for i in range(1, block):
            grid[i] = products[grid[i - 1], grid[i]]
        before = np.append(np.uint16(machine.same), scan(grid[-1])[:-1])
        return products[before[None, :], grid].T.reshape(-1)[: len(f)]

    return machine.ends[scan(machine.numbers[symbols])]


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which code points start a slice. ``first``: where documents that aren't empty begin."""
    kind = classes[points]
    head = np.zeros(len(points) + 1, bool)
    head[first] = True
    head[-1] = True  # nothing is seen beyond a document
    one = np.where(head[1:], 0, np.append(points[1:], 0))
    two = np.where(head[1:] | np.append(head[2:], True), 0, np.append(points[2:], [0, 0])[: len(points)])
    symbol = np.array([O, L, N, RUN], np.uint8)[kind]
    breaks = (kind == WHITE) & ~head[1:] & (np.append(kind[1:], WHITE) != WHITE)
    symbol[breaks] = np.where(points[breaks] == 0x20, SPACE, LAST)
    mark = np.flatnonzero(points == 0x27)
    x, y = one[mark], two[mark]
    symbol[mark[np.isin(x, [ord(c) for c in "stmd"])]] = SHORT
    long = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    symbol[mark[long]] = LONG
    symbol[first] += FIRST
    after = states(symbol)
    before = np.concatenate([[np.uint8(ENDED)], after[:-1]])
    return automaton().opens[before, symbol]


@functools.cache
def tiktoken_classes() -> np.ndarray:
    """Class by code point as tiktoken's own Unicode tables have them."""
    import tiktoken

    known = "".join(map(chr, [*range(0xD800), *range(0xE000, PLANES)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[[ord(c) for c in one.decode(one.encode_ordinary(known))]] = kind
    return out


@functools.cache
def tokenizers_classes() -> np.ndarray:
    """Class by code point as the tokenizers library has them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    known = "".join(map(chr, [*range(0xD800), *range(0xE000, PLANES)]))
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, PLANES)])
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\P{L}+"), (NUMBER, r"\P{N}+"), (WHITE, r"\S+")):
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(known):
            out[points[a:b]] = kind
    return out


class Merges:
    """Pairs of ids that merge: ``of`` gives a pair's place in the table, or -1; ``rank`` and ``into`` are by place."""

    def __init__(self, pairs: list[tuple[int, int, int, int]]):
        """``pairs``: left id, right id, rank, id of both together."""
        left, right, rank, into = np.array(pairs, np.int64).T
        order = np.argsort(left << 32 | right)
        self.keys, self.rank, self.into = (left << 32 | right)[order], rank[order], into[order]
        self.by_pair = {(a, b): (r, c) for a, b, r, c in pairs}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


def merge_one(ids: list[int], merges: Merges) -> list[int]:
    """Ids after all merges: of neighbours that merge, those with the smallest rank first, then from the left."""
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int) -> list[tuple[int, int, int, int, int]]:
        j = after[i]
        found = merges.by_pair.get((ids[i], ids[j])) if j < n else None
        return [(found[0], i, ids[i], ids[j], found[1])] if found else []

    heap = [x for i in range(n) for x in pair(i)]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, into = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has merged since
        ids[i], ids[j], after[i] = into, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (*pair(i), *(pair(before[i]) if before[i] >= 0 else ())):
            heapq.heappush(heap, x)
    return [x for x in ids if x >= 0]


def merge_short(ids: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many short slices after all merges, and how many each has; each round makes the next merge of every slice."""
    piece = np.repeat(np.arange(len(lengths)), lengths)
    none, bits = np.int64(1) << 40, int(lengths.max(initial=1)).bit_length()
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def found(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that begin at ``at``, and their ranks with their places."""
        both = at + 1 < len(ids)
        both[both] = piece[at[both]] == piece[at[both] + 1]
        pair = np.full(len(at), -1)
        pair[both] = merges.of(ids[at[both]], ids[at[both] + 1])
        return pair, np.where(pair >= 0, merges.rank[pair] << bits | place[at], none)

    pair, key = found(np.arange(len(ids)))
    done = []
    while len(ids):
        starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        least = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(ids))))
        over = least == none
        if over.any():
            done.append((piece[over], ids[over]))
            ids, piece, place, pair, key, least = (x[~over] for x in (ids, piece, place, pair, key, least))
        at = np.flatnonzero(key == least)
        ids[at] = merges.into[pair[at]]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids, piece, place, pair, key = (x[stay] for x in (ids, piece, place, pair, key))
        at -= np.arange(len(at))
        changed = np.concatenate([at, at[at > 0] - 1])
        pair[changed], key[changed] = found(changed)
    piece, ids = (np.concatenate([x[k] for x in done]) for k in (0, 1)) if done else (piece, ids)
    order = np.argsort(piece, kind="stable")
    return ids[order], np.bincount(piece, minlength=len(lengths))


#: Longer slices are merged one at a time with a heap; the merges are the same.
SHORT_BYTES = 48


class Encoder:
    """Ids of whole texts. ``whole``: a slice that is a token is taken as one, without merging."""

    def __init__(self, ids: dict[bytes, int], merges: Merges, classes: np.ndarray, whole: bool, table_bytes: int = TABLE_BYTES):
        self.ids, self.merges, self.classes, self.whole, self.table_bytes = ids, merges, classes, whole, table_bytes
        strings = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            strings[i] = token
        self.tokens = Strings(strings)
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _learn(self, pieces: list[bytes]) -> None:
        short, held = [], 0
        for p in pieces:
            held += len(p)
            if self.whole and p in self.ids:
                self.known[p] = np.array([self.ids[p]], "<u4").tobytes()
            elif len(p) > SHORT_BYTES:
                self.known[p] = np.array(merge_one(self.byte_ids[np.frombuffer(p, np.uint8)].tolist(), self.merges), "<u4").tobytes()
                held += len(self.known[p])
            else:
                short.append(p)
        if short:
            ids, counts = merge_short(self.byte_ids[np.frombuffer(b"".join(short), np.uint8)], np.array([len(p) for p in short]), self.merges)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            self.known.update(zip(short, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        self.held += held + ENTRY_BYTES * len(pieces)

    def _values(self, pieces: list[bytes]) -> list[bytes]:
        if self.held > self.table_bytes:
            self.known, self.held = {}, 0
        self._learn([p for p in pieces if p not in self.known])
        return [self.known[p] for p in pieces]

    def apply(self, texts: pa.Array, lead: bytes = b"") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For ranges of documents: first, last, the ids, where each document's begin (one more than documents), the bytes, the same for these.

        ``lead`` (a byte) goes before each text that isn't empty.
        """
        offsets, data = buffers(texts)
        for i, j in steps(offsets, STEP):
            at, body = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            if lead:
                full = at[:-1] < at[1:]
                body = np.insert(body, at[:-1][full], lead[0])
                at = at + np.concatenate([[0], np.cumsum(full)])
            body = np.ascontiguousarray(body)
            points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), "<u4")
            heads = np.flatnonzero((body & 0xC0) != 0x80)
            first = np.searchsorted(heads, at[:-1][at[:-1] < at[1:]])
            starts = heads[token_starts(points, first, self.classes)] if len(points) else heads
            edges = np.append(starts, len(body)).astype(np.int64)
            slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(body)])
            coded = slices.dictionary_encode()
            taken = pa.array(self._values(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            _, ends, joined = taken.buffers()
            ends = np.frombuffer(ends, np.int64)[: len(taken) + 1] // 4 if len(taken) else np.zeros(1, np.int64)
            ids = np.frombuffer(joined, "<u4")[: ends[-1]] if len(taken) else np.zeros(0, "<u4")
            yield i, j, ids, ends[np.searchsorted(starts, at)], body, at


@functools.lru_cache(maxsize=2)
def from_ranks(path: str) -> Encoder:
    """The encoder of a file of base64 tokens with their ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    halves = ((t[:k], t[k:], i) for t, i in ranks.items() for k in range(1, len(t)))
    pairs = [(ranks[a], ranks[b], i, i) for a, b, i in halves if a in ranks and b in ranks]
    return Encoder(ranks, Merges(pairs), tiktoken_classes(), whole=True)


def byte_alphabet() -> dict[str, int]:
    """Byte by the character that stands for it in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def from_json(path: str) -> Encoder:
    """The encoder of a tokenizer file with a byte-level vocabulary and merges; special tokens are plain text."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
        raise ValueError("this tokenizer is not a plain byte-level one")
    spelled = lambda token: bytes(map(alphabet.__getitem__, token))
    ids = {spelled(t): i for t, i in model["vocab"].items() if t not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = [(ids[spelled(a)], ids[spelled(b)], k, ids[spelled(a + b)]) for k, (a, b) in enumerate(pairs)]
    return Encoder(ids, Merges(merges), tokenizers_classes(), whole=False)


@functools.cache
def _decimals(n: int) -> Strings:
    return Strings([b" %d" % i for i in range(n)])


def _each(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of each text, and where each id's bytes start in it."""
    for i, j, ids, first, _, at in encoder.apply(texts):
        starts = encoder.tokens.ends(ids) - encoder.tokens.lengths[ids]
        for k in range(j - i):
            yield ids[first[k] : first[k + 1]], starts[first[k] : first[k + 1]] - at[k]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` (array of int) and ``offsets`` (array of long: where each id's bytes start in the UTF-8 text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = from_ranks(path)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                rows = list(_each(encoder, b["text"].slice(part, 256)))
                ids = pa.array([x.astype(np.int32) for x, _ in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b["id"].slice(part, 256), ids, pa.array([x for _, x in rows], pa.list_(pa.int64()))], [id_col, "ids", "offsets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The id and ``decoded`` (binary) of rows with ``ids`` and ``offsets``: each id's bytes at its offset. Null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = from_ranks(path).tokens
        for b in batches:
            out = []
            for ids, offsets in zip(b["ids"], b["offsets"], strict=True):
                ids, offsets = np.array(ids.as_py() or [], np.int64), np.array(offsets.as_py() or [], np.int64)
                lengths = tokens.lengths[ids]
                text = np.zeros(int((offsets + lengths).max(initial=0)), np.uint8)
                text[np.repeat(offsets - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = tokens.join(ids)
                out.append(text.tobytes())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(f"`{id_col}`").alias("id"), "ids", "offsets").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; the decoded bytes are the ids' own, joined.

    Null and empty texts have no ids and decode to nothing; rows that repeat are encoded each; a null id stays null; an empty table
    gives an empty one; a very long text makes a step of its own; no other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = from_ranks(path)
        decimals = _decimals(len(encoder.tokens.lengths))
        for b in batches:
            counts, spelled, decoded = [], [], []
            for i, j, ids, first, _, _ in encoder.apply(b["text"]):
                said, numbers = encoder.tokens.join(ids), decimals.join(ids)
                said_at = np.concatenate([[0], encoder.tokens.ends(ids)])[first]
                numbers_at = np.concatenate([[0], decimals.ends(ids)])[first]
                counts += np.diff(first).tolist()
                for k in range(j - i):
                    spelled.append(hashlib.sha256(numbers[numbers_at[k] + 1 : numbers_at[k + 1]]).hexdigest())
                    decoded.append(hashlib.sha256(said[said_at[k] : said_at[k + 1]]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(counts, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
