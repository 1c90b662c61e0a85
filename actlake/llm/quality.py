"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over one feature at a time, so that each feature ends as a lookup table over its bins; the
strongest pairs of features get small two-way tables the same way. A score is the sum of the entries of a document's bins.
Training uses all labelled rows: bins are cut at quantiles of all of them, tasks boost over parts of about ``PART_ROWS`` rows with these
bins, and the entries of the parts' tables are averaged, each part weighing as many rows as it has.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import LOWER, WHITE, Words, buffers, cut, steps, stored

#: Labelled rows that one task boosts over; more rows make more parts.
PART_ROWS = 1 << 14
#: Labelled ids up to which they are broadcast to the documents' tasks.
BROADCAST_IDS = 1 << 21
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_len", "upper", "digit", "punct", "symbol", "white", "non_ascii",
    "bang", "line_len", "repeated_lines", "repeated_words", "one_letter", "top_word", "ends_in_symbol", "long_words",
)
_SYMBOLS = b"#$%&*@^_|~<>{}[]\\/=+"


def _among(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = {
    "upper": _among(bytes(range(65, 91))),
    "digit": _among(b"0123456789"),
    "punct": _among(b".,;:?'\"()-"),
    "symbol": _among(_SYMBOLS),
    "white": WHITE,
    "non_ascii": _among(bytes(range(0xC0, 0x100))),
    "bang": _among(b"!"),
}


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text, from the whole of it; null and empty texts give zeros."""
    offsets, data = buffers(texts)
    parts = [_features(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]) for i, j in steps(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[edges])


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: how many of its keys are distinct, and how often its commonest occurs."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[at], np.diff(np.append(at, len(keys))))
    return np.bincount(owner[at], minlength=n), top


def _features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    words = Words(offsets, data)
    count, lengths = np.diff(words.first), words.end - words.start
    owner = np.repeat(np.arange(n), count)
    per, per_word = np.maximum(size, 1), np.maximum(count, 1)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(count), "word_len": np.bincount(owner, lengths, n) / per_word}
    out |= {k: _per_doc(table[data], offsets) / per for k, table in _CLASSES.items()}
    distinct, top = _repeats(words.hashes, owner, n)
    out |= {"repeated_words": 1 - distinct / per_word, "top_word": top / per_word}
    out["one_letter"] = np.bincount(owner, lengths == 1, n) / per_word
    out["long_words"] = np.bincount(owner, lengths > 24, n) / per_word
    last = words.data[words.end - 1] if len(words.end) else words.data
    out["ends_in_symbol"] = np.bincount(owner, _CLASSES["symbol"][last] | (last == 33), n) / per_word
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    starts, ends = ends[:-1], ends[1:]
    lines = np.searchsorted(offsets, starts, "right") - 1
    held = np.bincount(lines, minlength=n)[:n]
    out["line_len"] = np.log1p(size / np.maximum(held, 1))
    sums = np.concatenate([[0], np.cumsum(words.hashes, dtype=np.uint64)])
    at = np.searchsorted(words.start, np.concatenate([starts, ends[-1:]]))
    keys = sums[at[1:]] - sums[at[:-1]]
    full = at[1:] > at[:-1]
    kinds, _ = _repeats(keys[full], lines[full], n)
    out["repeated_lines"] = 1 - kinds / np.maximum(np.bincount(lines[full], minlength=n), 1)
    out["repeated_lines"][np.bincount(lines[full], minlength=n) == 0] = 0
    return np.column_stack([out[k] for k in FEATURES]).astype(float)


@dataclasses.dataclass(frozen=True)
class Model:
    """Bin edges and lookup tables: ``single[f][bin]`` and ``pairs[(f, g)][bin_f, bin_g]`` (coarser bins)."""

    base: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.single, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        rough = [np.searchsorted(edges, x[:, f], "right") for f, edges in enumerate(self.coarse)]
        for (f, g), table in self.pairs.items():
            total += table[rough[f], rough[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Inner quantiles of ascending values that occur so many times each."""
    if not len(values):
        return np.zeros(0)
    ends = np.cumsum(counts)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, k, "right")] for k in (np.floor(at), np.ceil(at)))
    return np.unique(low + (at - np.floor(at)) * (high - low))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """Best step function over the bins with at most 2 ** depth levels, by the usual second-order gain."""
    out = np.full(len(grad), grad.sum() / (hess.sum() + smooth))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gain = g**2 / (h + smooth) + (grad.sum() - g) ** 2 / (hess.sum() - h + smooth)
        gain[(h < 1e-3) | (hess.sum() - h < 1e-3)] = -1
        k = int(gain.argmax()) + 1
        if gain[k - 1] > grad.sum() ** 2 / (hess.sum() + smooth) + 1e-9:
            out[:k], out[k:] = _tree(grad[:k], hess[:k], depth - 1, smooth), _tree(grad[k:], hess[k:], depth - 1, smooth)
    return out


Cuts = tuple[list[np.ndarray], list[np.ndarray]]


def cuts_of(counted: list[tuple[np.ndarray, np.ndarray]], bins: int = 48, coarse: int = 8) -> Cuts:
    """Edges of the bins and of the coarser ones of pairs, from each feature's distinct values and their counts."""
    return [_edges(*c, bins) for c in counted], [_edges(*c, coarse) for c in counted]


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, n_pairs: int = 8, smooth: float = 2.0, cuts: Cuts | None = None
) -> Model:
    """Boost cyclically; without rows of both labels the score is the share of label 1 (0.5 without any row)."""
    width = x.shape[1]
    edges, coarse = cuts or cuts_of([np.unique(x[:, f], return_counts=True) for f in range(width)])
    single, pairs = [np.zeros(len(e) + 1) for e in edges], {}
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if 0 < y.sum() < len(y):
        at = [np.searchsorted(edges[f], x[:, f], "right") for f in range(width)]
        rough = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(width)]
        total = np.full(len(y), base)

        def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

        for _ in range(rounds):
            for f in range(width):
                step = rate * _tree(*sums(at[f], len(single[f])), 2, smooth)
                single[f] += step
                total += step[at[f]]
        cells = {}
        for f in range(width):
            for g in range(f):
                shape = len(coarse[f]) + 1, len(coarse[g]) + 1
                index = rough[f] * shape[1] + rough[g]
                grad, hess = sums(index, shape[0] * shape[1])
                cells[f, g] = (float((grad**2 / (hess + smooth)).sum()), shape, index)
        best = sorted(cells, key=lambda k: -cells[k][0])[:n_pairs]
        pairs = {k: np.zeros(cells[k][1]) for k in best}
        for _ in range(rounds // 3):
            for k in best:
                _, shape, index = cells[k]
                grad, hess = (v.reshape(shape) for v in sums(index, shape[0] * shape[1]))
                # a tree over the first feature whose leaves split once more over the second
                rows = _tree(grad.sum(1), hess.sum(1), 1, smooth)
                step = np.empty(shape)
                for level in np.unique(rows):
                    side = rows == level
                    step[side] = _tree(grad[side].sum(0), hess[side].sum(0), 1, smooth)
                pairs[k] += rate * step
                total += rate * step.ravel()[index]
    return Model(base, edges, single, coarse, pairs)


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """``(_id, _label, text)`` of all labelled documents that ``keep`` holds for: of an id with two labels the smaller; null ids and labels don't count.

    The ids with their labels are counted, and broadcast while they are few, so that no text is shuffled.
    """
    rows = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = cut(rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("_label")))
    texts = docs.where(keep & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "text")
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "_id")


def _rounded(x: np.ndarray) -> np.ndarray:
    """Values to 10 binary digits, so that a feature has few distinct ones however many rows there are."""
    part, power = np.frexp(x)
    return np.ldexp(np.round(part * 1024) / 1024, power)


def _counted(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each feature's distinct values over all rows, rounded and ascending, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rounded(np.array(b["x"].to_pylist()).reshape(-1, len(FEATURES)))
            for f in range(len(FEATURES)):
                value, n = np.unique(x[:, f], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), f, np.int32)), pa.array(value), pa.array(n)], ["f", "value", "n"])

    found = rows.select("x").mapInArrow(run, "f int, value double, n long").groupBy("f", "value").agg(F.sum("n").alias("n")).toPandas()
    found = found.sort_values(["f", "value"])
    return [(own["value"].to_numpy(), own["n"].to_numpy()) for own in (found[found["f"] == f] for f in range(len(FEATURES)))]


def _shapes(cuts: Cuts) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """Sizes of all tables that a model with these bins may have."""
    sizes = [len(e) + 1 for e in cuts[1]]
    return [len(e) + 1 for e in cuts[0]], {(f, g): (sizes[f], sizes[g]) for f in range(len(sizes)) for g in range(f)}


def _flat(m: Model, cuts: Cuts) -> np.ndarray:
    """The base and the entries of all tables, zero for pairs without one."""
    return np.concatenate([[m.base], *m.single, *(m.pairs[k].ravel() if k in m.pairs else np.zeros(a * b) for k, (a, b) in _shapes(cuts)[1].items())])


def _shaped(flat: np.ndarray, cuts: Cuts) -> Model:
    single, pairs = _shapes(cuts)
    parts = np.split(flat[1:], np.cumsum([*single, *(a * b for a, b in pairs.values())])[:-1])
    tables = {k: t.reshape(shape) for (k, shape), t in zip(pairs.items(), parts[len(single) :], strict=True) if t.any()}
    return Model(float(flat[0]), cuts[0], parts[: len(single)], cuts[1], tables)


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", part_rows: int = PART_ROWS) -> Model:
    """Fit on all labelled rows, part by part in tasks; the driver gets counts of rounded values and the averaged tables only.

    Rows with one id all count.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array(list(features(b["text"])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["_id"], b["_label"], x], ["_id", "_label", "x"])

    rows = stored(labelled(docs, labels, label, keep).mapInArrow(measured, "_id long, _label int, x array<double>"))
    n, cuts = rows.count(), cuts_of(_counted(rows))
    if not n:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))

    def boosted(part: pa.Table) -> pa.Table:
        part = part.sort_by("_id")
        x, y = np.array(part["x"].to_pylist()).reshape(-1, len(FEATURES)), part["_label"].to_numpy().astype(float)
        entries = _flat(fit(x, y, cuts=cuts), cuts) * (len(y) / n)
        cell = np.flatnonzero(entries)
        return pa.table({"cell": cell, "value": entries[cell]})

    parts = rows.groupBy(F.pmod(F.xxhash64("_id"), F.lit(-(-n // part_rows))).alias("part")).applyInArrow(boosted, "cell long, value double")
    # summed in order of size, so that runs agree to the last bit
    whole = parts.groupBy("cell").agg(F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, v: a + v).alias("value")).toPandas()
    flat = np.zeros(len(_flat(Model(0.0, cuts[0], [np.zeros(len(e) + 1) for e in cuts[0]], cuts[1], {}), cuts)))
    flat[whole["cell"].to_numpy()] = whole["value"].to_numpy()
    return _shaped(flat, cuts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; null text counts as empty, a null id stays null."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.scores(features(b["text"])))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; an empty table gives an empty one."""
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``threshold``, with all columns, judged row by row (ids need not be unique)."""
    schema, names = docs.schema, docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(features(b["text"])) >= threshold))

    return docs.mapInArrow(kept, schema).select(*[F.col(f"`{c}`") for c in names])
