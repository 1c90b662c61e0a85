"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three table rows: two hashes of the word and one of its first five bytes, so that inflected
forms share a part. Filters of widths 1 to 3 slide over the whole text, each is pooled to its maximum, and a logistic layer
weighs the maxima. Training uses all labelled rows: three in four are dealt to parts of about ``PART_BYTES`` of text, tasks learn on
these from a common start, and their parameters are averaged, as often as ``EPOCHS`` has numbers (H. B. McMahan and others,
Communication-efficient learning of deep networks from decentralized data, AISTATS 2017). The other rows set one threshold per
language, where the language is read off the text itself by its commonest function words, and the score is shifted so that the
threshold is 0.7.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import Words, cut, words_of
from actlake.llm.quality import labelled

#: Bytes of the texts that one task learns on; epochs before each averaging of the parts, and those where there is one part.
PART_BYTES, EPOCHS, ALONE = 1 << 25, (2, 2, 2), 10
#: Words of a step of learning, which a longer text has to itself; rows of the table that are averaged together.
STEP_WORDS, BLOCK = 1 << 18, 1 << 10
THRESHOLD = 0.7
WIDTHS, FILTERS, DIM, BITS, PREFIX = (1, 2, 3), 12, 16, 16, 5
_PAD = np.zeros((max(WIDTHS) - 1, DIM), np.float32)

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "de": "der die das und den ist im von mit auf zu des dem ein eine",
    "en": "the of and to is that for with as was on are by this",
    "es": "el los las que y del por con una para su al lo",
    "fr": "le les des et du est dans une pour qui sur au pas",
}


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(np.array([0, len(data)]), data).hashes


_KNOWN = np.concatenate([_hashes(w) for w in FUNCTION_WORDS.values()])
_OF = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(w.split()) for w in FUNCTION_WORDS.values()])
_ORDER = np.argsort(_KNOWN)


def languages(words: Words) -> np.ndarray:
    """Index into ``FUNCTION_WORDS`` per document: the language with most function words; the last plus one without any."""
    n = len(words.first) - 1
    at = np.minimum(np.searchsorted(_KNOWN[_ORDER], words.hashes), len(_ORDER) - 1)
    hit = _KNOWN[_ORDER][at] == words.hashes
    owner = np.repeat(np.arange(n), np.diff(words.first))[hit]
    counts = np.bincount(owner * len(FUNCTION_WORDS) + _OF[_ORDER][at[hit]], minlength=n * len(FUNCTION_WORDS)).reshape(n, -1)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(FUNCTION_WORDS))


def rows_of(words: Words) -> np.ndarray:
    """Three table rows of each word."""
    part = 1 << BITS
    return np.stack(
        [
            (words.hashes & np.uint64(part - 1)).astype(np.int32),
            ((words.hashes >> np.uint64(32)) & np.uint64(part - 1)).astype(np.int32) + part,
            (words.prefix_hashes(PREFIX) & np.uint64(part - 1)).astype(np.int32) + 2 * part,
        ],
        1,
    )


@dataclasses.dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width * DIM, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    base: float
    shifts: np.ndarray  # logit at the threshold, by language

    def pooled(self, rows: np.ndarray, first: np.ndarray, argmax: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Maxima of all filters per document (at least 0), where they are, and the padded embeddings.

        Each document is followed by empty words, so that no window reaches into the next one.
        """
        n, pad = len(first) - 1, len(_PAD)
        at = first[:-1] + pad * np.arange(n)
        x = np.zeros((len(rows) + pad * n, DIM), np.float32)
        place = np.arange(len(rows)) + pad * np.repeat(np.arange(n), np.diff(first))
        x[place] = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        out, where = [], []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            z = x[: len(x) - pad] @ w[:DIM] if len(x) > pad else np.zeros((0, FILTERS), np.float32)
            for k in range(1, width):
                z += x[k : len(x) - pad + k] @ w[k * DIM : (k + 1) * DIM]
            z = np.concatenate([z, np.zeros((pad, FILTERS), np.float32)])
            out.append(np.maximum.reduceat(z, at, axis=0) if n else np.zeros((0, FILTERS), np.float32))
            if argmax:
                ends = np.append(at[1:], len(z))
                where.append(np.stack([a + z[a:b].argmax(0) for a, b in zip(at, ends, strict=True)]))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0), np.concatenate(where, 1) if argmax else None, x

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(rows_of(words), words.first)[0] @ self.weights + self.base

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each whole text; null and empty ones get that of a text without words."""
        parts = [self.logits(w) - self.shifts[languages(w)] for _, _, w in words_of(texts, 1 << 19)]
        raw = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw.astype(float) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


@dataclasses.dataclass
class Learner:
    """A model with Adagrad's sums of squares, shaped as its parameters (a table row has one sum)."""

    model: Model
    sums: Model

    def dense(self) -> np.ndarray:
        """All but the table, in one row."""
        return np.concatenate([np.ravel(v) for m in (self.model, self.sums) for v in (*m.filters, m.bias, m.weights, m.base)]).astype(np.float64)

    def set_dense(self, flat: np.ndarray) -> None:
        for m in (self.model, self.sums):
            for v in (*m.filters, m.bias, m.weights):
                v[...] = flat[: v.size].reshape(v.shape)
                flat = flat[v.size :]
            m.base, flat = float(flat[0]), flat[1:]


def start(rng: np.random.Generator) -> Learner:
    """Tables start at small random values, so that the maximum over a text does not always stand at its first word."""
    n_filters = FILTERS * len(WIDTHS)
    m = Model(
        rng.normal(0, 0.05, (3 << BITS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(n_filters, 0.01, np.float32),
        (rng.normal(0, 0.3, n_filters)).astype(np.float32),
        0.0,
        np.zeros(len(FUNCTION_WORDS) + 1),
    )
    few = lambda shape: np.full(shape, 1e-3, np.float32)
    return Learner(m, Model(few(3 << BITS), [few(f.shape) for f in m.filters], few(n_filters).astype(float), few(n_filters).astype(float), 1e-3, m.shifts))


def prior(m: Model, positive: float, n: float) -> Model:
    """The model without rows of both labels: the share of label 1 for every text."""
    m.weights[:] = 0
    m.base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    return m


def _batches(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """``order`` in steps of ``batch`` rows, or of fewer where these have more than ``STEP_WORDS`` words."""
    i = 0
    while i < len(order):
        j = min(i + batch, len(order))
        while j > i + 1 and sizes[order[i:j]].sum() > STEP_WORDS:
            j = (i + j) // 2
        yield order[i:j]
        i = j


def learn(learner: Learner, rows: list[np.ndarray], y: np.ndarray, share: float, epochs: int, rng: np.random.Generator, batch: int = 32, rate: float = 0.1) -> None:
    """Adagrad on the logistic loss with both labels weighing the same, of which label 1 has this share in all rows."""
    m, s = learner.model, learner.sums
    weigh, sizes = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), np.array([len(r) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for ids in _batches(order, sizes, batch):
            own = [rows[k] for k in ids]
            first = np.concatenate([[0], np.cumsum([len(r) for r in own])])
            flat = np.concatenate(own)
            pooled, where, x = m.pooled(flat, first, argmax=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.weights + m.base, -30, 30)))
            d = ((p - y[ids]) * weigh[ids] / len(ids)).astype(np.float32)
            back = d[:, None] * m.weights * (pooled > 0)
            g = pooled.T @ d + 1e-5 * m.weights
            s.weights += g**2
            gb = back.sum(0)
            s.bias += gb**2
            s.base += float(d.sum()) ** 2
            gx = {}
            for k, (width, w) in enumerate(zip(WIDTHS, m.filters, strict=True)):
                at, b = where[:, k * FILTERS : (k + 1) * FILTERS], back[:, k * FILTERS : (k + 1) * FILTERS]
                gw = np.zeros_like(w)
                for j in range(width):
                    part = slice(j * DIM, (j + 1) * DIM)
                    gw[part] = np.einsum("dfe,df->ef", x[np.minimum(at + j, len(x) - 1)], b)
                    gx[k, j] = (at + j, b[:, :, None] * w[part].T[None])
                s.filters[k] += gw**2
                m.filters[k] = w - rate * gw / np.sqrt(s.filters[k])
            m.weights -= (rate * g / np.sqrt(s.weights)).astype(np.float32)
            m.bias -= (rate * gb / np.sqrt(s.bias)).astype(np.float32)
            m.base -= rate * float(d.sum()) / np.sqrt(s.base)
            pad = len(_PAD)
            place = np.full(len(x), -1)
            place[np.arange(len(flat)) + pad * np.repeat(np.arange(len(own)), np.diff(first))] = np.arange(len(flat))
            at = np.concatenate([a.ravel() for a, _ in gx.values()])
            grads = np.concatenate([v.reshape(-1, DIM) for _, v in gx.values()])
            word = np.where(at < len(x), place[np.minimum(at, len(x) - 1)], -1)
            real = (word >= 0) & (np.abs(grads).sum(1) > 0)
            for c in range(3):
                hit, back_to = np.unique(flat[word[real], c], return_inverse=True)
                total = np.zeros((len(hit), DIM), np.float32)
                np.add.at(total, back_to, grads[real])
                s.table[hit] += (total**2).mean(1)
                m.table[hit] -= rate * total / np.sqrt(s.table[hit])[:, None]


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = ALONE, seed: int = 7) -> Model:
    """A model of rows that are at hand."""
    rng = np.random.default_rng(seed)
    learner = start(rng)
    if not 0 < y.sum() < len(y):
        return prior(learner.model, y.sum(), len(y))
    learn(learner, rows, y, y.mean(), epochs, rng)
    return learner.model


def calibrate(m: Model, logits: np.ndarray, y: np.ndarray, lang: np.ndarray, n: np.ndarray, least: int = 8) -> None:
    """Set the logit at the threshold per language: where the two labels' errors, each as a share of its label, are fewest.

    ``n``: how many rows each entry stands for. Of equally good places the middle of the widest gap is taken. Languages with fewer than ``least`` rows of either label get
    the place that is best over all rows. Without rows of both labels the score is the model's plain probability.
    """

    def best(own: np.ndarray) -> float:
        order = np.flatnonzero(own)[np.argsort(logits[own], kind="stable")]
        z, one, zero = logits[order], (y * n)[order], ((1 - y) * n)[order]
        wrong = np.concatenate([[0], np.cumsum(one)]) / max(one.sum(), 1) + np.concatenate([np.cumsum(zero[::-1])[::-1], [0]]) / max(zero.sum(), 1)
        edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        near = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        k = near[np.argmax(edges[near + 1] - edges[near])]
        return float((edges[k] + edges[k + 1]) / 2)

    both = 0 < y.sum() < len(y)
    m.shifts[:] = best(np.ones(len(y), bool)) if both else np.log(THRESHOLD / (1 - THRESHOLD))
    for k in range(len(m.shifts)):
        own = lang == k
        if min((y * n)[own].sum(), ((1 - y) * n)[own].sum()) >= least:
            m.shifts[k] = best(own)


_PARTS_OF_TABLE = np.arange(3, dtype=np.int32) << BITS


def _rows(packed: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(r.as_buffer(), np.uint16).reshape(-1, 3) + _PARTS_OF_TABLE for r in packed]


def _averaged(rows: DataFrame, learner: Learner, share: float, epochs: int, parts: int, rng: np.random.Generator) -> Learner:
    """What the tasks learn on their partitions of ``rows`` from ``learner``, averaged by the parts' numbers of rows; a row of the table by the parts that change it."""
    shared = rows.sparkSession.sparkContext.broadcast(learner)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        part = pa.Table.from_batches(held).sort_by("_id").combine_chunks()
        own = Learner(*(dataclasses.replace(m, table=m.table.copy(), filters=[f.copy() for f in m.filters], bias=m.bias.copy(), weights=m.weights.copy()) for m in (shared.value.model, shared.value.sums)))
        number = TaskContext.get().partitionId()
        learn(own, _rows(part["rows"].combine_chunks()), part["_label"].to_numpy().astype(float), share, epochs, np.random.default_rng([number, *rng.integers(1 << 30, size=2)]) if parts > 1 else rng)
        at = np.flatnonzero(own.sums.table != shared.value.sums.table)
        values = np.concatenate([own.model.table[at], own.sums.table[at, None]], 1)
        ends = np.searchsorted(at, np.arange(0, (3 << BITS) + 1, BLOCK))
        out = [(-1, np.zeros(1, np.int32), own.dense()), *((k, at[i:j] - k * BLOCK, values[i:j]) for k, (i, j) in enumerate(zip(ends, ends[1:])) if j > i)]
        block, places, made = zip(*((k, p.astype(np.int32).tobytes(), v.astype(np.float64 if k < 0 else np.float32).tobytes()) for k, p, v in out))
        yield from pa.table({"block": pa.array(block, pa.int32()), "part": pa.array([number] * len(out), pa.int64()), "n": pa.array([part.num_rows] * len(out), pa.int64()), "places": pa.array(places, pa.binary()), "made": pa.array(made, pa.binary())}).to_batches()

    def mean(block: pa.Table) -> pa.Table:
        block = block.sort_by("part")
        kind = np.float64 if block["block"][0].as_py() < 0 else np.float32
        total, weight = None, np.zeros(BLOCK)
        for n, places, made in zip(block["n"].to_pylist(), block["places"].to_pylist(), block["made"].to_pylist(), strict=True):
            at = np.frombuffer(places, np.int32)
            values = np.frombuffer(made, kind).reshape(len(at), -1)
            total = np.zeros((BLOCK, values.shape[1])) if total is None else total
            total[at] += n * values.astype(float)
            weight[at] += n
        at = np.flatnonzero(weight)
        made = (total[at] / weight[at, None]).astype(kind)
        return pa.table({"block": block["block"].slice(0, 1), "places": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "made": pa.array([made.tobytes()], pa.binary())})

    changes = rows.select("_id", "_label", "rows").mapInArrow(learnt, "block int, part long, n long, places binary, made binary")
    for r in changes.groupBy("block").applyInArrow(mean, "block int, places binary, made binary").toLocalIterator():
        at = np.frombuffer(r.places, np.int32)
        if r.block < 0:
            learner.set_dense(np.frombuffer(r.made, np.float64))
        else:
            values = np.frombuffer(r.made, np.float32).reshape(len(at), -1)
            learner.model.table[at + r.block * BLOCK], learner.sums.table[at + r.block * BLOCK] = values[:, :-1], values[:, -1]
    return learner


def _fit_all(rows: DataFrame, parts: int) -> Model:
    """``fit`` on all of ``rows`` (_id, _label, rows), whose partitions are the parts."""
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    rng = np.random.default_rng(7)
    learner = start(rng)
    if not 0 < positive < n:
        return prior(learner.model, positive, n)
    for epochs in EPOCHS if parts > 1 else (ALONE,):
        learner = _averaged(rows, learner, positive / n, epochs, parts, rng)
        rng.random()
    return learner.model


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", max_words: int | None = None, part_bytes: int = PART_BYTES) -> Model:
    """Fit on all labelled rows, of which every fourth is kept for the thresholds; the driver gets the averaged parameters and counts of logits.

    Null texts count as empty ones, rows with one id all count, other columns are not read; without labelled rows every text scores
    0.5. A caller that wants a quick model may set ``max_words``: texts are then taken in the order of their ids' hashes while they
    together have no more words, those with more than a 64th of them left out; no query does.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lang = [], []
            for _, _, w in words_of(b["text"]):
                r = (rows_of(w) - _PARTS_OF_TABLE).astype(np.uint16)
                rows += [r[a:z].tobytes() for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
                lang += languages(w).tolist()
            yield pa.RecordBatch.from_arrays([b["_id"], b["_label"], pa.array(lang, pa.int32()), pa.array(rows, pa.binary())], ["_id", "_label", "lang", "rows"])

    texts = labelled(docs, labels, label, keep)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found, parts = texts.mapInArrow(coded, "_id long, _label int, lang int, rows binary"), max(1, -(-size // part_bytes))
    if max_words is not None:
        words, upto = F.expr("length(rows) div 6"), F.sum("words").over(Window.orderBy(F.xxhash64("_id"), "_id"))
        found = found.withColumn("words", words).where(F.col("words") * 64 <= max_words).withColumn("upto", upto).where(F.col("upto") <= max_words).drop("upto", "words")
    # dealt once; every round reads the same partitions
    found = cut(found.repartition(parts))
    aside = F.pmod(F.xxhash64("_id", F.lit("aside")), F.lit(4)) == 3
    m = _fit_all(found.where(~aside), parts)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [shared.value.pooled(r, np.array([0, len(r)]))[0][0] @ shared.value.weights + shared.value.base for r in _rows(b["rows"])]
            # to a 1024th, so that there are few distinct ones however many rows there are
            yield pa.RecordBatch.from_arrays([b["_label"], b["lang"], pa.array(np.round(np.clip(np.array(z, float), -60, 60) * 1024) / 1024)], ["_label", "lang", "z"])

    counts = found.where(aside).select("_label", "lang", "rows").mapInArrow(measured, "_label int, lang int, z double").groupBy("_label", "lang", "z").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = counts.sort_values(["lang", "z", "_label"])
    calibrate(m, counts["z"].to_numpy(float), counts["_label"].to_numpy(float), counts["lang"].to_numpy(), counts["n"].to_numpy(float))
    return m


def classify(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null text counts as empty, a null id stays null (held_out null), repeated rows score alike, an empty table gives an empty one;
    no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: 3 * 2 ** BITS rows of DIM floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(shared.value.scores(b["text"]))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
