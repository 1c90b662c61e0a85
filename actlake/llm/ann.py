"""Nearest neighbours by cosine over shifted space-filling curves.

Every vector is projected, shifted and given a Hilbert key, once for each of several curves with projections of their own. Keys
are cut into ranges of about ``block_rows`` vectors. A query is compared with the vectors in the ranges around its own key on
each curve; the best of all curves are merged and ranked by the exact measure. How many ranges to look at is fitted: a bounded
sample of queries is searched exhaustively, and the window is the least one that holds ``target`` of what it found.
Vectors with equal components are one entry of the index with its smallest ids, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import cut, mix

CURVES, PROJECTED, KEY_BITS = 4, 7, 8
BLOCK_ROWS, QUERY_ROWS, SAMPLE_QUERIES, TARGET = 16_384, 4096, 64, 0.97
LEAST_BLOCKS = 24


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (n x p, each below 2 ** bits) on the Hilbert curve through that grid.

    The transposed form of the index is made by bit operations on whole columns, as in J. Skilling, Programming the Hilbert
    curve (AIP Conference Proceedings 707, 2004), then its bits are interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """Hilbert keys of non-zero vectors, a column per curve; each curve has its own projection and shift."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    keys = []
    for c in range(CURVES):
        rng = np.random.default_rng([seed, c])
        spread = unit @ rng.normal(0, 1, (vectors.shape[1], PROJECTED))  # about standard normal, whatever the dimension
        even = 1 / (1 + np.exp(-1.702 * spread))
        keys.append(hilbert_keys(np.minimum(((even + rng.random(PROJECTED)) / 2 * 2**KEY_BITS).astype(np.int64), 2**KEY_BITS - 1), KEY_BITS))
    return np.stack(keys, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: finite, not zero, without null, of the commonest length (of equally common the shortest)."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def distinct_vectors(rows: DataFrame, n_ids: int) -> DataFrame:
    """(uid, ids, v): each distinct vector with its ``n_ids`` smallest ids, the smallest as uid.

    Ranks are limited within partitions before the shuffle, so a vector that a third of all rows share is no hot key.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_ids)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("uid"), "ids", "v")


def _keyed(index: DataFrame) -> DataFrame:
    """``index`` with ``keys``, the vector's key on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = curve_keys(_matrix(b["v"])) if b.num_rows else np.zeros((0, CURVES), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*b.schema.names, "keys"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(run, f"{kinds}, keys array<bigint>")


def _near(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows, exactly scored: (query row, vector row, score). Ties go to the smaller id."""
    norm_q, norm_v = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    rows, cols, scores = [], [], []
    for i in range(0, len(q), 256):
        near = (q[i : i + 256] / norm_q[i : i + 256, None]) @ (v / norm_v[:, None]).T
        # all that rounding could put among the best; ties reach as far as they reach
        edge = np.partition(near, -k, axis=1)[:, -k] if k < near.shape[1] else np.full(len(near), -2.0)
        r, c = np.nonzero(near >= edge[:, None] - 1e-12)
        exact = np.einsum("ij,ij->i", q[i + r], v[c]) / (norm_q[i + r] * norm_v[c])
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(i + r[place < k])
        cols.append(c[place < k])
        scores.append(exact[place < k])
    return (np.concatenate(x) for x in (rows, cols, scores))


def _bounds(index: DataFrame, blocks: int) -> list[np.ndarray]:
    """For each curve the keys that cut all vectors into ``blocks`` ranges of about equal size."""
    if blocks < 2:
        return [np.zeros(0, np.int64)] * CURVES
    shares = [i / blocks for i in range(1, blocks)]
    row = index.agg(*[F.percentile_approx(F.col("keys")[c], shares, 20 * blocks).alias(f"c{c}") for c in range(CURVES)]).first()
    return [np.array(row[c] or [], np.int64) for c in range(CURVES)]


def _blocks(keys: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, keys[:, c], "right") for c, b in enumerate(bounds)], 1)


def fit_window(index: DataFrame, queries: DataFrame, bounds: list[np.ndarray], k: int, sample: int, target: float) -> int:
    """Least number of ranges to each side that holds ``target`` of the sample's true neighbours on one curve or another.

    A query's own vector, one of the ``k`` best, is no neighbour. ``sample`` queries (those with the smallest hash of the id) are compared with all vectors, in one pass over these.
    """
    chosen = queries.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("uid", "v", "keys").collect()
    if not chosen:
        return 0
    q, own = np.array([r.v for r in chosen], float), _blocks(np.array([r["keys"] for r in chosen]), bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r, c, score = _near(q, _matrix(b["v"]), b["uid"].to_numpy(), k)
            away = np.abs(_blocks(np.array(b["keys"].to_pylist()), bounds)[c] - own[r]).min(1)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(b["uid"].to_numpy()[c]), pa.array(score), pa.array(away)], ["r", "uid", "score", "away"])

    found = index.select("uid", "v", "keys").mapInArrow(run, "r long, uid long, score double, away long")
    best = Window.partitionBy("r").orderBy(F.desc("score"), "uid")
    nearest = found.withColumn("_n", F.row_number().over(best)).where(f"_n <= {k}").select("r", "uid", "away").collect()
    away = [x.away for x in nearest if x.uid != chosen[x.r].uid]
    if not away:
        return 0
    return int(np.sort(away)[max(0, int(np.ceil(target * len(away))) - 1)])


def search(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    sample_queries: int = SAMPLE_QUERIES,
    target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``is_query`` (a function of the id column) holds for.

    Every row is indexed; a query's own row is not its neighbour, other rows with an equal vector are. Ties go to the smaller
    id; with fewer candidates than ``k`` all are given. Null, zero and non-finite vectors, null ids and vectors of another length
    than the commonest take no part; repeated rows count once; an empty table gives an empty result; other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    index = cut(_keyed(distinct_vectors(rows, k + 1)))
    n = index.count()
    blocks = max(1, min(n, max(LEAST_BLOCKS, -(-n // block_rows))))
    asked = cut(rows.where(is_query(F.col("vec_id"))).distinct().join(index.select("uid", "v"), "v").select("vec_id", "uid"))
    queries = index.select("uid", "v", "keys").join(asked.select("uid").distinct(), "uid", "left_semi")
    bounds = _bounds(index, blocks)
    window = fit_window(index, queries, bounds, k + 1, sample_queries, target)
    one = np.ones((CURVES, blocks), np.int64)

    def placed(df: DataFrame, reach: int, own: np.ndarray, other: np.ndarray, names: tuple[str, str]) -> DataFrame:
        """A row for each curve, each range within ``reach`` of the vector's own and each share of the other side there.

        ``own`` and ``other`` hold the number of shares of the two sides by curve and range; ``names`` are the shares' columns.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                at = _blocks(np.array(b["keys"].to_pylist()), bounds)
                salt = (mix(b["uid"].to_numpy().view(np.uint64)) >> np.uint64(1)).view(np.int64)
                for c in range(CURVES):
                    low, high = np.maximum(at[:, c] - reach, 0), np.minimum(at[:, c] + reach, blocks - 1)
                    row = np.repeat(np.arange(len(at)), high - low + 1)
                    block = low[row] + np.arange(len(row)) - np.searchsorted(row, row)
                    times = other[c, block]
                    share = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, block = np.repeat(row, times), np.repeat(block, times)
                    part = b.drop_columns(["keys"]).take(pa.array(row))
                    more = [pa.array(x) for x in (np.full(len(row), c), block, salt[row] % own[c, block], share)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "curve", "block", *names])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "keys")
        return df.mapInArrow(run, f"{kinds}, curve long, block long, {names[0]} long, {names[1]} long")

    def shares(df: DataFrame, reach: int, rows: int) -> np.ndarray:
        """Into how many shares of about ``rows`` each range is split, so that no crowded range is one task's work."""
        found = one.copy()
        for r in placed(df.select("uid", "keys"), reach, one, one, ("own", "other")).groupBy("curve", "block").count().collect():
            found[r.curve, r.block] = -(-r["count"] // rows)
        return found

    index_rows = index.select("uid", "v", "keys")
    chunks, parts = shares(queries, window, QUERY_ROWS), shares(index_rows, 0, 2 * block_rows)
    here, there = placed(queries, window, chunks, parts, ("chunk", "part")), placed(index_rows, 0, parts, chunks, ("part", "chunk"))

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"quid": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = v["uid"].to_numpy()
        r, c, score = _near(_matrix(q["v"]), _matrix(v["v"]), ids, k + 1)
        return pa.table({"quid": q["uid"].to_numpy()[r], "uid": ids[c], "score": score})

    keys = ["curve", "block", "chunk", "part"]
    found = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(compare, "quid long, uid long, score double")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "uid")
    merged = found.groupBy("quid", "uid").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(best)).where(f"_n <= {k + 1}")
    ids = merged.join(index.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("vec_id"))
    # of one query vector's candidates only the first k + 1 can be a result of any query with it
    first = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("_n", F.row_number().over(first)).where(f"_n <= {k + 1}").drop("_n")
    pairs = asked.select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id")).join(ids, "quid").where("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
