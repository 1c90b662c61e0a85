import numpy as np

from actlake.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, keys int")


def brute(x, ids, q, k=5):
    n = np.linalg.norm(x, axis=1)
    s = np.round((x @ x[q]) / (n * n[q]), 12)
    s[q] = -9
    return ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]].tolist()


def test_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[7]  # many copies of one vector
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    odd = [(5000, None, 1, 2), (5050, [0.0] * 16, 1, 2), (5100, [float("nan")] * 16, 1, 2), (5150, [1.0, 2.0], 1, 2), (5200, [None] * 16, 1, 2), rows[3]]
    found = ann.search(table(spark, rows + odd), lambda i: i % 50 == 0, block_rows=100).collect()
    by = {q: [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] for q in range(0, 1500, 50)}
    assert len(found) == 150 and {r.query_id for r in found} == set(by)
    wanted = {q: brute(x.astype(float), np.arange(1500), q) for q in by}
    assert by[150] == [7, 100, 101, 102, 103] and by[350] == wanted[350]
    assert sum(len(set(by[q]) & set(wanted[q])) for q in by) >= 0.9 * 150


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1, 1), (1, [0.0, 1.0], 1, 1), (2, [1.0, 1.0], 1, 1)]
    found = ann.search(table(spark, rows), lambda i: i % 50 == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(1, 2), (2, 1)]
    assert ann.search(table(spark, []), lambda i: i % 50 == 0).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(np.arange(8), np.arange(8), indexing="ij"), -1).reshape(-1, 2)
    keys = ann.hilbert_keys(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
