import itertools
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from actlake.llm import exact_dedup, neardup, queries


def test_copies_differ_by_white_space_only(docs):
    rows = docs([(9, "a  b"), (3, "a\t\nb"), (5, "a b "), (4, None), (2, ""), (7, "A b")]).repartition(5)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.group_copies(rows).collect()}
    assert found == {9: (3, 2, False), 3: (3, 2, True), 5: (5, 1, True), 4: (2, 2, False), 2: (2, 2, True), 7: (7, 1, True)}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(rows).collect()) == [2, 3, 5, 7]


def test_many_runs_meet_in_rounds(docs):
    rows = docs([(i, f"t{i % 7}") for i in range(400)]).repartition(40)
    found = exact_dedup.group_copies(rows, fan_in_bits=1).collect()
    assert len(found) == 400 and all(r.keep_id == r.doc_id % 7 and r.group_size == 58 - (r.doc_id % 7 >= 1) for r in found)


def test_odd_rows(odd, docs):
    found = exact_dedup.group_copies(odd).collect()
    assert len(found) == odd.count() and {r.keep_id for r in found if r.doc_id in (1, 2)} == {1} and {r.keep_id for r in found if r.doc_id == 6} == {6}
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "7", "None"]
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_one_row_of_each_text_stays_whatever_the_ids(docs):
    rows = docs([(3, "a"), (5, "a"), (5, "b x"), (5, "b  x"), (5, "b x"), (8, "b\tx"), (None, "a"), (None, "c"), (None, "c"), (9, "d"), (9, "d")]).repartition(4)
    kept = exact_dedup.drop_copies(rows)
    assert sorted((str(r.doc_id), " ".join(r.text.split())) for r in kept.collect()) == [("3", "a"), ("5", "b x"), ("9", "d"), ("None", "c")]
    assert kept.columns == rows.columns


def brute(rows, width, percent=80):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def exact_components(rows, width, percent=80):
    """As ``brute``, by one matrix of all shared shingles."""
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (t.lower().split() for _, t in rows)]
    place = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    marks = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        marks[i, [place[x] for x in s]] = 1
    n, both = marks.sum(1), marks @ marks.T
    linked = 100 * both >= percent * (n[:, None] + n[None] - both)
    comp = np.arange(len(sets))
    while True:
        least = np.where(linked, comp[None], len(sets)).min(1)
        if (least == comp).all():
            return {i: (len(s), rows[c][0]) for (i, _), s, c in zip(rows, sets, comp.tolist(), strict=True)}
        comp = least


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


def test_groups_equal_brute_force(docs):
    rng = random.Random(3)
    rows, bases = [], [[f"v{rng.randrange(900)}" for _ in range(n)] for n in (12, 40, 120, 300, 9)]
    for base in bases:
        rows += [(len(rows) + i, edited(base, rng.randrange(0, max(2, len(base) // 25)), rng)) for i in range(45)]
    rows += [(1000, "a b c"), (1001, "A b  c"), (1002, "a b"), (1003, ""), (1004, None)]
    for width, block_rows in ((5, 1024), (4, 16)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(docs(rows), width, 80, block_rows).collect()}
        assert found == brute(rows, width)


def test_crowded_regions_equal_brute_force(docs):
    rng, rows = random.Random(11), []
    for start in range(3):
        words = [f"c{start}_{k}" for k in range(80)]
        for _ in range(70):  # each is linked with few others only
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(80)] = f"w{rng.random()}"
            words[rng.randrange(80)] = f"w{rng.random()}"
    wanted = {i: c for i, (_, c) in brute(rows, 3).items()}
    rng.shuffle(rows)
    # nearly every region is crowded, so that pairs of blocks are compared
    found = {r.doc_id: r.component_id for r in neardup.group(docs(rows), 3, 80, 2).collect()}
    assert found == wanted and len(set(wanted.values())) > 1


def test_blocks_of_a_crowded_region_meet_but_for_its_largest_component(spark):
    members = spark.createDataFrame([(1, 0, k) for k in range(15)], "region long, tree int, cid long")
    labels = spark.createDataFrame([(k, 30, 0 if k < 9 else k) for k in range(15)], "cid long, n long, comp long")
    tasks, met = {}, set()
    for r in neardup._tasks(members, labels, 2).collect():
        tasks.setdefault(r.task, []).append(r)
    for task in tasks.values():
        met |= {frozenset((x.cid, y.cid)) for x, y in itertools.combinations(task, 2) if x.side != y.side or x.side < 0}
    assert met >= {frozenset(p) for p in itertools.combinations(range(15), 2) if p[1] >= 9}
    assert not {frozenset(p) for p in itertools.combinations(range(9), 2)} & met
    assert neardup._tasks(members, labels.withColumn("comp", F.lit(0)), 2).count() == 0


def test_a_dense_group_equals_brute_force(docs):
    # 2,000 near copies of one text, many of them near the bound with each other but linked with few
    rng = random.Random(17)
    base = [f"d{k}" for k in range(60)]
    rows = [(i, edited(base, rng.randrange(1, 4), rng)) for i in range(2000)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(docs(rows), 4).collect()}
    wanted = exact_components(rows, 4)
    assert found == wanted and 1 < len({c for _, c in wanted.values()}) < 2000


def test_a_hub_joins_its_spokes(docs):
    rng = random.Random(5)
    hub = [f"h{i}" for i in range(200)]
    # each spoke is near enough to the hub, but not to the others
    rows = [(50, " ".join(hub))] + [(i, edited(hub, 4, rng)) for i in range(40)]
    found = {r.doc_id: r.component_id for r in neardup.group(docs(rows), 4).collect()}
    assert found == {i: c for i, (_, c) in brute(rows, 4).items()} and set(found.values()) == {0}


def test_near_copies_of_odd_rows(odd, docs):
    found = neardup.group(odd, 5).collect()
    assert len(found) == odd.count() and {r.component_id for r in found if r.doc_id in (4, 5)} == {4} and all(r.kept for r in found if r.doc_id != 5)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert neardup.group(docs([])).count() == 0


def test_registered_queries_equal_their_sql(spark, docs, tmp_path):
    rng, words = random.Random(23), [f"S{k % 40}é" for k in range(60)]
    rows = [(i, edited(words, rng.randrange(4), rng)) for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, "A b"), (54, "a\tB"), (55, "Ä b")]
    path = str(tmp_path / "documents.parquet")
    docs(rows).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for name, text in queries.oracle_sql().items():
        found = queries.queries()[name](spark, str(tmp_path))
        wanted = duck.execute(text)
        columns = [c[0] for c in wanted.description]
        assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(wanted.fetchall()) and sorted(columns) == sorted(found.columns)
