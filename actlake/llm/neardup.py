"""Near-duplicate groups by MinHash and an LSH forest, every link confirmed on full shingle sets.

A document's set holds its distinct word shingles. Documents with equal sets are one class. Each class has a MinHash signature,
sorted in several orders (trees), each of which starts at another place of the signature. Classes whose signatures share a
prefix of four places in some order form a region.

First, each tree's regions are range-partitioned and sorted by their rotated signatures, so that a class stands beside those
with the longest common prefix, however deep the prefixes run where classes are dense. Of the ``NEIGHBOURS`` classes before it
the one with most equal places is its candidate: at most one pair for each class and tree. These are confirmed on the full sets
and make components.

Then every pair of a region, however large, that is in two components and could be a link is compared on the full sets. A
region's classes that have such a pair are sent there with their sets, a crowded region is dealt out as pairs of blocks, and a
task gives back only the edges of a spanning forest over the links that it finds. So no row is made for a pair, and
no candidate pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import Words, buffers, cut, fresh, mix, steps

TREES, STEP = 24, 4
SIGNATURE = TREES * STEP
#: Places of a signature that the classes of a region share, and those by which they are sorted.
DEPTH, ORDER = 4, 16
NEIGHBOURS = 8
#: Classes and shingles of a block; a crowded region is compared as pairs of blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Standard deviations below the wanted similarity at which the share of equal places rules a pair out: a chance under 1e-5.
MARGIN = 4.4
MARKS = 1 << 24
_FACTORS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
_A = (mix(np.arange(101, 101 + SIGNATURE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(901, 901 + SIGNATURE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words; a shorter text is one shingle, an empty one none."""
    offsets, data = buffers(texts)
    for i, j in steps(offsets):
        words = Words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        h = words.hashes
        n = len(h) - width + 1
        rolled = sum((h[k : n + k] * _FACTORS[k] for k in range(width)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
        rolled = mix(rolled + np.uint64(width))
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash of a set, ``SIGNATURE`` places of 32 bits."""
    low, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (low[i : i + 1024, None] * _A + _B).min(0), out=out)
    return out


def _measured(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, sig): size, digest and signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, sig = [], [], [], []
            for s in shingle_sets(b["text"], width):
                n.append(len(s))
                d1.append(s.sum(dtype=np.uint64))
                d2.append(mix(s).sum(dtype=np.uint64))
                sig.append(signature(s).tobytes() if len(s) else b"")
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (n, d1, d2)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *longs, pa.array(sig, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values are all ``width`` bytes long, as a matrix."""
    return buffers(column)[1].reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _signatures(column: pa.Array) -> np.ndarray:
    return _bytes(column, 4 * SIGNATURE).view(np.uint32)


def _sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest byte of each place."""
    return np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8))


def _prefix(sig: np.ndarray, tree: int) -> np.ndarray:
    """Hash of the first ``DEPTH`` places in a tree's order."""
    h = np.full(len(sig), tree + (DEPTH << 8), np.uint64)
    for k in range(DEPTH):
        h = mix(h) + sig[:, (tree * STEP + k) % SIGNATURE]
    return mix(h).view(np.int64)


def _regions(classes: DataFrame) -> DataFrame:
    """(region, tree, cid) of the classes that share their first places with another one in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b["sig"])
            for tree in range(TREES):
                marks = pa.array(np.full(len(sig), tree, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(_prefix(sig, tree)), marks, b["cid"]], ["region", "tree", "cid"])

    rows = classes.select("cid", "sig").mapInArrow(run, "region long, tree int, cid long")
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("region", _again())
    return rows.select("*", _again()).join(shared, ["region", "again"]).drop("again")


def _again() -> Column:
    """A second join key: with it both sides are dealt out anew, without which Spark could not split a hot region's rows."""
    return F.xxhash64("region").alias("again")


def _neighbours(members: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """Candidate pairs (a < b): each class of a region and the likeliest of the ``NEIGHBOURS`` before it in the region's order.

    Where a range of the order begins, the classes before it are out of sight; what that leaves out the second pass compares.
    """

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, tree = _signatures(b["sig"]), b["tree"].to_numpy()
            places = (tree[:, None] * STEP + np.arange(DEPTH, ORDER)) % SIGNATURE
            order = np.take_along_axis(sig, places, 1).astype(">u4")
            yield pa.RecordBatch.from_arrays([b["region"], _binary(order), b["cid"], b["n"], _binary(_sketch(sig))], ["region", "order", "cid", "n", "sketch"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = (*(b[c].to_numpy() for c in ("region", "cid", "n")), _bytes(b["sketch"], SIGNATURE))
            skip = 0 if held is None else len(held[0])
            region, cid, n, sketch = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
            best, most = np.full(len(cid), -1), np.full(len(cid), least - 1)
            for d in range(1, min(NEIGHBOURS, len(cid) - 1) + 1):
                equal = (sketch[d:] == sketch[:-d]).sum(1)
                near = (region[d:] == region[:-d]) & (equal > most[d:]) & (100 * np.minimum(n[d:], n[:-d]) >= percent * np.maximum(n[d:], n[:-d]))
                at = np.flatnonzero(near) + d
                best[at], most[at] = at - d, equal[at - d]
            x = np.flatnonzero(best >= 0)
            x = x[x >= skip]
            a, c = cid[best[x]], cid[x]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])
            held = tuple(v[-NEIGHBOURS:] for v in (region, cid, n, sketch))

    rows = members.join(classes.select("cid", "n", "sig"), "cid").select("region", "tree", "cid", "n", "sig")
    rows = rows.mapInArrow(ordered, "region long, order binary, cid long, n long, sketch binary")
    keys = ["region", "order", "cid"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pairs, "a long, b long").distinct()


def _tasks(members: DataFrame, labels: DataFrame, block_rows: int) -> DataFrame:
    """(task, side, tree, cid, comp): members of the regions that hold two components or more, once for each task they are in.

    A region of more than ``block_rows`` classes or ``BLOCK_SHINGLES`` shingles is crowded. The members in its largest component
    and the others are each cut into blocks; every pair of blocks is a task, but for those of two blocks of the largest
    component. ``side`` tells the blocks of a task apart; -1 is a block with itself.
    """
    rows = members.join(labels, "cid")
    sizes = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).groupBy("region")
    large = F.struct("size", "comp")
    sizes = sizes.agg(F.sum("size").alias("members"), F.max("size").alias("most"), F.sum("n").alias("n"), F.max_by("comp", large).alias("main"), F.max_by("n", large).alias("main_n"))
    blocks = lambda size, n: F.greatest(F.lit(1), F.ceil(size / block_rows), F.ceil(n / BLOCK_SHINGLES))
    sizes = sizes.where("most < members").select(
        "region",
        _again(),
        "main",
        (blocks(F.col("members"), F.col("n")) > 1).alias("crowded"),
        blocks(F.col("most"), F.col("main_n")).alias("main_blocks"),
        blocks(F.col("members") - F.col("most"), F.col("n") - F.col("main_n")).alias("other_blocks"),
    )
    dealt = rows.select("region", "tree", "cid", "comp", _again()).join(sizes, ["region", "again"])
    of, in_main = F.xxhash64("cid", "region"), F.col("comp") == F.col("main")
    block = F.when(in_main, F.col("other_blocks") + F.pmod(of, "main_blocks")).otherwise(F.pmod(of, "other_blocks"))
    last = F.when(in_main, F.col("other_blocks")).otherwise(F.col("other_blocks") + F.col("main_blocks")) - 1
    zero = F.lit(0).cast("long")
    one = F.array(F.struct(zero.alias("own"), zero.alias("other")))
    many = F.transform(F.sequence(zero, last), lambda k: F.struct(block.alias("own"), k.alias("other")))
    dealt = dealt.select("region", "tree", "cid", "comp", F.explode(F.when(F.col("crowded"), many).otherwise(one)).alias("at"))
    own, other = F.col("at.own"), F.col("at.other")
    side = F.when(own == other, -1).otherwise((own > other).cast("int"))
    return dealt.select(F.xxhash64("region", F.least(own, other), F.greatest(own, other)).alias("task"), side.alias("side"), "tree", "cid", "comp")


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, from batches in which a task's rows stand together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        task = b["task"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]]).tolist()
        for i, j in zip(cuts, cuts[1:]):
            if held and j > i and held[0]["task"][0].as_py() != task[i]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if j > i:
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Task:
    """The rows of one task, to ask which pairs of them could be links."""

    def __init__(self, rows: pa.Table, least: int, percent: int):
        self.side, self.tree, self.cid, self.n, self.comp = (rows[c].to_numpy() for c in ("side", "tree", "cid", "n", "comp"))
        self.sketch, self.own = _bytes(rows["sketch"], SIGNATURE), _bytes(rows["own"], 4 * TREES).view(np.uint32)
        self.least, self.percent = least, percent

    def after(self, i: int, comp: np.ndarray) -> np.ndarray:
        """Rows after the i-th that could be linked with it: of another component, of the other side, of a size that allows
        it, with places enough equal, and in no region together before this tree's."""
        n = self.n[i + 1 :]
        wanted = (comp[i + 1 :] != comp[i]) & ((self.side[i + 1 :] != self.side[i]) | (self.side[i] < 0))
        j = np.flatnonzero(wanted & (100 * np.minimum(n, self.n[i]) >= self.percent * np.maximum(n, self.n[i]))) + i + 1
        j = j[(self.sketch[j] == self.sketch[i]).sum(1) >= self.least]
        return j[(self.own[j] == self.own[i]).argmax(1) == self.tree[i]]


def _possible(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """The rows that could be linked with another row of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches):
            task, keep = _Task(rows, least, percent), np.zeros(rows.num_rows, bool)
            for i in range(rows.num_rows - 1):
                j = task.after(i, task.comp)
                keep[j] = True
                keep[i] |= len(j) > 0
            if keep.any():
                yield from rows.filter(pa.array(keep)).to_batches()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, rows.schema)


def _forest(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): links between rows of a task (with their ``shingles``), enough of them to connect all that its links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches):
            task, comp, found = _Task(rows, least, percent), rows["comp"].to_numpy().copy(), []
            offsets, data = buffers(rows["shingles"])
            first, every = offsets // 8, np.frombuffer(data, np.uint64)
            # the task's own numbers of the shingles, so that a class's set can be marked in a table
            names, every = np.unique(every, return_inverse=True)
            marked = np.zeros(len(names), bool)
            for i in range(rows.num_rows - 1):
                j = task.after(i, comp)
                if not len(j):
                    continue
                own = every[first[i] : first[i + 1]]
                marked[own] = True
                for j in np.array_split(j, 1 + int(task.n[j].sum()) // BLOCK_SHINGLES):
                    ends = np.cumsum(task.n[j])
                    if not len(j):
                        continue
                    flat = np.arange(ends[-1]) + np.repeat(first[j] - ends + task.n[j], task.n[j])
                    both = np.add.reduceat(marked[every[flat]], ends - task.n[j], dtype=np.int64)
                    for k in j[100 * both >= percent * (task.n[i] + task.n[j] - both)].tolist():
                        if comp[k] != comp[i]:
                            found.append((task.cid[i], task.cid[k]))
                            comp[comp == comp[k]] = comp[i]
                marked[own] = False
            if found:
                a, c = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, shingles) of the documents in ``wanted`` (cid), from one more pass over the texts.

    A table of ``MARKS`` bits, which the driver broadcasts, spares most other documents the work and the shuffle; it may let
    some of them through, and the join drops these.
    """
    place = F.pmod(F.xxhash64("cid"), F.lit(MARKS))
    marks = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits"))
    table = np.zeros(MARKS // 64, np.int64)
    for r in marks.toLocalIterator():
        table[r.word] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b["p"].to_numpy()
            b = b.filter(pa.array((shared.value[p >> 6] >> (p & 63)) & 1 == 1))
            sets = [s.tobytes() for s in shingle_sets(b["text"], width)]
            yield pa.RecordBatch.from_arrays([b["cid"], pa.array(sets, pa.binary())], ["cid", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").where("cid IS NOT NULL").withColumn("p", place)
    return rows.mapInArrow(run, "cid long, shingles binary").join(wanted, "cid", "left_semi").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of every pair: whether the shared shingles are ``percent`` of all or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    merged = np.sort(np.concatenate([x, y]), kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    x = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): the smallest id that links (a, b) reach from each id in them.

    Large-star and small-star rounds in turn (R. Kiveris and others, Connected components in MapReduce and beyond, SoCC 2014) until
    the links no longer change; a hub's links are aggregated before they are shuffled.
    """
    links = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return links.groupBy(F.col("u").alias("cid")).agg(F.min("v").alias("comp"))
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())


def group(docs: DataFrame, width: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null and empty texts and texts of white space have no shingle and are linked with nothing; equal texts are linked; of repeated
    rows with one id all are kept or none; a null id is linked with nothing (component_id null, kept); an empty table gives an
    empty one; other columns are not read. Sets are compared by 64-bit hashes of their shingles; sets count as equal by their
    size and two 64-bit sums.
    """
    seen = cut(_measured(docs, width))
    digest = ["n", "d1", "d2"]
    classes = cut(seen.where("n > 0 AND doc_id IS NOT NULL").groupBy(*digest).agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig")))
    share = percent / 100
    least = int(np.floor(SIGNATURE * (share - MARGIN * np.sqrt(share * (1 - share) / SIGNATURE))))
    members = cut(_regions(classes))
    first = cut(_neighbours(members, classes, least, percent))
    sets = cut(_full_sets(docs, first.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), width))
    linked = cut(_confirmed(first, sets, percent).where("linked").select("a", "b"))
    joined = components(linked)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b["sig"])
            # 32 bits of each tree's region tell whether two classes share it
            own = np.stack([_prefix(sig, t).view(np.uint64) >> np.uint64(32) for t in range(TREES)], 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b["cid"], b["n"], _binary(_sketch(sig)), _binary(own)], ["cid", "n", "sketch", "own"])

    labels = cut(classes.select("cid", "n").join(joined, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    tasks = cut(_tasks(members, labels, block_rows))
    sketches = classes.select("cid", "n", "sig").mapInArrow(sketched, "cid long, n long, sketch binary, own binary")
    rest = cut(_possible(tasks.join(sketches, "cid"), least, percent))
    # a class that was in no pair before has its set made now
    lacking = cut(rest.select("cid").distinct().join(sets.select("cid"), "cid", "left_anti"))
    if lacking.take(1):
        sets = sets.unionByName(cut(_full_sets(docs, lacking, width)))
    late = cut(_forest(rest.join(sets, "cid"), least, percent))
    stars = joined.where("cid != comp").select(F.col("comp").alias("a"), F.col("cid").alias("b"))
    final = components(stars.unionByName(late))
    labels = classes.select(*digest, "cid").join(final, "cid", "left").select(*digest, F.coalesce("comp", "cid").alias("comp"))
    out = seen.select("doc_id", *digest).join(labels, digest, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; the columns stay as they are.

    Rows with a null id and those without shingles stay.
    """
    own = fresh(docs, "gone_id")
    gone = group(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
