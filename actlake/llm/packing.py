"""Packing of tokenised documents into sequences of bounded length by the sum-of-squares rule.

Documents are tokenised by a table of distinct chunks and cut into pieces of at most ``size`` tokens. Pieces are dealt by a hash
into shards of about ``shard_rows``; a shard takes its pieces longest first and puts each where the sum, over all residual
gaps, of the squared number of open sequences with that gap becomes smallest. Only lengths and places are kept while packing.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.chunks import Table, at_words, lower_ascii
from actlake.llm.common import cut

SIZE = 4096
END_ID = 1
#: Pieces that one shard packs. More of them waste less space; fewer spread better.
SHARD_ROWS = 16_384


@functools.lru_cache(maxsize=2)
def _table(path: str) -> Table:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    last = np.zeros(model.get_vocab_size() + 1, bool)
    last[[i for t, i in model.get_vocab().items() if t.endswith("</w>")]] = True

    def one_by_one(texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def together(texts: list[str]) -> list[bytes]:
        """Words of letters only, many to a call: each ends with its own end-of-word token, which is checked by counting."""
        ids = np.array(model.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(texts) or ends[-1] != len(ids):
            return one_by_one(texts)
        starts = np.concatenate([[0], ends[:-1]])
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def work(chunks: list[bytes]) -> list[list[bytes]]:
        out: list[bytes] = [b""] * len(chunks)
        texts = [c.decode() for c in chunks]
        words = [k for k, t in enumerate(texts) if t.strip(" \n").isalpha()]
        for i in range(0, len(words), 128):
            group = words[i : i + 128]
            for k, x in zip(group, together([texts[k].strip(" \n") for k in group]), strict=True):
                out[k] = x
        chosen = set(words)
        rest = [k for k in range(len(texts)) if k not in chosen]
        for k, x in zip(rest, one_by_one([texts[k] for k in rest]), strict=True):
            out[k] = x
        return [out]

    return Table(work, at_words, lower_ascii)


def token_ids(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Little-endian ids of each text, without the end id."""
    for i, j, outputs in _table(path).apply(texts):
        for k in range(j - i):
            yield bytes(outputs[0][1][outputs[0][0][k] : outputs[0][0][k + 1]]) if outputs else b""


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut after every ``size`` ids.

    Null and empty texts have the end id only, so every input row has a piece; rows that repeat are cut each.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for row, ids in enumerate(token_ids(b["text"], path)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            row, piece, start, length, crc = (np.array(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, int)] * 5
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece, longest first; of equal sums the smallest gap left wins.

    A new sequence opens only when no open one has room: opening one wherever that makes the sum smaller used up to 4 % more
    sequences on uniform lengths.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, stacks = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        # moving a sequence from gap g to g - n changes the sum by 2 (open[g - n] - open[g]) + 2; gap 0 doesn't count
        change = 2 * (open_[: size + 1 - n] - open_[n:]) + 2
        change[0] = 1 - 2 * open_[n]
        change[open_[n:] == 0] = np.iinfo(np.int64).max
        left = int(change.argmin())
        if open_[left + n]:
            s = stacks[left + n].pop()
            open_[left + n] -= 1
            offset[i] = size - left - n
        else:
            s, left = made, size - n
            made += 1
        where[i] = s
        if left:
            open_[left] += 1
            stacks[left].append(s)
    return where, offset


def pack(parts: DataFrame, size: int = SIZE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; every row of ``parts`` is placed once. An empty table gives an empty one."""
    parts = cut(parts)
    shards = max(1, -(-parts.count() // shard_rows))

    def place(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
        where, offset = sum_of_squares(shard["length"].to_numpy(), size)
        sequence = where * shards + shard["_shard"][0].as_py()
        return shard.drop_columns("_shard").append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # the hash takes in every column, as ids may repeat
    dealt = parts.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; a very long text is cut into as many pieces as it needs; rows that repeat are
    packed each; a null id stays null and changes no other; pieces of equal length go in the order of id, piece and digest; an empty
    table gives an empty one; other columns are not read.
    """
    return pack(pieces(docs, path, size), size, shard_rows)
