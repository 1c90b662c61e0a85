"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary continues past a white-space marker that follows another character (checked when the model loads), so
merges on the two sides of such a place don't depend on each other, and each distinct marked word needs to be segmented only
once. A task keeps the table for the texts it reads: joining word occurrences to a table of the whole corpus would shuffle
many times the input. The ids of a text are its chunks' ids joined by position.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.chunks import Table, at_spaces

END_ID = 2
_SPACE = "▁"


@functools.lru_cache(maxsize=2)
def _table(path: str) -> Table:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules = proto.normalizer_spec
    crossing = any(_SPACE in p.piece.lstrip(_SPACE) or "\n" in p.piece for p in proto.pieces)
    if crossing or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError("this vocabulary's pieces cross white space, or its normalisation does")
    rules.add_dummy_prefix = False  # the first chunk of a text brings its own marker
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    numbers = [f" {i}" for i in range(model.get_piece_size())]

    def work(chunks: list[bytes]) -> list[list[bytes]]:
        ids = model.encode([c.decode() for c in chunks], num_threads=1)
        return [
            ["".join([numbers[i] for i in x]).encode() for x in ids],
            [len(x).to_bytes(4, "little") for x in ids],
            [x.encode() for x in model.decode(ids, num_threads=1)],
        ]

    return Table(work, at_spaces)


def encode_column(texts: pa.Array, path: str) -> Iterator[tuple[int, bytes, bytes]]:
    """For each text: the number of ids (with the end id), the decimal ids joined by spaces, the decoded text in UTF-8."""
    for i, j, outputs in _table(path).apply(texts, b" "):
        if not outputs:
            for _ in range(i, j):
                yield 1, b"%d" % END_ID, b""
            continue
        (ids_at, ids), (counts_at, counts), (said_at, said) = outputs
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32)[: counts_at[-1] // 4], dtype=np.int64)])
        lengths = np.diff(sums[counts_at // 4])
        for k in range(j - i):
            body = bytes(ids[ids_at[k] + 1 : ids_at[k + 1]]) if lengths[k] else b""
            yield int(lengths[k]) + 1, (body + b" " if body else b"") + b"%d" % END_ID, bytes(said[said_at[k] + 1 : said_at[k + 1]])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` (array of int, the end id last) and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in range(0, b.num_rows, 256):
                rows = list(encode_column(b["text"].slice(part, 256), path))
                ids = pa.array([np.array(x[1].split(), np.int32) for x in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(rows)), ids, pa.array([x[2].decode() for x in rows])], [id_col, "ids", "decoded"])
                at += len(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have the end id only and decode to nothing; rows that repeat are encoded each; a null id stays null; an
    empty table gives an empty one; no other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ids, said = [], [], []
            for n, joined, decoded in encode_column(b["text"], path):
                counts.append(n)
                ids.append(hashlib.sha256(joined).hexdigest())
                said.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
