"""Helpers shared by the operators of this subpackage: whole texts as numpy buffers, word hashes, checkpoints."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer document makes a step of its own.
STEP_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _shared_folder(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder, unless it has one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Where the setting is missing a folder below the warehouse is taken in local mode (tests, a laptop); on a cluster, where that
    could be a folder of one machine, a missing setting is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the folder that ``cut`` uses, and read again: later steps read only the columns they use."""
    _shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of an Arrow string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if binary else "")
    texts = texts.cast(pa.large_binary() if binary else pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def steps(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``step`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@functools.cache
def _bytes_table() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words of some documents: ``hashes`` (64 bits each), ``start`` and ``end`` (bytes), ``first`` (n + 1, per document).

    A word is a longest run without ASCII white space; A-Z count as a-z.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        low = LOWER[data]
        white = WHITE[low]
        begins = ~white
        begins[1:] &= white[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = ~white[heads]
        ends = ~white
        ends[:-1] &= white[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[tails] = ~white[tails]
        self.data, self.start, self.end = low, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums, down = self._sums()
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        size = 1 << max(STEP_BYTES.bit_length(), n.bit_length())
        up, down = _powers(size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_bytes_table()[self.data] * up[:n], out=sums[1:])
        return sums, down

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hashes of the words' first ``n`` bytes; a shorter word's is that of the whole."""
        sums, down = self._sums()
        end = np.minimum(self.end, self.start + n)
        return mix((sums[end] - sums[self.start]) * down[self.start] + np.uint64(n << 32))


def words_of(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``Words`` of consecutive ranges of the array's documents, with each range."""
    offsets, data = buffers(texts)
    for i, j in steps(offsets, step):
        yield i, j, Words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
