"""Numpy kernels shared by the text operators.

All kernels work on a *block*: the UTF-8 bytes of a few documents joined by one
space, so that no word crosses from one document into the next.  Words are runs
of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def ascii_lower(data: bytes) -> bytes:
    """Lower-case A-Z only."""
    return data.translate(_LOWER_TABLE)


def mix64(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


class Block:
    """Words of a few documents, with a 64-bit hash each; ``outside`` tells the bytes that are of no word."""

    def __init__(self, texts: list[bytes], lower: bool = True, outside: np.ndarray = _IS_SPACE):
        data = b" ".join(texts)
        self.data = ascii_lower(data) if lower else data
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.doc_start[1:])
        word = np.empty(len(self.data) + 2, dtype=bool)
        word[0] = word[-1] = False
        np.logical_not(outside[self.bytes], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        #: words of document i are offsets[i]:offsets[i + 1]
        self.offsets = np.searchsorted(self.start, self.doc_start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def words(self) -> list[bytes]:
        return self.data.split()

    def hashes(self) -> np.ndarray:
        """A hash for each word: a polynomial of its bytes, then mixed with its length."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = 1 << max(16, int(n).bit_length())
        power, inverse = _powers(size)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix64(h ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word ``width``-grams of each document, and their offsets.

    A document with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    n = np.diff(offsets)
    per_doc = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(per_doc, out=out_offsets[1:])
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    total = np.zeros(len(hashes), dtype=np.uint64)
    factors = np.concatenate([_SHINGLE, mix64(np.arange(1, 1 + max(0, width - 5), dtype=np.uint64)) | np.uint64(1)])
    for j in range(width):
        total += padded[j : j + len(hashes)] * factors[j]
    first = np.repeat(offsets[:-1] - out_offsets[:-1], per_doc) + np.arange(out_offsets[-1])
    values = total[first]
    for i in np.flatnonzero((n > 0) & (n < width)):
        own = hashes[offsets[i] : offsets[i + 1]]
        values[out_offsets[i]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix64(values), out_offsets


def release() -> None:
    """Give memory that is no longer used back to the system: workers live on after a task, and executors have little to spare."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on this system
        pass


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes in all, one document at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a column's documents as in :func:`blocks`, with their bytes; only those of one block are copied at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and size + n > limit:
            yield first, i, binaries(column.slice(first, i - first))
            first, size = i, 0
        size += n + 1
    if first < len(column):
        yield first, len(column), binaries(column.slice(first))


def utf8(column: str | Column) -> Column:
    """The text's UTF-8 bytes; a missing text is an empty one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def id_crc(column: str | Column) -> Column:
    """crc32 of the id as text; of the empty text where the id is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def word_counts(texts: list[bytes]) -> np.ndarray:
    return Block(texts).counts


def load(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
