"""Benchmark passages in documents, found by winnowing.

An item's windows are its runs of ``window`` words; an item of fewer words is one window.
Of each run of ``window - k + 1`` consecutive k-grams winnowing keeps the one with the least
hash, in items and in documents alike; so a window that occurs in a document shares a kept
k-gram with it, wherever it begins: no span of ``window`` words is missed.  Shorter items
have a scheme of their own, with k half their length.  Fingerprints of documents meet those
of the benchmark, hits are extended to the whole windows around them, and every window is
confirmed on its words.

A benchmark of a counted size is broadcast and the documents are read once.  A larger one is
joined by shuffle: fingerprints first, then the windows around those that met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.kernels import Block, mix64, release, text_blocks, utf8
from ridgeline.llm.shared import Tables

_BLOCK = 1 << 20
#: Bits of the table that most fingerprints without a partner stop at.
_FILTER_BITS = 20
#: ASCII signs other than letters and digits; texts are lower-cased before.
_OUTSIDE = np.zeros(256, dtype=bool)
_OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_STEP = 0xA0761D6478BD642F


@dataclass(frozen=True)
class Winnowing:
    window: int = 10  # words of a window
    broadcast_bytes: int = 8 << 20  # of the benchmark's texts, distinct; beyond it the benchmark is shuffled

    def k(self, length: int) -> int:
        """Words of a k-gram for windows of that length."""
        return (length + 1) // 2


class Words(Block):
    """Words of a block's texts, of letters and digits, with a hash each and the k-grams' hashes."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts, outside=_OUTSIDE)
        self.hash = self.hashes()

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; runs that leave the text are there too, see :meth:`whole`."""
        out = np.zeros(len(self.hash), dtype=np.uint64)
        for j in range(min(k, len(out))):
            factor = mix64(np.array([j + 1], dtype=np.uint64))[0] | np.uint64(1)
            out[: len(out) - j] += self.hash[j:] * factor
        return mix64(out + np.uint64(k * _STEP % (1 << 64)))

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one text."""
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        return np.arange(len(self.hash)) + k <= ends

    def joined(self, i: int, n: int) -> bytes:
        """Words i to i + n, one space between them."""
        return b" ".join(self.data[a:b] for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True))


def kept(grams: np.ndarray, whole: np.ndarray, windows: np.ndarray, k: int, length: int) -> np.ndarray:
    """Places of the k-grams that winnowing keeps: the least of the k-grams of any window of ``length`` words, and its equals there."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    n = length - k + 1
    padded = np.concatenate([grams, np.full(n - 1, np.iinfo(np.uint64).max, dtype=np.uint64)])
    least = grams.copy()
    for j in range(1, n):
        np.minimum(least, padded[j : j + len(grams)], out=least)
    chosen = np.zeros(len(grams), dtype=bool)
    at = np.flatnonzero(windows)
    for j in range(n):
        own = at + j
        chosen[own[grams[own] == least[at]]] = True
    return np.flatnonzero(chosen & whole)


def _windows_of(words: Words, i: int, s: Winnowing) -> list[tuple[int, int]]:
    """First word and length of each window of an item."""
    first, last = words.offsets[i], words.offsets[i + 1]
    n = int(last - first)
    return [(int(first), n)] if 0 < n < s.window else [(p, s.window) for p in range(int(first), int(last) - s.window + 1)]


class Benchmark:
    """The distinct windows of all items: their words, fingerprints, hashes and items."""

    def __init__(self, items: list[tuple[str, bytes]], s: Winnowing):
        owners: dict[bytes, set[int]] = {}
        length_of: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        for item, text in items:
            words = Words([text])
            for p, n in _windows_of(words, 0, s):
                key = words.joined(p, n)
                owners.setdefault(key, set()).add(number[item])
                length_of[key] = n
        self.s = s
        self.schemes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[np.ndarray]]] = {}
        for n in sorted(set(length_of.values())):
            keys = [key for key in owners if length_of[key] == n]
            words = Words(keys)
            k = s.k(n)
            begins = words.offsets[:-1]
            whole = words.grams(n)[begins]
            order = np.argsort(whole, kind="stable")
            at_windows = np.zeros(len(words.hash), dtype=bool)
            at_windows[begins] = True
            grams = words.grams(k)
            prints = np.unique(grams[kept(grams, words.whole(k), at_windows, k, n)])
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[prints >> np.uint64(64 - _FILTER_BITS)] = True
            own = [np.fromiter(owners[keys[i]], dtype=np.int64) for i in order]
            self.schemes[n] = (prints, bits, whole[order], [keys[i] for i in order], own)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _around(places: np.ndarray, whole: np.ndarray, k: int, n: int) -> np.ndarray:
    """Beginnings of the windows of n words that hold a k-gram at one of the places."""
    begins = np.unique((places[:, None] - np.arange(n - k + 1)).ravel())
    begins = begins[begins >= 0]
    return begins[whole[begins]]


def _of_block(words: Words, b: Benchmark) -> Iterator[tuple[int, int, np.ndarray]]:
    """First word, length and items of each window of the benchmark that occurs in a block's texts."""
    grams: dict[int, np.ndarray] = {}
    for n, (prints, bits, hashes, keys, owners) in b.schemes.items():
        k = b.s.k(n)
        for size in (k, n):
            if size not in grams:
                grams[size] = words.grams(size)
        whole = words.whole(n)
        at = kept(grams[k], words.whole(k), whole, k, n)
        at = at[bits[grams[k][at] >> np.uint64(64 - _FILTER_BITS)]]
        at = at[_among(grams[k][at], prints)]
        if not len(at):
            continue
        begins = _around(at, whole, k, n)
        begins = begins[_among(grams[n][begins], hashes)]
        first = np.searchsorted(hashes, grams[n][begins])
        last = np.searchsorted(hashes, grams[n][begins], side="right")
        for p, i, j in zip(begins.tolist(), first.tolist(), last.tolist(), strict=True):
            text = words.joined(p, n)
            for w in range(i, j):  # more than one only where hashes of different windows are equal
                if keys[w] == text:
                    yield p, n, owners[w]


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _scan(docs: DataFrame, b: Benchmark) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256``, documents read once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column("text"), _BLOCK):
                words = Words(texts)
                edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
                found: dict[int, list[np.ndarray]] = {}
                for p, n, owners in _of_block(words, b):
                    edge[p] += 1
                    edge[p + n] -= 1
                    found.setdefault(int(np.searchsorted(words.offsets, p, side="right")) - 1, []).append(owners)
                hit = np.zeros(len(edge), dtype=np.int64)
                np.cumsum(np.cumsum(edge[:-1]) > 0, out=hit[1:])
                n_hit = hit[words.offsets[1:]] - hit[words.offsets[:-1]]
                items = [[b.ids[j] for j in np.unique(np.concatenate(found[i]))] if i in found else [] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, last - first), pa.array(np.diff(words.offsets)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items])],
                    names=["id", "n_words", "n_hit", "n_items", "items_sha256"],
                )
        release()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string")


def _exploded(rows: DataFrame, make, names: str) -> DataFrame:
    """Rows (key) of arrays that ``make`` yields for each text's words: place in the block's list of keys, then values."""
    columns = [c.split()[0] for c in names.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = {c: batch.column(c) for c in batch.schema.names if c not in ("key", "text")}
            for first, last, texts in text_blocks(batch.column("text"), _BLOCK):
                keys = batch.column("key").slice(first, last - first)
                for owner, *values in make(Words(texts), {c: x.slice(first, last - first) for c, x in extra.items()}):
                    if len(owner):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), *[pa.array(v, t) for v, t in zip(values, kinds, strict=True)]], names=["key", *columns])
        release()

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {names}")


def _owner(words: Words, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.offsets, places, side="right") - 1


def _joined(docs: DataFrame, items: DataFrame, s: Winnowing, keep: Tables) -> DataFrame:
    """The same as :func:`_scan` for a benchmark of any size: fingerprints and windows meet by shuffle.

    Documents of equal id and text are one, so that each is found once; a hot fingerprint is only ever
    joined to one row, and adaptive execution cuts its many documents.
    """
    def windows(words: Words, _: dict) -> Iterator[tuple]:
        for i in range(len(words.offsets) - 1):
            at = _windows_of(words, i, s)
            yield [i] * len(at), [n for _, n in at], [words.joined(p, n) for p, n in at]

    owned = keep.keep("windows", _exploded(items.select(F.col("id").alias("key"), "text"), windows, "n int, window binary").distinct())
    lengths = sorted(r.n for r in owned.select("n").distinct().collect())  # at most as many as a window has words

    def prints(words: Words, _: dict) -> Iterator[tuple]:
        for n in lengths:
            k = s.k(n)
            grams = words.grams(k)
            at = kept(grams, words.whole(k), words.whole(n), k, n)
            yield _owner(words, at), np.full(len(at), n, dtype=np.int32), grams[at].view(np.int64)

    distinct = owned.select("n", "window").distinct()
    theirs = _exploded(distinct.select(F.col("n").alias("key"), F.col("window").alias("text")), prints, "n int, print long").filter("n = key").select("n", "print").distinct()
    keyed = docs.select(F.struct("id", F.md5("text").alias("of"), F.length("text").alias("bytes")).alias("key"), "text")
    ours = _exploded(keyed, prints, "n int, print long")
    met = keep.keep("met", ours.join(theirs, ["n", "print"], "left_semi"))
    met = met.groupBy("key").agg(F.collect_set(F.struct("n", "print")).alias("met"))  # of one document, as many as its words at most

    def around(words: Words, extra: dict) -> Iterator[tuple]:
        pairs = extra["met"].to_pylist()
        for n in lengths:
            k = s.k(n)
            grams, whole = words.grams(k), words.whole(n)
            for i, known in enumerate(pairs):
                a, z = int(words.offsets[i]), int(words.offsets[i + 1])
                own = np.unique(np.array([x["print"] for x in known if x["n"] == n], dtype=np.int64).view(np.uint64))
                at = a + np.flatnonzero(_among(grams[a:z], own) & words.whole(k)[a:z])
                begins = _around(at, whole, k, n)
                begins = begins[begins >= a]
                yield np.full(len(begins), i), begins - a, np.full(len(begins), n, dtype=np.int32), [words.joined(p, n) for p in begins.tolist()]

    texts = keyed.join(met, "key").dropDuplicates(["key"])
    near = _exploded(texts, around, "begin long, n int, window binary")
    hits = keep.keep("hits", near.join(distinct, ["n", "window"], "left_semi"))
    before = F.coalesce(F.max(F.col("begin") + F.col("n")).over(Window.partitionBy("key").orderBy("begin", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("begin") + F.col("n") - F.greatest("begin", before))
    n_hit = hits.select("key", new.alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    pairs = hits.select("key", "n", "window").distinct().join(owned.withColumnRenamed("key", "item"), ["n", "window"]).select("key", "item").distinct()
    listed = pairs.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = n_hit.join(listed, "key").select("key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, own in text_blocks(batch.column("text"), _BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), pa.array(np.diff(Words(own).offsets))], names=["key", "n_words"])

    all_docs = keyed.mapInArrow(counts, f"key {keyed.schema['key'].dataType.simpleString()}, n_words long")
    theirs_of = found.withColumnRenamed("key", "k")
    same = (F.col("key.of") == F.col("k.of")) & (F.col("key.bytes") == F.col("k.bytes")) & F.col("key.id").eqNullSafe(F.col("k.id"))
    out = all_docs.join(theirs_of, same, "left")
    return out.select(
        "key.id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", s: Winnowing = Winnowing()) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document against all items.

    Missing and empty texts have no words, on both sides; items without words have no window.
    Items of one id are one item, and a missing item id is the empty text; documents of one id
    are judged each by its own text.  Other columns, of any name, are not read.  Empty tables
    give no rows, or no hits.
    """
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), utf8(text_col).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text") + F.length("id")), F.lit(0))).first()[0]
    if size <= s.broadcast_bytes:
        out = _scan(texts, Benchmark([(r.id, bytes(r.text)) for r in items.collect()], s))  # its size is counted
    else:
        out = _joined(texts, items, s, Tables(docs.sparkSession, "winnowing"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
