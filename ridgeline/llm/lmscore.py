"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for every word and pair of adjacent words of the training texts,
its count on a logarithmic scale: a sequence with level q is entered q times, once
for each level up to its own, so that probing level after level until one is
missing gives its count back.  The filter is built in shards, each over its own
stretch of bits, and its bits grow with the training text without a bound.  So they
are never gathered: the words and pairs of a block of texts are sent to their shards,
and the levels found there are sent back to the block.

Beside the model, each text gets an exact unigram score: with its level each word's exact
count comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.llm.kernels import Block, mix64, release, text_blocks, utf8
from ridgeline.llm.shared import Tables

END = np.uint64(0x6C62272E07BB0142)
START = np.uint64(0x27D4EB2F165667C5)
_PAIR = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SALTS = mix64(np.arange(65, dtype=np.uint64))
_BLOCK = 1 << 21
_FLUSH = 2_000_000  # tokens that a task counts together
_PROBED = 2_000_000  # tokens whose words and pairs are sent to the shards together


@dataclass(frozen=True)
class Settings:
    """``bits_per_token`` of training text, however much that is.

    ``weight`` is the number of pair observations that the unigram probability stands for.
    """

    base: float = 2.0
    probes: int = 3
    bits_per_token: float = 8.0
    weight: float = 500.0
    docs_per_shard: int = 6000
    bytes_per_shard: int = 16 << 20  # of training text, where documents are long


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts, each text's words and then one end; the text of each; the hash of each with the token before it."""
    block = Block(texts)
    n = block.counts
    total = n + 1
    owner = np.repeat(np.arange(len(texts)), total)
    last = np.cumsum(total) - 1
    token = np.full(int(total.sum()), END, dtype=np.uint64)
    is_word = np.ones(len(token), dtype=bool)
    is_word[last] = False
    token[is_word] = block.hashes()
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[last - total + 1] = START
    return token, owner, before


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(before * _PAIR[0] + token * _PAIR[1])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _address(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard and, below it, the 32 bits by which pairs are told apart in their shard."""
    return _shard(keys, shards) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def _pack(keys: np.ndarray) -> tuple[bytes, bytes]:
    """32-bit numbers in order in 3 bytes each, after counts of those with each first byte; a few are kept as they are."""
    keys = keys.astype("<u4")
    if len(keys) < 512:
        return b"", keys.tobytes()
    heads = np.bincount(keys >> np.uint32(24), minlength=256)
    kind = np.uint8 if heads.max() < 1 << 8 else np.uint16 if heads.max() < 1 << 16 else np.uint32
    return heads.astype(kind).tobytes(), keys.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpack(heads: bytes, body: bytes) -> np.ndarray:
    if not heads:
        return np.frombuffer(body, "<u4").astype(np.uint64)
    n = np.frombuffer(heads, {256: np.uint8, 512: np.uint16, 1024: np.uint32}[len(heads)])
    out = np.empty((len(body) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(body, np.uint8).reshape(-1, 3)
    out[:, 3] = np.repeat(np.arange(256, dtype=np.uint8), n)
    return out.view("<u4").ravel().astype(np.uint64)


_PACKED = "shard int, words binary, word_counts binary, heads binary, pairs binary, often binary, more binary"


def count(docs: DataFrame, shards: int) -> DataFrame:
    """Counts of words and pairs in ``docs`` (text bytes), packed: a row a shard and share of a task.

    ``often`` marks the pairs seen more than once, ``more`` has their counts.
    """
    def packed(tokens: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(tokens), return_counts=True)
        at = np.searchsorted(_shard(word, shards), np.arange(shards + 1, dtype=np.uint64))
        pair, m = np.unique(_address(np.concatenate(pairs), shards), return_counts=True)
        pair_at = np.searchsorted(pair >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
        out: list[list] = [[] for _ in range(7)]
        for i in np.flatnonzero((np.diff(at) > 0) | (np.diff(pair_at) > 0)).tolist():
            a, b, c, d = at[i], at[i + 1], pair_at[i], pair_at[i + 1]
            own = m[c:d]
            row = (
                i, word[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes(), *_pack(pair[c:d]),
                np.packbits(own > 1, bitorder="little").tobytes(), own[own > 1].astype(np.uint32).tobytes(),
            )
            for column, x in zip(out, row, strict=True):
                column.append(x)
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in _PACKED.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, size = [], [], 0
        for batch in batches:
            for _, _, texts in text_blocks(batch.column("text"), _BLOCK):
                token, _, before = _tokens(texts)
                tokens.append(token)
                pairs.append(_pair(before, token))
                size += len(token)
                if size >= _FLUSH:
                    yield packed(tokens, pairs)
                    tokens, pairs, size = [], [], 0
        if size:
            yield packed(tokens, pairs)
        release()

    return docs.mapInArrow(run, _PACKED)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _places(keys: np.ndarray, level: int, size: int, probes: int) -> Iterator[np.ndarray]:
    """The bit of a shard's stretch for each probe of each key at a level."""
    h = mix64(keys + _SALTS[level])
    step = mix64(h ^ np.uint64(0x8EBC6AF09C88C6E3)) | np.uint64(1)
    for _ in range(probes):
        yield ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        h = h + step


def _levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def merge(counts: DataFrame, size: int, s: Settings) -> DataFrame:
    """For each shard: its words with their counts, and its bits of the filter."""
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        word, n = _sum([np.frombuffer(x, np.uint64) for x in col["words"]], [np.frombuffer(x, np.uint32) for x in col["word_counts"]])
        pairs, pair_counts = [], []
        for heads, body, often, more in zip(col["heads"], col["pairs"], col["often"], col["more"], strict=True):
            pairs.append(_unpack(heads, body))
            pair_counts.append(np.ones(len(pairs[-1]), np.int64))
            pair_counts[-1][np.unpackbits(np.frombuffer(often, np.uint8), count=len(pairs[-1]), bitorder="little") == 1] = np.frombuffer(more, np.uint32)
        pair, m = _sum(pairs, pair_counts)
        bits = np.zeros(size, dtype=np.uint8)
        for salt, keys, own in ((1, word, n), (2, pair, m)):
            keys = mix64(keys ^ np.uint64(salt))
            levels = _levels(own, s.base)
            for level in range(1, int(levels.max(initial=0)) + 1):
                for place in _places(keys[levels >= level], level, size, s.probes):
                    bits[place] = 1
        return pa.table({
            "shard": pa.array([col["shard"][0]], pa.int32()), "words": [word.tobytes()], "counts": [n.tobytes()],
            "bits": [np.packbits(bits, bitorder="little").tobytes()], "total": [int(n.sum())], "distinct": [len(word)],
        })

    return counts.groupBy("shard").applyInArrow(run, "shard int, words binary, counts binary, bits binary, total long, distinct long")


@dataclass
class Filter:
    """Finished bits of the filter, of one shard or of several in a row."""

    bits: np.ndarray
    shards: int
    size: int
    total: int
    distinct: int
    settings: Settings

    def levels(self, keys: np.ndarray, salt: int, shard: np.ndarray) -> np.ndarray:
        """The highest level up to which each key is a member at every level."""
        mixed = mix64(keys ^ np.uint64(salt))
        begin = shard.astype(np.uint64) * np.uint64(self.size)
        out = np.zeros(len(keys), dtype=np.int64)
        active = np.arange(len(keys))
        level = 1
        while len(active) and level < 64:
            found = active
            left = mixed[active]
            for probe in range(self.settings.probes):
                # places of one probe for those that passed the ones before it
                place = self._place(left, level, probe) + begin[found]
                hit = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                found, left = found[hit], left[hit]
            out[found] = level
            active = found
            level += 1
        return out

    def _place(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        h = mix64(keys + _SALTS[level])
        if probe:
            h = h + np.uint64(probe) * (mix64(h ^ np.uint64(0x8EBC6AF09C88C6E3)) | np.uint64(1))
        return ((h >> np.uint64(32)) * np.uint64(self.size)) >> np.uint64(32)

    def counts(self, levels: np.ndarray) -> np.ndarray:
        """A level's middle count (geometric), 1 for the first and 0 for none."""
        b = self.settings.base
        return np.where(levels > 1, b ** (levels - 0.5), levels.astype(float))

    def log10(self, word_levels: np.ndarray, mine: np.ndarray, prior: np.ndarray, pair_levels: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before it; ``mine``, ``prior`` and ``pair`` are the places of its levels."""
        s = self.settings
        word_count = self.counts(word_levels)
        single = (word_count + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        # no pair is commoner than its parts
        together = np.minimum(self.counts(pair_levels)[pair], np.minimum(word_count[mine], word_count[prior]))
        return np.log10((together + s.weight * single[mine]) / (word_count[prior] + s.weight))


def bits_for(size: int, s: Settings) -> int:
    """The filter's bits for ``size`` bytes of training text, about 6 a token."""
    return max(1 << 16, int(size / 6 * s.bits_per_token))


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Learn from the rows with ``train`` true and score all: ``id, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are a text's words (runs of bytes other than ASCII white space, A-Z in
    lower case) and then one end.  ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V
    + 1))) over them with exact counts; ``n_known`` counts those with c > 0;
    ``score`` is the model's log10 probability.  A missing or empty text has its end
    alone; texts of any length are read whole.  Repeated rows get equal scores, missing ids
    are passed on, an empty table gives an empty result, and other columns are not read.
    Without training rows every probability is that of N = V = 0.
    """
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), train.alias("train"))
    sizes = picked.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("train"), F.octet_length("text"))).alias("size")).first()
    shards = max(16, -(-sizes.docs // s.docs_per_shard), -(-(sizes["size"] or 0) // s.bytes_per_shard))
    size = max(64, bits_for(sizes["size"] or 0, s) // shards // 64 * 64)
    tables = Tables(docs.sparkSession, "lmscore")
    merged = tables.keep("merged", merge(count(picked.filter("train").select("text"), shards), size, s))
    totals = merged.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = int(totals.n or 0), int(totals.v or 0)
    blocks = tables.keep("blocks", _blocks(picked.select("id", "text")))
    model = Filter(np.zeros(0, np.uint8), 1, size, n, v, s)
    scored = _scored(blocks, merged, shards, model, picked.schema["id"].dataType)
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).select("id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _high(at: np.ndarray) -> np.ndarray:
    """What two bytes do not hold of the tokens' places: a byte each, or four where one text has more than 16 million distinct words."""
    return (at >> 16).astype(np.uint8 if not len(at) or at.max() < 1 << 24 else np.uint32)


_BLOCKS = "block long, sizes binary, words binary, low binary, high binary"


def _blocks(picked: DataFrame) -> DataFrame:
    """The tokens of many texts a row: the texts' ids and sizes, the distinct words, and each token's place among these, in 3 bytes."""
    id_type = to_arrow_type(picked.schema["id"].dataType)

    def packed(block: int, ids: list[pa.Array], sizes: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        word, at = np.unique(np.concatenate(tokens), return_inverse=True)
        ids = pa.concat_arrays(ids)
        own = (np.concatenate(sizes).astype(np.int32).tobytes(), word.tobytes(), at.astype(np.uint16).tobytes(), _high(at).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in own], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
            names=[*[f.split()[0] for f in _BLOCKS.split(", ")], "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, tokens, held = [], [], [], 0
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text"), _BLOCK):
                token, owner, _ = _tokens(texts)
                ids.append(batch.column("id").slice(a, b - a))
                sizes.append(np.bincount(owner, minlength=b - a))
                tokens.append(token)
                held += len(token)
                if held >= _PROBED:
                    yield packed(block, ids, sizes, tokens)
                    ids, sizes, tokens, held, block = [], [], [], 0, block + 1
        if ids:
            yield packed(block, ids, sizes, tokens)
        release()

    return picked.mapInArrow(run, f"{_BLOCKS}, ids array<{picked.schema['id'].dataType.simpleString()}>")


def _unpacked(row: dict, shards: int) -> tuple[np.ndarray, ...]:
    """Of a block: its words' hashes, the words of its tokens and of those before them, its pairs' addresses, and its tokens' pairs."""
    word, sizes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["sizes"], np.int32)
    kind = np.uint8 if 2 * len(row["high"]) == len(row["low"]) else np.uint32
    mine = np.frombuffer(row["low"], np.uint16).astype(np.int32) | np.frombuffer(row["high"], kind).astype(np.int32) << 16
    begin = np.cumsum(sizes) - sizes
    prior = np.empty(len(mine), np.int32)
    prior[1:] = mine[:-1]
    prior[begin] = mine[-1]  # a text's beginning is counted as often as its end
    before = word[prior]
    before[begin] = START
    pair, at = np.unique(_address(_pair(before, word[mine]), shards), return_inverse=True)
    return word, mine, prior, pair, at


def _scored(blocks: DataFrame, merged: DataFrame, shards: int, model: Filter, id_type) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score``: words and pairs of a block go to their shards, and their counts and levels come back."""
    log_all = float(np.log10(model.total + 0.5 * (model.distinct + 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.arange(shards + 1, dtype=np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                word, _, _, pair, _ = _unpacked(row, shards)
                at, pair_at = np.searchsorted(_shard(word, shards), ends), np.searchsorted(pair >> np.uint64(32), ends)
                used = np.flatnonzero((np.diff(at) > 0) | (np.diff(pair_at) > 0))
                packed = [_pack(pair[pair_at[i] : pair_at[i + 1]]) for i in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)), pa.array(np.full(len(used), row["block"])), pa.array([word[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()),
                        pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary()),
                    ],
                    names=["shard", "block", "words", "heads", "pairs"],
                )
        release()

    def look_up(probes: pa.Table, counted: pa.Table) -> pa.Table:
        own = replace(model, bits=np.frombuffer(counted.column("bits")[0].as_py(), np.uint8)) if counted.num_rows else None
        known, counts = (np.frombuffer(counted.column(c)[0].as_py(), t) if own else np.zeros(0, t) for c, t in (("words", np.uint64), ("counts", np.int64)))

        def levels(keys: np.ndarray, salt: int) -> bytes:
            found = own.levels(keys, salt, np.zeros(len(keys), dtype=np.uint64)) if own and len(keys) else np.zeros(len(keys))
            return found.astype(np.uint8).tobytes()

        out: list[list[bytes]] = [[], [], []]
        for words, heads, pairs in zip(*(probes.column(c) for c in ("words", "heads", "pairs")), strict=True):
            word = np.frombuffer(words.as_py(), np.uint64)
            place = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
            c = np.where(known[place] == word, counts[place], 0) if len(known) else np.zeros(len(word), np.int64)
            for column, x in zip(out, (levels(word, 1), c.tobytes(), levels(_unpack(heads.as_py(), pairs.as_py()), 2)), strict=True):
                column.append(x)
        return pa.table([probes.column("block"), probes.column("shard"), *[pa.array(x, pa.binary()) for x in out]], names=["block", "shard", "word_levels", "counts", "pair_levels"])

    def total(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.drop_columns(["ids"]).to_pylist()[0]
        _, mine, prior, _, pair = _unpacked(row, shards)
        answers = answers.sort_by("shard")  # words and pairs are in the order of their shards
        kinds = (("word_levels", np.uint8), ("counts", np.int64), ("pair_levels", np.uint8))
        word_levels, counts, pair_levels = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t).astype(np.int64) for c, t in kinds)
        sizes = np.frombuffer(row["sizes"], np.int32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        base = np.log10(counts + 0.5) - log_all
        sums = [np.bincount(owner, x, minlength=len(sizes)) for x in ((counts > 0)[mine], base[mine], model.log10(word_levels, mine, prior, pair_levels, pair))]
        return pa.table({
            "id": block.column("ids").combine_chunks().flatten(), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(sums[0].astype(np.int64)),
            "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
        })

    probes = blocks.drop("ids").mapInArrow(deal, "shard int, block long, words binary, heads binary, pairs binary")
    answers = probes.groupBy("shard").cogroup(merged.select("shard", "words", "counts", "bits").groupBy("shard")).applyInArrow(
        look_up, "block long, shard int, word_levels binary, counts binary, pair_levels binary"
    )
    kind = id_type.simpleString()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
