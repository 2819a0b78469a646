"""SentencePiece encoding with seeded merge-dropout, and decoding.

Pieces and their scores come from a SentencePiece BPE model file; nothing is
trained.  A text is split where no piece can reach across (a space after something
else), and in each part the best-scored pair of neighbours is merged over and over.
With dropout, a candidate that comes to the head of the agenda is skipped if a hash of
seed, document, the part's place in the text, place in the part and piece says so; it
comes back only if a neighbour changes.  So a word is cut anew wherever it is met.  The
same seed gives the same pieces on any cluster; all of them decode to the text.

The agendas of all parts of one length advance together, a candidate each at a time.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.kernels import mix64, release, text_blocks, utf8
from ridgeline.llm.shared import Tables, maybe_broadcast

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_PART = re.compile(" *[^ \n▁]+| +|\n|▁")
_SPACE = "▁"
_NEVER = (1 << 31) - 1
_GONE = -0x110001  # no character and no piece
_LONG = 48  # characters; agendas of longer parts are heaps, one by one
_TOGETHER = 1 << 17  # characters whose agendas advance together
_BLOCK = 1 << 19


class Pieces:
    """The pieces of a model: their ids, the order in which they are merged, and their bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(_SPACE in names[i].lstrip(_SPACE) for i in plain):
            raise ValueError("pieces with a space after something else are not supported")
        self.ids = {names[i]: i for i in plain}
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {names[i]: r for r, i in enumerate(by_score)}
        self.of_byte = [0] * 256
        data = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][1:-1], 16)
                self.of_byte[value] = i
                data[i] = bytes([value])
            elif names[i] in self.ids:
                data[i] = names[i].replace(_SPACE, " ").encode()
        if not all(self.of_byte):
            raise ValueError("a model with byte pieces is needed")
        self.length = np.array([len(x) for x in data], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(data), dtype=np.uint8)
        # characters that are no piece but lie in one take part in merges under numbers of their own
        units = dict(self.ids)
        for c in sorted({c for name in self.ids for c in name} - set(self.ids)):
            units[c] = n + len(units)
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for name, i in units.items():
            if len(name) == 1:
                self.single[ord(name)] = i
        self.odd = {i: name for name, i in units.items() if i >= n}
        self.of_rank = np.array(by_score, dtype=np.int64)
        pairs = {}
        for name in self.ids:
            for k in range(1, len(name)):
                left, right = units.get(name[:k]), units.get(name[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = self.rank[name]
        self._table(pairs)

    def pack(self, parts: list[str]) -> bytes:
        ids = array("i")
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                ids.extend([self.of_byte[b] for b in p.encode("utf-8", "surrogateescape")])
            else:
                ids.append(i)
        return ids.tobytes()

    def _table(self, pairs: dict[int, int]) -> None:
        """The pairs with their ranks by open addressing, at most an eighth full."""
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.pair = np.full(1 << self.bits, -1, dtype=np.int64)
        self.pair_rank = np.full(1 << self.bits, _NEVER, dtype=np.int64)
        mask = (1 << self.bits) - 1
        keys = np.array(list(pairs), dtype=np.int64)
        for key, at in zip(keys.tolist(), self._slots(keys).tolist(), strict=True):
            while self.pair[at] != -1:
                at = (at + 1) & mask
            self.pair[at], self.pair_rank[at] = key, pairs[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of pieces makes, ``_NEVER`` if none."""
        keys = left << 32 | (right & 0xFFFFFFFF)
        at = self._slots(keys)
        held = self.pair[at]
        out = np.where(held == keys, self.pair_rank[at], _NEVER)
        left_over = np.flatnonzero((held != keys) & (held != -1))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            held = self.pair[at[left_over]]
            hit = held == keys[left_over]
            out[left_over[hit]] = self.pair_rank[at[left_over[hit]]]
            left_over = left_over[~hit & (held != -1)]
        return out

    def _together(self, parts: list[str], limit: int, keys: np.ndarray) -> list[bytes]:
        """Packed ids of parts of one length, each under its key.

        Characters that are no piece are kept as negative numbers, merge with nothing, and become bytes at the end.
        """
        n, width = len(parts), len(parts[0])
        letters = np.frombuffer("".join(parts).replace(" ", _SPACE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        piece = self.single[letters]
        piece = np.where(piece < 0, -1 - letters, piece).reshape(n, width)
        result = piece.copy()
        # one place more, which stands for what is before the first piece and after the last
        piece = np.concatenate([piece, np.full((n, 1), _GONE)], axis=1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        before[:, 0] = width
        rank = np.full((n, width + 1), _NEVER, dtype=np.int64)
        rank[:, : width - 1] = self._ranks(piece[:, : width - 1].ravel(), piece[:, 1:width].ravel()).reshape(n, width - 1)
        part = np.arange(n)
        while len(part):
            at = rank.argmin(axis=1)  # the leftmost of the best
            row = np.arange(len(part))
            best = rank[row, at]
            over = best == _NEVER
            if over.any():
                result[part[over]] = piece[over, :-1]
                go = ~over
                part, piece, after, before, rank, at, best = (x[go] for x in (part, piece, after, before, rank, at, best))
                row = np.arange(len(part))
            if limit:
                skip = _skipped_all(keys[part], at, best) < limit
                rank[row[skip], at[skip]] = _NEVER
                row, at, best = row[~skip], at[~skip], best[~skip]
            second = after[row, at]
            third = after[row, second]
            merged = self.of_rank[best]
            piece[row, at] = merged
            piece[row, second] = _GONE
            rank[row, second] = _NEVER
            after[row, at] = third
            before[row, third] = at
            rank[row, at] = self._ranks(merged, piece[row, third])
            previous = before[row, at]
            rank[row, previous] = self._ranks(piece[row, previous], merged)
        return self._packed(result)

    def _packed(self, piece: np.ndarray) -> list[bytes]:
        """Each row's pieces, 4 bytes each, without those that are gone."""
        keep = piece != _GONE
        count = keep.sum(axis=1)
        flat = piece[keep]
        if ((flat < 0) | (flat >= len(self.length))).any():
            names = [chr(-1 - p) if p < 0 else self.odd.get(p) for p in flat.tolist()]
            own = [[p] if c is None else [self.of_byte[b] for b in c.encode("utf-8", "surrogateescape")] for p, c in zip(flat.tolist(), names, strict=True)]
            count = np.add.reduceat(np.array([len(x) for x in own]), np.cumsum(count) - count)
            flat = np.array([p for x in own for p in x], dtype=np.int64)
        ends = (np.cumsum(count) * 4).tolist()
        data = flat.astype("<i4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def cut(self, parts: list[str], limit: int, keys: np.ndarray) -> list[bytes]:
        """Packed ids of the parts, each under its 32-bit key; a candidate is skipped if its hash is below ``limit``."""
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        out: list[bytes] = [b""] * len(parts)
        order = np.argsort(size, kind="stable")
        in_order = size[order]
        at, end = 0, int(np.searchsorted(in_order, _LONG, "right"))
        while at < end:
            width = int(in_order[at])
            last = min(at + _TOGETHER // width, int(np.searchsorted(in_order, width, "right")))
            some = order[at:last]
            for i, x in zip(some.tolist(), self._together([parts[i] for i in some.tolist()], limit, keys[some]), strict=True):
                out[i] = x
            at = last
        for i in order[end:].tolist():
            out[i] = self.pack(self._merged_long(parts[i].replace(" ", _SPACE), limit, int(keys[i])))
        for i in np.flatnonzero(size == 1).tolist():
            if parts[i] == _SPACE:  # the character itself, not a space
                out[i] = array("i", [self.of_byte[b] for b in parts[i].encode()]).tobytes()
        return out

    def _merged_long(self, text: str, dropout: int, key: int) -> list[str]:
        """The pieces of a long part, with the agenda as a heap; a candidate is skipped if its 32-bit hash is below ``dropout``."""
        rank = self.rank
        n = len(text)
        parts: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                both = parts[i] + parts[after[i]]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, i, after[i], both))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, j, both = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[i] + parts[j] != both:
                continue  # a neighbour has changed since
            if dropout and _skipped(key, i, r, dropout):
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0) -> bytes:
        """The ids of a text's pieces, 4 bytes each."""
        return self.encode_all([text], dropout, np.array([seed]))[0]

    def encode_all(self, texts: list[str], dropout: float, keys: np.ndarray) -> list[bytes]:
        """The ids of each text's pieces under its key."""
        limit = int(dropout * (1 << 32))
        split = [_PART.findall(" " + t) if t else [] for t in texts]
        parts = [p for x in split for p in x]
        count = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        place = np.concatenate([[0], np.cumsum(size)])
        first = np.cumsum(count) - count
        place = place[:-1] - np.repeat(place[first], count)  # in the part's own text
        own = mix64(np.repeat(mix64(keys.astype(np.int64).view(np.uint64)), count) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        own &= np.uint64(0xFFFFFFFF)
        ids = self.cut(parts, limit, own)
        ends = np.cumsum(count).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text from its ids: all pieces' bytes, less the space put before the text."""
        n = self.length[ids]
        total = np.cumsum(n)
        if not len(total):
            return b""
        at = np.repeat(self.start[ids] - total + n, n) + np.arange(total[-1])
        return self.bytes[at].tobytes()[1:]


def _skipped(key: int, at: int, rank: int, dropout: int) -> bool:
    """Whether the candidate at a place is skipped: a keyed hash of place and merge, against the limit."""
    h = ((key ^ (at * 0x9E3779B1 + rank * 0xC2B2AE3D)) * 0x7FEB352D) & 0xFFFFFFFF
    h = ((h ^ (h >> 15)) * 0x846CA68B) & 0xFFFFFFFF
    return (h ^ (h >> 16)) < dropout


def _skipped_all(key: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes of :func:`_skipped`."""
    low = np.uint64(0xFFFFFFFF)
    place = at.astype(np.uint64) * np.uint64(0x9E3779B1) + rank.astype(np.uint64) * np.uint64(0xC2B2AE3D)
    h = ((key ^ place) * np.uint64(0x7FEB352D)) & low
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x846CA68B)) & low
    return h ^ (h >> np.uint64(16))


@lru_cache(maxsize=2)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def _of_files(df: DataFrame) -> bool:
    """Whether rows are those of files, perhaps not all or not whole, so that file and row tell each."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "parquet" in str(node.relation()).lower()


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (key and others) with ``copy``, their number among the rows of one key from 0 on.

    A row is known by its file and place there; rows that are not of files are written first.  Only
    places and keys of keys that occur more than once are numbered: within a stretch of places, and the
    stretches by their sizes, so that no key is one task's, however many rows it has.
    """
    tables = Tables(rows.sparkSession, "copies")
    if not _of_files(rows):
        rows = tables.keep("rows", rows)
    placed = rows.withColumns({"file": F.xxhash64("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    narrow = placed.select("key", "file", "row", F.shiftright("row", 16).alias("stretch"))
    often = tables.keep("often", narrow.groupBy("key").count().filter("count > 1").select("key"))
    own = narrow.join(maybe_broadcast(often), "key", "left_semi")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("file", "stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = own.groupBy("key", "file", "stretch").agg(F.count(F.lit(1)).alias("n")).select("key", "file", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("key", "file", "stretch").orderBy("row")) - 1
    numbers = own.select("key", "file", "stretch", "row", within.alias("within")).join(starts, ["key", "file", "stretch"])
    numbers = tables.keep("numbers", numbers.select("file", "row", (F.col("before") + F.col("within")).alias("copy")).filter("copy > 0"))
    return placed.join(maybe_broadcast(numbers), ["file", "row"], "left").drop("file", "row").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))


def encode(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = 0.1, seed: int = 1, copies: bool = False
) -> DataFrame:
    """``id, ids`` for each row: the ids of its text's pieces.

    Dropout is keyed on seed, id and the place in the text, so a repeated word and copies
    with different ids are cut differently, and repeated rows alike.  With ``copies``, rows of
    the same id are numbered, wherever they are, and each is cut on its own; so rows of equal id and text
    have the same cuts, as a whole, however the table is split.
    ``dropout`` 0 gives the model's own pieces.  A missing or
    empty text has no ids; missing ids are passed on; an empty table gives an empty
    result; other columns are not read; texts of any length are cut whole.  ``model`` is read by the driver.
    """
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    picked = docs.select(F.col(id_col).alias("id"), key.alias("key"), utf8(text_col).alias("text"), F.lit(0).cast("long").alias("copy"))
    if copies:
        picked = numbered(picked.drop("copy"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if copies:
                keys = mix64(keys.view(np.uint64) + batch.column("copy").to_numpy().view(np.uint64)).view(np.int64)
            for a, b, texts in text_blocks(batch.column("text"), _BLOCK):
                packed = own.encode_all([x.decode("utf-8", "surrogateescape") for x in texts], dropout, keys[a:b])
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "ids"])
        release()

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``id, ids, text`` for each row: the text that its ids stand for; missing and empty ids stand for the empty text.

    Missing ids of rows are passed on, repeated rows are alike, an empty table gives an empty
    result, other columns are not read, and lists of any length are taken whole.
    """
    picked = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column("ids")
            texts = [own.decode(column[i].values.to_numpy() if column[i].is_valid else np.zeros(0, dtype=np.int32)) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(texts, pa.binary())], names=["id", "ids", "text"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, ids array<int>, text binary").withColumn("text", F.col("text").cast("string"))
