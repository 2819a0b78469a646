"""Near-duplicate documents by b-bit MinHash, with every link confirmed on the full shingle sets.

Documents are first joined into classes of equal word sequences.  A class has one
sketch: band keys from groups of minima, and the low bits of all minima, packed.
Classes that share a band key are candidates.  They are not paired off: in each bucket
all members meet one pivot, in a second round those still apart from it meet another,
and what is then still in different components meets across these, by longer sketches.
A pair is compared by its packed sketches, then on its full sets, which are read from the
texts once.  No link is lost to a cap: the bands find a pair at the threshold with probability above
1 - 1e-6.

What is written between steps is a table in the shared folder; rows of buckets hold two
or three numbers each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import Block, mix64, release, shingles, text_blocks, utf8
from ridgeline.llm.shared import Tables, fresh

_BLOCK = 500_000
#: Tables of numbers (up to 80 bytes a row) are broadcast if they have at most this many rows; else they are joined by shuffle.
BROADCAST_ROWS = 250_000
#: The same for ids and hashes of texts to read or to leave out; beyond it the texts are shuffled once.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Sketching:
    percent: int = 85  # links need 100 * intersection >= percent * union
    width: int = 5
    bands: int = 32
    rows: int = 6
    bits: int = 2  # kept of each minimum
    long_hashes: int = 1024  # of the sketches that what the pivots have not linked is compared by
    cell: int = 1024  # rows of one component of a bucket that meet others in one cell
    dealt: int = 256  # pairs of one pivot that are compared in one place
    sigmas: float = 4.5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def most_unlike(self, n: int, bits: int) -> int:
        """Of n packed values, the most that may differ at the threshold: collision-corrected, ``sigmas`` deviations."""
        j = self.percent / 100
        unlike = (1 - j) * (1 - 0.5**bits)
        return floor(n * unlike + self.sigmas * sqrt(n * unlike * (1 - unlike)))


def _multipliers(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of each column's minima, packed into 64-bit words: (rows, ceil(columns * bits / 64))."""
    low = values & np.uint64((1 << bits) - 1)
    per = 64 // bits
    out = np.zeros((len(values), -(-values.shape[1] // per)), dtype=np.uint64)
    for j in range(values.shape[1]):
        out[:, j // per] |= low[:, j] << np.uint64(j % per * bits)
    return out.view(np.int64)


def _minima(values: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), len(multipliers)), dtype=np.uint64)
    for j, a in enumerate(multipliers):
        out[:, j] = np.minimum.reduceat(values * a, starts)
    return mix64(out)


def _classes(block: Block, hashes: np.ndarray) -> np.ndarray:
    """A hash of each document's word sequence (0 without words)."""
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(block.offsets[:-1], block.counts).astype(np.uint64)
    mixed = mix64(hashes + place * np.uint64(0x9FB21C651E98DF25))
    out = np.zeros(len(block.counts), dtype=np.uint64)
    full = block.counts > 0
    if full.any():
        out[full] = mix64(np.add.reduceat(mixed, block.offsets[:-1][full]))
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block, np.ndarray]]:
    for batch in batches:
        for first, last, texts in text_blocks(batch.column("text"), _BLOCK):
            block = Block(texts)
            yield batch.slice(first, last - first), block, block.hashes()
    release()


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def sketches(docs: DataFrame, s: Sketching) -> DataFrame:
    """``id, text_hash, class, n, bands, packed`` of ``docs`` (id, text_hash, text bytes); class and sketch are null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(s.hashes, 0x51)
        for rows, block, hashes in _each(batches):
            values, offsets = shingles(hashes, block.offsets, s.width)
            n = np.zeros(len(block.counts), dtype=np.int64)
            full = np.flatnonzero(block.counts > 0)
            bands = np.zeros((len(n), s.bands), dtype=np.int64)
            packed = np.zeros((len(n), -(-s.hashes // (64 // s.bits))), dtype=np.int64)
            if len(full):
                minima = _minima(values, offsets[:-1][full], multipliers)
                packed[full] = _pack(minima, s.bits)
                keys = np.zeros((len(full), s.bands), dtype=np.uint64)
                for r in range(s.rows):
                    keys = mix64(keys ^ minima[:, r :: s.rows]) + np.arange(s.bands, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                bands[full] = mix64(keys).view(np.int64)
                for i in full:
                    n[i] = len(np.unique(values[offsets[i] : offsets[i + 1]]))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"), rows.column("text_hash"), pa.array(_classes(block, hashes).view(np.int64), mask=block.counts == 0),
                    pa.array(n), _lists(bands), _lists(packed),
                ],
                names=["id", "text_hash", "class", "n", "bands", "packed"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, text_hash long, class long, n long, bands array<long>, packed array<long>")


def _of_rows(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows (id, text_hash) that are among the keys, or are not; where these are few the rows are not moved."""
    keys = keys.select(F.col("id").alias("i"), F.col("text_hash").alias("h"))
    return rows.join(_maybe_broadcast(keys, BROADCAST_IDS), (F.col("text_hash") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")), how)


def _sets(docs: DataFrame, wanted: DataFrame, s: Sketching) -> DataFrame:
    """``class, data`` of the wanted documents (id, text_hash): their distinct shingles."""
    found = _of_rows(docs, wanted, "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, hashes in _each(batches):
            values, offsets = shingles(hashes, block.offsets, s.width)
            full = np.flatnonzero(block.counts > 0)
            own = [np.unique(values[offsets[i] : offsets[i + 1]]) for i in full]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            data = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_classes(block, hashes)[full].view(np.int64)), data], names=["class", "data"])

    return found.mapInArrow(run, "class long, data array<long>")


def _long(sets: DataFrame, s: Sketching) -> DataFrame:
    """``class, n, packed`` of some sets: long sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(s.long_hashes, 0xA7)
        for batch in batches:
            data = batch.column("data")
            offsets = data.offsets.to_numpy()
            if batch.num_rows:
                values = data.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
                packed = _lists(_pack(_minima(values, offsets[:-1] - offsets[0], multipliers), s.bits))
                yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(np.diff(offsets).astype(np.int64)), packed], names=["class", "n", "packed"])
        release()

    return sets.mapInArrow(run, "class long, n long, packed array<long>")


def _unlike(a: str, b: str, words: int, bits: int) -> Column:
    """How many packed values of two sketches differ."""
    def one(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        if bits == 2:
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        return F.bit_count(x)

    return reduce(lambda p, q: p + q, [one(i) for i in range(words)])


def _alike(s: Sketching, hashes: int) -> Column:
    """Whether the sketches of a row ``l`` and a row ``r``, and their sizes, allow the similarity."""
    words = -(-hashes // (64 // s.bits))
    sizes = 100 * F.least("l.n", "r.n") >= s.percent * F.greatest("l.n", "r.n")
    return sizes & (_unlike("l.packed", "r.packed", words, s.bits) <= s.most_unlike(hashes, s.bits))


def _short(key: Column) -> Column:
    """31 bits of a band key: a class's own keys are told apart by these."""
    return key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _maybe_broadcast(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``class, comp, degree`` for the ends of the edges (a, b): the component, named by one of its classes, and the number of links.

    Each step joins every node to the least of its neighbours and itself, and goes on
    with the edges between what is joined; these soon are none.  Equal names always
    mean connected nodes.
    """
    graph = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    while True:
        low = graph.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
        joined = tables.keep("joined", low.select("class", F.least("class", "low").alias("comp"), "degree"))
        hubs = _maybe_broadcast(joined.select("class", "comp"))
        if labels is None:
            labels = joined
        else:
            up = hubs.select(F.col("class").alias("comp"), F.col("comp").alias("top"))
            labels = tables.keep("labels", labels.join(up, "comp", "left").select("class", F.coalesce("top", "comp").alias("comp"), "degree"))
        graph = graph.join(hubs.select(F.col("class").alias("a"), F.col("comp").alias("p")), "a").join(
            hubs.select(F.col("class").alias("b"), F.col("comp").alias("q")), "b"
        )
        graph = tables.keep("graph", graph.filter("p != q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
        if not graph.limit(1).count():
            return labels


class _Links:
    """Candidate classes of one corpus, and how their pairs are confirmed."""

    def __init__(self, picked: DataFrame, nodes: DataFrame, s: Sketching, tables: Tables):
        self.s, self.tables = s, tables
        self.nodes = nodes
        slots = nodes.select("class", F.explode("bands").alias("key"))
        # classes are hashes, so the least of a bucket is any of them, and often the same in a group's other buckets
        buckets = slots.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("pivot")).filter("members > 1")
        self.members = tables.keep("members", slots.join(buckets, "key").select("key", "class", "pivot"))
        wanted = nodes.join(self.members.select("class"), "class", "left_semi").select("class", "id", "text_hash", "n", "packed")
        wanted = tables.keep("wanted", wanted)
        n = wanted.count()
        self.light = wanted.select("class", "n", "packed")
        self.few = n <= BROADCAST_ROWS
        if self.few:
            self.light = F.broadcast(self.light)
        self.sets = tables.keep("sets", _sets(picked, wanted, s))
        if self.sets.count() > n:  # rows that repeat an id and its text
            self.sets = tables.keep("sets", self.sets.dropDuplicates(["class"]))

    def confirmed(self, pairs: DataFrame, alike: bool = False) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are alike enough; ``alike`` says that their sketches are known to be.

        A pivot ``a`` with many pairs meets them in several places.
        """
        pairs = self.tables.keep("pairs", pairs)
        counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") > self.s.dealt)
        hot = self.tables.keep("hot", counts.select("a", F.ceil(F.col("pairs") / self.s.dealt).cast("int").alias("places")))
        hot = _maybe_broadcast(hot)

        def dealt(rows: DataFrame) -> DataFrame:
            """Rows of pivots ``a``, once for each place."""
            rows = rows.join(hot, "a", "left")
            return rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")

        pairs = pairs.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("places", F.lit(1))).cast("int").alias("place"), "b")
        near = pairs if alike else self.tables.keep("near", self._near(pairs, dealt))
        sets = self.sets
        if near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then sets that no pair needs are not moved
            sets = sets.join(F.broadcast(near.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "class", "left_semi")
        met = near.join(sets.select(F.col("class").alias("b"), F.col("data").alias("y")), "b").join(
            dealt(sets.select(F.col("class").alias("a"), F.col("data").alias("x"))), ["a", "place"]
        )
        common = F.size(F.array_intersect("x", "y")).cast("long")
        enough = 100 * common >= self.s.percent * (F.size("x") + F.size("y") - common)
        return self.tables.keep("edges", met.filter(enough).select("a", "b"))

    def _near(self, pairs: DataFrame, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Those of the pairs (a, place, b) whose sketches allow the similarity."""
        left = self.light.select(F.col("class").alias("a"), "n", "packed")
        right = self.light.select(F.col("class").alias("b"), "n", "packed")
        with_b = pairs.join(right, "b").select("a", "place", "b", "n", "packed").alias("r")
        on = F.col("l.a") == F.col("r.a")
        if not self.few:
            left, on = dealt(left), on & (F.col("l.place") == F.col("r.place"))
        return with_b.join(left.alias("l"), on & _alike(self.s, self.s.hashes)).select("r.a", "r.place", "r.b")

    def first(self) -> DataFrame:
        """Links of all members to their buckets' pivots."""
        pairs = self.members.filter("class != pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
        return self.confirmed(pairs.distinct())

    def divided(self, labels: DataFrame) -> DataFrame:
        """``key, class, comp, degree`` and, of its bucket, ``largest, of_largest, others, head`` where it holds several components.

        ``head`` is the member with most links, of any component.
        """
        rows = self.members.select("key", "class").join(_maybe_broadcast(labels), "class", "left").select(
            "key", "class", F.coalesce("comp", "class").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree")
        )
        parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "class", "comp")).alias("head"))
        buckets = parts.groupBy("key").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("largest"), F.max("head").alias("head"), F.count(F.lit(1)).alias("parts")
        ).filter("parts > 1")
        buckets = buckets.select(
            "key", F.col("largest.comp").alias("largest"), F.col("largest.n").alias("of_largest"), (F.col("n") - F.col("largest.n")).alias("others"), "head"
        )
        return self.tables.keep("divided", rows.join(buckets, "key"))

    def second(self, rows: DataFrame) -> DataFrame:
        """Links of members of divided buckets to the one with most links so far, which is likely to have more."""
        apart = rows.filter("comp != head.comp").select(F.col("head.class").alias("a"), F.col("class").alias("b"))
        return self.confirmed(apart.distinct())

    def rest(self, rows: DataFrame) -> DataFrame:
        """Links between members of one bucket in different components.

        The bucket's largest component is dealt to blocks, and the others' members go
        to each of these, and to cells among themselves; so no task gets a whole bucket.
        """
        cell = self.s.cell
        left = self.tables.keep("left", rows.select("class").distinct())
        few = _maybe_broadcast(left)
        fine = _long(self.sets.join(few, "class", "left_semi"), self.s)
        # of the bands that two classes share, the first gives the pair
        bands = self.nodes.join(few, "class", "left_semi").select("class", F.transform("bands", _short).alias("bands"))
        fine = self.tables.keep("fine", fine.join(bands, "class"))
        rows = rows.join(F.broadcast(fine) if left.count() <= BROADCAST_ROWS // 10 else fine, "class").select(
            "key", "class", "comp", "largest", "of_largest", "others", "n", "packed", "bands", F.array_position("bands", _short(F.col("key"))).alias("band")
        )
        first = ~F.exists(F.sequence(F.lit(1), F.col("l.band")), lambda i: (i < F.col("l.band")) & (F.element_at("l.bands", i.cast("int")) == F.element_at("r.bands", i.cast("int"))))
        near = _alike(self.s, self.s.long_hashes) & first
        blocks = F.ceil(F.col("of_largest") / cell).cast("int")
        most = rows.filter("comp = largest").withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        others = rows.filter("comp != largest")
        spread = others.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        same = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block"))
        pairs = most.alias("l").join(spread.alias("r"), same & near).select(F.col("l.class").alias("a"), F.col("r.class").alias("b"))
        cells = F.ceil(F.col("others") / cell).cast("int")
        own = others.withColumn("own", F.pmod(F.xxhash64("class"), cells).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
        own = own.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        same = reduce(lambda p, q: p & q, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "lo", "hi")])
        # the two come from the two blocks of the cell
        apart = (F.col("l.comp") != F.col("r.comp")) & ((F.col("l.own") != F.col("r.own")) | (F.col("l.lo") == F.col("l.hi")))
        among = own.alias("l").join(own.alias("r"), same & (F.col("l.class") < F.col("r.class")) & apart & near)
        pairs = pairs.union(among.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")))
        return self.confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), alike=True)


def _decided(docs: DataFrame, id_col: str, text_col: str, s: Sketching) -> DataFrame:
    """``id, text_hash, n_shingles, component_id, kept`` for each row."""
    tables = Tables(docs.sparkSession, "neardup")
    text = utf8(text_col)
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sketched = tables.keep("sketched", sketches(picked, s))
    least = F.struct(F.col("id").isNull(), "id")
    nodes = sketched.filter("class IS NOT NULL").groupBy("class").agg(F.min_by(F.struct("id", "text_hash", "n", "bands", "packed"), least).alias("x"))
    nodes = tables.keep("nodes", nodes.select("class", "x.*"))
    links = _Links(picked, nodes, s, tables)
    edges = links.first()
    labels = components(edges, tables)
    rows = links.divided(labels)
    if rows.limit(1).count():
        more = links.second(rows)
        if more.limit(1).count():
            edges = edges.union(more)
            labels = components(edges, tables)
            rows = links.divided(labels)
        last = links.rest(rows)
        if last.limit(1).count():
            labels = components(edges.union(last), tables)
    named = nodes.select("class", "id").join(labels.select("class", "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least_id = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = tables.keep("by_class", named.join(least_id, "comp").select("class", "component_id"))
    tables.drop_all_but("sketched", "by_class")
    out = sketched.select("id", "text_hash", "class", "n").join(by_class, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    )


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", s: Sketching = Sketching()) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case.
    A document's set has its distinct 5-word shingles; with fewer words, the whole
    sequence.  A missing, empty or blank text has none and is linked with nothing;
    texts of any length are taken whole.
    ``component_id`` is the least id reachable over links and copies; ``kept`` is
    whether that is the row's own.  Missing ids are never representatives: such a
    row has its group's least other id, or if there is none, a missing component and is
    kept.  Of rows with the same id each is judged by its own text.  An empty table gives
    an empty result; other columns are not read.
    """
    return _decided(docs, id_col, text_col, s).drop("text_hash")


def unique(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", s: Sketching = Sketching()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one document of each group.

    Of rows with the same id one stays, too; rows without id stay unless their group has one with an id.
    Missing and empty texts stay, an empty table stays empty, and columns of any name are passed on.
    """
    tables = Tables(docs.sparkSession, "unique")
    decided = tables.keep("decided", _decided(docs, id_col, text_col, s))
    gone = tables.keep("gone", decided.filter(~F.col("kept")).select("id", "text_hash").distinct())
    own_id, own_hash, again_id = fresh(docs.columns, "gone_id", "gone_hash", "twice_id")
    gone = _maybe_broadcast(gone.select(F.col("id").alias(own_id), F.col("text_hash").alias(own_hash)), BROADCAST_IDS)
    known = docs.join(gone, (F.xxhash64(utf8(text_col)) == F.col(own_hash)) & F.col(id_col).eqNullSafe(F.col(own_id)), "left_anti")
    twice = decided.filter("kept AND id IS NOT NULL").groupBy("id").count().filter("count > 1").select(F.col("id").alias(again_id))
    twice = tables.keep("twice", twice)
    if twice.limit(1).count():
        again = known.join(twice, F.col(id_col) == F.col(again_id), "left_semi").dropDuplicates([id_col])
        return known.join(twice, F.col(id_col) == F.col(again_id), "left_anti").unionByName(again)
    return known
