"""Mixing sources to target weights by Pareto order sampling.

Everything is DataFrame code: the rows are never sorted as a whole and no
source is gathered in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.shared import checkpointed, fresh

BINS = 4096
#: A plan of at most this many sources is broadcast to the rows; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
_UNIT = float(1 << 52)


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), volume: float = 1.5, max_copies: int = 2
) -> DataFrame:
    """Targets by weight: ``source, source_size, target``.

    ``sizes`` has one row a source, and may have more columns, which stay.  Sources in order of code point (missing
    last) take the weights in turn and share ``volume`` times all words; no
    target exceeds ``max_copies`` times its source's words, and what lies above
    is shared again by weight among the others.  The limit binds the sources
    with the least room for their weight first, which makes one pass over the
    sources in that order enough.
    """
    # windows over all sources: a row a source, never a row a document
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by_room = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    named = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    ordered = named.select(
        "*",
        (F.sum("source_size").over(everything).cast("double") * volume).alias("volume"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    full = F.col("cap") * F.col("weight_from") <= F.col("weight") * (F.col("volume") - F.col("cap_before"))
    split = ordered.withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    left = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.col("weight") * ((F.col("volume") - spent) / F.nullif(left, F.lit(0.0)))
    return split.select(
        *sizes.columns, F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target")
    )


def _by_source(rows: DataFrame, plan: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """Rows with their source's plan; if the sources are few, without moving the rows."""
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("s")), how)


def _by_weight(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("o"))
    return rows.join(F.broadcast(plan) if few else plan, on, "left")


def _own(size: Column, weight: Column | None) -> Column:
    """A document's inclusion weight, a power of two, so that a source has few: about the root of its words, or the given weight rounded down."""
    if weight is None:
        return F.pow(F.lit(2.0), F.floor(F.length(F.bin(size)) / 2))
    w = weight.cast("double")
    return F.when(w > 0, F.pow(F.lit(2.0), F.floor(F.log2(w) + F.lit(1e-9)))).otherwise(F.lit(0.0))


def _rank(u: Column, due: Column) -> tuple[Column, Column]:
    """Certain copies of a document, and its rank for one more: random odds over inclusion odds (null: none is due)."""
    due = F.coalesce(due, F.lit(0.0))
    whole = F.floor(due).cast("int")
    p = due - whole
    return whole, F.when(p <= 0, F.lit(None).cast("double")).otherwise((u * (F.lit(1.0) - p)) / ((F.lit(1.0) - u) * p))


def _dues(parts: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``s, o, size, source_size, target, due``: the copies due to each weight of each source.

    They are in proportion to the weights, at most ``max_copies``, and what lies above
    is shared again among the lighter documents, so that the words due are the source's target.
    """
    most = F.lit(float(max_copies))
    of_source = Window.partitionBy("source")
    heaviest_first = of_source.orderBy(F.col("own").desc())
    joined = targets.withColumnRenamed("source", "s").join(parts, F.col("source").eqNullSafe(F.col("s")))
    laid = joined.select(
        "*", F.coalesce(F.sum("size").over(heaviest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("heavier"),
        F.sum(F.col("own") * F.col("size")).over(heaviest_first.rowsBetween(0, Window.unboundedFollowing)).alias("mass"),
    )
    full = (F.col("own") > 0) & (most * F.col("mass") <= F.col("own") * (F.col("target") - most * F.col("heavier")))
    laid = laid.withColumn("full", full)
    left = F.col("target") - F.sum(F.when(F.col("full"), most * F.col("size")).otherwise(0.0)).over(of_source)
    mass = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("own") * F.col("size"))).over(of_source)
    share = F.col("own") * (left / F.nullif(mass, F.lit(0.0)))
    due = F.when(F.col("full"), most).otherwise(F.least(most, F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))))
    return laid.select("s", F.col("own").alias("o"), "size", "source_size", "target", due.alias("due"))


def copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    volume: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix-1",
    checkpoint: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Decide how often each document is taken.

    Returns the ranked documents ``id, source, size, whole, q``, the plan of each source and
    weight ``s, o, due``, that of each source ``s, source_size, target, cut``, and
    whether these are few enough to broadcast.  A document is taken ``whole`` times, and once
    more if its rank ``q`` is at most ``cut``.

    Each document's expected number of copies is in proportion to its weight: a power
    of two near the root of its words, or ``weight_col`` rounded down to one (missing,
    negative or 0: never taken); together a source's documents are due its target.  The
    whole copies are certain; for the rest, with inclusion odds p / (1 - p), the
    documents are ranked by random odds over inclusion odds, and those lowest
    in rank are taken until their words are as near the words still due as they
    come.  The place to cut is found from sums by bins of the rank, then inside
    one bin, so no source is sorted in one task.

    Missing text or no words: size 0, taken with its rank at no cost.  Missing
    sources are one source, last in order.  Repeated rows have one rank: all or
    none are taken.  Texts of any length are counted whole.  An empty table gives empty
    results.  Other columns are not read, whatever their names.
    """
    size = word_count(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), uniform(F.col(id_col), seed).alias("u"),
        _own(size, F.col(weight_col) if weight_col else None).alias("own"),
    )
    if checkpoint:
        keyed = checkpointed(keyed)  # the texts are read once; only these few columns are kept
    parts = keyed.groupBy("source", "own").agg(F.sum("size").alias("size"))
    few = parts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    targets = source_targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, volume, max_copies)
    dues = _dues(parts, targets, max_copies)
    plan = dues.select("s", "o", "due")
    ranked = _by_weight(keyed, plan, few).drop("s", "o").withColumns(dict(zip(("whole", "q"), _rank(F.col("u"), F.col("due")), strict=True)))
    rest = ranked.filter(F.col("q").isNotNull())
    need = dues.groupBy(F.col("s").alias("source")).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum(F.floor("due") * F.col("size")).alias("certain")
    ).withColumn("need", F.col("target") - F.col("certain"))
    bin_of = F.floor(F.col("q") / (F.col("q") + 1) * BINS).cast("int")
    in_bins = rest.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = in_bins.withColumn("through", F.sum("size").over(up_to))
    needs = need.select(F.col("source").alias("s"), "need")
    crossing = (
        bins.join(needs, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("through") >= F.col("need")) & (F.col("through") - F.col("size") < F.col("need")))
        .groupBy(F.col("source").alias("s")).agg(F.min_by("need", "bin").alias("need"), F.min_by(F.col("through") - F.col("size"), "bin").alias("before"), F.min("bin").alias("b"))
    )
    inside = (
        _by_source(rest.withColumn("bin", bin_of), crossing, few, "inner")
        .filter(F.col("bin") == F.col("b"))
        .groupBy("source", "q").agg(F.sum("size").alias("size"), F.max("need").alias("need"), F.max("before").alias("before"))
    )
    walk = Window.partitionBy("source").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = inside.withColumn("through", F.col("before") + F.sum("size").over(walk))
    # the document that crosses the line is taken if that comes nearer than to leave it
    without = F.col("through") - F.col("size")
    fits = (F.col("through") <= F.col("need")) | (
        (without < F.col("need")) & (F.col("need") - without > F.col("through") - F.col("need"))
    )
    cuts = steps.groupBy(F.col("source").alias("s")).agg(
        F.max(F.when(fits, F.col("q"))).alias("cut_in"), F.min("q").alias("first")
    )
    # no bin crosses: all of the rest is due.  The bin crosses at its first document, left out: cut just below it.
    cut = F.when(F.col("first").isNull(), F.when(F.col("need") > 0, F.lit(float("inf"))).otherwise(F.lit(-1.0))).otherwise(
        F.coalesce(F.col("cut_in"), F.col("first") * F.lit(1.0 - 2.0**-50))
    )
    plans = (
        need.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("cut", cut)
        .select(F.col("source").alias("s"), "source_size", "target", "cut")
    )
    return ranked.select("id", "source", "size", "whole", "q"), plan, plans, few


def taken(docs: DataFrame, **options) -> DataFrame:
    """``id, size, source_size, target, copies, taken`` for each row of ``docs``; see :func:`copies`."""
    ranked, _, plans, few = copies(docs, **options)
    extra = (F.col("q") <= F.col("cut")).cast("int")
    n = F.col("whole") + F.coalesce(extra, F.lit(0))
    return _by_source(ranked, plans, few).select(
        "id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), n.alias("copies"), (n * F.col("size")).cast("long").alias("taken"),
    )


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: str = "mix-1", **options
) -> DataFrame:
    """The mixed corpus: each row of ``docs``, with all its columns, as often as it is taken; see :func:`copies`.

    The texts are not moved: each row finds its number of copies from its id, its weight and its source's plan.
    """
    _, plan, plans, few = copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, weight_col=weight_col, seed=seed, **options)
    plan = plan.join(plans.select(F.col("s").alias("t"), "cut"), F.col("s").eqNullSafe(F.col("t"))).select("s", "o", F.struct("due", "cut").alias("p"))
    s, o, p, own, copy = fresh(docs.columns, "mix_source", "mix_weight", "mix_plan", "mix_own", "mix_copy")
    plan = plan.select(F.col("s").alias(s), F.col("o").alias(o), F.col("p").alias(p))
    rows = docs.withColumn(own, _own(word_count(F.col(text_col)), F.col(weight_col) if weight_col else None))
    on = F.col(source_col).cast("string").eqNullSafe(F.col(s)) & (F.col(own) == F.col(o))
    rows = rows.join(F.broadcast(plan) if few else plan, on, "left")
    whole, q = _rank(uniform(F.col(id_col), seed), F.col(f"{p}.due"))
    n = whole + F.coalesce((q <= F.col(f"{p}.cut")).cast("int"), F.lit(0))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n))).drop(s, o, p, own, copy)
