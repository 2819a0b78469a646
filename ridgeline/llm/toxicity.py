"""Toxicity: class-conditional Kneser-Ney models of the words' letters.

A word's probability in a class is the product of its letters' given the few bytes
before, from the class's own counts, discounted, and beyond them from backoff
probabilities that both classes share.  So an expression that was seen too rarely
to tell leaves both classes alike.  A text's two log-likelihoods are each divided by its
length in words.  Their difference, and the logarithm of the length, which says how far the
difference can be trusted, are turned into a probability by three numbers fitted on a part
of the labelled rows that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import Block, release, text_blocks, utf8
from ridgeline.llm.shared import shared_dir

_KEEP = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``max_docs`` bounds the expected number of labelled rows of each class that are learned from
    (chosen by a hash of the id), and with them the letter sequences counted."""

    order: int = 4
    discount: float = 0.95
    max_docs: int = 20_000


@dataclass
class Model:
    grams: np.ndarray
    gram_llr: np.ndarray
    contexts: np.ndarray
    context_llr: np.ndarray
    slope: float = 1.0
    by_length: float = 0.0
    offset: float = 0.0


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Block, np.ndarray]:
    """Distinct words of a block, and for each text its distinct words with damped counts.

    Returns (text, word, weight) of each pair, the block, and each word's first place in it.
    """
    lowered = [t.decode("utf-8", "replace").lower().encode("utf-8", "surrogatepass").translate(_KEEP) for t in texts]
    block = Block(lowered, lower=False)
    _, first, word = np.unique(block.hashes(), return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), block.counts)
    pair, n = np.unique(owner * max(1, len(first)) + word, return_counts=True)
    weight = 1 + np.floor(np.log2(n))  # a word said often says little more
    return pair // max(1, len(first)), pair % max(1, len(first)), weight, block, first


def _grams(block: Block, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``order``-byte sequences of the words, begun and ended by marks, and the word of each."""
    start, size = block.start[first], (block.end - block.start)[first]
    total = size + order  # order - 1 marks before, one after
    word = np.repeat(np.arange(len(first)), total)
    begin = np.cumsum(total) - total
    at = np.arange(total.sum()) - begin[word]
    source = start[word] + at - (order - 1)
    inside = (at >= order - 1) & (at < total[word] - 1)
    letters = np.where(at < order - 1, 1, 2).astype(np.uint64)
    letters[inside] = block.bytes[source[inside]]
    value = np.zeros(len(letters), dtype=np.uint64)
    for j in range(order):
        shifted = np.zeros_like(value)
        shifted[j:] = letters[: len(letters) - j]
        value |= shifted << np.uint64(8 * j)
    whole = at >= order - 1
    return value[whole], word[whole]


def _count(docs: DataFrame, s: Settings) -> DataFrame:
    """``gram, toxic, ordinary`` of labelled texts (text bytes, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
            for a, b, texts in text_blocks(batch.column("text"), _BLOCK):
                owner, word, weight, block, first = _words(texts)
                if not len(first):
                    continue
                toxic = labels[a:b][owner] == 1
                gram, of = _grams(block, first, s.order)
                distinct, inverse = np.unique(gram, return_inverse=True)
                sums = [
                    np.bincount(inverse, np.bincount(word[m], weight[m], minlength=len(first))[of], minlength=len(distinct))
                    for m in (toxic, ~toxic)
                ]
                yield pa.RecordBatch.from_pydict({"gram": distinct.view(np.int64), "toxic": sums[0], "ordinary": sums[1]})

    counted = docs.mapInArrow(run, "gram long, toxic double, ordinary double")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _shared(grams: np.ndarray, s: Settings) -> np.ndarray:
    """Backoff probability of each gram's last letter given one byte less of context.

    By continuation counts: of how many different letters to the left a sequence is
    seen after, in either class.
    """
    def tail(x: np.ndarray, n: int) -> np.ndarray:
        return x & np.uint64((1 << (8 * n)) - 1)

    levels, current = [], tail(grams, s.order - 1)
    for n in range(s.order - 1, 0, -1):
        values, left = np.unique(current, return_counts=True)
        levels.append((n, values, left.astype(float)))
        current = tail(values, n - 1)
    known = probability = np.zeros(0)
    for n, values, left in reversed(levels):
        _, at = np.unique(values >> np.uint64(8), return_inverse=True)
        all_left, kinds = np.bincount(at, left), np.bincount(at)
        lower = 1 / 256 if n == 1 else probability[np.searchsorted(known, tail(values, n - 1))]
        probability = np.maximum(left - s.discount, 0) / all_left[at] + s.discount * kinds[at] / all_left[at] * lower
        known = values
    return probability[np.searchsorted(known, tail(grams, s.order - 1))]


def _ratios(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, s: Settings) -> Model:
    order = np.argsort(grams)
    grams, counts = grams[order], (toxic[order], ordinary[order])
    if not len(grams):
        none = np.zeros(0)
        return Model(grams, none, grams, none)
    backoff = _shared(grams, s)
    contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    logs, rests = [], []
    for c in counts:
        total, kinds = np.bincount(at, c), np.bincount(at, c > 0)
        rest = np.where(total > 0, s.discount * kinds / np.maximum(total, 1), 1.0)
        own = np.where(total[at] > 0, np.maximum(c - s.discount, 0) / np.maximum(total[at], 1), 0.0)
        logs.append(np.log(own + rest[at] * backoff))
        rests.append(np.log(rest))
    return Model(grams, logs[0] - logs[1], contexts, rests[0] - rests[1])


def _differences(texts: list[bytes], model: Model, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Each text's log-likelihood as toxic less that as ordinary, both by its length, and the logarithm of the length."""
    owner, word, weight, block, first = _words(texts)
    if not len(first) or not len(model.grams):
        return np.zeros(len(texts)), np.zeros(len(texts))
    gram, of = _grams(block, first, s.order)
    place = np.minimum(np.searchsorted(model.grams, gram), len(model.grams) - 1)
    context = gram >> np.uint64(8)
    around = np.minimum(np.searchsorted(model.contexts, context), len(model.contexts) - 1)
    unseen = np.where(model.contexts[around] == context, model.context_llr[around], 0.0)
    by_word = np.bincount(of, np.where(model.grams[place] == gram, model.gram_llr[place], unseen), minlength=len(first))
    total = np.bincount(owner, by_word[word] * weight, minlength=len(texts))
    length = np.bincount(owner, weight, minlength=len(texts))
    length = np.maximum(length, 1)
    return total / length, np.log(length)


def _fit_line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic regression of y on the columns of x, with a small ridge."""
    if not len(y) or y.min() == y.max():
        n = (y == 1).sum()
        return np.array([1.0, *np.zeros(x.shape[1] - 1), np.log((n + 0.5) / (len(y) - n + 1.5))])
    scale = np.maximum(x.std(axis=0), 1e-9)
    rows, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (y - p) - 0.01 * w
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([*(w[:-1] / scale), w[-1]])


def _scored(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """``docs`` (id, text bytes, more) with the text replaced by the difference ``x`` and the logarithm ``l`` of the length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_differences(texts, shared.value, s) for _, _, texts in text_blocks(batch.column("text"), _BLOCK)]
            both = [pa.array(np.concatenate([*[pair[k] for pair in x], np.zeros(0)])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *both], names=[*rest, "x", "l"])
        release()

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{fields}, x double, l double")


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings()
) -> Model:
    """Learn from the labelled rows: ``labels`` has the id, the label (1 toxic, 0 not, missing ignored) and ``part``.

    Rows of part 0 give the counts, those of part 1 the three numbers of the
    probability.  An id labelled twice counts as toxic if it once is.  Of each
    class at most about ``s.max_docs`` rows are taken, and as many ordinary ones as
    toxic, so that neither class's counts are denser than the other's.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic"), F.min("part").alias("part")
    )
    n = {(r.part, r.toxic): r["count"] for r in known.groupBy("part", "toxic").count().collect()}
    most = min(s.max_docs, n.get((0, 1), 0) or s.max_docs)
    calibrating = n.get((1, 0), 0) + n.get((1, 1), 0)
    share = {
        (0, 1): s.max_docs / max(1, n.get((0, 1), 0)),
        (0, 0): most / max(1, n.get((0, 0), 0)),
        (1, 1): s.max_docs / max(1, calibrating),
        (1, 0): s.max_docs / max(1, calibrating),
    }
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    limit = F.lit(0.0)
    for (part, toxic), x in share.items():
        limit = F.when((F.col("part") == part) & (F.col("toxic") == toxic), F.lit(min(1.0, x))).otherwise(limit)
    # about 3 * max_docs rows at most, so the ids may go to every task
    sample = known.filter(draw < limit)
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(sample), "id")
    shared_dir(docs.sparkSession)  # the checkpoint goes there
    counted = _count(texts.filter("part = 0").select("text", "toxic"), s).checkpoint()
    table = counted.toArrow()
    model = _ratios(
        table.column("gram").to_numpy().view(np.uint64), table.column("toxic").to_numpy(), table.column("ordinary").to_numpy(), s
    )
    seen = _scored(texts.filter("part = 1").select("text", "toxic"), model, s).toArrow()
    x = np.column_stack([seen.column("x").to_numpy(), seen.column("l").to_numpy()])
    model.slope, model.by_length, model.offset = map(float, _fit_line(x, seen.column("toxic").to_numpy().astype(float)))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """``id, score`` for each row: the probability that its text is toxic.

    A missing text, or one without letters, has that of no evidence; texts of any length are
    read whole.  Ids are passed on as they are, repeated rows get equal scores, an empty table gives an empty
    result, and other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    log_odds = F.lit(model.slope) * F.col("x") + F.lit(model.by_length) * F.col("l") + F.lit(model.offset)
    return _scored(picked, model, s).select("id", (1 / (1 + F.exp(-log_odds))).alias("score"))
