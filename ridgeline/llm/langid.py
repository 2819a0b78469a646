"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import release, text_blocks, utf8
from ridgeline.llm.shared import checkpointed

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages whose probabilities a task holds at once (32 MB); more are gone through in groups of this many.
AT_ONCE = 256
_HELD = 64  # languages whose counts a task holds before it passes them on
_BLOCK = 1 << 19


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (where it is one character) and letterhood, of the first 65,536 code points."""
    lower = np.arange(0x10000, dtype=np.uint32)
    letter = np.zeros(0x10000, dtype=bool)
    for i in range(0x10000):
        c = chr(i)
        low = c.lower()
        if len(low) == 1:
            lower[i] = min(ord(low), 0xFFFF)
        letter[i] = c.isalpha()
    return lower, letter


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text each is of, and whether each text has a letter.

    Characters that are not letters count as one and the same separator.
    """
    lower, letter = _tables()
    decoded = [t.decode("utf-8", "replace") for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in decoded), dtype=np.int64, count=len(decoded))
    codes = np.frombuffer((" ".join(decoded) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(codes, 0xFFFF)
    is_letter = letter[low]
    for i in np.flatnonzero(codes > 0xFFFF):
        is_letter[i] = chr(codes[i]).isalpha()
    owner = np.repeat(np.arange(len(decoded)), lengths)
    has_letter = np.bincount(owner[is_letter], minlength=len(decoded)) > 0
    chars = np.where(is_letter, np.where(codes > 0xFFFF, codes, lower[low]), 32).astype(np.uint32)
    out, owners = [], []
    value = np.zeros(len(chars), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        value = (value[: len(chars) - n + 1] * np.uint32(0x01000193)) ^ (chars[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
            bucket = (mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)
            whole = owner[: len(bucket)] == owner[n - 1 :]  # not across two texts
            whole &= is_letter[: len(bucket)] | is_letter[n - 1 :]
            out.append(bucket[whole].astype(np.int32))
            owners.append(owner[: len(bucket)][whole])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([*out, empty.astype(np.int32)]), np.concatenate([*owners, empty]), has_letter


def fit(docs: DataFrame, train: Column, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[np.ndarray]]:
    """Languages in order and their log-probability matrices, ``BUCKETS + 1`` rows each (the last: log priors), for ``AT_ONCE`` languages each.

    All rows with ``train`` true and a language are counted.  Each task adds up
    its own counts, and those of all tasks are added by language and bucket.  A language
    takes 128 KB, on the driver as well.
    """
    rows = docs.filter(train & F.col(lang_col).isNotNull()).select(
        utf8(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                own = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "bucket": own.astype(np.int32), "n": counts[own]})
            total.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, last, texts in text_blocks(batch.column("text"), _BLOCK):
                bucket, owner, _ = features(texts)
                names = langs[first:last]
                for lang in set(names):
                    mine = np.fromiter((x == lang for x in names), dtype=bool, count=len(names))
                    counts = total.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                    counts[:BUCKETS] += np.bincount(bucket[mine[owner]], minlength=BUCKETS)
                    counts[BUCKETS] += mine.sum()
                    if len(total) >= _HELD:
                        yield from sums()
        yield from sums()
        release()

    counted = checkpointed(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    seen = counted.filter(F.col("bucket") == BUCKETS).select("lang", "n").collect()  # a row a language
    langs = sorted((r.lang for r in seen), key=lambda x: [ord(c) for c in x])
    texts = float(max(1, sum(r.n for r in seen)))
    models = []
    for at in range(0, len(langs), AT_ONCE):
        some = langs[at : at + AT_ONCE]
        table = (counted if len(langs) <= AT_ONCE else counted.filter(F.col("lang").isin(some))).toArrow()
        place = {x: i for i, x in enumerate(some)}
        counts = np.zeros((BUCKETS + 1, len(some)))
        counts[table.column("bucket").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
        model = np.zeros((BUCKETS + 1, len(some)), dtype=np.float32)
        model[:BUCKETS] = np.log(counts[:BUCKETS] + 0.5) - np.log(counts[:BUCKETS].sum(axis=0) + 0.5 * BUCKETS)
        model[BUCKETS] = np.log(counts[BUCKETS]) - np.log(texts)
        models.append(model)
    return langs, models


def predict(
    docs: DataFrame, langs: list[str], models: list[np.ndarray], *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, lang_pred, score`` for each row: the likeliest language and its probability.

    ``und`` with score 0 where the text is missing or has no letter, or where
    nothing was learned; of equal likelihoods the first language by code point.
    Texts of any length are read whole.  Repeated rows get equal predictions; missing ids
    are passed on; an empty table gives an empty result; other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.withColumns({"best": F.lit(None).cast("string"), "top": F.lit(float("-inf")), "mass": F.lit(0.0)})
    for i, model in enumerate(models):  # one pass a group of languages, one after the other in the same task
        out = _pass(out, langs[i * AT_ONCE : (i + 1) * AT_ONCE], model, kind)
    found = F.col("best").isNotNull()
    return out.select(
        "id", F.coalesce("best", F.lit("und")).alias("lang_pred"), F.when(found, 1.0 / F.nullif("mass", F.lit(0.0))).otherwise(0.0).alias("score")
    )


def _pass(docs: DataFrame, names: list[str], model: np.ndarray, kind: str) -> DataFrame:
    """The rows with ``best``, the likeliest language so far, ``top``, its log-probability, and ``mass``, all languages' probability over its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        columns = [np.ascontiguousarray(matrix[:BUCKETS, k]) for k in range(len(names))]
        for batch in batches:
            best, top, mass = batch.column("best").to_pylist(), batch.column("top").to_numpy().copy(), batch.column("mass").to_numpy().copy()
            for first, last, texts in text_blocks(batch.column("text"), _BLOCK):
                bucket, owner, has_letter = features(texts)
                sums = np.stack([np.bincount(owner, weights=c[bucket], minlength=last - first) for c in columns], axis=1)
                sums += matrix[BUCKETS]
                own = sums.max(axis=1)
                here, before = np.maximum(own, top[first:last]), top[first:last]
                with np.errstate(invalid="ignore"):
                    was = np.where(np.isfinite(before), mass[first:last] * np.exp(before - here), 0.0)
                mass[first:last] = was + np.exp(sums - here[:, None]).sum(axis=1)
                for i in np.flatnonzero((own > before) & has_letter).tolist():
                    best[first + i] = names[sums[i].argmax()]
                top[first:last] = here
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(best, pa.string()), pa.array(top), pa.array(mass)], names=["id", "text", "best", "top", "mass"]
            )
        release()

    return docs.mapInArrow(run, f"id {kind}, text binary, best string, top double, mass double")
