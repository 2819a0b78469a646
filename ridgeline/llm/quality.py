"""Quality rules: compression bands over whole documents and fixed chunks."""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import release, text_blocks, utf8

_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_NOT_WORD_CHARS = _BLANK + bytes(range(0x80, 0xC0))  # white space and continuation bytes

SCHEMA = (
    "id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, chunks_out double, base_failed boolean, kept boolean"
)


_MANY = 50_000  # words


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size, by the text's bytes.

    ``whole`` has (up to bytes, least ratio, greatest ratio): short texts carry the
    frame's header and fill no window, so they may compress less and must repeat
    more before they are rejected.  Each chunk of ``chunk_bytes`` (a last one of
    half that at least) has its own band, and a text with more than ``max_out``
    of its chunks outside is rejected.
    """

    # the greatest ratios lie a little above those of natural text, which fall as texts get longer
    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.36, 1.20),
        (512, 0.36, 0.82),
        (768, 0.36, 0.74),
        (1024, 0.36, 0.69),
        (1536, 0.34, 0.64),
        (2048, 0.34, 0.60),
        (2560, 0.32, 0.57),
        (2816, 0.32, 0.54),
        (3072, 0.32, 0.526),
        (4096, 0.32, 0.524),
        (6144, 0.29, 0.515),
        (8192, 0.29, 0.495),
        (12288, 0.29, 0.48),
        (16384, 0.29, 0.47),
        (32768, 0.27, 0.455),
        (float("inf"), 0.27, 0.45),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.30, 0.527)
    max_out: float = 0.25
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for up_to, low, high in self.whole if size <= up_to)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) > _MANY:
        return _repeated_in_many(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    again = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def _repeated_in_many(words: list[bytes]) -> int:
    """The same for very long texts, with numbers for words and windows."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def measure(text: bytes, compressor: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    size = len(text)
    ratio = len(compressor.compress(text)) / size if size else 0.0
    out = n = 0
    if size > bands.chunk_bytes:
        for at in range(0, size, bands.chunk_bytes):
            part = text[at : at + bands.chunk_bytes]
            if len(part) * 2 >= bands.chunk_bytes:
                n += 1
                out += not bands.chunk[0] <= len(compressor.compress(part)) / len(part) <= bands.chunk[1]
    share = out / n if n else 0.0
    repeated = repeated_words(words)
    failed = len(words) < bands.min_words or 100 * repeated > bands.max_repeat_percent * len(words)
    low, high = bands.limits(size)
    return (
        len(words),
        len(text.translate(None, _NOT_WORD_CHARS)),
        size - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        ratio,
        share,
        failed,
        not failed and low <= ratio <= high and share <= bands.max_out,
    )


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Counts, compression ratios and verdict for each row: see ``SCHEMA``.

    A missing text is an empty one: no words, ratio 0, rejected for its length.
    Each row is judged by itself, so ties and repeated rows get equal verdicts,
    ids are passed on as they are (missing ones too), and an empty table gives an
    empty result.  Texts of any length are measured whole.  Other columns are not read.  No shuffle.
    """
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [measure(t, compressor, bands) for _, _, texts in text_blocks(batch.column("text")) for t in texts]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "chunks_out", "base_failed", "kept"],
            )
        release()

    return picked.mapInArrow(run, SCHEMA.format(id=picked.schema["id"].dataType.simpleString()))


def passing(docs: DataFrame, *, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, whose text the rules keep.

    Missing and empty texts go, repeated rows go or stay together, an empty table stays empty.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            for first, last, block in text_blocks(texts):
                keep = [bool(measure(t, compressor, bands)[-1]) for t in block]
                yield batch.slice(first, last - first).filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
