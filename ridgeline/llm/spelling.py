"""Groups of spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut into two even segments.  One edit leaves one of them whole, so a
word near it, of equal length or one longer, has that segment at its place, or one place on.
Words meet in buckets of (length, segment); what lies between the segment and the word's other
end is verified to be one edit apart.  A bucket of many words is cut again: its words share
that segment, so one edit leaves one half of the rest whole too.  This goes on until buckets
are small or the rest is one letter, where the alphabet bounds them; no candidate is
dropped, and no bucket is compared all with all.

A pair that is found in two buckets counts in one: that of the rightmost place where the
letter may have come in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class Spelling:
    min_length: int = 6  # code points of a word
    min_count: int = 5  # occurrences of a word overall
    ratio: int = 5  # how many times as frequent a word's form is at least
    every: int = 199  # of that many occurrences one loses a letter
    bucket: int = 2048  # pairs that a bucket may hold before it is cut


def counted(docs: DataFrame, id_col: str, text_col: str, s: Spelling) -> DataFrame:
    """``word, n``: the words of all texts and how often they occur."""
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= s.min_length)  # a run that is shorter gives no word, with or without the letter
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(h % s.every == 0, cut).otherwise(F.col("run")).alias("word")
    return runs.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= s.min_length) & (F.col("n") >= s.min_count))


def _row(side: str, of: Column, left: Column, middle: Column, right: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), of.alias("l"), left.alias("left"), middle.alias("mid"), right.alias("right"))


def _cut(side: str, extra: int) -> list[Column]:
    """A row's two rows when its middle is cut at half the index word's: the letter is right of the cut, or left of it."""
    half = F.floor((F.length("mid") - extra) / 2).cast("int")
    return [
        _row(side, F.col("l"), F.concat("left", F.substring("mid", F.lit(1), half)), F.substring("mid", half + 1, F.length("mid")), F.col("right")),
        _row(side, F.col("l"), F.col("left"), F.substring("mid", F.lit(1), half + extra), F.concat(F.substring("mid", half + extra + 1, F.length("mid")), "right")),
    ]


def _segments(rows: DataFrame) -> DataFrame:
    cut = F.when(F.col("side") == "index", F.array(*_cut("index", 0))).otherwise(F.array(*_cut("probe", 1)))
    return rows.select("word", "n", F.explode(cut).alias("r")).select("word", "n", "r.*")


def _buckets(words: DataFrame, s: Spelling, keep: Tables) -> list[DataFrame]:
    """Rows of words (word, n, side, l, left, mid, right) in buckets (l, left, right) of at most ``s.bucket`` pairs, or with middles of one letter."""
    length, none = F.length("word"), F.lit("")
    sides = F.array(_row("index", length, none, F.col("word"), none), _row("probe", length - 1, none, F.col("word"), none))
    rows = _segments(words.select("word", "n", F.explode(sides).alias("r")).select("word", "n", "r.*"))
    done = []
    level, key = 0, ["l", "left", "right"]
    while True:
        rows = keep.keep(f"rows{level}", rows)
        sizes = rows.groupBy(*key).agg(F.count_if(F.col("side") == "index").alias("indexed"), F.count(F.lit(1)).alias("all"))
        sizes = sizes.filter("indexed > 0 AND all > 1")  # others have no pair
        hot = (F.col("indexed") * F.col("all") > s.bucket) & (F.col("l") - F.length("left") - F.length("right") > 1)
        sizes = keep.keep(f"sizes{level}", sizes.select(*key, hot.alias("hot")))
        done.append(rows.join(sizes.filter("NOT hot").drop("hot"), key, "left_semi"))
        if sizes.filter("hot").isEmpty():
            return done
        rows = _segments(rows.join(sizes.filter("hot").drop("hot"), key, "left_semi"))
        level += 1


def _near(rows: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: pairs of words one edit apart that share a bucket, each once."""
    a = rows.filter("side = 'index'").select("l", "left", "right", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mid").alias("a_mid"))
    b = rows.select("l", "left", "right", "side", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mid").alias("b_mid"))
    once = F.when(F.col("side") == "index", F.col("a") < F.col("b")).otherwise((F.col("right") == "") | ~F.col("b_mid").startswith(F.col("a_mid")))
    one_edit = F.levenshtein("a_mid", "b_mid", 1) == 1
    return a.join(b, ["l", "left", "right"]).filter(once & one_edit).select("a", "a_n", "b", "b_n")


def links(words: DataFrame, s: Spelling, keep: Tables) -> DataFrame:
    """``word, n_near, near, near_n`` of words with a near word; ``near`` is the most frequent one, of equal ones the first in order."""
    pairs = None
    for rows in _buckets(words, s, keep):
        found = _near(rows)
        pairs = found if pairs is None else pairs.unionByName(found)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    each = pairs.select(both.alias("r")).select("r.*")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n"))


def roots(forms: DataFrame, keep: Tables) -> DataFrame:
    """``word, root`` from ``word, form``: each word's form's form and so on, to the last.

    A form is several times as frequent as its word, so there are no circles, and each round doubles
    the steps that are taken: five or six rounds at most.
    """
    at = keep.keep("roots", forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        joined = keep.keep("roots", joined)
        if joined.filter("went").isEmpty():
            return joined.drop("went")
        at = joined.drop("went")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Spelling = Spelling()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word with enough letters and occurrences.

    Missing and empty texts have no words; a missing id is the empty text; repeated rows count
    as often as they are there; ties between near words go to the first in code-point order; an
    empty table gives no rows.  Other columns, of any name, are not read.
    """
    keep = Tables(docs.sparkSession, "spelling")
    words = keep.keep("words", counted(docs, id_col, text_col, s))
    near = keep.keep("links", links(words, s, keep))
    keep.drop_all_but("words", "links")
    all_words = words.join(near, "word", "left").withColumn("formed", F.coalesce(F.col("near_n") >= s.ratio * F.col("n"), F.lit(False)))
    out = all_words.select("word", F.when(F.col("formed"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("formed"), F.col("near_n")).alias("form_n"))
    last = roots(out.filter("form IS NOT NULL"), keep)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
