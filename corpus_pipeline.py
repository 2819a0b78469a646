"""The corpus pipeline: documents in, pieces for training out.

``STAGES`` are applied in order; what a stage returns is written as Parquet and read
again as the next one's documents.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import mixing, neardup, pii, quality, spm
from ridgeline.llm.shared import new_folder

#: The PII field, the compression ratios and the pieces have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
SEED = 1
#: Five words and a similarity of 0.8; a pair there is missed by 46 bands of 6 with probability 8.4e-7.
NEAR = neardup.Sketching(percent=80, bands=46)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Missing, empty and short texts go, very long ones are judged whole; missing ids and
    repeated rows pass as they are; an empty table stays empty.
    """
    return quality.passing(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates.

    Missing and empty texts stay; rows without id stay unless their group has one with an
    id; of repeated rows one stays; an empty table stays empty.
    """
    return neardup.unique(docs, s=NEAR)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` is set anew.

    Missing texts stay missing, repeated rows are alike, an empty table stays empty.
    """
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source targets takes them: left out, once, or twice.

    Missing sources are one source; missing and empty texts cost nothing and are due like the
    shortest; repeated rows are all taken or none; an empty table stays empty.
    """
    return mixing.mix(docs, seed=f"pipeline-{SEED}")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_pieces, ids``: the pieces of each document taken, one row a copy, each copy cut on its own.

    Missing and empty texts have no pieces; missing ids are passed on; an empty table gives none.
    """
    out = spm.encode(docs.withColumn("key", F.struct("doc_id", "source")), id_col="key", seed=SEED, copies=True)
    return out.select("id.doc_id", "id.source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality", rules), ("near duplicates", deduplicate), ("personal data", mask), ("mix", mix), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
