"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.tables import work_dir


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (as in tests, with a local master), a temporary one, set from now on."""
    return work_dir(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables of one call, in a folder of their own in the shared folder: compressed, and read back by few tasks if small."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = new_folder(spark, name)
        self.paths: dict[str, list[str]] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back, so that lost executors cost no recomputation."""
        path = f"{self.folder}/{name}-{sum(map(len, self.paths.values()))}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


#: Tables of numbers (up to 80 bytes a row) are broadcast if they have at most this many rows; else they are joined by shuffle.
BROADCAST_ROWS = 250_000


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
