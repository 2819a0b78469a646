"""Tables in folders: month replacement, small upserts, and mart publication."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; where none is set, as in tests, a temporary one of a local master."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """Length and time of change of files or folders' files: different once anything was written."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
    return tuple(out)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything but marks."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def replace_months(df: DataFrame, path: str, column: str = "order_month", parts: int = 1, key: str = "order_id") -> None:
    """Write the rows of ``df``; months that it has are replaced whole, all others stay.

    Rows are brought together by month, and adaptive execution cuts a large month into several files.  It cuts between the
    outputs of tasks only: where few tasks make a month's rows, ``parts`` deals these by their key first, so that sorting a piece fits the memory.
    """
    if parts == 1:
        rows = df.hint("rebalance", column)
    else:
        rows = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts))).hint("rebalance", column, "__part").drop("__part")
    rows.write.partitionBy(column).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def drop_partners(df: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Without the rows of some partners; rows without partner stay."""
    return df.filter(F.col("partner_id").isNull() | ~F.col("partner_id").isin(*excluded)) if excluded else df


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Replace the rows of a small table that share the new rows' keys, and add the others."""
    if exists(spark, path):
        old = spark.read.parquet(path)
        rows = rows.unionByName(old.join(rows.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # a control table: a row a partner or file
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def set_sla(spark: SparkSession, path: str, partner_id: str, minutes: int, effective: str) -> None:
    """A partner's service level; ValueError outside of 1 to 240 minutes."""
    if not 1 <= minutes <= 240:
        raise ValueError("service level must be 1 to 240 minutes")
    row = spark.createDataFrame([(partner_id, int(minutes), effective)], "partner_id string, sla_minutes int, effective_date string")
    upsert(spark, path, row, ["partner_id"])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may have been written before some columns were added."""
    return spark.read.option("mergeSchema", True).parquet(path)


def together(jobs: list[Callable[[], None]], at_once: int = 4) -> None:
    """Run jobs a few at a time, so that small ones do not leave the cluster idle; the first that failed is raised when all have ended."""
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def publish(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write all tables beside the published folder and swap them in whole; rows of each.

    A failure while writing or swapping leaves the published folder as it was.  Any file system of Spark's will do.
    """
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(root.rstrip("/"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = (path(target.getParent(), f".{target.getName()}-{k}-{uuid.uuid4().hex[:8]}") for k in ("new", "old"))
    try:
        seen = {name: Observation() for name in tables}

        def write(name: str) -> None:
            tables[name].observe(seen[name], F.count(F.lit(1)).alias("rows")).write.option("compression", "snappy").parquet(f"{fresh}/{name}.parquet")

        together([partial(write, name) for name in tables])
        rows = {name: o.get["rows"] for name, o in seen.items()}
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{root} cannot be moved")
        if not fs.rename(fresh, target):
            if fs.exists(old):
                fs.rename(old, target)
            raise OSError(f"{root} cannot be replaced")
    finally:
        fs.delete(fresh, True)
        fs.delete(old, True)
    return rows
