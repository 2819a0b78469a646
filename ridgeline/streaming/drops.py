"""Order files as a stream: each batch of new files rebuilds the months that it touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.pipeline import Warehouse
from ridgeline.sources import staging


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start a query that hands each batch of new CSV files, all columns as text, to ``handle``."""
    rows = spark.readStream.schema(schema).option("header", True).csv(folder).withColumn("file", F.col("_metadata.file_path"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def importer(house: Warehouse) -> Callable[[DataFrame, int], None]:
    """Merge a batch into the raw layer and rebuild its months; a batch that is handed over twice changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        names = [n for n in batch.columns if n != "file"]
        named = staging.of_columns(batch.toDF(*[n if n == "file" else staging.normal_header(n) for n in batch.columns]), list(map(staging.normal_header, names)))
        named = named.withColumn("source_row_number", F.monotonically_increasing_id())
        staged = staging.stage_orders(named, F.url_decode("file")).withColumn("imported_at", F.current_timestamp().cast("timestamp_ntz"))
        with house.writing(f"stream-{number}-{uuid.uuid4().hex}") as run:
            run.replace("staged_stream", staged)
            rows = house.table("staged_stream")
            if not (house.has("abnormal_orders") and not house.table("abnormal_orders").filter(F.col("run_id") == f"stream-{number}").isEmpty()):
                run.append("abnormal_orders", staging.abnormal(rows).withColumn("run_id", F.lit(f"stream-{number}")))
            rows = staging.accepted(rows)
            months = [r[0] for r in rows.select("order_month").distinct().collect()]
            if house._months("ods_orders") & set(months):
                old = house.table("ods_orders", months)
                rows = rows.unionByName(old.join(rows.select("order_id"), "order_id", "left_anti"), allowMissingColumns=True)
            house.build(run.replace_months("ods_orders", rows) if months else [], run)

    return handle
