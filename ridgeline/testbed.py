"""Delivery orders and rosters derived from the star-schema test tables, by fixed arithmetic on their keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import sizes

#: The test tables that the orders are made from.
TABLES = ("orders", "supplier", "nation", "region")


@dataclass(frozen=True)
class Inputs:
    orders: DataFrame
    riders: DataFrame
    merchants: DataFrame
    partners: DataFrame


def _text(c: Column) -> Column:
    return c.cast("string")


def _day(number: Column) -> Column:
    """A roster's date: 2026-01-01 and up to 119 days on."""
    return F.date_add(F.lit("2026-01-01").cast("date"), (number * 47 % 120).cast("int"))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def after(base: Column, seconds: Column) -> Column:
        return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    places = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n_suppliers = table("supplier").count()
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    create = after(F.lit("2026-03-01 00:00:00").cast("timestamp_ntz"), k * 7919 % 5270400)
    base = table("orders").join(sizes.beside(suppliers), F.col("s_suppkey") == F.col("o_custkey") % n_suppliers, "left").withColumn("create_time", create)
    # every 50th order was imported once before, as not yet done
    twice = F.when(k % 50 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    base = base.withColumn("early", F.explode(twice))
    base = base.withColumns({
        "pay_time": F.when(k % 13 != 0, after(F.col("create_time"), (1 + k % 8) * 60)),
        "accept_time": F.when(~((status == "O") & (k % 5 < 3)), after(F.col("create_time"), (2 + k % 18) * 60)),
    })
    rider = k % 503
    done, early = status == "F", F.col("early")
    orders = base.select(
        _text(k).alias("order_id"),
        F.date_format("create_time", "yyyy-MM").alias("order_month"),
        _text(F.col("s_nationkey")).alias("partner_id"),
        F.lit(None).cast("string").alias("partner_name"),
        _text(F.col("s_suppkey")).alias("merchant_id"),
        F.col("s_name").alias("merchant_name"),
        _text(F.col("o_custkey")).alias("user_id"),
        _text(rider).alias("rider_id"),
        F.lit(None).cast("string").alias("rider_name"),
        F.when(rider % 10 < 6, "全职").when(rider % 10 < 9, "兼职").alias("employment_status"),
        F.when(early, "配送中").when(done, "已完成").when((status == "O") & (k % 4 == 0), "已取消（无责）").when(status == "O", "已取消").otherwise("配送中").alias("order_status"),
        F.concat(F.lit("CS"), _text(k % 7)).alias("customer_service_id"),
        F.when(k % 29 != 0, F.col("o_orderpriority")).alias("order_source"),
        "create_time", "pay_time", "accept_time",
        F.when(~early & (status == "O"), after(F.coalesce("pay_time", "create_time"), (2 + k % 35) * 60)).alias("cancel_time"),
        F.when(~early & done, after(F.col("accept_time"), (12 + k % 42) * 60)).alias("complete_time"),
        (F.round("o_totalprice") / 100).alias("order_price"),
        (F.round("o_totalprice") / 100).alias("amount_payable"),
        (F.round("o_totalprice") / 100).alias("amount_paid"),
        ((k % 7) * F.lit(0.5)).alias("hq_discount_amount"),
        ((k % 5) * F.lit(0.75)).alias("discount_amount"),
        F.when(k % 5 != 0, F.concat(F.lit("C"), _text(k))).alias("coupon_id"),
        F.when(k % 6 == 0, F.concat(F.lit("M"), _text(k))).alias("marketing_coupon_id"),
        F.when(done, F.lit(4.2) + (k % 45) / F.lit(10.0)).otherwise(F.lit(0.0)).alias("rider_income"),
        F.when(done, F.lit(1.1) + (k % 26) / F.lit(10.0)).otherwise(F.lit(0.0)).alias("partner_income"),
        F.when(done, F.lit(0.5)).otherwise(F.lit(0.0)).alias("hq_income"),
        F.when(done, F.lit(0.2)).otherwise(F.lit(0.0)).alias("maiyatian_income"),
        F.lit(0.1).alias("insurance_fee"),
        F.when(early, F.lit("2026-04-30 00:00:00").cast("timestamp_ntz")).otherwise(F.lit("2026-05-01 00:00:00").cast("timestamp_ntz")).alias("imported_at"),
        k.alias("source_row_number"),
    )
    ids = table("orders").select(rider.alias("id")).distinct()
    riders = ids.select(
        _text(F.col("id")).alias("rider_id"), F.concat(F.lit("骑手"), _text(F.col("id"))).alias("rider_name"), _day(F.col("id")).alias("hire_date"),
        F.lit("在职").alias("status"), F.lit(None).cast("string").alias("partner_name"), F.lit(None).cast("string").alias("region"),
    )
    merchants = suppliers.select(
        _text(F.col("s_suppkey")).alias("merchant_id"), F.col("s_name").alias("merchant_name"),
        F.concat(F.lit("店"), _text(F.col("s_suppkey"))).alias("shop_name"), F.col("n_name").alias("partner_name"), F.col("r_name").alias("region"),
        _day(F.col("s_suppkey")).alias("register_date"), F.lit("营业").alias("status"),
    )
    partners = places.select(
        _text(F.col("n_nationkey")).alias("partner_id"), F.concat(F.lit("合伙人"), F.col("n_name")).alias("partner_name"),
        _day(F.col("n_nationkey")).alias("open_date"), F.col("r_name").alias("province"), F.col("n_name").alias("city"),
        F.lit(None).cast("string").alias("district"), F.concat_ws(" ", "r_name", "n_name").alias("region_raw"), F.lit("正常").alias("status"),
    )
    return Inputs(orders, riders, merchants, partners)


#: The same as SQL: common table expressions for the oracles.
SQL = """
places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
rider_roster AS (
  SELECT CAST(i AS VARCHAR) AS rider_id, '骑手' || i AS rider_name, DATE '2026-01-01' + CAST(i * 47 % 120 AS INTEGER) AS hire_date,
         '在职' AS status, CAST(NULL AS VARCHAR) AS partner_name, CAST(NULL AS VARCHAR) AS region FROM (SELECT DISTINCT o_orderkey % 503 AS i FROM orders)),
merchant_roster AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS merchant_id, s_name AS merchant_name, '店' || s_suppkey AS shop_name, n_name AS partner_name,
         r_name AS region, DATE '2026-01-01' + CAST(s_suppkey * 47 % 120 AS INTEGER) AS register_date, '营业' AS status
  FROM supplier LEFT JOIN places ON s_nationkey = n_nationkey),
partner_roster AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS partner_id, '合伙人' || n_name AS partner_name, DATE '2026-01-01' + CAST(n_nationkey * 47 % 120 AS INTEGER) AS open_date,
         r_name AS province, n_name AS city, CAST(NULL AS VARCHAR) AS district, r_name || ' ' || n_name AS region_raw, '正常' AS status FROM places),
timed AS (
  SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN create_time + to_seconds((1 + o_orderkey % 8) * 60) END AS pay_time,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 < 3 THEN NULL ELSE create_time + to_seconds((2 + o_orderkey % 18) * 60) END AS accept_time
  FROM (SELECT *, TIMESTAMP '2026-03-01 00:00:00' + to_seconds(o_orderkey * 7919 % 5270400) AS create_time FROM orders) o
  LEFT JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier)),
latest AS (
  SELECT CAST(k AS VARCHAR) AS order_id, strftime(create_time, '%Y-%m') AS order_month, CAST(s_nationkey AS VARCHAR) AS partner_id,
         CAST(s_suppkey AS VARCHAR) AS merchant_id, s_name AS merchant_name, CAST(o_custkey AS VARCHAR) AS user_id, CAST(k % 503 AS VARCHAR) AS rider_id,
         CASE WHEN k % 503 % 10 < 6 THEN '全职' WHEN k % 503 % 10 < 9 THEN '兼职' END AS employment_status,
         CASE WHEN o_orderstatus = 'F' THEN '已完成' WHEN o_orderstatus = 'O' AND k % 4 = 0 THEN '已取消（无责）' WHEN o_orderstatus = 'O' THEN '已取消' ELSE '配送中' END AS order_status,
         'CS' || (k % 7) AS customer_service_id, CASE WHEN k % 29 <> 0 THEN o_orderpriority END AS order_source,
         create_time, pay_time, accept_time,
         CASE WHEN o_orderstatus = 'O' THEN coalesce(pay_time, create_time) + to_seconds((2 + k % 35) * 60) END AS cancel_time,
         CASE WHEN o_orderstatus = 'F' THEN accept_time + to_seconds((12 + k % 42) * 60) END AS complete_time,
         round(o_totalprice) / 100 AS amount, (k % 7) * 0.5::DOUBLE AS hq_discount, (k % 5) * 0.75::DOUBLE AS discount,
         CASE WHEN k % 5 <> 0 THEN 'C' || k END AS coupon_id, CASE WHEN k % 6 = 0 THEN 'M' || k END AS marketing_coupon_id,
         CASE WHEN o_orderstatus = 'F' THEN 4.2::DOUBLE + (k % 45) / 10.0::DOUBLE ELSE 0.0 END AS rider_income,
         CASE WHEN o_orderstatus = 'F' THEN 1.1::DOUBLE + (k % 26) / 10.0::DOUBLE ELSE 0.0 END AS partner_income,
         CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 0.0 END::DOUBLE AS hq_income, CASE WHEN o_orderstatus = 'F' THEN 0.2 ELSE 0.0 END::DOUBLE AS maiyatian_income
  FROM timed)"""
