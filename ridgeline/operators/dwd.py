"""The wide order fact: one row an order, typed, named from the rosters, with its flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Settings
from ridgeline.functions import sizes
from ridgeline.functions.expressions import blank_to_null, minutes_between


def latest(rows: DataFrame, key: str, order: tuple[str, ...] = ("imported_at", "source_row_number")) -> DataFrame:
    """The latest row of each key that is not blank; of rows equal in that, the one of the last file by name.

    The first row is the one that none is before: for a rank Spark would sort the rows before the shuffle too, which few repeats do not repay.
    """
    by = [F.col(c).desc_nulls_last() for c in (*order, "file") if c in rows.columns]
    before = F.lag(F.lit(True)).over(Window.partitionBy(key).orderBy(*by))
    return rows.filter(blank_to_null(F.col(key)).isNotNull()).withColumn("__before", before).filter("__before IS NULL").drop("__before")


def latest_of_few(rows: DataFrame, key: str) -> DataFrame:
    """As :func:`latest`, where few keys have several rows: only these rows are shuffled and sorted.

    Repeated keys are found, and told to all tasks, by 64-bit hashes; a key that shares another's hash is looked at in vain.
    Where they are too many to be told, all rows are ranked.
    """
    hashed = rows.filter(blank_to_null(F.col(key)).isNotNull()).withColumn("__hash", F.xxhash64(key))
    # most keys are there once: brought together first, they are not counted twice
    repeated = hashed.select("__hash").repartition("__hash").groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash")
    if repeated.count() > sizes.REPEATED_IDS:
        return latest(rows, key)
    told = F.broadcast(repeated)
    several = latest(hashed.join(told, "__hash", "left_semi"), key)
    return hashed.join(told, "__hash", "left_anti").unionByName(several).drop("__hash")


def _within(date: Column, since: Column, days: int) -> Column:
    """0 to ``days`` days after ``since``; false where either is missing."""
    return F.coalesce(F.datediff(date, since).between(0, days), F.lit(False))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def build(orders: DataFrame, riders: DataFrame, merchants: DataFrame, partners: DataFrame, cfg: Settings = Settings(), months: list[str] | None = None) -> DataFrame:
    """The fact of all orders, or of those of some months.

    ``orders`` has normalised ids, typed times and amounts.  Of an order imported
    more than once the latest row counts.  Rosters have one row an id.
    Rosters and repeated ids are counted when this is called, to choose how they are joined.
    """
    rows = orders if months is None else orders.filter(F.col("order_month").isin(*months))
    o = latest_of_few(rows, "order_id").alias("o")
    r = riders.select("rider_id", F.col("rider_name").alias("roster_rider"), "hire_date").alias("r")
    m = merchants.select("merchant_id", F.col("merchant_name").alias("roster_merchant"), F.col("shop_name").alias("roster_shop"), "register_date").alias("m")
    p = partners.select("partner_id", F.col("partner_name").alias("roster_partner"), "open_date", "province", "city", "district").alias("p")
    joined = o.join(sizes.beside(r), "rider_id", "left").join(sizes.beside(m), "merchant_id", "left").join(sizes.beside(p), "partner_id", "left")
    status = F.coalesce(F.col("order_status"), F.lit(""))
    times = joined.withColumns({
        "order_month": F.coalesce("order_month", F.date_format("create_time", "yyyy-MM")),
        "partner_name": F.coalesce("roster_partner", "partner_name"),
        "merchant_name": F.coalesce("roster_merchant", "merchant_name"),
        "shop_name": F.col("roster_shop"),
        "rider_name": F.coalesce("roster_rider", "rider_name"),
        "employment_type": F.when(F.col("employment_status").contains("全职"), "fulltime").when(F.col("employment_status").contains("兼职"), "parttime").otherwise("unknown"),
        "order_date": F.to_date("create_time"),
        "order_hour": F.hour("create_time"),
        "accept_hour": F.hour("accept_time"),
        "is_paid": F.col("pay_time").isNotNull(),
        "is_completed": F.col("complete_time").isNotNull() | status.contains("完成") | status.contains("送达"),
        "is_cancelled": F.col("cancel_time").isNotNull() | status.contains("取消"),
        "pay_cancel_minutes": minutes_between(F.col("pay_time"), F.col("cancel_time")),
        "order_elapsed_minutes_to_cancel": minutes_between(F.col("create_time"), F.col("cancel_time")),
        "has_marketing_coupon": blank_to_null(F.col("marketing_coupon_id")).isNotNull(),
    })
    limit = F.lit(float(cfg.cancel_minutes))
    late = _true(F.col("pay_cancel_minutes") > limit)
    waited = _true(F.col("order_elapsed_minutes_to_cancel") > limit)
    cancelled, accepted = F.col("is_cancelled"), F.col("accept_time").isNotNull()
    flagged = times.withColumns({
        "is_valid_order": F.col("is_completed") | late,
        "is_valid_cancel_order": cancelled & late,
        "is_new_rider_order": _within(F.col("order_date"), F.col("hire_date"), cfg.new_rider_days),
        "is_new_merchant_order": _within(F.col("order_date"), F.col("register_date"), cfg.new_merchant_days),
        "is_new_partner_order": _within(F.col("order_date"), F.col("open_date"), cfg.new_partner_days),
        "service_online_flag": _true(F.col("order_hour").between(cfg.online_from, cfg.online_to)),
        "is_timeout_cancel": cancelled & waited,
        "is_not_timeout_cancel": cancelled & ~waited,
        "is_unaccepted_cancel": cancelled & ~accepted,
        "is_accepted_cancel": cancelled & accepted,
        "is_rider_noliability_cancel": cancelled & status.contains("无责"),
        "has_coupon_order": blank_to_null(F.col("coupon_id")).isNotNull() | F.col("has_marketing_coupon"),
        "hq_subsidy_amount": F.when(F.col("has_marketing_coupon"), 0.0).otherwise(F.col("hq_discount_amount")),
        "partner_subsidy_amount": F.col("discount_amount") + F.when(F.col("has_marketing_coupon"), F.col("hq_discount_amount")).otherwise(0.0),
        "is_cross_day_order": _true(F.to_date("create_time") != F.to_date("complete_time")),
    })
    return flagged.withColumnsRenamed({"hq_discount_amount": "hq_discount_raw_amount", "discount_amount": "discount_raw_amount"}).select(*COLUMNS)


COLUMNS = (
    "order_id order_month partner_id partner_name merchant_id merchant_name shop_name user_id rider_id rider_name employment_status "
    "employment_type province city district order_status customer_service_id order_source create_time pay_time accept_time cancel_time "
    "complete_time order_date order_hour accept_hour is_paid is_completed is_cancelled pay_cancel_minutes order_elapsed_minutes_to_cancel "
    "is_valid_order is_valid_cancel_order is_new_rider_order is_new_merchant_order is_new_partner_order service_online_flag is_timeout_cancel "
    "is_not_timeout_cancel is_unaccepted_cancel is_accepted_cancel is_rider_noliability_cancel has_coupon_order order_price amount_payable "
    "amount_paid rider_income partner_income hq_income maiyatian_income insurance_fee coupon_id marketing_coupon_id hq_discount_raw_amount "
    "discount_raw_amount hq_subsidy_amount partner_subsidy_amount is_cross_day_order"
).split()

#: The fact as SQL, over the test bed's common table expressions.
SQL = """
dwd AS (
  SELECT o.order_id, order_month, o.partner_id, p.partner_name, o.merchant_id, coalesce(m.merchant_name, o.merchant_name) AS merchant_name, shop_name, user_id,
         o.rider_id, r.rider_name, employment_status,
         CASE WHEN employment_status LIKE '%全职%' THEN 'fulltime' WHEN employment_status LIKE '%兼职%' THEN 'parttime' ELSE 'unknown' END AS employment_type,
         p.province, p.city, p.district, order_status, customer_service_id, order_source, create_time, pay_time, accept_time, cancel_time, complete_time,
         d AS order_date, CAST(hour(create_time) AS INTEGER) AS order_hour, CAST(hour(accept_time) AS INTEGER) AS accept_hour,
         pay_time IS NOT NULL AS is_paid, done AS is_completed, off AS is_cancelled, pcm AS pay_cancel_minutes, ecm AS order_elapsed_minutes_to_cancel,
         done OR coalesce(pcm > 5, false) AS is_valid_order, off AND coalesce(pcm > 5, false) AS is_valid_cancel_order,
         coalesce(d - hire_date BETWEEN 0 AND 30, false) AS is_new_rider_order, coalesce(d - register_date BETWEEN 0 AND 30, false) AS is_new_merchant_order,
         coalesce(d - open_date BETWEEN 0 AND 90, false) AS is_new_partner_order, hour(create_time) BETWEEN 9 AND 20 AS service_online_flag,
         off AND coalesce(ecm > 5, false) AS is_timeout_cancel, off AND NOT coalesce(ecm > 5, false) AS is_not_timeout_cancel,
         off AND accept_time IS NULL AS is_unaccepted_cancel, off AND accept_time IS NOT NULL AS is_accepted_cancel,
         off AND order_status LIKE '%无责%' AS is_rider_noliability_cancel, coupon_id IS NOT NULL OR marketing_coupon_id IS NOT NULL AS has_coupon_order,
         amount AS order_price, amount AS amount_payable, amount AS amount_paid, rider_income, partner_income, hq_income, maiyatian_income,
         0.1::DOUBLE AS insurance_fee, coupon_id, marketing_coupon_id, hq_discount AS hq_discount_raw_amount, discount AS discount_raw_amount,
         CASE WHEN marketing_coupon_id IS NOT NULL THEN 0.0 ELSE hq_discount END AS hq_subsidy_amount,
         discount + CASE WHEN marketing_coupon_id IS NOT NULL THEN hq_discount ELSE 0.0 END AS partner_subsidy_amount,
         coalesce(CAST(create_time AS DATE) <> CAST(complete_time AS DATE), false) AS is_cross_day_order,
         hire_date, register_date, open_date
  FROM (SELECT *, CAST(create_time AS DATE) AS d, complete_time IS NOT NULL OR order_status LIKE '%完成%' AS done,
               cancel_time IS NOT NULL OR order_status LIKE '%取消%' AS off, epoch(cancel_time - pay_time)::DOUBLE / 60 AS pcm,
               epoch(cancel_time - create_time)::DOUBLE / 60 AS ecm FROM latest) o
  LEFT JOIN rider_roster r ON r.rider_id = o.rider_id LEFT JOIN merchant_roster m ON m.merchant_id = o.merchant_id
  LEFT JOIN partner_roster p ON p.partner_id = o.partner_id)"""
