"""SQL restatements of the fact and the metric tables."""

from __future__ import annotations

from ridgeline import testbed
from ridgeline.operators import dwd

WITH = f"WITH {testbed.SQL},{dwd.SQL}"


def n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def d(value: str, condition: str = "true") -> str:
    return f"count(DISTINCT {value}) FILTER (WHERE {condition} AND trim({value}) <> '')"


def r(a: str, b: str, digits: int = 4) -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), {digits})"


def avg(total: str, of: str) -> str:
    return f"round(round(({total}) * 100) / nullif({of}, 0)) / 100"


TOTAL, VALID, DONE, OFF = "count(*)", n("is_valid_order"), n("is_completed"), n("is_cancelled")
VALID_OFF = n("is_valid_cancel_order")
MONTH = "strftime(order_date, '%Y-%m') AS order_month"
PARTNER = "coalesce(partner_id, 'UNKNOWN') AS partner_id"
COUNTS = f"{TOTAL} AS total_orders, {VALID} AS valid_orders, {DONE} AS completed_orders, {OFF} AS cancelled_orders, {r(DONE, VALID)} AS completion_rate"
ACTIVE = (
    f"{d('merchant_id', 'is_completed')} AS active_merchants, {d('merchant_id', 'is_completed AND is_new_merchant_order')} AS new_merchants, "
    f"{d('rider_id', 'is_completed')} AS active_riders, {d('rider_id', 'is_completed AND is_new_rider_order')} AS new_riders"
)
SUBSIDY = "round(sum(hq_subsidy_amount), 2) AS hq_subsidy_total, round(sum(partner_subsidy_amount), 2) AS partner_subsidy_total"
PLACE = "max(province) AS province, max(city) AS city, max(district) AS district"
NAME = "max(partner_name) AS partner_name"


def grouped(keys: str, measures: str, where: str = "true", source: str = "dwd") -> str:
    return f"SELECT {keys}, {measures} FROM {source} WHERE order_date IS NOT NULL AND ({where}) GROUP BY ALL"


PARTNER_DAY = grouped(
    f"{MONTH}, {PARTNER}, order_date AS date",
    f"{NAME}, {PLACE}, {COUNTS}, {r(OFF, TOTAL)} AS cancel_rate, {ACTIVE}, {n('is_completed AND is_new_rider_order')} AS new_rider_orders, "
    f"{n('is_completed AND NOT is_new_rider_order')} AS old_rider_orders, {n('is_completed AND is_new_merchant_order')} AS new_merchant_orders, "
    f"{n('is_completed AND NOT is_new_merchant_order')} AS old_merchant_orders, {SUBSIDY}",
)
ADMIN_PARTNER = grouped(f"{MONTH}, order_date AS date, {PARTNER}", f"{PLACE}, {NAME}, bool_or(is_new_partner_order) AS is_new_partner, {COUNTS}, {ACTIVE}, {SUBSIDY}")
RIDER_DAY = grouped(
    f"{MONTH}, {PARTNER}, rider_id, order_date AS date",
    f"max(rider_name) AS rider_name, {DONE} AS completed_orders, {OFF} AS cancelled_orders, bool_or(is_new_rider_order) AS is_new_rider", "rider_id <> ''",
)
MERCHANT_DAY = grouped(
    f"{MONTH}, {PARTNER}, merchant_id, order_date AS date",
    f"max(merchant_name) AS merchant_name, {DONE} AS completed_orders, {OFF} AS cancelled_orders, bool_or(is_new_merchant_order) AS is_new_merchant, {SUBSIDY}",
    "merchant_id <> ''",
)
USER_DAY = grouped(
    f"{MONTH}, {PARTNER}, user_id, order_date AS date", f"{TOTAL} AS total_orders, {DONE} AS completed_orders, {OFF} AS cancelled_orders", "user_id <> ''"
)
WAITED = "is_unaccepted_cancel AND is_timeout_cancel"
_PAID = "round(sum(CASE WHEN {0} THEN amount_paid ELSE 0 END), 2)"
DIRECT_MERCHANT = grouped(
    f"{MONTH}, {PARTNER}, merchant_id, order_date AS date",
    f"{NAME}, max(merchant_name) AS merchant_name, max(shop_name) AS shop_name, {n('is_unaccepted_cancel')} AS unaccepted_cancel_orders, "
    f"{_PAID.format('is_unaccepted_cancel')} AS unaccepted_cancel_amount_paid, {n('is_accepted_cancel')} AS accepted_cancel_orders, "
    f"{_PAID.format('is_accepted_cancel')} AS accepted_cancel_amount_paid, {DONE} AS completed_orders, {_PAID.format('is_completed')} AS completed_amount_paid, "
    f"{TOTAL} AS total_orders, {r(DONE, TOTAL)} AS completion_rate, {avg('sum(amount_paid)', TOTAL)} AS avg_amount_paid",
    "merchant_id <> ''",
)
SOURCE_DAY = grouped(
    f"{MONTH}, {PARTNER}, coalesce(nullif(trim(order_source), ''), '未知') AS order_source, order_date AS date",
    f"{NAME}, {n('is_cancelled AND NOT is_paid')} AS unpaid_orders, {n('is_unaccepted_cancel')} AS unaccepted_cancel_orders, "
    f"{n('is_accepted_cancel')} AS accepted_cancel_orders, {DONE} AS completed_orders, {TOTAL} AS total_orders",
)
COUPON_DAY = grouped(
    f"{MONTH}, {PARTNER}, order_date AS date, coupon_id, marketing_coupon_id",
    f"{NAME}, {TOTAL} AS coupon_order_count, round(sum(hq_discount_raw_amount), 2) AS hq_discount_total, round(sum(discount_raw_amount), 2) AS discount_total, "
    "round(sum(hq_discount_raw_amount + discount_raw_amount), 2) AS total_discount",
    "has_coupon_order AND is_completed",
)
_KIND = ", ".join(
    f"{n(f'is_completed AND employment_type = {k!r}')} AS {k}_completed_orders, {d('rider_id', f'is_completed AND employment_type = {k!r}')} AS {k}_rider_count"
    for k in ("parttime", "fulltime")
)
DIRECT_HOUR = f"""SELECT o.*, coalesce(accepted_rider_count, 0) AS accepted_rider_count, {r('parttime_completed_orders', 'parttime_rider_count')} AS parttime_efficiency,
  {r('fulltime_completed_orders', 'fulltime_rider_count')} AS fulltime_efficiency
FROM ({grouped(
    f"{MONTH}, {PARTNER}, order_date AS date, coalesce(order_hour, 0) AS hour",
    f"{NAME}, {n('is_cancelled AND NOT is_paid')} AS unpaid_orders, {n('is_unaccepted_cancel')} AS unaccepted_cancel_orders, {n('is_accepted_cancel')} AS accepted_cancel_orders, "
    f"{DONE} AS delivered_orders, {TOTAL} AS total_orders, {VALID} AS valid_orders, {VALID_OFF} AS valid_cancel_orders, {r(VALID_OFF, VALID)} AS valid_cancel_rate, {_KIND}")}) o
LEFT JOIN ({grouped(f"{PARTNER}, order_date AS date, accept_hour AS hour", f"{d('rider_id')} AS accepted_rider_count", "accept_time IS NOT NULL")}) a USING (partner_id, date, hour)"""

#: Metric tables by name.
TABLES = {
    "admin_day": grouped(
        f"{MONTH}, order_date AS date, province, city, district",
        f"{COUNTS}, {d('partner_id')} AS active_partners, {d('partner_id', 'is_new_partner_order')} AS new_partners, {ACTIVE}, {SUBSIDY}",
    ),
    "admin_partner": ADMIN_PARTNER,
    "partner_day": PARTNER_DAY,
    "partner_hour": grouped(
        f"{MONTH}, {PARTNER}, order_date AS date, coalesce(order_hour, 0) AS hour", f"{DONE} AS completed_orders, {OFF} AS cancelled_orders, {r(OFF, TOTAL)} AS cancel_rate"
    ),
    "partner_rider_day": RIDER_DAY,
    "partner_merchant_day": MERCHANT_DAY,
    "partner_user_day": USER_DAY,
    "cancel_day": grouped(
        f"{MONTH}, {PARTNER}, order_date AS date",
        f"{NAME}, {DONE} AS completed_orders, {VALID} AS valid_orders, {VALID_OFF} AS valid_cancel_orders, {r(VALID_OFF, VALID)} AS valid_cancel_rate, "
        f"{n(WAITED + ' AND service_online_flag')} AS unaccepted_timeout_online_cancel_orders, {n(WAITED + ' AND NOT service_online_flag')} AS unaccepted_timeout_offline_cancel_orders, "
        f"{n(WAITED)} AS unaccepted_timeout_cancel_orders, {n('is_unaccepted_cancel AND is_not_timeout_cancel')} AS unaccepted_not_timeout_cancel_orders, "
        f"{n('is_unaccepted_cancel')} AS unaccepted_cancel_orders, {n('is_accepted_cancel AND is_rider_noliability_cancel')} AS accepted_noliability_cancel_orders, "
        f"{n('is_cancelled AND NOT is_paid')} AS unpaid_cancel_orders, {TOTAL} AS total_orders, {r(n(WAITED + ' AND service_online_flag'), TOTAL)} AS unaccepted_timeout_online_cancel_rate",
    ),
    "direct_hour": DIRECT_HOUR,
    "new_riders": grouped(
        f"{MONTH}, {PARTNER}, rider_id", f"{NAME}, max(rider_name) AS rider_name, max(hire_date) AS hire_date, {TOTAL} AS total_orders, {DONE} AS completed_orders", "is_new_rider_order"
    ),
    "new_merchants": grouped(
        f"{MONTH}, {PARTNER}, merchant_id",
        f"{NAME}, max(merchant_name) AS merchant_name, max(shop_name) AS shop_name, max(register_date) AS register_date, {TOTAL} AS total_orders, {DONE} AS completed_orders, {r(DONE, TOTAL)} AS completion_rate",
        "is_new_merchant_order",
    ),
    "merchant_day": DIRECT_MERCHANT,
    "source_day": SOURCE_DAY,
    "coupon_day": COUPON_DAY,
}
FACT = "SELECT * EXCLUDE (hire_date, register_date, open_date) FROM dwd"
