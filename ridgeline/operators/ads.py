"""The metric layer: fourteen tables, each a grouping of the fact with measures from one vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.expressions import average_money, blank_to_null, money, ratio0
from ridgeline.functions.measures import Measure, aggregate, any_of, count, distinct, most, total, total_if
from ridgeline.functions.sizes import beside

C = F.col
UNKNOWN = "UNKNOWN"
NO_SOURCE = "未知"


def _both(*names: str) -> Column:
    out = C(names[0])
    for n in names[1:]:
        out = out & (~C(n[1:]) if n[0] == "~" else C(n))
    return out


#: What can be measured of a group of orders.
MEASURES: dict[str, Callable[[], Measure]] = {
    "total_orders": lambda: count(),
    "valid_orders": lambda: count(C("is_valid_order")),
    "completed_orders": lambda: count(C("is_completed")),
    "cancelled_orders": lambda: count(C("is_cancelled")),
    "valid_cancel_orders": lambda: count(C("is_valid_cancel_order")),
    "unpaid_orders": lambda: count(C("is_cancelled") & ~C("is_paid")),
    "unaccepted_cancel_orders": lambda: count(C("is_unaccepted_cancel")),
    "accepted_cancel_orders": lambda: count(C("is_accepted_cancel")),
    "active_partners": lambda: distinct(None, "partner_id"),
    "new_partners": lambda: distinct(C("is_new_partner_order"), "partner_id"),
    "active_merchants": lambda: distinct(C("is_completed"), "merchant_id"),
    "new_merchants": lambda: distinct(_both("is_completed", "is_new_merchant_order"), "merchant_id"),
    "active_riders": lambda: distinct(C("is_completed"), "rider_id"),
    "new_riders": lambda: distinct(_both("is_completed", "is_new_rider_order"), "rider_id"),
    "new_rider_orders": lambda: count(_both("is_completed", "is_new_rider_order")),
    "old_rider_orders": lambda: count(_both("is_completed", "~is_new_rider_order") & blank_to_null(C("rider_id")).isNotNull()),
    "new_merchant_orders": lambda: count(_both("is_completed", "is_new_merchant_order")),
    "old_merchant_orders": lambda: count(_both("is_completed", "~is_new_merchant_order") & blank_to_null(C("merchant_id")).isNotNull()),
    "hq_subsidy_total": lambda: total("hq_subsidy_amount", money),
    "partner_subsidy_total": lambda: total("partner_subsidy_amount", money),
    "is_new_partner": lambda: any_of(C("is_new_partner_order")),
    "is_new_rider": lambda: any_of(C("is_new_rider_order")),
    "is_new_merchant": lambda: any_of(C("is_new_merchant_order")),
    **{n: (lambda n=n: most(n)) for n in ("partner_name", "rider_name", "merchant_name", "shop_name", "province", "city", "district")},
}
#: Ratios of measures of the same row, 0 where the lower one is.
RATES = {
    "completion_rate": ("completed_orders", "valid_orders"),
    "cancel_rate": ("cancelled_orders", "total_orders"),
    "valid_cancel_rate": ("valid_cancel_orders", "valid_orders"),
}


def measured(rows: DataFrame, keys: dict[str, Column], *names: str, counts: Column | None = None, **more: Measure) -> DataFrame:
    """Rows grouped by named keys, with measures and rates by name, and further measures.

    Of rows where ``counts`` does not hold only distinct values are taken.
    """
    out = aggregate(rows, keys, {n: MEASURES[n]() for n in names if n not in RATES} | more, counts)
    return out.withColumns({n: ratio0(C(RATES[n][0]), C(RATES[n][1])) for n in names if n in RATES}) if any(n in RATES for n in names) else out


def _dated(dwd: DataFrame) -> DataFrame:
    return dwd.filter(C("order_date").isNotNull())


def _keys(*names: str) -> dict[str, Column]:
    known = {
        "date": C("order_date"),
        "order_month": F.date_format("order_date", "yyyy-MM"),
        "partner_id": F.coalesce("partner_id", F.lit(UNKNOWN)),
        "hour": F.coalesce("order_hour", F.lit(0)),
        "order_source": F.coalesce(blank_to_null(C("order_source")), F.lit(NO_SOURCE)),
    }
    return {n: known.get(n, C(n)) for n in names}


def _has(name: str) -> Column:
    return blank_to_null(C(name)).isNotNull()


_COUNTS = ("total_orders", "valid_orders", "completed_orders", "cancelled_orders")
_SUBSIDIES = ("hq_subsidy_total", "partner_subsidy_total")
_ACTIVE = ("active_merchants", "new_merchants", "active_riders", "new_riders")
_PLACE = ("province", "city", "district")


def admin_day(dwd: DataFrame) -> DataFrame:
    return measured(_dated(dwd), _keys("order_month", "date", *_PLACE), *_COUNTS, "completion_rate", "active_partners", "new_partners", *_ACTIVE, *_SUBSIDIES)


def admin_partner(dwd: DataFrame, entities: bool = True) -> DataFrame:
    """``entities`` tells whether riders and merchants are counted, for which each order is read up to three times."""
    active = _ACTIVE if entities else ()
    return measured(_dated(dwd), _keys("order_month", "date", "partner_id"), *_PLACE, "partner_name", "is_new_partner", *_COUNTS, "completion_rate", *active, *_SUBSIDIES)


def partner_day(dwd: DataFrame, entities: bool = True) -> DataFrame:
    """``entities`` as in :func:`admin_partner`."""
    active = _ACTIVE if entities else ()
    return measured(
        _dated(dwd), _keys("order_month", "partner_id", "date"), "partner_name", *_PLACE, *_COUNTS, "completion_rate", "cancel_rate", *active,
        "new_rider_orders", "old_rider_orders", "new_merchant_orders", "old_merchant_orders", *_SUBSIDIES,
    )


def partner_hour(dwd: DataFrame) -> DataFrame:
    out = measured(_dated(dwd), _keys("order_month", "partner_id", "date", "hour"), "total_orders", "completed_orders", "cancelled_orders", "cancel_rate")
    return out.drop("total_orders")


def partner_rider_day(dwd: DataFrame) -> DataFrame:
    rows = _dated(dwd).filter(_has("rider_id"))
    return measured(rows, _keys("order_month", "partner_id", "rider_id", "date"), "rider_name", "completed_orders", "cancelled_orders", "is_new_rider")


def partner_merchant_day(dwd: DataFrame) -> DataFrame:
    rows = _dated(dwd).filter(_has("merchant_id"))
    return measured(rows, _keys("order_month", "partner_id", "merchant_id", "date"), "merchant_name", "completed_orders", "cancelled_orders", "is_new_merchant", *_SUBSIDIES)


def partner_user_day(dwd: DataFrame) -> DataFrame:
    return measured(_dated(dwd).filter(_has("user_id")), _keys("order_month", "partner_id", "user_id", "date"), "total_orders", "completed_orders", "cancelled_orders")


def cancel_day(dwd: DataFrame) -> DataFrame:
    waited = _both("is_unaccepted_cancel", "is_timeout_cancel")
    out = measured(
        _dated(dwd), _keys("order_month", "partner_id", "date"), "partner_name", "completed_orders", "valid_orders", "valid_cancel_orders", "valid_cancel_rate",
        "unaccepted_cancel_orders", "total_orders",
        unaccepted_timeout_online_cancel_orders=count(waited & C("service_online_flag")),
        unaccepted_timeout_offline_cancel_orders=count(waited & ~C("service_online_flag")),
        unaccepted_timeout_cancel_orders=count(waited),
        unaccepted_not_timeout_cancel_orders=count(_both("is_unaccepted_cancel", "is_not_timeout_cancel")),
        accepted_noliability_cancel_orders=count(_both("is_accepted_cancel", "is_rider_noliability_cancel")),
        unpaid_cancel_orders=MEASURES["unpaid_orders"](),
    )
    return out.withColumn("unaccepted_timeout_online_cancel_rate", ratio0(C("unaccepted_timeout_online_cancel_orders"), C("total_orders")))


def events(rows: DataFrame, made: Column, took: Column) -> DataFrame:
    """Each order as up to two events: ``made`` and ``took``, structs of the same fields or missing, with ``is_made`` to tell them."""
    each = F.array(*[F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(is_made).alias("is_made"))) for at, is_made in ((made, True), (took, False))])
    return rows.withColumn("event", F.explode(each)).filter("event IS NOT NULL").withColumn("is_made", C("event.is_made"))


def direct_hour(dwd: DataFrame) -> DataFrame:
    """Orders by the hour they were made in; riders by the hour they accepted in, on the order's date."""
    hour = lambda n: F.struct(F.coalesce(n, F.lit(0)).alias("hour"))
    rows = events(_dated(dwd), hour("order_hour"), F.when(C("accept_time").isNotNull(), hour("accept_hour")))
    kinds = {}
    for kind in ("parttime", "fulltime"):
        own = C("is_completed") & (C("employment_type") == kind)
        kinds |= {f"{kind}_completed_orders": count(own), f"{kind}_rider_count": distinct(C("is_made") & own, "rider_id")}
    out = measured(
        rows, _keys("order_month", "partner_id", "date") | {"hour": C("event.at.hour")}, "partner_name", "unpaid_orders", "unaccepted_cancel_orders", "accepted_cancel_orders",
        "valid_orders", "valid_cancel_orders", "valid_cancel_rate", delivered_orders=MEASURES["completed_orders"](), total_orders=MEASURES["total_orders"](),
        accepted_rider_count=distinct(~C("is_made"), "rider_id"), counts=C("is_made"), **kinds,
    ).filter("total_orders > 0")
    return out.withColumns({f"{k}_efficiency": ratio0(C(f"{k}_completed_orders"), C(f"{k}_rider_count")) for k in ("parttime", "fulltime")})


def new_riders(dwd: DataFrame, riders: DataFrame) -> DataFrame:
    rows = _dated(dwd).filter(C("is_new_rider_order") & _has("rider_id")).join(beside(riders.select("rider_id", "hire_date")), "rider_id", "left")
    return measured(rows, _keys("order_month", "partner_id", "rider_id"), "partner_name", "rider_name", "total_orders", "completed_orders", hire_date=most("hire_date"))


def new_merchants(dwd: DataFrame, merchants: DataFrame) -> DataFrame:
    rows = _dated(dwd).filter(C("is_new_merchant_order") & _has("merchant_id")).join(beside(merchants.select("merchant_id", "register_date")), "merchant_id", "left")
    out = measured(
        rows, _keys("order_month", "partner_id", "merchant_id"), "partner_name", "merchant_name", "shop_name", "total_orders", "completed_orders",
        register_date=most("register_date"),
    )
    return out.withColumn("completion_rate", ratio0(C("completed_orders"), C("total_orders")))


def merchant_day(dwd: DataFrame) -> DataFrame:
    """Orders and money paid, by what became of them."""
    kinds = {"unaccepted_cancel": "is_unaccepted_cancel", "accepted_cancel": "is_accepted_cancel", "completed": "is_completed"}
    paid = {f"{k}_amount_paid": total_if(C(flag), C("amount_paid"), money) for k, flag in kinds.items()}
    out = measured(
        _dated(dwd).filter(_has("merchant_id")), _keys("order_month", "partner_id", "merchant_id", "date"), "partner_name", "merchant_name", "shop_name",
        "unaccepted_cancel_orders", "accepted_cancel_orders", "completed_orders", "total_orders", **paid, paid=total("amount_paid"),
    )
    return out.withColumns({
        "completion_rate": ratio0(C("completed_orders"), C("total_orders")), "avg_amount_paid": average_money(C("paid"), C("total_orders")),
    }).drop("paid")


def source_day(dwd: DataFrame) -> DataFrame:
    return measured(
        _dated(dwd), _keys("order_month", "partner_id", "order_source", "date"), "partner_name", "unpaid_orders", "unaccepted_cancel_orders",
        "accepted_cancel_orders", "completed_orders", "total_orders",
    )


def coupon_day(dwd: DataFrame) -> DataFrame:
    rows = _dated(dwd).filter(C("has_coupon_order") & C("is_completed"))
    return measured(
        rows, _keys("order_month", "partner_id", "date", "coupon_id", "marketing_coupon_id"), "partner_name", coupon_order_count=count(),
        hq_discount_total=total("hq_discount_raw_amount", money), discount_total=total("discount_raw_amount", money),
        total_discount=total(C("hq_discount_raw_amount") + C("discount_raw_amount"), money),
    )


#: Tables by name; those of ``WITH_ROSTER`` also take a roster.
TABLES: dict[str, Callable[..., DataFrame]] = {
    "admin_day": admin_day, "admin_partner": admin_partner, "partner_day": partner_day, "partner_hour": partner_hour,
    "partner_rider_day": partner_rider_day, "partner_merchant_day": partner_merchant_day, "partner_user_day": partner_user_day,
    "cancel_day": cancel_day, "direct_hour": direct_hour, "new_riders": new_riders, "new_merchants": new_merchants,
    "merchant_day": merchant_day, "source_day": source_day, "coupon_day": coupon_day,
}
WITH_ROSTER = {"new_riders": "riders", "new_merchants": "merchants"}

# fixed values: what the key of each table's rows begins with, and the columns that follow
KEYS = {
    "admin_day": ("admin_day", "date", "province", "city", "district"), "admin_partner": ("admin_partner", "date", "partner_id"),
    "partner_day": ("partner_day", "partner_id", "date"), "partner_hour": ("partner_hour", "partner_id", "date", "hour"),
    "partner_rider_day": ("partner_rider", "partner_id", "rider_id", "date"), "partner_merchant_day": ("partner_merchant", "partner_id", "merchant_id", "date"),
    "partner_user_day": ("partner_user", "partner_id", "user_id", "date"), "cancel_day": ("direct_cancel", "partner_id", "date"),
    "direct_hour": ("direct_hour", "partner_id", "date", "hour"), "new_riders": ("direct_new_rider", "order_month", "partner_id", "rider_id"),
    "new_merchants": ("direct_new_merchant", "order_month", "partner_id", "merchant_id"), "merchant_day": ("direct_merchant", "partner_id", "merchant_id", "date"),
    "source_day": ("direct_source", "partner_id", "order_source", "date"), "coupon_day": ("direct_coupon", "partner_id", "date", "coupon_id", "marketing_coupon_id"),
}


def keyed(name: str, df: DataFrame, batch_id: str) -> DataFrame:
    """A table's rows with their key as text (missing parts empty) and the batch that made them."""
    prefix, *parts = KEYS[name]
    key = F.concat_ws("|", F.lit(prefix), *[F.coalesce(C(p).cast("string"), F.lit("")) for p in parts])
    return df.withColumns({"metric_key": key, "batch_id": F.lit(batch_id)})
