"""The BI mart: sixteen tables from the fact, the metric tables and the rosters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Settings
from ridgeline.functions.expressions import average_money, blank_to_null, half_up, money, quotient, ratio_null
from ridgeline.functions.measures import Measure, count, distinct, total, total_if
from ridgeline.functions.sizes import beside
from ridgeline.operators import ads
from ridgeline.operators.ads import NO_SOURCE, C, measured

# fixed values: the mart's labels
LABELS = {
    "order_id": "订单编号", "order_month": "订单月份", "date": "日期", "order_date": "日期", "order_hour": "下单小时", "hour": "小时", "partner_id": "合伙人ID",
    "partner_name": "合伙人名称", "province": "省", "city": "市", "district": "区县", "merchant_id": "商家ID", "merchant_name": "商户名称", "shop_name": "店铺名称",
    "user_id": "用户ID", "rider_id": "骑手ID", "rider_name": "骑手姓名", "employment_status": "在职状态", "employment_type": "用工类型", "order_source": "订单来源",
    "order_status": "订单状态", "create_time": "下单时间", "pay_time": "支付时间", "accept_time": "接单时间", "complete_time": "完成时间", "cancel_time": "取消时间",
    "total_orders": "总订单", "valid_orders": "有效订单", "completed_orders": "完成订单", "cancelled_orders": "取消订单", "valid_cancel_orders": "有效取消订单",
    "active_partners": "活跃合伙人数", "new_partners": "新合伙人数", "active_merchants": "活跃商家数", "new_merchants": "新商家数", "active_riders": "活跃骑手数",
    "new_riders": "新骑手数", "new_rider_orders": "新骑手完成订单", "old_rider_orders": "老骑手完成订单", "new_merchant_orders": "新商家完成订单",
    "old_merchant_orders": "老商家完成订单", "paid_total": "完成订单实付金额", "rider_income_total": "骑手提成总额", "partner_income_total": "合伙人收入总额",
    "hq_subsidy_total": "总部补贴", "partner_subsidy_total": "合伙人补贴", "profit": "经营利润", "ticket": "客单价", "rider_income_per_order": "骑手单均提成",
    "completion_rate": "完成率", "cancel_rate": "取消率", "efficiency": "人效", "health": "健康状态", "priority": "优先级", "action": "建议动作",
    "previous_orders": "前一日完成订单", "change": "变化单量", "change_rate": "变化比例", "swing": "波动类型", "first_date": "开始日期", "last_date": "结束日期",
    "days": "统计天数", "rider_days": "活跃骑手日数", "merchant_days": "活跃商家日数", "orders_per_day": "日均完成订单",
}
# fixed values: names of the weekdays from Sunday on
WEEKDAYS = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")
# fixed values: bands and classes
RED, YELLOW, GREEN = "红色风险", "黄色关注", "绿色正常"


def labelled(df: DataFrame) -> DataFrame:
    """With the mart's labels for column names."""
    return df.withColumnsRenamed({c: LABELS[c] for c in df.columns if c in LABELS})


@dataclass(frozen=True)
class Layers:
    """What the mart is made of."""

    fact: DataFrame
    riders: DataFrame
    merchants: DataFrame
    partners: DataFrame
    cfg: Settings = Settings()

    @property
    def partner_day(self) -> DataFrame:
        return self.included(ads.partner_day(self.fact))

    @property
    def partner_orders(self) -> DataFrame:
        """The partners' days without counts of riders and merchants."""
        return self.included(ads.partner_day(self.fact, entities=False))

    def included(self, rows: DataFrame, keep_missing: bool = False) -> DataFrame:
        """Without the excluded partners; rows without partner only if asked for."""
        out = ~C("partner_id").isin(*self.cfg.excluded_partners) if self.cfg.excluded_partners else F.lit(True)
        return rows.filter(C("partner_id").isNull() | out if keep_missing else C("partner_id").isNotNull() & out)


def date_dim(x: Layers) -> DataFrame:
    """Every day from the first to the last of the partners' days."""
    ends = x.partner_orders.agg(F.min("date").alias("first"), F.max("date").alias("last")).filter("first IS NOT NULL")
    days = ends.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))
    number = F.dayofweek("date") - 1
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.date_format("date", "yyyy-MM").alias("year_month"),
        F.concat(F.date_format("date", "MM"), F.lit("月"), F.date_format("date", "dd"), F.lit("日")).alias("month_day"), number.alias("weekday_number"),
        F.get(F.array(*[F.lit(w) for w in WEEKDAYS]), number).alias("weekday"),
    )


def partner_dim(x: Layers) -> DataFrame:
    columns = ("partner_id", "partner_name", "open_date", "province", "city", "district", "region_raw", "status")
    both = x.included(x.partners).select(*columns).unionByName(x.partner_orders.select("partner_id", "partner_name", "province", "city", "district"), allowMissingColumns=True)
    out = both.filter(blank_to_null(C("partner_id")).isNotNull()).groupBy("partner_id").agg(*[F.max(c).alias(c) for c in columns[1:]])
    return out.withColumn("partner_name", F.coalesce("partner_name", "partner_id"))


def rider_dim(x: Layers) -> DataFrame:
    rows = x.riders.filter(blank_to_null(C("rider_id")).isNotNull())
    return rows.select("rider_id", F.coalesce("rider_name", "rider_id").alias("rider_name"), "hire_date", "status", "partner_name", "region")


def merchant_dim(x: Layers) -> DataFrame:
    rows = x.merchants.filter(blank_to_null(C("merchant_id")).isNotNull())
    return rows.select("merchant_id", F.coalesce("merchant_name", "merchant_id").alias("merchant_name"), "shop_name", "partner_name", "region", "register_date", "status")


def _there(condition: Column | None, name: str) -> Measure:
    return distinct(condition, name, blanks=True)


def _business() -> dict[str, Measure]:
    """Entities and money of a group of orders; new ones count whether their orders were completed or not."""
    done = C("is_completed")
    return {
        "active_merchants": _there(done, "merchant_id"), "new_merchants": _there(C("is_new_merchant_order"), "merchant_id"),
        "active_riders": _there(done, "rider_id"), "new_riders": _there(C("is_new_rider_order"), "rider_id"),
        "paid_total": total_if(done, C("amount_paid"), money), "rider_income_total": total_if(done, C("rider_income"), money),
        "income": total_if(done, C("partner_income")), "subsidy": total("partner_subsidy_amount"),
    }


def _per_order(df: DataFrame) -> DataFrame:
    money_left = df.withColumns({"partner_income_total": money(C("income")), "profit": money(C("income") - C("subsidy"))}).drop("income", "subsidy")
    return money_left.withColumns({
        "ticket": average_money(C("paid_total"), C("completed_orders")), "rider_income_per_order": average_money(C("rider_income_total"), C("completed_orders")),
        "completion_rate": ratio_null(C("completed_orders"), C("total_orders")), "cancel_rate": ratio_null(C("cancelled_orders"), C("total_orders")),
        "efficiency": ratio_null(C("completed_orders"), C("active_riders"), 2),
    })


_COUNTS = ("total_orders", "valid_orders", "completed_orders", "cancelled_orders")
_SUBSIDIES = ("hq_subsidy_total", "partner_subsidy_total")
_LABELS = ("partner_name", "province", "city", "district")


def _dated(x: Layers, keep_missing: bool = False) -> DataFrame:
    return x.included(x.fact, keep_missing).filter(C("order_date").isNotNull())


def nation_day(x: Layers) -> DataFrame:
    keys = {"order_month": F.date_format("order_date", "yyyy-MM"), "date": C("order_date"), **{n: C(n) for n in _LABELS[1:]}}
    more = {"active_partners": _there(None, "partner_id"), "new_partners": _there(C("is_new_partner_order"), "partner_id")}
    return _per_order(measured(_dated(x, True), keys, *_COUNTS, *_SUBSIDIES, **more, **_business()))


def partner_day(x: Layers) -> DataFrame:
    keys = {"order_month": F.date_format("order_date", "yyyy-MM"), "partner_id": C("partner_id"), "date": C("order_date")}
    done = C("is_completed")
    old = {"old_rider_orders": count(done & ~C("is_new_rider_order")), "old_merchant_orders": count(done & ~C("is_new_merchant_order"))}
    return _per_order(measured(_dated(x), keys, *_LABELS, *_COUNTS, "new_rider_orders", "new_merchant_orders", *_SUBSIDIES, **old, **_business()))


def partner_hour(x: Layers) -> DataFrame:
    """Orders by the hour made, riders by the date and hour in which they accepted."""
    kinds = ("fulltime", "parttime")
    at = F.coalesce("accept_time", "create_time")

    def place(month: Column, date: Column, hour: Column) -> Column:
        return F.struct(month.alias("month"), date.alias("date"), hour.alias("hour"))

    made = F.when(C("order_date").isNotNull() & C("order_hour").isNotNull(), place(C("order_month"), C("order_date"), C("order_hour")))
    took = place(F.date_format(at, "yyyy-MM"), F.to_date(at), C("accept_hour"))
    took = F.when(C("rider_id").isNotNull() & C("accept_hour").isNotNull() & at.isNotNull(), took)
    rows = ads.events(x.included(x.fact), made, took)
    keys = {"order_month": C("event.at.month"), "partner_id": C("partner_id"), "date": C("event.at.date"), "hour": C("event.at.hour")}
    done = {f"{k}_completed_orders": count(C("is_completed") & (C("employment_type") == k)) for k in kinds}
    riders = {f"{k}_accepted_riders": _there(~C("is_made") & (C("employment_type") == k), "rider_id") for k in kinds}
    out = measured(
        rows, keys, *_LABELS, *_COUNTS, "valid_cancel_orders", accepted_riders=_there(~C("is_made"), "rider_id"), counts=C("is_made"), **done, **riders,
    ).filter("total_orders > 0")

    def share(a: str, b: str, digits: int) -> Column:
        return F.coalesce(ratio_null(C(a), C(b), digits), F.lit(0.0))

    return out.withColumns({
        "efficiency": share("completed_orders", "accepted_riders", 2), **{f"{k}_efficiency": share(f"{k}_completed_orders", f"{k}_accepted_riders", 2) for k in kinds},
        "completion_rate": share("completed_orders", "total_orders", 4), "cancel_rate": share("cancelled_orders", "total_orders", 4),
    })


def rider_day(x: Layers) -> DataFrame:
    rows = x.included(ads.partner_rider_day(x.fact)).join(beside(x.riders.select("rider_id", F.col("rider_name").alias("known"), "hire_date")), "rider_id", "left")
    return rows.withColumn("rider_name", F.coalesce("known", "rider_name", "rider_id")).withColumn("is_new_rider", C("is_new_rider").cast("int")).drop("known")


def merchant_day(x: Layers) -> DataFrame:
    known = x.merchants.select("merchant_id", F.col("merchant_name").alias("known"), "shop_name", "register_date")
    rows = x.included(ads.partner_merchant_day(x.fact)).join(beside(known), "merchant_id", "left")
    return rows.withColumn("merchant_name", F.coalesce("known", "merchant_name", "merchant_id")).withColumn("is_new_merchant", C("is_new_merchant").cast("int")).drop("known")


def order_fact(x: Layers) -> DataFrame:
    flags = ("is_paid", "is_completed", "is_cancelled", "is_valid_order", "is_valid_cancel_order", "is_new_rider_order", "is_new_merchant_order", "is_new_partner_order",
             "is_timeout_cancel", "is_unaccepted_cancel", "is_accepted_cancel", "is_cross_day_order")
    amounts = ("order_price", "amount_payable", "amount_paid", "rider_income", "partner_income", "hq_income", "maiyatian_income", "insurance_fee", "hq_subsidy_amount", "partner_subsidy_amount")
    rows = x.included(x.fact.filter("order_id IS NOT NULL"), True)
    return rows.select(
        "order_id", "order_month", "order_date", "order_hour", "partner_id", "partner_name", "province", "city", "district", "merchant_id",
        F.coalesce("merchant_name", "merchant_id").alias("merchant_name"), "shop_name", "user_id", "rider_id", F.coalesce("rider_name", "rider_id").alias("rider_name"),
        "employment_status", "employment_type", F.coalesce(blank_to_null(C("order_source")), F.lit(NO_SOURCE)).alias("order_source"), "order_status",
        "create_time", "pay_time", "accept_time", "complete_time", "cancel_time", *[C(f).cast("int").alias(f) for f in flags],
        "pay_cancel_minutes", "order_elapsed_minutes_to_cancel", *[money(C(a)).alias(a) for a in amounts],
        money(C("hq_income") - C("maiyatian_income")).alias("commission"),
    )


def source_day(x: Layers) -> DataFrame:
    keys = {"order_month": C("order_month"), "partner_id": C("partner_id"), "date": C("order_date"), "order_source": F.coalesce(blank_to_null(C("order_source")), F.lit(NO_SOURCE))}
    return measured(_dated(x), keys, *_LABELS, *_COUNTS, "valid_cancel_orders")


def user_day(x: Layers) -> DataFrame:
    return x.included(ads.partner_user_day(x.fact))


def partner_health(x: Layers) -> DataFrame:
    """Totals of each partner and a band: red, yellow or green by completion and cancellation."""
    day = x.partner_day
    sums = {n: F.sum(n) for n in _COUNTS} | {"rider_days": F.sum("active_riders"), "merchant_days": F.sum("active_merchants")}
    out = day.groupBy("partner_id").agg(
        *[F.max(n).alias(n) for n in _LABELS], F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("days"),
        *[c.alias(n) for n, c in sums.items()],
    )
    done, off = quotient(C("completed_orders"), C("total_orders")), quotient(C("cancelled_orders"), C("total_orders"))
    band = F.when((C("total_orders") == 0) | (done < 0.60) | (off > 0.30), RED).when((done < 0.80) | (off > 0.20), YELLOW).otherwise(GREEN)
    return out.withColumns({
        "orders_per_day": ratio_null(C("completed_orders"), C("days"), 2), "completion_rate": half_up(done, 4), "cancel_rate": half_up(off, 4),
        "efficiency": ratio_null(C("completed_orders"), C("rider_days"), 2), "health": band,
    })


def partner_swing(x: Layers) -> DataFrame:
    """Each partner's day against the one before."""
    before = F.lag("completed_orders").over(Window.partitionBy("partner_id").orderBy("date"))
    rows = x.partner_orders.select("partner_id", *_LABELS, "date", "completed_orders", before.alias("previous_orders"))
    now, then = C("completed_orders"), C("previous_orders")
    kind = F.when(then.isNull(), "无基准").when(then - now >= 100, "大幅下滑").when((now < then) & (quotient(then - now, then) >= 0.2), "比例下滑").otherwise("正常")
    return rows.withColumns({"change": now - F.coalesce(then, F.lit(0)), "change_rate": ratio_null(now - then, then), "swing": kind})


# fixed values: advice on a partner
ADVICE = {
    "completion": "完成率偏低，优先排查取消和履约", "cancel": "取消率偏高，优先排查接单和商家出餐", "efficiency": "人效偏低，关注骑手排班和订单密度", "orders": "单量偏低，关注商家激活和订单来源",
    "yellow": "轻度异常，建议持续跟踪", "none": "正常",
}


def partner_risk(x: Layers) -> DataFrame:
    rows = partner_health(x).filter(C("health").isin(RED, YELLOW) | (C("completed_orders") < 100))
    red = C("health") == RED
    action = (
        F.when(red & (C("completion_rate") < 0.60), ADVICE["completion"]).when(red & (C("cancel_rate") > 0.30), ADVICE["cancel"])
        .when(C("efficiency") < 3, ADVICE["efficiency"]).when(C("completed_orders") < 100, ADVICE["orders"])
        .when(C("health") == YELLOW, ADVICE["yellow"]).otherwise(ADVICE["none"])
    )
    return rows.select(
        "partner_id", *_LABELS, "first_date", "last_date", "total_orders", "completed_orders", "cancelled_orders", "completion_rate", "cancel_rate", "efficiency", "health",
        F.when(red, 1).when(C("health") == YELLOW, 2).otherwise(3).alias("priority"), action.alias("action"),
    )


def version(published: DataFrame) -> DataFrame:
    """The latest published version."""
    return published.orderBy(F.desc("published_at"), F.desc("data_version")).limit(1)


#: Tables by the name of their file; :func:`version` is made from the control table.
TABLES: dict[str, tuple[str, Callable[[Layers], DataFrame]]] = {
    "date_dim": ("日期维度", date_dim), "partner_dim": ("合伙人维度", partner_dim), "rider_dim": ("骑手维度", rider_dim), "merchant_dim": ("商家维度", merchant_dim),
    "nation_day": ("全国日汇总", nation_day), "partner_day": ("合伙人日汇总", partner_day), "partner_hour": ("小时运力汇总", partner_hour), "rider_day": ("骑手日汇总", rider_day),
    "merchant_day": ("商家日汇总", merchant_day), "order_fact": ("订单明细事实表", order_fact), "source_day": ("订单来源汇总", source_day),
    "user_day": ("用户商家识别汇总", user_day), "partner_health": ("合伙人健康度", partner_health), "partner_swing": ("合伙人波动预警", partner_swing),
    "partner_risk": ("合伙人风险建议", partner_risk),
}
