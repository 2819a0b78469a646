"""SQL restatements of the mart."""

from __future__ import annotations

from ridgeline.oracles.metrics import (
    DONE, MERCHANT_DAY, NAME, OFF, PARTNER_DAY, PLACE, RIDER_DAY, SUBSIDY, TOTAL, USER_DAY, VALID, VALID_OFF, avg, n,
)

IN = "partner_id IS NOT NULL AND partner_id NOT IN ('7')"
IN_OR_NONE = "(partner_id IS NULL OR partner_id NOT IN ('7'))"
DAY = f"(SELECT * FROM ({PARTNER_DAY}) WHERE {IN})"


def q(a: str, b: str, digits: int) -> str:
    return f"round(({a})::DOUBLE / nullif({b}, 0), {digits})"


def _sum(x: str) -> str:
    return f"sum(CASE WHEN is_completed THEN {x} ELSE 0 END)"


_RIDERS = "count(DISTINCT rider_id) FILTER (WHERE is_completed)"
BUSINESS = (
    f"{TOTAL} AS total_orders, {VALID} AS valid_orders, {DONE} AS completed_orders, {OFF} AS cancelled_orders, {SUBSIDY}, "
    f"count(DISTINCT merchant_id) FILTER (WHERE is_completed) AS active_merchants, count(DISTINCT merchant_id) FILTER (WHERE is_new_merchant_order) AS new_merchants, "
    f"{_RIDERS} AS active_riders, count(DISTINCT rider_id) FILTER (WHERE is_new_rider_order) AS new_riders, round({_sum('amount_paid')}, 2) AS paid_total, "
    f"round({_sum('rider_income')}, 2) AS rider_income_total, round({_sum('partner_income')}, 2) AS partner_income_total, "
    f"round({_sum('partner_income')} - sum(partner_subsidy_amount), 2) AS profit, {avg(_sum('amount_paid'), DONE)} AS ticket, "
    f"{avg(_sum('rider_income'), DONE)} AS rider_income_per_order, {q(DONE, TOTAL, 4)} AS completion_rate, {q(OFF, TOTAL, 4)} AS cancel_rate, {q(DONE, _RIDERS, 2)} AS efficiency"
)
MONTH = "strftime(order_date, '%Y-%m') AS order_month"
SOURCE = "coalesce(nullif(trim(order_source), ''), '未知') AS order_source"


def _share(a: str, b: str, digits: int) -> str:
    return f"coalesce({q(a, b, digits)}, 0)"


HOUR = f"""SELECT o.*, coalesce(a.n, 0) AS accepted_riders, coalesce(a.f, 0) AS fulltime_accepted_riders, coalesce(a.p, 0) AS parttime_accepted_riders,
  {_share('completed_orders', 'a.n', 2)} AS efficiency, {_share('fulltime_completed_orders', 'a.f', 2)} AS fulltime_efficiency,
  {_share('parttime_completed_orders', 'a.p', 2)} AS parttime_efficiency, {_share('completed_orders', 'total_orders', 4)} AS completion_rate, {_share('cancelled_orders', 'total_orders', 4)} AS cancel_rate
FROM (SELECT order_month, partner_id, order_date AS date, order_hour AS hour, {NAME}, {PLACE}, {TOTAL} AS total_orders, {VALID} AS valid_orders, {DONE} AS completed_orders,
        {OFF} AS cancelled_orders, {VALID_OFF} AS valid_cancel_orders, {n("is_completed AND employment_type = 'fulltime'")} AS fulltime_completed_orders,
        {n("is_completed AND employment_type = 'parttime'")} AS parttime_completed_orders FROM dwd WHERE {IN} GROUP BY ALL) o
LEFT JOIN (SELECT partner_id, CAST(accept_time AS DATE) AS date, accept_hour AS hour, count(DISTINCT rider_id) AS n,
        count(DISTINCT rider_id) FILTER (WHERE employment_type = 'fulltime') AS f, count(DISTINCT rider_id) FILTER (WHERE employment_type = 'parttime') AS p
      FROM dwd WHERE {IN} AND accept_time IS NOT NULL GROUP BY ALL) a USING (partner_id, date, hour)"""
_FLAGS = ("is_paid is_completed is_cancelled is_valid_order is_valid_cancel_order is_new_rider_order is_new_merchant_order is_new_partner_order is_timeout_cancel "
          "is_unaccepted_cancel is_accepted_cancel is_cross_day_order").split()
_AMOUNTS = "order_price amount_payable amount_paid rider_income partner_income hq_income maiyatian_income insurance_fee hq_subsidy_amount partner_subsidy_amount".split()
FACT = f"""SELECT order_id, order_month, order_date, order_hour, partner_id, partner_name, province, city, district, merchant_id, merchant_name, shop_name, user_id, rider_id, rider_name,
  employment_status, employment_type, {SOURCE}, order_status, create_time, pay_time, accept_time, complete_time, cancel_time,
  {', '.join(f'CAST({f} AS INTEGER) AS {f}' for f in _FLAGS)}, pay_cancel_minutes, order_elapsed_minutes_to_cancel,
  {', '.join(f'round({a}, 2) AS {a}' for a in _AMOUNTS)}, round(hq_income - maiyatian_income, 2) AS commission FROM dwd WHERE {IN_OR_NONE}"""
HEALTH = f"""SELECT *, {q('completed_orders', 'days', 2)} AS orders_per_day, {q('completed_orders', 'total_orders', 4)} AS completion_rate, {q('cancelled_orders', 'total_orders', 4)} AS cancel_rate,
  {q('completed_orders', 'rider_days', 2)} AS efficiency,
  CASE WHEN total_orders = 0 OR completed_orders / total_orders < 0.6::DOUBLE OR cancelled_orders / total_orders > 0.3::DOUBLE THEN '红色风险'
       WHEN completed_orders / total_orders < 0.8::DOUBLE OR cancelled_orders / total_orders > 0.2::DOUBLE THEN '黄色关注' ELSE '绿色正常' END AS health
FROM (SELECT partner_id, {NAME}, {PLACE}, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days, sum(total_orders)::BIGINT AS total_orders,
        sum(valid_orders)::BIGINT AS valid_orders, sum(completed_orders)::BIGINT AS completed_orders, sum(cancelled_orders)::BIGINT AS cancelled_orders,
        sum(active_riders)::BIGINT AS rider_days, sum(active_merchants)::BIGINT AS merchant_days FROM {DAY} GROUP BY partner_id)"""
SWING = f"""SELECT *, completed_orders - coalesce(previous_orders, 0) AS change, {q('completed_orders - previous_orders', 'previous_orders', 4)} AS change_rate,
  CASE WHEN previous_orders IS NULL THEN '无基准' WHEN previous_orders - completed_orders >= 100 THEN '大幅下滑'
       WHEN previous_orders > completed_orders AND (previous_orders - completed_orders)::DOUBLE / previous_orders >= 0.2::DOUBLE THEN '比例下滑' ELSE '正常' END AS swing
FROM (SELECT partner_id, partner_name, province, city, district, date, completed_orders, lag(completed_orders) OVER (PARTITION BY partner_id ORDER BY date) AS previous_orders FROM {DAY})"""
RISK = f"""SELECT partner_id, partner_name, province, city, district, first_date, last_date, total_orders, completed_orders, cancelled_orders, completion_rate, cancel_rate, efficiency, health,
  CASE health WHEN '红色风险' THEN 1 WHEN '黄色关注' THEN 2 ELSE 3 END AS priority,
  CASE WHEN health = '红色风险' AND completion_rate < 0.6 THEN '完成率偏低，优先排查取消和履约' WHEN health = '红色风险' AND cancel_rate > 0.3 THEN '取消率偏高，优先排查接单和商家出餐'
       WHEN efficiency < 3 THEN '人效偏低，关注骑手排班和订单密度' WHEN completed_orders < 100 THEN '单量偏低，关注商家激活和订单来源'
       WHEN health = '黄色关注' THEN '轻度异常，建议持续跟踪' ELSE '正常' END AS action
FROM ({HEALTH}) WHERE health <> '绿色正常' OR completed_orders < 100"""

TABLES = {
    "date_dim": f"""SELECT CAST(x AS DATE) AS date, CAST(year(x) AS INTEGER) AS year, CAST(month(x) AS INTEGER) AS month, CAST(day(x) AS INTEGER) AS day, strftime(x, '%Y-%m') AS year_month,
        strftime(x, '%m月%d日') AS month_day, CAST(strftime(x, '%w') AS INTEGER) AS weekday_number, ['周日', '周一', '周二', '周三', '周四', '周五', '周六'][CAST(strftime(x, '%w') AS INTEGER) + 1] AS weekday
        FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS x FROM {DAY})""",
    "partner_dim": f"""SELECT partner_id, coalesce(max(partner_name), partner_id) AS partner_name, max(open_date) AS open_date, max(province) AS province, max(city) AS city, max(district) AS district,
        max(region_raw) AS region_raw, max(status) AS status FROM (SELECT partner_id, partner_name, open_date, province, city, district, region_raw, status FROM partner_roster WHERE {IN}
        UNION ALL SELECT partner_id, partner_name, NULL, province, city, district, NULL, NULL FROM {DAY}) GROUP BY partner_id""",
    "rider_dim": "SELECT rider_id, rider_name, hire_date, status, partner_name, region FROM rider_roster",
    "merchant_dim": "SELECT merchant_id, merchant_name, shop_name, partner_name, region, register_date, status FROM merchant_roster",
    "nation_day": f"SELECT {MONTH}, order_date AS date, province, city, district, count(DISTINCT partner_id) AS active_partners, count(DISTINCT partner_id) FILTER (WHERE is_new_partner_order) AS new_partners, {BUSINESS} FROM dwd WHERE {IN_OR_NONE} GROUP BY ALL",
    "partner_day": f"SELECT {MONTH}, partner_id, order_date AS date, {NAME}, {PLACE}, {n('is_completed AND is_new_rider_order')} AS new_rider_orders, {n('is_completed AND NOT is_new_rider_order')} AS old_rider_orders, {n('is_completed AND is_new_merchant_order')} AS new_merchant_orders, {n('is_completed AND NOT is_new_merchant_order')} AS old_merchant_orders, {BUSINESS} FROM dwd WHERE {IN} GROUP BY ALL",
    "partner_hour": HOUR,
    "rider_day": f"SELECT b.* REPLACE (coalesce(r.rider_name, b.rider_name, rider_id) AS rider_name, CAST(is_new_rider AS INTEGER) AS is_new_rider), r.hire_date FROM (SELECT * FROM ({RIDER_DAY}) WHERE {IN}) b LEFT JOIN rider_roster r USING (rider_id)",
    "merchant_day": f"SELECT b.* REPLACE (coalesce(m.merchant_name, b.merchant_name, merchant_id) AS merchant_name, CAST(is_new_merchant AS INTEGER) AS is_new_merchant), m.shop_name, m.register_date FROM (SELECT * FROM ({MERCHANT_DAY}) WHERE {IN}) b LEFT JOIN merchant_roster m USING (merchant_id)",
    "order_fact": FACT,
    "source_day": f"SELECT order_month, partner_id, order_date AS date, {SOURCE}, {NAME}, {PLACE}, {TOTAL} AS total_orders, {VALID} AS valid_orders, {DONE} AS completed_orders, {OFF} AS cancelled_orders, {VALID_OFF} AS valid_cancel_orders FROM dwd WHERE {IN} GROUP BY ALL",
    "user_day": f"SELECT * FROM ({USER_DAY}) WHERE {IN}",
    "partner_health": HEALTH,
    "partner_swing": SWING,
    "partner_risk": RISK,
}
