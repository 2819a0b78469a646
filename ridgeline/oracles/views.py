"""SQL restatements of the dashboard's views, for the catalog's parameters."""

from __future__ import annotations

from ridgeline.oracles import metrics as m
from ridgeline.oracles.metrics import COUPON_DAY, DIRECT_MERCHANT, DONE, OFF, PARTNER_DAY, SOURCE_DAY, TABLES, TOTAL, USER_DAY, avg, d, n, r

START, END, PARTNER = "2026-03-10", "2026-04-09", "3"
SPAN = f"BETWEEN DATE '{START}' AND DATE '{END}'"
W = f"order_date {SPAN}"
WP = f"{W} AND partner_id = '{PARTNER}'"
LATE = "(is_cancelled AND is_paid AND coalesce(pay_cancel_minutes, 0) > {0})"


def runtime(t: float = 5) -> str:
    late = LATE.format(t)
    return f"{TOTAL} AS total_orders, {n(f'is_completed OR {late}')} AS valid_orders, {DONE} AS completed_orders, {OFF} AS cancelled_orders, {n(late)} AS valid_cancel_orders"


def _done(x: str) -> str:
    return f"round(sum(CASE WHEN is_completed THEN {x} ELSE 0 END), 2)"


FINANCE = (
    f"{_done('amount_paid')} AS received, {_done('rider_income')} AS rider_commission, {_done('partner_income')} AS partner_income, "
    f"{_done('partner_subsidy_amount')} AS partner_subsidy, {_done('hq_subsidy_amount')} AS hq_subsidy"
)
_TOOK = "epoch(complete_time - accept_time) / 60"
SLA = (
    f"{n(f'is_completed AND {_TOOK} IS NOT NULL')} AS sla_base, {n(f'is_completed AND {_TOOK} <= 30')} AS on_time_orders, "
    f"{n(f'is_completed AND {_TOOK} <= 40')} AS sla_on_time_orders, {n(f'is_completed AND {_TOOK} > 40')} AS sla_overtime_orders"
)
ENTITIES = m.ACTIVE
MONEY = (
    f"round(partner_income - partner_subsidy, 2) AS profit, coalesce({avg('received', 'completed_orders')}, 0) AS avg_ticket_price, "
    f"coalesce({avg('rider_commission', 'completed_orders')}, 0) AS rider_avg_commission"
)
RATES = (
    f"{r('completed_orders', 'total_orders')} AS completion_rate, {r('cancelled_orders', 'total_orders')} AS cancel_rate, "
    f"{r('completed_orders', 'valid_orders')} AS valid_completion_rate, {r('valid_cancel_orders', 'valid_orders')} AS valid_cancel_rate"
)
EFFICIENCY = f"{r('completed_orders', 'active_riders', 2)} AS efficiency"
SLA_RATES = ", ".join(f"{r(a, 'sla_base')} AS {b}" for a, b in (("on_time_orders", "on_time_rate"), ("sla_on_time_orders", "sla_on_time_rate"), ("sla_overtime_orders", "sla_overtime_rate")))


def _active(entity: str) -> str:
    ids = f"SELECT {entity}_id, {DONE} AS done, {n(f'is_completed AND is_new_{entity}_order')} AS fresh FROM dwd WHERE {W} AND {entity}_id <> '' GROUP BY 1"
    return f"(SELECT {n('done >= 1')} AS active_{entity}s, {n('fresh > 0')} AS new_{entity}s FROM ({ids}))"


def ranking(keys: str) -> str:
    order = ", ".join(f"{k.strip()} NULLS LAST" for k in keys.split(","))
    return f"""SELECT *, {RATES}, {EFFICIENCY}, {MONEY} FROM (SELECT {keys}, {runtime()}, {FINANCE}, {d('rider_id', 'is_completed')} AS active_riders FROM dwd WHERE {W} GROUP BY ALL)
      ORDER BY completed_orders DESC, {order} LIMIT 50"""


def high(v: str, warn: float, target: float, most: float) -> str:
    return f"CASE WHEN {v} <= {warn} THEN 0.0 WHEN {v} >= {target} THEN {most} ELSE round(({v} - {warn}::DOUBLE) / ({target} - {warn})::DOUBLE * {most}, 2) END"


def low(v: str, target: float, warn: float, most: float) -> str:
    return f"CASE WHEN {v} <= {target} THEN {most} WHEN {v} >= {warn} THEN 0.0 ELSE round(({warn}::DOUBLE - {v}) / ({warn} - {target})::DOUBLE * {most}, 2) END"


def health(source: str, days: str) -> str:
    """The score's columns added to a table with the counts."""
    return f"""SELECT * EXCLUDE (per_day, complete, offs, valid_off, per_rider, fresh, got, won),
      CASE WHEN health_score >= 80 THEN 'green' WHEN health_score >= 60 THEN 'yellow' ELSE 'red' END AS health_band,
      CASE WHEN health_score >= 80 THEN '健康' WHEN health_score >= 60 THEN '关注' ELSE '风险' END AS health_label,
      coalesce(nullif(array_to_string(list_filter([CASE WHEN offs >= 0.2 THEN '取消率偏高' END, CASE WHEN valid_off >= 0.08 THEN '有效取消偏高' END, CASE WHEN per_rider < 1.2 THEN '人效偏低' END,
        CASE WHEN profit < 0 THEN '合伙人利润为负' END], lambda x: x IS NOT NULL)[1:3], '；'), ''), '经营整体稳定') AS issues
    FROM (SELECT *, round(scale_growth + fulfillment_quality + capacity_health + merchant_operation + revenue_quality, 1) AS health_score
    FROM (SELECT *, {high('per_day', 10, 100, 20)} AS scale_growth,
      round({high('complete', 0.6, 0.9, 10)} + {low('offs', 0.08, 0.3, 10)} + {low('valid_off', 0.03, 0.15, 5)}, 2) AS fulfillment_quality,
      round({high('per_rider', 0.8, 3.5, 12)} + {high('active_riders', 3, 30, 8)}, 2) AS capacity_health,
      round({high('active_merchants', 5, 50, 10)} + {high('fresh', 0.02, 0.1, 5)}, 2) AS merchant_operation,
      round({high('got', 3, 12, 8)} + {high('won', 0.2, 2.0, 12)}, 2) AS revenue_quality
    FROM (SELECT *, {r('total_orders', days)} AS per_day, {r('completed_orders', 'total_orders')} AS complete, {r('cancelled_orders', 'total_orders')} AS offs,
      {r('CASE WHEN valid_cancel_orders > 0 THEN valid_cancel_orders ELSE greatest(valid_orders - completed_orders, 0) END', 'valid_orders')} AS valid_off,
      {r('completed_orders', 'active_riders')} AS per_rider, {r('new_merchant_orders', 'completed_orders')} AS fresh, {r('received', 'completed_orders')} AS got, {r('profit', 'completed_orders')} AS won
    FROM ({source}))))"""


_FRESH = f"{n('is_completed AND is_new_merchant_order')} AS new_merchant_orders"
HEALTH_SOURCE = f"SELECT *, {RATES}, {EFFICIENCY}, {MONEY} FROM (SELECT partner_id, max(partner_name) AS partner_name, {runtime()}, {FINANCE}, {ENTITIES}, {_FRESH} FROM dwd WHERE {W} AND partner_id IS NOT NULL GROUP BY partner_id)"
HEALTH = health(HEALTH_SOURCE, "31")
_FEW = "({0} > 0 AND {0} < completed_orders * 0.1::DOUBLE)"
OVERVIEW = f"""SELECT * , coalesce(nullif(concat_ws(' ', CASE WHEN cancel_rate > 0.2 THEN 'Cancel rate is high. Review capacity response and timeout acceptance.' END,
    CASE WHEN {_FEW.format('new_rider_orders')} THEN 'New rider contribution is low. Review onboarding activation and coaching.' END,
    CASE WHEN {_FEW.format('new_merchant_orders')} THEN 'New merchant contribution is low. Review first-order conversion and merchant follow-up.' END), ''), 'Current city operation is stable.') AS diagnostics
  FROM ({health(f'''SELECT *, {RATES}, {EFFICIENCY}, {MONEY}, {SLA_RATES} FROM (SELECT {runtime(8)}, {FINANCE}, {SLA}, {ENTITIES}, {n('is_completed AND is_new_rider_order')} AS new_rider_orders, {_FRESH},
    max(partner_id) AS partner_id, max(partner_name) AS partner_name, max(province) AS province, max(city) AS city, max(district) AS district FROM dwd WHERE {WP})''', '31')})"""

_LATE5 = LATE.format(5)
_KINDS = ("parttime", "fulltime")


def _events(bucket: str, where: str) -> str:
    base = f"rider_id, employment_type, is_completed, is_cancelled, (is_completed OR {_LATE5}) AS valid"
    took = f"SELECT {base}, CAST(accept_time AS DATE) AS date, accept_hour AS hour, {str(bucket == 'accept').lower()} AS made, true AS took FROM dwd WHERE {where} AND accept_hour IS NOT NULL"
    made = f"SELECT {base}, order_date AS date, order_hour AS hour, true AS made, false AS took FROM dwd WHERE {where}"
    return took if bucket == "accept" else f"{made} UNION ALL {took}"


_HOUR_COUNTS = (
    f"{n('made')} AS total_orders, {n('made AND is_completed')} AS completed_orders, {n('made AND is_cancelled')} AS cancelled_orders, {n('made AND valid')} AS valid_orders, "
    + ", ".join(f"{n(f'made AND is_completed AND employment_type = {k!r}')} AS {k}_completed_orders" for k in _KINDS)
)
_HOUR_RIDERS = f"{d('rider_id', 'took')} AS accepted_riders, " + ", ".join(f"{d('rider_id', f'took AND employment_type = {k!r}')} AS {k}_accepted_riders" for k in _KINDS)
_HOUR_RATES = (
    f"{r('completed_orders', 'total_orders')} AS completion_rate, {r('cancelled_orders', 'total_orders')} AS cancel_rate, {r('completed_orders', 'valid_orders')} AS valid_completion_rate, "
    f"{r('completed_orders', 'accepted_riders', 2)} AS efficiency, " + ", ".join(f"{r(f'{k}_completed_orders', f'{k}_accepted_riders', 2)} AS {k}_efficiency" for k in _KINDS)
)


def hours(bucket: str, where: str, keys: str) -> str:
    return f"SELECT *, {_HOUR_RATES} FROM (SELECT {keys}, {_HOUR_COUNTS}, {_HOUR_RIDERS} FROM ({_events(bucket, where)}) GROUP BY ALL)"


def hour_summary(bucket: str, where: str) -> str:
    names = ["total_orders", "completed_orders", "cancelled_orders", "valid_orders", *[f"{k}_completed_orders" for k in _KINDS], "accepted_riders", *[f"{k}_accepted_riders" for k in _KINDS]]
    sums = ", ".join(f"sum({x})::BIGINT AS {x}" for x in names)
    return f"SELECT *, {_HOUR_RATES} FROM (SELECT hour, {sums} FROM (SELECT date, hour, {_HOUR_COUNTS}, {_HOUR_RIDERS} FROM ({_events(bucket, where)}) GROUP BY ALL) GROUP BY hour)"


ACCEPTED = f"accept_time >= TIMESTAMP '{START}' AND accept_time < TIMESTAMP '2026-04-10' AND partner_id = '{PARTNER}'"
_W = "coalesce(order_elapsed_minutes_to_cancel, 0) > 8"
_NO = "is_cancelled AND is_unaccepted_cancel"
_CANCEL = (
    f"{n(_NO)} AS unaccepted_cancel_orders, {n(f'{_NO} AND {_W}')} AS unaccepted_timeout_cancel_orders, {n(f'{_NO} AND {_W} AND service_online_flag')} AS unaccepted_timeout_online_cancel_orders, "
    f"{n(f'{_NO} AND {_W} AND NOT service_online_flag')} AS unaccepted_timeout_offline_cancel_orders, {n(f'{_NO} AND NOT ({_W})')} AS unaccepted_not_timeout_cancel_orders, "
    f"{n('is_accepted_cancel AND is_rider_noliability_cancel')} AS accepted_noliability_cancel_orders, {n('is_cancelled AND NOT is_paid')} AS unpaid_cancel_orders"
)
_ONLINE = f"{r('unaccepted_timeout_online_cancel_orders', 'total_orders')} AS unaccepted_timeout_online_cancel_rate"
_DH = (
    f"{runtime(8)}, {n('is_cancelled AND NOT is_paid')} AS unpaid_orders, {n('is_unaccepted_cancel')} AS unaccepted_cancel_orders, {n('is_accepted_cancel')} AS accepted_cancel_orders, "
    f"{d('rider_id', 'accept_time IS NOT NULL')} AS accepted_riders, "
    + ", ".join(f"{n(f'is_completed AND employment_type = {k!r}')} AS {k}_completed_orders, {d('rider_id', f'is_completed AND employment_type = {k!r}')} AS {k}_riders" for k in _KINDS)
)
_DH_NAMES = "total_orders valid_orders completed_orders cancelled_orders valid_cancel_orders unpaid_orders unaccepted_cancel_orders accepted_cancel_orders accepted_riders parttime_completed_orders parttime_riders fulltime_completed_orders fulltime_riders".split()
_DH_RATES = f"{RATES}, " + ", ".join(f"{r(f'{k}_completed_orders', f'{k}_riders', 2)} AS {k}_efficiency" for k in _KINDS)
_DH_EACH = f"SELECT order_date AS date, order_hour AS hour, {_DH} FROM dwd WHERE {WP} GROUP BY ALL"
BASE, NOW = "date BETWEEN DATE '2026-03-01' AND DATE '2026-03-31'", "date BETWEEN DATE '2026-04-01' AND DATE '2026-04-30'"
_P = {"baseline": BASE, "current": NOW}


def _two(name: str, value: str | None = None) -> str:
    return ", ".join(f"sum(CASE WHEN {c} THEN {value or name} ELSE 0 END) AS {p}_{name}" for p, c in _P.items())


def _price(a: str, b: str) -> str:
    return f"coalesce(round({a} / nullif({b}, 0)) / 100, 0)"


MERCHANTS = f"""SELECT partner_id, partner_name, merchant_id, merchant_name, baseline_total_orders::BIGINT AS baseline_total_orders, current_total_orders::BIGINT AS current_total_orders,
  (current_total_orders - baseline_total_orders)::BIGINT AS change_total_orders, {r('baseline_completed_orders', 'baseline_total_orders')} AS baseline_completion_rate,
  {r('current_completed_orders', 'current_total_orders')} AS current_completion_rate,
  round({r('current_completed_orders', 'current_total_orders')} - {r('baseline_completed_orders', 'baseline_total_orders')}, 4) AS change_completion_rate,
  {_price('baseline_paid', 'baseline_total_orders')} AS baseline_avg_price, {_price('current_paid', 'current_total_orders')} AS current_avg_price,
  {', '.join(f"current_{k}_orders::BIGINT AS current_{k}_orders, {_price(f'current_{k}_paid', f'current_{k}_orders')} AS current_{k}_avg_price" for k in ('unaccepted_cancel', 'accepted_cancel', 'completed'))}
FROM (SELECT partner_id, merchant_id, max(partner_name) AS partner_name, max(merchant_name) AS merchant_name, {_two('total_orders')},
  {', '.join(f"{_two(f'{k}_orders')}, {_two(f'{k}_paid', f'round({k}_amount_paid * 100)')}" for k in ('unaccepted_cancel', 'accepted_cancel', 'completed'))}, {_two('paid', 'round(avg_amount_paid * 100) * total_orders')}
  FROM ({DIRECT_MERCHANT}) WHERE {BASE} OR {NOW} GROUP BY ALL) ORDER BY current_completed_orders DESC, current_total_orders DESC, partner_id, merchant_id LIMIT 100"""
SOURCES = f"""SELECT order_source, baseline_total_orders::BIGINT AS baseline_total_orders, current_total_orders::BIGINT AS current_total_orders, (current_total_orders - baseline_total_orders)::BIGINT AS change_total_orders,
  baseline_unaccepted_cancel_orders::BIGINT AS baseline_unaccepted_cancel_orders, current_unaccepted_cancel_orders::BIGINT AS current_unaccepted_cancel_orders, current_completed_orders::BIGINT AS current_completed_orders,
  coalesce(v, 0) AS current_valid_orders FROM (SELECT order_source, {_two('total_orders')}, {_two('unaccepted_cancel_orders')}, {_two('completed_orders')} FROM ({SOURCE_DAY}) WHERE {BASE} OR {NOW} GROUP BY 1)
  LEFT JOIN (SELECT coalesce(order_source, '未知') AS order_source, {n('is_valid_order')} AS v FROM dwd WHERE order_date BETWEEN DATE '2026-04-01' AND DATE '2026-04-30' GROUP BY 1) USING (order_source)"""
_MATRIX_DAY = f"SELECT rider_id, order_date AS date, {DONE} AS x, max(is_new_rider_order::INT) AS fresh FROM dwd WHERE {WP} GROUP BY ALL"
_CELL = f"SELECT rider_id, c.date, coalesce(x, 0) AS x FROM (SELECT DISTINCT rider_id FROM ({_MATRIX_DAY})) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS date) c LEFT JOIN ({_MATRIX_DAY}) y USING (rider_id, date)"
MATRIX = f"""WITH_PART SELECT rider_id, rider_name, strftime(hire_date, '%Y-%m-%d') AS hire_date, completed_orders, qualified_days, is_new_rider, (qualified_days >= 3)::BIGINT AS is_target_met, days, false AS is_total
 FROM (SELECT rider_id, sum(x)::BIGINT AS completed_orders, count(*) FILTER (WHERE x >= 1) AS qualified_days, string_agg(x::VARCHAR, ',' ORDER BY date) AS days FROM ({_CELL}) GROUP BY 1)
 JOIN (SELECT rider_id, max(fresh) AS is_new_rider FROM ({_MATRIX_DAY}) GROUP BY 1) USING (rider_id) LEFT JOIN rider_roster USING (rider_id)
UNION ALL SELECT '-', '-', NULL, sum(completed_orders)::BIGINT, sum(qualified_days)::BIGINT, NULL, sum((qualified_days >= 3)::BIGINT)::BIGINT, (SELECT string_agg(x::VARCHAR, ',' ORDER BY date) FROM (SELECT date, sum(x)::BIGINT AS x FROM ({_CELL}) GROUP BY 1)), true
 FROM (SELECT rider_id, sum(x)::BIGINT AS completed_orders, count(*) FILTER (WHERE x >= 1) AS qualified_days FROM ({_CELL}) GROUP BY 1)""".replace("WITH_PART ", "")
_NEW_ORDER = "ORDER BY completed_orders DESC, total_orders DESC, partner_id, {0}_id LIMIT 100"


def _new(entity: str) -> str:
    return f"""SELECT *, {r('completed_orders', 'total_orders')} AS completion_rate FROM (SELECT partner_id, {entity}_id, max(partner_name) AS partner_name, max({entity}_name) AS {entity}_name,
      sum(total_orders)::BIGINT AS total_orders, sum(completed_orders)::BIGINT AS completed_orders FROM ({TABLES[f'new_{entity}s']}) WHERE order_month BETWEEN '2026-03' AND '2026-04' GROUP BY ALL) {_NEW_ORDER.format(entity)}"""


def _bands(rows: str, bands: tuple, name: str) -> str:
    cases = " ".join(f"WHEN v BETWEEN {a} AND {b} THEN '{x}'" for x, a, b in bands)
    labels = ", ".join(f"'{x}'" for x, *_ in bands)
    return f"""SELECT label, coalesce(c, 0) AS {name} FROM (SELECT unnest([{labels}]) AS label) LEFT JOIN (SELECT CASE {cases} END AS label, count(*) AS c FROM ({rows}) GROUP BY 1) USING (label)
      UNION ALL SELECT '合计', count(*) FILTER (WHERE CASE {cases} END IS NOT NULL) FROM ({rows})"""


_TREND = f"SELECT date, {', '.join(f'sum({x})::BIGINT AS {x}' for x in ('total_orders', 'valid_orders', 'completed_orders', 'cancelled_orders'))}, round(sum(hq_subsidy_total), 2) AS hq_subsidy_total, round(sum(partner_subsidy_total), 2) AS partner_subsidy_total FROM ({m.ADMIN_PARTNER}) WHERE date {SPAN} GROUP BY 1"
_AGE = "CASE WHEN order_date - open_date <= 30 THEN '0-30' WHEN order_date - open_date <= 60 THEN '31-60' WHEN order_date - open_date <= 90 THEN '61-90' END"
_LAST = f"(SELECT DISTINCT date FROM ({PARTNER_DAY}) ORDER BY date DESC LIMIT 3)"

VIEWS = {
    "e1_directory": "SELECT partner_id, partner_name, province, city, district FROM partner_roster",
    "e1_regions": "SELECT DISTINCT province, city, district FROM dwd",
    "e3a_admin_summary": f"SELECT *, {RATES}, {EFFICIENCY}, {MONEY} FROM (SELECT {runtime()}, {FINANCE} FROM dwd WHERE {W}), {_active('partner')}, {_active('rider')}, {_active('merchant')}",
    "e3d_daily_trend": f"SELECT *, {r('completed_orders', 'total_orders')} AS completion_rate, {r('cancelled_orders', 'total_orders')} AS cancel_rate FROM ({_TREND})",
    "e3e_ranking": ranking("partner_id"),
    "e3e_ranking_city": ranking("province, city"),
    "e3f_partner_tiers": _bands(f"SELECT count(*)::DOUBLE / 31 AS v FROM dwd WHERE {W} GROUP BY partner_id", (("0-4", 0, 4), ("5-9", 5, 9), ("10-14", 10, 14), ("15+", 15, 1e18)), "partners"),
    "e3g_new_partner_orders": f"SELECT partner_id, partner_name, {_AGE} AS label, count(*) AS completed_orders FROM dwd WHERE {W} AND is_completed AND {_AGE} IS NOT NULL GROUP BY ALL ORDER BY label, completed_orders DESC, partner_id LIMIT 60",
    "e3i_watch_red": f"SELECT * FROM ({HEALTH}) WHERE health_band = 'red' ORDER BY health_score, completed_orders DESC, partner_id LIMIT 50",
    "e3i_watch_yellow": f"SELECT * FROM ({HEALTH}) WHERE health_band = 'yellow' ORDER BY health_score, completed_orders DESC, partner_id LIMIT 50",
    "e3j_recent_days": f"SELECT partner_id, date, partner_name, total_orders, completed_orders FROM ({PARTNER_DAY}) WHERE date BETWEEN DATE '2026-04-27' AND DATE '2026-04-30'",
    "e4_fluctuation": f"""SELECT partner_id, partner_name, date, completed_orders, round(b, 2) AS baseline_orders, round(completed_orders - b, 2) AS change, round(coalesce((completed_orders - b) / nullif(b, 0), 0), 4) AS change_rate,
        new_riders, new_merchants, active_riders, active_merchants, cancel_rate, hq_subsidy_total, partner_subsidy_total, CASE WHEN b >= 10 THEN 'large' WHEN b >= 5 THEN 'medium' ELSE 'small' END AS city_level
        FROM (SELECT *, avg(completed_orders) OVER (PARTITION BY partner_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY partner_id ORDER BY date DESC) AS k FROM ({PARTNER_DAY}))
        WHERE k = 1 AND b IS NOT NULL AND abs(completed_orders - b) >= CASE WHEN b >= 5 THEN 3 ELSE 2 END AND abs(coalesce((completed_orders - b) / nullif(b, 0), 0)) >= CASE WHEN b >= 5 THEN 0.2 ELSE 0.3 END::DOUBLE
        ORDER BY abs(coalesce((completed_orders - b) / nullif(b, 0), 0)) DESC, partner_id LIMIT 50""",
    "e5_hours": hours("order", W, "hour"),
    "e6_health": f"SELECT * FROM ({HEALTH}) ORDER BY health_score DESC, completed_orders DESC, partner_id LIMIT 100",
    "e7_overview": OVERVIEW,
    "e8_partner_health": health(HEALTH_SOURCE.replace(W, WP), "31"),
    "e9_partner_daily": f"SELECT *, {RATES}, {EFFICIENCY}, {MONEY}, {SLA_RATES} FROM (SELECT order_date AS date, {runtime(8)}, {FINANCE}, {SLA}, {ENTITIES} FROM dwd WHERE {WP} GROUP BY 1)",
    "e10_hours": hours("order", WP, "date, hour"),
    "e10_hours_accept": hours("accept", ACCEPTED, "date, hour"),
    "e10_hour_summary": hour_summary("order", WP),
    "e10_rider_days": f"SELECT date, {_HOUR_RIDERS} FROM ({_events('order', WP)}) WHERE took GROUP BY 1",
    "e11_rider_matrix": MATRIX,
    "e11_rider_tiers": _bands(f"SELECT {DONE} AS v FROM dwd WHERE {WP} GROUP BY rider_id", (("1-9", 1, 9), ("10-29", 10, 29), ("30-49", 30, 49), ("50+", 50, 1e18)), "riders"),
    "e11_new_rider_days": f"SELECT order_date AS date, count(*) AS completed_orders FROM dwd WHERE {WP} AND is_completed AND is_new_rider_order GROUP BY 1",
    "e12_new_merchant_days": f"SELECT order_date AS date, count(*) AS completed_orders FROM dwd WHERE {WP} AND is_completed AND is_new_merchant_order GROUP BY 1",
    "e12_merchants": f"SELECT *, {r('completed_orders', 'total_orders')} AS completion_rate, {r('cancelled_orders', 'total_orders')} AS cancel_rate FROM (SELECT merchant_id, max(merchant_name) AS merchant_name, max(shop_name) AS shop_name, max(register_date) AS register_date, {TOTAL} AS total_orders, {DONE} AS completed_orders, {OFF} AS cancelled_orders, max(is_new_merchant_order::INT) AS is_new_merchant FROM dwd WHERE {WP} GROUP BY 1)",
    "e13_merchant_like_users": f"SELECT user_id, sum(total_orders)::BIGINT AS total_orders, sum(completed_orders)::BIGINT AS completed_orders, sum(cancelled_orders)::BIGINT AS cancelled_orders FROM ({USER_DAY}) WHERE date {SPAN} GROUP BY 1 HAVING sum(completed_orders) >= 4 ORDER BY completed_orders DESC, user_id LIMIT 20",
    "e15_order_sources": f"SELECT *, {RATES}, round(total_orders::DOUBLE / sum(total_orders) OVER (), 4) AS share FROM (SELECT coalesce(order_source, '未知') AS order_source, {runtime()} FROM dwd WHERE {WP} GROUP BY 1)",
    "e16_rider_income": f"SELECT *, coalesce({avg('commission', 'completed_orders')}, 0) AS avg_commission FROM (SELECT rider_id, max(rider_name) AS rider_name, {DONE} AS completed_orders, {_done('rider_income')} AS commission FROM dwd WHERE {WP} GROUP BY 1) WHERE completed_orders > 0 OR commission > 0 ORDER BY commission DESC, completed_orders DESC, rider_id LIMIT 200",
    "e18_cancel_daily": f"SELECT *, {RATES}, {MONEY}, {SLA_RATES}, {_ONLINE} FROM (SELECT order_date AS date, {runtime(8)}, {_CANCEL}, {FINANCE}, {SLA} FROM dwd WHERE {WP} GROUP BY 1)",
    "e18_cancel_summary": f"SELECT *, {RATES}, {EFFICIENCY}, {MONEY}, {SLA_RATES}, {_ONLINE} FROM (SELECT {runtime(8)}, {_CANCEL}, {FINANCE}, {SLA}, {ENTITIES} FROM dwd WHERE {WP})",
    "e19_direct_hours": f"SELECT *, {_DH_RATES} FROM ({_DH_EACH})",
    "e19_direct_hour_summary": f"SELECT *, {_DH_RATES} FROM (SELECT hour, {', '.join(f'sum({x})::BIGINT AS {x}' for x in _DH_NAMES)} FROM ({_DH_EACH}) GROUP BY 1)",
    "e20_new_riders": _new("rider"),
    "e20_new_merchants": _new("merchant"),
    "e21_merchant_comparison": MERCHANTS,
    "e22_source_comparison": SOURCES,
    "e23_coupons": f"SELECT coalesce(sum(coupon_order_count), 0)::BIGINT AS coupon_orders, {', '.join(f'coalesce(round(sum({x}), 2), 0) AS {x}' for x in ('hq_discount_total', 'discount_total', 'total_discount'))} FROM ({COUPON_DAY}) WHERE date {SPAN}",
    "c2_heatmap": "SELECT date, " + ", ".join(f"sum(CASE WHEN hour = {h} THEN completed_orders ELSE 0 END)::BIGINT AS h{h:02d}" for h in range(24)) + f", sum(completed_orders)::BIGINT AS total FROM ({TABLES['partner_hour']}) GROUP BY 1",
    "c3_last_dates": f"""SELECT partner_id, d1, d2, d3, coalesce(d1, d2, d3) - coalesce(d3, d2, d1) AS trend FROM (SELECT partner_id, {', '.join(f'sum(completed_orders) FILTER (WHERE k = {i})::BIGINT AS d{i}' for i in (1, 2, 3))}
        FROM ({PARTNER_DAY}) JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM {_LAST}) USING (date) GROUP BY 1)""",
    "c4_extremes": f"SELECT * FROM (SELECT partner_id, health_score, 'low' AS end FROM ({HEALTH}) ORDER BY health_score, partner_id LIMIT 5) UNION ALL SELECT * FROM (SELECT partner_id, health_score, 'high' AS end FROM ({HEALTH}) ORDER BY health_score DESC, partner_id LIMIT 5)".replace("AS end", 'AS "end"'),
    "c5_peak_hour": f"SELECT (SELECT hour FROM ({hours('order', W, 'hour')}) ORDER BY total_orders DESC, hour LIMIT 1) AS peak_hour, max(total_orders) AS peak, {r('sum(completed_orders)', 'sum(accepted_riders)', 2)} AS efficiency FROM ({hours('order', W, 'hour')})",
}
