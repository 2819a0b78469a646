"""All registered queries over the test bed, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline import testbed
from ridgeline.config import Settings, Swing, Tier
from ridgeline.functions.periods import periods
from ridgeline.operators import ads, dwd
from ridgeline.oracles import mart as mart_sql
from ridgeline.oracles import metrics
from ridgeline.oracles import views as view_sql
from ridgeline.plans import mart, views
from ridgeline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters that suit the test bed's few orders a day.
CFG = Settings(excluded_partners=("7",), swings=(Swing("large", 10, 3, 0.2), Swing("medium", 5, 3, 0.2), Swing("small", 0, 2, 0.3)),
               partner_tiers=(Tier("0-4", 0, 4), Tier("5-9", 5, 9), Tier("10-14", 10, 14), Tier("15+", 15)), merchant_like_orders=4, rider_daily_target=1, rider_target_days=3)


#: Folders of the facts and rosters written so far and their schemas, by session, input and its files' state.
_WRITTEN: dict[tuple, tuple[str, dict[str, StructType]]] = {}


class Rosters:
    """The rosters that were written beside a fact, each read when it is asked for."""

    def __init__(self, read: Callable[[str], DataFrame]):
        self._read = read

    riders = property(lambda self: self._read("riders"))
    merchants = property(lambda self: self._read("merchants"))
    partners = property(lambda self: self._read("partners"))


def fact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Rosters]:
    """The fact by month and the rosters, as the warehouse keeps them: written once a session and state of the input, then read."""
    state = tables.stamp(spark, [f"{sf_dir}/{t}.parquet" for t in testbed.TABLES])
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _WRITTEN or not tables.exists(spark, _WRITTEN[key][0]):
        x = testbed.inputs(spark, sf_dir)
        made = {"dwd_orders": dwd.build(x.orders, x.riders, x.merchants, x.partners, CFG), "riders": x.riders, "merchants": x.merchants, "partners": x.partners}
        folder = f"{tables.work_dir(spark)}/ridgeline-{uuid.uuid4().hex}"
        for name, df in made.items():
            if name == "dwd_orders":
                tables.replace_months(df, f"{folder}/{name}", parts=16)  # two months, of rows much wider than the test table's
            else:
                df.write.parquet(f"{folder}/{name}")
        _WRITTEN[key] = folder, {name: df.schema for name, df in made.items()}
    folder, schemas = _WRITTEN[key]

    def read(name: str) -> DataFrame:
        return spark.read.schema(schemas[name]).parquet(f"{folder}/{name}").select(*schemas[name].names)

    return read("dwd_orders"), Rosters(read)


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = testbed.inputs(spark, sf_dir)
    return dwd.build(x.orders, x.riders, x.merchants, x.partners, CFG)


def _table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = fact(spark, sf_dir)
    roster = ads.WITH_ROSTER.get(name)
    return ads.TABLES[name](rows, getattr(x, roster)) if roster else ads.TABLES[name](rows)


def _mart(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = fact(spark, sf_dir)
    return mart.TABLES[name][1](mart.Layers(rows, x.riders, x.merchants, x.partners, CFG))


WINDOW = views.Filters.of_request(date(2026, 3, 10), date(2026, 4, 9))
OWN = views.Filters.of_request(WINDOW.start, WINDOW.end, partner_id="3")
MARCH, APRIL = periods(date(2026, 4, 1), date(2026, 4, 30), baseline=(date(2026, 3, 1), date(2026, 3, 31)))
BOTH = views.Filters(MARCH[0], APRIL[1])


def _matrix(f: DataFrame, x: Rosters) -> DataFrame:
    out = views.rider_matrix(f, x.riders, OWN, CFG)
    return out.withColumn("days", F.array_join(F.transform(F.array_sort(F.map_entries("days")), lambda e: e["value"].cast("string")), ","))


#: The dashboard's views by name, from the fact and the rosters.
VIEWS: dict[str, Callable[[DataFrame, Rosters], DataFrame]] = {
    "e1_directory": lambda f, x: views.directory(x.partners, ads.partner_day(f, entities=False)),
    "e1_regions": lambda f, x: views.regions(ads.partner_day(f, entities=False)),
    "e3a_admin_summary": lambda f, x: views.admin_summary(f, WINDOW, CFG),
    "e3d_daily_trend": lambda f, x: views.daily_trend(ads.admin_partner(f, entities=False), WINDOW),
    "e3e_ranking": lambda f, x: views.ranking(f, WINDOW, CFG),
    "e3e_ranking_city": lambda f, x: views.ranking(f, WINDOW, CFG, "city"),
    "e3f_partner_tiers": lambda f, x: views.partner_tiers(f, WINDOW, CFG),
    "e3g_new_partner_orders": lambda f, x: views.new_partner_orders(f, x.partners, WINDOW),
    "e3i_watch_red": lambda f, x: views.watch_list(f, WINDOW, CFG, "red"),
    "e3i_watch_yellow": lambda f, x: views.watch_list(f, WINDOW, CFG, "yellow"),
    "e3j_recent_days": lambda f, x: views.recent_days(ads.partner_day(f, entities=False), date(2026, 4, 30)),
    "e4_fluctuation": lambda f, x: views.fluctuation(ads.partner_day(f), CFG),
    "e5_hours": lambda f, x: views.hours(WINDOW.apply(f), CFG.cancel_minutes, by_date=False),
    "e6_health": lambda f, x: views.health(f, WINDOW, CFG),
    "e7_overview": lambda f, x: views.overview(f, OWN, CFG, 8, 40),
    "e8_partner_health": lambda f, x: views.health(f, OWN, CFG),
    "e9_partner_daily": lambda f, x: views.partner_daily(f, OWN, CFG, 8, 40),
    "e10_hours": lambda f, x: views.hours(OWN.apply(f), CFG.cancel_minutes),
    "e10_hours_accept": lambda f, x: views.hours(views.accepted_within(f.filter("partner_id = '3'"), OWN.start, OWN.end), CFG.cancel_minutes, "accept"),
    "e10_hour_summary": lambda f, x: views.hour_summary(OWN.apply(f), CFG.cancel_minutes),
    "e10_rider_days": lambda f, x: views.rider_days(OWN.apply(f), CFG.cancel_minutes),
    "e11_rider_matrix": _matrix,
    "e11_rider_tiers": lambda f, x: views.rider_tiers(f, OWN, CFG),
    "e11_new_rider_days": lambda f, x: views.newcomer_days(f, OWN, "rider"),
    "e12_merchants": lambda f, x: views.merchants(f, x.merchants, OWN),
    "e12_new_merchant_days": lambda f, x: views.newcomer_days(f, OWN, "merchant"),
    "e13_merchant_like_users": lambda f, x: views.merchant_like_users(ads.partner_user_day(f), WINDOW, CFG),
    "e15_order_sources": lambda f, x: views.order_sources(f, OWN, CFG),
    "e16_rider_income": lambda f, x: views.rider_income(f, x.riders, OWN),
    "e18_cancel_daily": lambda f, x: views.cancel_daily(f, OWN, CFG, 8, 40),
    "e18_cancel_summary": lambda f, x: views.cancel_daily(f, OWN, CFG, 8, 40, by_day=False),
    "e19_direct_hours": lambda f, x: views.direct_hours(f, OWN, CFG, 8),
    "e19_direct_hour_summary": lambda f, x: views.direct_hours(f, OWN, CFG, 8, by_date=False),
    "e20_new_riders": lambda f, x: views.new_entities(ads.new_riders(f, x.riders), "rider", BOTH),
    "e20_new_merchants": lambda f, x: views.new_entities(ads.new_merchants(f, x.merchants), "merchant", BOTH),
    "e21_merchant_comparison": lambda f, x: views.merchant_comparison(ads.merchant_day(f), MARCH, APRIL),
    "e22_source_comparison": lambda f, x: views.source_comparison(ads.source_day(f), f, MARCH, APRIL, CFG),
    "e23_coupons": lambda f, x: views.coupons(ads.coupon_day(f), WINDOW),
    "c2_heatmap": lambda f, x: views.heatmap(ads.partner_hour(f), total=True),
    "c3_last_dates": lambda f, x: views.last_dates(ads.partner_day(f, entities=False)),
    "c4_extremes": lambda f, x: views.extremes(views.partner_scores(f, WINDOW, CFG).select("partner_id", "health_score"), "health_score", "partner_id"),
    "c5_peak_hour": lambda f, x: views.peak_hour(views.hours(WINDOW.apply(f), CFG.cancel_minutes, by_date=False)),
}


def _view(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return VIEWS[name](*fact(spark, sf_dir))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"dwd_order_fact": _fact}
    out |= {f"q{i}_{name}": partial(_table, name) for i, name in enumerate(ads.TABLES, 1)}
    out |= {f"b{i}_{name}": partial(_mart, name) for i, name in enumerate(mart.TABLES, 1)}
    out |= {name: partial(_view, name) for name in VIEWS}
    return out


def oracles() -> dict[str, str]:
    out = {"dwd_order_fact": metrics.FACT}
    out |= {f"q{i}_{name}": metrics.TABLES[name] for i, name in enumerate(ads.TABLES, 1)}
    out |= {f"b{i}_{name}": mart_sql.TABLES[name] for i, name in enumerate(mart.TABLES, 1)}
    out |= view_sql.VIEWS
    return {k: f"{metrics.WITH} {v}" for k, v in out.items()}
