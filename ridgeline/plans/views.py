"""What the dashboard asks for, as DataFrames: filters, aggregates and rankings over the fact and metric tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Settings, Tier
from ridgeline.functions.expressions import average_money, blank_to_null, count_if, half_up, minutes_between, money, quotient, ratio0, repaired, sum_if
from ridgeline.functions.health import scored
from ridgeline.functions.measures import Measure, aggregate, count, distinct, most, total_if
from ridgeline.functions.periods import check_window, day_count, period_of, within
from ridgeline.operators import ads
from ridgeline.operators.ads import NO_SOURCE, C

KINDS = ("parttime", "fulltime")
_PLACE = ("province", "city", "district")


@dataclass(frozen=True)
class Filters:
    """What a request narrows down; what is empty does not apply."""

    start: date | None = None
    end: date | None = None
    province: str | None = None
    city: str | None = None
    district: str | None = None
    partner_id: str | None = None

    @classmethod
    def of_request(cls, start: date | None = None, end: date | None = None, **more: str | None) -> Filters:
        """The filters of a request; ValueError for a window that the dashboard does not take."""
        check_window(start, end)
        return cls(start, end, **more)

    def of(self, column: str = "order_date") -> Column:
        out = within(C(column), (self.start, self.end))
        for name in (*_PLACE, "partner_id"):
            if getattr(self, name):
                out = out & (C(name) == getattr(self, name))
        return out

    def apply(self, df: DataFrame, column: str = "order_date") -> DataFrame:
        """The rows of the window and place; where the table has months, those outside of the window are not read."""
        out = df.filter(C(column).isNotNull() & self.of(column))
        if "order_month" in df.columns:
            for day, side in ((self.start, C("order_month").__ge__), (self.end, C("order_month").__le__)):
                out = out.filter(side(F.lit(f"{day:%Y-%m}"))) if day else out
        return out


# ----------------------------------------------------------- shared pieces


def per_order(total: str | Column, n: str | Column) -> Column:
    """Average money, 0 where there are no orders."""
    a, b = (C(x) if isinstance(x, str) else x for x in (total, n))
    return F.coalesce(average_money(a, b), F.lit(0.0))


def runtime(threshold: float) -> dict[str, Measure]:
    """Order counts in which the request's own threshold decides what a valid cancellation is."""
    late = C("is_cancelled") & C("is_paid") & (F.coalesce("pay_cancel_minutes", F.lit(0.0)) > threshold)
    return {
        "total_orders": count(), "valid_orders": count(C("is_completed") | late), "completed_orders": count(C("is_completed")),
        "cancelled_orders": count(C("is_cancelled")), "valid_cancel_orders": count(late),
    }


def finance() -> dict[str, Measure]:
    done = C("is_completed")
    return {
        "received": total_if(done, C("amount_paid"), money), "rider_commission": total_if(done, C("rider_income"), money),
        "partner_income": total_if(done, C("partner_income"), money), "partner_subsidy": total_if(done, C("partner_subsidy_amount"), money),
        "hq_subsidy": total_if(done, C("hq_subsidy_amount"), money),
    }


def sla(on_time: float, minutes: float) -> dict[str, Measure]:
    """Completed orders by the time from acceptance; those without it are left out of the base."""
    took = minutes_between(C("accept_time"), C("complete_time"))
    base = C("is_completed") & took.isNotNull()
    return {
        "sla_base": count(base), "on_time_orders": count(base & (took <= on_time)), "sla_on_time_orders": count(base & (took <= minutes)),
        "sla_overtime_orders": count(base & (took > minutes)),
    }


def entities() -> dict[str, Measure]:
    return {n: ads.MEASURES[n]() for n in ("active_merchants", "new_merchants", "active_riders", "new_riders")}


def agg(df: DataFrame, keys: list[str] | dict[str, Column], *groups: dict[str, Measure]) -> DataFrame:
    """Measures by keys; without keys one row."""
    wanted = {n: m for g in groups for n, m in g.items()}
    if not keys:
        return df.agg(*[m.column.alias(n) for n, m in wanted.items()])
    return aggregate(df, keys if isinstance(keys, dict) else {k: C(k) for k in keys}, wanted)


def with_rates(df: DataFrame) -> DataFrame:
    """The ratios of whatever counts the table has."""
    rates = {
        "completion_rate": ("completed_orders", "total_orders"), "cancel_rate": ("cancelled_orders", "total_orders"), "valid_completion_rate": ("completed_orders", "valid_orders"),
        "valid_cancel_rate": ("valid_cancel_orders", "valid_orders"), "efficiency": ("completed_orders", "active_riders"), "on_time_rate": ("on_time_orders", "sla_base"),
        "sla_on_time_rate": ("sla_on_time_orders", "sla_base"), "sla_overtime_rate": ("sla_overtime_orders", "sla_base"),
    }
    have = set(df.columns)
    out = {n: ratio0(C(a), C(b), 2 if n == "efficiency" else 4) for n, (a, b) in rates.items() if a in have and b in have}
    if "received" in have:
        out |= {
            "profit": half_up(C("partner_income") - C("partner_subsidy"), 2), "avg_ticket_price": per_order("received", "completed_orders"),
            "rider_avg_commission": per_order("rider_commission", "completed_orders"),
        }
    return df.withColumns(out)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tiered(value: Column, tiers: tuple[Tier, ...]) -> Column:
    """The label of the first band that holds the value; none for a value between bands."""
    out = F.lit(None).cast("string")
    for t in reversed(tiers):
        fits = value >= t.low if t.high is None else value.between(t.low, t.high)
        out = F.when(fits, F.lit(t.label)).otherwise(out)
    return out


# ---------------------------------------------------------- headquarters


def directory(partners: DataFrame, partner_day: DataFrame) -> DataFrame:
    """All partners known to the roster or the metrics; what the roster has goes first."""
    seen = partner_day.filter(C("partner_id") != ads.UNKNOWN).groupBy("partner_id").agg(*[F.max(n).alias(f"seen_{n}") for n in ("partner_name", *_PLACE)])
    both = partners.select("partner_id", "partner_name", *_PLACE).join(seen, "partner_id", "full_outer")
    return both.select("partner_id", *[repaired(F.coalesce(blank_to_null(C(n)), f"seen_{n}")).alias(n) for n in ("partner_name", *_PLACE)])


def region_choices(places: DataFrame, f: Filters) -> tuple[Filters, DataFrame]:
    """What of a chosen province, city and district exists, and the regions within it.

    From the widest on: a choice that none of the regions left has is dropped, the others narrow them.
    """
    left = places.select(*_PLACE).distinct()
    for name in _PLACE:
        if chosen := getattr(f, name):
            own = left.filter(C(name) == chosen)
            if own.limit(1).count():  # a dimension of a few thousand rows
                left = own
            else:
                f = replace(f, **{name: None})
    return f, left


def regions(partner_day: DataFrame) -> DataFrame:
    return partner_day.select(*_PLACE).distinct()


_ENTITIES = ("partner", "rider", "merchant")


def admin_summary(fact: DataFrame, f: Filters, cfg: Settings) -> DataFrame:
    """One row: order counts, money, and entities with at least the active number of completed orders.

    One pass: each order counts for all and for its partner, rider and merchant, and the ids' counts are then counted.
    """
    of = [F.struct(F.lit("all").alias("kind"), F.lit("").alias("id"), F.lit(False).alias("is_new"))]
    of += [F.struct(F.lit(n).alias("kind"), blank_to_null(C(f"{n}_id")).alias("id"), C(f"is_new_{n}_order").alias("is_new")) for n in _ENTITIES]
    rows = f.apply(fact).withColumn("of", F.explode(F.array(*of))).select("*", "of.*").filter("id IS NOT NULL")
    whole = {**runtime(cfg.cancel_minutes), **finance()}
    each = agg(rows, ["kind", "id"], whole, {"new_completed": count(C("is_completed") & C("is_new"))})
    least = max(cfg.active_orders, 1)
    counts = runtime(cfg.cancel_minutes)
    out = [F.max(F.when(C("kind") == "all", C(n))).alias(n) for n in whole]
    for n in _ENTITIES:
        own = C("kind") == n
        out += [count_if(own & (C("completed_orders") >= least)).alias(f"active_{n}s"), count_if(own & (C("new_completed") > 0)).alias(f"new_{n}s")]
    one = each.agg(*out)
    return with_rates(one.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts}))


def daily_trend(admin_partner: DataFrame, f: Filters, only_new: tuple[str, ...] = ()) -> DataFrame:
    """Counts by day; ``only_new`` names flags (partner, rider, merchant) that a row must have."""
    rows = f.apply(admin_partner, "date")
    for name in only_new:
        rows = rows.filter(C("is_new_partner") if name == "partner" else C(f"new_{name}s") > 0)
    names = ("total_orders", "valid_orders", "completed_orders", "cancelled_orders")
    out = rows.groupBy("date").agg(*[F.sum(n).alias(n) for n in names], *[money(F.sum(n)).alias(n) for n in ("hq_subsidy_total", "partner_subsidy_total")])
    return with_rates(out).drop("valid_completion_rate")


def ranking(fact: DataFrame, f: Filters, cfg: Settings, level: str = "all", n: int = 50) -> DataFrame:
    """The ``n`` partners, provinces or cities with most completed orders."""
    keys = {"all": ["partner_id"], "province": ["province"], "city": ["province", "city"]}[level]
    out = with_rates(agg(f.apply(fact), keys, runtime(cfg.cancel_minutes), finance(), {"active_riders": ads.MEASURES["active_riders"]()}))
    return top(out, n, F.desc("completed_orders"), *[F.asc_nulls_last(k) for k in keys])


def partner_tiers(fact: DataFrame, f: Filters, cfg: Settings) -> DataFrame:
    """How many partners fall in each band of average orders a day, and a row with the total of the bands."""
    rows = f.apply(fact).filter(C("partner_id").isNotNull())
    closed = f.start and f.end
    days = day_count(f.start, f.end) if closed else day_count(None, None, rows.agg(F.count_distinct("order_date")).first()[0])
    each = rows.groupBy("partner_id").agg(F.count(F.lit(1)).alias("n"))
    label = tiered(quotient(C("n"), F.lit(days)), cfg.partner_tiers)
    return _banded(each.select(label.alias("label")), cfg.partner_tiers, "partners")


def _banded(rows: DataFrame, tiers: tuple[Tier, ...], name: str) -> DataFrame:
    counts = rows.agg(*[count_if(C("label") == t.label).alias(f"t{i}") for i, t in enumerate(tiers)])
    labels = [t.label for t in tiers] + ["合计"]
    values = [C(f"t{i}") for i in range(len(tiers))]
    every = F.array(*[F.struct(F.lit(x).alias("label"), v.alias(name)) for x, v in zip(labels, [*values, sum(values, F.lit(0))], strict=True)])
    return counts.select(F.inline(every))


def new_partner_orders(fact: DataFrame, partners: DataFrame, f: Filters, n: int = 60) -> DataFrame:
    """Completed orders of each partner in its first, second and third 30 days, one row each; earlier ones count in the first."""
    rows = f.apply(fact).filter("is_completed").join(partners.select("partner_id", "open_date").filter("open_date IS NOT NULL"), "partner_id")
    age = F.datediff("order_date", "open_date")
    bands = {"0-30": age <= 30, "31-60": (age > 30) & (age <= 60), "61-90": (age > 60) & (age <= 90)}
    sums = rows.groupBy("partner_id").agg(F.max("partner_name").alias("partner_name"), *[count_if(c).alias(b) for b, c in bands.items()])
    long = sums.unpivot(["partner_id", "partner_name"], list(bands), "label", "completed_orders").filter("completed_orders > 0")
    return top(long, n, "label", F.desc("completed_orders"), "partner_id")


def partner_scores(fact: DataFrame, f: Filters, cfg: Settings, days: int | None = None) -> DataFrame:
    """All partners with their health scores."""
    own = agg(
        f.apply(fact).filter(C("partner_id").isNotNull()), ["partner_id"], {"partner_name": most("partner_name")}, runtime(cfg.cancel_minutes), finance(), entities(),
        {"new_merchant_orders": ads.MEASURES["new_merchant_orders"]()},
    )
    own = with_rates(own)
    return scored(own, days or day_count(f.start, f.end))


def health(fact: DataFrame, f: Filters, cfg: Settings, n: int = 100, days: int | None = None) -> DataFrame:
    """The best ``n`` partners with their health scores, best first."""
    return top(partner_scores(fact, f, cfg, days), n, F.desc("health_score"), F.desc("completed_orders"), "partner_id")


def watch_list(fact: DataFrame, f: Filters, cfg: Settings, band: str, n: int = 50) -> DataFrame:
    """Partners of one band, worst first."""
    return top(partner_scores(fact, f, cfg).filter(C("health_band") == band), n, "health_score", F.desc("completed_orders"), "partner_id")


def recent_days(partner_day: DataFrame, today: date, days: int = 4) -> DataFrame:
    """Each partner's last days up to ``today``, by day."""
    rows = partner_day.filter(C("date").between(F.lit(today - timedelta(days=days - 1)), F.lit(today)))
    return rows.groupBy("partner_id", "date").agg(F.max("partner_name").alias("partner_name"), F.sum("total_orders").alias("total_orders"), F.sum("completed_orders").alias("completed_orders"))


def fluctuation(partner_day: DataFrame, cfg: Settings, n: int = 50) -> DataFrame:
    """Partners whose last day differs much from the mean of up to seven rows before it, by the limits of their size."""
    by = Window.partitionBy("partner_id").orderBy("date")
    rows = partner_day.withColumns({
        "baseline": F.avg("completed_orders").over(by.rowsBetween(-7, -1)), "back": F.row_number().over(Window.partitionBy("partner_id").orderBy(F.desc("date"))),
    }).filter("back = 1 AND baseline IS NOT NULL")
    change = C("completed_orders") - C("baseline")
    rows = rows.withColumns({"change": change, "share": F.coalesce(quotient(change, C("baseline")), F.lit(0.0))})
    level, hit = F.lit(None).cast("string"), F.lit(False)
    for s in sorted(cfg.swings, key=lambda s: s.at_least):  # the largest class that applies is set last
        of = C("baseline") >= s.at_least
        level = F.when(of, F.lit(s.name)).otherwise(level)
        hit = F.when(of, (F.abs("change") >= s.orders) & (F.abs("share") >= s.share)).otherwise(hit)
    out = rows.withColumns({"city_level": level, "hit": hit}).filter("hit").orderBy(F.desc(F.abs("share")), "partner_id").limit(n)
    return out.select(
        "partner_id", "partner_name", "date", "completed_orders", half_up(C("baseline"), 2).alias("baseline_orders"), half_up(C("change"), 2).alias("change"),
        half_up(C("share"), 4).alias("change_rate"), "new_riders", "new_merchants", "active_riders", "active_merchants", "cancel_rate", "hq_subsidy_total", "partner_subsidy_total", "city_level",
    )


# ------------------------------------------------------------------ hours


def _hour_events(rows: DataFrame, threshold: float, bucket: str) -> DataFrame:
    """An event for the hour an order was made in and one for the hour it was accepted in; by accept bucket, one for both."""
    late = C("is_cancelled") & C("is_paid") & (F.coalesce("pay_cancel_minutes", F.lit(0.0)) > threshold)
    accepted_on = F.coalesce(F.to_date("accept_time"), F.lit(None) if bucket == "accept" else C("order_date"))
    took = F.struct(accepted_on.alias("date"), C("accept_hour").alias("hour"), F.lit(bucket == "accept").alias("made"), F.lit(True).alias("took"))
    made = F.struct(C("order_date").alias("date"), C("order_hour").alias("hour"), F.lit(True).alias("made"), F.lit(False).alias("took"))
    events = F.array(took) if bucket == "accept" else F.array(made, took)
    out = rows.select("rider_id", "employment_type", "is_completed", "is_cancelled", (C("is_completed") | late).alias("valid"), F.explode(events).alias("e"))
    return out.select("*", "e.*").drop("e").filter("date IS NOT NULL AND hour IS NOT NULL")


def _riders(prefix: str = "") -> dict[str, Measure]:
    out = {"accepted_riders": distinct(C("took"), "rider_id")}
    return out | {f"{k}_accepted_riders": distinct(C("took") & (C("employment_type") == k), "rider_id") for k in KINDS}


def _hour_counts() -> dict[str, Measure]:
    made = C("made")
    out = {
        "total_orders": count(made), "completed_orders": count(made & C("is_completed")), "cancelled_orders": count(made & C("is_cancelled")),
        "valid_orders": count(made & C("valid")),
    }
    return out | {f"{k}_completed_orders": count(made & C("is_completed") & (C("employment_type") == k)) for k in KINDS} | _riders()


def _hour_rates(df: DataFrame) -> DataFrame:
    pairs = {"efficiency": ("completed_orders", "accepted_riders"), **{f"{k}_efficiency": (f"{k}_completed_orders", f"{k}_accepted_riders") for k in KINDS}}
    return with_rates(df).withColumns({n: ratio0(C(a), C(b), 2) for n, (a, b) in pairs.items()})


def hours(rows: DataFrame, threshold: float, bucket: str = "order", by_date: bool = True) -> DataFrame:
    """Orders and accepting riders by hour, of each date or of the whole window (riders once)."""
    return _hour_rates(agg(_hour_events(rows, threshold, bucket), ["date", "hour"] if by_date else ["hour"], _hour_counts()))


def hour_summary(rows: DataFrame, threshold: float, bucket: str = "order") -> DataFrame:
    """The hours of all dates added up: a rider counts once for each date."""
    each = agg(_hour_events(rows, threshold, bucket), ["date", "hour"], _hour_counts())
    return _hour_rates(each.groupBy("hour").agg(*[F.sum(c).alias(c) for c in each.columns if c not in ("date", "hour")]))


def rider_days(rows: DataFrame, threshold: float, bucket: str = "order") -> DataFrame:
    """Riders who accepted, by date."""
    events = _hour_events(rows, threshold, bucket).filter(C("took") & blank_to_null(C("rider_id")).isNotNull())
    return agg(events, ["date"], _riders())


def accepted_within(fact: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Orders accepted from the start's midnight to before the midnight after the end."""
    at = C("accept_time")
    out = at.isNotNull()
    if start:
        out = out & (at >= F.lit(datetime.combine(start, time())).cast("timestamp_ntz"))
    if end:
        out = out & (at < F.lit(datetime.combine(end + timedelta(days=1), time())).cast("timestamp_ntz"))
    return fact.filter(out)


# -------------------------------------------------------------- a partner


# fixed values: what the overview says of a city
DIAGNOSES = {
    "cancel": "Cancel rate is high. Review capacity response and timeout acceptance.",
    "riders": "New rider contribution is low. Review onboarding activation and coaching.",
    "merchants": "New merchant contribution is low. Review first-order conversion and merchant follow-up.",
    "none": "Current city operation is stable.",
}


def overview(fact: DataFrame, f: Filters, cfg: Settings, threshold: float | None = None, sla_minutes: int | None = None) -> DataFrame:
    """One row: the partner's counts, money, service level, health and what to look at; none if it has no orders."""
    rows = f.apply(fact)
    more = {"new_rider_orders": ads.MEASURES["new_rider_orders"](), "new_merchant_orders": ads.MEASURES["new_merchant_orders"](), "dates": distinct(None, "order_date", blanks=True),
            **{n: most(n) for n in ("partner_id", "partner_name", *_PLACE)}}
    out = agg(rows, [], runtime(cfg.threshold(threshold)), finance(), sla(cfg.on_time_minutes, sla_minutes or cfg.sla_minutes), entities(), more).filter("total_orders > 0")
    days = F.lit(day_count(f.start, f.end)) if f.start and f.end else C("dates")
    out = scored(with_rates(out), days)
    few = lambda n: (C(n) > 0) & (C(n) < C("completed_orders") * F.lit(0.1))
    found = F.array_compact(F.array(
        F.when(C("cancel_rate") > 0.20, DIAGNOSES["cancel"]), F.when(few("new_rider_orders"), DIAGNOSES["riders"]), F.when(few("new_merchant_orders"), DIAGNOSES["merchants"]),
    ))
    return out.withColumn("diagnostics", F.when(F.size(found) == 0, DIAGNOSES["none"]).otherwise(F.array_join(found, " "))).drop("dates")


def partner_daily(fact: DataFrame, f: Filters, cfg: Settings, threshold: float | None = None, sla_minutes: int | None = None) -> DataFrame:
    groups = (runtime(cfg.threshold(threshold)), finance(), sla(cfg.on_time_minutes, sla_minutes or cfg.sla_minutes), entities())
    return with_rates(agg(f.apply(fact), {"date": C("order_date")}, *groups))


def rider_matrix(fact: DataFrame, riders: DataFrame, f: Filters, cfg: Settings, new: str = "all") -> DataFrame:
    """A row a rider: completed orders in all and on each day of the window, days on target, and a total row.

    ``new`` keeps riders with (``new``) or without (``old``) orders flagged as of a new rider.
    """
    rows = f.apply(fact).filter(blank_to_null(C("rider_id")).isNotNull())
    day = rows.groupBy("rider_id", C("order_date").alias("date")).agg(
        count_if(C("is_completed")).alias("n"), F.max("rider_name").alias("seen"), F.max(C("is_new_rider_order").cast("int")).alias("is_new_rider")
    )
    each = day.groupBy("rider_id").agg(
        F.max("seen").alias("seen"), F.sum("n").alias("completed_orders"), count_if(C("n") >= max(cfg.rider_daily_target, 1)).alias("qualified_days"),
        F.max("is_new_rider").alias("is_new_rider"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "n")))).alias("days"),
    )
    if new in ("new", "old"):
        each = each.filter(C("is_new_rider") == int(new == "new"))
    known = riders.select("rider_id", F.col("rider_name").alias("known"), F.date_format("hire_date", "yyyy-MM-dd").alias("hire_date"))
    each = each.join(known, "rider_id", "left").withColumn("rider_name", F.coalesce("known", "seen", "rider_id"))
    if f.start and f.end and f.start <= f.end:
        calendar = F.transform(F.sequence(F.lit(f.start), F.lit(f.end), F.expr("interval 1 day")), lambda d: F.date_format(d, "yyyy-MM-dd"))
        each = each.withColumn("days", F.map_from_arrays(calendar, F.transform(calendar, lambda d: F.coalesce(F.try_element_at("days", d), F.lit(0).cast("long")))))
    met = (C("qualified_days") >= max(cfg.rider_target_days, 1)).cast("long")
    each = each.select("rider_id", "rider_name", "hire_date", "completed_orders", "qualified_days", "is_new_rider", met.alias("is_target_met"), "days", F.lit(False).alias("is_total"))
    # a day of the total, too, is one of the riders' own: those are added up by day, with the other sums as one more
    sums = ("completed_orders", "qualified_days", "is_target_met")
    parts = F.concat(F.transform(F.map_entries("days"), lambda e: F.struct(e["key"].alias("d"), e["value"].alias("n"))), F.array(*[F.struct(F.lit(f" {n}").alias("d"), C(n).alias("n")) for n in sums]))
    by_day = each.select(F.explode(parts).alias("p")).groupBy("p.d").agg(F.sum("p.n").alias("n"))
    found = by_day.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", "n")))).alias("all"))
    total = found.select(
        *[F.coalesce(F.try_element_at("all", F.lit(f" {n}")), F.lit(0)).cast(each.schema[n].dataType).alias(n) for n in sums],
        F.map_filter("all", lambda k, v: ~k.startswith(" ")).alias("days"),
    )
    total = total.withColumn("days", F.when(F.size("days") > 0, C("days")))
    return each.unionByName(total.withColumn("rider_id", F.lit("-")).withColumn("rider_name", F.lit("-")).withColumn("is_total", F.lit(True)), allowMissingColumns=True)


def rider_tiers(fact: DataFrame, f: Filters, cfg: Settings) -> DataFrame:
    """How many riders fall in each band of completed orders, whoever is new."""
    each = f.apply(fact).filter(blank_to_null(C("rider_id")).isNotNull()).groupBy("rider_id").agg(count_if(C("is_completed")).alias("n"))
    return _banded(each.select(tiered(C("n"), cfg.rider_tiers).alias("label")), cfg.rider_tiers, "riders")


def newcomer_days(fact: DataFrame, f: Filters, entity: str) -> DataFrame:
    """Completed orders of new riders or merchants by day."""
    rows = f.apply(fact).filter(C("is_completed") & C(f"is_new_{entity}_order") & blank_to_null(C(f"{entity}_id")).isNotNull())
    return rows.groupBy(C("order_date").alias("date")).agg(F.count(F.lit(1)).alias("completed_orders"))


def merchants(fact: DataFrame, roster: DataFrame, f: Filters, new: str = "all") -> DataFrame:
    """A row a merchant, most completed orders first in display order columns."""
    rows = f.apply(fact).filter(blank_to_null(C("merchant_id")).isNotNull())
    each = rows.groupBy("merchant_id").agg(
        F.max("merchant_name").alias("seen"), F.max("shop_name").alias("shop_name"), F.count(F.lit(1)).alias("total_orders"), count_if(C("is_completed")).alias("completed_orders"),
        count_if(C("is_cancelled")).alias("cancelled_orders"), F.max(C("is_new_merchant_order").cast("int")).alias("is_new_merchant"),
    )
    if new in ("new", "old"):
        each = each.filter(C("is_new_merchant") == int(new == "new"))
    known = roster.select("merchant_id", F.col("merchant_name").alias("known"), "register_date")
    return with_rates(each.join(known, "merchant_id", "left").withColumn("merchant_name", F.coalesce("known", "seen", "merchant_id")).drop("known", "seen"))


def merchant_like_users(user_day: DataFrame, f: Filters, cfg: Settings, n: int = 20) -> DataFrame:
    """Users who order as much as a merchant."""
    each = f.apply(user_day, "date").groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("total_orders", "completed_orders", "cancelled_orders")])
    return top(each.filter(C("completed_orders") >= cfg.merchant_like_orders), n, F.desc("completed_orders"), "user_id")


def order_sources(fact: DataFrame, f: Filters, cfg: Settings) -> DataFrame:
    source = F.coalesce(blank_to_null(C("order_source")), F.lit(NO_SOURCE))
    out = with_rates(agg(f.apply(fact), {"order_source": source}, runtime(cfg.cancel_minutes)))
    return out.withColumn("share", ratio0(C("total_orders"), F.sum("total_orders").over(Window.partitionBy())))


def rider_income(fact: DataFrame, riders: DataFrame, f: Filters, n: int = 200) -> DataFrame:
    """What riders earned, most first; those with neither completed orders nor income are left out."""
    rows = f.apply(fact).filter(blank_to_null(C("rider_id")).isNotNull())
    each = rows.groupBy("rider_id").agg(F.max("rider_name").alias("seen"), count_if(C("is_completed")).alias("completed_orders"), money(sum_if(C("is_completed"), C("rider_income"))).alias("commission"))
    each = each.filter("completed_orders > 0 OR commission > 0").join(riders.select("rider_id", F.col("rider_name").alias("known")), "rider_id", "left")
    each = each.select("rider_id", F.coalesce("known", "seen", "rider_id").alias("rider_name"), "completed_orders", "commission", per_order("commission", "completed_orders").alias("avg_commission"))
    return top(each, n, F.desc("commission"), F.desc("completed_orders"), "rider_id")


def sla_setting(config: DataFrame, partner_id: str, cfg: Settings) -> int:
    """A partner's service level in minutes, or the default."""
    row = config.filter(C("partner_id") == partner_id).orderBy(F.desc("effective_date")).select("sla_minutes").first()
    return int(row[0]) if row and row[0] else cfg.sla_minutes


# --------------------------------------------------------- direct cities


def cancel_daily(fact: DataFrame, f: Filters, cfg: Settings, threshold: float | None = None, sla_minutes: int | None = None, by_day: bool = True) -> DataFrame:
    """The kinds of cancellation by day, or of the whole window."""
    limit = cfg.threshold(threshold)
    waited = F.coalesce("order_elapsed_minutes_to_cancel", F.lit(0.0)) > limit
    none = C("is_cancelled") & C("is_unaccepted_cancel")
    kinds = {
        "unaccepted_cancel_orders": none, "unaccepted_timeout_cancel_orders": none & waited, "unaccepted_timeout_online_cancel_orders": none & waited & C("service_online_flag"),
        "unaccepted_timeout_offline_cancel_orders": none & waited & ~C("service_online_flag"), "unaccepted_not_timeout_cancel_orders": none & ~waited,
        "accepted_noliability_cancel_orders": C("is_accepted_cancel") & C("is_rider_noliability_cancel"), "unpaid_cancel_orders": C("is_cancelled") & ~C("is_paid"),
    }
    groups = (runtime(limit), {n: count(c) for n, c in kinds.items()}, finance(), sla(cfg.on_time_minutes, sla_minutes or cfg.sla_minutes))
    out = agg(f.apply(fact), {"date": C("order_date")} if by_day else {}, *groups, {} if by_day else entities())
    return with_rates(out).withColumn("unaccepted_timeout_online_cancel_rate", ratio0(C("unaccepted_timeout_online_cancel_orders"), C("total_orders")))


def direct_hours(fact: DataFrame, f: Filters, cfg: Settings, threshold: float | None = None, by_date: bool = True) -> DataFrame:
    """Orders and riders by the hour the orders were made in; without dates, those of all dates added up."""
    took = C("accept_time").isNotNull()
    counts = runtime(cfg.threshold(threshold)) | {
        "unpaid_orders": count(C("is_cancelled") & ~C("is_paid")), "unaccepted_cancel_orders": count(C("is_unaccepted_cancel")), "accepted_cancel_orders": count(C("is_accepted_cancel")),
        "accepted_riders": distinct(took, "rider_id"),
    }
    for k in KINDS:
        own = C("is_completed") & (C("employment_type") == k)
        counts |= {f"{k}_completed_orders": count(own), f"{k}_riders": distinct(own, "rider_id")}
    each = agg(f.apply(fact).filter("order_hour IS NOT NULL"), {"date": C("order_date"), "hour": C("order_hour")}, counts)
    if not by_date:
        each = each.groupBy("hour").agg(*[F.sum(n).alias(n) for n in counts])
    return with_rates(each).withColumns({f"{k}_efficiency": ratio0(C(f"{k}_completed_orders"), C(f"{k}_riders"), 2) for k in KINDS})


def new_entities(table: DataFrame, entity: str, f: Filters, n: int = 100) -> DataFrame:
    """New riders or merchants of the months in the window, most completed orders first."""
    rows = table
    if f.start:
        rows = rows.filter(C("order_month") >= f.start.strftime("%Y-%m"))
    if f.end:
        rows = rows.filter(C("order_month") <= f.end.strftime("%Y-%m"))
    if f.partner_id:
        rows = rows.filter(C("partner_id") == f.partner_id)
    each = rows.groupBy("partner_id", f"{entity}_id").agg(
        F.max("partner_name").alias("partner_name"), F.max(f"{entity}_name").alias(f"{entity}_name"), F.sum("total_orders").alias("total_orders"), F.sum("completed_orders").alias("completed_orders")
    )
    return top(with_rates(each), n, F.desc("completed_orders"), F.desc("total_orders"), "partner_id", f"{entity}_id")


def _by_period(rows: DataFrame, keys: list[str], names: dict[str, Column], baseline, current) -> DataFrame:
    """Sums of each key in the baseline and the current period."""
    period = period_of(C("date"), baseline, current)
    marked = rows.withColumn("period", period).filter("period IS NOT NULL")
    sums = [F.sum(F.when(C("period") == p, c).otherwise(F.lit(0))).alias(f"{p}_{n}") for p in ("baseline", "current") for n, c in names.items()]
    return marked.groupBy(*keys).agg(*sums, *[F.max(n).alias(n) for n in ("partner_name", "merchant_name") if n in rows.columns and n not in keys])


def merchant_comparison(merchant_day: DataFrame, baseline, current, n: int = 100) -> DataFrame:
    """Each merchant's orders, completion and prices in two periods."""
    names = {c: C(c) for c in ("total_orders", "completed_orders", "unaccepted_cancel_orders", "accepted_cancel_orders")}
    cents = lambda c: F.round(c * 100, 0)
    names |= {f"{k}_paid": cents(C(f"{k}_amount_paid")) for k in ("unaccepted_cancel", "accepted_cancel", "completed")} | {"paid": cents(C("avg_amount_paid")) * C("total_orders")}
    out = _by_period(merchant_day, ["partner_id", "merchant_id"], names, baseline, current)

    def price(a: str, b: str) -> Column:
        return F.coalesce(F.round(quotient(C(a), C(b)), 0) / F.lit(100.0), F.lit(0.0))

    out = out.withColumns({f"{p}_completion_rate": ratio0(C(f"{p}_completed_orders"), C(f"{p}_total_orders")) for p in ("baseline", "current")})
    out = out.withColumns({
        "change_total_orders": C("current_total_orders") - C("baseline_total_orders"), "change_completion_rate": half_up(C("current_completion_rate") - C("baseline_completion_rate"), 4),
        **{f"{p}_avg_price": price(f"{p}_paid", f"{p}_total_orders") for p in ("baseline", "current")},
        **{f"current_{k}_avg_price": price(f"current_{k}_paid", f"current_{k}_orders") for k in ("unaccepted_cancel", "accepted_cancel", "completed")},
    })
    out = out.select(
        "partner_id", "partner_name", "merchant_id", "merchant_name", "baseline_total_orders", "current_total_orders", "change_total_orders", "baseline_completion_rate",
        "current_completion_rate", "change_completion_rate", "baseline_avg_price", "current_avg_price", "current_unaccepted_cancel_orders", "current_unaccepted_cancel_avg_price",
        "current_accepted_cancel_orders", "current_accepted_cancel_avg_price", "current_completed_orders", "current_completed_avg_price",
    )
    return top(out, n, F.desc("current_completed_orders"), F.desc("current_total_orders"), "partner_id", "merchant_id")


def source_comparison(source_day: DataFrame, fact: DataFrame, baseline, current, cfg: Settings) -> DataFrame:
    """Each source's orders in two periods, with the valid ones of the current."""
    names = {c: C(c) for c in ("total_orders", "unaccepted_cancel_orders", "accepted_cancel_orders", "unpaid_orders", "completed_orders")}
    out = _by_period(source_day.drop("partner_name"), ["order_source"], names, baseline, current)
    own = fact.filter(C("order_date").isNotNull() & within(C("order_date"), current))
    valid = agg(own, {"order_source": F.coalesce(blank_to_null(C("order_source")), F.lit(NO_SOURCE))}, {"current_valid_orders": count(C("is_valid_order"))})
    return out.join(valid, "order_source", "left").select(
        "order_source", "baseline_total_orders", "current_total_orders", (C("current_total_orders") - C("baseline_total_orders")).alias("change_total_orders"),
        "baseline_unaccepted_cancel_orders", "current_unaccepted_cancel_orders", "current_completed_orders", F.coalesce("current_valid_orders", F.lit(0)).alias("current_valid_orders"),
    )


def coupons(coupon_day: DataFrame, f: Filters) -> DataFrame:
    """One row: the window's coupon orders and discounts."""
    rows = f.apply(coupon_day, "date")
    return rows.agg(F.coalesce(F.sum("coupon_order_count"), F.lit(0)).alias("coupon_orders"), *[F.coalesce(money(F.sum(n)), F.lit(0.0)).alias(n) for n in ("hq_discount_total", "discount_total", "total_discount")])


# ---------------------------------------------------------------- display


def ordered(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Rows in a table's order: those without value last either way, numbers as numbers, text as a Chinese reader sorts it."""
    value = blank_to_null(F.when(C(column).cast("string") == "-", None).otherwise(C(column).cast("string")))
    number, text = value.try_cast("double"), F.collate(value, "zh")
    keys = [F.desc_nulls_last(number), F.desc_nulls_last(text)] if descending else [F.asc_nulls_last(number), F.asc_nulls_last(text)]
    return df.orderBy(*keys)


def heatmap(hourly: DataFrame, value: str = "completed_orders", total: bool = False) -> DataFrame:
    """Dates by the 24 hours, 0 where there is nothing."""
    out = hourly.groupBy("date").pivot("hour", list(range(24))).agg(F.sum(value)).na.fill(0)
    out = out.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})
    return out.withColumn("total", sum((C(f"h{h:02d}") for h in range(24)), F.lit(0))) if total else out


def last_dates(partner_day: DataFrame, value: str = "completed_orders", n: int = 3) -> DataFrame:
    """Each partner's values on the last ``n`` dates of all, latest first, and the change from the first to the last that is there."""
    dates = partner_day.select("date").distinct().orderBy(F.desc("date")).limit(n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))
    rows = partner_day.join(F.broadcast(dates.withColumn("back", rank)), "date")
    out = rows.groupBy("partner_id").pivot("back", list(range(1, n + 1))).agg(F.sum(value)).withColumnsRenamed({str(i): f"d{i}" for i in range(1, n + 1)})
    return out.withColumn("trend", F.coalesce(*[f"d{i}" for i in range(1, n + 1)]) - F.coalesce(*[f"d{i}" for i in range(n, 0, -1)]))


def extremes(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` lowest and ``n`` highest rows."""
    low = top(df.filter(C(value).isNotNull()), n, F.asc(value), key).withColumn("end", F.lit("low"))
    return low.unionByName(top(df.filter(C(value).isNotNull()), n, F.desc(value), key).withColumn("end", F.lit("high")))


def peak_hour(hour_rows: DataFrame, value: str = "total_orders") -> DataFrame:
    """One row: the first of the hours with most, and riders' efficiency over all hours."""
    first = F.max_by("hour", F.struct(C(value), -C("hour")))
    return hour_rows.agg(first.alias("peak_hour"), F.max(value).alias("peak"), ratio0(F.sum("completed_orders"), F.sum("accepted_riders"), 2).alias("efficiency"))
