"""Every registered query of the library against its SQL, row for row."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ridgeline import catalog
from ridgeline.plans import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order) for v in values]
    return sorted(flat, key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_filters_reach_the_fact(spark, sf_dir):
    """A view of one partner and window reads its months only, its columns only, and asks the files for the partner."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    scan = [line for line in plan_of(catalog.queries()["e10_hours"](spark, sf_dir)).splitlines() if "FileScan" in line]
    assert len(scan) == 1
    assert "order_month#" in scan[0].split("PartitionFilters: [")[1].split("]")[0] and "2026-03" in scan[0] and "2026-04" in scan[0]
    assert "EqualTo(partner_id,3)" in scan[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "amount_paid" not in scan[0] and "coupon_id" not in scan[0]


@pytest.mark.parametrize("name, scans, exchanges", [
    ("e3a_admin_summary", 1, 2), ("e3e_ranking", 1, 2), ("e6_health", 1, 3), ("e10_hours", 1, 2), ("e18_cancel_daily", 1, 1), ("q3_partner_day", 1, 2), ("q9_direct_hour", 1, 2), ("b7_partner_hour", 3, 2), ("e11_rider_matrix", 4, 9),
])
def test_plans_read_the_fact_once(spark, sf_dir, name, scans, exchanges):
    plan = plan_of(catalog.queries()[name](spark, sf_dir))
    assert plan.count("FileScan") <= scans, plan
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= exchanges, plan


def test_extremes_see_more_than_the_best_hundred_partners(spark, sf_dir):
    rows, _ = catalog.fact(spark, sf_dir)
    # every partner's orders again for nineteen more partners each, less of them for each
    many = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).filter(F.pmod(F.xxhash64("order_id"), F.lit(20)) >= F.col("k"))
    many = many.withColumn("partner_id", F.concat_ws("-", "partner_id", "k")).drop("k").localCheckpoint()
    scores = {r.partner_id: r.health_score for r in views.partner_scores(many, catalog.WINDOW, catalog.CFG).collect()}
    assert len(scores) > 100
    got = [(r.partner_id, r.health_score) for r in catalog.VIEWS["c4_extremes"](many, None).filter("end = 'low'").collect()]
    assert sorted(got) == sorted(sorted(scores.items(), key=lambda x: (x[1], x[0]))[:5])
