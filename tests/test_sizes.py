"""Orders stay where they are: what is shuffled and sorted while the fact is made, and that all ways of making it agree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ridgeline import catalog, testbed
from ridgeline.functions import sizes
from ridgeline.operators import dwd
from ridgeline.sources import tables


@pytest.fixture
def large(spark):
    """As for rosters that Spark would not broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_joins(text):
    """Joins by sorting with orders on one side; the few rows of nations and regions may be joined in any way."""
    return [x for x in re.findall(r"SortMergeJoin.*", text) if "nationkey" not in x and "regionkey" not in x]


def test_making_the_fact_sorts_and_shuffles_only_orders_imported_again(spark, sf_dir, large):
    text = plan(catalog.queries()["dwd_order_fact"](spark, sf_dir))
    assert not sorted_joins(text) and "WindowGroupLimit" not in text
    # one sort and one shuffle by id, of the rows whose id is there again
    assert text.count("Sort [order_id") == 1 and text.count("Exchange hashpartitioning(order_id") == 1 and "LeftSemi" in text.split("Sort [order_id")[1]


@pytest.mark.parametrize("name", ["b8_rider_day", "b9_merchant_day", "q10_new_riders", "q11_new_merchants"])
def test_rosters_do_not_shuffle_what_they_are_joined_to(spark, sf_dir, large, name):
    assert not sorted_joins(plan(catalog.queries()[name](spark, sf_dir)))


def orders(spark, n=600, seed=5):
    """Few and many imports of an id, missing and blank ids, rows equal in all but the file or altogether."""
    r = random.Random(seed)
    rows = [(r.choice([None, "", " ", *(f"o{i}" for i in range(300))]), r.choice([None, 1, 2]), r.choice([None, 1, 2]), r.choice("ab")) for _ in range(n)]
    rows += [("same", 1, 1, "a")] * 3 + [(f"once{i}", 1, 1, "a") for i in range(200)]
    return spark.createDataFrame(rows, "order_id string, imported_at int, source_row_number int, file string").repartition(5)


@pytest.mark.parametrize("bound", [sizes.REPEATED_IDS, 0])
def test_the_latest_row_of_each_id_however_many_are_repeated(spark, monkeypatch, bound):
    monkeypatch.setattr(sizes, "REPEATED_IDS", bound)
    df = orders(spark)
    best = {}
    for row in df.collect():
        if row.order_id and row.order_id.strip():
            rank = tuple((v is not None, v or 0) for v in row[1:3]) + (row.file,)
            best[row.order_id] = max(best.get(row.order_id, (rank, tuple(row))), (rank, tuple(row)), key=lambda x: x[0])
    got = dwd.latest_of_few(df, "order_id")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((row for _, row in best.values()), key=repr)


def test_rosters_too_large_to_broadcast_give_the_same_fact(spark, sf_dir, monkeypatch):
    made = {}
    for bound in (sizes.ROSTER_ROWS, 0):
        monkeypatch.setattr(sizes, "ROSTER_ROWS", bound)
        df = catalog.queries()["dwd_order_fact"](spark, sf_dir)
        assert ("ShuffledHashJoin" in plan(df)) == (bound == 0) and not sorted_joins(plan(df))
        made[bound] = sorted(map(repr, df.collect()))
    assert len(set(map(tuple, made.values()))) == 1


def test_orders_of_the_test_bed_come_from_one_reading(spark, sf_dir):
    rows = testbed.inputs(spark, sf_dir).orders
    assert "Union" not in plan(rows)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 50 == 0).alias("again")).first()
    assert rows.count() == n.n + n.again and n.again > 0


def test_a_month_that_one_task_made_is_cut_before_it_is_sorted(spark, tmp_path):
    rows = spark.range(0, 20000, 1, 1).select(F.lit("2026-03").alias("order_month"), F.col("id").cast("string").alias("order_id"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        tables.replace_months(rows, str(tmp_path / "t"), parts=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "order_month=2026-03").glob("*.parquet"))) > 1
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "t")).select("order_month", "order_id", "x").collect())) == sorted(map(repr, rows.collect()))
