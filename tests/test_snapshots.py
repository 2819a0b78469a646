"""Layers that change together: committed states, failures, conflicts, damage."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import ads
from ridgeline.sources import snapshots
from tests.test_layers import HEADERS, order_lines
from tests.test_raw_files import house_of


def month(spark, name, *values):
    return spark.createDataFrame([(name, v) for v in values], "order_month string, v long")


def rows(df):
    return sorted((r.order_month, r.v) for r in df.collect())


def test_readers_see_whole_commits(spark, tmp_path):
    own = snapshots.Snapshots(spark, str(tmp_path))
    run = own.begin("a")
    assert run.replace_months("x", month(spark, "2026-04", 1, 2).unionByName(month(spark, "2026-05", 3))) == ["2026-04", "2026-05"]
    run.append("log", spark.range(1))
    assert own.latest() == (0, {}) and own.there({}, "x") == {}
    run.commit()
    held = own.latest()[1]
    assert rows(own.table(held, "x")) == [("2026-04", 1), ("2026-04", 2), ("2026-05", 3)]
    # the next run replaces one month from the layer itself; the old state stays readable
    run = own.begin("b")
    run.replace_months("x", own.table(run.state, "x").filter("order_month = '2026-05'").withColumn("v", F.col("v") + 10).withColumn("w", F.lit("new")))
    run.append("log", spark.range(2))
    assert rows(own.table(run.state, "x")) == [("2026-04", 1), ("2026-04", 2), ("2026-05", 13)]
    assert rows(own.table(own.latest()[1], "x")) == rows(own.table(held, "x"))
    run.commit()
    assert rows(own.table(held, "x"))[-1] == ("2026-05", 3)
    assert own.table(own.latest()[1], "x", ["2026-05"]).first().w == "new" and own.table(own.latest()[1], "log").count() == 3


def test_of_two_runs_the_second_to_commit_fails(spark, tmp_path):
    own = snapshots.Snapshots(spark, str(tmp_path))
    one, two = own.begin("one"), own.begin("two")
    one.replace("x", spark.range(1))
    two.replace("x", spark.range(2))
    one.commit()
    with pytest.raises(snapshots.Conflict):
        two.commit()
    assert own.table(own.latest()[1], "x").count() == 1


def test_folders_that_no_state_names_are_collected(spark, tmp_path):
    own = snapshots.Snapshots(spark, str(tmp_path))
    for i in range(4):
        run = own.begin(f"r{i}")
        run.replace_months("x", month(spark, f"2026-0{1 + i % 2}", i))
        run.commit()
    lost = own.begin("lost")
    lost.replace("x2", spark.range(1))  # never committed
    before = rows(own.table(own.latest()[1], "x"))
    own.collect(keep=1)
    assert own.numbers() == [4] and rows(own.table(own.latest()[1], "x")) == before
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["run=r2-1", "run=r3-1"]


def test_many_appends_are_brought_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MANY", 3)
    own = snapshots.Snapshots(spark, str(tmp_path))
    run = own.begin("a")
    for i in range(5):
        run.append("log", spark.range(i, i + 1))
    run.commit()
    assert sorted(r.id for r in own.table(own.latest()[1], "log").collect()) == [0, 1, 2, 3, 4] and len(own.latest()[1]["log"][""]) == 2


def write_orders(root, name, lines):
    (root / "raw" / "orders_raw" / name).write_text("\n".join(",".join(x) for x in [HEADERS, *lines]), encoding="utf-8")


def state_of(house):
    return {n: (house.table(n).count(), house.table(n).agg(F.bit_xor(F.xxhash64(*[c for c in house.table(n).columns if c != "payload"]))).first()[0]) for n in ("ods_orders", "dwd_orders", "ads_partner_day", "ads_merchant_day", "abnormal_orders", "registry")}


def test_a_failure_after_the_seventh_table_changes_nothing(spark, tmp_path, monkeypatch):
    """And a fact or metric table that lost rows is noticed and built again."""
    house = house_of(spark, tmp_path)
    lines = list(order_lines())
    write_orders(tmp_path, "2026-04.csv", [*lines[:20], [""] * len(HEADERS)])
    house.run()
    before = state_of(house)
    write_orders(tmp_path, "2026-04b.csv", [*lines[10:40], [""] * len(HEADERS)])
    eighth = list(ads.TABLES)[7]
    monkeypatch.setitem(ads.TABLES, eighth, lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        house.run()
    assert state_of(house) == before
    monkeypatch.undo()
    assert house.run().months == ["2026-04"]
    assert house.table("dwd_orders").count() == 30  # the file's month is replaced
    assert house.table("abnormal_orders").count() == 2
    # half of the fact's rows are lost: files are damaged outside of the warehouse
    whole = state_of(house)
    folder = next(Path(house.cfg.table_root, "dwd_orders").glob(f"run={house.state()['dwd_orders']['2026-04'][0]}/order_month=2026-04"))
    half = spark.createDataFrame(spark.read.parquet(str(folder)).limit(15).collect(), spark.read.parquet(str(folder)).schema)
    shutil.rmtree(folder)
    half.write.parquet(str(folder))
    assert house.damaged() == [("dwd_orders", "2026-04")]
    assert house.run().months == ["2026-04"] and house.damaged() == []
    assert {n: v[0] for n, v in state_of(house).items()} == {n: v[0] for n, v in whole.items()}
    assert state_of(house)["dwd_orders"] == whole["dwd_orders"]
