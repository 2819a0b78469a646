"""The fixture of two partners: 7 days, 13 hours, one completed and one cancelled order each hour."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridgeline import pipeline
from ridgeline.config import Settings
from ridgeline.operators import ads, dwd
from ridgeline.plans import mart, views
from ridgeline.sources import staging, tables

HEADERS = "订单编号,合伙人ID,合伙人,商家ID,商家名称,用户ID,配送员ID,配送员,在职状态,订单状态,下单来源,添加时间,支付时间,接单时间,取消时间,完成时间,实付金额,总部优惠金额,优惠金额,优惠券ID,营销优惠券ID,骑手收入,合伙人收入,总部收入,麦芽田收入,保险费".split(",")


def order_lines(month=4):
    for day in range(7):
        for hour in range(9, 22):
            t = datetime(2026, month, 1 + day, hour)
            s = lambda m: (t + timedelta(minutes=m)).strftime("%Y-%m-%d %H:%M:%S")
            yield [f"A-{month}-{day}-{hour}", "1", "甲", "1001", "店甲", "u1", "3001.0", "骑甲", "全职", "已完成", "小程序", s(0), s(1), s(2), "", s(35), "18.8", "1.2", "0.3", "C1", "", "5.5", "3.1", "1.0", "0.4", "0.1"]
            yield [f"B-{month}-{day}-{hour}", "2", "乙", "1002", "店乙", "u2", "3002", "骑乙", "兼职", "已取消（无责）", "", s(0), s(0), "", s(10), "", "15.0", "0.6", "0.5", "", "MK-1", "0", "0", "0", "0", "0.1"]


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("house")
    raw = root / "raw"
    for d in ("orders_raw", "riders", "merchants", "partners"):
        (raw / d).mkdir(parents=True)
    lines = [",".join(HEADERS), *[",".join(x) for x in order_lines()], "," * (len(HEADERS) - 1)]
    (raw / "orders_raw" / "2026-04.csv").write_bytes("\n".join(lines).encode("gbk"))
    (raw / "partners" / "p.csv").write_text("ID,合伙人,成立时间,合伙人区域,状态\n1,合伙甲,2026-03-20,广东省 梅州市 梅江区,正常\n2,合伙乙,2025-12-01,广东省/广州市/天河区,正常\n", encoding="utf-8-sig")
    (raw / "riders" / "r.csv").write_text("帮手ID,帮手姓名,入职时间,状态,所属合伙人,区域\n03001,骑手甲,2026-03-25,在职,合伙甲,梅江\n3002,骑手乙,2025-01-01,在职,合伙乙,天河\n", encoding="utf-8")
    (raw / "merchants" / "m.csv").write_text("商家ID,商家名称,商户名称,所属合伙人,所属区域,注册时间,状态\n1001,商家甲,店铺甲,合伙甲,梅江,2026-03-25,营业\n1002,商家乙,店铺乙,合伙乙,天河,2025-01-01,营业\n", encoding="utf-8")
    (raw / "orders_raw" / ".hidden.csv").write_text("x")
    cfg = Settings(excluded_partners=("101",), raw_root=str(raw), table_root=str(root / "tables"), export_root=str(root / "mart"))
    return pipeline.Warehouse(spark, cfg)


@pytest.fixture(scope="module")
def imported(house):
    return house.run()


def test_import(house, imported):
    assert (imported.status, imported.files, imported.skipped, imported.failed, imported.months) == ("success", 4, 0, 0, ["2026-04"])
    assert house.table("ods_orders").count() == 182
    fault = house.table("abnormal_orders").first()
    assert (fault.kind, fault["rows"]) == ("missing_order_id", 1)
    assert len(imported.mart_rows) == 16
    assert imported.data_version.startswith("v20")


def test_week(house, imported):
    f = house.table("dwd_orders")
    row = f.agg(*[F.count_if(c).alias(c) for c in ("is_completed", "is_cancelled", "is_valid_order", "is_new_partner_order", "is_new_rider_order", "is_new_merchant_order")]).first()
    assert tuple(row) == (91, 91, 182, 91, 91, 91)
    cancel = house.table("ads_cancel_day").agg(*[F.sum(c) for c in ("unaccepted_timeout_cancel_orders", "unaccepted_timeout_online_cancel_orders", "unaccepted_timeout_offline_cancel_orders", "accepted_noliability_cancel_orders")]).first()
    assert tuple(cancel) == (91, 84, 7, 0)
    one = f.filter("partner_id = '1'").first()
    two = f.filter("partner_id = '2'").first()
    assert (one.hq_subsidy_amount, one.partner_subsidy_amount, one.rider_id, one.rider_name, one.shop_name, one.city) == (1.2, 0.3, "3001", "骑手甲", "店铺甲", "梅州市")
    assert (two.hq_subsidy_amount, two.partner_subsidy_amount, two.employment_type) == (0.0, 1.1, "parttime")


def test_metric_keys(house, imported):
    for name in ads.TABLES:
        df = house.table(f"ads_{name}")
        assert df.count() == df.select("metric_key").distinct().count(), name
    assert house.table("ads_partner_hour").filter("metric_key = 'partner_hour|1|2026-04-01|9'").count() == 1


def test_service_level(house, imported):
    f = house.table("dwd_orders")
    whole = views.Filters(partner_id="1")
    at = {m: views.overview(f, whole, house.cfg, sla_minutes=m).first() for m in (30, 40)}
    assert (at[30].on_time_orders, at[30].sla_overtime_orders, at[40].sla_on_time_orders) == (0, 91, 91)
    assert at[30].diagnostics == "Current city operation is stable."
    assert views.overview(f, views.Filters(partner_id="9"), house.cfg).count() == 0


def test_import_again_skips(house, imported):
    again = house.run()
    assert (again.skipped, again.status, again.months) == (4, "success", [])
    assert house.table("ods_orders").count() == 182


def test_month_is_replaced(house, imported, spark):
    may = [",".join(HEADERS), *[",".join(x) for x in order_lines(5)]]
    raw = house.cfg.raw_root
    (Path(raw) / "orders_raw" / "2026-05.csv").write_text("\n".join(may), encoding="utf-8")
    assert house.run().months == ["2026-05"]
    assert {r[0]: r[1] for r in house.table("dwd_orders").groupBy("order_month").count().collect()} == {"2026-04": 182, "2026-05": 182}
    assert {r[0]: r[1] for r in house.table("ads_partner_day").groupBy("order_month").count().collect()} == {"2026-04": 14, "2026-05": 14}


def test_bad_file_is_told(house, imported):
    path = Path(house.cfg.raw_root) / "riders" / "broken.xlsx"
    path.write_bytes(b"no workbook")
    result = house.run()
    path.unlink()
    assert (result.status, result.failed) == ("partial_success", 1)


def test_state_of_the_data(house, imported, spark, tmp_path):
    info = house.info().first()
    assert info.last_import_status in ("success", "partial_success") and str(info.latest_data_date) >= "2026-04-07" and set(info.roster_versions) == {"riders", "merchants", "partners"}
    assert set(info.stage_seconds) == set(pipeline.STAGES) and abs(info.total_seconds - sum(info.stage_seconds.values())) < 0.01
    assert info.data_version.startswith("v20") and info.latest_ready_month >= "2026-04"
    empty = pipeline.Warehouse(spark, Settings(table_root=str(tmp_path / "none"))).info().first()
    assert (empty.last_import_status, empty.latest_run_id, empty.data_version) == ("never_run", None, None)


def test_command_line(house, imported, tmp_path, capsys):
    import json

    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"raw_root": str(tmp_path / "raw"), "table_root": house.cfg.table_root, "export_root": str(tmp_path / "mart")}))
    assert pipeline.main(["import", "--mode", "auto", "--config", str(path)]) == 0
    assert "success" in capsys.readouterr().out
    for command in ("validate", "check"):
        assert pipeline.main([command, "--config", str(path)]) == 0
    assert "dwd_orders" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        pipeline.main(["serve"])


def test_export_labels(house, imported, spark):
    day = spark.read.parquet(f"{house.cfg.export_root}/合伙人日汇总.parquet")
    assert {"合伙人ID", "日期", "完成率", "经营利润"} <= set(day.columns)
    assert {p.name.removesuffix(".parquet") for p in Path(house.cfg.export_root).iterdir()} == {label for label, _ in mart.TABLES.values()} | {"数据版本"}


def test_failed_swap_keeps_the_old(house, imported, spark):
    before = sorted(p.name for p in Path(house.cfg.export_root).iterdir())
    with pytest.raises(Exception):
        tables.publish({"x": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, house.cfg.export_root)
    assert sorted(p.name for p in Path(house.cfg.export_root).iterdir()) == before


def test_outcome():
    assert pipeline.outcome(0) == ("success", "import finished")
    assert pipeline.outcome(1)[0] == "partial_success"
    assert pipeline.outcome(0, "disk")[0] == "success"
    assert pipeline.outcome(0, None, "x") == ("failed", "x")
    assert pipeline.months_to_build({"a"}, {"b"}, True, False) == ["a", "b"]


def test_headers():
    assert staging.normal_headers([" Partner Name ", "Partner Name", "Order（Actual）", None]) == ["partnername", "partnername.1", "order(actual)", "column"]
    assert staging.encoding_of("订单".encode("gbk")) == "gbk" and staging.encoding_of("订单".encode()) == "utf-8"


def test_only_order_number_is_an_order_id(spark):
    df = spark.createDataFrame([("1", "x")], "`编号` string, `备注` string").withColumn("source_row_number", F.lit(2))
    assert staging.accepted(staging.stage_orders(df, "2026-04.csv")).count() == 0


def test_sla_setting(spark, tmp_path):
    path = str(tmp_path / "sla")
    with pytest.raises(ValueError):
        tables.set_sla(spark, path, "1", 0, "2026-04-01")
    tables.set_sla(spark, path, "1", 45, "2026-04-01")
    tables.set_sla(spark, path, "1", 50, "2026-04-02")
    tables.set_sla(spark, path, "2", 20, "2026-04-01")
    config = tables.read(spark, path)
    assert config.count() == 2
    assert [views.sla_setting(config, p, Settings()) for p in ("1", "2", "3")] == [50, 20, 30]


HOUR_ROW = "order_date date, order_hour int, accept_time timestamp_ntz, accept_hour int, rider_id string, is_completed boolean, is_cancelled boolean, is_paid boolean, pay_cancel_minutes double, employment_type string"


def test_hour_split(spark):
    d, t = date(2026, 4, 6), datetime(2026, 4, 6, 10, 5)
    rows = [(d, 10, t, 10, r, True, False, True, None, k) for r, k in (("F001", "fulltime"), ("P001", "parttime"), ("P001", "parttime"), ("U001", "unknown"))]
    got = views.hours(spark.createDataFrame(rows, HOUR_ROW), 5).first()
    assert (got.accepted_riders, got.fulltime_accepted_riders, got.parttime_accepted_riders, got.parttime_completed_orders, got.parttime_efficiency) == (3, 1, 1, 2, 2.0)


def test_accept_bucket_after_midnight(spark):
    d = date(2026, 4, 6)
    rows = [(d, 23, datetime(2026, 4, 7, h, m), h, "R1", True, False, True, None, "unknown") for h, m in ((0, 13), (1, 5))]
    df = spark.createDataFrame(rows, HOUR_ROW)
    assert {(r.date, r.hour, r.total_orders) for r in views.hours(df, 5, "accept").collect()} == {(date(2026, 4, 7), 0, 1), (date(2026, 4, 7), 1, 1)}
    assert [(r.date, r.accepted_riders) for r in views.rider_days(df, 5, "accept").collect()] == [(date(2026, 4, 7), 1)]
    made = {(r.date, r.hour): (r.total_orders, r.accepted_riders) for r in views.hours(df, 5).collect()}
    assert made == {(d, 23): (2, 0), (date(2026, 4, 7), 0): (0, 1), (date(2026, 4, 7), 1): (0, 1)}


def test_latest_row_counts(spark):
    rows = [("1", datetime(2026, 1, 1), 5, "a"), ("1", datetime(2026, 1, 2), 1, "b"), ("1", datetime(2026, 1, 2), 2, "c"), (" ", datetime(2026, 1, 1), 1, "d"), (None, datetime(2026, 1, 1), 1, "e")]
    df = spark.createDataFrame(rows, "order_id string, imported_at timestamp_ntz, source_row_number int, v string")
    assert [r.v for r in dwd.latest(df, "order_id").collect()] == ["c"]


def test_fluctuation_counts_rows_not_days(spark):
    rows = [("p", "P", date(2026, 3, 1) + timedelta(days=2 * i), n, 0, 0, 1, 1, 0.0, 0.0, 0.0) for i, n in enumerate([100] * 9 + [40])]
    names = "partner_id string, partner_name string, date date, completed_orders int, new_riders int, new_merchants int, active_riders int, active_merchants int, cancel_rate double, hq_subsidy_total double, partner_subsidy_total double"
    got = views.fluctuation(spark.createDataFrame(rows, names), Settings()).first()
    assert (got.baseline_orders, got.change, got.change_rate, got.city_level) == (100.0, -60.0, -0.6, "small")
    assert views.fluctuation(spark.createDataFrame(rows[:1], names), Settings()).count() == 0


def test_display_order(spark):
    df = spark.createDataFrame([("9",), ("10",), ("-",), (None,), ("b",)], "v string")
    assert [r.v for r in views.ordered(df, "v").collect()][:2] == ["10", "9"]
    assert [r.v for r in views.ordered(df, "v", False).collect()][:2] == ["9", "10"]


def test_text_sorts_as_a_chinese_reader_sorts_it(spark):
    df = spark.createDataFrame([("上海",), ("北京",), ("-",), ("广州",), (" ",), (None,), ("7",)], "v string")
    for descending in (False, True):
        got = [r.v for r in views.ordered(df, "v", descending).collect()]
        assert got[0] == "7" and got[1:4] == ["北京", "广州", "上海"][:: -1 if descending else 1] and set(got[4:]) == {"-", " ", None}


def test_registered_tables_exist():
    assert len(ads.TABLES) == 14 and len(mart.TABLES) == 15


def rider_file(raw, name, *rows):
    (raw / "riders").mkdir(parents=True, exist_ok=True)
    (raw / "riders" / name).write_text("帮手ID,帮手姓名,入职时间,状态,所属合伙人,区域\n" + "\n".join(rows) + "\n", encoding="utf-8")


def test_rosters_keep_the_rows_of_earlier_files(spark, tmp_path):
    raw = tmp_path / "raw"
    own = pipeline.Warehouse(spark, Settings(raw_root=str(raw), table_root=str(tmp_path / "t"), export_root=str(tmp_path / "m")))
    rider_file(raw, "a.csv", "1,甲,2026-01-01,在职,P,R", "2,乙,2026-01-01,在职,P,R")
    own.run()
    rider_file(raw, "b.csv", "3,丙,2026-02-01,在职,P,R", "2,乙新,2026-01-01,离职,P,R")
    own.run()
    assert {(r.rider_id, r.rider_name) for r in own.table("riders").collect()} == {("1", "甲"), ("2", "乙新"), ("3", "丙")}
    assert set(own.status()["files"].toPandas()["status"]) == {"success"}
    assert {r.run_id for r in own.status()["runs"].collect()} != set() and own.status()["runs"].select("run_id").distinct().count() == 1


def test_a_failed_run_leaves_its_files_to_the_next(spark, tmp_path, monkeypatch):
    raw = tmp_path / "raw"
    (raw / "orders_raw").mkdir(parents=True)
    (raw / "orders_raw" / "2026-04.csv").write_text("\n".join([",".join(HEADERS), *[",".join(x) for x in list(order_lines())[:4]]]), encoding="utf-8")
    own = pipeline.Warehouse(spark, Settings(raw_root=str(raw), table_root=str(tmp_path / "t"), export_root=str(tmp_path / "m")))
    monkeypatch.setattr(own, "_merge", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        own.run()
    monkeypatch.undo()
    again = own.run()
    assert (again.skipped, again.months) == (0, ["2026-04"]) and own.table("dwd_orders").count() == 4
    third = own.run()
    assert (third.skipped, third.months) == (1, [])


def test_lost_layers_are_built_again(house, imported, spark):
    import shutil

    before = house.table("dwd_orders").count()
    shutil.rmtree(next(Path(house.cfg.table_root, "dwd_orders").glob("run=*/order_month=2026-04")))
    assert house.run().months == ["2026-04"]
    shutil.rmtree(f"{house.cfg.table_root}/ads_admin_day")
    assert "2026-04" in house.run().months
    assert house.table("dwd_orders").count() == before


def test_large_months_are_cut_into_files(spark, tmp_path):
    """A month is not one task's: adaptive execution cuts it where it is large."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000).select(F.lit("2026-04").alias("order_month"), "id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
        tables.replace_months(df.repartition(8), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "order_month=2026-04").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_first_alias_that_stands_for_nothing_gives_way(spark):
    df = spark.createDataFrame([("1", "-", "天河")], "`帮手id` string, `区域` string, `所属区域` string").withColumn("source_row_number", F.lit(2))
    assert staging.stage_roster(df, "riders", "r.csv").first().region == "天河"


def test_region_choices_fall_back_to_what_exists(spark):
    places = spark.createDataFrame([("广东", "广州", "天河"), ("广东", "深圳", "南山"), ("浙江", "杭州", "西湖")], "province string, city string, district string")
    f, left = views.region_choices(places, views.Filters(province="广东", city="杭州", district="南山"))
    assert (f.province, f.city, f.district) == ("广东", None, "南山") and left.count() == 1
    f, left = views.region_choices(places, views.Filters(province="无", city="杭州"))
    assert (f.province, f.city) == (None, "杭州") and {r.district for r in left.collect()} == {"西湖"}


def test_requests_of_more_than_a_month_are_refused():
    with pytest.raises(ValueError):
        views.Filters.of_request(date(2026, 3, 1), date(2026, 4, 5))
    assert views.Filters.of_request(date(2026, 3, 1), None).end is None


def test_directory_mends_names(spark):
    broken = "未知".encode().decode("latin1")
    partners = spark.createDataFrame([("1", broken, "p", "c", "d")], "partner_id string, partner_name string, province string, city string, district string")
    day = spark.createDataFrame([], "partner_id string, partner_name string, province string, city string, district string")
    assert views.directory(partners, day).first().partner_name == "未知"


def test_validate_and_rebuild(house, imported):
    got = {(r.layer, r.month): r.rows for r in house.validate().collect()}
    assert got["ods_orders", "2026-04"] == got["dwd_orders", "2026-04"] == 182
    assert "2026-04" in house.rebuild()
    assert {(r.layer, r.month): r.rows for r in house.validate().collect()} == got
    assert house.check().count() == 0


def test_rows_are_numbered_as_in_the_file(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("订单编号,备注\n1,\"two\nlines\"\n2,b\n3,c\n", encoding="utf-8")
    assert [(r["订单编号"], r.source_row_number) for r in staging.read_csv(spark, str(path)).collect()] == [("1", 2), ("2", 3), ("3", 4)]
