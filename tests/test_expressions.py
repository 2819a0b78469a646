from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ridgeline.config import PARTNER_TIERS, Settings, tiers_from_json, tiers_from_text
from ridgeline.functions import expressions as E
from ridgeline.functions.periods import check_window, day_count, periods


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_identifier(spark):
    got = values(spark, E.identifier, ["123.0", "00123", "+45.00", "-", None, " ", "１２３", "45.50", "＃７－Ａ", "1E3", "ORD-0-9-1", "A 1　2", "0", "nan"])
    assert got == ["123", "123", "45", None, None, None, "123", "45.5", "#7-A", "1000", "ORD-0-9-1", "A12", "0", None]


def test_amount(spark):
    assert values(spark, E.amount, ["¥1,234.50", "净额-88元", None, "无效值", "1.2.3"]) == [1234.5, -88.0, 0.0, 0.0, 0.0]


def test_timestamp(spark):
    got = values(spark, E.timestamp, ["2026-03-05 09:08:07", "2026/3/5 9:8", " 2026-03-05 ", "2026-03-05T09:08:07.123456", "2026-02-30", "24:00:00", "20260305", None, ""])
    assert got[:4] == [datetime(2026, 3, 5, 9, 8, 7), datetime(2026, 3, 5, 9, 8), datetime(2026, 3, 5), datetime(2026, 3, 5, 9, 8, 7, 123456)]
    assert got[4:] == [None] * 5


def test_dates_in_other_forms(spark):
    texts = ["20190501", "2019.5.1", "2019年5月1日", "May 1, 2019", "1 May 2019", "01-May-2019", "1 January 2019", "January 31, 2019", "43586", "43586.75", "2019-05-01 23:59:59", "2019/5/1"]
    day = date(2019, 5, 1)
    assert values(spark, E.date, texts) == [day] * 6 + [date(2019, 1, 1), date(2019, 1, 31)] + [day] * 4
    assert values(spark, E.date, ["20191301", "123", "1-5-2019", "soon", "99999", "2019-02-30", None]) == [None] * 7


def test_compatible_characters_as_the_database_has_them(spark):
    """Each character below U+10000 that has a compatible form, one by one."""
    import unicodedata

    signs = [chr(c) for c in (*range(0x20, 0xD800), *range(0xE000, 0x10000)) if unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    assert len(signs) > 2500
    df = spark.createDataFrame([(s,) for s in [*signs, "①㈱ﬁ２", "plain"]], "s string")
    assert all(r[1] == unicodedata.normalize("NFKC", r[0]) for r in df.select("s", E.compatible(F.col("s"))).collect())
    assert values(spark, E.identifier, ["①２", "ＡＢ－７", "㎏9", "\u00a012\u2003"]) == ["12", "AB-7", "kg9", "12"]


def test_months(spark):
    assert values(spark, E.month_of_file, ["2026-03 orders.xls", "orders.csv", "2026年4月.csv", "2026-13.csv"]) == ["2026-03", None, "2026-04", None]
    assert values(spark, E.valid_month, ["2026-03", "2026-13", "1999-01", None]) == ["2026-03", None, None, None]


def test_region(spark):
    got = values(spark, E.region, ["广东省 梅州市 梅江区", "广东省/广州市/天河区", "北京 朝阳", "广东-深圳", "广东省梅州市梅江区", "上海市浦东新区", "somewhere", "", None])
    assert [tuple(r) for r in got[:7]] == [
        ("广东省", "梅州市", "梅江区"), ("广东省", "广州市", "天河区"), ("北京", "北京", "朝阳"), ("广东", "深圳", None), ("广东省", "梅州市", "梅江区"),
        ("上海市", "上海市", "浦东新区"), ("somewhere", None, None),
    ]
    assert [tuple(r) for r in got[7:]] == [(None, None, None)] * 2
    rest = values(spark, E.region, ["广东省梅州市梅江", "北京市朝阳", "广东省梅江区", "广东省", "北京市"])
    assert [tuple(r) for r in rest] == [("广东省", "梅州市", "梅江"), ("北京市", "北京市", "朝阳"), ("广东省", None, "梅江区"), ("广东省", None, None), ("北京市", "北京市", None)]


def test_text(spark):
    assert values(spark, E.clean_text, [" a ", "NaN", "none", "-", "", None]) == ["a", None, None, None, None, None]
    broken = "未知".encode().decode("latin1")
    assert values(spark, E.repaired, [broken, "未知", "café", None]) == ["未知", "未知", "café", None]


def test_rounding(spark):
    df = spark.createDataFrame([(23, 40), (1, 0), (2, 3)], "a int, b int")
    rows = df.select(E.ratio0(F.col("a"), F.col("b"), 2), E.ratio_null(F.col("a"), F.col("b")), E.average_money(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(0.57, 0.575, 0.58), (0.0, None, None), (0.67, 0.6667, 0.67)]


def test_scores(spark):
    df = spark.createDataFrame([(0.6,), (0.75,), (0.9,), (1.5,)], "v double")
    assert [r[0] for r in df.select(E.score_high(F.col("v"), 0.6, 0.9, 10)).collect()] == [0.0, 5.0, 10.0, 10.0]
    assert [r[0] for r in df.select(E.score_low(F.col("v"), 0.7, 0.8, 10)).collect()] == [10.0, 5.0, 0.0, 0.0]


def test_window():
    with pytest.raises(ValueError):
        check_window(date(2026, 3, 1), date(2026, 4, 5))
    with pytest.raises(ValueError):
        check_window(date(2026, 3, 2), date(2026, 3, 1))
    check_window(date(2026, 3, 1), date(2026, 3, 31))
    check_window(None, date(2026, 3, 31))


def test_periods():
    a, b = date(2026, 4, 1), date(2026, 4, 10)
    assert periods(a, b) == ((date(2026, 3, 22), date(2026, 3, 31)), (a, b))
    assert periods(a, b, baseline=(date(2026, 1, 1), None)) == ((date(2026, 1, 1), None), (a, b))
    assert periods(None, None) == ((None, None), (None, None))
    assert periods(a, b, compare=(None, date(2026, 4, 5)))[1] == (a, date(2026, 4, 5))
    assert (day_count(a, b), day_count(None, b, 3), day_count(None, None)) == (10, 3, 1)


def test_tiers():
    assert [t.label for t in tiers_from_json('[{"min": 1, "max": 9}, {"min": 10}, {"max": 1}, 3]', PARTNER_TIERS)] == ["1-9", "10+"]
    assert tiers_from_json("nonsense", PARTNER_TIERS) == PARTNER_TIERS
    assert [(t.low, t.high) for t in tiers_from_text("1-9，10+, x, 9-1")] == [(1.0, 9.0), (10.0, None)]
    assert not any(t.holds(9.5) for t in PARTNER_TIERS)


def test_settings():
    assert Settings(excluded_partners=()).excluded_partners == ()
    assert Settings().threshold(0) == 5 and Settings().threshold(8) == 8
