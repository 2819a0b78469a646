"""Raw files of all formats as rows: pieces of quoted CSV in each encoding, workbooks, digests, one plan for many files."""

import csv
import hashlib
import io
import random
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ridgeline import pipeline
from ridgeline.config import Settings
from ridgeline.sources import raw, staging
from tests.test_layers import HEADERS, order_lines


def plain_rows(data: bytes, encoding: str):
    """What the standard reader makes of the whole file: number and filled cells of each row that is not blank."""
    rows = [r for r in csv.reader(io.StringIO(data.decode(encoding), newline="")) if r]
    header = raw.normal_headers(rows[0])
    return [(n, {h: v for h, v in zip(header, r, strict=False) if v.strip()}) for n, r in enumerate(rows[1:], 2)]


def odd_csv(seed: int, rows: int, sign: str, end: str = "\n") -> str:
    """Rows with quotes, line ends and commas in values, quotes inside plain values, blank lines, short and long rows."""
    r = random.Random(seed)
    out = ["订单编号,备注,Order（Actual）,备注"]
    for i in range(rows):
        kind = r.randrange(9)
        text = {
            0: f"plain {sign}", 1: f'"a{end}b, ""{sign}"" c{end}{end}"', 2: f'"{end}"', 3: 'five" pipe', 4: '""', 5: f'"{"x,y" + end * 3}{sign * 40}"', 6: f'"{sign}"tail', 7: "", 8: f'"{end}""{end}"',
        }[kind]
        out.append(f"{i},{text},{sign}{i}" + (",more,than,header" if kind == 6 else ""))
        if kind == 7:
            out.append("")
    return end.join(out) + (end if seed % 2 else "")


def read_rows(spark, path: Path, step: int):
    pieces = raw.survey(spark, [("orders", str(path), path.stat().st_size)], step)
    return sorted((r.source_row_number, dict(r.cells)) for r in raw.rows(pieces).collect())


@pytest.mark.parametrize("encoding, sign, end", [("utf-8", "单é", "\n"), ("utf-8-sig", "单", "\r\n"), ("gbk", "订单", "\n"), ("latin1", "é\xff", "\r\n")])
def test_pieces_of_a_file_are_its_rows(spark, tmp_path, encoding, sign, end):
    """Whatever the pieces' size, rows and numbers are those of one reader; pieces begin inside quotes now and then."""
    header_of = {"latin1": lambda t: t.replace("订单编号", "id").replace("备注", "r").replace("（Actual）", "(a)")}.get(encoding, lambda t: t)
    path = tmp_path / "o.csv"
    for seed, step in ((1, 97), (2, 700), (3, 1 << 20)):
        data = header_of(odd_csv(seed, 150, sign, end)).encode(encoding)
        path.write_bytes(data)
        want = plain_rows(data, encoding)
        assert read_rows(spark, path, step) == want
    pieces = raw.survey(spark, [("orders", str(path), len(data))], 97).collect()
    assert len(pieces) > 20 and any(p.inside for p in pieces) and {p.encoding for p in pieces} == {"utf-8" if encoding == "utf-8-sig" else encoding}


def test_one_long_quoted_value_over_many_pieces(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("订单编号,备注\n1,\"" + "line, \"\"of\"\" many\n" * 400 + "\"\n2,b\n3," + "no line end " * 300 + "\n4,d", encoding="gbk")
    got = read_rows(spark, path, 256)
    assert got == plain_rows(path.read_bytes(), "gbk") and [n for n, _ in got] == [2, 3, 4, 5]


def test_encoding_is_the_first_that_reads_all_pieces(spark, tmp_path):
    """A sign of the last piece decides for all."""
    path = tmp_path / "o.csv"
    path.write_bytes("a,b\n".encode() + b"1,plain\n" * 200 + "2,é\n".encode("latin1"))
    assert read_rows(spark, path, 128)[-1] == (202, {"a": "2", "b": "é"})


def test_two_thousand_files_are_one_scan(spark, tmp_path):
    """Files of two headers and encodings: the plan reads pieces once, and there is no union."""
    files = []
    for i in range(2000):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(f"订单编号,添加时间\n{i},2026-04-01\n".encode("gbk") if i % 2 else f"添加时间,备注,订单编号\n2026-05-01,x,{i}\n".encode())
        files.append(("orders", str(path), path.stat().st_size))
    pieces = raw.survey(spark, files)
    pieces.write.parquet(str(tmp_path / "pieces"))
    staged = staging.stage_orders(raw.rows(spark.read.parquet(str(tmp_path / "pieces"))), F.col("path"))
    plan = staged._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "Union" not in plan
    got = staged.groupBy("order_month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("order_id").alias("ids")).collect()
    assert sorted((r.order_month, r.n, r.ids) for r in got) == [("2026-04", 1000, 1000), ("2026-05", 1000, 1000)]


def test_digests_of_files(spark, tmp_path):
    data = random.Random(1).randbytes(3 << 20)
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(b"")
    got = {r.path: (r.sha256, r.size) for r in raw.fingerprints(spark, [str(tmp_path / "a"), f"file:{tmp_path}/b"]).collect()}
    assert got == {str(tmp_path / "a"): (hashlib.sha256(data).hexdigest(), len(data)), f"file:{tmp_path}/b": (hashlib.sha256(b"").hexdigest(), 0)}
    assert raw.fingerprints(spark, []).count() == 0


# --------------------------------------------------------------- workbooks


def workbook(path: Path, sheets: list[str], shared: list[str] = (), styles: str = "", date1904: bool = False):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(len(sheets)))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><workbookPr{" date1904=\"1\"" * date1904}/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(shared)}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")


def inline(reference: str, text: str) -> str:
    return f'<c r="{reference}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="22"/><xf numFmtId="165"/></cellXfs>'


def test_workbook_rows(spark, tmp_path):
    """The sheet of most rows; shared and inline strings, numbers, dates, booleans, errors, gaps and repeated headers."""
    shared = ["<si><t>订单编号</t></si>", "<si><r><t>备</t></r><r><t>注</t></r><rPh><t>bei</t></rPh></si>", "<si><t>two\nlines</t></si>"]
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>1</v></c><c r="E1" t="str"><f>x</f><v>下单时间</v></c></row>'
        '<row r="2"><c r="A2"><v>20190500000001</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>18.8</v></c><c r="E2" s="2"><v>43586.5</v></c></row>'
        '<row r="4"><c r="A4"><v>1.5E3</v></c><c r="B4" t="b"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4" s="3"><v>2</v></c><c r="E4" s="1"><v>59</v></c></row>'
        '<row r="5"><c r="A5" s="1"/></row>'
        f'<row>{inline("A6", "x")}<c><v>7</v></c>{inline("F6", "beyond")}</row>'
    )
    small = f'<row r="1">{inline("A1", "other")}</row>'
    path = tmp_path / "b.xlsx"
    workbook(path, [small, rows, small], shared, STYLES)
    got = {r.source_row_number: {k: v for k, v in r.asDict().items() if v is not None and k != "source_row_number"} for r in staging.read_file(spark, str(path)).collect()}
    assert got == {
        2: {"订单编号": "20190500000001", "备注": "two\nlines", "备注.1": "18.8", "下单时间": "2019-05-01 12:00:00"},
        4: {"订单编号": "1500", "备注": "True", "column": "2", "下单时间": "1900-02-28 00:00:00"},
        6: {"订单编号": "x", "备注": "7"},
    }
    workbook(path, [f'<row>{inline("A1", "d")}</row><row><c r="A2" s="1"><v>0.25</v></c></row><row><c r="A3" s="1"><v>1</v></c></row>'], styles=STYLES, date1904=True)
    assert [r.d for r in staging.read_file(spark, str(path)).orderBy("source_row_number").collect()] == ["06:00:00", "1904-01-02 00:00:00"]


def test_what_is_no_workbook_is_told(spark, tmp_path):
    bad = {"none.xlsx": b"no zip", "old.xls": b"\xd0\xcf\x11\xe0" * 100, "empty.csv": b""}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    workbook(tmp_path / "blank.xlsx", [""])
    workbook(tmp_path / "cut.xlsx", ["<row><c><v>1</v>"])
    workbook(tmp_path / "none_at_all.xlsx", [])
    found = raw.survey(spark, [("orders", str(p), p.stat().st_size) for p in tmp_path.iterdir()])
    told = {Path(r.path).name: r.error for r in found.collect()}
    assert len(told) == 6 and all(told.values()) and "header" in told["empty.csv"] and "header" in told["blank.xlsx"]
    assert raw.rows(found).count() == 0


# ------------------------------------------------------- imported together


def house_of(spark, root: Path) -> pipeline.Warehouse:
    for d in ("orders_raw", "riders", "merchants", "partners"):
        (root / "raw" / d).mkdir(parents=True, exist_ok=True)
    return pipeline.Warehouse(spark, Settings(excluded_partners=(), raw_root=str(root / "raw"), table_root=str(root / "tables"), export_root=str(root / "mart")))


def sheet_of(rows: list[list[str]]) -> str:
    return "".join(f'<row r="{n}">' + "".join(inline(f"{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[c]}{n}", v) for c, v in enumerate(r) if v) + "</row>" for n, r in enumerate(rows, 1))


def test_import_of_other_headers_workbooks_and_payloads(spark, tmp_path, monkeypatch):
    house = house_of(spark, tmp_path)
    orders = tmp_path / "raw" / "orders_raw"
    other = {"添加时间": "下单时间", "完成时间": "送达时间", "配送员ID": "帮手ID", "实付金额": "amount_paid", "下单来源": "渠道来源", "商家ID": "商户ID"}
    lines = list(order_lines())
    workbook(orders / "2026-04.xlsx", [sheet_of([HEADERS, *lines[:20]]), sheet_of([["x"]])])
    (orders / "new.csv").write_text("\n".join(",".join(x) for x in [[other.get(h, h) for h in HEADERS], *lines[20:40]]), encoding="gbk")
    (orders / "english.csv").write_text("订单编号,partner_id,create_time,complete_time,rider_id,order_price,门店评分\nE1,9,2026-04-03 10:00:00,2026-04-03 10:30:00,77,12.5,4.9\n", encoding="utf-8")
    (tmp_path / "raw" / "merchants" / "a.csv").write_text("商家ID,商家名称,商户名称,注册日期\n1001,甲,旧店,2026-03-25\n", encoding="utf-8")
    (tmp_path / "raw" / "merchants" / "b.csv").write_text("商户ID,商家,招牌\n1001,甲新,\n1002,乙,新招牌\n", encoding="utf-8")
    workbook(tmp_path / "raw" / "partners" / "p.xlsx", [sheet_of([["ID", "合伙人名称", "开城时间", "区域"], ["1", "合伙甲", "2026-03-20", "广东省 梅州市 梅江区"]])])
    result = house.run()
    assert (result.status, result.failed, result.months) == ("success", 0, ["2026-04"])
    fact = {r.order_id: r for r in house.table("dwd_orders").collect()}
    assert len(fact) == 41
    assert fact["E1"].rider_id == "77" and fact["E1"].order_price == 12.5 and fact["E1"].complete_time is not None
    late = next(r for o, r in fact.items() if o == lines[20][0])
    assert (late.merchant_id, late.rider_id, late.amount_paid) == ("1001", "3001", 18.8) and late.complete_time is not None and late.order_source == "小程序"
    assert house.table("ods_orders").filter("file LIKE '%.xlsx'").agg(F.min("source_row_number"), F.max("source_row_number")).first() == (2, 21)
    partner = house.table("partners").first()
    assert (partner.partner_name, str(partner.open_date), partner.city) == ("合伙甲", "2026-03-20", "梅州市")
    # the latest row names the merchant; its shop is the last that any row tells
    assert {r.merchant_id: (r.merchant_name, r.shop_name, str(r.register_date)) for r in house.table("merchants").collect()} == {"1001": ("甲新", "旧店", "None"), "1002": ("乙", None, "None")}
    # headers that are known later are read from the raw layer, not from the files
    for path in (tmp_path / "raw").rglob("*.*"):
        path.unlink()
    monkeypatch.setitem(staging.ORDER_FIELDS, "customer_service_id", (*staging.ORDER_FIELDS["customer_service_id"], "门店评分"))
    monkeypatch.setitem(staging.ROSTER_FIELDS["merchants"], "shop_name", (*staging.ROSTER_FIELDS["merchants"]["shop_name"], "招牌"))
    assert house.rebuild() == ["2026-04"]
    assert {r.order_id: r.customer_service_id for r in house.table("dwd_orders").filter("order_id = 'E1'").collect()} == {"E1": "4.9"}
    assert {r.merchant_id: r.shop_name for r in house.table("merchants").collect()} == {"1001": "旧店", "1002": "新招牌"}
    assert house.table("dwd_orders").count() == 41


def test_fields_that_all_rows_lack_are_told_again(spark, tmp_path, monkeypatch):
    """Raw rows without income or core fields, imported before their headers were known, are filled from their payloads."""
    house = house_of(spark, tmp_path)
    lines = list(order_lines())[:6]
    (tmp_path / "raw" / "orders_raw" / "2026-04.csv").write_text("\n".join(",".join(x) for x in [HEADERS, *lines]), encoding="utf-8")
    for field in ("rider_income", "partner_income"):
        monkeypatch.setitem(staging.ORDER_FIELDS, field, ())
    house.run()
    assert house.table("dwd_orders").agg(F.sum("rider_income")).first()[0] == 0
    monkeypatch.undo()
    assert house.run().months == ["2026-04"]
    assert house.table("dwd_orders").agg(F.sum("rider_income")).first()[0] == 16.5
    assert house.run().months == []
