"""Raw order and roster files: discovery, and the logical fields behind their headers."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import expressions as E
from ridgeline.sources import raw
from ridgeline.sources.raw import encoding_of, normal_header, normal_headers

__all__ = ["encoding_of", "normal_header", "normal_headers"]

SUFFIXES = (".xls", ".xlsx", ".csv")
FOLDERS = {"orders": ("orders_raw", "orders"), "riders": ("riders",), "merchants": ("merchants",), "partners": ("partners",)}

# fixed values: the headers under which each logical field appears, in order of preference; case does not count
ORDER_FIELDS = {
    "order_id": ("订单编号",),
    "partner_id": ("合伙人ID", "合伙人编号", "partner_id"),
    "partner_name": ("合伙人", "合伙人名称", "合伙人公司名", "合伙人公司名称", "partner_name"),
    "merchant_id": ("商家ID", "商户ID", "merchant_id"),
    "merchant_name": ("商家", "商家名称", "商户名称", "merchant_name"),
    "user_id": ("用户ID", "下单用户ID", "user_id"),
    "rider_id": ("配送员ID", "帮手ID", "骑手ID", "rider_id"),
    "rider_name": ("配送员", "配送员名称", "帮手姓名", "骑手姓名", "骑手", "rider_name"),
    "employment_status": ("在职状态", "employment_status"),
    "order_status": ("订单状态", "状态", "order_status"),
    "customer_service_id": ("客服编号", "customer_service_id"),
    "order_source": ("下单来源", "渠道来源", "order_source"),
    "added_at": ("添加时间", "下单时间", "创建时间", "create_time", "added_at"),
    "pay_time": ("支付时间", "pay_time"),
    "accept_time": ("接单时间", "accept_time"),
    "cancel_time": ("取消时间", "cancel_time"),
    "complete_time": ("完成时间", "送达时间", "complete_time"),
    "order_price": ("订单价格", "订单金额", "order_price"),
    "amount_payable": ("应付金额", "amount_payable"),
    "amount_paid": ("实付金额", "amount_paid"),
    "hq_discount_amount": ("总部优惠金额", "总部优惠", "hq_discount_amount"),
    "discount_amount": ("优惠金额", "discount_amount"),
    "coupon_id": ("优惠券ID", "优惠劵ID", "coupon_id"),
    "marketing_coupon_id": ("营销优惠券ID", "营销优惠劵ID", "marketing_coupon_id"),
    "rider_income": ("帮手收入", "骑手收入", "rider_income"),
    "partner_income": ("合伙人收入", "partner_income"),
    "hq_income": ("总部收入", "hq_income"),
    "maiyatian_income": ("麦芽田收入", "maiyatian_income", "myt_income"),
    "insurance_fee": ("保险费", "insurance_fee"),
}
ROSTER_FIELDS = {
    "riders": {
        "rider_id": ("帮手ID", "配送员ID", "骑手ID", "rider_id"),
        "rider_name": ("帮手姓名", "配送员", "配送员名称", "骑手姓名", "rider_name"),
        "hire_date": ("入职时间", "入职日期", "hire_date"),
        "status": ("状态", "status"),
        "partner_name": ("所属合伙人", "partner_name"),
        "region": ("所属区域", "区域", "region"),
    },
    "merchants": {
        "merchant_id": ("商家ID", "商户ID", "merchant_id"),
        "merchant_name": ("商家", "商家名称", "merchant_name"),
        "shop_name": ("商户名称", "shop_name"),
        "partner_name": ("所属合伙人", "partner_name"),
        "region": ("所属区域", "区域", "region"),
        "register_date": ("注册时间", "注册日期", "register_date"),
        "status": ("状态", "status"),
    },
    "partners": {
        "partner_id": ("ID", "合伙人ID", "partner_id"),
        "partner_name": ("合伙人", "合伙人名称", "合伙人公司名", "合伙人公司名称", "partner_name"),
        "open_date": ("成立时间", "开城时间", "open_date"),
        "region_raw": ("合伙人区域", "区域", "region_raw"),
        "status": ("状态", "status"),
    },
}
_IDS = ("order_id", "partner_id", "merchant_id", "user_id", "rider_id")
_TIMES = ("added_at", "pay_time", "accept_time", "cancel_time", "complete_time")
_AMOUNTS = ("order_price", "amount_payable", "amount_paid", "hq_discount_amount", "discount_amount", "rider_income", "partner_income", "hq_income", "maiyatian_income", "insurance_fee")


def discover(root: str | Path) -> list[tuple[str, str]]:
    """(kind, path) of each file under the raw root, in order; hidden files and other endings are left out, each file once."""
    out, seen = [], set()
    for kind, folders in FOLDERS.items():
        for folder in folders:
            for path in sorted(Path(root, folder).glob("*")):
                if path.suffix.lower() in SUFFIXES and not path.name.startswith((".", "~$")) and path.resolve() not in seen:
                    seen.add(path.resolve())
                    out.append((kind, str(path.resolve())))
    return out


def pending(files: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """The files whose content was not yet imported with success as that kind; all of them if forced."""
    if force:
        return files
    return files.join(registry.filter("status = 'success'").select("kind", "sha256"), ["kind", "sha256"], "left_anti")


def read_file(spark: SparkSession, path: str, step: int = raw.PIECE) -> DataFrame:
    """One file with all columns as text, headers normalised, and its row numbers (the header is row 1)."""
    size = raw.fingerprints(spark, [path]).first().size
    pieces = raw.survey(spark, [("file", path, size)], step)
    pieces = spark.createDataFrame(pieces.collect(), pieces.schema)  # those of one file
    error = pieces.first().error
    if error:
        raise ValueError(error)
    cells = raw.rows(pieces)
    names = raw.headers(path, pieces.first())
    return cells.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in names], "source_row_number")


read_csv = read_file


def of_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows with ``cells``, the columns' texts by name where they are not blank."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("string") for n in names]))
    return df.withColumn("cells", F.map_filter(pairs, lambda _, v: E.blank_to_null(v).isNotNull()))


def _logical(df: DataFrame, fields: dict[str, tuple[str, ...]], clean: bool = False) -> dict[str, Column]:
    """Each field from the first of its headers that is filled, or with ``clean`` that still is when texts that stand for nothing are gone.

    Texts are looked for in ``cells`` if there are any, or in ``payload``, or in the columns.
    """
    have = set(df.columns)

    def value(alias: str) -> Column:
        name = normal_header(alias)
        if "cells" in have:
            c = F.try_element_at("cells", F.lit(name))
        elif "payload" in have:
            c = F.try_variant_get("payload", f"$['{name}']", "string")
        else:
            c = F.col(f"`{name}`")
        return E.clean_text(c) if clean else c

    return {n: E.first_filled([value(a) for a in aliases if normal_header(a) in have or have & {"cells", "payload"}]) for n, aliases in fields.items()}


def _payload(df: DataFrame) -> list[Column]:
    """The whole source row, for what is asked of it later."""
    return [F.to_variant_object("cells").alias("payload")] if "cells" in df.columns else []


def stage_orders(df: DataFrame, path: str | Column) -> DataFrame:
    """Logical fields as text, with the file, its month, the row number and the whole row: the raw layer's rows."""
    fields = _logical(df, ORDER_FIELDS)
    file = F.lit(path) if isinstance(path, str) else path
    staged = df.select(*[c.alias(n) for n, c in fields.items()], file.alias("file"), "source_row_number", *_payload(df))
    of_file = E.month_of_file(F.element_at(F.split("file", "/"), -1))
    return staged.withColumn("order_month", E.valid_month(F.coalesce(E.month(E.timestamp(F.col("added_at"))), of_file)))


def told_again(rows: DataFrame, fields: dict[str, tuple[str, ...]], clean: bool = False) -> DataFrame:
    """Raw rows whose missing fields are looked for in the payload, under the headers that count now; months stay."""
    if "payload" not in rows.columns:
        return rows
    found = _logical(rows.select("payload"), fields, clean)
    return rows.withColumns({n: F.coalesce(F.col(n), c) if n in rows.columns else c for n, c in found.items()})


def accepted(staged: DataFrame) -> DataFrame:
    """Rows with an order id."""
    return staged.filter(E.blank_to_null(F.col("order_id")).isNotNull() & F.col("order_month").isNotNull())


def abnormal(staged: DataFrame) -> DataFrame:
    """One row for each file and kind of fault: rows without order id, and rows without month."""
    no_id = E.blank_to_null(F.col("order_id")).isNull()
    kind = F.when(no_id, "missing_order_id").when(F.col("order_month").isNull(), "missing_order_month")
    return staged.select("file", kind.alias("kind")).filter("kind IS NOT NULL").groupBy("file", "kind").agg(F.count(F.lit(1)).alias("rows"))


def typed_orders(raw: DataFrame) -> DataFrame:
    """The fact's input: ids normalised, times and amounts parsed."""
    return raw.withColumns({
        **{n: E.identifier(F.col(n)) for n in _IDS}, **{n: E.timestamp(F.col(n)) for n in _TIMES}, **{n: E.amount(F.col(n)) for n in _AMOUNTS},
    }).withColumnRenamed("added_at", "create_time")


def stage_roster(df: DataFrame, kind: str, path: str | Column) -> DataFrame:
    """Logical fields of a roster file as text, with the file and the row number: the raw layer's rows, those with an id."""
    fields = _logical(df, ROSTER_FIELDS[kind], clean=True)
    file = F.lit(path) if isinstance(path, str) else path
    return df.select(*[c.alias(n) for n, c in fields.items()], file.alias("file"), "source_row_number", *_payload(df)).filter(F.col(f"{kind[:-1]}_id").isNotNull())


def typed_roster(rows: DataFrame, kind: str) -> DataFrame:
    """A roster from the raw rows of all files: ids normalised, dates parsed, partners' regions cut into levels; of an id the latest row.

    A field that a row lacks is looked for in its payload, and a shop's name in the latest row of the merchant that has one.
    """
    fields = ROSTER_FIELDS[kind]
    key = f"{kind[:-1]}_id"
    rows = told_again(rows, fields, clean=True)
    out = rows.select(*fields, *[c for c in ("imported_at", "source_row_number", "file") if c in rows.columns])
    out = out.withColumn(key, E.identifier(F.col(key)))
    for n in ("hire_date", "register_date", "open_date"):
        if n in fields:
            out = out.withColumn(n, E.date(F.col(n)))
    if kind == "partners":
        out = out.withColumn("r", E.region(F.col("region_raw"))).select("*", "r.province", "r.city", "r.district").drop("r")
    order = [c for c in ("imported_at", "source_row_number", "file") if c in out.columns]
    latest = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order or [key]])
    if kind == "merchants":
        known = F.first("shop_name", ignorenulls=True).over(latest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        out = out.withColumn("shop_name", F.coalesce("shop_name", known))
    rank = F.row_number().over(latest)
    return out.filter(F.col(key).isNotNull()).withColumn("__rank", rank).filter("__rank = 1").drop("__rank", *order)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ; what one lacks is missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
