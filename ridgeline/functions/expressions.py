"""Column helpers: conditional aggregates, ratios, cleaning and parsing."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------- aggregates


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- numbers


def half_up(value: Column, digits: int) -> Column:
    """Round by scaling, which agrees with the SQL oracle on every ratio of counts."""
    scale = float(10**digits)
    return F.round(value.cast("double") * F.lit(scale), 0) / F.lit(scale)


def money(value: Column) -> Column:
    return half_up(value, 2)


def quotient(a: Column, b: Column) -> Column:
    """a / b as double; missing where b is 0 or missing."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def ratio0(a: Column, b: Column, digits: int = 4) -> Column:
    """Rounded a / b, 0 where b is 0."""
    return half_up(F.coalesce(quotient(a, b), F.lit(0.0)), digits)


def ratio_null(a: Column, b: Column, digits: int = 4) -> Column:
    """Rounded a / b, missing where b is 0."""
    return half_up(quotient(a, b), digits)


def average_money(total: Column, n: Column) -> Column:
    """Rounded total / n with the total taken in whole cents, so that the order of summing shows nowhere; missing where n is 0."""
    cents = F.round(total * F.lit(100.0), 0)
    return F.round(quotient(cents, n), 0) / F.lit(100.0)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, in minutes."""
    def seconds(c: Column) -> Column:
        return F.unix_timestamp(c.cast("timestamp"))

    return (seconds(end) - seconds(start)).cast("double") / F.lit(60.0)


def score_high(value: Column, warn: float, target: float, most: float) -> Column:
    """0 up to ``warn``, ``most`` from ``target`` on, and in between in proportion."""
    part = half_up((value - F.lit(warn)) / F.lit(target - warn) * F.lit(most), 2)
    return F.when(value <= warn, F.lit(0.0)).when(value >= target, F.lit(most)).otherwise(part)


def score_low(value: Column, target: float, warn: float, most: float) -> Column:
    """``most`` down from ``target``, 0 from ``warn`` on, and in between in proportion."""
    part = half_up((F.lit(warn) - value) / F.lit(warn - target) * F.lit(most), 2)
    return F.when(value <= target, F.lit(most)).when(value >= warn, F.lit(0.0)).otherwise(part)


# ------------------------------------------------------------------- text


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_filled(columns: list[Column]) -> Column:
    """The first of the columns that is not blank; missing if there are none."""
    return F.coalesce(*[blank_to_null(c) for c in columns]) if columns else F.lit(None).cast("string")


# fixed values: texts that stand for nothing
NOTHING = ("", "nan", "none", "null", "-")


def clean_text(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(F.lower(text).isin(*NOTHING), F.lit(None)).otherwise(text)


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters below U+10000 that compatibility normalisation (NFKC) makes one other, what these are, and those that it makes several of or none."""
    one, other, more = [], [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        n = unicodedata.normalize("NFKC", c)
        if n != c and len(n) == 1:
            one.append(c)
            other.append(n)
        elif n != c:
            more[c] = n
    return "".join(one), "".join(other), more


def compatible(text: Column) -> Column:
    """Text with each character as compatibility normalisation has it; characters that only together are another stay apart."""
    one, other, more = _compatible()
    narrow = F.translate(text, one, other)
    pairs = F.from_json(F.lit(json.dumps(more)), "map<string,string>")  # folded to a constant once a plan
    each = F.transform(F.split(narrow, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c))
    return F.when(narrow.rlike("[" + "".join(more) + "]"), F.concat_ws("", each)).otherwise(narrow)


def identifier(value: Column) -> Column:
    """An id as text: no spaces, compatible forms narrowed, and numbers without plus sign, leading zeros or zeros after the point.

    One rule for orders and rosters, so that their ids join.
    """
    clean = clean_text(value)
    text = F.regexp_replace(F.when(clean.rlike(r"[^\x00-\x7F]"), compatible(clean)).otherwise(clean), r"\s+", "")
    plain = F.regexp_extract(text, r"^\+?0*([0-9]+)(?:\.0*)?$", 1)
    power = F.when(text.rlike(r"^\+?[0-9]+(\.[0-9]+)?[eE]\+?[0-9]{1,2}$"), text.try_cast("decimal(38,4)"))
    whole = F.when(power == F.floor(power), F.floor(power).cast("string"))
    part = F.regexp_extract(text, r"^\+?0*([0-9]+\.[0-9]*[1-9])0*$", 1)
    return blank_to_null(F.coalesce(F.nullif(plain, F.lit("")), F.nullif(part, F.lit("")), whole, F.regexp_replace(text, r"^\+", "")))


def amount(value: Column) -> Column:
    """A number from text with anything around it; 0 if there is none."""
    digits = F.regexp_replace(value.cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


#: Year, month and day, and perhaps the time, in figures: the usual form.
_USUAL = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})(\.\d{1,9})?)?)?$"
# fixed values: other forms in which dates are written, with the shape that each has
DATE_FORMS = (
    (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"), (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"), (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"), (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
)


def timestamp(value: Column) -> Column:
    """A time from text of the usual form, with - or / between year, month and day; missing where it has another.  A text is parsed once."""
    text = F.trim(value.cast("string"))
    # the parts in one order; a time that is not there is midnight
    parts = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _USUAL, "$1-$3-$4 $5:$6:$7$8"), " ::$", " 0:0:0"), ":$", ":0")
    return F.when(text.rlike(_USUAL), parts.try_cast("timestamp_ntz"))


def date(value: Column) -> Column:
    """A date from text: of a usual time, or in one of some other forms that its shape tells.

    Numbers from 20000 to 80000 are days as spreadsheets count them.
    """
    text = F.trim(value.cast("string"))
    days = F.when(text.rlike(r"^[2-7]\d{4}(\.\d+)?$"), F.floor(text.try_cast("double")).cast("int"))
    out = F.when(days.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), days))
    for shape, form in DATE_FORMS:
        out = out.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("date"))
    return F.coalesce(timestamp(value).cast("date"), out)


def month(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def valid_month(value: Column) -> Column:
    return F.when(value.rlike(r"^20\d{2}-(0[1-9]|1[0-2])$"), value)


def month_of_file(name: Column) -> Column:
    """``yyyy-MM`` from a file name: a year, then one or two digits before 月, or else any of 1 to 12."""
    def of(pattern: str) -> Column:
        year, number = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).try_cast("int")
        return F.when(number.between(1, 12), F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0")))

    return F.coalesce(of(r"(20\d\d)[^\d]?(\d{1,2})月"), of(r"(20\d\d)[^\d]?(\d{1,2})"))


def repaired(value: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; kept only if that is valid and loses no Chinese."""
    odd = value.rlike("[À-ÿ]") & ~value.rlike("[^\u0000-ÿ]")
    raw = F.encode(F.when(odd, value), "ISO-8859-1")
    again = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))

    def chinese(c: Column) -> Column:
        return F.regexp_count(c, F.lit("[一-鿿]"))

    return F.when(odd & again.isNotNull() & (chinese(again) >= chinese(value)), again).otherwise(value)


# fixed values: the cities that are provinces
MUNICIPALITIES = ("北京", "上海", "天津", "重庆")


def region(value: Column) -> Column:
    """``struct(province, city, district)`` from a region's text.

    The first line that is not blank, cut at separators: three parts or more are the three
    levels; two are province and city, or municipality and district; one is cut by
    the endings of province, city and district, and is the province itself if it has none.
    """
    line = F.trim(F.coalesce(F.get(F.filter(F.split(value, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")))
    parts = F.filter(F.split(line, r"[-/\\|,，、\s]+"), lambda x: x != "")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    city_state = reduce(lambda a, b: a | b, [part(0).startswith(m) for m in MUNICIPALITIES])
    one = part(0)
    none = F.lit(None).cast("string")
    province = F.regexp_extract(one, r"^(.+?(?:省|自治区|特别行政区|市))", 1)
    after = F.substr(one, F.length(province) + 1)
    own_city = reduce(lambda a, b: a | b, [province.startswith(m) for m in MUNICIPALITIES])
    city = F.nullif(F.regexp_extract(after, r"^(.+?(?:自治州|地区|盟|市))", 1), F.lit(""))
    rest = F.substr(after, F.length(F.coalesce(city, F.lit(""))) + 1)
    # what no ending cuts off is the district as it stands
    cut = F.nullif(F.regexp_extract(rest, r"^(.+?(?:区|县|旗|市))", 1), F.lit(""))
    district = F.when(city.isNull() & ~own_city, F.nullif(rest, F.lit(""))).otherwise(F.coalesce(cut, F.nullif(rest, F.lit(""))))

    def level(three: Column, pair_city: Column, pair: Column, single: Column, bare: Column) -> Column:
        return (
            F.when(n >= 3, three).when((n == 2) & city_state, pair_city).when(n == 2, pair)
            .when((n == 1) & (province != ""), single).when(n == 1, bare)
        )

    return F.struct(
        level(part(0), part(0), part(0), province, one).alias("province"),
        level(part(1), part(0), part(1), F.when(own_city, F.coalesce(city, province)).otherwise(city), none).alias("city"),
        level(part(2), part(1), none, district, none).alias("district"),
    )
