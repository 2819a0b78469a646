"""Measures of groups of rows, distinct counts under conditions included, by hash aggregates of fixed-width values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """What is measured: ``count`` of rows, ``sum``, ``any``, ``most`` (greatest) or ``distinct`` values of the column ``name``.

    ``value`` is a condition for counts, and what is summed or compared for the others;
    ``then`` is applied to the sum of a whole group.
    """

    kind: str
    value: Column | None = None
    name: str = ""
    then: Callable[[Column], Column] = lambda c: c

    @property
    def column(self) -> Column:
        """The measure as an aggregate by itself."""
        if self.kind == "distinct":
            return F.count_distinct(F.when(self.value, F.col(self.name)))
        return self.whole(self.part(None))

    def part(self, counts: Column | None) -> Column:
        """The aggregate of some rows, of which only those where ``counts`` holds count."""
        if self.kind == "count":
            both = [c for c in (counts, self.value) if c is not None]
            return F.count_if(reduce(Column.__and__, both)) if both else F.count(F.lit(1))
        value = self.value if counts is None else F.when(counts, self.value)
        return {"sum": F.sum, "any": F.bool_or, "most": F.max}[self.kind](value)

    def of_parts(self, part: Column) -> Column:
        """The aggregate of what :meth:`part` gave for parts of a group."""
        return F.coalesce(F.sum(part), F.lit(0)) if self.kind == "count" else {"sum": F.sum, "any": F.bool_or, "most": F.max}[self.kind](part)

    def whole(self, total: Column) -> Column:
        return self.then(total)


def count(condition: Column | None = None) -> Measure:
    return Measure("count", condition)


def total(value: Column | str, then: Callable[[Column], Column] = lambda c: c) -> Measure:
    return Measure("sum", F.col(value) if isinstance(value, str) else value, then=then)


def total_if(condition: Column, value: Column, then: Callable[[Column], Column] = lambda c: c) -> Measure:
    return Measure("sum", F.when(condition, value).otherwise(F.lit(0.0)), then=then)


def any_of(condition: Column) -> Measure:
    return Measure("any", condition)


def most(name: str) -> Measure:
    """The greatest value of a column; where distinct values are counted beside it, the column should have few values in a group."""
    return Measure("most", F.col(name), name)


def distinct(condition: Column | None, name: str, blanks: bool = False) -> Measure:
    """Values of a column that are not missing (nor blank, unless asked for), once each, where the condition holds."""
    there = F.col(name).isNotNull() if blanks else F.col(name).isNotNull() & (F.trim(name) != "")
    return Measure("distinct", there if condition is None else F.coalesce(condition, F.lit(False)) & there, name)


def aggregate(rows: DataFrame, keys: dict[str, Column], wanted: dict[str, Measure], counts: Column | None = None) -> DataFrame:
    """``rows`` grouped by named keys, one column a measure.

    Without distinct counts, or with one and no greatest value, this is one grouping.  Else each row becomes a base row, which
    counts and sums, and a row for each column of distinct values under one of whose conditions it
    falls.  A first grouping by key and value leaves each value once, with one flag a condition; a
    second one counts flags and adds up base rows.  Greatest values, whose buffers no hash aggregate
    holds, are keys of the base rows in the first grouping and are compared among few in the second;
    where there are none, base rows also carry the first column's value.  Of rows where ``counts`` does
    not hold only distinct values are taken; a group of such rows alone has zero counts or is left out.
    """
    values: dict[str, list[str]] = {}
    for n, m in wanted.items():
        if m.kind == "distinct":
            values.setdefault(m.name, []).append(n)
    by = [c.alias(n) for n, c in keys.items()]
    labels = [n for n, m in wanted.items() if m.kind == "most"]
    plain = [n for n, m in wanted.items() if m.kind in ("count", "sum", "any")]
    if not values or sum(map(len, values.values())) == 1 and not labels:
        return rows.groupBy(*by).agg(*[(m.column if m.kind == "distinct" else m.whole(m.part(counts))).alias(n) for n, m in wanted.items()])
    width = max(map(len, values.values()))

    def row(kind: int, value: Column, flags: list[Column]) -> Column:
        flags = flags + [F.lit(False)] * (width - len(flags))
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), *[f.alias(f"f{i}") for i, f in enumerate(flags)])

    kinds = [(F.col(name).cast("string"), [wanted[n].value for n in those]) for name, those in values.items()]
    if labels or counts is not None:
        kinds.insert(0, (F.lit(None).cast("string"), []))
    made = [row(0, *kinds[0]) if counts is None else F.when(counts, row(0, *kinds[0]))]
    made += [F.when(reduce(Column.__or__, flags), row(kind, value, flags)) for kind, (value, flags) in enumerate(kinds) if kind]
    is_base = F.col("__row.kind") == 0
    each = rows.withColumn("__row", F.explode(F.array(*made))).filter("__row IS NOT NULL")
    first = each.groupBy(
        *by, *[F.when(is_base, wanted[n].value).alias(f"__most_{n}") for n in labels], F.col("__row.kind").alias("__kind"), F.col("__row.value").alias("__value")
    ).agg(*[wanted[n].part(is_base).alias(f"__part_{n}") for n in plain], *[F.bool_or(f"__row.f{i}").alias(f"__f{i}") for i in range(width)])

    def second(n: str, m: Measure) -> Column:
        if m.kind == "distinct":
            kind = list(values).index(m.name) + len(kinds) - len(values)
            return F.count_if((F.col("__kind") == kind) & F.col(f"__f{values[m.name].index(n)}"))
        return m.whole(m.of_parts(F.col(f"__most_{n}" if m.kind == "most" else f"__part_{n}")))

    return first.groupBy(*keys).agg(*[second(n, m).alias(n) for n, m in wanted.items()])
