"""Query windows and the periods that a comparison sets side by side."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Window = tuple[date | None, date | None]


def check_window(start: date | None, end: date | None, most_days: int = 31) -> None:
    """ValueError for a window that ends before it starts or has more than ``most_days`` days; an open one passes."""
    if start is None or end is None:
        return
    if start > end:
        raise ValueError("the window ends before it starts")
    if (end - start).days + 1 > most_days:
        raise ValueError(f"the window has more than {most_days} days")


def periods(start: date | None, end: date | None, baseline: Window = (None, None), compare: Window = (None, None)) -> tuple[Window, Window]:
    """Baseline and current window: as given, or else the equally long one just before the current."""
    current = (compare[0] or start, compare[1] or end) if any(compare) else (start, end)
    if any(baseline) or not all(current):
        return baseline, current
    span = max((current[1] - current[0]).days, 0)
    last = current[0] - timedelta(days=1)
    return (last - timedelta(days=span), last), current


def within(column: Column, window: Window) -> Column:
    """Whether a date lies in a window, both ends included; an open end holds nothing off."""
    out = F.lit(True)
    if window[0]:
        out = out & (column >= F.lit(window[0]))
    if window[1]:
        out = out & (column <= F.lit(window[1]))
    return out


def period_of(column: Column, baseline: Window, current: Window) -> Column:
    """``baseline``, ``current`` or missing; a date in both counts as baseline."""
    return F.when(within(column, baseline), "baseline").when(within(column, current), "current")


def day_count(start: date | None, end: date | None, dates: int | None = None) -> int:
    """Days of a closed window, or else the number of dates seen, or 1."""
    if start and end:
        return max((end - start).days + 1, 1)
    return max(dates or 1, 1)
