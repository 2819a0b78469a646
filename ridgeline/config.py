"""Business parameters, passed to builders explicitly; there are no globals."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Tier:
    label: str
    low: float
    high: float | None = None  # None: no upper end

    def holds(self, value: float) -> bool:
        return value >= self.low and (self.high is None or value <= self.high)


# fixed values: default bands of partners (average orders a day) and riders (completed orders in the window)
PARTNER_TIERS = (Tier("0-9", 0, 9), Tier("10-49", 10, 49), Tier("50-99", 50, 99), Tier("100+", 100))
RIDER_TIERS = (Tier("1-9", 1, 9), Tier("10-29", 10, 29), Tier("30-49", 30, 49), Tier("50+", 50))


@dataclass(frozen=True)
class Swing:
    """When a partner's change is reported: size class from ``at_least`` baseline orders on."""

    name: str
    at_least: float
    orders: float
    share: float


# fixed values: swings by size class, largest first
SWINGS = (Swing("large", 500, 100, 0.20), Swing("medium", 200, 50, 0.25), Swing("small", 0, 30, 0.30))


@dataclass(frozen=True)
class Settings:
    cancel_minutes: float = 5  # a paid order cancelled later than this is a valid one
    new_rider_days: int = 30
    new_merchant_days: int = 30
    new_partner_days: int = 90
    online_from: int = 9
    online_to: int = 20
    excluded_partners: tuple[str, ...] = ("101",)  # may be empty
    on_time_minutes: float = 30
    sla_minutes: int = 30
    merchant_like_orders: int = 20
    rider_daily_target: int = 10
    rider_target_days: int = 10
    active_orders: int = 1
    partner_tiers: tuple[Tier, ...] = PARTNER_TIERS
    rider_tiers: tuple[Tier, ...] = RIDER_TIERS
    swings: tuple[Swing, ...] = SWINGS
    max_window_days: int = 31
    raw_root: str = "data/raw"
    table_root: str = "data/tables"
    export_root: str = "data/mart"
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def threshold(self, value: float | None) -> float:
        """A request's cancel threshold; 0 and None mean the default."""
        return value or self.cancel_minutes


def load(path: str | Path | None = None, **changes) -> Settings:
    """Settings from a JSON file whose keys are field names, with changes on top."""
    known = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    for key, kind in (("partner_tiers", Tier), ("rider_tiers", Tier), ("swings", Swing)):
        if key in known:
            known[key] = tuple(kind(**x) for x in known[key])
    if "excluded_partners" in known:
        known["excluded_partners"] = tuple(str(x) for x in known["excluded_partners"])
    names = set(Settings.__dataclass_fields__)
    return replace(Settings(**{k: v for k, v in known.items() if k in names}), **changes)


def tiers_from_json(text: str | None, default: tuple[Tier, ...]) -> tuple[Tier, ...]:
    """Tiers from a request's JSON list of {label, min, max}; entries that make no sense are skipped, none left: the default."""
    try:
        entries = json.loads(text) if text else []
    except ValueError:
        entries = []
    out = []
    for entry in entries if isinstance(entries, list) else []:
        try:
            low = float(entry["min"])
            high = None if entry.get("max") in (None, "") else float(entry["max"])
        except (TypeError, KeyError, ValueError, AttributeError):
            continue
        if low < 0 or (high is not None and high < low):
            continue
        default_label = f"{low:g}+" if high is None else f"{low:g}-{high:g}"
        out.append(Tier(str(entry.get("label") or default_label), low, high))
    return tuple(out) or default


def tiers_from_text(text: str) -> tuple[Tier, ...]:
    """Tiers from ``"1-9,10+"``; parts that are neither a range nor open are skipped."""
    out = []
    for part in (p.strip() for p in text.replace("，", ",").split(",")):
        low, dash, high = part.partition("-")
        try:
            if part.endswith("+"):
                out.append(Tier(part, float(part[:-1])))
            elif dash and float(low) <= float(high):
                out.append(Tier(part, float(low), float(high)))
        except ValueError:
            continue
    return tuple(out)
