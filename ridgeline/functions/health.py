"""The health score of a partner or region: five dimensions, one hundred points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.expressions import half_up, ratio0, score_high, score_low

C = F.col


def scored(df: DataFrame, days: Column | int = 1) -> DataFrame:
    """``df`` with the score's dimensions, total, band and issues.

    Reads total_orders, valid_orders, completed_orders, cancelled_orders,
    valid_cancel_orders, active_riders, active_merchants, new_merchant_orders,
    received and profit.  Where no valid cancellation is known, those are valid less completed.
    """
    days = F.lit(days) if isinstance(days, int) else days
    done = C("completed_orders")
    valid_cancel = F.when(F.coalesce("valid_cancel_orders", F.lit(0)) > 0, C("valid_cancel_orders")).otherwise(F.greatest(C("valid_orders") - done, F.lit(0)))
    off, valid_off = ratio0(C("cancelled_orders"), C("total_orders")), ratio0(valid_cancel, C("valid_orders"))
    per_rider, complete = ratio0(done, C("active_riders")), ratio0(done, C("total_orders"))
    parts = {
        "scale_growth": score_high(ratio0(C("total_orders"), F.greatest(days, F.lit(1))), 10, 100, 20),
        "fulfillment_quality": score_high(complete, 0.60, 0.90, 10) + score_low(off, 0.08, 0.30, 10) + score_low(valid_off, 0.03, 0.15, 5),
        "capacity_health": score_high(per_rider, 0.8, 3.5, 12) + score_high(C("active_riders").cast("double"), 3, 30, 8),
        "merchant_operation": score_high(C("active_merchants").cast("double"), 5, 50, 10) + score_high(ratio0(C("new_merchant_orders"), done), 0.02, 0.10, 5),
        "revenue_quality": score_high(ratio0(C("received"), done), 3, 12, 8) + score_high(ratio0(C("profit"), done), 0.2, 2.0, 12),
    }
    found = F.array(
        F.when(off >= 0.20, "取消率偏高"), F.when(valid_off >= 0.08, "有效取消偏高"), F.when(per_rider < 1.2, "人效偏低"), F.when(C("profit") < 0, "合伙人利润为负")
    )
    out = df.withColumns({n: half_up(c, 2) for n, c in parts.items()})
    total = half_up(sum((C(n) for n in parts), F.lit(0.0)), 1)
    out = out.withColumns({"health_score": total, "issues": F.slice(F.array_compact(found), 1, 3)})
    band = F.when(C("health_score") >= 80, "green").when(C("health_score") >= 60, "yellow").otherwise("red")
    label = F.when(C("health_score") >= 80, "健康").when(C("health_score") >= 60, "关注").otherwise("风险")
    issues = F.when(F.size("issues") == 0, F.lit("经营整体稳定")).otherwise(F.array_join("issues", "；"))
    return out.withColumns({"health_band": band, "health_label": label, "issues": issues})
