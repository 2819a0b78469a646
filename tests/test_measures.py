import random

import pytest
from pyspark.sql import functions as F

from ridgeline import catalog
from ridgeline.functions.measures import aggregate, any_of, count, distinct, most, total, total_if

C = F.col
SCHEMA = "g string, rider string, shop string, label string, done boolean, new boolean, paid double, made boolean"


def table(spark, n=400, seed=3):
    """Rows with missing and blank ids, missing flags, labels that vary within a group, and repeats."""
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    rows = [
        (pick("a", "b", None), pick(None, "", " ", "r1", "r2", "r3"), pick(None, "s1", "s2"), pick(None, "x", "y"), pick(True, False, None), pick(True, False, None), pick(None, 0.5, 2.0), pick(True, False))
        for _ in range(n)
    ]
    rows.append(("only took", "r1", None, "x", True, True, 1.0, False))
    return rows, spark.createDataFrame(rows, SCHEMA)


def by_hand(rows, counted=lambda r: True, label=True):
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        base = [r for r in own if counted(r)]
        paid = [r[6] for r in base if r[6] is not None]
        out[g] = {
            "n": len(base), "finished": sum(r[4] is True for r in base), "paid_all": sum(paid) if paid else None,
            "paid_done": sum(r[6] or 0.0 for r in base if r[4]) if base else None, "riders": len({r[1] for r in own if r[4] and (r[1] or "").strip()}),
            "new_riders": len({r[1] for r in own if r[4] and r[5] and (r[1] or "").strip()}), "blank_too": len({r[1] for r in own if r[1] is not None}), "shops": len({r[2] for r in own if r[2]}),
        }
        new = [r[5] for r in base if r[5] is not None]
        out[g] |= {"any_new": any(new) if new else None}
        if label:
            out[g] |= {"label": max((r[3] for r in base if r[3] is not None), default=None)}
    return out


def wanted(label=True):
    out = {
        "n": count(), "finished": count(C("done")), "paid_all": total("paid"), "paid_done": total_if(C("done"), F.coalesce("paid", F.lit(0.0))),
        "riders": distinct(C("done"), "rider"), "new_riders": distinct(C("done") & C("new"), "rider"), "blank_too": distinct(None, "rider", blanks=True),
        "shops": distinct(None, "shop"), "any_new": any_of(C("new")),
    }
    return out | {"label": most("label")} if label else out


@pytest.mark.parametrize("label", [True, False])
@pytest.mark.parametrize("some", [True, False])
def test_measures_by_hand(spark, label, some):
    rows, df = table(spark)
    got = aggregate(df, {"g": C("g")}, wanted(label), C("made") if some else None)
    want = by_hand(rows, (lambda r: r[7]) if some else (lambda r: True), label)
    assert {r.g: {k: v for k, v in r.asDict().items() if k != "g"} for r in got.collect()} == want


def test_measures_by_themselves_agree_with_those_of_parts(spark):
    _, df = table(spark, 200, 9)
    alone = df.groupBy("g").agg(*[m.column.alias(n) for n, m in wanted().items()])
    assert sorted(map(repr, alone.collect())) == sorted(map(repr, aggregate(df, {"g": C("g")}, wanted()).collect()))


def test_an_empty_table_has_no_groups(spark):
    assert aggregate(spark.createDataFrame([], SCHEMA), {"g": C("g")}, wanted()).count() == 0


@pytest.mark.parametrize("name, sorts", [("q1_admin_day", 0), ("b5_nation_day", 0), ("q3_partner_day", 2), ("q9_direct_hour", 2), ("b7_partner_hour", 2)])
def test_distinct_counts_neither_expand_nor_sort_orders(spark, sf_dir, name, sorts):
    """Values are told apart by hash aggregates; only tables with names compare these, by sorting the second grouping."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("SortAggregate") <= sorts, plan
