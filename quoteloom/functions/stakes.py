"""Stake plans of a discrepancy, as column expressions.

A discrepancy is seen through ``odds_a, odds_b, gap, profit_margin,
middle_profit_margin``; a plan is a struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
SHIFT = 0.05
STEP = 0.1
MODES = ("balanced", "aggressive-middle", "conservative-rounded")


def settle(x: Column) -> Column:
    """C-35: four decimals, nothing under the epsilon.

    What is under it rounds to zero anyway; adding zero clears the sign.  The
    argument is named once, so plans don't double with every step.
    """
    return F.round(x, 4) + F.lit(0.0)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def has_middle() -> Column:
    return (F.col("gap") > 0) & F.col("middle_profit_margin").isNotNull()


def available_modes() -> Column:
    """C-38."""
    every, first, middle = (F.array(*map(F.lit, m)) for m in (MODES, MODES[:1], MODES[1:2]))
    return F.when(~has_middle(), first).when(F.col("profit_margin") >= 0, every).otherwise(middle)


def balanced_stakes(units: Column) -> tuple[Column, Column]:
    """C-36."""
    a = units * (F.col("odds_b") / (F.col("odds_a") + F.col("odds_b")))
    return settle(a), settle(units - a)


def plan(mode: str, stake_a: Column, stake_b: Column) -> Column:
    """C-37: profits, floor and labels of two stakes."""
    total = settle(stake_a + stake_b)
    won_a, won_b = settle(stake_a * F.col("odds_a") - total), settle(stake_b * F.col("odds_b") - total)
    worst = settle(F.least(won_a, won_b))
    middle = F.when(has_middle(), settle(stake_a * F.col("odds_a") + stake_b * F.col("odds_b") - total))
    labels = F.array_compact(F.array(
        F.when(~has_middle(), F.lit("Same-threshold arb")),
        F.lit({"aggressive-middle": "Middle-focused", "conservative-rounded": "Rounded to 0.1u"}.get(mode)).cast("string"),
        F.when(worst < 0, F.lit("Not guaranteed")).when(has_middle() & (worst == 0), F.lit("Breakeven floor")),
    ))
    return F.struct(
        settle(stake_a).alias("stake_a"), settle(stake_b).alias("stake_b"), total.alias("total_stake"), won_a.alias("profit_a"), won_b.alias("profit_b"),
        worst.alias("worst_case"), middle.alias("middle_profit"), (worst >= 0).alias("guaranteed"), labels.alias("labels"),
    )


def stake_plan(mode: str, units: Column) -> Column:
    """C-39: the plan of one mode; null if the mode isn't available or there are no units."""
    a, b = balanced_stakes(units)
    if mode == "balanced":
        out = plan(mode, a, b)
    elif mode == "aggressive-middle":
        shift = settle(units * SHIFT)
        up_a, up_b = clamp(a + shift, 0.0, units), clamp(b + shift, 0.0, units)
        longer_a, longer_b = F.col("odds_a") > F.col("odds_b") + EPSILON, F.col("odds_b") > F.col("odds_a") + EPSILON
        stake_a = F.when(longer_a, up_a).when(longer_b, units - up_b).otherwise(a)
        stake_b = F.when(longer_a, units - up_a).when(longer_b, up_b).otherwise(b)
        out = plan(mode, stake_a, stake_b)
    else:
        # lambda variables keep each step's value from being written out again in every later expression
        base = F.array(F.struct(a.alias("a"), units.alias("u")))
        tried = F.flatten(F.transform(base, lambda x: F.transform(
            F.array(F.floor(x["a"] / STEP + 0.5) * STEP, F.floor(x["a"] / STEP) * STEP, F.ceil(x["a"] / STEP) * STEP),
            lambda s, i: F.struct(settle(clamp(s, 0.0, x["u"])).alias("s"), x["a"].alias("a"), x["u"].alias("u"), i.alias("i")),
        )))
        paired = F.transform(tried, lambda x: F.struct(x["s"], settle(x["u"] - x["s"]).alias("t"), x["a"], x["i"]))
        planned = F.transform(paired, lambda x: F.struct(plan(mode, x["s"], x["t"]).alias("plan"), F.abs(x["s"] - x["a"]).alias("off"), x["i"]))
        best = F.array_min(F.transform(planned, lambda x: F.struct((-x["plan"]["worst_case"]).alias("o1"), x["off"].alias("o2"), x["i"].alias("o3"))))
        out = F.element_at(planned, best["o3"] + 1)["plan"]
    return F.when((units > 0) & F.array_contains(available_modes(), mode), out)


def stake_units(x: Column, default: float = 20.0) -> Column:
    """C-40: at least 0.1, one decimal."""
    return F.greatest(F.lit(0.1), F.round(F.coalesce(x, F.lit(default)), 1))
