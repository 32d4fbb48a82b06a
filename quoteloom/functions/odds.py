"""Arithmetic of quoted prices, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comparison_market(market: Column) -> Column:
    """C-06: milestone lines are compared with the points lines."""
    return F.when(market == "player_points_milestones", F.lit("player_points")).otherwise(market)


def implied_probability(price: Column) -> Column:
    """C-09: 1 / price, 0 where the price is not above 0."""
    return F.when(price <= 0, F.lit(0.0)).otherwise(1 / price)


def _balanced_return(a: Column, b: Column, units: float) -> Column:
    usable = (a > 0) & (b > 0)
    return F.when(usable, F.round(units / (1 / F.when(usable, a) + 1 / F.when(usable, b)) - 1, 4))


def profit_margin(a: Column, b: Column) -> Column:
    """C-10: return of balanced stakes when exactly one side wins; null without two prices above 0."""
    return _balanced_return(a, b, 1.0)


def middle_profit_margin(a: Column, b: Column) -> Column:
    """C-11: return of the same stakes when both sides win."""
    return _balanced_return(a, b, 2.0)


def match_id(sport: Column, start_time: Column, home_id: Column, away_id: Column) -> Column:
    """C-12: the first 12 hex digits of the MD5 of the event's key."""
    return F.substring(F.md5(F.concat_ws(":", sport, start_time, home_id.cast("string"), away_id.cast("string"))), 1, 12)


def failure_rate(failed: Column, attempted: Column) -> Column:
    """C-29."""
    return F.round(F.coalesce(F.try_divide(failed, attempted), F.lit(0.0)), 4)


def profit_band(margin: Column) -> Column:
    """C-34."""
    return F.when(margin >= 0.03, F.lit("high")).when(margin >= 0.015, F.lit("medium")).otherwise(F.lit("low"))


def lookback_start(latest: Column, interval_minutes: int, least: int = 15) -> Column:
    """C-30: the ISO text of ``max(interval, least)`` minutes before an ISO time."""
    before = F.to_timestamp(latest) - F.expr(f"INTERVAL {max(interval_minutes, least)} MINUTE")
    return F.date_format(before, "yyyy-MM-dd'T'HH:mm:ss")
