"""How values are shown to a reader (C-32, C-33, C-41, C-42)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"


def odds_text(x: Column) -> Column:
    return F.when(x.isNull(), NONE).otherwise(F.format_string("%.2f", x))


def percent_text(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.1f", x * 100), F.lit("%"))


def gap_text(x: Column) -> Column:
    return F.format_string("%.1f", x)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _plain(x: Column) -> Column:
    """Up to two decimals, thousands grouped, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def units_text(x: Column) -> Column:
    return F.when(_finite(x), _plain(x)).otherwise(NONE)


def signed_units_text(x: Column) -> Column:
    shown = F.round(x, 2)
    return F.when(~_finite(x), NONE).when(shown == 0, "0").otherwise(F.concat(F.when(shown > 0, "+").otherwise("-"), _plain(F.abs(shown))))


def app_time(text: Column) -> Column:
    """A timestamp; text without a zone is UTC, what isn't a time is null."""
    t = F.trim(text)
    return F.try_to_timestamp(F.when(t.rlike(r"([zZ]|[+-]\d{2}:\d{2})$"), t).otherwise(F.concat(t, F.lit("Z"))))


def local_time_text(text: Column, zone: str = "Europe/Belgrade") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(app_time(text), F.current_timezone()), zone), "d MMM, HH:mm"), F.lit(NONE))


def relative_text(text: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(app_time(text))) / 60_000_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes.isNull(), "Never").when(minutes < 1, "Just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def confidence_rank(x: Column) -> Column:
    return F.when(x == "high", 3).when(x == "low", 1).otherwise(2)


def scan_percent(done: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(done, total), F.lit(0.0)) * 100).cast("int")
