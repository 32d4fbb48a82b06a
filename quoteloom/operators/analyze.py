"""Cross-source comparison: threshold gaps and equal-threshold arbitrage.

Both are self-joins on the comparison group (match, comparison market, player),
null-safe in the player, with the theta conditions as residual predicates of an
equi-join: Catalyst plans a hash or sort-merge join on the group, which
adaptive execution splits where a group is hot.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.odds import comparison_market, middle_profit_margin, profit_margin

COLUMNS = ("match_id", "market_type", "player_name", "bookmaker_a_id", "bookmaker_b_id", "threshold_a", "threshold_b", "odds_a", "odds_b", "gap", "profit_margin", "middle_profit_margin")


def _sides(odds: DataFrame) -> tuple[DataFrame, DataFrame]:
    slim = odds.select("match_id", comparison_market(F.col("market_type")).alias("market_type"), "player_name", "bookmaker_id", "threshold", "over_odds", "under_odds", "seq")
    return slim.alias("a"), slim.alias("b")


def _same_group() -> Column:
    return (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.market_type") == F.col("b.market_type")) & F.col("a.player_name").eqNullSafe(F.col("b.player_name"))


def gap_join(odds: DataFrame, min_gap: float = 0.0) -> DataFrame:
    """J-01: over at a lower line of one source with under at a higher line of another."""
    a, b = _sides(odds)
    a, b = a.where(F.col("a.over_odds").isNotNull()), b.where(F.col("b.under_odds").isNotNull())
    gap = F.col("b.threshold") - F.col("a.threshold")
    on = _same_group() & (F.col("a.bookmaker_id") != F.col("b.bookmaker_id")) & (gap > 0) & (gap >= min_gap)
    return a.join(b, on).select(*_gap_row(gap))


def _gap_row(gap: Column) -> list[Column]:
    a, b = F.col("a.over_odds"), F.col("b.under_odds")
    return [
        F.col("a.match_id"), F.col("a.market_type"), F.col("a.player_name"), F.col("a.bookmaker_id").alias("bookmaker_a_id"), F.col("b.bookmaker_id").alias("bookmaker_b_id"), F.col("a.threshold").alias("threshold_a"),
        F.col("b.threshold").alias("threshold_b"), a.alias("odds_a"), b.alias("odds_b"), F.round(gap, 1).alias("gap"), profit_margin(a, b).alias("profit_margin"), middle_profit_margin(a, b).alias("middle_profit_margin"),
    ]


def arbitrage_join(odds: DataFrame) -> DataFrame:
    """J-02: two sources at one line whose over prices differ by 0.05 or more; the better profitable crossing, the earlier row's over on ties."""
    a, b = _sides(odds)
    a, b = a.where("a.over_odds <> 0"), b.where("b.over_odds <> 0")
    on = _same_group() & (F.col("a.threshold") == F.col("b.threshold")) & (F.col("a.bookmaker_id") != F.col("b.bookmaker_id")) & (F.col("a.seq") < F.col("b.seq"))
    pairs = a.join(b, on & (F.abs(F.col("a.over_odds") - F.col("b.over_odds")) >= 0.05))
    forth, back = profit_margin(F.col("a.over_odds"), F.col("b.under_odds")), profit_margin(F.col("b.over_odds"), F.col("a.under_odds"))
    scored = pairs.withColumn("forth", forth).withColumn("back", back)
    turned = (F.col("back") > 0) & (F.coalesce(F.col("forth"), F.lit(0.0)) < F.col("back"))
    best = F.when(turned, F.col("back")).otherwise(F.col("forth"))
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return scored.where(F.coalesce(turned, F.lit(False)) | (F.col("forth") > 0)).select(
        "a.match_id", "a.market_type", "a.player_name", pick("a.bookmaker_id", "b.bookmaker_id").alias("bookmaker_a_id"), pick("b.bookmaker_id", "a.bookmaker_id").alias("bookmaker_b_id"),
        F.col("a.threshold").alias("threshold_a"), F.col("b.threshold").alias("threshold_b"), pick("a.over_odds", "b.over_odds").alias("odds_a"),
        pick("b.under_odds", "a.under_odds").alias("odds_b"), F.lit(0.0).alias("gap"), F.when(turned, F.col("back")).otherwise(best).alias("profit_margin"), F.lit(None).cast("double").alias("middle_profit_margin"),
    )


def find_discrepancies(odds: DataFrame, min_gap: float = 0.0) -> DataFrame:
    """All gaps and arbitrages.  ``odds`` needs a ``seq`` that orders a group's rows."""
    return gap_join(odds, min_gap).unionByName(arbitrage_join(odds))


def counted_discrepancies(odds: DataFrame, min_gap: float = 0.0) -> DataFrame:
    """The rows of ``find_discrepancies``, each once, with ``n_pairs``: how many pairs of quotes give it.

    Quotes of one source with one line and the same prices are copies.  Only
    different ones meet, so the pairs do not grow with the square of the copies.
    Prices and lines of a row name its copies among the quotes.
    """
    return _counted_gaps(odds, min_gap).unionByName(_counted_arbitrage(odds))


def _copies(odds: DataFrame, *prices: str) -> DataFrame:
    quotes, _ = _sides(odds)
    return quotes.groupBy("match_id", "market_type", "player_name", "bookmaker_id", "threshold", *prices).agg(F.count("*").alias("n"))


def _counted_gaps(odds: DataFrame, min_gap: float) -> DataFrame:
    a, b = _copies(odds.where("over_odds is not null"), "over_odds").alias("a"), _copies(odds.where("under_odds is not null"), "under_odds").alias("b")
    gap = F.col("b.threshold") - F.col("a.threshold")
    on = _same_group() & (F.col("a.bookmaker_id") != F.col("b.bookmaker_id")) & (gap > 0) & (gap >= min_gap)
    return a.join(b, on).select(*_gap_row(gap), (F.col("a.n") * F.col("b.n")).alias("n_pairs"))


def _counted_arbitrage(odds: DataFrame) -> DataFrame:
    """A pair's row hangs on which quote is the earlier only where both crossings earn the same; there the quotes' order is counted."""
    slim = odds.where("over_odds <> 0")
    a, b = _copies(slim, "over_odds", "under_odds").alias("a"), _copies(slim, "over_odds", "under_odds").alias("b")
    on = _same_group() & (F.col("a.threshold") == F.col("b.threshold")) & (F.col("a.bookmaker_id") != F.col("b.bookmaker_id")) & (F.abs(F.col("a.over_odds") - F.col("b.over_odds")) >= 0.05)
    forth, back = profit_margin(F.col("a.over_odds"), F.col("b.under_odds")), profit_margin(F.col("b.over_odds"), F.col("a.under_odds"))
    met = a.join(b, on).withColumn("forth", forth).withColumn("back", F.coalesce(back, F.lit(0.0)))  # every two kinds meet both ways, so only over at a counts
    row = (
        "a.match_id", "a.market_type", "a.player_name", F.col("a.bookmaker_id").alias("bookmaker_a_id"), F.col("b.bookmaker_id").alias("bookmaker_b_id"), F.col("a.threshold").alias("threshold_a"), F.col("b.threshold").alias("threshold_b"),
        F.col("a.over_odds").alias("odds_a"), F.col("b.under_odds").alias("odds_b"), F.lit(0.0).alias("gap"), F.col("forth").alias("profit_margin"), F.lit(None).cast("double").alias("middle_profit_margin"),
    )
    better = met.where((F.col("forth") > 0) & (F.col("back") < F.col("forth"))).select(*row, (F.col("a.n") * F.col("b.n")).alias("n_pairs"))
    tied = met.where((F.col("forth") > 0) & (F.col("back") == F.col("forth"))).select(*row, F.col("b.over_odds").alias("over_b"), F.col("a.under_odds").alias("under_a"))
    # the quotes of both kinds in their order; a quote at b counts the quotes at a before it
    quotes, _ = _sides(slim)
    side = lambda me, over, under: (
        tied.alias("t").join(quotes.alias("q"), (F.col("t.match_id") == F.col("q.match_id")) & (F.col("t.market_type") == F.col("q.market_type")) & F.col("t.player_name").eqNullSafe(F.col("q.player_name")) & (F.col(f"t.bookmaker_{me}_id") == F.col("q.bookmaker_id")) & (F.col("t.threshold_a") == F.col("q.threshold")) & (F.col(f"t.{over}") == F.col("q.over_odds")) & (F.col(f"t.{under}") == F.col("q.under_odds")))
        .select("t.*", F.col("q.seq").alias("seq"), F.lit(int(me == "a")).alias("at_a"))
    )
    order = W.partitionBy(*tied.columns).orderBy("seq", "at_a").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = side("a", "odds_a", "under_a").unionByName(side("b", "over_b", "odds_b")).withColumn("before", F.sum("at_a").over(order))
    counted = placed.where("at_a = 0").groupBy(*COLUMNS, "over_b", "under_a").agg(F.sum("before").alias("n_pairs")).where("n_pairs > 0")
    # rows that differ only in the prices they do not show are one
    return better.unionByName(counted.drop("over_b", "under_a")).groupBy(*COLUMNS).agg(F.sum("n_pairs").alias("n_pairs"))


def notifications(discrepancies: DataFrame, threshold: float = 1.5) -> DataFrame:
    """D-12: a message for every gap of ``threshold`` or more; of counted discrepancies one for each row, with its count."""
    wide = discrepancies.where(F.col("gap") >= threshold)
    title = F.format_string("%s: %.1f gap", F.coalesce("player_name", "match_id"), "gap")
    message = F.format_string("over %.1f at %s, under %.1f at %s", "threshold_a", "bookmaker_a_id", "threshold_b", "bookmaker_b_id")
    data = F.to_json(F.struct("match_id", "market_type", "gap"))
    count = ["n_pairs"] if "n_pairs" in discrepancies.columns else []
    return wide.select(F.lit("discrepancy").alias("type"), title.alias("title"), message.alias("message"), F.lit(False).alias("is_read"), data.alias("data"), *count)
