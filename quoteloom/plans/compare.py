"""Queries on comparison: gaps, arbitrage, their read model, and stake plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stakes
from ..functions.odds import implied_probability, profit_band
from ..operators import analyze
from ..sources import domain
from ..sources.domain import BOOKMAKERS_SQL, LEAGUES_SQL, MATCHES_SQL, ODDS_SQL

_PLAYER = "a.match_id = b.match_id and a.market = b.market and a.player_name is not distinct from b.player_name"
_SIDES = ODDS_SQL + """,
o as (select *, case market_type when 'player_points_milestones' then 'player_points' else market_type end as market from odds)"""
GAPS = _SIDES + f""",
gaps as (
  select a.match_id, a.market as market_type, a.player_name, a.bookmaker_id as bookmaker_a_id, b.bookmaker_id as bookmaker_b_id,
         a.threshold as threshold_a, b.threshold as threshold_b, a.over_odds as odds_a, b.under_odds as odds_b, round(b.threshold - a.threshold, 1) as gap,
         case when a.over_odds > 0 and b.under_odds > 0 then round(1.0 / (1 / a.over_odds + 1 / b.under_odds) - 1, 4) end as profit_margin,
         case when a.over_odds > 0 and b.under_odds > 0 then round(2.0 / (1 / a.over_odds + 1 / b.under_odds) - 1, 4) end as middle_profit_margin
  from o a join o b on {_PLAYER} and a.bookmaker_id <> b.bookmaker_id and a.threshold < b.threshold
  where a.over_odds is not null and b.under_odds is not null)"""
ARBS = f""",
pairs as (
  select a.match_id, a.market as market_type, a.player_name, a.bookmaker_id as ba, b.bookmaker_id as bb, a.threshold, a.over_odds as oa, a.under_odds as ua, b.over_odds as ob, b.under_odds as ub,
         case when a.over_odds > 0 and b.under_odds > 0 then round(1.0 / (1 / a.over_odds + 1 / b.under_odds) - 1, 4) end as forth,
         case when b.over_odds > 0 and a.under_odds > 0 then round(1.0 / (1 / b.over_odds + 1 / a.under_odds) - 1, 4) end as back
  from o a join o b on {_PLAYER} and a.threshold = b.threshold and a.bookmaker_id <> b.bookmaker_id and a.seq < b.seq
  where a.over_odds <> 0 and b.over_odds <> 0 and abs(a.over_odds - b.over_odds) >= 0.05),
arbs as (
  select match_id, market_type, player_name, case when t then bb else ba end as bookmaker_a_id, case when t then ba else bb end as bookmaker_b_id,
         threshold as threshold_a, threshold as threshold_b, case when t then ob else oa end as odds_a, case when t then ua else ub end as odds_b,
         0.0::double as gap, case when t then back else forth end as profit_margin, null::double as middle_profit_margin
  from (select *, back > 0 and back > coalesce(forth, 0) as t from pairs) where t or forth > 0),
found as (select * from gaps union all select * from arbs)"""
_COLS = ", ".join(analyze.COLUMNS)


def _found(spark: SparkSession, sf_dir: str, min_gap: float = 0.0) -> DataFrame:
    return analyze.find_discrepancies(domain.odds(spark, sf_dir), min_gap)


def gap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.gap_join(domain.odds(spark, sf_dir))


def arb_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.arbitrage_join(domain.odds(spark, sf_dir))


def find_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def gap_min_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 5.0).where("gap > 0").groupBy("match_id", "market_type").agg(F.count("*").alias("n"), F.max("gap").alias("widest"), F.max("profit_margin").alias("best_margin"))


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07: discrepancies with match, league and both sources; the small sides are joined by what Catalyst finds best."""
    d = _found(spark, sf_dir)
    m, lg, b = domain.matches(spark, sf_dir), domain.leagues(spark, sf_dir), domain.bookmakers(spark, sf_dir).select("id", "name")
    return (
        d.join(m.withColumnsRenamed({"id": "m_id"}), d["match_id"] == F.col("m_id"), "left")
        .join(lg.select(F.col("id").alias("l_id"), F.col("name").alias("league_name")), F.col("league_id") == F.col("l_id"), "left")
        .join(b.select(F.col("id").alias("a_id"), F.col("name").alias("bookmaker_a_name")), F.col("bookmaker_a_id") == F.col("a_id"), "left")
        .join(b.select(F.col("id").alias("b_id"), F.col("name").alias("bookmaker_b_name")), F.col("bookmaker_b_id") == F.col("b_id"), "left")
        .select(*analyze.COLUMNS, "league_id", "league_name", "home_team", "away_team", "start_time", "bookmaker_a_name", "bookmaker_b_name")
    )


DETAIL = GAPS + ARBS + "," + MATCHES_SQL + "," + LEAGUES_SQL + "," + BOOKMAKERS_SQL + """,
detail as (
  select f.*, m.league_id, l.name as league_name, m.home_team, m.away_team, m.start_time, ba.name as bookmaker_a_name, bb.name as bookmaker_b_name
  from found f left join matches m on f.match_id = m.id left join leagues l on m.league_id = l.id
       left join bookmakers ba on f.bookmaker_a_id = ba.id left join bookmakers bb on f.bookmaker_b_id = bb.id)"""

SORT_COLUMNS = ("profit_margin", "middle_profit_margin", "gap", "match_id", "market_type", "player_name")


def sorted_page(df: DataFrame, sort_by: str = "profit_margin", descending: bool = True, limit: int = 50, offset: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """H-06: one page by an allow-listed column; an unknown one means profit margin."""
    key = F.col(sort_by if sort_by in SORT_COLUMNS else "profit_margin")
    order = [key.desc_nulls_last() if descending else key.asc_nulls_first(), *(F.col(t).asc_nulls_first() for t in ties)]
    return df.orderBy(*order).offset(offset).limit(limit)


def filter_discrepancies(df: DataFrame, bookmakers: list[str] | None = None, market: str | None = None, league: str | None = None, min_gap: float | None = None) -> DataFrame:
    """D-03: the optional conditions of the read API, joined by 'and'."""
    if bookmakers:
        df = df.where(F.col("bookmaker_a_id").isin(bookmakers) | F.col("bookmaker_b_id").isin(bookmakers))
    if market:
        df = df.where(F.col("market_type") == market)
    if league:
        df = df.where(F.col("league_id") == league)
    return df if min_gap is None else df.where(F.col("gap") >= min_gap)


_TIES = ("match_id", "market_type", "player_name", "bookmaker_a_id", "bookmaker_b_id", "threshold_a", "threshold_b", "odds_a", "odds_b")


def top_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_page(_detail(spark, sf_dir), "profit_margin", True, 50, 10, _TIES).select(*_TIES, "profit_margin", "league_name")


def discrepancy_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir).where("match_id = 'm42'")


def discrepancy_by_bookmaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filter_discrepancies(_detail(spark, sf_dir), ["b1", "b5"], min_gap=20.0)
    return d.groupBy("bookmaker_a_name", "bookmaker_b_name").agg(F.count("*").alias("n"), F.round(F.sum("gap"), 1).alias("total_gap"))


def discrepancy_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filter_discrepancies(_detail(spark, sf_dir), market="player_points", league="l3")
    return d.groupBy("league_name", "market_type").agg(F.count("*").alias("n"), F.max("profit_margin").alias("best"))


def profit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _found(spark, sf_dir)
    return d.withColumn("band", profit_band(F.col("profit_margin"))).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg(implied_probability(F.col("odds_a"))), 6).alias("mean_implied"))


def notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.notifications(_found(spark, sf_dir), 45.0).select("type", "title", "message", "is_read")


def group_league_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-19: league -> match -> number of discrepancies, as nested groups written out."""
    per_match = _detail(spark, sf_dir).groupBy("league_name", "match_id").agg(F.count("*").alias("n"))
    entry = F.concat_ws(":", "match_id", "n")
    return per_match.groupBy("league_name").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("matches"), F.sum("n").alias("n"))


def _stakes(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _found(spark, sf_dir).where("odds_a > 0 and odds_b > 0 and profit_margin is not null")
        planned = d.withColumn("plan", stakes.stake_plan(mode, F.lit(20.0))).where(F.col("plan").isNotNull())
        p = F.col("plan")
        return planned.select("match_id", "bookmaker_a_id", "bookmaker_b_id", "threshold_a", "threshold_b", "odds_a", "odds_b", *(F.round(p[c], 3).alias(c) for c in ("stake_a", "stake_b", "profit_a", "profit_b", "worst_case", "middle_profit")), F.array_join(p["labels"], "|").alias("labels"))

    return query


def stake_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _found(spark, sf_dir).where("profit_margin is not null")
    return d.groupBy(F.array_join(stakes.available_modes(), ",").alias("modes")).agg(F.count("*").alias("n"))


def _stake_sql(mode: str, sa: str, sb: str, where: str, label: str) -> str:
    return f"""with {GAPS}{ARBS},
d as (select *, gap > 0 and middle_profit_margin is not null as mid, round(20.0 * (odds_b / (odds_a + odds_b)), 4) as a, round(20.0 - 20.0 * (odds_b / (odds_a + odds_b)), 4) as b
      from found where odds_a > 0 and odds_b > 0 and profit_margin is not null),
s as (select *, round({sa}, 4) as stake_a, round({sb}, 4) as stake_b, {sa} as ra, {sb} as rb from d where {where}),
p as (select *, round(ra * odds_a - round(ra + rb, 4), 4) as profit_a, round(rb * odds_b - round(ra + rb, 4), 4) as profit_b, case when mid then round(ra * odds_a + rb * odds_b - round(ra + rb, 4), 4) end as middle_profit from s)
select match_id, bookmaker_a_id, bookmaker_b_id, threshold_a, threshold_b, odds_a, odds_b, round(stake_a, 3) as stake_a, round(stake_b, 3) as stake_b, round(profit_a, 3) as profit_a, round(profit_b, 3) as profit_b,
       round(least(profit_a, profit_b), 3) as worst_case, round(middle_profit, 3) as middle_profit,
       concat_ws('|', case when not mid then 'Same-threshold arb' end, {label}, case when least(profit_a, profit_b) < 0 then 'Not guaranteed' when mid and least(profit_a, profit_b) = 0 then 'Breakeven floor' end) as labels
from p"""


QUERIES = {
    "gap_join": gap_join,
    "arb_join": arb_join,
    "find_discrepancies": find_discrepancies,
    "gap_min_filter": gap_min_filter,
    "top_discrepancies": top_discrepancies,
    "discrepancy_detail": discrepancy_detail,
    "discrepancy_by_bookmaker": discrepancy_by_bookmaker,
    "discrepancy_by_market": discrepancy_by_market,
    "profit_bands": profit_bands,
    "notifications": notify,
    "group_league_match": group_league_match,
    "stake_balanced": _stakes("balanced"),
    "stake_aggressive": _stakes("aggressive-middle"),
    "stake_conservative": _stakes("conservative-rounded"),
    "stake_modes": stake_modes,
}

ORACLES = {
    "gap_join": f"with {GAPS} select {_COLS} from gaps",
    "arb_join": f"with {GAPS}{ARBS} select {_COLS} from arbs",
    "find_discrepancies": f"with {GAPS}{ARBS} select {_COLS} from found",
    "gap_min_filter": f"with {GAPS} select match_id, market_type, count(*) as n, max(gap) as widest, max(profit_margin) as best_margin from gaps where threshold_b - threshold_a >= 5.0 group by all",
    "top_discrepancies": f"""with {DETAIL} select {', '.join(_TIES)}, profit_margin, league_name from detail
order by profit_margin desc nulls last, {', '.join(t + ' asc nulls first' for t in _TIES)} limit 50 offset 10""",
    "discrepancy_detail": f"with {DETAIL} select * from detail where match_id = 'm42'",
    "discrepancy_by_bookmaker": f"""with {DETAIL} select bookmaker_a_name, bookmaker_b_name, count(*) as n, round(sum(gap), 1) as total_gap from detail
where (bookmaker_a_id in ('b1', 'b5') or bookmaker_b_id in ('b1', 'b5')) and gap >= 20.0 group by all""",
    "discrepancy_by_market": f"with {DETAIL} select league_name, market_type, count(*) as n, max(profit_margin) as best from detail where market_type = 'player_points' and league_id = 'l3' group by all",
    "profit_bands": f"""with {GAPS}{ARBS} select case when profit_margin >= 0.03 then 'high' when profit_margin >= 0.015 then 'medium' else 'low' end as band, count(*) as n,
round(avg(case when odds_a <= 0 then 0 else 1 / odds_a end), 6) as mean_implied from found group by 1""",
    "notifications": f"""with {GAPS} select 'discrepancy' as type, printf('%s: %.1f gap', coalesce(player_name, match_id), gap) as title,
printf('over %.1f at %s, under %.1f at %s', threshold_a, bookmaker_a_id, threshold_b, bookmaker_b_id) as message, false as is_read from gaps where gap >= 45.0""",
    "group_league_match": f"""with {DETAIL}, g as (select league_name, match_id, count(*) as n from detail group by all)
select league_name, string_agg(match_id || ':' || n, ',' order by match_id || ':' || n) as matches, sum(n)::bigint as n from g group by 1""",
    "stake_balanced": _stake_sql("balanced", "a", "b", "not mid or profit_margin >= 0", "null"),
    "stake_aggressive": _stake_sql(
        "aggressive-middle",
        "case when odds_a > odds_b + 1e-9 then least(greatest(a + 1.0, 0), 20) when odds_b > odds_a + 1e-9 then 20 - least(greatest(b + 1.0, 0), 20) else a end",
        "case when odds_a > odds_b + 1e-9 then 20 - least(greatest(a + 1.0, 0), 20) when odds_b > odds_a + 1e-9 then least(greatest(b + 1.0, 0), 20) else b end",
        "mid", "'Middle-focused'",
    ),
    "stake_modes": f"""with {GAPS}{ARBS} select case when not (gap > 0 and middle_profit_margin is not null) then 'balanced' when profit_margin >= 0 then 'balanced,aggressive-middle,conservative-rounded' else 'aggressive-middle' end as modes,
count(*) as n from found where profit_margin is not null group by 1""",
}
