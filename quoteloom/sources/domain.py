"""The driver's star schema read as the odds domain, so that every operator runs at any scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes: a part is a match, a supplier group a source, a line item a quote.  ``seq`` orders the quotes of different sources."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    flag = F.col("l_returnflag")
    market = F.when(flag == "A", "player_points").when(flag == "N", "player_points_milestones").otherwise("game_total_ot")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("match_id"), F.concat(F.lit("b"), (F.col("l_suppkey") % 8).cast("string")).alias("bookmaker_id"),
        market.alias("market_type"), F.when(flag != "R", F.col("p_name")).alias("player_name"), (F.col("l_quantity") + 0.5).alias("threshold"),
        (1.4 + F.col("l_discount") * 10).alias("over_odds"), F.when(flag != "N", 1.4 + F.col("l_tax") * 10).alias("under_odds"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_time"),
    )


ODDS_SQL = """
odds as (
  select 'm' || l_partkey as match_id, 'b' || (l_suppkey % 8) as bookmaker_id,
         case l_returnflag when 'A' then 'player_points' when 'N' then 'player_points_milestones' else 'game_total_ot' end as market_type,
         case when l_returnflag <> 'R' then p_name end as player_name, l_quantity + 0.5 as threshold,
         1.4 + l_discount * 10 as over_odds, case when l_returnflag <> 'N' then 1.4 + l_tax * 10 end as under_odds,
         (l_orderkey, l_linenumber, l_suppkey) as seq, strftime(l_shipdate, '%Y-%m-%d') as start_time
  from lineitem join part on l_partkey = p_partkey)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as they were seen hour by hour: an event is one sighting, stamped with ISO text."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string")).alias("match_id"), F.concat(F.lit("b"), (F.col("event_id") % 8).cast("string")).alias("bookmaker_id"),
        F.col("event_type").alias("market_type"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("player_name"),
        (F.col("user_id") % 5 + 0.5).cast("double").alias("threshold"), F.col("value").alias("over_odds"), (F.col("value") / 2).alias("under_odds"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:00:00").alias("scraped_at"), F.col("event_id").alias("seq"),
    )


SNAPSHOT_SQL = """
snap as (
  select 'm' || (user_id % 40) as match_id, 'b' || (event_id % 8) as bookmaker_id, event_type as market_type,
         case when user_id % 3 <> 0 then 'p' || user_id end as player_name, (user_id % 5 + 0.5)::double as threshold,
         value as over_odds, value / 2 as under_odds, strftime(ts, '%Y-%m-%dT%H:00:00') as scraped_at, event_id as seq
  from events)"""


def bookmakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per supplier group: name of its first supplier, active unless its number is 7."""
    s = table(spark, sf_dir, "supplier")
    g = s.groupBy((F.col("s_suppkey") % 8).alias("k")).agg(F.min_by("s_name", "s_suppkey").alias("name"))
    return g.select(F.concat(F.lit("b"), F.col("k").cast("string")).alias("id"), "name", (F.col("k") != 7).alias("is_active"))


BOOKMAKERS_SQL = """
bookmakers as (
  select 'b' || k as id, name, k <> 7 as is_active
  from (select s_suppkey % 8 as k, min_by(s_name, s_suppkey) as name from supplier group by 1))"""


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        F.concat(F.lit("l"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("country"),
        F.when(F.col("n_nationkey") % 2 == 0, "basketball").otherwise("football").alias("sport"), (F.col("n_nationkey") % 5 != 0).alias("is_active"),
    )


LEAGUES_SQL = """
leagues as (
  select 'l' || n_nationkey as id, n_name as name, r_name as country,
         case when n_nationkey % 2 = 0 then 'basketball' else 'football' end as sport, n_nationkey % 5 <> 0 as is_active
  from nation join region on n_regionkey = r_regionkey)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match per part; every thirtieth has no league and every seventh no start."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("m"), k.cast("string")).alias("id"), F.when(k % 30 != 0, F.concat(F.lit("l"), (k % 25).cast("string"))).alias("league_id"), F.col("p_brand").alias("home_team"), F.col("p_type").alias("away_team"),
        F.when(k % 7 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T20:00:00"))).alias("start_time"),
    )


MATCHES_SQL = """
matches as (
  select 'm' || p_partkey as id, case when p_partkey % 30 <> 0 then 'l' || (p_partkey % 25) end as league_id, p_brand as home_team, p_type as away_team,
         case when p_partkey % 7 <> 0 then '2024-01-' || lpad((p_partkey % 28 + 1)::varchar, 2, '0') || 'T20:00:00' end as start_time
  from part)"""


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quotes of an order book: a month is a slot, customers and order numbers name the teams in several spellings, every fifth is a shared-platform prop."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    home_no, away_no = c % 6, F.lit(6) + k % 4
    turned = k % 7 == 0
    first, second = F.when(turned, away_no).otherwise(home_no), F.when(turned, home_no).otherwise(away_no)

    def label(n):  # noqa: ANN001, ANN202
        s = n.cast("string")
        return F.when(k % 11 == 0, F.concat(F.lit("Nation "), s, F.lit(" BC"))).when(k % 3 == 0, F.concat(F.lit("nation "), s)).when(k % 17 == 0, F.concat(F.lit("Club "), s)).otherwise(F.concat(F.lit("NATION_"), s))

    prop = k % 5 == 0
    player = F.when(prop, F.concat(F.lit("Player "), (c % 50).cast("string")))
    return o.select(
        k.alias("seq"), F.concat(F.lit("b"), (c % 4).cast("string")).alias("bookmaker_id"), F.concat(F.lit("League-"), (k % 3).cast("string")).alias("league_id"), F.lit("basketball").alias("sport"),
        label(first).alias("home_team"), F.when(prop, player).otherwise(label(second)).alias("away_team"), F.when(prop, "points").otherwise("game total ot").alias("market_type"), player.alias("player_name"),
        (F.floor(F.col("o_totalprice") / 10000) + 0.5).cast("double").alias("threshold"), (1.5 + (c % 10) / 10.0).alias("over_odds"), (1.5 + (k % 10) / 10.0).alias("under_odds"),
        F.when(k % 13 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("start_time"),
    )


RAW_SQL = """
numbered as (
  select *, case when o_orderkey % 7 = 0 then 6 + o_orderkey % 4 else o_custkey % 6 end as n1, case when o_orderkey % 7 = 0 then o_custkey % 6 else 6 + o_orderkey % 4 end as n2 from orders),
labelled as (
  select *, case when o_orderkey % 11 = 0 then 'Nation ' || n1 || ' BC' when o_orderkey % 3 = 0 then 'nation ' || n1 when o_orderkey % 17 = 0 then 'Club ' || n1 else 'NATION_' || n1 end as l1,
            case when o_orderkey % 11 = 0 then 'Nation ' || n2 || ' BC' when o_orderkey % 3 = 0 then 'nation ' || n2 when o_orderkey % 17 = 0 then 'Club ' || n2 else 'NATION_' || n2 end as l2,
            case when o_orderkey % 5 = 0 then 'Player ' || (o_custkey % 50) end as player_name
  from numbered),
raw as (
  select o_orderkey as seq, 'b' || (o_custkey % 4) as bookmaker_id, 'League-' || (o_orderkey % 3) as league_id, 'basketball' as sport, l1 as home_team, coalesce(player_name, l2) as away_team,
         case when player_name is not null then 'points' else 'game total ot' end as market_type, player_name, floor(o_totalprice / 10000) + 0.5 as threshold, 1.5 + (o_custkey % 10) / 10.0 as over_odds, 1.5 + (o_orderkey % 10) / 10.0 as under_odds,
         case when o_orderkey % 13 <> 0 then strftime(o_orderdate, '%Y-%m') end as start_time
  from labelled)"""


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") + 1).cast("long").alias("team_id"), F.lit("basketball").alias("sport"), F.col("n_name").alias("display_name"), (F.col("n_nationkey") != 9).alias("is_active"), F.lit(None).cast("long").alias("merged_into"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical alias per nation, 'nation N bc' of some at one book, and two books' own readings of a shared spelling."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    s = F.col("k").cast("string")
    one = n.select((F.col("k") + 1).alias("alias_id"), F.concat(F.lit("nation "), s).alias("normalized_alias"), F.lit("").alias("bookmaker_id"), F.lit("canonical").alias("source"), (F.col("k") + 1).alias("team_id"))
    two = n.where("k % 2 = 0").select((F.col("k") + 101).alias("alias_id"), F.concat(F.lit("nation "), s, F.lit(" bc")).alias("normalized_alias"), F.lit("b1").alias("bookmaker_id"), F.lit("manual").alias("source"), (F.col("k") + 1).alias("team_id"))
    three = n.where("k in (2, 3)").select((F.col("k") + 201).alias("alias_id"), F.concat(F.lit("nation "), s).alias("normalized_alias"), F.lit("b2").alias("bookmaker_id"), F.lit("manual").alias("source"), (F.col("k") + 2).alias("team_id"))
    return one.unionByName(two).unionByName(three).withColumn("sport", F.lit("basketball"))


IDENTITY = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({x})), '_', ' '), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"

REGISTRY_SQL = """
teams as (select n_nationkey + 1 as team_id, 'basketball' as sport, n_name as display_name, n_nationkey <> 9 as is_active from nation),
aliases as (
  select n_nationkey + 1 as alias_id, 'nation ' || n_nationkey as normalized_alias, '' as bookmaker_id, 'canonical' as source, n_nationkey + 1 as team_id from nation
  union all select n_nationkey + 101, 'nation ' || n_nationkey || ' bc', 'b1', 'manual', n_nationkey + 1 from nation where n_nationkey % 2 = 0
  union all select n_nationkey + 201, 'nation ' || n_nationkey, 'b2', 'manual', n_nationkey + 2 from nation where n_nationkey in (2, 3))"""

RESOLVED_SQL = RAW_SQL + "," + REGISTRY_SQL + f""",
labels as (select distinct bookmaker_id, label from (select bookmaker_id, home_team as label from raw union all select bookmaker_id, away_team from raw)),
res as (
  select bookmaker_id, label, team_id, display_name as team_name, source from (
    select l.bookmaker_id, l.label, a.team_id, t.display_name, a.source,
           row_number() over (partition by l.bookmaker_id, l.label order by case when a.bookmaker_id = l.bookmaker_id then 0 else 1 end, case when a.source = 'canonical' then 0 else 1 end, a.alias_id) as n
    from labels l join aliases a on a.normalized_alias = {IDENTITY.format(x='l.label')} and a.bookmaker_id in (l.bookmaker_id, '') join teams t on t.team_id = a.team_id and t.is_active)
  where n = 1),
resolved as (
  select r.*, h.team_id as home_id, coalesce(h.team_name, trim(r.home_team)) as home_name, a.team_id as away_id, coalesce(a.team_name, trim(r.away_team)) as away_name,
         coalesce(r.player_name <> '' and trim(r.away_team) = trim(r.player_name), false) as shared
  from raw r left join res h on r.bookmaker_id = h.bookmaker_id and r.home_team = h.label left join res a on r.bookmaker_id = a.bookmaker_id and r.away_team = a.label)"""
