"""Queries on the snapshot store, the read API, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources import domain
from ..sources.domain import BOOKMAKERS_SQL, LEAGUES_SQL, MATCHES_SQL, ODDS_SQL, SNAPSHOT_SQL

_SNAP = ("match_id", "bookmaker_id", "market_type", "player_name", "threshold", "over_odds", "under_odds", "scraped_at", "seq")


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_snapshot(domain.snapshots(spark, sf_dir))


def snapshot_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.snapshots(spark, sf_dir)
    pointer = rows.agg(F.min("scraped_at").alias("current_snapshot_at"))
    return store.at_snapshot(rows, pointer)


def legacy_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.legacy_window(domain.snapshots(spark, sf_dir), 240)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_latest(domain.snapshots(spark, sf_dir)).select(*_SNAP)


def stale_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the store that the latest snapshot no longer shows, by source."""
    rows = domain.snapshots(spark, sf_dir)
    newest = store.latest_snapshot(rows).select(*store.ODDS_KEY)
    on = [rows[c].eqNullSafe(newest[c]) for c in store.ODDS_KEY]
    return rows.join(newest, on, "left_anti").groupBy("bookmaker_id").agg(F.count("*").alias("n"))


def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = store.latest_snapshot(domain.snapshots(spark, sf_dir))
    return store.system_status(snap, domain.matches(spark, sf_dir), domain.bookmakers(spark, sf_dir), domain.table(spark, sf_dir, "supplier"))


def per_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.source_counts(domain.odds(spark, sf_dir))


def cycle_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders")
    tasks = o.select(F.concat(F.lit("b"), (F.col("o_custkey") % 10).cast("string")).alias("bookmaker_id"), F.col("o_totalprice").cast("long").alias("duration_ms"), (F.col("o_orderkey") % 50).alias("raw_items"), (F.col("o_orderstatus") == "P").alias("failed"))
    return store.cycle_benchmark(tasks, store.source_counts(domain.odds(spark, sf_dir)))


def matches_snapshot_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, lg = domain.matches(spark, sf_dir), domain.leagues(spark, sf_dir)
    seen = store.with_odds_at(m, store.latest_snapshot(domain.snapshots(spark, sf_dir)))
    return seen.join(lg.select(F.col("id").alias("l_id"), F.col("name").alias("league_name")), F.col("league_id") == F.col("l_id"), "left").drop("l_id")


def matches_by_bookmaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.with_odds_at(domain.matches(spark, sf_dir), domain.odds(spark, sf_dir), ["b2", "b6"])
    return found.orderBy(F.col("start_time").asc_nulls_first(), "id").offset(20).limit(50).select("id", "start_time")


def match_bookmakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.match_bookmakers(domain.odds(spark, sf_dir), domain.bookmakers(spark, sf_dir))
    return found.select("match_id", F.array_join(F.transform("bookmakers", lambda b: b["name"]), ",").alias("names"), F.size("bookmakers").alias("n"))


def match_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, b = domain.odds(spark, sf_dir).where("match_id = 'm7'"), domain.bookmakers(spark, sf_dir)
    joined = o.join(b.select(F.col("id").alias("b_id"), "name"), F.col("bookmaker_id") == F.col("b_id"), "left")
    return joined.orderBy("market_type", F.col("player_name").asc_nulls_first(), "threshold").select("market_type", "player_name", "threshold", "name", "over_odds", "under_odds")


def odds_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.snapshots(spark, sf_dir).where("match_id = 'm5'").orderBy(F.desc("scraped_at"), "seq").select(*_SNAP)


def active_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.leagues(spark, sf_dir).where("is_active and sport = 'basketball'")


def active_bookmakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.bookmakers(spark, sf_dir).where("is_active").orderBy(F.desc("is_active"), "name")


def unresolved_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-05, J-09, H-04: filtered, with source and league names, first page of the five-key order."""
    u = domain.raw_offers(spark, sf_dir).where("start_time is null and market_type = 'points'").where(F.col("bookmaker_id").isin("b1", "b2"))
    b = domain.bookmakers(spark, sf_dir).select(F.col("id").alias("b_id"), F.col("name").alias("bookmaker_name"))
    joined = u.join(b, F.col("bookmaker_id") == F.col("b_id"), "left")
    return joined.orderBy("league_id", "home_team", "player_name", "threshold", "seq").limit(100).select("league_id", "home_team", "player_name", "threshold", "seq", "bookmaker_name")


def review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-06, H-05, H-10, C-41: order statuses as review states, ranked by confidence."""
    o = domain.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    confidence = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(2)
    return o.select("o_orderkey", "o_orderstatus", confidence.alias("rank")).orderBy("o_orderstatus", F.desc("rank"), "o_orderkey").limit(200)


def review_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events")
    history = e.select((F.col("user_id") % 20).alias("team_id"), "event_type", F.concat(F.lit("b"), (F.col("event_id") % 8).cast("string")).alias("bookmaker_id"), F.when(F.col("event_id") % 97 == 0, "declined").otherwise("pending").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("scraped_at"))
    out = store.review_history(history, history, ("team_id", "event_type"), F.lit("2024-01-03"))
    return out.select("team_id", "event_type", F.array_join("books", ",").alias("books"), "declined")


def merge_matches_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    odds = domain.snapshots(spark, sf_dir).withColumnRenamed("seq", "id")
    mapping = spark.sql("select * from values ('m1', 'm2'), ('m3', 'm2'), ('m10', 'm11') as t(source_id, target_id)")
    return store.merge_matches(odds, mapping).groupBy("match_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.registry import union_all

    odds = domain.odds(spark, sf_dir)
    parts = [odds.where(F.col("bookmaker_id") == f"b{n}").select("bookmaker_id", "market_type", "threshold") for n in range(8)]
    return union_all(parts).groupBy("bookmaker_id", "market_type").agg(F.count("*").alias("n"), F.sum("threshold").alias("total"))


def distinct_bookmakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.odds(spark, sf_dir).select("match_id", "bookmaker_id").distinct()


def missing_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, line = domain.table(spark, sf_dir, "part"), domain.table(spark, sf_dir, "lineitem")
    asked, got = p.select("p_partkey"), line.where("l_returnflag = 'A' and l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return asked.exceptAll(got.distinct())


def highlight_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-18: quotes of a match marked where a discrepancy ends at them."""
    from ..operators.analyze import find_discrepancies

    odds = domain.odds(spark, sf_dir)
    d = find_discrepancies(odds, 40.0)
    ends = d.select("match_id", F.explode(F.array(F.struct(F.col("bookmaker_a_id").alias("b"), F.col("threshold_a").alias("t")), F.struct(F.col("bookmaker_b_id").alias("b"), F.col("threshold_b").alias("t")))).alias("e")).select(F.col("match_id").alias("m"), "e.b", "e.t").distinct()
    joined = odds.join(ends, (F.col("match_id") == F.col("m")) & (F.col("bookmaker_id") == F.col("b")) & (F.col("threshold") == F.col("t")), "left")
    return joined.groupBy("match_id", F.col("b").isNotNull().alias("highlighted")).agg(F.count("*").alias("n"))


def market_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-20, F-21."""
    odds = domain.odds(spark, sf_dir)
    return odds.groupBy("match_id", "market_type", "player_name").agg(F.count("*").alias("offers"), F.count_distinct("bookmaker_id").alias("books"), F.min("threshold").alias("low"), F.max("threshold").alias("high"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-26, C-27."""
    e = domain.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.max("p.k").alias("top"))


def upcoming_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-15, H-09: matches without a valid start, or that start from a moment on."""
    m = domain.matches(spark, sf_dir)
    start = F.try_to_timestamp("start_time")
    return m.where(start.isNull() | (start >= F.lit("2024-01-20 00:00:00").cast("timestamp"))).orderBy(F.col("start_time").asc_nulls_last(), "home_team", "id").limit(300).select("id", "start_time", "home_team")


def bookmaker_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-24, H-12: every source known or seen, with what was stored of it."""
    b, c = domain.bookmakers(spark, sf_dir), store.source_counts(domain.odds(spark, sf_dir).where("bookmaker_id <> 'b2'"))
    joined = b.join(c, b["id"] == c["bookmaker_id"], "full")
    return joined.select(F.coalesce("id", "bookmaker_id").alias("id"), "name", F.coalesce("is_active", F.lit(False)).alias("is_active"), F.coalesce("odds_count", F.lit(0)).cast("long").alias("odds_count"))


QUERIES = {f.__name__: f for f in (
    snapshot_latest, snapshot_pointer, legacy_window, upsert_latest, stale_hidden, system_status, per_source_counts, cycle_benchmark, matches_snapshot_semi, matches_by_bookmaker,
    match_bookmakers, match_odds, odds_history, active_leagues, active_bookmakers, unresolved_filter, review_filter, review_history_summary, merge_matches_dedupe, union_sources,
    distinct_bookmakers, missing_ids_anti, highlight_offers, market_groups, json_props, upcoming_filter, bookmaker_deck,
)}

_LATEST = f"with {SNAPSHOT_SQL}, newest as (select * from snap where scraped_at = (select max(scraped_at) from snap))"
from ..plans.compare import GAPS as _GAPS, ARBS as _ARBS  # noqa: E402, I001
from ..sources.domain import RAW_SQL  # noqa: E402

ORACLES = {
    "snapshot_latest": f"{_LATEST} select * from newest",
    "snapshot_pointer": f"with {SNAPSHOT_SQL} select * from snap where scraped_at = (select min(scraped_at) from snap)",
    "legacy_window": f"with {SNAPSHOT_SQL} select * from snap where scraped_at >= (select strftime(max(scraped_at)::timestamp - interval 240 minute, '%Y-%m-%dT%H:%M:%S') from snap)",
    "upsert_latest": f"""with {SNAPSHOT_SQL}
select * exclude (n) from (select *, row_number() over (partition by match_id, bookmaker_id, market_type, player_name, threshold order by scraped_at desc, seq desc) as n from snap where player_name is not null) where n = 1
union all select * from snap where player_name is null""",
    "stale_hidden": f"""{_LATEST} select bookmaker_id, count(*) as n from snap s where not exists (
select 1 from newest w where w.match_id = s.match_id and w.bookmaker_id = s.bookmaker_id and w.market_type = s.market_type and w.player_name is not distinct from s.player_name and w.threshold = s.threshold) group by 1""",
    "system_status": f"""{_LATEST}, {MATCHES_SQL}, {BOOKMAKERS_SQL} select (select count(*) from newest) as odds, (select count(distinct match_id) from newest) as matches_with_odds, (select max(scraped_at) from newest) as last_scrape,
(select count(*) from matches) as matches, (select count(*) from bookmakers where is_active) as active_bookmakers, (select count(*) from supplier) as discrepancies""",
    "per_source_counts": f"with {ODDS_SQL} select bookmaker_id, count(*) as odds_count, count(distinct match_id) as matches from odds group by 1",
    "cycle_benchmark": f"""with {ODDS_SQL},
c as (select bookmaker_id, count(*) as odds_count, count(distinct match_id) as matches from odds group by 1),
t as (select 'b' || (o_custkey % 10) as bookmaker_id, sum(trunc(o_totalprice)::bigint)::bigint as duration_ms, sum(o_orderkey % 50)::bigint as raw_items, count(*) as leagues_attempted, count(*) filter (o_orderstatus = 'P') as leagues_failed from orders group by 1)
select bookmaker_id, coalesce(duration_ms, 0) as duration_ms, coalesce(raw_items, 0) as raw_items, coalesce(leagues_attempted, 0) as leagues_attempted, coalesce(leagues_failed, 0) as leagues_failed, coalesce(odds_count, 0) as odds_count, coalesce(matches, 0) as matches,
round(coalesce(leagues_failed / leagues_attempted, 0), 4) as failure_rate from t full join c using (bookmaker_id)""",
    "matches_snapshot_semi": f"{_LATEST}, {MATCHES_SQL}, {LEAGUES_SQL} select m.*, l.name as league_name from matches m left join leagues l on m.league_id = l.id where exists (select 1 from newest w where w.match_id = m.id)",
    "matches_by_bookmaker": f"with {ODDS_SQL}, {MATCHES_SQL} select id, start_time from matches m where exists (select 1 from odds o where o.match_id = m.id and bookmaker_id in ('b2', 'b6')) order by start_time asc nulls first, id limit 50 offset 20",
    "match_bookmakers": f"""with {ODDS_SQL}, {BOOKMAKERS_SQL}, p as (select distinct match_id, bookmaker_id from odds)
select match_id, string_agg(name, ',' order by name, bookmaker_id) as names, count(*)::int as n from p left join bookmakers b on b.id = p.bookmaker_id group by 1""",
    "match_odds": f"with {ODDS_SQL}, {BOOKMAKERS_SQL} select market_type, player_name, threshold, name, over_odds, under_odds from odds left join bookmakers b on b.id = bookmaker_id where match_id = 'm7'",
    "odds_history": f"with {SNAPSHOT_SQL} select * from snap where match_id = 'm5'",
    "active_leagues": f"with {LEAGUES_SQL} select * from leagues where is_active and sport = 'basketball'",
    "active_bookmakers": f"with {BOOKMAKERS_SQL} select * from bookmakers where is_active",
    "unresolved_filter": f"""with {RAW_SQL}, {BOOKMAKERS_SQL} select league_id, home_team, player_name, threshold, seq, name as bookmaker_name from raw left join bookmakers b on b.id = bookmaker_id
where start_time is null and market_type = 'points' and bookmaker_id in ('b1', 'b2') order by league_id, home_team, player_name, threshold, seq limit 100""",
    "review_filter": """select o_orderkey, o_orderstatus, case o_orderpriority when '1-URGENT' then 3 when '5-LOW' then 1 else 2 end as rank from orders where o_orderstatus in ('O', 'P') order by o_orderstatus, rank desc, o_orderkey limit 200""",
    "review_history_summary": """with h as (select user_id % 20 as team_id, event_type, 'b' || (event_id % 8) as bookmaker_id, event_id % 97 = 0 as declined, strftime(ts, '%Y-%m-%d') as d from events),
p as (select team_id, event_type, string_agg(distinct bookmaker_id, ',' order by bookmaker_id) as books, bool_or(declined) as declined from h where d <= '2024-01-03' group by 1, 2)
select k.team_id, k.event_type, books, declined from (select distinct team_id, event_type from h) k left join p using (team_id, event_type)""",
    "merge_matches_dedupe": f"""with {SNAPSHOT_SQL}, m as (select * from (values ('m1', 'm2'), ('m3', 'm2'), ('m10', 'm11')) t(source_id, target_id)),
moved as (select coalesce(target_id, match_id) as match_id, s.* exclude (match_id) from snap s left join m on s.match_id = m.source_id),
r as (select *, row_number() over (partition by match_id, bookmaker_id, market_type, player_name, threshold order by seq desc) as n from moved)
select match_id, count(*) as n, sum(seq)::bigint as ids from r where n = 1 or match_id not in (select target_id from m) group by 1""",
    "union_sources": f"with {ODDS_SQL} select bookmaker_id, market_type, count(*) as n, sum(threshold) as total from odds group by 1, 2",
    "distinct_bookmakers": f"with {ODDS_SQL} select distinct match_id, bookmaker_id from odds",
    "missing_ids_anti": "select p_partkey from part except select l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 30",
    "highlight_offers": f"""with {_GAPS}{_ARBS},
d as (select * from found where gap = 0 or threshold_b - threshold_a >= 40),
ends as (select match_id, bookmaker_a_id as b, threshold_a as t from d union select match_id, bookmaker_b_id, threshold_b from d)
select o.match_id, e.b is not null as highlighted, count(*) as n from odds o left join ends e on e.match_id = o.match_id and e.b = o.bookmaker_id and e.t = o.threshold group by 1, 2""",
    "market_groups": f"with {ODDS_SQL} select match_id, market_type, player_name, count(*) as offers, count(distinct bookmaker_id) as books, min(threshold) as low, max(threshold) as high from odds group by 1, 2, 3",
    "json_props": "select event_type, sum((props::json->>'k')::int)::bigint as total, max((props::json->>'k')::int) as top from events group by 1",
    "upcoming_filter": f"with {MATCHES_SQL} select id, start_time, home_team from matches where try_cast(start_time as timestamp) is null or try_cast(start_time as timestamp) >= timestamp '2024-01-20' order by start_time asc nulls last, home_team, id limit 300",
    "bookmaker_deck": f"""with {ODDS_SQL}, {BOOKMAKERS_SQL}, c as (select bookmaker_id, count(*) as n from odds where bookmaker_id <> 'b2' group by 1)
select coalesce(id, bookmaker_id) as id, name, coalesce(is_active, false) as is_active, coalesce(n, 0) as odds_count from bookmakers full join c on id = bookmaker_id""",
}
