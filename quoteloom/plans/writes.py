"""Queries on what a cycle or a reviewer writes: upserts, aliases, decisions, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decisions, store
from ..sources import domain
from ..sources.domain import IDENTITY, REGISTRY_SQL


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as normalised quotes of 700 matches, some without a known team."""
    o = domain.table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        _text("m", c % 700).alias("match_id"), _text("l", k % 5).alias("league_id"), F.lit("basketball").alias("sport"), (k % 9 - 1).cast("long").alias("home_team_id"), (c % 11).cast("long").alias("away_team_id"),
        _text("h", k % 9).alias("home_team"), _text("a", c % 11).alias("away_team"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_time"), k.cast("long").alias("seq"),
    )


def first_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_of_match(_quotes(spark, sf_dir))


def upsert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-03 with F-22: the matches of the early orders, then those of the later ones over them."""
    quotes = _quotes(spark, sf_dir)
    early, late = quotes.where("start_time < '1996'"), quotes.where("start_time >= '1996' and home_team <> 'h3'")
    return store.upsert_matches(store.first_of_match(early), store.first_of_match(late))


def upsert_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = domain.table(spark, sf_dir, "nation")
    table = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("basketball").alias("sport"), _text("r", F.col("n_regionkey")).alias("country"))
    c = domain.table(spark, sf_dir, "customer")
    changes = c.select((F.col("c_nationkey") + 5).cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("football").alias("sport"), F.lit(None).cast("string").alias("country"), F.col("c_custkey").alias("seq"))
    return store.upsert_leagues(table, changes)


def upsert_bookmakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.table(spark, sf_dir, "supplier").withColumn("id", _text("b", F.col("s_suppkey")))
    table = s.select("id", F.col("s_name").alias("name"), F.lit("url").alias("website_url"), (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    changes = s.where("s_acctbal > 0").select(_text("b", F.col("s_suppkey") % 7).alias("id"), F.upper("s_name").alias("name"), F.lit(None).cast("string").alias("website_url"), F.col("s_suppkey").alias("seq"))
    return store.upsert_bookmakers(table, changes)


def notifications_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-14, H-07."""
    e = domain.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.col("event_id") % 3 == 0).alias("is_read"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return store.read_notifications(rows, True, 120)


def rank_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-07: the place of the 25 best customers of each segment in the list sorted by balance."""
    c = domain.table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    order = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.withColumn("badge", F.row_number().over(order)).where("badge <= 25").select("c_mktsegment", "c_custkey", F.concat(F.lit("#"), F.col("badge").cast("string")).alias("badge"))


#: Columns of each order, those marked ``-`` from the largest on.
REVIEW_SORTS = {
    "confidence": ("-confidence_rank", "-score", "start_time", "id"),
    "score": ("-score", "-confidence_rank", "start_time", "id"),
    "start": ("start_time", "-confidence_rank", "-score", "id"),
    "newest": ("-scraped_at", "-confidence_rank", "-score", "id"),
}


def sort_reviews(cases: DataFrame, mode: str) -> DataFrame:
    """H-10: review cases in one of four orders, unknown values always last."""
    return cases.orderBy(*(F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in REVIEW_SORTS[mode]))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), (k % 3).cast("int").alias("confidence_rank"), F.when(k % 5 != 0, (k % 40 + 60).cast("double")).alias("score"), F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start_time"),
        F.date_format("o_orderdate", "yyyy-MM").alias("scraped_at"),
    )


def review_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 cases in each of the four orders."""
    cases, out = _reviews(spark, sf_dir), None
    for mode in REVIEW_SORTS:
        page = sort_reviews(cases, mode).limit(40).select(F.lit(mode).alias("mode"), "id")
        out = page if out is None else out.unionByName(page)
    return out


def review_history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-07: earlier cases of two kinds that agree with a case in six columns, up to a snapshot."""
    e = domain.table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select(
        k.alias("id"), F.when(k % 4 == 0, "alias_suggestion").when(k % 4 == 1, "auto_alias").otherwise("candidate_search").alias("review_kind"), F.lit("basketball").alias("sport"), _text("n", F.col("user_id") % 6).alias("norm"),
        (F.col("user_id") % 3).alias("team_id"), F.col("event_type").alias("start_time"), _text("h", k % 2).alias("home"), _text("a", k % 2).alias("away"), F.date_format("ts", "yyyy-MM-dd").alias("scraped_at"),
    )
    return decisions.case_history(rows, {"sport": "basketball", "norm": "n4", "team_id": 1, "start_time": "click", "home": "h0", "away": "a0"}, "2024-01-20").select("id", "review_kind", "scraped_at")


def candidate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-18: each order's lines as candidates of five teams, one a team afterwards."""
    line = domain.table(spark, sf_dir, "lineitem")
    team = F.col("l_partkey") % 5
    one = F.struct(team.alias("team_id"), _text("t", team).alias("team_name"), F.col("l_quantity").cast("double").alias("score"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("x")).alias("matched_alias"))
    lists = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return lists.select("l_orderkey", F.array_join(F.transform(decisions.collapse_candidates(F.col("c")), lambda c: F.concat_ws(":", c["team_name"], c["score"].cast("int").cast("string"), c["matched_alias"])), ",").alias("teams"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ask for aliases: some for labels that are taken, some blank, some for unknown teams."""
    c = domain.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    label = F.when(k % 10 == 0, F.lit("--")).when(k % 10 < 4, _text("nation ", k % 25)).otherwise(_text("Fan ", k % 40))
    return c.select(
        k.cast("long").alias("request_id"), F.lit("basketball").alias("sport"), _text("b", k % 3).alias("bookmaker_id"), label.alias("raw_team_name"),
        F.when(k % 9 == 0, F.lit("Nobody")).otherwise(_text("NATION_", k % 25)).alias("team_name"), F.when(k % 2 == 0, "manual").otherwise("auto_review").alias("source"),
    )


def alias_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-13: what becomes of each request."""
    judged, _ = decisions.remember_aliases(domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir), _requests(spark, sf_dir))
    return judged.select("request_id", "outcome", F.col("target_id").alias("team_id"))


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-21, U-08: customers as review cases, decided in every way."""
    k = F.col("c_custkey")
    c = domain.table(spark, sf_dir, "customer")
    cases = c.select(
        k.cast("long").alias("id"), F.lit("basketball").alias("sport"), _text("b", k % 3).alias("bookmaker_id"), _text("Case ", k).alias("raw_team_name"), F.when(k % 4 != 0, k % 25 + 1).cast("long").alias("suggested_team_id"),
        F.when(k % 4 != 0, _text("NATION_", k % 25)).alias("suggested_team_name"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("approved_at"),
    )
    asked = c.select(
        (k + k % 2 * 1_000_000 * (k % 5 == 0).cast("int")).cast("long").alias("case_id"), F.when(k % 6 == 0, "decline").otherwise("approve").alias("action"),
        F.when(k % 7 == 0, k % 30 + 1).cast("long").alias("team_id"), F.when(k % 11 == 0, _text("Klub ", k % 13)).alias("create_team_name"),
    )
    outcomes, _, _, _ = decisions.settle_reviews(cases, asked, domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir), "now")
    return outcomes.select("case_id", "outcome", "code", "team_name")


QUERIES = {f.__name__: f for f in (
    first_of_match, upsert_matches, upsert_leagues, upsert_bookmakers, notifications_unread, rank_badges, review_sorts, review_history_filter, candidate_collapse, alias_requests, review_decisions,
)}

_QUOTES = """
quotes as (
  select 'm' || (o_custkey % 700) as match_id, 'l' || (o_orderkey % 5) as league_id, 'basketball' as sport, (o_orderkey % 9 - 1)::bigint as home_team_id, (o_custkey % 11)::bigint as away_team_id,
         'h' || (o_orderkey % 9) as home_team, 'a' || (o_custkey % 11) as away_team, strftime(o_orderdate, '%Y-%m-%d') as start_time, o_orderkey::bigint as seq
  from orders)"""
_FIRST = "match_id as id, league_id, sport, {home} as home_team_id, {away} as away_team_id, home_team, away_team, start_time, 'upcoming' as status, seq"


def _first(home: str, away: str, cond: str) -> str:
    return f"select {_FIRST.format(home=home, away=away)} from quotes where {cond} qualify row_number() over (partition by match_id order by seq) = 1"


ORACLES = {
    "first_of_match": f"with {_QUOTES} {_first('home_team_id', 'away_team_id', 'true')}",
    "upsert_matches": f"""with {_QUOTES},
late as ({_first('case when home_team_id > 0 then home_team_id end', 'case when away_team_id > 0 then away_team_id end', "start_time >= '1996' and home_team <> 'h3'")}),
early as ({_first('home_team_id', 'away_team_id', "start_time < '1996'")})
select * from late union all select * from early where id not in (select id from late)""",
    "upsert_leagues": """with c as (
  select (c_nationkey + 5)::varchar as id, c_name as name, 'football' as sport, null::varchar as country from customer qualify row_number() over (partition by c_nationkey order by c_custkey desc) = 1)
select * from c union all select n_nationkey::varchar, n_name, 'basketball', 'r' || n_regionkey from nation where n_nationkey::varchar not in (select id from c)""",
    "upsert_bookmakers": """with c as (
  select 'b' || (s_suppkey % 7) as id, upper(s_name) as name, null::varchar as website_url, true as is_active from supplier where s_acctbal > 0 qualify row_number() over (partition by s_suppkey % 7 order by s_suppkey desc) = 1)
select * from c union all select 'b' || s_suppkey, s_name, 'url', s_suppkey % 2 = 0 from supplier where 'b' || s_suppkey not in (select id from c)""",
    "notifications_unread": """select event_id as id, event_type as type, false as is_read, strftime(ts, '%Y-%m-%dT%H:%M:%S') as created_at from events where event_id % 3 <> 0
order by created_at desc, id desc limit 120""",
    "rank_badges": """select c_mktsegment, c_custkey, '#' || n as badge from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as n from customer) where n <= 25""",
    "review_sorts": """with r as (
  select o_orderkey as id, o_orderkey % 3 as c, case when o_orderkey % 5 <> 0 then o_orderkey % 40 + 60 end as score, case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as s, strftime(o_orderdate, '%Y-%m') as t from orders)
select 'confidence' as mode, id from (select id from r order by c desc, score desc nulls last, s nulls last, id limit 40)
union all select 'score', id from (select id from r order by score desc nulls last, c desc, s nulls last, id limit 40)
union all select 'start', id from (select id from r order by s nulls last, c desc, score desc nulls last, id limit 40)
union all select 'newest', id from (select id from r order by t desc nulls last, c desc, score desc nulls last, id limit 40)""",
    "review_history_filter": """select event_id as id, case event_id % 4 when 0 then 'alias_suggestion' else 'auto_alias' end as review_kind, strftime(ts, '%Y-%m-%d') as scraped_at from events
where event_id % 4 in (0, 1) and user_id % 6 = 4 and user_id % 3 = 1 and event_type = 'click' and event_id % 2 = 0 and strftime(ts, '%Y-%m-%d') <= '2024-01-20'""",
    "candidate_collapse": """with c as (select l_orderkey, l_partkey % 5 as team, l_quantity::int as score, case when l_linenumber % 3 = 0 then 'x' end as alias from lineitem),
t as (select l_orderkey, team, max(score) as score, max(alias) as alias from c group by 1, 2)
select l_orderkey, string_agg('t' || team || ':' || score || coalesce(':' || alias, ''), ',' order by score desc, 't' || team) as teams from t group by 1""",
    "alias_requests": f"""with {REGISTRY_SQL},
r as (
  select c_custkey::bigint as request_id, 'b' || (c_custkey % 3) as scope, case when c_custkey % 2 = 0 then 'manual' else 'auto_review' end as source,
         case when c_custkey % 10 = 0 then '--' when c_custkey % 10 < 4 then 'nation ' || (c_custkey % 25) else 'Fan ' || (c_custkey % 40) end as label,
         case when c_custkey % 9 = 0 then 'Nobody' else 'NATION_' || (c_custkey % 25) end as wanted
  from customer),
known as (select a.normalized_alias as k, a.bookmaker_id as s, a.source, a.alias_id, a.team_id, t.display_name from aliases a join teams t using (team_id) where t.is_active),
said as (select *, {IDENTITY.format(x='label')} as lk, {IDENTITY.format(x='wanted')} as wk from r),
target as (
  select request_id, team_id, display_name from said join known on wk = k and (s = scope or s = '')
  qualify row_number() over (partition by request_id order by (s <> scope)::int, (known.source <> 'canonical')::int, alias_id) = 1),
now_ as (
  select request_id, team_id as now_id from said join known on lk = k and (s = scope or s = '')
  qualify row_number() over (partition by request_id order by (s <> scope)::int, (known.source <> 'canonical')::int, alias_id) = 1),
asked as (select * from said left join target using (request_id) left join now_ using (request_id)),
taken as (select lk, scope, arg_min(team_id, request_id) as first_id from asked where team_id is not null and lk <> '' group by 1, 2)
select request_id, team_id,
       case when lk = '' or wk = '' then 'blank' when team_id is null then 'unknown_team' when lk = {IDENTITY.format(x='display_name')} and wk <> lk then 'circular'
            when now_id <> team_id then 'conflict' when first_id <> team_id then 'conflict' when now_id is not null and source = 'auto_review' then 'kept' else 'saved' end as outcome
from asked left join taken using (lk, scope)""",
}
