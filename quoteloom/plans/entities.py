"""Queries on entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_league_id, identity_text
from ..operators import registry, resolve
from ..sources import domain
from ..sources.domain import IDENTITY, RAW_SQL, REGISTRY_SQL, RESOLVED_SQL


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = domain.raw_offers(spark, sf_dir)
    return registry.with_teams(raw, domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir)).withColumn("voted_league", canonical_league_id(F.col("league_id")))


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = domain.raw_offers(spark, sf_dir)
    labels = raw.select("sport", "bookmaker_id", F.explode(F.array("home_team", "away_team")).alias("label"))
    return registry.resolve_labels(labels, domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir)).drop("sport")


def league_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domain.raw_offers(spark, sf_dir).select("bookmaker_id", F.col("league_id").alias("label"))
    leagues = spark.sql("select * from values ('league_0', 'First League'), ('aba', 'ABA League') as t(id, name)")
    known = spark.sql("select * from values ('', 'league 1', 'aba'), ('b2', 'league 0', 'aba') as t(bookmaker_id, alias, league_id)")
    return registry.resolve_leagues(labels, leagues, known)


def alias_prefix_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = domain.aliases(spark, sf_dir)
    renamed = a.withColumn("normalized_alias", F.regexp_replace("normalized_alias", "[0-9]+", "#"))
    return registry.shared_aliases(renamed, 3, 5)


def missing_start_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, missing = resolve.split_missing_start(domain.raw_offers(spark, sf_dir))
    return missing.groupBy("reason_code", "market_type").agg(F.count("*").alias("n")).unionByName(timed.groupBy(F.lit("timed").alias("reason_code"), "market_type").agg(F.count("*").alias("n")))


def canonical_matchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.canonical_matchups(_resolved(spark, sf_dir)).drop("seen")


def inferred_matchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir)
    return resolve.inferred_matchups(r, resolve.canonical_matchups(r.where("start_time < '1998'"))).drop("seen")


def event_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.event_votes(_resolved(spark, sf_dir))


def league_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.league_evidence(_resolved(spark, sf_dir))


def shared_platform_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, lost = resolve.resolve_matchups(domain.raw_offers(spark, sf_dir).where("start_time is not null"), domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir))
    ok = done.where("player_name is not null").groupBy(F.lit("resolved").alias("outcome"), "home_team", "away_team").agg(F.count("*").alias("n"))
    bad = lost.groupBy(F.col("reason_code").alias("outcome"), F.col("normalized_team_name").alias("home_team"), F.lit("").alias("away_team")).agg(F.count("*").alias("n"))
    return ok.unionByName(bad)


def unresolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lost = resolve.resolve_matchups(domain.raw_offers(spark, sf_dir).where("start_time is not null"), domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir))
    return lost.select("seq", "reason_code", "candidate_count", F.size("candidate_matchups").alias("shown"), F.size("available_matchups_same_slot").alias("at_slot"))


def autocreate_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = domain.raw_offers(spark, sf_dir)
    return resolve.autocreate_names(raw, domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir))


def create_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = domain.raw_offers(spark, sf_dir).select("sport", F.col("home_team").alias("display_name"), "seq")
    return registry.create_teams(domain.teams(spark, sf_dir), names).select("team_id", "sport", "display_name")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir)
    out = resolve.normalized_odds(r, resolve.event_votes(r))
    return out.select("seq", "match_id", "bookmaker_id", "league_id", "home_team", "away_team", "market_type", "threshold")


def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir).where(~resolve.shared_platform())
    return resolve.review_cases(r, resolve.event_votes(r), domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir))


def auto_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir).where(~resolve.shared_platform())
    cases = resolve.review_cases(r, resolve.event_votes(r), domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir))
    past = cases.where("suggested_team_id is not null and bookmaker_id = 'b0'").select("sport", identity_text(F.col("raw_team_name")).alias("norm"), F.col("suggested_team_id").alias("team_id"), "start_time", "bookmaker_id", F.when(F.col("suggested_team_id") == 4, "declined").otherwise("pending").alias("status"))
    return resolve.auto_aliases(cases, past)


def team_candidates_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domain.raw_offers(spark, sf_dir).select("sport", F.col("home_team").alias("label"))
    found = registry.search_candidates(labels, domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir))
    return found.select("label", F.explode("candidates").alias("c")).select("label", "c.place", "c.team_id", "c.team_name", "c.score", "c.matched_alias")


def merge_teams_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.sql("select * from values (3L, 4L), (7L, 1L) as t(source_id, target_id)")
    _, after = registry.merge_teams(domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir), mapping)
    return after.select("normalized_alias", "bookmaker_id", "source", "team_id")


def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = domain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") - 1).cast("long").alias("merged_into"))
    return registry.follow_merges(edges)


def alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = domain.aliases(spark, sf_dir)
    changes = a.where("alias_id % 3 = 0").withColumn("alias_id", F.col("alias_id") + 1000).withColumn("team_id", F.col("team_id") + 1).withColumn("source", F.when(F.col("alias_id") % 2 == 0, "auto_review").otherwise("manual"))
    return registry.upsert_aliases(a, changes).drop("sport")


_BOTH = "start_time is not null and home_id is not null and away_id is not null and home_id <> away_id"
_MATCHUPS = RESOLVED_SQL + f""",
votes as (select sport, start_time, least(home_id, away_id) as low_id, greatest(home_id, away_id) as high_id, home_id, away_id, max(home_name) as home_name, max(away_name) as away_name, count(*) as n from resolved where not shared and {_BOTH} group by 1, 2, 3, 4, 5, 6),
matchups as (select * exclude (n, k) from (select *, row_number() over (partition by sport, start_time, low_id, high_id order by n desc, home_id, away_id) as k from votes) where k = 1)"""


def _inferred(cond: str) -> str:
    return f""",
used as (select start_time, home_id as id from matchups where {cond} union select start_time, away_id from matchups where {cond}),
free as (select distinct start_time, home_id as id, home_name as name from resolved r where shared and start_time is not null and home_id is not null and not exists (select 1 from used u where u.start_time = r.start_time and u.id = r.home_id)),
inferred as (
  select 'basketball' as sport, start_time, min(id) as low_id, max(id) as high_id, first(id order by name, id) as home_id, last(id order by name, id) as away_id, first(name order by name, id) as home_name, last(name order by name, id) as away_name
  from free group by start_time having count(*) = 2)"""


_SLOTS = _MATCHUPS + _inferred("true") + """,
every as (select sport, start_time, low_id, high_id, home_id, away_id, home_name, away_name from matchups union all select * from inferred),
sides as (select start_time, home_id as team, home_name, away_name from every union all select start_time, away_id, home_name, away_name from every),
cand as (select start_time, team, count(*) as n, any_value(home_name) as home_name, any_value(away_name) as away_name from sides group by 1, 2)"""
_VOTES = RESOLVED_SQL + f""",
base as (select *, least(home_id, away_id) as low_id, greatest(home_id, away_id) as high_id, replace({IDENTITY.format(x='league_id')}, ' ', '_') as lg from resolved where {_BOTH}),
eo as (select sport, start_time, low_id, high_id, home_id, away_id, count(*) as n from base group by all),
el as (select sport, start_time, low_id, high_id, lg, count(*) as n from base group by all),
ev as (
  select o.*, l.league_id, case when o.k = 1 and l.k = 1 then 'high' else 'medium' end as confidence
  from (select sport, start_time, low_id, high_id, first(home_id order by n desc, home_id, away_id) as home_id, first(away_id order by n desc, home_id, away_id) as away_id, count(*) as k, sum(n)::bigint as votes from eo group by 1, 2, 3, 4) o
  join (select sport, start_time, low_id, high_id, first(lg order by n desc, lg) as league_id, count(*) as k from el group by 1, 2, 3, 4) l using (sport, start_time, low_id, high_id))"""

QUERIES = {
    "alias_resolution": alias_resolution,
    "league_resolution": league_resolution,
    "alias_prefix_conflict": alias_prefix_conflict,
    "missing_start_split": missing_start_split,
    "canonical_matchup": canonical_matchup,
    "inferred_matchup": inferred_matchup,
    "event_vote": event_vote,
    "league_vote": league_vote,
    "shared_platform_resolve": shared_platform_resolve,
    "unresolved_candidates": unresolved_candidates,
    "autocreate_teams": autocreate_teams,
    "create_teams": create_teams,
    "normalized_odds": normalized,
    "review_cases": review_cases,
    "auto_approval": auto_approval,
    "team_candidates_top3": team_candidates_top3,
    "merge_teams_repoint": merge_teams_repoint,
    "merge_chain": merge_chain,
    "alias_upsert": alias_upsert,
}

ORACLES = {
    "alias_resolution": f"with {RESOLVED_SQL} select bookmaker_id, label, team_id, team_name, source from res",
    "league_resolution": f"""with {RAW_SQL},
leagues as (select * from (values ('league_0', 'First League'), ('aba', 'ABA League')) t(id, name)), known as (select * from (values ('', 'league 1', 'aba'), ('b2', 'league 0', 'aba')) t(bookmaker_id, alias, league_id)),
l as (select distinct bookmaker_id, league_id as label, replace({IDENTITY.format(x='league_id')}, ' ', '_') as k from raw),
f as (select l.*, coalesce(o.league_id, g.league_id, d.id, l.k) as league_id from l left join known o on o.bookmaker_id = l.bookmaker_id and o.alias = replace(l.k, '_', ' ') and o.bookmaker_id <> '' left join known g on g.bookmaker_id = '' and g.alias = replace(l.k, '_', ' ') left join leagues d on d.id = l.k)
select f.bookmaker_id, f.label, f.league_id, coalesce(n.name, array_to_string(list_transform(list_filter(string_split_regex(f.league_id, '[_-]'), lambda w: w <> ''), lambda w: case when length(w) <= 4 and regexp_matches(w, '^[[:alpha:]]+$') then upper(w) else upper(w[1:1]) || lower(w[2:]) end), ' ')) as league_name
from f left join leagues n on n.id = f.league_id""",
    "alias_prefix_conflict": f"""with {REGISTRY_SQL}, r as (select 'basketball' as sport, regexp_replace(normalized_alias, '[0-9]+', '#', 'g') as normalized_alias, bookmaker_id, team_id from aliases)
select sport, normalized_alias, bookmaker_id from r where team_id = 3 intersect select sport, normalized_alias, bookmaker_id from r where team_id = 5""",
    "missing_start_split": f"with {RAW_SQL} select case when start_time is null then 'missing_start_time' else 'timed' end as reason_code, market_type, count(*) as n from raw group by all",
    "canonical_matchup": f"with {_MATCHUPS} select sport, start_time, low_id, high_id, home_id, away_id, home_name, away_name from matchups",
    "inferred_matchup": f"with {_MATCHUPS}{_inferred('''start_time < '1998' ''')} select * from inferred",
    "event_vote": f"with {_VOTES} select sport, start_time, low_id, high_id, home_id, away_id, league_id, confidence, votes from ev",
    "league_vote": f"with {_VOTES} select sport, start_time, low_id, high_id, string_agg(lg || ' x' || n, ', ' order by n desc, lg) as evidence from el group by 1, 2, 3, 4",
    "shared_platform_resolve": f"""with {_SLOTS},
p as (select r.home_name as team_name, c.* exclude (start_time, team) from resolved r left join cand c on r.start_time = c.start_time and r.home_id = c.team where r.shared and r.start_time is not null)
select case when n = 1 then 'resolved' when n > 1 then 'ambiguous_multiple_matchups_for_team_at_slot' else 'no_canonical_matchup_for_team_at_slot' end as outcome,
       case when n = 1 then home_name else team_name end as home_team, case when n = 1 then away_name else '' end as away_team, count(*) as n from p group by 1, 2, 3""",
    "unresolved_candidates": f"""with {_SLOTS}, slot as (select start_time, count(*) as k from every group by 1)
select r.seq, case when c.n > 1 then 'ambiguous_multiple_matchups_for_team_at_slot' else 'no_canonical_matchup_for_team_at_slot' end as reason_code, coalesce(c.n, 0) as candidate_count, least(coalesce(c.n, 0), 8) as shown, least(coalesce(s.k, 0), 12) as at_slot
from resolved r left join cand c on r.start_time = c.start_time and r.home_id = c.team left join slot s on s.start_time = r.start_time where r.shared and r.start_time is not null and coalesce(c.n, 0) <> 1""",
    "autocreate_teams": f"""with {RESOLVED_SQL},
b as (select * from (select *, {IDENTITY.format(x='home_team')} as hk, {IDENTITY.format(x='away_team')} as ak from resolved where not shared and start_time is not null) where hk <> '' and ak <> '' and hk <> ak),
seen as (select sport, start_time, least(hk, ak) as k1, greatest(hk, ak) as k2, min(seq) as seq from b group by 1, 2, 3, 4 having count(*) >= 2),
names as (select sport, k, name, count(*) as n from (select sport, hk as k, trim(home_team) as name from b union all select sport, ak, trim(away_team) from b) group by all),
shown as (select sport, k, first(name order by n desc, length(name) desc, name desc) as display_name from names group by 1, 2),
full_ as (select start_time, home_id as id from b where home_id is not null and away_id is not null union select start_time, away_id from b where home_id is not null and away_id is not null),
anchored as (select distinct b.start_time, least(hk, ak) as k1, greatest(hk, ak) as k2, case when home_id is null then hk else ak end as k from b join full_ f on f.start_time = b.start_time and f.id = coalesce(home_id, away_id) where (home_id is null) <> (away_id is null)),
sides as (select *, k1 as k from seen union all select *, k2 from seen),
free as (select sport, k, min(seq) as seq from sides s where not exists (select 1 from anchored a where a.start_time = s.start_time and a.k1 = s.k1 and a.k2 = s.k2 and a.k = s.k) group by 1, 2)
select f.sport, s.display_name, f.seq from free f join shown s using (sport, k)
where not exists (select 1 from aliases a join teams t using (team_id) where t.is_active and a.bookmaker_id = '' and a.normalized_alias = {IDENTITY.format(x='s.display_name')})""",
    "create_teams": f"""with {RAW_SQL}, {REGISTRY_SQL},
f as (select sport, {IDENTITY.format(x='home_team')} as k, arg_min(home_team, seq) as display_name, min(seq) as seq from raw group by 1, 2)
select 25 + row_number() over (order by seq, sport, display_name) as team_id, sport, display_name from f where k not in (select {IDENTITY.format(x='display_name')} from teams)""",
    "normalized_odds": f"""with {_VOTES}
select b.seq, substr(md5(b.sport || ':' || b.start_time || ':' || ev.home_id || ':' || ev.away_id), 1, 12) as match_id, b.bookmaker_id, ev.league_id, case when ev.home_id = b.home_id then b.home_name else b.away_name end as home_team,
       case when ev.home_id = b.home_id then b.away_name else b.home_name end as away_team, case b.market_type when 'points' then 'player_points' else 'game_total_ot' end as market_type, b.threshold
from base b join ev using (sport, start_time, low_id, high_id)""",
    "merge_teams_repoint": f"""with {REGISTRY_SQL}, m as (select * from (values (3, 4), (7, 1)) t(source_id, target_id)),
moved as (select a.alias_id, a.normalized_alias, a.bookmaker_id, a.source, coalesce(m.target_id, a.team_id) as team_id, m.target_id is not null as moved from aliases a left join m on a.team_id = m.source_id),
kept as (select * exclude (n, moved) from (select *, row_number() over (partition by normalized_alias, bookmaker_id order by moved, alias_id) as n from moved) where n = 1),
named as (select {IDENTITY.format(x='t.display_name')} as normalized_alias, m.target_id from teams t join m on t.team_id = m.source_id)
select normalized_alias, bookmaker_id, source, team_id from kept
union all select n.normalized_alias, '', 'merge', n.target_id from named n where not exists (select 1 from kept k where k.normalized_alias = n.normalized_alias and k.bookmaker_id = '')""",
    "merge_chain": """with recursive e as (select n_nationkey as team_id, case when n_nationkey % 5 <> 0 then n_nationkey - 1 end as into_ from nation),
w as (select team_id, team_id as here, into_ from e union all select w.team_id, e.team_id, e.into_ from w join e on e.team_id = w.into_)
select team_id, here as final_id from w where into_ is null""",
    "alias_upsert": f"""with {REGISTRY_SQL}, c as (select alias_id + 1000 as alias_id, normalized_alias, bookmaker_id, case when (alias_id + 1000) % 2 = 0 then 'auto_review' else 'manual' end as source, team_id + 1 as team_id from aliases where alias_id % 3 = 0),
u as (select *, false as late from aliases union all select *, true from c)
select alias_id, normalized_alias, bookmaker_id, source, team_id from (select *, row_number() over (partition by normalized_alias, bookmaker_id order by (late and source <> 'auto_review') desc, (not late) desc, alias_id desc) as n from u) where n = 1""",
}
