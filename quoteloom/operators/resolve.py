"""Entity resolution of raw quotes, pass by pass.

Raw quotes have ``seq, bookmaker_id, league_id, sport, home_team, away_team,
market_type, player_name, threshold, over_odds, under_odds, start_time``;
``seq`` is their total order.  A *shared-platform prop* carries the player in
the away team.  A *slot* is a sport and an exact start time; an *event* is a
slot and a pair of teams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.odds import match_id
from ..functions.text import identity_text, market_type, matchup
from .players import known_names, resolve_players
from .registry import bounded, checkpointed, search_candidates, with_teams

RAW = ("seq", "bookmaker_id", "league_id", "sport", "home_team", "away_team", "market_type", "player_name", "threshold", "over_odds", "under_odds", "start_time")
REVIEW_LEAST = 76.0


def shared_platform() -> Column:
    """C-22."""
    return F.coalesce((F.col("player_name") != "") & (F.trim("away_team") == F.trim("player_name")), F.lit(False))


def split_missing_start(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D-10: quotes with a start time, and diagnostics of those without."""
    missing = raw.where("start_time is null").select("seq", "bookmaker_id", "league_id", "sport", "market_type", "player_name", F.col("home_team").alias("raw_team_name"), F.lit("missing_start_time").alias("reason_code"), F.lit(0).alias("candidate_count"))
    return raw.where("start_time is not null"), missing


def both_known() -> Column:
    return F.col("home_id").isNotNull() & F.col("away_id").isNotNull() & (F.col("home_id") != F.col("away_id"))


def _event() -> list[Column]:
    return [F.col("sport"), F.col("start_time"), F.least("home_id", "away_id").alias("low_id"), F.greatest("home_id", "away_id").alias("high_id")]


def canonical_matchups(resolved: DataFrame, count: Column | None = None) -> DataFrame:
    """F-08: the voted orientation of each event: most frequent, then smallest ids.  ``resolved`` comes from ``with_teams``; ``count`` sums its quotes if a row stands for several."""
    votes = resolved.where(~shared_platform() & F.col("start_time").isNotNull() & both_known()).groupBy(*_event(), "home_id", "away_id").agg((F.count("*") if count is None else count).alias("n"), F.min("seq").alias("seen"), F.max("home_name").alias("home_name"), F.max("away_name").alias("away_name"))
    best = votes.groupBy("sport", "start_time", "low_id", "high_id").agg(F.min_by(F.struct("home_id", "away_id", "home_name", "away_name"), F.struct(-F.col("n"), "home_id", "away_id")).alias("m"), F.min("seen").alias("seen"))
    return best.select("sport", "start_time", "low_id", "high_id", "m.*", "seen")


def inferred_matchups(resolved: DataFrame, known: DataFrame) -> DataFrame:
    """F-09 and J-21: a slot's two teams that only props name, as a matchup; home is the first name in order."""
    teams = resolved.where(shared_platform() & F.col("start_time").isNotNull() & F.col("home_id").isNotNull()).select("sport", "start_time", "home_id", "home_name").distinct()
    used = known.select("sport", "start_time", F.explode(F.array("home_id", "away_id")).alias("home_id")).distinct()
    free = teams.join(used, ["sport", "start_time", "home_id"], "left_anti")
    pairs = free.groupBy("sport", "start_time").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("home_name", "home_id"))).alias("t")).where("n = 2")
    first, second = F.col("t")[0], F.col("t")[1]
    return pairs.select(
        "sport", "start_time", F.least(first["home_id"], second["home_id"]).alias("low_id"), F.greatest(first["home_id"], second["home_id"]).alias("high_id"),
        first["home_id"].alias("home_id"), second["home_id"].alias("away_id"), first["home_name"].alias("home_name"), second["home_name"].alias("away_name"), F.lit(2**62).alias("seen"),
    )


def resolve_matchups(raw: DataFrame, teams: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pass 3: quotes with the voted orientation (J-17) and props with their matchup (J-16); diagnostics of props without exactly one.

    The matchups are found among counted kinds of quotes, which are far fewer.
    """
    resolved = with_teams(raw, teams, aliases)
    kinds = raw.groupBy("sport", "bookmaker_id", "start_time", "home_team", "away_team", "player_name").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    named = checkpointed(with_teams(kinds, teams, aliases))
    known = bounded(canonical_matchups(named, F.sum("n")))
    every = checkpointed(known.unionByName(inferred_matchups(named, known)))
    plain = resolved.where(~shared_platform())
    m = known.select(F.col("sport").alias("m_sport"), F.col("start_time").alias("m_start"), F.col("low_id").alias("m_low"), F.col("high_id").alias("m_high"), F.col("home_name").alias("m_home"), F.col("away_name").alias("m_away"))
    on = (F.col("sport") == F.col("m_sport")) & (F.col("start_time") == F.col("m_start")) & (F.least("home_id", "away_id") == F.col("m_low")) & (F.greatest("home_id", "away_id") == F.col("m_high")) & both_known()
    turned = plain.join(m, on, "left").withColumn("home_team", F.coalesce("m_home", "home_team")).withColumn("away_team", F.coalesce("m_away", "away_team")).select(*RAW)
    props = resolved.where(shared_platform())
    sides = every.select("sport", "start_time", F.explode(F.array("home_id", "away_id")).alias("team"), F.struct("seen", "home_name", "away_name").alias("entry"))
    listed = bounded(sides.groupBy("sport", "start_time", "team").agg(F.array_sort(F.collect_list("entry")).alias("mine")))
    slot = bounded(every.groupBy("sport", "start_time").agg(F.array_sort(F.collect_list(F.struct("seen", "home_name", "away_name"))).alias("slot")))
    joined = props.join(listed.withColumnRenamed("team", "home_id"), ["sport", "start_time", "home_id"], "left").join(slot, ["sport", "start_time"], "left")
    count = F.coalesce(F.size("mine"), F.lit(0))
    found = joined.where(F.size("mine") == 1).withColumn("home_team", F.col("mine")[0]["home_name"]).withColumn("away_team", F.col("mine")[0]["away_name"]).select(*RAW)
    shown = lambda c, n: F.transform(F.slice(F.coalesce(c, F.array().cast("array<struct<seen:bigint,home_name:string,away_name:string>>")), 1, n), lambda x: matchup(x["home_name"], x["away_name"]))
    lost = joined.where(~F.coalesce(F.size("mine") == 1, F.lit(False))).select(
        "seq", "bookmaker_id", "league_id", "sport", "market_type", "player_name", F.col("home_team").alias("raw_team_name"), F.col("home_name").alias("normalized_team_name"), "start_time", "threshold",
        F.when(F.coalesce(F.size("mine"), F.lit(0)) > 1, "ambiguous_multiple_matchups_for_team_at_slot").otherwise("no_canonical_matchup_for_team_at_slot").alias("reason_code"),
        F.greatest(count, F.lit(0)).alias("candidate_count"), shown(F.col("mine"), 8).alias("candidate_matchups"), shown(F.col("slot"), 12).alias("available_matchups_same_slot"),
    )
    return turned.unionByName(found), lost


def event_votes(resolved: DataFrame) -> DataFrame:
    """F-05 to F-07: each event's orientation, league and confidence.  ``resolved`` has team ids and ``voted_league``."""
    base = resolved.where(F.col("start_time").isNotNull() & both_known())
    key = ["sport", "start_time", "low_id", "high_id"]
    ways = base.groupBy(*_event(), "home_id", "away_id").agg(F.count("*").alias("n"))
    way = ways.groupBy(*key).agg(F.min_by(F.struct("home_id", "away_id"), F.struct(-F.col("n"), "home_id", "away_id")).alias("o"), F.count("*").alias("orientations"), F.sum("n").alias("votes"))
    tallies = base.groupBy(*_event(), "voted_league").agg(F.count("*").alias("n"))
    tally = tallies.groupBy(*key).agg(F.min_by("voted_league", F.struct(-F.col("n"), "voted_league")).alias("league_id"), F.count("*").alias("leagues"))
    confidence = F.when((F.col("orientations") == 1) & (F.col("leagues") <= 1), "high").otherwise("medium")
    return way.join(tally, key).select(*key, "o.home_id", "o.away_id", "league_id", confidence.alias("confidence"), "votes")


def league_evidence(resolved: DataFrame) -> DataFrame:
    """F-07: ``league xN`` of each event, most votes first, then by name."""
    counted = resolved.where(F.col("start_time").isNotNull() & both_known()).groupBy(*_event(), "voted_league").agg(F.count("*").alias("n"))
    entry = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "voted_league")))
    return counted.groupBy("sport", "start_time", "low_id", "high_id").agg(F.array_join(F.transform(entry, lambda e: F.concat(e["voted_league"], F.lit(" x"), (-e["k"]).cast("string"))), ", ").alias("evidence"))


def autocreate_names(raw: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pass 2 (F-10, J-22): ``sport, display_name, seq`` of teams to create from matchups seen twice or more at one slot.

    A side is left to review if its counterpart is known and also appears in a
    fully known matchup of the same slot.
    """
    quotes = raw.where(~shared_platform() & F.col("start_time").isNotNull()).groupBy("sport", "bookmaker_id", "start_time", "home_team", "away_team").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    base = checkpointed(quotes.withColumn("home_key", identity_text(F.col("home_team"))).withColumn("away_key", identity_text(F.col("away_team"))).where("home_key <> '' and away_key <> '' and home_key <> away_key"))
    resolved = with_teams(base, teams, aliases)
    pair = [F.col("sport"), F.col("start_time"), F.least("home_key", "away_key").alias("key1"), F.greatest("home_key", "away_key").alias("key2")]
    seen = resolved.groupBy(*pair).agg(F.sum("n").alias("n"), F.min("seq").alias("seq")).where("n >= 2")
    names = base.select("sport", "n", F.explode(F.array(F.struct(F.col("home_key").alias("key"), F.trim("home_team").alias("name")), F.struct(F.col("away_key").alias("key"), F.trim("away_team").alias("name")))).alias("t")).groupBy("sport", "t.key", "t.name").agg(F.sum("n").alias("count"))
    shown = names.groupBy("sport", "key").agg(F.max_by("name", F.struct("count", F.length("name"), "name")).alias("display_name"))
    full = resolved.where("home_id is not null and away_id is not null").select("sport", "start_time", F.explode(F.array("home_id", "away_id")).alias("known")).distinct()
    half = resolved.where("(home_id is null) <> (away_id is null)").select(*pair, F.coalesce("home_id", "away_id").alias("known"), F.when(F.col("home_id").isNull(), F.col("home_key")).otherwise(F.col("away_key")).alias("key"))
    anchored = half.join(full, ["sport", "start_time", "known"], "left_semi").select("sport", "start_time", "key1", "key2", "key").distinct()
    sides = seen.select("sport", "start_time", "key1", "key2", "seq", F.explode(F.array("key1", "key2")).alias("key"))
    free = sides.join(anchored, ["sport", "start_time", "key1", "key2", "key"], "left_anti").groupBy("sport", "key").agg(F.min("seq").alias("seq")).join(shown, ["sport", "key"])
    labels = free.select("sport", F.lit("").alias("bookmaker_id"), F.col("display_name").alias("label"))
    from .registry import resolve_labels

    known = resolve_labels(labels, teams, aliases).select("sport", F.col("label").alias("display_name"))
    return free.join(known, ["sport", "display_name"], "left_anti").select("sport", "display_name", "seq")


def normalized_odds(resolved: DataFrame, votes: DataFrame) -> DataFrame:
    """Pass 6 (J-18, C-05, C-12, C-13): final quotes with match id, voted orientation, canonical market and players' known names; quotes with unknown teams drop out."""
    sides = [F.least("home_id", "away_id").alias("low_id"), F.greatest("home_id", "away_id").alias("high_id")]
    base = known_names(resolved.where(F.col("start_time").isNotNull() & both_known()).select("*", *sides))
    v = bounded(votes.select("sport", "start_time", "low_id", "high_id", F.col("home_id").alias("h"), F.col("away_id").alias("a"), F.col("league_id").alias("voted")))
    out = base.join(v, ["sport", "start_time", "low_id", "high_id"])
    straight = F.col("h") == F.col("home_id")
    return out.select(
        match_id(F.col("sport"), F.col("start_time"), F.col("h"), F.col("a")).alias("match_id"), "bookmaker_id", F.col("voted").alias("league_id"), "sport",
        F.col("h").alias("home_team_id"), F.col("a").alias("away_team_id"),
        F.when(straight, F.col("home_name")).otherwise(F.col("away_name")).alias("home_team"), F.when(straight, F.col("away_name")).otherwise(F.col("home_name")).alias("away_team"),
        market_type(F.col("market_type")).alias("market_type"), "player_name", "threshold", "over_odds", "under_odds", "start_time", "seq",
    )


def contextual_players(resolved: DataFrame) -> DataFrame:
    """Pass 4: quotes with the players' names of their match; a quote's match is that of its own orientation."""
    own = match_id(F.col("sport"), F.col("start_time"), F.col("home_id"), F.col("away_id"))
    placed = resolved.withColumn("match_id", F.when(F.col("start_time").isNotNull() & both_known(), own))
    return resolve_players(placed).drop("match_id")


def review_cases(resolved: DataFrame, votes: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pass 7: one case per unknown label, bookmaker, slot and known counterpart, the first in order (W-05).

    A unique event of the counterpart at the slot suggests its other team
    (high); several are ranked by score (medium); otherwise the whole registry
    is searched (medium from ``REVIEW_LEAST`` on, else low).
    """
    side = lambda me, other: F.struct(F.col(f"{me}_team").alias("label"), F.col(f"{me}_id").alias("id"), F.col(f"{other}_id").alias("other_id"), F.col(f"{other}_name").alias("other_name"), F.lit(0 if me == "home" else 1).alias("turn"))
    sides = resolved.where("start_time is not null").select("seq", "bookmaker_id", "sport", "start_time", "league_id", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("t"))
    open_ = sides.where("t.id is null").select("seq", "bookmaker_id", "sport", "start_time", "league_id", "t.label", "t.other_id", F.when(F.col("t.other_id").isNotNull(), F.col("t.other_name")).alias("counterpart"), "t.turn")
    kinds = open_.groupBy("bookmaker_id", "sport", "start_time", "label", "counterpart").agg(F.min_by(F.struct("seq", "turn", "league_id", "other_id"), F.struct("seq", "turn")).alias("k"))
    first = kinds.select("bookmaker_id", "sport", "start_time", "label", "counterpart", "k.*", identity_text(F.col("label")).alias("norm")).groupBy("bookmaker_id", "sport", "norm", "start_time", F.coalesce("counterpart", F.lit("")).alias("cp")).agg(F.min_by(F.struct("label", "other_id", "counterpart", "league_id", "seq"), F.struct("seq", "turn")).alias("f"))
    cases = checkpointed(first.select("bookmaker_id", "sport", "start_time", "norm", "cp", "f.*"))
    names = teams.select(F.col("team_id").alias("n_id"), F.col("display_name").alias("cand_name"))
    options = votes.select("sport", "start_time", F.explode(F.array(F.struct(F.col("home_id").alias("other_id"), F.col("away_id").alias("cand_id")), F.struct(F.col("away_id").alias("other_id"), F.col("home_id").alias("cand_id")))).alias("o")).select("sport", "start_time", "o.*").distinct()
    options = options.join(names, F.col("cand_id") == F.col("n_id")).drop("n_id")
    from ..functions.fuzzy import team_score

    pairs = cases.join(options, ["sport", "start_time", "other_id"]).withColumn("cand_key", identity_text(F.col("cand_name"))).where("cand_key <> norm and cand_key <> ''")
    pairs = checkpointed(pairs)
    scores = checkpointed(pairs.select("norm", "cand_key").distinct().repartition("norm", "cand_key").withColumn("score", F.round(team_score(F.col("norm"), F.col("cand_key")), 6)))
    scored = pairs.join(scores, ["norm", "cand_key"])  # each two names are compared once
    order = W.partitionBy("bookmaker_id", "sport", "norm", "start_time", "cp").orderBy(F.desc("score"), "cand_name")
    local = scored.withColumn("place", F.row_number().over(order)).groupBy("bookmaker_id", "sport", "norm", "start_time", "cp").agg(F.count("*").alias("n"), F.min_by(F.struct(F.col("cand_id").alias("team_id"), F.col("cand_name").alias("team_name"), "score"), "place").alias("local"))
    wide = search_candidates(cases, teams, aliases).select("sport", "label", F.element_at("candidates", 1).alias("wide"))
    out = cases.join(local, ["bookmaker_id", "sport", "norm", "start_time", "cp"], "left").join(wide, ["sport", "label"], "left")
    best = lambda c: F.coalesce(F.col(f"local.{c}"), F.col(f"wide.{c}"))
    return out.select(
        "bookmaker_id", "sport", "start_time", "league_id", F.col("label").alias("raw_team_name"), "counterpart", best("team_id").alias("suggested_team_id"), best("team_name").alias("suggested_team_name"), best("score").alias("similarity_score"),
        F.when(F.col("n") == 1, "alias_suggestion").otherwise("candidate_search").alias("review_kind"),
        F.when(F.col("n") == 1, "high").when(F.col("n") > 1, "medium").when(F.col("wide.score") >= REVIEW_LEAST, "medium").otherwise("low").alias("confidence"),
        F.when(F.col("counterpart").isNotNull(), "candidate_team_match_same_start_time").otherwise("candidate_team_search").alias("reason_code"),
    )


def auto_aliases(cases: DataFrame, history: DataFrame) -> DataFrame:
    """U-17 (D-11, J-23, F-16): anchored suggestions to approve: seen before by the same book, or by two books, and never declined.

    ``history``: ``sport, norm, team_id, start_time, bookmaker_id, status`` of earlier cases.
    """
    eligible = cases.where("review_kind = 'alias_suggestion' and confidence = 'high' and suggested_team_id is not null and counterpart is not null").withColumn("norm", identity_text(F.col("raw_team_name")))
    key = ["sport", "norm", "team_id", "start_time"]
    now = eligible.withColumnRenamed("suggested_team_id", "team_id").groupBy(*key).agg(F.collect_set("bookmaker_id").alias("books"))
    past = history.groupBy(*key).agg(F.collect_set("bookmaker_id").alias("past"), F.bool_or(F.col("status") == "declined").alias("declined"))
    joined = now.join(past, key, "left").withColumn("past", F.coalesce("past", F.array().cast("array<string>")))
    ok = ~F.coalesce("declined", F.lit(False)) & (F.arrays_overlap("books", "past") | (F.size(F.array_union("books", "past")) >= 2))
    return joined.where(ok).select(*key, F.explode("books").alias("bookmaker_id"))
