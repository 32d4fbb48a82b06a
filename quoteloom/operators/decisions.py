"""Decisions on teams: aliases to remember, review cases to settle, merges and what follows from them.

All work on whole batches: a request is a row, and so is its outcome.
Review cases are ``id, sport, bookmaker_id, raw_team_name, suggested_team_id,
suggested_team_name, candidate_teams, status, approved_at``, where
``candidate_teams`` is an array of ``struct<team_id, team_name, score,
matched_alias>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_text, scope_key
from .registry import checkpointed, create_teams, follow_merges, numbered, resolve_labels

#: Status code of each outcome, as an API would answer.
CODES = {
    "approved": 200, "declined": 200, "unknown_case": 404, "unknown_team": 404, "two_choices": 400, "no_choice": 400, "other_sport": 400, "blank": 400, "circular": 409, "conflict": 409,
}


def judge_aliases(teams: DataFrame, aliases: DataFrame, requests: DataFrame) -> DataFrame:
    """U-13: ``requests`` with ``key, scope, target_id, target_name, outcome``.

    ``requests``: ``request_id, sport, bookmaker_id, raw_team_name, team_name,
    source``.  Outcomes: ``blank`` (a name has no letters or digits),
    ``unknown_team``, ``circular`` (the label is its target's own name, though
    the target was asked for by another), ``conflict`` (the label already stands
    for another team, or an earlier request of the batch wants it to), ``kept``
    (an automatic request for an alias that exists) and ``saved``.
    """
    asked = requests.withColumn("key", identity_text(F.col("raw_team_name"))).withColumn("wanted", identity_text(F.col("team_name"))).withColumn("scope", scope_key(F.col("bookmaker_id")))
    labels = requests.select("sport", "bookmaker_id", F.explode(F.array("raw_team_name", "team_name")).alias("label"))
    known = checkpointed(resolve_labels(labels, teams, aliases))

    def found(side: str, prefix: str) -> DataFrame:
        named = known.select(F.col("sport").alias("_s"), F.col("bookmaker_id").alias("_b"), F.col("label").alias("_l"), F.col("team_id").alias(f"{prefix}_id"), F.col("team_name").alias(f"{prefix}_name"))
        on = (F.col("sport") == F.col("_s")) & F.col("bookmaker_id").eqNullSafe(F.col("_b")) & (F.col(side) == F.col("_l"))
        return asked.join(named, on, "left").drop("_s", "_b", "_l")

    asked = found("team_name", "target")
    asked = found("raw_team_name", "now")
    taken = asked.where("target_id is not null and key <> ''").groupBy("sport", "key", "scope").agg(F.min_by("target_id", "request_id").alias("first_target"))
    asked = asked.join(taken, ["sport", "key", "scope"], "left")
    blank = (F.col("key") == "") | (F.col("wanted") == "")
    circular = (F.col("key") == identity_text(F.col("target_name"))) & (F.col("wanted") != F.col("key"))
    outcome = (
        F.when(blank, "blank").when(F.col("target_id").isNull(), "unknown_team").when(circular, "circular")
        .when(F.col("now_id").isNotNull() & (F.col("now_id") != F.col("target_id")), "conflict")
        .when(F.col("first_target") != F.col("target_id"), "conflict")
        .when(F.col("now_id").isNotNull() & (F.col("source") == "auto_review"), "kept").otherwise("saved")
    )
    return asked.withColumn("outcome", outcome).drop("wanted", "now_id", "now_name", "first_target")


def remember_aliases(teams: DataFrame, aliases: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U-13, U-12: outcomes of the requests, and the alias table after those that are saved."""
    judged = checkpointed(judge_aliases(teams, aliases, requests))
    saved = judged.where("outcome = 'saved'").groupBy("sport", F.col("key").alias("normalized_alias"), F.col("scope").alias("bookmaker_id")).agg(F.min_by(F.struct("source", "target_id"), "request_id").alias("r"))
    saved = saved.select("sport", "normalized_alias", "bookmaker_id", "r.source", F.col("r.target_id").alias("team_id"))
    key = ["sport", "normalized_alias", "bookmaker_id"]
    fresh = numbered(saved, key, "alias_id", aliases, "alias_id").select(*aliases.columns)
    return judged, aliases.join(saved.select(*key), key, "left_anti").select(*aliases.columns).unionByName(fresh)


def settle_reviews(cases: DataFrame, decisions: DataFrame, teams: DataFrame, aliases: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """U-21, U-08: outcomes, and cases, teams and aliases after the decisions.

    ``decisions``: ``case_id, action`` (approve or decline) ``, team_id,
    create_team_name``.  An approval takes the chosen team (through its merges),
    else a team of the given name, created if need be, else the suggestion.
    Outcomes are ``case_id, outcome, code, team_id, team_name``; refused ones
    change nothing, and the first approval's time stays.
    """
    mine = cases.select(F.col("id").alias("case_id"), "sport", "bookmaker_id", "raw_team_name", "suggested_team_id", "suggested_team_name")
    asked = decisions.withColumn("create_team_name", F.when(F.trim("create_team_name") != "", F.trim("create_team_name"))).join(mine.withColumn("there", F.lit(True)), "case_id", "left")
    ends = follow_merges(teams.select("team_id", "merged_into")).select(F.col("team_id").alias("f_id"), "final_id")
    last = teams.select(F.col("team_id").alias("l_id"), F.col("sport").alias("l_sport"), F.col("display_name").alias("l_name"))
    chosen = asked.join(ends, F.col("team_id") == F.col("f_id"), "left").join(last, F.col("final_id") == F.col("l_id"), "left")
    refused = (
        F.when(F.col("there").isNull(), "unknown_case").when(F.col("action") == "decline", "declined")
        .when(F.col("team_id").isNotNull() & F.col("create_team_name").isNotNull(), "two_choices")
        .when(F.col("team_id").isNotNull() & F.col("l_id").isNull(), "unknown_team").when(F.col("team_id").isNotNull() & (F.col("l_sport") != F.col("sport")), "other_sport")
        .when(F.col("team_id").isNull() & F.col("create_team_name").isNull() & F.coalesce(F.col("suggested_team_name"), F.lit("")).eqNullSafe(""), "no_choice")
    )
    chosen = checkpointed(chosen.withColumn("refused", refused).withColumn("wanted", F.coalesce("create_team_name", "l_name", "suggested_team_name")))
    open_ = chosen.where("refused is null")
    new = create_teams(teams, open_.where("create_team_name is not null").select("sport", F.col("create_team_name").alias("display_name"), F.col("case_id").alias("seq")))
    every = checkpointed(teams.unionByName(new.select(*teams.columns)))
    named = checkpointed(with_canonical(every, aliases))
    requests = open_.select(F.col("case_id").alias("request_id"), "sport", "bookmaker_id", "raw_team_name", F.col("wanted").alias("team_name"), F.lit("manual_review").alias("source"))
    judged, after = remember_aliases(every, named, requests)
    answer = judged.select(F.col("request_id").alias("case_id"), F.when(F.col("outcome").isin("saved", "kept"), "approved").otherwise(F.col("outcome")).alias("judged"), "target_id", "target_name")
    outcome = F.coalesce("refused", "judged")
    table = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    ok = F.col("outcome") == "approved"
    outcomes = chosen.select("case_id", "refused").join(answer, "case_id", "left").withColumn("outcome", outcome)
    outcomes = checkpointed(outcomes.select("case_id", "outcome", table[F.col("outcome")].alias("code"), F.when(ok, F.col("target_id")).alias("team_id"), F.when(ok, F.col("target_name")).alias("team_name")))
    return outcomes, mark_reviews(cases, outcomes, stamp), every, after


def mark_reviews(cases: DataFrame, outcomes: DataFrame, stamp: str) -> DataFrame:
    """U-08, C-28: cases approved or declined; the time of the first approval stays."""
    done = outcomes.where("outcome in ('approved', 'declined')").select(F.col("case_id").alias("_id"), F.col("outcome").alias("_new"))
    joined = cases.join(done, F.col("id") == F.col("_id"), "left")
    approved = F.when(F.col("_new") == "approved", F.coalesce("approved_at", F.lit(stamp))).otherwise(F.col("approved_at"))
    new = {"status": F.coalesce("_new", "status"), "approved_at": approved}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in cases.columns))


def with_canonical(teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """The alias table with each active team's own name as a global alias, where that key is free."""
    own = teams.where("is_active").select("sport", identity_text(F.col("display_name")).alias("normalized_alias"), F.lit("").alias("bookmaker_id"), F.lit("canonical").alias("source"), "team_id").where("normalized_alias <> ''")
    one = own.groupBy("sport", "normalized_alias", "bookmaker_id", "source").agg(F.min("team_id").alias("team_id"))
    key = ["sport", "normalized_alias", "bookmaker_id"]
    missing = one.join(aliases.select(*key), key, "left_anti")
    return aliases.unionByName(numbered(missing, key, "alias_id", aliases, "alias_id").select(*aliases.columns))


def case_history(cases: DataFrame, like: dict[str, object], snapshot: str) -> DataFrame:
    """D-07: suggested and automatic aliases among the cases that agree with all columns of ``like`` (nulls with nulls), no later than the snapshot."""
    same = F.col("review_kind").isin("alias_suggestion", "auto_alias") & (F.col("scraped_at") <= snapshot)
    for column, value in like.items():
        same &= F.col(column).eqNullSafe(F.lit(value))
    return cases.where(same)


def collapse_candidates(candidates: Column) -> Column:
    """F-18: one candidate a team, with its best score and, where that one has none, another's matched alias; by score, then name."""
    ids = F.array_distinct(F.transform(candidates, lambda c: c["team_id"]))

    def one(team_id: Column) -> Column:
        of_team = F.filter(candidates, lambda c: c["team_id"] == team_id)
        best = F.reduce(of_team, of_team[0], lambda x, c: F.when(F.coalesce(c["score"], F.lit(0.0)) > F.coalesce(x["score"], F.lit(0.0)), c).otherwise(x))
        other = F.filter(F.transform(of_team, lambda c: c["matched_alias"]), lambda a: a.isNotNull())
        alias = F.coalesce(best["matched_alias"], F.try_element_at(other, F.lit(1)))
        return F.struct((-F.coalesce(best["score"], F.lit(0.0))).alias("rank"), best["team_name"].alias("team_name"), best["team_id"].alias("team_id"), best["score"].alias("score"), alias.alias("matched_alias"))

    ranked = F.array_sort(F.transform(ids, one))
    return F.transform(ranked, lambda c: F.struct(c["team_id"].alias("team_id"), c["team_name"].alias("team_name"), c["score"].alias("score"), c["matched_alias"].alias("matched_alias")))


def merge_problems(teams: DataFrame, mapping: DataFrame) -> DataFrame:
    """U-15: the pairs of a team merge that must not be merged, with the reason; no rows means go ahead."""
    side = lambda p: teams.select(F.col("team_id").alias(f"{p}_id"), F.col("sport").alias(f"{p}_sport"))
    both = mapping.join(side("s"), F.col("source_id") == F.col("s_id"), "left").join(side("t"), F.col("target_id") == F.col("t_id"), "left")
    reason = F.when(F.col("source_id") == F.col("target_id"), "same_team").when(F.col("s_id").isNull() | F.col("t_id").isNull(), "unknown_team").when(F.col("s_sport") != F.col("t_sport"), "other_sport")
    return both.select("source_id", "target_id", reason.alias("reason")).where("reason is not null")


def merge_log(mapping: DataFrame, stamp: str) -> DataFrame:
    """U-15: the rows that a merge adds to the history of merges."""
    return mapping.select("source_id", "target_id", F.lit(stamp).alias("merged_at"))


def repoint_reviews(cases: DataFrame, mapping: DataFrame, teams: DataFrame) -> DataFrame:
    """U-15: pending cases whose suggestion or candidates name a merged team, rewritten to its target."""
    names = teams.select(F.col("team_id").alias("_t"), F.col("display_name").alias("_n"))
    pairs = mapping.join(names, F.col("target_id") == F.col("_t")).select("source_id", "target_id", F.col("_n").alias("target_name"))
    touched = cases.where("status = 'pending'").select("id", "suggested_team_id", "candidate_teams")
    mentioned = touched.select("id", F.explode(F.array_distinct(F.concat(F.array("suggested_team_id"), F.transform(F.coalesce("candidate_teams", F.array()), lambda c: c["team_id"])))).alias("team"))
    moves = mentioned.join(pairs, F.col("team") == F.col("source_id")).groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("source_id", F.struct("target_id", "target_name")))).alias("to"))
    joined = cases.join(moves, F.col("id") == F.col("_id"), "left")

    def moved(c: Column) -> Column:
        to = F.try_element_at(F.col("to"), c["team_id"])
        return F.struct(F.coalesce(to["target_id"], c["team_id"]).alias("team_id"), F.coalesce(to["target_name"], c["team_name"]).alias("team_name"), c["score"].alias("score"), c["matched_alias"].alias("matched_alias"))

    suggestion = F.try_element_at(F.col("to"), F.col("suggested_team_id"))
    new = {
        "suggested_team_id": F.coalesce(suggestion["target_id"], "suggested_team_id"), "suggested_team_name": F.coalesce(suggestion["target_name"], "suggested_team_name"),
        "candidate_teams": F.when(F.col("to").isNull(), F.col("candidate_teams")).otherwise(collapse_candidates(F.transform("candidate_teams", moved))),
    }
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in cases.columns))
