"""Cycles that build on one another."""

from pyspark.sql import functions as F
from test_resolve import raw, world

from quoteloom.operators import decisions
from quoteloom.operators.store import SnapshotStore
from quoteloom.streaming import cycle


def ids(keep):
    return {r.display_name: r.team_id for r in keep.current("teams").collect()}


def test_created_teams_and_their_matches_stay(spark, tmp_path):
    teams, aliases = world(spark, "Alfa", "Beta")
    keep = SnapshotStore(spark, f"file://{tmp_path}/s")
    first = raw(spark, ("a", "Nova", "Stara", None, "t"), ("b", "Nova", "Stara", None, "t"))
    second = raw(spark, ("a", "Aaa", "Bbb", None, "t"), ("b", "Aaa", "Bbb", None, "t"), ("a", "Nova", "Stara", None, "t"))
    cycle.run_cycle(keep, first, teams, aliases, "2026-01-01T00:00:00")
    before, matches = ids(keep), {r.match_id for r in keep.current("odds").collect()}
    assert set(before) == {"Alfa", "Beta", "Nova", "Stara"} and len(matches) == 1
    cycle.run_cycle(keep, second, teams, aliases, "2026-01-01T00:10:00")
    after = ids(keep)
    assert {k: after[k] for k in before} == before and set(after) - set(before) == {"Aaa", "Bbb"} and len(set(after.values())) == 6
    assert matches < {r.match_id for r in keep.current("odds").collect()}
    spelled = keep.current("aliases").collect()
    assert len({r.alias_id for r in spelled}) == len(spelled) == 6
    assert {r.id for r in keep.current("matches").collect()} == {r.match_id for r in keep.current("odds").collect()}
    assert {(r.bookmaker_id, r.odds_count) for r in keep.current("benchmark").collect()} == {("a", 2), ("b", 1)}
    # the second cycle again, as a retry would run it
    keep.point_to("2026-01-01T00-00-00")
    assert ids(keep) == before
    cycle.run_cycle(keep, second, teams, aliases, "2026-01-01T00:10:00")
    assert ids(keep) == after and keep.history().count() == 2 + 3


def test_anchored_suggestion_is_approved_when_the_book_repeats_it(spark, tmp_path):
    teams, aliases = world(spark, "Alfa", "Beta")
    keep = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = raw(spark, ("a", "Alfa", "Beta", None, "t"), ("b", "Alfa", "Betta BC", None, "t"))
    seen = []
    for minute in (0, 1, 2):
        cycle.run_cycle(keep, rows, teams, aliases, f"2026-01-01T00:0{minute}:00")
        seen.append(([(r.raw_team_name, r.status, r.review_kind) for r in keep.current("reviews").collect()], keep.current("odds").count()))
    assert seen == [([("Betta BC", "pending", "alias_suggestion")], 1), ([("Betta BC", "approved", "auto_alias")], 1), ([], 2)]
    found = keep.current("aliases").where("normalized_alias = 'betta bc'").collect()
    assert [(r.bookmaker_id, r.source, r.team_id) for r in found] == [("b", "auto_review", 2)]


def test_players_have_their_known_names_and_gaps_are_told(spark, tmp_path):
    teams, aliases = world(spark, "Alfa", "Beta")
    keep = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = raw(spark, ("a", "Alfa", "Beta", None, "t"), ("a", "Alfa", "S. Vezenkov", "S. Vezenkov", "t"), ("b", "Beta", "Sasha Vezenkov", "Sasha Vezenkov", "t"))
    rows = rows.withColumn("threshold", F.when(F.col("bookmaker_id") == "b", 9.5).otherwise(1.5))
    cycle.run_cycle(keep, rows, teams, aliases, "2026-01-01T00:00:00", notify_from=2.0)
    assert {r.player_name for r in keep.current("odds").collect()} == {None, "Sasha Vezenkov"}
    assert [r.title for r in keep.current("notifications").collect()] == ["Sasha Vezenkov: 8.0 gap"]
    cycle.run_cycle(keep, rows.limit(0), teams, aliases, "2026-01-01T00:10:00")
    assert keep.current("odds").count() == keep.current("notifications").count() == 0 and ids(keep) == {"Alfa": 1, "Beta": 2}


def requests(spark, *rows):
    return spark.createDataFrame([(i, "basketball", *r) for i, r in enumerate(rows)], "request_id long, sport string, bookmaker_id string, raw_team_name string, team_name string, source string")


def test_alias_guards(spark):
    teams, aliases = world(spark, "Alfa", "Beta")
    more = spark.createDataFrame([(3, "basketball", "al", "", "manual", 1)], aliases.schema)
    asked = requests(
        spark, ("b", "Alfica", "Alfa", "manual"), ("b", "Alfica", "Beta", "manual"), ("b", "--", "Alfa", "manual"), ("b", "New", "Nobody", "manual"), ("b", "Alfa", "Al", "manual"), ("b", "Beta", "Alfa", "manual"),
        ("b", "AL", "Alfa", "auto_review"), ("b", "al", "Alfa", "manual"), ("b", "x", "Beta", "auto_review"), (None, "y", "Beta", "manual"),
    )
    judged, after = decisions.remember_aliases(teams, aliases.unionByName(more), asked)
    assert [r.outcome for r in judged.orderBy("request_id").collect()] == ["saved", "conflict", "blank", "unknown_team", "circular", "conflict", "kept", "saved", "saved", "saved"]
    got = {(r.normalized_alias, r.bookmaker_id): r.team_id for r in after.collect()}
    assert got == {("alfa", ""): 1, ("beta", ""): 2, ("al", ""): 1, ("alfica", "b"): 1, ("al", "b"): 1, ("x", "b"): 2, ("y", ""): 2}
    assert after.select("alias_id").distinct().count() == len(got)


CASES = "id long, sport string, bookmaker_id string, raw_team_name string, suggested_team_id long, suggested_team_name string, candidate_teams array<struct<team_id:long,team_name:string,score:double,matched_alias:string>>, status string, approved_at string"


def test_decisions_on_review_cases(spark):
    teams, aliases = world(spark, "Alfa", "Beta", "Gama")
    merged = teams.withColumn("is_active", F.col("team_id") != 3).withColumn("merged_into", F.when(F.col("team_id") == 3, F.lit(2)).cast("long"))
    names = ["Alfica", "Betica", "Gamica", "Nova", "Delta", "Alfa", "Zeta", "Eta"]
    suggested = {1: (1, "Alfa"), 6: (2, "Beta"), 8: (1, "Alfa")}
    cases = spark.createDataFrame([(i, "basketball", "b", n, *suggested.get(i, (None, None)), None, "pending", "old" if i == 1 else None) for i, n in enumerate(names, 1)], CASES)
    rows = [(1, "approve", None, None), (2, "approve", 3, None), (3, "approve", 1, "X"), (4, "approve", None, " Nova Klub "), (5, "approve", None, " "), (6, "approve", None, None), (7, "decline", None, None), (8, "approve", 99, None), (77, "approve", 1, None)]
    asked = spark.createDataFrame(rows, "case_id long, action string, team_id long, create_team_name string")
    outcomes, after, every, spelled = decisions.settle_reviews(cases, asked, merged, aliases, "now")
    assert {r.case_id: (r.outcome, r.code, r.team_name) for r in outcomes.collect()} == {
        1: ("approved", 200, "Alfa"), 2: ("approved", 200, "Beta"), 3: ("two_choices", 400, None), 4: ("approved", 200, "Nova Klub"), 5: ("no_choice", 400, None),
        6: ("conflict", 409, None), 7: ("declined", 200, None), 8: ("unknown_team", 404, None), 77: ("unknown_case", 404, None),
    }
    assert {r.id: (r.status, r.approved_at) for r in after.collect()} == {1: ("approved", "old"), 2: ("approved", "now"), 4: ("approved", "now"), 7: ("declined", None), **{i: ("pending", None) for i in (3, 5, 6, 8)}}
    new = {r.display_name: r.team_id for r in every.collect()}["Nova Klub"]
    assert {(r.normalized_alias, r.team_id) for r in spelled.where("bookmaker_id = 'b'").collect()} == {("alfica", 1), ("betica", 2), ("nova", new)}
    assert {r.team_id for r in spelled.where("normalized_alias = 'nova klub'").collect()} == {new}


def test_merge_rewrites_pending_reviews_and_is_logged(spark):
    teams, _ = world(spark, "Alfa", "Beta", "Gama")
    listed = [(1, "Alfa", 80.0, None), (2, "Beta", 90.0, None), (3, "Gama", 70.0, None), (1, "Alfa", 60.0, "alf")]
    cases = spark.createDataFrame([(1, "s", "b", "x", 1, "Alfa", listed, "pending", None), (2, "s", "b", "x", 1, "Alfa", listed, "approved", "t"), (3, "s", "b", "y", 3, "Gama", None, "pending", None), (4, "s", "b", "z", None, None, [], "pending", None)], CASES)
    mapping = spark.createDataFrame([(1, 2)], "source_id long, target_id long")
    got = {r.id: (r.suggested_team_id, r.suggested_team_name, r.candidate_teams and [tuple(c) for c in r.candidate_teams]) for r in decisions.repoint_reviews(cases, mapping, teams).collect()}
    assert got == {1: (2, "Beta", [(2, "Beta", 90.0, "alf"), (3, "Gama", 70.0, None)]), 2: (1, "Alfa", listed), 3: (3, "Gama", None), 4: (None, None, [])}
    assert [tuple(r) for r in decisions.merge_log(mapping, "now").collect()] == [(1, 2, "now")]
    bad = spark.createDataFrame([(1, 1), (1, 9), (1, 2)], "source_id long, target_id long")
    assert {(r.source_id, r.target_id): r.reason for r in decisions.merge_problems(teams, bad).collect()} == {(1, 1): "same_team", (1, 9): "unknown_team"}


def test_copies_of_quotes_are_compared_once_and_counted(spark, tmp_path):
    teams, aliases = world(spark, "Alfa", "Beta")
    keep = SnapshotStore(spark, f"file://{tmp_path}/s")
    one = raw(spark, ("a", "Alfa", "Beta", None, "t"), ("b", "Beta", "Alfa", None, "t"))
    rows = one.crossJoin(spark.range(1500)).withColumn("seq", F.col("seq") + 2 * F.col("id")).drop("id").withColumn("threshold", F.when(F.col("bookmaker_id") == "b", 9.5).otherwise(1.5))
    cycle.run_cycle(keep, rows, teams, aliases, "2026-01-01T00:00:00")
    assert keep.current("odds").count() == 3000
    assert [(r.bookmaker_a_id, r.bookmaker_b_id, r.gap, r.n_pairs) for r in keep.current("discrepancies").collect()] == [("a", "b", 8.0, 1500 * 1500)]
    assert [r.n_pairs for r in keep.current("notifications").collect()] == [1500 * 1500]
