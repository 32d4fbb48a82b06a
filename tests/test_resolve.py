"""Entity resolution scenarios."""

from pyspark.sql import functions as F

from quoteloom.operators import registry, resolve

RAW = "seq long, bookmaker_id string, league_id string, sport string, home_team string, away_team string, market_type string, player_name string, threshold double, over_odds double, under_odds double, start_time string"


def raw(spark, *rows):
    return spark.createDataFrame([(i, b, "lg", "basketball", h, a, "points", p, 1.5, 1.9, 1.9, t) for i, (b, h, a, p, t) in enumerate(rows)], RAW)


def world(spark, *names):
    teams = spark.createDataFrame([(i + 1, "basketball", n, True, None) for i, n in enumerate(names)], "team_id long, sport string, display_name string, is_active boolean, merged_into long")
    aliases = spark.createDataFrame([(i + 1, "basketball", n.lower(), "", "canonical", i + 1) for i, n in enumerate(names)], "alias_id long, sport string, normalized_alias string, bookmaker_id string, source string, team_id long")
    return teams, aliases


def test_tie_of_orientations_takes_the_smaller_ids(spark):
    teams, aliases = world(spark, "Alfa", "Beta")
    r = registry.with_teams(raw(spark, ("a", "Beta", "Alfa", None, "t"), ("b", "alfa", "beta", None, "t")), teams, aliases)
    assert [(m.home_id, m.away_id) for m in resolve.canonical_matchups(r).collect()] == [(1, 2)]


def test_two_prop_teams_make_a_matchup_and_four_do_not(spark):
    teams, aliases = world(spark, "Alfa", "Beta", "Gama", "Delta")
    two = raw(spark, ("a", "Beta", "P1", "P1", "t"), ("a", "Alfa", "P2", "P2", "t"))
    done, lost = resolve.resolve_matchups(two, teams, aliases)
    assert {(r.home_team, r.away_team) for r in done.collect()} == {("Alfa", "Beta")} and lost.count() == 0
    four = two.unionByName(raw(spark, ("a", "Gama", "P3", "P3", "t"), ("a", "Delta", "P4", "P4", "t")))
    done, lost = resolve.resolve_matchups(four, teams, aliases)
    assert done.count() == 0 and {r.reason_code for r in lost.collect()} == {"no_canonical_matchup_for_team_at_slot"}


def test_own_alias_beats_global_and_inactive_teams_do_not_count(spark):
    teams, aliases = world(spark, "Alfa", "Beta")
    own = spark.createDataFrame([(9, "basketball", "alfa", "b1", "manual", 2)], aliases.schema)
    labels = spark.createDataFrame([("basketball", "b1", "ALFA"), ("basketball", "b2", "Alfa"), ("basketball", "b2", "none"), ("basketball", None, "Beta")], "sport string, bookmaker_id string, label string")
    got = {(r.bookmaker_id, r.label): r.team_id for r in registry.resolve_labels(labels, teams, aliases.unionByName(own)).collect()}
    assert got == {("b1", "ALFA"): 2, ("b2", "Alfa"): 1, (None, "Beta"): 2}
    off = teams.withColumn("is_active", F.col("team_id") != 1)
    assert registry.resolve_labels(labels, off, aliases).where("label = 'Alfa'").count() == 0


def test_autocreate_needs_two_and_leaves_anchored_sides(spark):
    teams, aliases = world(spark, "Alfa", "Beta")
    rows = raw(spark, ("a", "Nova", "Stara", None, "t"), ("b", "NOVA", "Stara", None, "t"), ("a", "Once", "Never", None, "t"), ("a", "Alfa", "Beta", None, "u"), ("a", "Alfa", "Betta", None, "u"), ("b", "Alfa", "Betta", None, "u"))
    assert {r.display_name for r in resolve.autocreate_names(rows, teams, aliases).collect()} == {"Nova", "Stara"}


def test_review_suggests_the_only_event_of_the_counterpart(spark):
    teams, aliases = world(spark, "Alfa", "Beta", "Gama")
    r = registry.with_teams(raw(spark, ("a", "Alfa", "Beta", None, "t"), ("b", "Alfa", "Betta BC", None, "t"), ("c", "Gamma", "Zeta", None, "u")), teams, aliases).withColumn("voted_league", F.col("league_id"))
    cases = {(c.bookmaker_id, c.raw_team_name): c for c in resolve.review_cases(r, resolve.event_votes(r), teams, aliases).collect()}
    known = cases["b", "Betta BC"]
    assert (known.suggested_team_name, known.review_kind, known.confidence) == ("Beta", "alias_suggestion", "high")
    assert cases["c", "Gamma"].suggested_team_name == "Gama" and cases["c", "Gamma"].review_kind == "candidate_search"


def test_merge_and_chains(spark):
    teams, aliases = world(spark, "Alfa", "Beta", "Gama")
    mapping = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    after, spelled = registry.merge_teams(teams, aliases, mapping)
    assert {r.team_id: r.is_active for r in after.collect()} == {1: True, 2: False, 3: True}
    assert {r.normalized_alias: r.team_id for r in spelled.collect()} == {"alfa": 1, "beta": 1, "gama": 3}
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "team_id long, merged_into long")
    assert {r.team_id: r.final_id for r in registry.follow_merges(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_empty_input(spark):
    teams, aliases = world(spark, "Alfa")
    none = raw(spark, ("a", "Alfa", "Beta", None, "t")).limit(0)
    done, lost = resolve.resolve_matchups(none, teams, aliases)
    assert done.count() == lost.count() == resolve.autocreate_names(none, teams, aliases).count() == 0


def test_candidates_are_searched_for_every_label(spark):
    from quoteloom.plans import QUERIES
    from quoteloom.sources import domain

    sf_dir = "/root/testdata/sf0.001"
    labels = {r.home_team for r in domain.raw_offers(spark, sf_dir).select("home_team").distinct().collect()}
    got = QUERIES["team_candidates_top3"](spark, sf_dir).collect()
    assert {r.label for r in got} == labels and not all(x.startswith("Club") for x in labels)
    assert max(r.place for r in got) == 3
