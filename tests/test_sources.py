"""Parsers on small documents of the recorded shapes."""

import json

from quoteloom.sources import offers


def docs(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "payload string")


def got(df):
    return sorted((r.market_type, r.player_name, r.threshold, r.over_odds, r.under_odds) for r in df.collect())


def test_match_lists_come_in_four_shapes(spark):
    m = {"id": 1, "home": "P", "away": "T", "leagueName": "Poeni igrača ~ NBA", "kickOffTime": 1000, "params": {"ouPlPoints": "20.5"}, "odds": {"51679": 1.8}}
    for shape in (m, [m], {"esMatches": [m]}, {"1": m}):
        r = offers.maxbet(docs(spark, shape)).collect()
        assert [(x.player_name, x.threshold, x.over_odds, x.league_id, x.start_time) for x in r] == [("P", 20.5, 1.8, "nba", "1970-01-01T00:00:01+00:00")]


def test_bad_documents_give_no_rows(spark):
    for read in (offers.maxbet, offers.merkurxtip, offers.oktagon_list, offers.mozzart, offers.meridian_totals, offers.pinnbet_totals, offers.admiralbet, offers.balkanbet):
        assert read(docs(spark, {}, [], {"x": 1})).count() == 0
        assert read(docs(spark).limit(0) if False else spark.createDataFrame([], "payload string")).count() == 0


def test_reversed_names(spark):
    m = {"home": "James L.", "away": "LAL", "leagueName": "Igrači - NBA", "params": {"ouPlPoints": "1.5"}, "odds": {"51679": 2.0}}
    assert [r.player_name for r in offers.merkurxtip(docs(spark, [m])).collect()] == ["L.James"]


def test_last_and_first_wins(spark):
    odd = lambda side, v: {"specialOddValue": "10.5", "subgame": {"name": side}, "game": {"name": "Broj poena X"}, "value": v, "oddStatus": "ACTIVE"}
    doc = {"items": [{"home": {"name": "A"}, "visitor": {"name": "B"}, "competition": {"name": "NBA"}, "startTime": 5, "oddsGroup": [{"groupName": "Poena igrača", "odds": [odd("više", 1.0), odd("više", 2.0), odd("manje", 3.0)]}]}]}
    assert got(offers.mozzart(docs(spark, doc))) == [("player_points", "X", 10.5, 2.0, 3.0)]
    bulk = [{"id": 1, "home": "P", "away": "T", "leagueName": "Igrači ~ NBA", "odBetPickGroups": [{"handicapParamValue": "7.5", "tipTypes": [{"tipTypeId": 51679, "value": 0}, {"tipTypeId": 51679, "value": 1.5}, {"tipTypeId": 51679, "value": 1.7}]}]}]
    assert got(offers.oktagon_bulk(docs(spark, bulk))) == [("player_points", "P", 7.5, 1.5, None)]


def test_short_name_split_prefers_the_longest_matching_side(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Ri-val-Tim A", "Tim A"), ("X-Y", "Z"), ("", "Z")], "s string, t string")
    r = df.select(offers.matchup_of_short_name(F.col("s"), F.col("t")).alias("m")).collect()
    assert (r[0].m.home, r[0].m.away) == ("Ri-val", "Tim A") and r[1].m is None and r[2].m is None


def test_registry_keeps_order_and_last_registration(spark):
    reg = offers.Registry()
    reg.register("a", offers.maxbet)
    reg.register("b", offers.mozzart)
    reg.register("a", offers.merkurxtip)
    assert reg.ids() == ["a", "b"] and offers.mock(spark).count() == 42


def test_oktagon_chains_lists_and_bulk_answers(spark):
    listed = [{"id": 1, "home": "H", "away": "A", "kickOffTime": 1000, "leagueName": "Euroleague", "params": {"overUnderOvertime": "150.5"}, "odds": {"50444": 1.8, "50445": 1.9}}]
    over, under = offers.TOTALS_OT[0][:2]
    pick = lambda code, value: {"handicapParamValue": "160.5", "tipTypes": [{"tipTypeId": code, "value": value}]}
    bulk = [{"id": 1, "odBetPickGroups": [pick(over, 1.7), pick(under, 2.0)]}, {"id": 2, "home": "X", "away": "Y", "leagueName": "Euroleague", "odBetPickGroups": [pick(over, 1.6)]}]
    rows = {(r.home_team, r.threshold): (r.over_odds, r.under_odds, r.league_id) for r in offers.oktagon(docs(spark, listed, bulk)).collect()}
    assert rows[("H", 160.5)][:2] == (1.7, 2.0) and ("X", 160.5) in rows and rows[("H", 160.5)][2] == rows[("X", 160.5)][2]


def test_merge_of_repeated_rows(spark):
    row = lambda over, under, start, seq: ("b", "l", "s", "h", "a", "m", None, 1.5, over, under, start, seq)
    df = spark.createDataFrame([row(None, 2.0, "t1", 1), row(1.5, 9.0, None, 2), row(9.0, None, "t3", 3), row(8.0, 8.0, "", 4)], "bookmaker_id string, league_id string, sport string, home_team string, away_team string, market_type string, player_name string, threshold double, over_odds double, under_odds double, start_time string, seq long")
    assert [(r.over_odds, r.under_odds, r.start_time) for r in offers.dedupe_merge(df).collect()] == [(1.5, 2.0, "t3")]


def test_ids_fallback_and_modes(spark):
    m = [{"id": i, "home": "h", "away": "a", "params": p, "odds": {}} for i, p in ((3, {"x": "1"}), (2, {"x": ""}), (1, {"y": "2"}), (3, {"x": "5"}), (None, {"x": "1"}))]
    found = offers.match_ids(offers.es_matches(docs(spark, m)), ("x", "y"))
    assert [r.id for r in found.orderBy("place").collect()] == [3, 1]
    some, none = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int")
    other = spark.createDataFrame([(7,), (8,)], "a int")
    assert [r.a for r in offers.or_else(some, other).collect()] == [1] and sorted(r.a for r in offers.or_else(none, other).collect()) == [7, 8]
    reg = offers.chosen_registry({"maxbet": "real", "unheard": "real", "mozzart": "mock", "pinnbet": "off"}, offers.mock)
    assert reg.ids() == ["maxbet", "unheard", "mozzart"]
    assert set(offers.default_registry().ids()) == set(offers.READERS) and len(offers.READERS) == 8


def test_meridian_reads_pages_and_markets_and_drops_the_past(spark):
    header = lambda i, start: {"eventId": i, "state": "ACTIVE", "startTime": start, "rivals": ["A", "B"], "league": {"slug": "euroleague"}}
    market = lambda: {"name": "Last, First", "state": "ACTIVE", "overUnder": 9.5, "selections": [{"name": "više", "price": 1.8}]}
    total = {"name": "Ukupno (uklj. OT)", "overUnder": 150.5, "selections": [{"name": "Manje", "price": 1.9}]}
    page = {"payload": [{"events": [{"header": header(i, s), "positions": [{"groups": [total]}]} for i, s in ((1, 5000), (2, 10), (3, None))]}]}
    detail = lambda i, kind, groups: {"header": header(i, 5000), "market_type": kind, "payload": groups}
    full = [{"markets": [market()]}]
    d = docs(spark, page, detail(1, "player_points", full), detail(1, "player_assists", full), detail(3, "player_points", []), detail(3, "player_rebounds", full))
    rows = sorted((r.market_type, r.player_name or "") for r in offers.meridian(d, 1000).collect())
    # of the totals, event 2 is over; those of 1 and 3 have one key but for the start, so one of them stays
    assert rows == [("game_total_ot", ""), ("player_assists", "First Last"), ("player_points", "First Last")]
    assert offers.meridian(d).where("player_name is not null").count() == 0
