"""Snapshots, upserts and merges."""

from quoteloom.operators import store

SNAP = "match_id string, bookmaker_id string, market_type string, player_name string, threshold double, over_odds double, scraped_at string, seq int"


def rows(spark, *values):
    return spark.createDataFrame([("m", "b", "x", p, 1.5, o, t, i) for i, (p, o, t) in enumerate(values)], SNAP)


def test_upsert_replaces_only_rows_with_a_whole_key(spark):
    out = store.upsert_latest(rows(spark, ("p", 1.0, "1"), ("p", 2.0, "2"), (None, 3.0, "1"), (None, 4.0, "2")))
    assert sorted(r.over_odds for r in out.collect()) == [2.0, 3.0, 4.0]


def test_latest_and_empty(spark):
    df = rows(spark, ("p", 1.0, "1"), ("q", 2.0, "2"))
    assert [r.over_odds for r in store.latest_snapshot(df).collect()] == [2.0]
    assert store.latest_snapshot(df.limit(0)).count() == 0


def test_merge_keeps_the_largest_id_null_safe(spark):
    df = spark.createDataFrame([("s", "b", "x", None, 1.5, 1), ("t", "b", "x", None, 1.5, 2), ("u", "b", "x", None, 1.5, 3), ("z", "b", "x", None, 1.5, 4)], "match_id string, bookmaker_id string, market_type string, player_name string, threshold double, id int")
    mapping = spark.createDataFrame([("s", "t"), ("u", "t")], "source_id string, target_id string")
    assert sorted((r.match_id, r.id) for r in store.merge_matches(df, mapping).collect()) == [("t", 3), ("z", 4)]


def test_snapshot_store_publishes_and_hides(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert s.current("odds") is None
    df = spark.createDataFrame([("m", 1.5)], "match_id string, threshold double")
    s.publish("2026-01-01T00:00:00", odds=df)
    s.publish("2026-01-01T00:10:00", odds=df.limit(0))
    assert s.current("odds").count() == 0 and s.history().count() == 1


def test_store_queries_take_every_row(spark):
    from collections import Counter

    from quoteloom.plans import QUERIES
    from quoteloom.sources import domain

    sf_dir = "/root/testdata/sf0.001"
    odds = domain.odds(spark, sf_dir).collect()
    cycle = {r.bookmaker_id: r for r in QUERIES["cycle_benchmark"](spark, sf_dir).collect()}
    orders = Counter(f"b{r.o_custkey % 10}" for r in domain.table(spark, sf_dir, "orders").collect())
    assert {b: r.leagues_attempted for b, r in cycle.items() if r.leagues_attempted} == dict(orders)
    assert {b: r.odds_count for b, r in cycle.items() if r.odds_count} == dict(Counter(r.bookmaker_id for r in odds))
    ends = set()
    for r in QUERIES["find_discrepancies"](spark, sf_dir).collect():
        if r.gap == 0 or r.threshold_b - r.threshold_a >= 40:
            ends |= {(r.match_id, r.bookmaker_a_id, r.threshold_a), (r.match_id, r.bookmaker_b_id, r.threshold_b)}
    want = Counter((r.match_id, (r.match_id, r.bookmaker_id, r.threshold) in ends) for r in odds)
    assert {(r.match_id, r.highlighted): r.n for r in QUERIES["highlight_offers"](spark, sf_dir).collect()} == dict(want)
