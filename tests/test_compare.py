"""Gaps, arbitrage and stakes on hand-made quotes."""

from pyspark.sql import functions as F

from quoteloom.functions import stakes
from quoteloom.operators import analyze

SCHEMA = "match_id string, bookmaker_id string, market_type string, player_name string, threshold double, over_odds double, under_odds double, seq int"


def quotes(spark, *rows):
    return spark.createDataFrame([("m1", *r, i) for i, r in enumerate(rows)], SCHEMA)


def found(df):
    return sorted((r.bookmaker_a_id, r.bookmaker_b_id, r.gap, r.profit_margin) for r in df.collect())


def test_gap_needs_over_below_and_under_above(spark):
    low_over = quotes(spark, ("a", "player_points", "P", 20.5, 1.9, None), ("b", "player_points", "P", 22.5, None, 1.9))
    assert found(analyze.find_discrepancies(low_over)) == [("a", "b", 2.0, -0.05)]
    high_over = quotes(spark, ("a", "player_points", "P", 20.5, None, 1.9), ("b", "player_points", "P", 22.5, 1.9, None))
    assert found(analyze.find_discrepancies(high_over)) == []


def test_three_sources_give_three_pairs_and_own_alternates_none(spark):
    df = quotes(spark, *((b, "player_points", None, t, 1.9, 1.9) for b, t in (("a", 1.5), ("b", 2.5), ("c", 3.5), ("a", 1.5))))
    assert analyze.gap_join(df).count() == 5
    assert analyze.gap_join(df.where("bookmaker_id = 'a'")).count() == 0


def test_markets_stay_apart_but_milestones_are_points(spark):
    df = quotes(spark, ("a", "game_total_ot", None, 1.5, 1.9, 1.9), ("b", "game_total", None, 2.5, 1.9, 1.9), ("a", "player_points_milestones", "P", 1.5, 1.9, None), ("b", "player_points", "P", 2.5, None, 1.9))
    out = analyze.find_discrepancies(df).collect()
    assert [(r.market_type, r.gap) for r in out] == [("player_points", 1.0)]


def test_equal_lines_take_the_better_crossing(spark):
    df = quotes(spark, ("a", "player_points", "P", 1.5, 1.7, 2.3), ("b", "player_points", "P", 1.5, 2.2, 1.6))
    r = analyze.find_discrepancies(df).collect()
    assert [(x.bookmaker_a_id, x.bookmaker_b_id, x.odds_a, x.odds_b, x.gap, x.middle_profit_margin) for x in r] == [("b", "a", 2.2, 2.3, 0.0, None)]
    close = quotes(spark, ("a", "player_points", "P", 1.5, 1.90, 2.3), ("b", "player_points", "P", 1.5, 1.85, 2.6))
    assert analyze.arbitrage_join(close).count() == 0  # 1.90 - 1.85 is under 0.05 in doubles


def test_zero_prices_and_empty_input(spark):
    zero = quotes(spark, ("a", "player_points", None, 1.5, 0.0, 1.9), ("b", "player_points", None, 2.5, 1.9, 1.9))
    assert [r.profit_margin for r in analyze.gap_join(zero).collect()] == [None]
    assert analyze.find_discrepancies(zero.limit(0)).count() == 0


def test_min_gap_compares_before_rounding(spark):
    df = quotes(spark, ("a", "player_points", None, 1.5, 1.9, None), ("b", "player_points", None, 3.0, None, 1.9))
    assert analyze.find_discrepancies(df, 1.5).count() == 1
    assert analyze.find_discrepancies(df, 1.6).count() == 0


def test_stake_plans(spark):
    d = spark.sql("select 2.1D odds_a, 2.0D odds_b, 2.0D gap, 0.0244D profit_margin, 1.0488D middle_profit_margin")
    for mode in stakes.MODES:
        p = d.select(stakes.stake_plan(mode, F.lit(20.0)).alias("p")).first().p
        assert abs(p.total_stake - 20) < 1e-6 and p.worst_case == min(p.profit_a, p.profit_b)
    rounded = d.select(stakes.stake_plan("conservative-rounded", F.lit(20.0)).alias("p")).first().p
    assert round(rounded.stake_a * 10, 6) == round(rounded.stake_a * 10) and rounded.guaranteed
    no_middle = d.withColumn("gap", F.lit(0.0))
    assert no_middle.select(stakes.stake_plan("aggressive-middle", F.lit(20.0)).alias("p")).first().p is None
    assert no_middle.select(stakes.stake_plan("balanced", F.lit(20.0)).alias("p")).first().p.labels == ["Same-threshold arb"]


def test_stake_queries_plan_every_discrepancy(spark):
    from quoteloom.plans import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    d = [r for r in QUERIES["find_discrepancies"](spark, sf_dir).collect() if r.odds_a > 0 and r.odds_b > 0 and r.profit_margin is not None]
    want = {}
    for r in d:
        middle = r.gap > 0 and r.middle_profit_margin is not None
        want.setdefault("stake_balanced", []).append(r) if not middle or r.profit_margin >= 0 else None
        want.setdefault("stake_aggressive", []).append(r) if middle else None
        want.setdefault("stake_conservative", []).append(r) if middle and r.profit_margin >= 0 else None
    for name in ("stake_balanced", "stake_aggressive", "stake_conservative"):
        key = lambda r: (r.match_id, r.bookmaker_a_id, r.bookmaker_b_id, r.threshold_a, r.threshold_b, r.odds_a, r.odds_b)
        got = QUERIES[name](spark, sf_dir).collect()
        assert sorted(map(key, got)) == sorted(map(key, want[name]))
        assert any(0 < r.threshold_b - r.threshold_a <= 30 for r in got)
        for r in got:
            if name == "stake_balanced":
                assert abs(r.stake_a - 20 * r.odds_b / (r.odds_a + r.odds_b)) < 2e-3 and abs(r.stake_a + r.stake_b - 20) < 2e-3
            assert abs(r.profit_a - (r.stake_a * r.odds_a - 20)) < 0.11 and abs(r.profit_b - (r.stake_b * r.odds_b - 20)) < 0.11 and r.worst_case == min(r.profit_a, r.profit_b)


def test_counted_discrepancies_are_the_pairs_with_their_number(spark):
    import random
    from collections import Counter

    draw, kinds = random.Random(7), "match_id string, market_type string, player_name string, bookmaker_id string, threshold double, over_odds double, under_odds double, seq long"
    price = lambda: draw.choice([1.9, 2.1, 2.3, 2.3, 0.0, None])
    rows = [(draw.choice("mn"), draw.choice(["player_points", "player_points_milestones", "game_total"]), draw.choice(["p", None]), draw.choice("abc"), draw.choice([1.5, 2.5, 12.5]), price(), price(), i) for i in range(400)]
    quotes = spark.createDataFrame(rows, kinds)
    for least in (0.0, 10.0):
        pairs = Counter(tuple(r) for r in analyze.find_discrepancies(quotes, least).collect())
        counted = [(tuple(r)[:-1], r.n_pairs) for r in analyze.counted_discrepancies(quotes, least).collect()]
        assert dict(counted) == pairs and len(counted) == len(pairs)
        assert any(r[9] == 0.0 for r in pairs) and max(pairs.values()) > 5
