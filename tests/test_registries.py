"""Registry files, seeds, sinks and display forms."""

import json

import duckdb
from pyspark.sql import functions as F

from quoteloom.functions import display
from quoteloom.operators import migrate
from quoteloom.sources import registries


def test_league_registry_round_trip(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"canonical_leagues": {"aba-liga": {"name": "ABA", "country": None}, "x_y": {}}, "aliases": {"ABA  Liga": "aba_liga", "": "x"}, "bookmaker_aliases": {"B1": {"Liga-A": "aba liga"}}}))
    leagues, aliases = registries.read_league_registry(spark, f"file://{path}")
    assert {(r.id, r.name) for r in leagues.collect()} == {("aba_liga", "ABA"), ("x_y", "X Y")}
    want = {("", "aba liga", "aba_liga"), ("b1", "liga a", "aba_liga")}
    assert {tuple(r) for r in aliases.collect()} == want
    registries.write_league_registry(leagues, aliases, f"file://{tmp_path}/out")
    again = registries.read_league_registry(spark, f"file://{tmp_path}/out")[1]
    assert {tuple(r) for r in again.collect()} == want


def test_seeds_and_legacy_teams(spark, tmp_path):
    seeds = spark.createDataFrame([("basketball", "zvezda", "Crvena Zvezda", 1), ("basketball", "kk zvezda", "Crvena Zvezda", 2), ("basketball", "partizan nis", "Partizan", 3)], "sport string, alias string, canonical_name string, seq int")
    teams, aliases = registries.seed_teams(seeds)
    assert {(r.team_id, r.display_name) for r in teams.collect()} == {(1, "Crvena Zvezda"), (2, "Partizan")}
    assert {(r.normalized_alias, r.team_id) for r in aliases.collect()} == {("crvena zvezda", 1), ("zvezda", 1), ("kk zvezda", 1), ("partizan", 2), ("partizan nis", 2)}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"aliases": {"CZV": "Crvena Zvezda", "no": "Nobody"}, "bookmaker_aliases": {"B2": {"PAR": "Partizan"}}, "competition_aliases": {"nba": {"Q": "Partizan"}}}))
    got = {(r.bookmaker_id, r.normalized_alias, r.team_id) for r in registries.read_team_registry(spark, f"file://{path}", teams, aliases).collect()}
    assert got == {("", "czv", 1), ("b2", "par", 2)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b1", 3)], "bookmaker_id string, odds_count int")
    for stamp in ("2026-01-01T00:00:00", "2026-01-01T00:10:00"):
        registries.write_benchmarks(df, f"file://{tmp_path}/b", stamp)
        registries.append_notifications(df, f"file://{tmp_path}/n")
    assert spark.read.json(f"file://{tmp_path}/b/cycles").count() == 2 and spark.read.json(f"file://{tmp_path}/b/cycle-2026-01-01T00-10-00").count() == 1
    assert spark.read.parquet(f"file://{tmp_path}/n/notifications").count() == 2


def test_display(spark):
    x, t = F.col("x"), F.col("t")
    df = spark.createDataFrame([(None, None), (0.001, "2026-07-01T12:00:00"), (-1234.5, "bad"), (2.25, "2026-01-01T12:00:00+02:00")], "x double, t string")
    rows = df.select(display.odds_text(x), display.units_text(x), display.signed_units_text(x), display.local_time_text(t), display.relative_text(t, F.lit("2026-07-01 13:05:00").cast("timestamp"))).collect()
    assert [tuple(r) for r in rows] == [("—", "—", "—", "—", "Never"), ("0.00", "0", "0", "1 Jul, 14:00", "1h ago"), ("-1234.50", "-1,234.5", "-1,234.5", "—", "Never"), ("2.25", "2.25", "+2.25", "1 Jan, 11:00", "181d ago")]


def test_review_approval_keeps_the_first_time(spark):
    df = spark.createDataFrame([(1, "pending", None), (2, "approved", "a"), (3, "pending", None)], "id int, status string, approved_at string")
    rows = {r.id: (r.status, r.approved_at) for r in migrate.approve_reviews(df, [1, 2], "b").collect()}
    assert rows == {1: ("approved", "b"), 2: ("approved", "a"), 3: ("pending", None)}


def test_display_formats_as_its_sql(spark, tmp_path):
    import __spark_entry__ as entry

    values = [None, -0.3, -0.49, -0.01, -0.5, -0.51, 0.0, 0.29, 0.5, -999.99, 9999.99, 1234.5, -7.0]
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view customer as select * from read_parquet('{path}/*.parquet')")
    got = {tuple(r) for r in entry.queries()["display_formats"](spark, str(tmp_path)).collect()}
    assert got == set(db.execute(entry.oracle_sql()["display_formats"]).fetchall())
