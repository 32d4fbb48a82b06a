"""Registry files and sinks: league and team registries as JSON, benchmark and notification sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_league_id, humanize_league, identity_text, scope_key
from ..operators.registry import create_teams, resolve_labels

LEAGUE_FILE = "canonical_leagues map<string,struct<name:string,country:string>>, aliases map<string,string>, bookmaker_aliases map<string,map<string,string>>"
TEAM_FILE = "aliases map<string,string>, bookmaker_aliases map<string,map<string,string>>"


def read_league_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A-15: ``leagues(id, name, country)`` and ``aliases(bookmaker_id, alias, league_id)`` of a registry file, all keys in normal form."""
    file = spark.read.schema(LEAGUE_FILE).option("multiLine", True).json(path)
    entries = file.select(F.explode("canonical_leagues").alias("id", "meta")).withColumn("id", canonical_league_id(F.col("id")))
    leagues = entries.select("id", F.coalesce(F.nullif("meta.name", F.lit("")), humanize_league(F.col("id"))).alias("name"), "meta.country")
    every = file.select(F.lit("").alias("bookmaker_id"), F.explode("aliases").alias("alias", "target"))
    own = file.select(F.explode("bookmaker_aliases").alias("b", "m")).select(identity_text(F.col("b")).alias("bookmaker_id"), F.explode("m").alias("alias", "target"))
    kept = every.unionByName(own).where("alias <> '' and target <> ''")
    return leagues, kept.select("bookmaker_id", identity_text(F.col("alias")).alias("alias"), canonical_league_id(F.col("target")).alias("league_id"))


def write_league_registry(leagues: DataFrame, aliases: DataFrame, path: str) -> None:
    """A-16, U-18: a new version of the registry as one JSON document."""
    meta = leagues.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("name", "country")))).alias("canonical_leagues"))
    every = aliases.where("bookmaker_id = ''").agg(F.map_from_entries(F.collect_list(F.struct("alias", "league_id"))).alias("aliases"))
    per_book = aliases.where("bookmaker_id <> ''").groupBy("bookmaker_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", "league_id"))).alias("m"))
    own = per_book.agg(F.map_from_entries(F.collect_list(F.struct("bookmaker_id", "m"))).alias("bookmaker_aliases"))
    meta.crossJoin(every).crossJoin(own).coalesce(1).write.mode("overwrite").json(path)


def seed_teams(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-17: ``teams`` and ``aliases`` of ``seeds(sport, alias, canonical_name, seq)``: a team per name, numbered in seed order, its own name and its seed aliases."""
    spark = seeds.sparkSession
    none = spark.createDataFrame([], "team_id long, sport string, display_name string, is_active boolean, merged_into long")
    teams = create_teams(none, seeds.select("sport", F.col("canonical_name").alias("display_name"), "seq"))
    named = seeds.join(teams.select(F.col("sport").alias("t_sport"), identity_text(F.col("display_name")).alias("key"), "team_id"), (F.col("sport") == F.col("t_sport")) & (identity_text(F.col("canonical_name")) == F.col("key")))
    own = teams.select("sport", identity_text(F.col("display_name")).alias("normalized_alias"), F.lit("canonical").alias("source"), "team_id", F.col("team_id").alias("alias_id"))
    extra = named.select("sport", identity_text(F.col("alias")).alias("normalized_alias"), F.lit("seed").alias("source"), "team_id", (F.col("seq") + 1_000_000).cast("long").alias("alias_id"))
    both = own.unionByName(extra).groupBy("sport", "normalized_alias").agg(F.min_by(F.struct("alias_id", "source", "team_id"), "alias_id").alias("a"))
    return teams, both.select("a.alias_id", "sport", "normalized_alias", F.lit("").alias("bookmaker_id"), "a.source", "a.team_id")


def read_team_registry(spark: SparkSession, path: str, teams: DataFrame, aliases: DataFrame, sport: str = "basketball") -> DataFrame:
    """A-18: legacy aliases of a registry file whose targets are known teams; competition-scoped ones are not read."""
    file = spark.read.schema(TEAM_FILE).option("multiLine", True).json(path)
    every = file.select(F.lit("").alias("bookmaker_id"), F.lit("legacy_alias").alias("source"), F.explode("aliases").alias("alias", "target"))
    own = file.select(F.explode("bookmaker_aliases").alias("b", "m")).select(scope_key(F.col("b")).alias("bookmaker_id"), F.lit("legacy_bookmaker_alias").alias("source"), F.explode("m").alias("alias", "target"))
    rows = every.unionByName(own).where("alias <> '' and target <> ''").withColumn("sport", F.lit(sport))
    known = resolve_labels(rows.select("sport", "bookmaker_id", F.col("target").alias("label")), teams, aliases).select("bookmaker_id", F.col("label").alias("target"), "team_id")
    return rows.join(known, ["bookmaker_id", "target"]).select("sport", identity_text(F.col("alias")).alias("normalized_alias"), "bookmaker_id", "source", "team_id")


def write_benchmarks(cycle: DataFrame, folder: str, stamp: str) -> None:
    """A-20: a cycle's figures as a JSON file of its own, and appended to the log of all cycles."""
    stamped = cycle.withColumn("cycle", F.lit(stamp))
    stamped.coalesce(1).write.mode("overwrite").json(f"{folder}/cycle-{stamp.replace(':', '-')}")
    stamped.coalesce(1).write.mode("append").json(f"{folder}/cycles")


def append_notifications(messages: DataFrame, folder: str) -> None:
    """A-21: the in-app provider; another one would take the same frame in ``foreachBatch``."""
    messages.write.mode("append").parquet(f"{folder}/notifications")
