"""The snapshot store and its reads.

A snapshot is an immutable directory per cycle; history is append-only; a
pointer, written last, says which snapshot is current.  Readers that see the
old pointer keep seeing the old snapshot.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odds import lookback_start

ODDS_KEY = ("match_id", "bookmaker_id", "market_type", "player_name", "threshold")


def latest_snapshot(rows: DataFrame, stamp: str = "scraped_at") -> DataFrame:
    """F-03, D-04: rows of the latest stamp; the one-row maximum is broadcast."""
    top = rows.agg(F.max(stamp).alias("_top"))
    return rows.join(F.broadcast(top), F.col(stamp) == F.col("_top")).drop("_top")


def at_snapshot(rows: DataFrame, pointer: DataFrame, stamp: str = "scraped_at") -> DataFrame:
    """D-04: rows of the snapshot that the one-row ``pointer(current_snapshot_at)`` names; none without a pointer."""
    return rows.join(F.broadcast(pointer.limit(1)), F.col(stamp) == F.col("current_snapshot_at")).drop("current_snapshot_at")


def legacy_window(rows: DataFrame, interval_minutes: int = 10, stamp: str = "scraped_at") -> DataFrame:
    """D-04 and C-30: before there is a pointer, rows of the trailing window."""
    top = rows.agg(lookback_start(F.max(stamp), interval_minutes).alias("_from"))
    return rows.join(F.broadcast(top), F.col(stamp) >= F.col("_from")).drop("_from")


def upsert_latest(rows: DataFrame, key: tuple[str, ...] = ODDS_KEY, order: tuple[str, ...] = ("scraped_at", "seq")) -> DataFrame:
    """U-04, W-02: of rows with the same key the latest; rows with a null in the key are never replaced (T3)."""
    whole = ~F.greatest(*(F.col(k).isNull() for k in key))
    rest = [c for c in rows.columns if c not in key]
    replaced = rows.where(whole).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
    return replaced.unionByName(rows.where(~whole))


def replace_rows(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """U-01 to U-03: the table after whole rows are replaced by key; of several changes of one key the last by ``order`` counts."""
    rest = [c for c in table.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    return table.join(last.select(*key), key, "left_anti").select(*table.columns).unionByName(last.select(*table.columns))


def upsert_bookmakers(table: DataFrame, changes: DataFrame) -> DataFrame:
    """U-01: a source that is written again is active again.  ``changes``: ``id, name, website_url, seq``."""
    return replace_rows(table, changes.withColumn("is_active", F.lit(True)), ["id"], "seq")


def upsert_leagues(table: DataFrame, changes: DataFrame) -> DataFrame:
    """U-02.  ``changes``: ``id, name, sport, country, seq``."""
    return replace_rows(table, changes, ["id"], "seq")


def upsert_matches(table: DataFrame, changes: DataFrame) -> DataFrame:
    """U-03: team ids of zero or less count as unknown."""
    known = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("home_team_id", "away_team_id")}
    return replace_rows(table, changes.withColumns(known), ["id"], "seq")


def first_of_match(quotes: DataFrame) -> DataFrame:
    """F-22: each match as its first quote of the cycle names it: ``id, league_id, sport, home_team_id, away_team_id, home_team, away_team, start_time, status, seq``."""
    rest = ("league_id", "sport", "home_team_id", "away_team_id", "home_team", "away_team", "start_time", "seq")
    first = quotes.groupBy(F.col("match_id").alias("id")).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select("id", *(f"r.{c}" for c in rest[:-1]), F.lit("upcoming").alias("status"), "r.seq")


def read_notifications(rows: DataFrame, unread_only: bool = False, limit: int = 50) -> DataFrame:
    """D-14, H-07: notifications, the newest first."""
    return (rows.where(~F.col("is_read")) if unread_only else rows).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def keep_max_id(rows: DataFrame, key: tuple[str, ...], id_col: str) -> DataFrame:
    """F-13, W-06: of rows with the same key (nulls are equal) the one with the largest id."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), id_col).alias("r")).select(*key, "r.*")


def merge_matches(odds: DataFrame, mapping: DataFrame, id_col: str = "id") -> DataFrame:
    """U-09: quotes after matches ``source_id`` went into ``target_id``; colliding quotes keep the largest id."""
    m = mapping.select("source_id", "target_id")
    moved = odds.join(m, odds["match_id"] == m["source_id"], "left").withColumn("match_id", F.coalesce("target_id", "match_id")).drop("source_id", "target_id")
    touched = m.select(F.col("target_id").alias("match_id")).distinct()
    collide = keep_max_id(moved.join(touched, "match_id", "left_semi"), ODDS_KEY, id_col)
    return collide.select(*odds.columns).unionByName(moved.join(touched, "match_id", "left_anti").select(*odds.columns))


def with_odds_at(matches: DataFrame, odds: DataFrame, bookmakers: list[str] | None = None) -> DataFrame:
    """J-04: matches with a quote (of one of the sources, if given)."""
    seen = odds if not bookmakers else odds.where(F.col("bookmaker_id").isin(bookmakers))
    return matches.join(seen.select(F.col("match_id").alias("_m")), F.col("id") == F.col("_m"), "left_semi")


def match_bookmakers(odds: DataFrame, bookmakers: DataFrame) -> DataFrame:
    """J-06, F-12: each match's sources by name."""
    pairs = odds.select("match_id", "bookmaker_id").distinct().join(bookmakers.select(F.col("id").alias("b_id"), "name"), F.col("bookmaker_id") == F.col("b_id"), "left")
    return pairs.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("name", "bookmaker_id"))).alias("bookmakers"))


def source_counts(odds: DataFrame) -> DataFrame:
    """F-14."""
    return odds.groupBy("bookmaker_id").agg(F.count("*").alias("odds_count"), F.count_distinct("match_id").alias("matches"))


def cycle_benchmark(tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """F-15, C-29: per source totals of the cycle's tasks, full-outer with what was stored."""
    ran = tasks.groupBy("bookmaker_id").agg(F.sum("duration_ms").alias("duration_ms"), F.sum("raw_items").alias("raw_items"), F.count("*").alias("leagues_attempted"), F.count_if("failed").alias("leagues_failed"))
    both = ran.join(counts, "bookmaker_id", "full")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("duration_ms", "raw_items", "leagues_attempted", "leagues_failed", "odds_count", "matches")}
    out = both.withColumns(zero)
    return out.withColumn("failure_rate", F.round(F.coalesce(F.try_divide("leagues_failed", "leagues_attempted"), F.lit(0.0)), 4))


def system_status(odds: DataFrame, matches: DataFrame, bookmakers: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """F-01, F-02, F-04: one row of totals."""
    a = odds.agg(F.count("*").alias("odds"), F.count_distinct("match_id").alias("matches_with_odds"), F.max("scraped_at").alias("last_scrape"))
    b = matches.agg(F.count("*").alias("matches"))
    c = bookmakers.agg(F.count_if("is_active").alias("active_bookmakers"))
    d = discrepancies.agg(F.count("*").alias("discrepancies"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four single rows


def review_history(cases: DataFrame, history: DataFrame, key: tuple[str, ...], snapshot: Column | str) -> DataFrame:
    """J-23, F-16: earlier books of each case group at or before the snapshot, and whether it was ever declined."""
    past = history.where(F.col("scraped_at") <= snapshot).groupBy(*key).agg(F.array_sort(F.collect_set("bookmaker_id")).alias("books"), F.bool_or(F.col("status") == "declined").alias("declined"))
    return cases.select(*key).distinct().join(past, list(key), "left")


class SnapshotStore:
    """Parquet tables below one folder, on any file system Spark can write."""

    #: U-06: tables of which every cycle's rows stay to be read.
    HISTORIES = frozenset({"odds", "unresolved", "reviews", "notifications", "benchmark"})

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def publish(self, stamp: str, **tables: DataFrame) -> None:
        """Write every table of a cycle (an empty one too) and the odds' part of the history, then move the pointer.

        Every write goes to a folder that the stamp names and overwrites it, so
        a cycle that is run again leaves what its first run would have left.
        """
        name = stamp.replace(":", "-")
        for table, df in tables.items():
            df.withColumn("scraped_at", F.lit(stamp)).write.mode("overwrite").parquet(self._path("snapshots", name, table))
        for table in self.HISTORIES & set(tables):
            self.spark.read.parquet(self._path("snapshots", name, table)).write.mode("overwrite").parquet(self._path(f"{table}_history", f"cycle={name}"))
        self.spark.createDataFrame([(1, stamp, name)], "id int, current_snapshot_at string, folder string").coalesce(1).write.mode("overwrite").parquet(self._path("scrape_state", name))
        self.point_to(name)

    def point_to(self, name: str) -> None:
        """U-05: make a snapshot the current one, be it older or newer than the one before."""
        turn = (self._pointers().agg(F.max("turn")).first()[0] or 0) + 1
        self.spark.createDataFrame([(json.dumps({"turn": turn, "current": name}),)], "value string").coalesce(1).write.mode("append").text(self._path("pointer"))

    def _pointers(self) -> DataFrame:
        """``turn, current``: one row each time the pointer was set."""
        rows = self._read("text", "pointer")
        if rows is None:
            return self.spark.createDataFrame([], "turn long, current string")
        return rows.select(F.get_json_object("value", "$.turn").cast("long").alias("turn"), F.get_json_object("value", "$.current").alias("current"))

    def _read(self, kind: str, *parts: str) -> DataFrame | None:
        try:
            return self.spark.read.format(kind).load(self._path(*parts))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def pointer(self) -> str | None:
        """The folder of the current snapshot: the one pointed to last."""
        return self._pointers().agg(F.max_by("current", "turn")).first()[0]

    def current(self, table: str) -> DataFrame | None:
        """A table of the current snapshot; None if there is no snapshot, or none of that table."""
        name = self.pointer()
        return None if name is None else self._read("parquet", "snapshots", name, table)

    def history(self, table: str = "odds") -> DataFrame | None:
        found = self._read("parquet", f"{table}_history")
        return None if found is None else found.drop("cycle")
