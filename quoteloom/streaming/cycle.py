"""The scrape cycle as a Structured Streaming micro-batch.

Each micro-batch is one cycle: the raw quotes that arrived are resolved,
normalised, compared and published as one snapshot.  Teams and aliases are part
of the snapshot, so a cycle starts from what the one before it has learnt, and
numbers that were given to a team stay with it.  The pointer moves last, so a
failed batch leaves the former snapshot in place, aliases included, and its
retry writes the same folders again.  One checkpoint is one running query, which
is the single-flight guard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import canonical_league_id, identity_text
from ..operators import analyze, decisions, registry, resolve, store
from ..operators.registry import checkpointed
from ..operators.store import SnapshotStore

TEAMS = "team_id long, sport string, display_name string, is_active boolean, merged_into long"
ALIASES = "alias_id long, sport string, normalized_alias string, bookmaker_id string, source string, team_id long"
LOST = ("seq", "bookmaker_id", "sport", "market_type", "player_name", "raw_team_name", "reason_code", "candidate_count")


@dataclass(frozen=True)
class Normalized:
    """What the passes give: final quotes, quotes without a place, review cases, and the registry after them."""

    quotes: DataFrame
    unresolved: DataFrame
    reviews: DataFrame
    teams: DataFrame
    aliases: DataFrame


def normalize(raw: DataFrame, teams: DataFrame, aliases: DataFrame) -> Normalized:
    """The passes in their order.

    What several later steps read is cut, so that no pass runs twice.  Quotes
    without a start leave first; new teams of repeated matchups are
    known to every later pass.
    """
    timed, missing = resolve.split_missing_start(raw)
    names = checkpointed(resolve.autocreate_names(timed, teams, aliases))
    new = checkpointed(registry.create_teams(teams, names))
    every = checkpointed(teams.unionByName(new))
    spelled = checkpointed(decisions.with_canonical(every, aliases))
    placed, lost = resolve.resolve_matchups(timed, every, spelled)
    lost = checkpointed(lost.select(*LOST))
    leagues = registry.bounded(timed.select(F.col("league_id").alias("_l")).distinct().withColumn("voted_league", canonical_league_id(F.col("_l"))))
    resolved = registry.with_teams(placed, every, spelled).join(leagues, F.col("league_id").eqNullSafe(F.col("_l")), "left").drop("_l")
    resolved = checkpointed(resolve.contextual_players(checkpointed(resolved)))
    votes = checkpointed(resolve.event_votes(resolved))
    quotes = checkpointed(resolve.normalized_odds(resolved, votes))
    unresolved = lost.unionByName(missing.select(*LOST))
    cases = checkpointed(resolve.review_cases(resolved.where(~resolve.shared_platform()), votes, every, spelled))
    return Normalized(quotes, unresolved, cases, every, spelled)


def auto_approve(found: Normalized, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """U-17: review cases with a ``status``, and the aliases after the anchored suggestions that are approved at once.

    ``history`` holds the cases of earlier cycles.  An alias that the guards
    refuse leaves its case pending.
    """
    spark = found.reviews.sparkSession
    past = spark.createDataFrame([], "sport string, norm string, team_id long, start_time string, bookmaker_id string, status string")
    if history is not None:
        past = history.select("sport", identity_text(F.col("raw_team_name")).alias("norm"), F.col("suggested_team_id").alias("team_id"), "start_time", "bookmaker_id", "status")
    cases = found.reviews.withColumn("norm", identity_text(F.col("raw_team_name")))
    fit = checkpointed(resolve.auto_aliases(found.reviews, past))
    key = ["sport", "norm", "start_time", "bookmaker_id"]
    chosen = cases.join(fit.withColumnRenamed("team_id", "suggested_team_id"), [*key, "suggested_team_id"], "left_semi")
    requests = chosen.select(F.xxhash64(*key, "suggested_team_id").alias("request_id"), "sport", "bookmaker_id", "raw_team_name", F.col("suggested_team_name").alias("team_name"), F.lit("auto_review").alias("source")).distinct()
    judged, aliases = decisions.remember_aliases(found.teams, found.aliases, requests)
    taken = judged.where("outcome in ('saved', 'kept')").select("sport", F.col("key").alias("norm"), "bookmaker_id").distinct()
    done = chosen.join(taken, ["sport", "norm", "bookmaker_id"], "left_semi").select(*key, F.lit("approved").alias("new")).distinct()
    marked = cases.join(done, key, "left").withColumn("status", F.coalesce("new", F.lit("pending")))
    kind = F.when(F.col("status") == "approved", "auto_alias").otherwise(F.col("review_kind"))
    return checkpointed(marked.withColumn("review_kind", kind).drop("norm", "new")), checkpointed(aliases)


def run_cycle(
    keep: SnapshotStore, raw: DataFrame, teams: DataFrame, aliases: DataFrame, stamp: str, min_gap: float = 0.0, notify_from: float = 1.5, tasks: DataFrame | None = None,
) -> None:
    """One cycle; an empty batch publishes an empty snapshot.

    ``teams`` and ``aliases`` count only where the store has no snapshot yet.
    ``tasks`` are the readers' timings (see ``store.cycle_benchmark``).
    """
    before, known = keep.current("teams"), keep.current("aliases")
    if before is not None and known is not None:
        teams, aliases = before.drop("scraped_at"), known.drop("scraped_at")
    teams, aliases = (x.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in kind.split(", "))) for x, kind in ((teams, TEAMS), (aliases, ALIASES)))
    history = keep.history("reviews")
    if history is not None:
        history = history.where(F.col("scraped_at") < stamp)
    found = normalize(raw, teams, aliases)
    reviews, spelled = auto_approve(found, history)
    gaps = checkpointed(analyze.counted_discrepancies(found.quotes, min_gap))
    ran = raw.sparkSession.createDataFrame([], "bookmaker_id string, duration_ms long, raw_items long, failed boolean") if tasks is None else tasks
    matches = store.first_of_match(found.quotes)
    keep.publish(
        stamp, odds=found.quotes, matches=matches, unresolved=found.unresolved, reviews=reviews, discrepancies=gaps, teams=found.teams, aliases=spelled,
        notifications=analyze.notifications(gaps, notify_from), benchmark=store.cycle_benchmark(ran, store.source_counts(found.quotes)),
    )


def start(spark: SparkSession, raw_stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], interval: str | None = None) -> StreamingQuery:
    """Run ``on_batch`` for every micro-batch: on an interval, or once over what is there."""
    writer = raw_stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
