"""Registries of teams and leagues: aliases, their resolution, and changes to them.

Tables: ``teams(team_id, sport, display_name, is_active, merged_into)``,
``aliases(alias_id, sport, normalized_alias, bookmaker_id, source, team_id)``
where an empty bookmaker means global scope.  Every distinct label is resolved
once and joined back, however many quotes carry it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import team_score
from ..functions.text import canonical_league_id, humanize_league, identity_text, scope_key

BROADCAST_ROWS = 20_000


def resolve_labels(labels: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """J-10 and W-01: ``sport, bookmaker_id, label, team_id, team_name, source`` of the labels that some alias knows.

    Own-bookmaker aliases come before global ones, canonical sources before
    others, then the lowest alias id.
    """
    wanted = labels.select("sport", "bookmaker_id", "label").distinct().withColumn("key", identity_text(F.col("label"))).withColumn("scope", scope_key(F.col("bookmaker_id")))
    known = aliases.join(teams.where("is_active").select(F.col("team_id").alias("t_id"), "display_name"), F.col("team_id") == F.col("t_id"))
    known = known.select(F.col("sport").alias("a_sport"), "normalized_alias", F.col("bookmaker_id").alias("a_scope"), "source", "alias_id", "team_id", "display_name")
    on = (F.col("sport") == F.col("a_sport")) & (F.col("key") == F.col("normalized_alias")) & ((F.col("a_scope") == F.col("scope")) | (F.col("a_scope") == ""))
    order = F.struct((F.col("a_scope") != F.col("scope")).cast("int"), (F.col("source") != "canonical").cast("int"), "alias_id")
    best = wanted.join(known, on).groupBy("sport", "bookmaker_id", "label").agg(F.min_by(F.struct("team_id", "display_name", "source"), order).alias("t"))
    return best.select("sport", "bookmaker_id", "label", "t.team_id", F.col("t.display_name").alias("team_name"), "t.source")


def with_teams(raw: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """``raw`` with ``home_id, home_name, away_id, away_name``; unknown labels keep their trimmed text and a null id."""
    labels = raw.select("sport", "bookmaker_id", F.explode(F.array("home_team", "away_team")).alias("label"))
    known = bounded(resolve_labels(labels, teams, aliases))
    for side in ("home", "away"):
        mine = known.select(F.col("sport").alias("_s"), F.col("bookmaker_id").alias("_b"), F.col("label").alias("_l"), F.col("team_id").alias(f"{side}_id"), F.col("team_name").alias("_n"))
        on = (F.col("sport") == F.col("_s")) & F.col("bookmaker_id").eqNullSafe(F.col("_b")) & (F.col(f"{side}_team") == F.col("_l"))
        raw = raw.join(mine, on, "left").withColumn(f"{side}_name", F.coalesce("_n", F.trim(f"{side}_team"))).drop("_s", "_b", "_l", "_n")
    return raw


def resolve_leagues(labels: DataFrame, leagues: DataFrame, aliases: DataFrame) -> DataFrame:
    """J-11: ``bookmaker_id, label, league_id, league_name``; own alias, then global alias, then canonical id, then a slug.

    ``leagues(id, name)``; ``aliases(bookmaker_id, alias, league_id)``, '' being global; an alias is in normal form, an id has underscores.
    """
    wanted = labels.select("bookmaker_id", "label").distinct().withColumn("spoken", identity_text(F.col("label"))).withColumn("key", canonical_league_id(F.col("label"))).withColumn("scope", scope_key(F.col("bookmaker_id")))
    own = aliases.where("bookmaker_id <> ''").select(F.col("bookmaker_id").alias("o_scope"), F.col("alias").alias("o_key"), F.col("league_id").alias("own_id"))
    every = aliases.where("bookmaker_id = ''").select(F.col("alias").alias("g_key"), F.col("league_id").alias("global_id"))
    direct = leagues.select(F.col("id").alias("d_key"))
    found = wanted.join(own, (F.col("scope") == F.col("o_scope")) & (F.col("spoken") == F.col("o_key")), "left").join(every, F.col("spoken") == F.col("g_key"), "left").join(direct, F.col("key") == F.col("d_key"), "left")
    found = found.withColumn("league_id", F.coalesce("own_id", "global_id", "d_key", "key"))
    names = leagues.select(F.col("id").alias("n_id"), F.col("name").alias("n_name"))
    named = found.join(names, F.col("league_id") == F.col("n_id"), "left")
    return named.select("bookmaker_id", "label", "league_id", F.coalesce("n_name", humanize_league(F.col("league_id"))).alias("league_name"))


def search_candidates(labels: DataFrame, teams: DataFrame, aliases: DataFrame, limit: int = 3, least: float = 0.0) -> DataFrame:
    """J-14: ``sport, label, candidates``, the best ``limit`` teams of the sport by fuzzy score over name and aliases.

    Labels meet all teams of their sport through an equi-join on the sport.
    Names equal to the label in normal form are no candidates.
    """
    wanted = labels.select("sport", "label").distinct().withColumn("key", identity_text(F.col("label"))).where("key <> ''")
    active = teams.where("is_active").select(F.col("team_id").alias("t_id"), F.col("sport").alias("t_sport"), "display_name")
    spelled = active.select("t_id", "t_sport", "display_name", F.col("display_name").alias("spelling")).unionByName(
        active.join(aliases.select("team_id", F.col("normalized_alias").alias("spelling")), F.col("t_id") == F.col("team_id")).select("t_id", "t_sport", "display_name", "spelling")
    )
    spelled = spelled.withColumn("other", identity_text(F.col("spelling"))).where("other <> ''").distinct()
    pairs = wanted.join(spelled, (F.col("sport") == F.col("t_sport")) & (F.col("key") != F.col("other")))
    scored = pairs.withColumn("score", F.round(team_score(F.col("key"), F.col("other")), 6)).where(F.col("score") > 0)
    own_name = (F.col("spelling") != F.col("display_name")).cast("int")
    best = scored.groupBy("sport", "label", "t_id", "display_name").agg(F.max_by(F.struct("score", "spelling"), F.struct("score", -own_name)).alias("b")).where(F.col("b.score") >= least)
    order = W.partitionBy("sport", "label").orderBy(F.desc("b.score"), "display_name")
    top = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    entry = F.struct("place", F.col("t_id").alias("team_id"), F.col("display_name").alias("team_name"), F.col("b.score").alias("score"), F.when(F.col("b.spelling") != F.col("display_name"), F.col("b.spelling")).alias("matched_alias"))
    return top.groupBy("sport", "label").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))


def upsert_aliases(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """U-12, U-13: the alias table after ``changes`` (same columns); the latest ``alias_id`` of a key wins, but ``auto_review`` never replaces another alias."""
    keyed = aliases.select("*", F.lit(0).alias("turn")).unionByName(changes.select("*", F.lit(1).alias("turn")))
    rank = F.struct((F.col("turn") == 1) & (F.col("source") != "auto_review"), F.col("turn") == 0, "alias_id")
    best = keyed.groupBy("sport", "normalized_alias", "bookmaker_id").agg(F.max_by(F.struct("alias_id", "source", "team_id"), rank).alias("a"))
    return best.select("a.alias_id", "sport", "normalized_alias", "bookmaker_id", "a.source", "a.team_id")


def forget_alias(aliases: DataFrame, sport: str, alias: str, bookmaker_id: str = "", source: str | None = None) -> DataFrame:
    """U-14."""
    match = (F.col("sport") == sport) & (F.col("normalized_alias") == identity_text(F.lit(alias))) & (F.col("bookmaker_id") == bookmaker_id)
    return aliases.where(~(match & (F.lit(True) if source is None else F.col("source") == source)))


def numbered(rows: DataFrame, order: list[str], name: str, existing: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a column ``name``: whole numbers without gaps, in the given order, on from the largest ``id_col`` of ``existing``.

    Rows are dealt into ranges of the order; a range's rows are numbered by
    themselves, and what the ranges before it hold is a sum over one row a range.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    out = dealt.join(F.broadcast(before), F.col("_range") == F.col("_r")).crossJoin(F.broadcast(top))  # one row a partition, and one row
    return out.withColumn(name, (F.col("_top") + F.col("_before") + place).cast("long")).drop("_range", "_r", "_before", "_top")


def create_teams(teams: DataFrame, names: DataFrame) -> DataFrame:
    """U-11: teams not yet known by normal form, numbered on from the largest id in the order of ``seq``.  ``names``: ``sport, display_name, seq``."""
    known = teams.select(F.col("sport").alias("k_sport"), identity_text(F.col("display_name")).alias("k_key"))
    fresh = names.withColumn("key", identity_text(F.col("display_name"))).join(known, (F.col("sport") == F.col("k_sport")) & (F.col("key") == F.col("k_key")), "left_anti")
    one = fresh.groupBy("sport", "key").agg(F.min_by(F.struct("display_name", "seq"), "seq").alias("n")).select("sport", "n.display_name", "n.seq")
    with_ids = numbered(one, ["seq", "sport", "display_name"], "team_id", teams, "team_id")
    return with_ids.select("team_id", "sport", "display_name", F.lit(True).alias("is_active"), F.lit(None).cast("long").alias("merged_into"))


def follow_merges(edges: DataFrame) -> DataFrame:
    """U-16: ``team_id, final_id``, following ``merged_into`` by pointer doubling; a chain that runs into a cycle ends at the cycle's smallest id.

    The number of rounds is the logarithm of the number of teams.
    """
    seen = checkpointed(edges.select("team_id", F.coalesce("merged_into", "team_id").alias("final_id"), F.col("merged_into").isNull().alias("root")).withColumn("low", F.col("final_id")))
    rounds = max(1, seen.count().bit_length())
    for _ in range(rounds):
        step = seen.select(F.col("team_id").alias("n_id"), F.col("final_id").alias("n_final"), F.col("low").alias("n_low"))
        seen = checkpointed(seen.join(step, F.col("final_id") == F.col("n_id"), "left").select("team_id", F.coalesce("n_final", "final_id").alias("final_id"), "root", F.least("low", F.coalesce("n_low", "low")).alias("low")))
    ends = seen.select(F.col("team_id").alias("e_id"), F.col("root").alias("e_root"), F.col("low").alias("e_low"))
    ended = F.coalesce("e_root", F.lit(True))
    return seen.join(ends, F.col("final_id") == F.col("e_id"), "left").select("team_id", F.when(ended, F.col("final_id")).otherwise(F.col("e_low")).alias("final_id"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder; a local one is set only where none is and the master is local."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint(eager=True)


def bounded(df: DataFrame) -> DataFrame:
    """A table that is small as a rule, cut and counted: broadcast up to ``BROADCAST_ROWS`` rows, else joined as Catalyst finds best."""
    cut = checkpointed(df)
    return F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut


def merge_teams(teams: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U-15: teams and aliases after merging ``source_id`` into ``target_id`` (``mapping``).

    Aliases that the target has already are dropped, the others are repointed;
    the source's name becomes a global alias of the target; the source goes
    inactive.
    """
    m = mapping.select("source_id", "target_id")
    moved = aliases.join(m, aliases["team_id"] == m["source_id"], "left").withColumn("moved", F.col("target_id").isNotNull()).withColumn("team_id", F.coalesce("target_id", "team_id")).drop("source_id", "target_id")
    first = W.partitionBy("sport", "normalized_alias", "bookmaker_id").orderBy("moved", "alias_id")
    kept = moved.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "moved")
    gone = teams.join(m, teams["team_id"] == m["source_id"])
    named = gone.select("sport", identity_text(F.col("display_name")).alias("normalized_alias"), F.lit("").alias("bookmaker_id"), F.lit("merge").alias("source"), F.col("target_id").alias("team_id"))
    key = ["sport", "normalized_alias", "bookmaker_id"]
    missing = named.join(kept.select(*key), key, "left_anti").groupBy(*key, "source").agg(F.min("team_id").alias("team_id"))
    with_names = kept.unionByName(numbered(missing, key, "alias_id", aliases, "alias_id").select(*kept.columns))
    after = teams.join(m, teams["team_id"] == m["source_id"], "left").select(*(c for c in teams.columns if c not in ("is_active", "merged_into")), (F.col("is_active") & F.col("target_id").isNull()).alias("is_active"), F.coalesce("target_id", "merged_into").alias("merged_into"))
    return after, with_names


def shared_aliases(aliases: DataFrame, left: Column | int, right: Column | int) -> DataFrame:
    """I-04: alias keys that both teams have."""
    keys = lambda t: aliases.where(F.col("team_id") == t).select("sport", "normalized_alias", "bookmaker_id")
    return keys(left).intersect(keys(right))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """I-01: all sources' rows, by name."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
