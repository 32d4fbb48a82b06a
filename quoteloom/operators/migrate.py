"""Schema changes of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """U-20: ``df`` in the columns and types of ``schema``; missing columns get their default, surplus ones go."""
    defaults = defaults or {}
    have = set(df.columns)
    value = lambda f: F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))
    return df.select(*(value(f).cast(f.dataType).alias(f.name) for f in schema))


def null_dangling(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """D-19, J-25: references without a target become null."""
    known = target.select(F.col(key).alias("_known")).distinct()
    joined = df.join(known, df[column] == F.col("_known"), "left")
    return joined.select(*(F.when(F.col("_known").isNotNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns))


def merge_problems(matches: DataFrame, mapping: DataFrame) -> DataFrame:
    """U-10: the pairs of a match merge that must not be merged, with the reason; no rows means go ahead."""
    side = lambda p: matches.select(F.col("id").alias(f"{p}_id"), F.col("sport").alias(f"{p}_sport"), F.col("start_time").alias(f"{p}_start"))
    both = mapping.join(side("s"), F.col("source_id") == F.col("s_id"), "left").join(side("t"), F.col("target_id") == F.col("t_id"), "left")
    reason = (
        F.when(F.col("source_id") == F.col("target_id"), "same_match").when(F.col("s_id").isNull(), "unknown_source").when(F.col("t_id").isNull(), "unknown_target")
        .when(F.col("s_sport") != F.col("t_sport"), "different_sport").when(~F.col("s_start").eqNullSafe(F.col("t_start")), "different_start")
    )
    return both.select("source_id", "target_id", reason.alias("reason")).where("reason is not null")


def approve_reviews(cases: DataFrame, approved_ids: list[int], stamp: str) -> DataFrame:
    """U-08, C-28: cases marked as approved; a first approval time stays."""
    mine = F.col("id").isin(approved_ids)
    return cases.withColumns({"status": F.when(mine, "approved").otherwise(F.col("status")), "approved_at": F.when(mine, F.coalesce("approved_at", F.lit(stamp))).otherwise(F.col("approved_at"))})


def deactivate(discrepancies: DataFrame, fresh: DataFrame) -> DataFrame:
    """U-07: all former discrepancies inactive, the new ones active."""
    return discrepancies.withColumn("is_active", F.lit(False)).unionByName(fresh.withColumn("is_active", F.lit(True)))
