"""Queries on the streaming cycle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import SnapshotStore
from ..sources import domain
from ..streaming import cycle


def _shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage raw quotes in two halves, run the stream after each over what is new, a cycle a half, and read the last snapshot back."""
    folder = _shared_folder(spark)
    raw = domain.raw_offers(spark, sf_dir)
    store, teams, aliases = SnapshotStore(spark, f"{folder}/store"), domain.teams(spark, sf_dir), domain.aliases(spark, sf_dir)
    for part in range(2):
        raw.where(F.pmod("seq", F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/in")
        query = cycle.start(spark, stream, f"{folder}/state", lambda df, number: cycle.run_cycle(store, df, teams, aliases, f"2026-01-01T00:{number:02d}:00", 10.0))
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    current = store.current("odds")
    return current.groupBy("scraped_at", "market_type").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("matches"))


QUERIES = {"stream_cycle": stream_cycle}
ORACLES: dict[str, str] = {}
