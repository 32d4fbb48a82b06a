"""Exact dedup with a heavy-hitter split (native).

Misra-Gries counters (``DataFrame.stat.freqItems``, a JVM aggregate whose state
is bounded by ``1 / support`` digests) name every digest that may hold at least
``support`` of the rows.  One exact count of those candidates verifies them and
finds each one's winner; that table has at most ``1 / support`` rows whatever
the input, so it is broadcast and the rows of heavy digests are settled on the
map side, without a shuffle.  All other digests, none of which can be large,
go through the ordinary shuffle by digest: groups are counted with partial sums
first, and what joins back are groups of several rows, whose keys adaptive
execution can split.

Texts are never shuffled: only ``(id, digest)`` pairs are.  A digest is the
SHA-256 of the text after lower-casing A-Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut

SUPPORT = 1 / 512
#: Rows to drop up to which their ids and digests are broadcast, so that texts stay where they are.
BROADCAST_LOSERS = 200_000


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` for every row; a null text counts as empty."""
    text: Column = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return df.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Of the rows with equal texts (A-Z lower-cased, null as empty) the one with
    the largest id stays.  Defined cases: null ids rank below every other id,
    and a group of nothing but null ids keeps them (``keep_id`` null); rows
    repeated with the same id count one by one in ``group_size``, and all rows
    with the largest id are marked as kept; an empty table gives no rows; other
    columns are ignored whatever their names.
    """
    marked = cut(digests(df, id_col, text_col))
    heavy = _verified(marked, support)
    joined = marked.join(F.broadcast(heavy), "digest", "left")
    settled = joined.where(F.col("size").isNotNull()).select("id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "digest")
    light = joined.where(F.col("size").isNull()).select("id", "digest")
    groups = light.groupBy(F.col("digest").alias("_digest")).agg(F.max("id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    rest = light.join(groups, F.col("digest") == F.col("_digest"), "left")
    rest = rest.select("id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), "digest")
    both = settled.unionByName(rest)
    return both.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _verified(marked: DataFrame, support: float) -> DataFrame:
    """Exact size and winner of the digests that may be frequent; at most ``1 / support`` rows."""
    frequent = marked.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).distinct()
    counted = marked.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    return cut(counted.where(F.col("size") > 1))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT, broadcast_losers: int = BROADCAST_LOSERS) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns; of rows repeated with the same id and text, one stays."""
    judged = cut(exact_dedup(df, id_col, text_col, support))
    lost = judged.where(~F.col("kept")).select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    kept = judged.where(F.col("kept") & (F.col("group_size") > 1))
    repeated = kept.groupBy("id", "digest").count().where("count > 1").limit(1).count()  # else texts need no shuffle of their own
    lost = cut(lost)
    few = lost.count() <= broadcast_losers
    numbered = df.withColumn("_digest_in", F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256))
    stay = numbered.join(F.broadcast(lost) if few else lost, numbered[id_col].eqNullSafe(lost["_id"]) & (numbered["_digest_in"] == lost["_digest"]), "left_anti")
    return (stay.dropDuplicates([id_col, "_digest_in"]) if repeated else stay).select(*df.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = exact_dedup(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
