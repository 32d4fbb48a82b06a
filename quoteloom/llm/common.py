"""Small helpers shared by the operators: lineage cuts, Arrow plumbing, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Edges up to which one task finds the components by union-find; beyond, the rounds over DataFrames do.
SMALL_GRAPH = 200_000


def cut(df: DataFrame, tidy: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from that copy.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a
    local one is set only where the setting is empty (tests, one machine).
    With ``tidy`` garbage is collected afterwards, so that shuffle files nobody
    needs any more leave the executors' disks early.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    out = df.checkpoint(eager=True)
    if tidy:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let go of what nothing refers to any more: Spark then deletes its shuffle and checkpoint files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, schema: T.StructType | str, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return df.mapInArrow(step, schema)


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column`` each, so that Python never holds much text at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the edges ``u, v`` with the smallest node it hangs together with."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps; a small one (``SMALL_GRAPH``, counted) in one task.

    Returns ``node, component`` for every node of an edge, the component being
    its smallest node.  Every round keeps at most as many edges as before, all
    state is in DataFrames, and each round is cut in the checkpoint folder.
    Rounds go on until the edges stay as they are, which they do after a number
    of rounds that grows with the logarithm of the nodes.
    Loops and repeated edges are fine; an empty edge list gives no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null").distinct())
    many = now.count()
    if many <= SMALL_GRAPH:  # a checked bound: one task holds all of it
        return arrow_map(now.coalesce(1), "node bigint, component bigint", _union_find)
    nodes = now
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small, tidy=False)
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == state:
            break
        before = state
    found = now.groupBy("u").agg(F.min("v").alias("m"))
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(found, every["node"] == found["u"], "left").select("node", F.coalesce("m", "node").alias("component"))
