"""Sharding by minimax contiguous partition (native).

Groups of equal texts are atomic and ordered by their smallest id.  The
capacity of a shard is the smallest for which a greedy left-to-right filling
needs no more than ``shards`` shards, found by binary search; the cuts are made
where the filling at that capacity makes them.

The search never needs all group sizes at once.  The driver holds the sizes of
at most ``FAN`` blocks of neighbouring groups.  On blocks, a greedy walk can be
bracketed: taking every block as atomic gives a capacity that surely suffices,
taking blocks that hold several groups as divisible gives one that is surely
needed.  Only blocks in which one of the bracket's cuts falls are then split
into finer blocks, by one Spark aggregation over their groups, until the
bracket closes.  A round divides the id range of such a block by ``SPLIT``, so
64-bit ids need a handful of rounds at any size of the table.

One dominating group would leave a plain greedy filling with empty shards at
the end, since every other shard may grow to that group's size.  So the
partition is made lexicographically: a group that fills the capacity alone
gets a shard for itself, and the search is repeated for the groups on its left
and right with the shards that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

SHARDS = 16
SPLIT = 512
ROWS_A_BLOCK = 100_000


@dataclass(frozen=True)
class Block:
    """Neighbouring groups: ids of the first and last group, their bytes, their number, the largest group."""

    first: int
    last: int
    size: int
    groups: int
    most: int


def fill(sizes: list[int], capacity: int) -> list[int] | None:
    """Greedy filling with atomic sizes: the starts of all shards, or None if one size is over the capacity."""
    starts, load = [0], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if load + size > capacity:
            starts.append(i)
            load = 0
        load += size
    return starts


def minimax(sizes: list[int], shards: int) -> int:
    """Smallest capacity whose greedy filling takes at most ``shards`` shards (binary search)."""
    low, high = max([0, *sizes]), sum(sizes)
    low = max(low, -(-high // shards))
    while low < high:
        middle = (low + high) // 2
        starts = fill(sizes, middle)
        if starts is not None and len(starts) <= shards:
            high = middle
        else:
            low = middle + 1
    return high


def _needed(blocks: list[Block], shards: int) -> int:
    """A lower bound: the smallest capacity if blocks of several groups could be divided anywhere."""
    low, high = max([0, *(b.most for b in blocks)]), sum(b.size for b in blocks)
    low = max(low, -(-high // shards))
    while low < high:
        middle = (low + high) // 2
        used, load = 1, 0
        for b in blocks:
            if load + b.size <= middle:
                load += b.size
            elif b.groups == 1:
                used, load = used + 1, b.size
            else:
                over = load + b.size - middle
                more = -(-over // middle)
                used, load = used + more, over - (more - 1) * middle
        if used <= shards:
            high = middle
        else:
            low = middle + 1
    return high


def _open(blocks: list[Block], shards: int, low: int, high: int) -> set[int]:
    """Blocks of several groups that a cut may fall into at a capacity between ``low`` and ``high``.

    Walks both bounds at once: the earliest and the latest place of every cut, as byte offsets.
    """
    ends, total = [], 0
    for b in blocks:
        total += b.size
        ends.append(total)
    starts = [end - b.size for end, b in zip(ends, blocks, strict=True)]
    out: set[int] = set()
    early = late = 0
    for _ in range(shards):
        early, late = early + low, late + high
        if early >= total:
            break
        spread = [i for i in range(len(blocks)) if starts[i] < late and ends[i] > early - blocks[i].most]
        out |= {i for i in spread if blocks[i].groups > 1 and starts[i] < late and ends[i] > early}
        inside = [i for i in range(len(blocks)) if starts[i] < early < ends[i]]
        early = min([early, *(starts[i] if blocks[i].groups == 1 else max(starts[i], early - blocks[i].most) for i in inside)])
    return out


def group_sizes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (``id, size, crc, digest``) and groups of equal texts (``digest, first, bytes``), both cut."""
    text = F.col(text_col).cast("string")
    rows = cut(df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"),
    ))
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))
    groups = cut(rows.groupBy("digest").agg(F.min(key).alias("first"), F.sum("size").alias("bytes")))
    return rows, groups


def _blocks(groups: DataFrame, ranges: list[tuple[int, int]]) -> list[Block]:
    """Block sums of the groups whose ``first`` lies in one of the ranges (first, last), each range split evenly."""
    split = max(2, SPLIT // len(ranges))
    where, piece = F.lit(False), F.lit(None).cast("long")
    for i, (low, high) in enumerate(ranges):
        step = max(1, -(-(high - low + 1) // split))
        inside = F.col("first").between(low, high)
        where |= inside
        place = F.floor((F.col("first").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("long")
        piece = F.when(inside, place + i * 10**6).otherwise(piece)
    parts = groups.where(where).groupBy(piece.alias("piece"), "first").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.count("*").alias("n"))
    sums = parts.groupBy("piece").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.sum("bytes").alias("size"), F.count("*").alias("groups"), F.max("bytes").alias("most"))
    return sorted((Block(r["first"], r["last"], r["size"], r["groups"], r["most"]) for r in sums.collect()), key=lambda b: b.first)


def _cuts(groups: DataFrame, blocks: list[Block], shards: int) -> list[int]:
    """``first`` of the group that opens each shard but the first."""
    if shards <= 1 or not blocks:
        return []
    while True:
        high = minimax([b.size for b in blocks], shards)
        low = _needed(blocks, shards)
        several = {i for i, b in enumerate(blocks) if b.groups > 1}
        opened = set() if low == high else _open(blocks, shards, low, high) or several
        if not opened:
            break
        ranges: list[tuple[int, int]] = []
        for i in sorted(opened):
            if i - 1 in opened:
                ranges[-1] = (ranges[-1][0], blocks[i].last)
            else:
                ranges.append((blocks[i].first, blocks[i].last))
        fine = _blocks(groups, ranges)
        blocks = sorted([b for i, b in enumerate(blocks) if i not in opened] + fine, key=lambda b: b.first)
    largest = max(range(len(blocks)), key=lambda i: blocks[i].size)
    total = sum(b.size for b in blocks)
    if blocks[largest].groups == 1 and blocks[largest].size == high and blocks[largest].size * shards > total and shards > 1 and len(blocks) > 1:
        left, right = blocks[:largest], blocks[largest + 1 :]
        rest = total - blocks[largest].size
        mine = 0
        if left:
            mine = round((shards - 1) * sum(b.size for b in left) / rest) if rest else 0
            mine = min(max(1, mine), shards - 1 - (1 if right and shards > 2 else 0))
        if not (left and right and shards == 2):
            others = shards - 1 - mine
            out = _cuts(groups, left, mine) + ([blocks[largest].first] if left else [])
            return out + ([right[0].first] + _cuts(groups, right, others) if right and others else [])
    starts = fill([b.size for b in blocks], high) or [0]
    return [blocks[i].first for i in starts[1:]]


def shard_cuts(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """At most ``shards - 1`` ids: a group belongs to the shard whose number is that of the cuts at or under its ``first``."""
    ends = groups.agg(F.min("first"), F.max("first")).first()
    if ends[0] is None:
        return []
    return _cuts(groups, _blocks(groups, [(ends[0], ends[1])]), shards)


def assign_shards(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, crc, shard, slot`` for every row, under the law ``bytes``.

    Size is the UTF-8 bytes of the text (none if null) plus one; null and empty
    texts are equal texts.  Slots number a shard's rows without gaps, by id.
    Defined cases: null ids come first; rows repeated with the same id get
    slots of their own, in any order among themselves; an empty table gives no
    rows; fewer groups than shards leave shards empty; other columns are ignored.
    """
    rows, groups = group_sizes(df, id_col, text_col)
    cuts = shard_cuts(groups, shards)
    shard = sum((F.when(F.col("first") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = rows.join(groups.select("digest", shard.alias("shard")), "digest").select("id", "size", "crc", "shard", F.monotonically_increasing_id().alias("tie"))
    placed = cut(placed)
    many = max(1, -(-placed.count() // ROWS_A_BLOCK), shuffle_partitions(df.sparkSession))
    # blocks of neighbouring rows of about equal numbers, by sampled quantiles; the tie splits rows that share an id
    order = ["shard", F.col("id").asc_nulls_first(), "tie"]
    placed = placed.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("turn", F.monotonically_increasing_id())
    # a row's turn is its block's number times 2**33 plus its place in the block
    placed = cut(placed.select("id", "size", "crc", "shard", F.shiftright("turn", 33).alias("block"), F.col("turn").bitwiseAND(F.lit(2**33 - 1)).alias("place")))
    runs = placed.groupBy("shard", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n") - F.col("first")
    shifts = cut(runs.select("shard", "block", before.alias("shift")))  # at most one row a block, and one more a shard
    out = placed.join(F.broadcast(shifts), ["shard", "block"])
    return out.select("id", "size", "crc", "shard", (F.col("place") + F.col("shift")).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = assign_shards(docs, SHARDS)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
