"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and
   a SuperMinHash signature.  Documents with the same set form a *class*; from
   here on each class is one node with a number of its own, and one row's text
   stands for it.
2. Signatures are cut into bands; representatives with an equal band meet in a
   bucket.  A bucket only says "each member may be linked with the smallest",
   so it gives a star and never its pairs; the stars' connected components are
   *clusters*.  All links inside a bucket lie inside one cluster.
3. Links are confirmed on the full sets.  First every member is compared with
   the smallest one that it shares a band with: one pair a member, however large
   its buckets are.  That joins most members of a hot group to one component.
4. Only clusters whose members are still in several components go on.  Such a
   cluster is dealt into blocks of limited bytes, ordered by set size, and every
   two blocks whose sizes allow the asked similarity, and which do not belong to
   one component as a whole, meet in one task.  The task starts from the
   components already known, finds candidates by their rarest shingles (two
   linked sets share one of each one's first ``n - ceil(percent * n) + 1``, so
   none is lost), verifies them on the sets and skips pairs that its union-find
   already holds together: it gives a spanning forest of the links.
5. The connected components of all confirmed links are the result.

Nothing is capped: a hot bucket or cluster becomes more blocks, not a longer
task.  What can be lost is a pair over the threshold that shares no band: under
1e-8 at similarity 0.85 with 32 bands of 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, components, cut, small_batches, texts_of
from .wordhash import U64, Words, blocks, mix

WIDTH = 5
BANDS, ROWS = 32, 5
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 4096
STAR = 512  # members that one copy of a star's smallest set is compared with
NONE = np.uint64(2**64 - 1)


def super_min_hash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit elements.

    Each element walks the m places in a random order of its own (a Fisher-Yates
    shuffle), putting the value ``step + r`` with a fresh r at its step-th place;
    a place keeps the least value.  All elements take the same step at once.  A
    value of a step is smaller than any of a later one, so a place that one
    step has reached is final, and the walk ends early once every place is.
    """
    out = np.full(m, NONE, U64)
    n = len(elements)
    if not n:
        return out
    state = elements
    order: np.ndarray | None = None
    lines = np.arange(n)
    for step in range(m):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        pick = step + ((state >> U64(8)) % U64(m - step)).astype(np.int64)
        if order is None:
            place = pick
        else:
            place = order[lines, pick].astype(np.int64)
            order[lines, pick] = order[:, step]
            order[:, step] = place
        fresh = np.full(m, NONE, U64)
        np.minimum.at(fresh, place, (U64(step) << U64(56)) | (mix(state) >> U64(8)))
        open_ = out == NONE
        out[open_] = fresh[open_]
        if not (out == NONE).any():
            break
        if order is None:  # most sets are done after one step and never need their orders
            order = np.tile(np.arange(m, dtype=np.int16), (n, 1))
            order[lines, pick] = 0
            order[:, 0] = pick
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = signature[: bands * rows].reshape(bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    for k in range(rows):
        key = mix(key * U64(3) + grid[:, k])
    return key


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted set of each text: distinct shingles of ``width`` words, or the whole sequence if there are fewer words."""
    for _, block in blocks(texts):
        words = Words([t.lower() for t in block])
        shingles = words.windows(width)
        for k in range(len(block)):
            first, last = words.first[k], words.first[k + 1]
            if last - first >= width:
                yield np.unique(shingles[first : last - width + 1])
            elif last > first:
                key = np.array([last - first], U64)
                for i in range(first, last):
                    key = mix(key * U64(3) + words.hash[i : i + 1])
                yield key
            else:
                yield np.zeros(0, U64)


def profiles(df: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``id, t, n, high, low, keys``: hash of the text, set size, set digest and band keys."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, t bigint, n bigint, high bigint, low bigint, keys array<bigint>"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text"):
                n, high, low, keys = [], [], [], []
                for found in shingle_sets(texts_of(part, "text"), width):
                    signature = super_min_hash(found, bands * rows)
                    n.append(len(found))
                    high.append(int(mix(found).sum(dtype=U64).view(np.int64)))
                    low.append(int(np.bitwise_xor.reduce(mix(found + U64(1))).view(np.int64)) if len(found) else 0)
                    keys.append(band_keys(signature, bands, rows).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("t"), *(pa.array(x, pa.int64()) for x in (n, high, low)), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "t", "n", "high", "low", "keys"],
                )

    return arrow_map(df.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text", f"xxhash64(cast(`{text_col}` as string)) as t"), schema, step)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection is at least ``percent`` hundredths of the union."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = shared(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def rare_parts(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Postings of each set's rarest elements: members by element, the bounds of each element's, and each set's elements in it.

    A set of n elements enters with its ``n - ceil(percent * n / 100) + 1``
    rarest; two sets whose intersection is at least ``percent`` hundredths of
    the union have one of these in common.
    """
    sizes = np.array([len(s) for s in sets])
    every, number = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(number, minlength=len(every))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((number, often[number], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chosen = place < np.repeat(sizes + percent * sizes // -100 + 1, sizes)
    member, element = owner[order][chosen], number[order][chosen]
    rare = np.split(element, np.searchsorted(member, np.arange(1, len(sets))))
    by_element = np.argsort(element, kind="stable")
    return member[by_element], np.searchsorted(element[by_element], np.arange(len(every) + 1)), rare


def linked_pairs(sets: list[np.ndarray], component: np.ndarray, split: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links among ``sets`` that join what ``component`` holds apart, as a spanning forest; with ``split``, only links between those before it and those from it on."""
    if len(sets) < 2:
        return
    component = component.copy()
    sizes = np.array([len(s) for s in sets])
    members, bounds, rare = rare_parts(sets, percent)
    for i in range(split or len(sets)):
        met = [members[bounds[e] : bounds[e + 1]] for e in rare[i].tolist()]
        others = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        others = others[(others >= split) & (others > i) & (component[others] != component[i])]
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        while len(others):
            j, others = int(others[0]), others[1:]
            if is_link(sets[i], sets[j], percent):
                yield i, j
                component[component == component[j]] = component[i]
                others = others[component[others] != component[i]]


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``id, n_shingles, component_id`` for every row.

    Two rows are linked if the intersection of their shingle sets is at least
    ``percent`` hundredths of the union; a component is named by its smallest
    id.  Defined cases: null and empty texts and texts without words have an
    empty set, are linked with nothing and are their own component; equal sets
    are always linked; a null id is never linked and gets a null component;
    rows that repeat an id with other texts are judged by their own texts; an
    empty table gives no rows; other columns are ignored.
    """
    found = cut(profiles(df, id_col, text_col, bands, rows, width))
    usable = found.where("n > 0 and id is not null")
    one = usable.groupBy("high", "low", "n").agg(F.min(F.struct("id", "t")).alias("rep"), F.first("keys").alias("keys"))
    classes = cut(one.select("high", "low", "n", "rep.id", "rep.t", "keys", F.monotonically_increasing_id().alias("node")))
    stars = cut(_stars(classes))
    clusters = components(stars, "node", "low_node").withColumnRenamed("node", "c_node")
    member = cut(classes.join(clusters, F.col("node") == F.col("c_node")).select("node", "id", "t", "n", F.col("component").alias("cluster")))
    sets = cut(_sets(df, id_col, text_col, member, width))
    known = cut(components(_first_links(sets, stars, percent)))
    rest = _rest_of_links(sets, member, known, percent, block_bytes, block_docs)
    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)).withColumnRenamed("node", "c_node")
    members = cut(joined.join(classes.select("node", "id"), F.col("c_node") == F.col("node")).select("node", "id", "component"))
    names = members.groupBy("component").agg(F.min("id").alias("name"))
    linked = members.join(names, "component").select(F.col("node").alias("c_node"), "name")
    named = classes.join(linked, F.col("node") == F.col("c_node"), "left").select("high", "low", "n", F.coalesce("name", "id").alias("component_id"))
    out = found.join(cut(named), ["high", "low", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id")).alias("component_id"))


def _stars(classes: DataFrame) -> DataFrame:
    """``node, low_node``: each member of a bucket with the bucket's smallest member, without repeats."""
    members = cut(classes.select("node", F.explode("keys").alias("key")))
    lows = cut(members.groupBy("key").agg(F.min("node").alias("low_node"), F.count("*").alias("size")).where("size > 1").select("key", "low_node"))
    return members.join(lows, "key").where("node > low_node").select("node", "low_node").distinct()


def _sets(df: DataFrame, id_col: str, text_col: str, member: DataFrame, width: int) -> DataFrame:
    """``node, cluster, n, elements``: the members' sets; the only place where texts move."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).withColumn("_t", F.xxhash64("text"))
    with_text = member.join(texts, (member["id"] == texts["_id"]) & (member["t"] == texts["_t"])).dropDuplicates(["_id", "_t"]).select("node", "cluster", "n", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in small_batches(batch, "text"):
                elements = pa.array([s.tobytes() for s in shingle_sets(texts_of(piece, "text"), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("node", "cluster", "n")), elements], ["node", "cluster", "n", "elements"])

    return arrow_map(with_text, "node bigint, cluster bigint, n bigint, elements binary", step)


def _first_links(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members that are linked with the smallest one of all their buckets' smallest."""
    one = cut(stars.groupBy("node").agg(F.min("low_node").alias("low_node")).withColumnRenamed("node", "_node"))
    copies = cut(one.groupBy("low_node").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies")).withColumnRenamed("low_node", "low"))
    salted = one.join(copies, F.col("low_node") == F.col("low")).select("_node", "low_node", F.pmod(F.xxhash64("_node"), F.col("copies")).cast("int").alias("salt"))
    asked = sets.join(salted, F.col("node") == F.col("_node")).select("node", "low_node", "salt", "n", "elements")
    lows = sets.join(copies, F.col("node") == F.col("low")).select("low", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("low_salt"), F.col("n").alias("low_n"), F.col("elements").alias("low_elements"))
    fits = 100 * F.least("n", "low_n") >= percent * F.greatest("n", "low_n")
    pairs = asked.join(lows, (F.col("low_node") == F.col("low")) & (F.col("salt") == F.col("low_salt")) & fits).select("node", "low", "elements", "low_elements")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "elements"):
                a, b = ([np.frombuffer(x, U64) for x in part.column(c).to_pylist()] for c in ("elements", "low_elements"))
                linked = pa.array([is_link(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield part.select(["node", "low"]).rename_columns(["a", "b"]).filter(linked)

    return arrow_map(pairs, "a bigint, b bigint", step)


def _rest_of_links(sets: DataFrame, member: DataFrame, known: DataFrame, percent: int, block_bytes: int, block_docs: int) -> DataFrame:
    """``a, b``: links between members of one cluster that the first ones leave apart, as spanning forests."""
    spark = sets.sparkSession
    known = known.withColumnRenamed("node", "c_node")
    labelled = member.join(known, F.col("node") == F.col("c_node"), "left").select("node", "n", "cluster", F.coalesce("component", "node").alias("component"))
    apart = labelled.groupBy("cluster").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one < other").select("cluster")
    labelled = cut(labelled.join(apart, "cluster"))
    # a component that fills blocks of its own never meets itself; all others of a cluster are dealt together
    sized = labelled.groupBy("cluster", "component").agg(F.sum(8 * F.col("n") + 100).alias("bytes"), F.count("*").alias("docs"))
    alone = (F.col("bytes") > block_bytes / 2) | (F.col("docs") > block_docs / 2)
    groups = sized.select("cluster", "component", F.when(alone, F.col("component")).otherwise(F.lit(-1)).alias("own"))
    # blocks: by set size in steps of a group's bytes; the histogram has a fixed number of size bands per group
    band = F.floor(F.log(F.col("n").cast("double")) * 8).cast("int")
    labelled = cut(labelled.join(groups, ["cluster", "component"]).withColumn("band", band))
    bands = labelled.groupBy("cluster", "own", "band").agg(F.sum(8 * F.col("n") + 100).alias("bytes"), F.count("*").alias("docs"), F.min("n").alias("low_n"), F.max("n").alias("high_n"))
    parts = F.greatest(F.ceil(F.col("bytes") / block_bytes), F.ceil(F.col("docs") / block_docs)).cast("int")
    # small clusters stay whole: one block if all their bands fit together
    whole = bands.groupBy("cluster").agg(F.sum("bytes").alias("all_bytes"), F.sum("docs").alias("all_docs"))
    fits = (F.col("all_bytes") <= block_bytes) & (F.col("all_docs") <= block_docs)
    planned = cut(bands.join(whole, "cluster").select("cluster", "own", "band", fits.alias("fits"), parts.alias("parts"), "low_n", "high_n"))
    placed = labelled.join(planned.select("cluster", "own", "band", "fits", "parts"), ["cluster", "own", "band"]).select(
        F.col("node").alias("_node"), "component",
        F.when(F.col("fits"), F.lit(-1)).otherwise(F.col("own")).alias("own"),
        F.when(F.col("fits"), F.lit(-1)).otherwise(F.col("band")).alias("band"),
        F.when(F.col("fits"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int").alias("part"),
    )
    large = planned.where("not fits").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = large.alias("l"), large.alias("r")
    block = lambda side: F.struct(f"{side}.band", f"{side}.own", f"{side}.part")
    strange = (F.col("l.own") == -1) | (F.col("l.own") != F.col("r.own"))
    meet = left.join(right, (F.col("l.cluster") == F.col("r.cluster")) & (block("l") <= block("r")) & strange & (100 * F.col("l.high_n") >= percent * F.col("r.low_n")))
    task = F.concat_ws(".", "l.band", "l.own", "l.part", "r.band", "r.own", "r.part").alias("task")
    sides = F.array(F.struct(*(F.col(f"l.{c}").alias(c) for c in ("own", "band", "part")), F.lit(0).alias("side")), F.struct(*(F.col(f"r.{c}").alias(c) for c in ("own", "band", "part")), F.lit(1).alias("side")))
    meet = meet.select(F.col("l.cluster").alias("cluster"), task, F.explode(F.when(block("l") == block("r"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s")).select("cluster", "s.own", "s.band", "s.part", "task", "s.side")
    small = planned.where("fits").select("cluster", F.lit(-1).cast("long").alias("own"), F.lit(-1).alias("band"), F.lit(0).alias("part"), F.lit("").alias("task"), F.lit(0).alias("side")).distinct()
    tasks = cut(small.unionByName(meet))
    with_sets = sets.join(placed, F.col("node") == F.col("_node")).select("node", "cluster", "component", "own", "band", "part", "elements")
    dealt = with_sets.join(tasks, ["cluster", "own", "band", "part"]).select("cluster", "task", "side", "node", "component", "elements")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "cluster", "task").sortWithinPartitions("cluster", "task", "side", "node")
    return arrow_map(dealt, "a bigint, b bigint", _task_links(percent))


def _task_links(percent: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, labels, sets = None, [], [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(nodes)), key=lambda i: (sides[i], len(sets[i])))
            split = sides.count(0) if 1 in sides else 0
            pairs = [(nodes[order[i]], nodes[order[j]]) for i, j in linked_pairs([sets[i] for i in order], np.array([labels[i] for i in order]), split, percent)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "task", "side", "node", "component")]
            elements = batch.column("elements")
            for i, (cluster, task, side, node, label) in enumerate(zip(*columns, strict=True)):
                if key != (cluster, task):
                    yield from links()
                    key, nodes, sides, labels, sets = (cluster, task), [], [], [], []
                nodes.append(node)
                sides.append(side)
                labels.append(label)
                sets.append(np.frombuffer(elements[i].as_py(), U64))
        yield from links()

    return step


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row of ``df`` of each component, with all columns: that with the smallest id, a row without an id only where none has one.

    Rows are numbered first, and the numbers written out, so that null and
    repeated ids are rows of their own.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    near = near_components(rows, "_row", text_col, percent).where("n_shingles > 0").select(F.col("id").alias("_r"), "component_id")
    groups = near.join(near.groupBy("component_id").count().where("count > 1").select("component_id"), "component_id")
    ids = rows.select("_row", F.col(id_col).alias("_id"))
    members = cut(groups.join(ids, F.col("_r") == F.col("_row")).select("_row", "component_id", F.struct(F.col("_id").isNull().alias("none"), "_id", "_row").alias("rank")))
    first = members.groupBy("component_id").agg(F.min("rank")["_row"].alias("first"))
    gone = members.join(first, "component_id").where("_row <> first").select(F.col("_row").alias("_r"))
    return rows.join(gone, F.col("_row") == F.col("_r"), "left_anti").drop("_row")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_components(docs, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common.n >= 85 * (x.n + y.n - common.n)),
sides as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from d union select reach.a, sides.b from reach join sides on reach.b = sides.a),
named as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from named left join sizes using (doc_id)
"""
