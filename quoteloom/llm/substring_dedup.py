"""Substring dedup by super-k-mer partitioning.

A *window* is ``WINDOW`` consecutive words of one document.  Its *minimiser* is
the smallest hash among the ``GRAM``-word grams in it.  Neighbouring windows
mostly share the minimiser; such a run, a *super-k-mer*, is a stretch of words
that belongs to the bucket named by its minimiser.  Equal windows have equal
minimisers, so all occurrences of a window meet in one bucket.

1. The texts are read once for the runs' table: minimiser, document, place.
   A minimiser that occurs in one document alone can't hide a window that
   occurs in two, so such runs are dropped before any text moves.
2. The remaining runs travel, each as one packed string of words, to their
   buckets; a string that a document repeats travels once, with all its places.
   In the bucket the windows are sorted by hash and document, and neighbours of
   one hash are compared on the packed strings, run against run, so windows
   count as equal only if their words are; should a hash ever stand for
   different words, its windows are sorted again by the words themselves.
   Every window that a smaller document has too is marked.
3. A hot bucket is salted by document.  There a window that loses to a smaller
   document of its own part is marked at once; the winners of the parts, at
   most one document a window and part, meet again by a 128-bit digest of
   their words.
4. Marked windows go back to their documents as ranges, and the words they
   cover are removed.

A document is known by its id and a hash of its text, so rows that share an id
but not the text are each cut at their own places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, release, small_batches, texts_of
from .wordhash import Words, blocks

WINDOW = 50
GRAM = 5
HOT = 512


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        span += step
    return place[:n]


def runs(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Super-k-mers of a block: minimiser, text number, first window (word place in the text), number of windows."""
    none = np.zeros(0, np.int64)
    n = len(words.hash) - window + 1
    if n <= 0:
        return none, none, none, none
    grams = words.windows(gram)
    place = sliding_min(grams, window - gram + 1)[:n]
    inside = np.flatnonzero(words.whole(window))
    if not len(inside):
        return none, none, none, none
    doc, at = words.doc[inside], place[inside]
    new = np.concatenate(([True], (np.diff(inside) != 1) | (np.diff(at) != 0) | (np.diff(doc) != 0)))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(inside)])))
    return grams[at[first]].view(np.int64), doc[first], inside[first] - words.first[doc[first]], count


def _runs_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text"):
                for first, block in blocks(texts_of(part, "text")):
                    mini, doc, at, count = runs(Words(block), window, gram)
                    if len(mini):
                        owner = pa.array(doc + first)
                        columns = [pa.array(mini), part.column("id").take(owner), part.column("t").take(owner), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["mini", "id", "t", "at", "count"])

    return arrow_map(docs, "mini bigint, id bigint, t bigint, at int, count int", step)


def _packed(docs: DataFrame, window: int) -> DataFrame:
    """Super-k-mers as strings: ``mini, salts, id, t, places, words``; ``docs`` has ``id, t, text, runs``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text", 1 << 20):
                lists = part.column("runs")
                flat = lists.flatten()
                mini, at, count, salts = (np.asarray(flat.field(k)).tolist() for k in ("mini", "at", "count", "salts"))
                offsets = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
                packed: dict[tuple[int, int, bytes], list[int]] = {}
                which: list[int] = []
                for k, text in enumerate(texts_of(part, "text")):
                    words = text.split()
                    for i in range(offsets[k], offsets[k + 1]):
                        key = (k, mini[i], b" ".join(words[at[i] : at[i] + count[i] + window - 1]))
                        places = packed.get(key)
                        if places is None:
                            packed[key] = [at[i]]
                            which.append(i)
                        else:
                            places.append(at[i])
                owner = pa.array([k for k, _, _ in packed], pa.int64())
                columns = [
                    pa.array([m for _, m, _ in packed], pa.int64()), pa.array([salts[i] for i in which], pa.int32()), part.column("id").take(owner), part.column("t").take(owner),
                    pa.array(packed.values(), pa.list_(pa.int32())), pa.array([w for _, _, w in packed], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["mini", "salts", "id", "t", "places", "words"])

    return arrow_map(docs, "mini bigint, salts int, id bigint, t bigint, places array<int>, words binary", step)


def _same_words(words: Words, here: np.ndarray, there: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at ``here`` and ``there`` (word numbers) have the same words; neighbouring pairs are compared as one run of bytes."""
    order = np.argsort(here, kind="stable")
    a, b = here[order], there[order]
    new = np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1) | (np.diff(words.doc[a]) != 0) | (np.diff(words.doc[b]) != 0)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(a)])) - 1
    buf, tail = words.buf, window - 1
    spans = [words.start[a[first]], words.end[a[last] + tail], words.start[b[first]], words.end[b[last] + tail]]
    same = np.array([buf[i:j] == buf[k:m] for i, j, k, m in zip(*(x.tolist() for x in spans), strict=True)], bool)
    out = np.empty(len(here), bool)
    out[order] = np.repeat(same, last - first + 1)
    return out


def equal_windows(words: Words, key: np.ndarray, doc: np.ndarray, at: np.ndarray, hashed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows at word numbers ``at`` by group of equal ones and document, and the place of each one's group start in it.

    Windows are grouped inside each ``key`` (the bucket and its part).  Hashes
    bring them together, the words decide: a hash whose windows differ is
    divided by the words themselves.
    """
    many = len(at)
    sub = np.zeros(many, np.int64)
    while True:
        order = np.lexsort((doc, sub, hashed, key))
        k, h, s = key[order], hashed[order], sub[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(many), 0))
        if sub.any():
            return order, first
        other = np.flatnonzero(first != np.arange(many))
        if not len(other):
            return order, first
        differ = other[~_same_words(words, at[order[other]], at[order[first[other]]], window)]
        if not len(differ):
            return order, first
        names: dict[bytes, int] = {}
        for i in order[np.isin(first, first[differ])].tolist():
            sub[i] = names.setdefault(words.buf[words.start[at[i]] : words.end[at[i] + window - 1]], len(names) + 1)


def _ranges(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of a row: row, first, number."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(at) > 1))))
    last = np.concatenate((new[1:], [len(row)])) - 1
    return row[new], at[new], at[last] - at[new] + 1


def _moved(places: pa.ListArray, row: np.ndarray, by: np.ndarray) -> pa.ListArray:
    """The lists of the rows, each moved by its number."""
    taken = places.take(pa.array(row))
    sizes = np.diff(np.asarray(taken.offsets))
    values = np.asarray(taken.flatten()) + np.repeat(by, sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int32)))


def settle_bucket(rows: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Marked windows, and the open ones of salted buckets, of whole bucket parts."""
    words = Words(texts_of(rows, "words"))
    mini, salt, salts, ids = (np.asarray(rows.column(c)) for c in ("mini", "salt", "salts", "id"))
    at = np.flatnonzero(words.whole(window))
    if not len(at):
        return
    row = words.doc[at]
    part = np.cumsum(np.concatenate(([0], (np.diff(mini) != 0) | (np.diff(salt) != 0))))
    order, first = equal_windows(words, part[row], ids[row], at, words.windows(window)[at], window)
    row, place = row[order], (at - words.first[row])[order]
    doc = ids[row]
    lost = doc > doc[first]

    def give(r: np.ndarray, begin: np.ndarray, count: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
        take = pa.array(r)
        columns = [rows.column("id").take(take), rows.column("t").take(take), _moved(rows.column("places"), r, begin), pa.array(count.astype(np.int32)), keys]
        return pa.RecordBatch.from_arrays(columns, ["id", "t", "places", "count", "key"])

    if lost.any():
        r, begin, count = _ranges(row[lost], place[lost])
        yield give(r, begin, count, pa.nulls(len(r), pa.binary()))
    open_ = np.flatnonzero(~lost & (salts[row] > 1))
    if len(open_):
        spots = at[order[open_]]
        begin, end = words.start[spots].tolist(), words.end[spots + window - 1].tolist()
        keys = pa.array([hashlib.blake2b(words.buf[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)], pa.binary())
        yield give(row[open_], place[open_], np.ones(len(open_), np.int32), keys)


def _bucket_sort(packed: DataFrame, window: int) -> DataFrame:
    """``id, t, places, count, key``: ranges of marked windows (key null) and, of salted buckets, the windows not marked there."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of the bucket part that may go on in the next slice

        def together() -> pa.RecordBatch:
            return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

        for batch in batches:
            for part in small_batches(batch, "words", 2 << 20):
                mini, salt = np.asarray(part.column("mini")), np.asarray(part.column("salt"))
                going_on = int(np.argmax((mini == mini[-1]) & (salt == salt[-1])))
                if waiting and (waiting[-1].column("mini")[-1].as_py(), waiting[-1].column("salt")[-1].as_py()) != (mini[0], salt[0]):
                    yield from settle_bucket(together(), window)
                    waiting = []
                if going_on:
                    waiting.append(part.slice(0, going_on))
                    yield from settle_bucket(together(), window)
                    waiting = []
                waiting.append(part.slice(going_on))
        if waiting:
            yield from settle_bucket(together(), window)

    return arrow_map(packed, "id bigint, t bigint, places array<int>, count int, key binary", step)


def _shared_runs(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """``_id, _t, runs``: each document's super-k-mers whose minimiser some other document has too; cut."""
    table = cut(_runs_table(docs.where("id is not null and text is not null"), window, gram))
    shared = table.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high")
    shared = cut(shared.select("mini", F.ceil(F.col("size") / hot).cast("int").alias("salts")))
    kept = table.join(shared, "mini").select("id", "t", F.struct("mini", "at", "count", "salts").alias("run"))
    return cut(kept.groupBy("id", "t").agg(F.collect_set("run").alias("runs")).withColumnsRenamed({"id": "_id", "t": "_t"}))


def _marked(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """The bucket sort's result; cut."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = _shared_runs(docs, window, gram, hot)
    release(docs.sparkSession)  # the runs' table and its shuffles, before texts move
    packed = _packed(_with(docs, lists).select("id", "t", "text", "runs"), window)
    salted = packed.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.col("salts")).cast("int"))
    return cut(_bucket_sort(salted.repartition(partitions, "mini", "salt").sortWithinPartitions("mini", "salt"), window))


def _with(docs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    return docs.join(lists, (docs["id"] == lists["_id"]) & (docs["t"] == lists["_t"]), how)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``id, t, places, count``: ranges of ``count`` windows from each place on that a smaller id has too; ``docs`` is ``id bigint, t bigint, text``."""
    marked = _marked(docs, window, gram, hot)
    release(docs.sparkSession)
    winners = marked.where(F.col("key").isNotNull())
    lows = winners.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    beaten = winners.join(lows, "key").where("id > low")
    names = ["id", "t", "places", "count"]
    return marked.where(F.col("key").isNull()).select(*names).unionByName(beaten.select(*names))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``id, n_words, n_removed, kept, kept_sha256``: every row's text without the words covered by a repeated window, joined by one space.

    Defined cases: null and empty texts have no words and stay empty; texts of
    fewer words than a window lose nothing; a passage repeated inside one
    document only stays; rows that repeat an id lose nothing to each other,
    whatever their texts; rows with a null id lose nothing and take nothing
    from others; an empty table gives no rows; other columns are ignored.  Ids
    are whole numbers.
    """
    return _removed(df, id_col, text_col, window, gram, hot, keep_text=True)


def _removed(df: DataFrame, id_col: str, text_col: str, window: int, gram: int, hot: int, keep_text: bool) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    marked = repeated_windows(docs, window, gram, hot)
    lists = cut(marked.groupBy("id", "t").agg(F.collect_list(F.struct("places", "count")).alias("ranges")).withColumnsRenamed({"id": "_id", "t": "_t"}))
    joined = _with(docs, lists, "left").select("id", "text", "ranges")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text"):
                n_words, n_removed, kept, digests = [], [], [], []
                lists = part.column("ranges")
                flat = lists.flatten()
                places, sizes = flat.field("places"), np.asarray(flat.field("count"))
                bounds = np.concatenate(([0], np.cumsum(np.diff(np.asarray(places.offsets)))))
                first = np.asarray(places.flatten())
                last = first + np.repeat(sizes, np.diff(bounds)) + window - 1
                ends = bounds[np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))].tolist()
                for k, text in enumerate(texts_of(part, "text")):
                    words = text.split()
                    n_words.append(len(words))
                    if ends[k + 1] > ends[k]:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, first[ends[k] : ends[k + 1]], 1)
                        np.subtract.at(change, last[ends[k] : ends[k + 1]], 1)
                        stay = np.cumsum(change)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    whole = b" ".join(words)
                    kept.append(whole if keep_text else None)
                    digests.append(hashlib.sha256(whole).hexdigest())
                columns = [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    return arrow_map(joined, "id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string", step)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _removed(docs, "doc_id", "text", WINDOW, GRAM, HOT, keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
lost as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as first_id from win) where doc_id > first_id),
words as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as x from d),
covered as (
  select words.doc_id, j, x, max(i) over (partition by words.doc_id order by j rows between 49 preceding and current row) as start
  from words left join lost on lost.doc_id = words.doc_id and i = j),
kept as (select doc_id, count(*) as n_words, count(start) as n_removed, string_agg(x, ' ' order by j) filter (where start is null) as t from covered group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""
