"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the two labels: 0 is low quality, 1 fair but toxic, 2 good.
The model is ``P(grade <= k) = logistic(threshold[k] - w . x)`` with one weight
vector for all thresholds, which are kept in order by construction (the first,
and the logarithms of the gaps).  ``x`` marks which hashed features a text has:
its words without punctuation in lower case, their beginnings, its symbol and
capital shapes, how its lines are cut, and how much it repeats itself.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
the id, and of these at most as many, in the same order, as have ``SAMPLE_BYTES``
of hashed features, which is what reaches the driver; so its cost doesn't grow
with the corpus or with long texts.  Training is accelerated proximal gradient descent
with an L1 penalty, which clears the weights of words that say nothing.  Every
row of the corpus is then scored whole, in one pass without a shuffle; the
model (a few MB, fixed by ``SLOTS``) goes along with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, cut, small_batches, texts_of
from .wordhash import U64, Words, blocks, mix

SAMPLE = 8_000
SAMPLE_BYTES = 64 << 20
SLOTS = 1 << 18
GRADES = 3
PREFIXES = (4, 5)
CURVATURE = 25.0
#: Steps and L1 penalty of the two passes of the fit.
SCREEN, SETTLE = (60, 8e-4), (400, 1e-4)
KEEP_AT = 0.6

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_TO_SHAPE = bytes.maketrans(bytes(range(65, 91)) + bytes(range(48, 58)), b"A" * 26 + b"0" * 10)
_SMALL = bytes(range(97, 123)) + bytes(range(128, 256))


def features(texts: list[bytes], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block of texts, as rows of distinct slots: ``(slot, bounds)``, text k having ``slot[bounds[k]:bounds[k + 1]]``."""
    plain = Words([t.lower().translate(_TO_SPACE) for t in texts])
    shapes = Words([t.translate(_TO_SHAPE, _SMALL) for t in texts])
    n = len(texts)
    docs = [plain.doc, shapes.doc, plain.doc, plain.doc]
    keys = [plain.hash, mix(shapes.hash + U64(1)), *(mix(plain.prefixes(size) + U64(100 + size)) for size in PREFIXES)]
    # words a line, share of distinct words, share of shaped words, each on a coarse scale
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    count = np.maximum(plain.count, 1)
    distinct = np.unique((plain.doc.astype(U64) << U64(40)) | (plain.hash >> U64(24))) >> U64(40)
    variety = np.bincount(distinct.astype(np.int64), minlength=n) / np.sqrt(count)
    scales = [np.floor(2 * np.log2(count / lines + 1e-3)), np.floor(4 * np.log2(variety + 1e-3)), np.floor(10 * np.minimum(shapes.count / count, 1)), np.minimum(np.floor(np.log2(count)), 6)]
    for number, scale in enumerate(scales):
        docs.append(np.arange(n))
        keys.append(mix((scale.astype(np.int64) + 1000).astype(U64) * U64(64) + U64(number + 2)))
    doc, slot = np.concatenate(docs), (np.concatenate(keys) % U64(slots)).astype(np.int64)
    both = np.unique(doc * slots + slot)
    return (both % slots).astype(np.int32), np.searchsorted(both, np.arange(n + 1) * slots)


@dataclass(frozen=True)
class Model:
    """Weights by slot and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, slot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each text and threshold."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[slot], dtype=np.float64)))
        score = total[bounds[1:]] - total[bounds[:-1]]
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted mean loss, its slope by score and by threshold."""
    edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
    high, low = _logistic(edges[grade + 1] - score), _logistic(edges[grade] - score)
    p = np.maximum(high - low, 1e-12)
    dh, dl = high * (1 - high) / p, low * (1 - low) / p
    dh, dl = dh * weight, dl * weight
    slopes = np.array([-(dh[grade == k].sum() - dl[grade == k + 1].sum()) for k in range(len(thresholds))])
    return float(-np.log(p) @ weight), dh - dl, slopes


def _descend(rows: np.ndarray, column: np.ndarray, many: int, grade: np.ndarray, weight: np.ndarray, w: np.ndarray, free: np.ndarray, steps: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps on the weights ``w`` and, plainly, on the free parameters of the thresholds."""
    rate = 1 / (np.bincount(column, minlength=many) / len(grade) * CURVATURE + 0.02)  # rare features take longer steps
    ahead, speed, best, scale = w, 1.0, np.inf, 1.0
    for _ in range(steps):
        score = np.bincount(rows, ahead[column], minlength=len(grade))
        loss, slope, by_threshold = _loss(score, grade, _thresholds(free), weight)
        if loss > best * 1.02:  # overshoot: start again from the last point with shorter steps
            scale, speed, ahead, best = scale / 2, 1.0, w, np.inf
            continue
        best = min(best, loss)
        step = scale * rate
        new = ahead - step * np.bincount(column, slope[rows], minlength=many)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead = new + (speed - 1) / faster * (new - w)
        w, speed = new, faster
        free = free - scale * 2.0 * np.concatenate(([by_threshold.sum()], [by_threshold[k + 1 :].sum() * np.exp(free[k + 1]) for k in range(len(free) - 1)]))
    return w, free


def _thresholds(free: np.ndarray) -> np.ndarray:
    return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))


def fit(slot: np.ndarray, bounds: np.ndarray, grade: np.ndarray, slots: int = SLOTS, grades: int = GRADES, screen: tuple[int, float] = SCREEN, settle: tuple[int, float] = SETTLE) -> Model:
    """Fit in two passes: a strong L1 penalty chooses the slots, then these are fitted on with a weak one.

    Without any rows, or with one grade only, the model keeps everything.
    """
    if len(np.unique(grade)) < 2:
        return Model(np.zeros(slots, np.float32), np.full(grades - 1, -40.0))
    rows = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(bounds))
    # slots that a few rows have, or whose rows' grades are like all others', only cost memory
    seen = np.bincount(slot, minlength=slots)
    apart = np.zeros(slots)
    for k in range(grades - 1):
        above = grade > k
        share = min(max(above.mean(), 1e-6), 1 - 1e-6)
        apart = np.maximum(apart, np.abs(np.bincount(slot, (above - share)[rows], minlength=slots)) / np.sqrt(np.maximum(seen, 1) * share * (1 - share)))
    useful = (seen >= 3) & (apart >= 1.5)
    used = np.flatnonzero(useful)
    rows, column = rows[useful[slot]], np.cumsum(useful, dtype=np.int32)[slot[useful[slot]]] - 1
    weight = 1 / np.sqrt(np.maximum(np.bincount(grade, minlength=grades), 1))[grade]  # rare grades count more
    weight /= weight.sum()
    share = np.clip(np.cumsum(np.bincount(grade, weight, minlength=grades))[:-1], 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    free = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    w, free = _descend(rows, column, len(used), grade, weight, np.zeros(len(used)), free, *screen)
    chosen = np.flatnonzero(w)
    inside = w[column] != 0
    w, free = _descend(rows[inside], np.searchsorted(chosen, column[inside]), len(chosen), grade, weight, w[chosen], free, *settle)
    weights = np.zeros(slots, np.float32)
    weights[used[chosen]] = w
    return Model(weights, _thresholds(free))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on the labelled rows with the smallest hashes of the id, ``sample`` and ``sample_bytes`` of features at most.

    Labels that are null, ids without a text and ids labelled twice (the first
    pair in order counts) are settled before the sample is drawn.
    """
    graded = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    graded = graded.groupBy(id_col).agg(F.min(F.struct("quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))).alias("l"))
    grade = F.when(F.col("l.quality") == 0, 0).when(F.col("l.toxic") != 0, 1).otherwise(2)
    chosen = graded.select(F.col(id_col).alias("_id"), grade.alias("grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    joined = docs.join(F.broadcast(cut(chosen)), docs[id_col] == F.col("_id")).select(F.col(text_col).cast("string").alias("text"), "grade", F.xxhash64("_id").alias("h"), F.monotonically_increasing_id().alias("row"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text"):
                lists = []
                for _, block in blocks(texts_of(part, "text")):
                    slot, bounds = features(block)
                    lists += [slot[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                packed = pa.array([x.astype("<i4").tobytes() for x in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("grade"), part.column("h"), part.column("row"), packed], ["grade", "h", "row", "slots"])

    drawn = cut(arrow_map(joined, "grade int, h bigint, row bigint, slots binary", step))
    so_far = F.sum(F.octet_length("slots")).over(W.orderBy("h", "row"))  # over the sample's sizes only
    fitting = cut(drawn.select("row", so_far.alias("bytes")).where(F.col("bytes") <= sample_bytes).select(F.col("row").alias("_row")))
    rows = drawn.join(F.broadcast(fitting), F.col("row") == F.col("_row"), "left_semi").select("grade", "slots").collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["slots"])))
    lists = [np.frombuffer(r["slots"], "<i4") for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return fit(np.concatenate(lists) if lists else np.zeros(0, np.int32), bounds, np.array([r["grade"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``id, expected_grade, tail_probability, kept`` for every row.

    The tail probability is that of the best grade, and a row is kept from
    ``keep_at`` on.  Defined cases: null and empty texts are scored as texts
    without words; repeated rows and null ids are scored one by one; an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text"):
                tails = [shared.value.tails(*features(block)) for _, block in blocks(texts_of(part, "text"))]
                all_tails = np.concatenate(tails) if tails else np.zeros((0, GRADES - 1))
                best = all_tails[:, -1]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(all_tails.sum(1)), pa.array(best), pa.array(best >= keep_at)], ["id", "expected_grade", "tail_probability", "kept"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(plain, f"id {docs.schema[id_col].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean", step)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all columns, in one pass (no join back)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col))
    names = docs.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, text_col):
                stay = [model.value.tails(*features(block))[:, -1] >= keep_at for _, block in blocks(texts_of(part, text_col))]
                yield part.filter(pa.array(np.concatenate(stay))).select(names)

    return docs.mapInArrow(step, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    out = score(docs, train(docs, labels))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), "kept")
