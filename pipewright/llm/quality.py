"""Quality classifier: ordinal cumulative-link regression on hashed text features.

Graded ratings 0 < 1 < ... < G - 1 share one weight vector over hashed features; G - 1 ordered
thresholds cut the score: P(grade <= k) = 1 / (1 + exp(score - threshold k)). So a model gives the
expected grade of a text and the tail probability P(grade >= k) that selection goes by.

Features are hashed to 24 bits: words, their first four to eight bytes, their last two bytes, whether
words repeat the one before or are in capitals, and how large the shares of those and of distinct words
are. A feature counts once in a text; heads of words that come twice or more are features of their own,
since some count for nothing until they are repeated. The model keeps those features that speak for a
lower grade in the rated sample: log-odds of ``LEAST_ODDS`` at least, and a likelihood ratio of
``LEAST_Z`` standard deviations. Weights are held at or below zero. So a text without such evidence has
the top grade, however long or unusual it is: what is rare in the sample can't make up for junk or
abuse, nor count against a text. Texts are hashed whole.

The model is fitted from a sample of at most ``max_rated`` rated rows, taken in the order of a hash of
their id. Their texts are hashed on the executors and features are counted by grade with partial
aggregation; the driver gets the kept features (some thousands) and which of them each rated row has,
never a text. Everything else is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm._arrow import slices, with_columns
from pipewright.llm._tables import cut, table
from pipewright.llm._words import mixed, word_parts

BITS = 24
MAX_RATED = 5000
TWICE = 1 << (BITS - 1)  # flipped in the bucket of a head that comes twice or more
LEAST_Z, LEAST_ODDS, MOST_ODDS = 4.0, 2.0, 4.0
STEPS, RATE, RIDGE = 400, 0.1, 1.0
MOST_WEIGHT = 4.0  # of a rare grade's texts against the others'
_FAMILIES = [np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in range(1, 10)]


def features(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each text's distinct features, in order; only of known buckets (a table of flags), if given."""
    parts = word_parts(texts)
    n_words = np.diff(parts.at)
    owner = np.repeat(np.arange(len(texts)), n_words)
    repeats = np.concatenate(([False], parts.hashes[1:] == parts.hashes[:-1])) if len(owner) else np.empty(0, dtype=bool)
    flags = repeats.astype(np.uint64) + 2 * parts.capitals.astype(np.uint64)

    def placed(text: np.ndarray, hashes: np.ndarray, family: int, twice: bool = False) -> np.ndarray:
        bucket = (mixed(hashes ^ _FAMILIES[family]) >> np.uint64(64 - BITS)).astype(np.int64)
        if known is not None:
            hit = known[bucket] | known[bucket ^ TWICE] if twice else known[bucket]
            text, bucket = text[hit], bucket[hit]
        return text << BITS | bucket

    keys = [placed(owner, hashes, family) for family, hashes in enumerate((parts.hashes, parts.tails, flags))]
    heads, times = np.unique(np.concatenate([placed(owner, hashes, family, True) for family, hashes in enumerate(parts.heads, 3)]), return_counts=True)
    keys += [heads, heads[times > 1] ^ TWICE]
    some = np.maximum(1, n_words)
    _, first = np.unique(mixed(parts.hashes + owner.astype(np.uint64) * _FAMILIES[0]), return_index=True)
    distinct = np.bincount(owner[first], minlength=len(texts))
    shares = (np.bincount(owner[repeats], minlength=len(texts)) / some, np.bincount(owner[parts.capitals], minlength=len(texts)) / some, np.where(n_words >= 8, -distinct / some, -2))
    for kind, share in enumerate(shares):
        for level in range(1, 7):
            text = np.flatnonzero(share >= (2.0**-level if kind < 2 else -(2.0**-level)))
            keys.append(placed(text, np.full(len(text), 10 * kind + level, dtype=np.uint64), 8))
    found = np.unique(np.concatenate(keys))
    text, bucket = found >> BITS, found & ((1 << BITS) - 1)
    if known is not None:
        hit = known[bucket]
        text, bucket = text[hit], bucket[hit]
    return text, bucket


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than there are grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. G - 1, one row per score."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def table(self) -> np.ndarray:
        known = np.zeros(1 << BITS, dtype=bool)
        known[self.buckets] = True
        return known

    def scores(self, texts: list[bytes], known: np.ndarray | None = None) -> np.ndarray:
        text, bucket = features(texts, self.table() if known is None else known)
        return np.bincount(text, self.weights[np.searchsorted(self.buckets, bucket)] if len(bucket) else None, minlength=len(texts))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: np.ndarray, scale: np.ndarray) -> OrdinalModel:
    """Maximum likelihood with a ridge, by gradient steps over the whole sample with a rate for each weight; no weight over zero.

    rows: of each rated row the places of its features in ``buckets``; scale: how much each feature counts."""
    thresholds = np.linspace(-4.0, -2.0, n_grades - 1)
    if not rows:
        return OrdinalModel(np.empty(0, dtype=np.int64), np.empty(0), thresholds)
    n, size = len(rows), len(buckets)
    own, place = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    x, weights = scale[place], np.zeros(size)
    weight_of = np.minimum(MOST_WEIGHT, n / n_grades / np.maximum(1, np.bincount(grades, minlength=n_grades)))[grades]
    mean, square = np.zeros(size + n_grades - 1), np.zeros(size + n_grades - 1)
    for step in range(1, STEPS + 1):
        scores = np.bincount(own, weights[place] * x, minlength=n)
        cut = np.pad(_sigmoid(thresholds[None, :] - scores[:, None]), ((0, 0), (1, 1)), constant_values=((0, 0), (0.0, 1.0)))  # P(grade < k)
        lower, upper = cut[np.arange(n), grades], cut[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-9)
        # d log P(grade) / d (threshold - score) at the two borders
        up, low = weight_of * upper * (1 - upper) / p, weight_of * lower * (1 - lower) / p
        at_borders = np.bincount(grades, up, minlength=n_grades)[:-1] - np.bincount(grades, low, minlength=n_grades)[1:]
        gradient = np.concatenate((np.bincount(place, (low - up)[own] * x, minlength=size) - RIDGE * weights, at_borders))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
        rate = RATE * (1 - step / (STEPS + 1))
        move = rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights = np.minimum(0.0, weights + move[:size])
        thresholds = np.maximum.accumulate(thresholds + move[size:])
    return OrdinalModel(buckets, weights * scale, thresholds)


def rated_sample(docs: DataFrame, ratings: DataFrame, grade: Column, id_column: str = "doc_id", text: str = "text", max_rated: int = MAX_RATED) -> DataFrame:
    """grade, features of at most max_rated rated rows; rows without a grade, id or text are left out.

    Of several ratings of an id the least counts, of several texts the first in order."""
    some = (
        ratings.select(F.col(id_column).alias("_id"), grade.cast("int").alias("_grade")).where("_id IS NOT NULL AND _grade IS NOT NULL")
        .orderBy(F.xxhash64("_id"), "_id", "_grade").limit(max_rated)
    )
    wanted = some.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    found = docs.where(F.col(text).isNotNull()).join(F.broadcast(wanted), F.col(id_column) == F.col("_id"))
    texts = found.groupBy(F.col("_id").alias("id")).agg(F.first("_grade").alias("grade"), F.min(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", max_bytes=1 << 19):
            text, bucket = features(batch.column("text").cast(pa.binary()).to_pylist())
            ends = np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), own], names=["id", "grade", "features"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, grade int, features array<int>")


def evidence(rated: DataFrame, n_grades: int) -> DataFrame:
    """feature, odds: of each feature of rated(grade, features) how strongly it speaks for a lower grade, log-odds up to MOST_ODDS."""
    totals = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    x_log = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    counts = rated.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(*(F.count_if(F.col("grade") >= k).alias(f"high{k}") for k in range(n_grades)))
    best = [F.lit(0.0)]
    for k in range(1, n_grades):
        high = sum(n for g, n in totals.items() if g >= k)
        low = sum(totals.values()) - high
        if not high or not low:
            continue
        both, a = F.col("high0").cast("double"), F.col(f"high{k}").cast("double")
        b = both - a
        odds = F.log((b + 0.5) / F.lit(low + 1.0)) - F.log((a + 0.5) / F.lit(high + 1.0))
        split = x_log(a) + x_log(b) + x_log(high - a) + x_log(low - b) - x_log(both) - x_log(high + low - both)
        whole = sum(n * math.log(n) * s for n, s in ((high + low, 1), (high, -1), (low, -1)))
        strong = (odds >= LEAST_ODDS) & (2 * (split + whole) >= LEAST_Z**2)
        best.append(F.when(strong, F.least(odds, F.lit(MOST_ODDS))).otherwise(0.0))
    return counts.select("feature", (F.greatest(*best) if len(best) > 1 else best[0]).alias("odds")).where("odds > 0")


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", select_grade: int | None = None, least_tail: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability (P(grade >= select_grade); default: the top grade) and kept.

    A null text is scored as an empty one, by the thresholds alone. Rows are scored one by one, so
    repeated rows get equal results; texts of any length are read whole; an empty table gives an
    empty result. A row is kept if its tail probability is at least least_tail. Columns of docs with
    the new names are replaced.
    """
    top = select_grade or len(model.thresholds)
    keep = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.table()
        for batch in slices(batches, text, max_bytes=1 << 20):
            tails = model.tails(model.scores([v or b"" for v in batch.column(text).cast(pa.binary()).to_pylist()], known))
            tail = tails[:, top - 1]
            yield with_columns(batch, keep, {"expected_grade": pa.array(tails.sum(axis=1)), "tail_probability": pa.array(tail), "kept": pa.array(tail >= least_tail)})

    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.select(*keep).mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *added]))


#: Grades of the labels table: 0 junk, 1 sound but toxic, 2 sound.
GRADES = 3


def label_grade() -> Column:
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)


def fitted(docs: DataFrame, ratings: DataFrame, grade: Column | None = None, n_grades: int = GRADES, max_rated: int = MAX_RATED) -> OrdinalModel:
    """A model of the ratings' grades (default: those of the labels table); without any rated row all texts score alike and are kept."""
    rated = cut(rated_sample(docs, ratings, label_grade() if grade is None else grade, max_rated=max_rated))
    kept = sorted((r["feature"], r["odds"]) for r in evidence(rated, n_grades).collect())
    buckets, scale = np.array([f for f, _ in kept], dtype=np.int64), np.array([o for _, o in kept]) / 2
    rows = sorted((r["id"], r["grade"], r["own"]) for r in _only(rated, buckets).collect())
    return fit([np.searchsorted(buckets, np.array(own, dtype=np.int64)) for _, _, own in rows], np.array([g for _, g, _ in rows], dtype=np.int64), n_grades, buckets, scale)


def _only(rated: DataFrame, buckets: np.ndarray) -> DataFrame:
    """id, grade, own: the features of each rated row that are among the buckets, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(x, buckets, assume_unique=True).astype(np.int32) for x in batch.column("features").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(own, pa.list_(pa.int32()))], names=["id", "grade", "own"])

    return rated.mapInArrow(run, rated.withColumnRenamed("features", "own").schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels table. A null text is scored as empty; repeated rows get equal scores; without
    usable labels all score alike; of several ratings of a doc_id the least counts; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents whose probability of the top grade is one half or more; that of an empty or null text comes from the thresholds
    alone. Equal texts stay or go together; an empty table gives an empty result."""
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("kept").select(*docs.columns)
