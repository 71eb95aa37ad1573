"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its words, pairs of words, word shapes (letters reduced to their case, digits to 9, runs to one)
and pairs of shapes, a pair of equal words or shapes counting as such; each hashed to one of ``BUCKETS`` and valued at
``SCALE`` times its share of the text's words.  The score is the logistic of the sparse dot product.

Training takes a bounded sample: of the labelled rows, the ``SAMPLE`` ones with the smallest hash of doc_id.  Executors
turn them into sparse rows, the driver runs per-coordinate FTRL-proximal over them.  Scores use whole texts of all
rows and nothing but the text.

Defined cases: a null or empty text scores by the bias alone; a null doc_id is never trained on nor held out; labels
with a null quality are left out, and of several for one doc_id each counts; without labelled rows every score is
0.5; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
SCALE = 20.0
#: The most labelled rows that training takes.
SAMPLE = 4096
EPOCHS = 4
_UPPER, _LOWER, _DIGIT, _SIGN = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"([^\w])\1+")


def word_shape(word: str) -> str:
    return _SIGN.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word))))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return h ^ (h >> np.uint64(29))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of all texts, four a word, and words per text; a text's first pairs stand alone."""
    index, words, counts = common.split_words(texts.fill_null(""))
    words = words.to_pylist()
    hashes = np.fromiter((zlib.crc32(w.lower().encode()) for w in words), np.uint64, len(words))[index]
    shapes = np.fromiter((zlib.crc32(word_shape(w).encode()) for w in words), np.uint64, len(words))[index]
    first = common.starts_of(counts)[:-1][counts > 0]
    out = np.empty((len(index), 4), np.uint64)
    for at, (kind, values) in enumerate(((1, hashes), (2, shapes))):
        before = np.concatenate([[0], values[:-1]]).astype(np.uint64) if len(values) else values
        same = before == values
        before[first] = 7
        same[first] = False
        out[:, 2 * at] = _mix(values, np.uint64(kind) + np.zeros_like(values))
        out[:, 2 * at + 1] = np.where(same, np.uint64(10 + kind), _mix(_mix(values, before), np.uint64(kind + 2) + np.zeros_like(values)))
    return (out >> np.uint64(11)) % np.uint64(BUCKETS), counts


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, indices, values) of the bounded sample, in the order of its hash."""
    common.ship(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    number = F.crc32(doc_id.cast("string"))
    known = labels.select(doc_id.alias("id"), F.col("quality").cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    known = known.where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    # a hash keeps about twice the sample before the exact cut, so that no task sends all its labels
    bound = 2 * sample / max(known.count(), 1)
    if bound < 1:
        known = known.where(F.xxhash64("id") <= int(-(1 << 63) + bound * (1 << 64)))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.where(doc_id.isNotNull() & (number % 3 != 1)).select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "label", "text")  # ``sample`` rows at most

    def sparse(batches):
        common.hold()
        for batch in common.in_slices(batches, 500):
            found, counts = features(batch.column("text"))
            first = common.starts_of(counts)
            rows = [np.unique(found[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            values = [(n * (SCALE / 4 / max(1, c))).astype(np.float32) for (_, n), c in zip(rows, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for v in values], pa.binary())], ["doc_id", "label", "i", "v"])

    got = chosen.mapInArrow(sparse, "doc_id long, label int, i binary, v binary").toArrow().to_pylist()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["label"], r["i"]))
    return [(r["label"], np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4")) for r in got]


def train(rows, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """FTRL-proximal; the last weight is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    w = np.zeros(BUCKETS + 1)

    def weight(at):
        found = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, found)

    for _ in range(epochs):
        for label, at, values in rows:
            at, values = np.append(at, BUCKETS), np.append(values, np.float32(1))
            own = weight(at)
            p = 1 / (1 + np.exp(-np.clip(own @ values, -35, 35)))
            g = (p - label) * values
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * own
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    return w.astype(np.float32)


def scorer(spark: SparkSession, weights: np.ndarray):
    """A column function from text to score; the weights, of a fixed size, are broadcast."""
    common.ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.hold()
        w = shared.value
        for texts in batches:
            out = [np.zeros(0)]
            for part in common.in_slices([pa.RecordBatch.from_arrays([texts], ["text"])], 2000, 1 << 20):
                found, counts = features(part.column("text"))
                per_word = w[found.astype(np.int64)].sum(axis=1, dtype=np.float64)
                total = np.concatenate([[0.0], np.cumsum(per_word)])
                first = common.starts_of(counts)
                dot = (total[first[1:]] - total[first[:-1]]) * (SCALE / 4) / np.maximum(counts, 1) + float(w[-1])
                out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
            yield pa.array(np.concatenate(out))

    def column(text: Column) -> Column:
        return score(F.coalesce(text.cast("string"), F.lit("")))

    return column


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    return train(training_rows(docs, labels, sample))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    score = scorer(spark, fit(docs, common.table(spark, sf_dir, "labels")))
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
    out = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
