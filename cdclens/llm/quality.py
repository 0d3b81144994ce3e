"""Operator 10, quality classifier: hashed word n-gram logistic regression, learned by
follow-the-regularised-leader (proximal, per coordinate), scored as sparse dot products.

Training reads a bounded sample of labelled rows (``max_labelled``); scoring reads every whole text.
The labelled rows' features stay on the executors and reach the driver a partition at a time,
so the driver holds one partition and the model, whatever the corpus.

Defined cases: a null text scores as an empty one (the bias alone); a null label is no label; a document
labelled repeatedly counts once with its lowest label; a null doc_id is never labelled and folds as crc32 of
the empty text; without labels of both kinds every score is their mean (0.5 without any); other columns of
the documents pass through and may bear any name but the score's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdclens.llm import _hashed as H
from cdclens.llm import _store as S

#: Labelled rows that training reads at most, those of the smallest xxhash64(doc_id).
MAX_LABELLED = 6000
BITS = 18


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(labels: DataFrame, label: str, learn: Column, max_labelled: int, lowest: bool = True) -> DataFrame:
    """(doc_id, label) once for each document, at most so many."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy("doc_id").agg((F.min if lowest else F.max)(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )


def _squeezed(ids: np.ndarray, values: np.ndarray, off: np.ndarray, bits: int):
    """Distinct features of each document with the root of their weight, and the new offsets."""
    n = len(off) - 1
    key = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(off)) + ids
    key, inverse = np.unique(key, return_inverse=True)
    value = np.sqrt(np.bincount(inverse, values, minlength=len(key)))
    return key & ((1 << bits) - 1), value, np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits)


def _examples(bits: int):
    def of(batches):
        for batch in batches:
            label = batch.column("label").to_pylist()
            key = batch.column("key").to_pylist()
            for a, b, ids, values, off in H.quality_features(batch.column("text"), bits):
                i, v, o = _squeezed(ids, values, off, bits)
                i, v = i.astype("<i4"), v.astype("<f4")
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[a:b], pa.int64()), "label": pa.array(label[a:b], pa.int32()),
                    "ids": pa.array([i[o[k] : o[k + 1]].tobytes() for k in range(b - a)], pa.binary()),
                    "values": pa.array([v[o[k] : o[k + 1]].tobytes() for k in range(b - a)], pa.binary()),
                })

    return of


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", max_labelled: int = MAX_LABELLED, bits: int = BITS, epochs: int | None = None, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.0) -> Model:
    """``learn`` says which rows of ``labels`` may be learned from.  Epochs: 2, or up to 20 over few rows."""
    spark = docs.sparkSession
    S.arrow_batches(spark)
    chosen = labelled(labels, label, F.lit(True) if learn is None else learn, max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", F.xxhash64("doc_id", "text").alias("key"))
    sample = S.cut(rows.mapInArrow(_examples(bits), "key long, label int, ids binary, values binary").repartition(8, F.pmod("key", F.lit(8))).sortWithinPartitions("key", "label"))
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    ones = seen = 0
    done = 0
    while done < (epochs or max(2, min(20, MAX_LABELLED // max(seen // max(done, 1), 1)))):
        done += 1
        for row in sample.select("label", "ids", "values").toLocalIterator(prefetchPartitions=True):
            i, x, y = np.frombuffer(row[1], "<i4"), np.frombuffer(row[2], "<f4").astype(float), row[0]
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = float(H.sigmoid(wi @ x + bias)) - y
            gx = g * x
            z[i] = zi + gx - (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / alpha * wi
            n[i] = ni + gx * gx
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            ones, seen = ones + y, seen + 1
    if not 0 < ones < seen:
        share = ones / seen if seen else 0.5
        return Model(w.astype(np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))), bits)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)), bits)


def scores(model: Model, text: pa.Array) -> np.ndarray:
    out = np.full(len(text), model.bias)
    for a, b, ids, values, off in H.quality_features(text, model.bits):
        i, v, o = _squeezed(ids, values, off, model.bits)
        out[a:b] += H.sums(model.weights[i] * v, o)
    return H.sigmoid(out)


def with_score(docs: DataFrame, model: Model, into: str = "score", text: str = "text") -> DataFrame:
    """Adds the probability of label 1.  The model goes out once, as a broadcast of 4 * 2**bits bytes (1 MB)."""
    spark = docs.sparkSession
    S.arrow_batches(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.bias, model.bits))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(scores(Model(*sent.value), column))

    return docs.withColumn(into, score(F.col(text)))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns alone."""
    own = "__quality"
    while own in docs.columns:
        own += "_"
    return with_score(docs, model, own).where(F.col(own) >= threshold).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = (S.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs, labels, fold("doc_id", 3) != 1)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
