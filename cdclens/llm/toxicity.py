"""Operator 3, toxicity: non-negative positive-unlabelled learning of a numpy classifier.

Confirmed toxic examples and unlabelled text train a linear model on hashed words and word starts.  Its risk is
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``: the second part estimates the risk on the
unseen negatives, and while it is below zero the step goes the other way, so that the model can't drive it there.
The class prior is the share of label 1 among the rows that may be learned from.

The toxic examples are a bounded sample of the labelled rows (``max_positive``), and the unlabelled text over which the risk is taken is a bounded uniform sample of
the documents that may be read (``max_unlabelled``, by a hash of doc_id; the README has figures).  Which features count is decided by all of those documents: P(f) comes from
one aggregation over all of them, by hashed feature.  The driver gets the features, 2**bits at most, whose prior-corrected precision ``prior * P(f|toxic) / P(f)`` reaches a half,
the count among the toxic examples taken one deviation lower, and that at least ``MIN_SUPPORT`` of them have, far more than chance would give; and which example has which of those.
Scoring reads every whole text.

Defined cases: a null text scores as an empty one; a null label is none; a document labelled repeatedly counts
once, as toxic if any row says so; without a toxic example every score is the prior (0 without labels); equal
examples count once; other columns pass through and may bear any name but the score's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdclens.llm import _hashed as H
from cdclens.llm import _store as S
from cdclens.llm.quality import fold, labelled

MAX_POSITIVE = 2500
MAX_UNLABELLED = 10000
#: Toxic examples that a feature must occur in.
MIN_SUPPORT = 3
#: Deviations by which a count among the toxic examples is lowered before a feature's precision is judged, so that rare words must be surer.
_SURE = 1.0
BITS = 20


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def _examples(bits: int):
    def of(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for a, b, ids, off in H.presence_features(batch.column("text"), bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic[a:b], pa.int32()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], names=["toxic", "ids"]
                )

    return of


def _counts(bits: int):
    """A partition's (feature, documents that have it) and, as feature -1, its documents."""

    def of(batches):
        total, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, ids, _ in H.presence_features(batch.column("text"), bits):
                total += np.bincount(ids, minlength=1 << bits)
        at = np.flatnonzero(total)
        rows = pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["feature", "k"])
        for k in range(0, rows.num_rows, 65536):
            yield rows.slice(k, 65536)

    return of


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], n_features: int, prior: float, steps: int = 300, rate: float = 0.1, l1: float = 0.001) -> tuple[np.ndarray, float]:
    """Weights and bias.  An example set is (example of each entry, feature of each entry, number of examples)."""
    (pd, pf, np_), (ud, uf, nu) = positive, unlabelled
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        sp = b + np.bincount(pd, w[pf], minlength=np_)
        su = b + np.bincount(ud, w[uf], minlength=nu)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        as_negative_p, as_negative_u = -prior * H.sigmoid(sp) / np_, H.sigmoid(su) / nu
        if negative >= 0:
            gp, gu = as_negative_p - prior * (1 - H.sigmoid(sp)) / np_, as_negative_u
        else:
            gp, gu = -as_negative_p, -as_negative_u
        g = np.append(np.bincount(pf, gp[pd], minlength=n_features) + np.bincount(uf, gu[ud], minlength=n_features), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1, 0)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, may_read: Column | None = None, label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, bits: int = BITS) -> Model:
    """``learn``: which rows of ``labels`` count; ``may_read``: which documents serve as unlabelled text and for the features' frequencies."""
    spark = docs.sparkSession
    S.arrow_batches(spark)
    learn = F.lit(True) if learn is None else learn
    known = labels.where(F.col(label).isin(0, 1) & learn)
    prior = known.agg(F.avg(label)).first()[0]
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior or 0.0, 1e-6) / max(1 - (prior or 0.0), 1e-6))), bits)
    if not prior or prior >= 1:
        return nothing
    toxic = labelled(known.where(F.col(label) == 1), label, F.lit(True), max_positive, lowest=False).select("doc_id", F.lit(1).alias("toxic"))
    own = docs.where(F.col("doc_id").isNotNull() & (F.lit(True) if may_read is None else may_read)).select("doc_id").distinct()
    other = own.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("toxic"))
    chosen = toxic.unionByName(other)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = S.cut(rows.mapInArrow(_examples(bits), "toxic int, ids array<int>").groupBy("toxic", F.xxhash64("ids").alias("example")).agg(F.first("ids").alias("ids")))
    count = dict(sample.groupBy("toxic").count().collect())
    n_p, n_u = count.get(1, 0), count.get(0, 0)
    if not n_p or not n_u:
        return nothing
    seen = docs if may_read is None else docs.where(may_read)
    seen = S.table(seen.select("text").mapInArrow(_counts(bits), "feature int, k long").groupBy("feature").agg(F.sum("k").alias("k")), "features")
    n = seen.where("feature = -1").first()[1]
    pairs = sample.select("toxic", "example", F.explode("ids").alias("feature"))
    share = (F.coalesce("k", F.lit(0)) + 1) / float(n)
    expected = share * n_p
    kept = [
        r[0]
        for r in pairs.where("toxic = 1").groupBy("feature").agg(F.count("*").alias("p")).where(F.col("p") >= MIN_SUPPORT).join(seen, "feature", "left")
        .where((prior * (F.col("p") - _SURE * F.sqrt("p")) / n_p >= 0.5 * share) & ((F.col("p") - expected) / F.sqrt(expected) >= 4)).select("feature").collect()
    ]
    if not kept:
        return nothing
    features = np.sort(np.array(kept, dtype=np.int64))
    listed = spark.createDataFrame([(int(x),) for x in features], "feature int")
    found = pairs.join(F.broadcast(listed), "feature").toPandas()
    found = found.sort_values(["toxic", "example", "feature"])
    at = np.searchsorted(features, found["feature"].to_numpy())
    is_p = found["toxic"].to_numpy() == 1

    def entries(mask: np.ndarray, n: int):
        return np.unique(found["example"].to_numpy()[mask], return_inverse=True)[1], at[mask], n

    weights, bias = fit(entries(is_p, n_p), entries(~is_p, n_u), len(features), float(prior))
    return Model(features, weights, bias, bits)


def scores(model: Model, text: pa.Array) -> np.ndarray:
    out = np.full(len(text), model.bias)
    if not len(model.features):
        return H.sigmoid(out)
    weight = np.zeros(1 << model.bits)
    weight[model.features] = model.weights
    half = 1 << (model.bits - 1)
    for a, b, h, head, _, sign, off in H.words(text):
        doc = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(off))
        for ids in ((h >> np.uint64(65 - model.bits)).astype(np.int64), (head >> np.uint64(65 - model.bits)).astype(np.int64) + half):
            hit = np.flatnonzero((weight[ids] != 0) & ~sign)
            key = np.unique((doc[hit] << model.bits) + ids[hit])
            out[a:b] += np.bincount(key >> model.bits, weight[key & ((1 << model.bits) - 1)], minlength=b - a)
    return H.sigmoid(out)


def with_score(docs: DataFrame, model: Model, into: str = "score", text: str = "text") -> DataFrame:
    """Adds the probability of being toxic.  The model goes out once, as a broadcast of what features it has."""
    S.arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias, model.bits))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(scores(Model(*sent.value), column))

    return docs.withColumn(into, score(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = (S.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs, labels, fold("doc_id", 5) != 0, fold("doc_id", 5) != 0)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
