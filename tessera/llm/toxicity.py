"""Toxicity as a severity grade: cumulative-link ordinal regression over sparse text features.

P(grade > k) = logistic(w.x - t_k) with one weight vector for all thresholds and t_0 < t_1 < ... The result is the expected
severity, the sum of these probabilities.

Features are words and their first 4, 5 and 6 bytes (stems, as languages here bend and join words), log(1 + count), hashed to 64 bits. The model is
fitted on at most ``fit_rows`` labelled documents, the ones whose ids hash lowest (the bound is a parameter); the
``FEATURES`` features that tell the labels apart best there (chi-square over ``LEAST_CHI``) are used. The labels give toxic or not. Grades above 0 are told apart by how much
evidence a toxic document holds: terciles of the count of features with positive weight in a first, two-grade fit.

All documents are scored over their whole texts, one Arrow batch at a time; the model (a few kB) goes with the task.

Defined results: null text has no features and gets the model's base severity; labels that are null or name no document are left out; of several
labels for one id the highest counts; without both kinds of label everything has severity 0; repeated rows are each scored; an
empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowwords import Words, chunks, mixed
from .common import durable
from .licenses import BETWEEN

FIT_ROWS, FEATURES, LEAST_DOCS, LEAST_CHI, PENALTY, ROUNDS = 20_000, 512, 5, 30.0, 0.3, 300
STEMS, GRADES = (4, 5, 6), 3


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def feature_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of every word and stem."""
    w = Words(texts, lower=True, space=BETWEEN)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    rows, found = [row], [w.hashes()]
    for k in STEMS:
        long = np.flatnonzero(w.ends - w.starts >= k)
        rows.append(row[long])
        found.append(mixed(w.span_hashes(w.starts[long], w.starts[long] + k) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(found)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the penalised likelihood. The gaps between thresholds are exponentials, so their order holds."""
    n, d = x.shape
    p = np.zeros(d + grades)
    p[d] = np.log((np.sum(y == 0) + 1) / (np.sum(y > 0) + 1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    ends = np.arange(n)
    for r in range(1, rounds + 1):
        gaps = np.exp(p[d + 1 :])
        t = np.concatenate([[-np.inf], p[d] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        eta = (x @ p[:d].astype(x.dtype)).astype(float)
        hi, lo = _logistic(t[y + 1] - eta), _logistic(t[y] - eta)
        hi, lo = np.where(y == grades, 1.0, hi), np.where(y == 0, 0.0, lo)
        prob = np.maximum(hi - lo, 1e-12)
        of_eta = -(1 - hi - lo)
        of_t = np.zeros((n, grades + 2))
        of_t[ends, y + 1] += np.where(y == grades, 0, hi * (1 - hi)) / prob
        of_t[ends, y] -= np.where(y == 0, 0, lo * (1 - lo)) / prob
        by_t = of_t.sum(axis=0)[1:-1]
        later = np.cumsum(by_t[::-1])[::-1]
        g = np.concatenate([-(of_eta.astype(x.dtype) @ x) + penalty * p[:d], [-later[0]], -later[1:] * gaps]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def matrix(rows: np.ndarray, found: np.ndarray, n: int, features: np.ndarray) -> np.ndarray:
    """Counts of the model's features, a row for each text."""
    at = np.searchsorted(features, found)
    hit = np.flatnonzero(features[np.minimum(at, len(features) - 1)] == found) if len(features) else np.zeros(0, np.int64)
    out = np.zeros((n, len(features)), np.float32)
    np.add.at(out, (rows[hit], at[hit]), 1)
    return out


def _counted(batches):
    """(feature, n, toxic): documents with the feature, in this batch."""
    for b in chunks(batches):
        rows, found = feature_hashes(b.column("text"))
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((rows, found))
        rows, found = rows[order], found[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        names, at = np.unique(found[new], return_inverse=True)
        own = toxic[rows[new]]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(at, own, minlength=len(names)).astype(np.int64))], ["feature", "n", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = durable(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))  # at most fit_rows pairs of numbers
    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 40.0))
    if not bad or bad == total:
        return nothing
    counts = sample.select("text", "toxic").mapInArrow(_counted, "feature bigint, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_DOCS)
    rate = bad / total
    spread = F.col("n") * (rate * (1 - rate)) * (1 - F.col("n") / (total + 1.0))
    best = counts.select("feature", (F.pow(F.col("toxic") - F.col("n") * rate, 2) / spread).alias("chi")).where((F.col("chi") > LEAST_CHI)).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    features = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))

    def vectors(batches):
        for b in chunks(batches):
            x = matrix(*feature_hashes(b.column("text")), b.num_rows, features)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([r.tobytes() for r in np.minimum(x, 255).astype(np.uint8)], pa.binary())], ["toxic", "x"])

    got = sample.select("text", "toxic").mapInArrow(vectors, "toxic int, x binary").collect()  # at most fit_rows * FEATURES bytes
    x = np.log1p(np.stack([np.frombuffer(r.x, np.uint8) for r in got]).astype(np.float32))
    toxic = np.array([r.toxic for r in got])
    weights, _ = fit_ordinal(x, (toxic > 0).astype(int), 1, rounds=ROUNDS // 2)
    evidence = np.expm1(x) @ (weights > 0.5).astype(x.dtype)
    cuts = np.quantile(evidence[toxic > 0], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic > 0, 1 + np.searchsorted(cuts, evidence, side="left"), 0)
    grade = np.searchsorted(np.unique(grade), grade)  # ties between terciles leave fewer grades
    return Model(features, *fit_ordinal(x, grade, int(grade.max())))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """For each row of docs: doc_id, severity (expected grade), grade (most thresholds passed at even odds), toxic."""

    def scored(batches):
        for b in chunks(batches):
            x = np.log1p(matrix(*feature_hashes(b.column("text")), b.num_rows, model.features))
            above = _logistic((x @ model.weights)[:, None] - model.thresholds[None, :])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array((above > 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] > 0.5)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), "text").mapInArrow(scored, "doc_id bigint, severity double, grade int, p_toxic double, toxic boolean")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
