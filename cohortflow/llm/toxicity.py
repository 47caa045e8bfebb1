"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are a document's distinct words and their beginnings (four to seven letters, for languages that build words
from parts), lower-cased; a feature's value is the number of distinct words that have it. Grades come from the 0/1
label: 0 where it is 0; other documents are 1 or, if they hold more telltale features than the median of these, 2.
All thresholds share one weight vector: P(grade > k) = sigmoid(w x - theta_k). The score is the expected grade; a
document is rejected when a grade above 0 is likelier than not.

The model is fitted on a bounded sample of labelled rows; counts of its features are aggregated on the executors, and
only the ``n_features`` most telling ones, and the sample's values of those, come to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, held_out, labelled_sample, ship, slices

LETTERS = re.compile(r"[^\W\d_]+")
GRADES = 3


def features(word: str) -> list[int]:
    """Signed 64-bit names of a word's features."""
    parts = [f"={word}", *(word[:n] for n in (4, 5, 6, 7) if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Model:
    names: np.ndarray  # sorted feature names
    weights: np.ndarray
    thetas: np.ndarray

    def word_scores(self) -> Cache:
        known = dict(zip(self.names.tolist(), self.weights.tolist(), strict=True))
        return Cache(lambda w: sum(known.get(f, 0.0) for f in features(w)))

    def grades(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1 from the summed weights."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - x[:, None], -60, 60)))


def _sparse(batches):
    """(doc_id, toxic, text) -> one row for each document and feature."""
    cache = Cache(features, 100_000)
    for part in slices(batches, "text"):
        for d, y, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            words = distinct_words(t)
            f = np.array([x for w in words for x in cache[w]], np.int64)
            name, n = np.unique(f, return_counts=True)
            if len(name):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), d)), pa.array(np.full(len(name), y)), pa.array(name),
                                                  pa.array(n)], names=["doc_id", "toxic", "name", "n"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, n_features: int = 600, penalty: float = 1e-4, steps: int = 1200) -> Model:
    """Fit on about ``rows`` labelled rows of either class (never held-out ones). Features are the ``n_features`` most telling
    of those that toxic documents have far more often; a weight is never below 0, so that a long text can't talk itself out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sample = labelled_sample(usable.select(F.col("doc_id").cast("long"), F.col("toxic").cast("long")), "doc_id", rows, "toxic")
    # bounded by 2 x rows, so it can be sent to every executor
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    sparse = ship(some).mapInArrow(_sparse, "doc_id long, toxic long, name long, n long").persist()
    count = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(1, count.get(1, 0)), max(1, count.get(0, 0))
    by = sparse.groupBy("name").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    # telltale: eight times as frequent among labelled toxic documents as among clean ones
    telltale = (F.col("p") >= max(3, min(8, pos // 50))) & (F.col("p") / pos >= 8 * F.col("q") / neg)
    z = (F.col("p") / pos - F.col("q") / neg) / F.sqrt((F.col("p") + F.col("q") + 1) / (pos + neg) / F.least(F.lit(pos), F.lit(neg)))
    chosen = by.filter(telltale).withColumn("z", z).orderBy(F.desc("z"), "name").limit(n_features).select("name")
    names = np.sort(chosen.toPandas()["name"].to_numpy(np.int64))
    from pyspark.sql.types import LongType, StructField, StructType
    wanted = docs.sparkSession.createDataFrame([(int(n),) for n in names], StructType([StructField("name", LongType())]))
    cells = sparse.join(F.broadcast(wanted), "name").select("doc_id", "name", "n").toPandas()
    every = sample.toPandas().sort_values("doc_id")
    sparse.unpersist()
    doc = np.searchsorted(every["doc_id"].to_numpy(), cells["doc_id"].to_numpy())
    col, n = np.searchsorted(names, cells["name"].to_numpy()), cells["n"].to_numpy(float)
    y = every["toxic"].to_numpy(np.int64)
    found = np.bincount(doc, n, minlength=len(y)) if len(doc) else np.zeros(len(y))
    grade = y + ((y == 1) & (found > np.median(found[y == 1]) if (y == 1).any() else np.zeros(len(y), bool)))
    return Model(names, *cumulative_link(doc, col, n, grade, len(names), penalty, steps))


def cumulative_link(doc, col, value, grade, n_features: int, penalty: float, steps: int):
    """Maximum likelihood of the proportional-odds model with weights of 0 or more, by projected Adam;
    returns (weights, thetas), thetas ascending."""
    w, base, gap = np.zeros(n_features), 1.0, np.log(1.0)
    m, v = np.zeros(n_features + 2), np.zeros(n_features + 2)
    n_docs = len(grade)
    if not n_docs:
        return w, np.array([60.0, 61.0])
    for t in range(1, steps + 1):
        x = np.bincount(doc, value * w[col], minlength=n_docs) if len(doc) else np.zeros(n_docs)
        th = np.array([base, base + np.exp(gap)])
        above = 1 / (1 + np.exp(np.clip(th[None, :] - x[:, None], -60, 60)))  # P(grade > k)
        edges = np.concatenate([np.ones((n_docs, 1)), above, np.zeros((n_docs, 1))], axis=1)
        at = np.arange(n_docs)
        p = np.maximum(edges[at, grade] - edges[at, grade + 1], 1e-9)
        slope = edges * (1 - edges)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p
        gx = -(up - down) / n_docs  # d loss / d x
        gth = np.array([up[grade == k + 1].sum() - down[grade == k].sum() for k in range(GRADES - 1)]) / n_docs
        g = np.concatenate([np.bincount(col, value * gx[doc], minlength=n_features)[:n_features] + penalty * w if len(doc) else w * 0,
                            [gth.sum(), gth[1] * np.exp(gap)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, base, gap = np.maximum(w - step[:-2], 0), base - step[-2], np.clip(gap - step[-1], -6, 6)
    return w, np.array([base, base + np.exp(gap)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, severity (expected grade, 0 to 2), p_toxic and rejected. Whole texts. A null
    or empty text, or one without letters, has no features; its severity is that of the thresholds alone."""

    def run(batches):
        weight = model.word_scores().__getitem__
        for part in slices(batches, "text"):
            x = np.array([sum(map(weight, distinct_words(t))) for t in part.column(1).to_pylist()])
            p = model.grades(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)],
                                             names=["doc_id", "severity", "p_toxic", "rejected"])

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, severity double, p_toxic double, rejected boolean")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`score` rejects; all columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        weight = model.word_scores().__getitem__
        for part in slices(batches, text_col):
            x = np.array([sum(map(weight, distinct_words(t))) for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(model.grades(x)[:, 0] < 0.5))

    return ship(docs).mapInArrow(run, docs.schema)
