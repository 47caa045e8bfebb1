"""Quality by positive-unlabelled learning with the non-negative unbiased risk estimator.

Trusted positives are labelled rows of quality 1; unlabelled rows are any documents; the class prior is the share of
quality 1 among labelled rows. With logistic loss l the risk is prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]):
no row of quality 0 is shown to the model as such. The model is linear in a fixed number of measures of a text's form,
each cut at quantiles of the sample, so that it can bend; its sigmoid is the score. Fitting uses bounded samples of rows;
scoring reads whole texts where they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, ship, slices

LETTERS = re.compile(r"[^\W\d_]+")
MEASURES = 14


def measures(text: str | None) -> list[float]:
    """Measures of form; all are shares or logarithms, and defined for empty texts."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * MEASURES
    low = [w.lower() for w in words]
    letters = LETTERS.findall(text)
    n_letters = sum(map(len, letters)) or 1
    kinds = len(set(low))
    same = sum(a == b for a, b in zip(low, low[1:], strict=False))
    pairs = len(set(zip(low, low[1:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    plain = sum(map(str.isalpha, words))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    marks = chars - n_letters - text.count(" ") - text.count("\n")
    stops = text.count(".") + text.count(",")
    shaped = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    bare = sum(1 for w in words if not any(map(str.isalnum, w)))
    return [kinds / n, same / n, pairs / n, upper / n, marks / chars, (marks - stops) / chars, stops / n, plain / n, shaped / n, bare / n,
            np.log1p(n), n_letters / n, len(set(lines)) / len(lines), sum(map(str.isdigit, text)) / chars]


@dataclass
class Model:
    knots: np.ndarray  # MEASURES x cuts
    weights: np.ndarray
    bias: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """A step for each knot below the value, and a ramp between the outer ones."""
        lo, hi = self.knots[:, :1].T, self.knots[:, -1:].T
        ramp = np.clip((x - lo) / np.maximum(hi - lo, 1e-9), -1, 2)
        return np.concatenate([ramp, *((x > k).astype(float) for k in self.knots.T)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights + self.bias, -40, 40)))


def _measured(batches):
    for part in slices(batches, "text"):
        x = np.array([measures(t) for t in part.column(1).to_pylist()], np.float64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def nnpu(design_p: np.ndarray, design_u: np.ndarray, prior: float, penalty: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk by Adam; where the estimate of the negative part falls below 0 its gradient is turned round."""
    k = design_p.shape[1]
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    p, u = (np.concatenate([d, np.ones((len(d), 1))], axis=1) for d in (design_p, design_u))
    soft, sig = (lambda f: np.logaddexp(0, f)), (lambda f: 1 / (1 + np.exp(-np.clip(f, -40, 40))))
    for t in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        gp = prior * (p.T @ (sig(fp) - 1)) / len(p)  # of l(f) over positives
        neg = soft(fu).mean() - prior * soft(fp).mean()
        gn = u.T @ sig(fu) / len(u) - prior * (p.T @ sig(fp)) / len(p)
        g = gp + gn if neg >= 0 else -gn
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 if t < steps * 0.7 else 0.2)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000, cuts: int = 9) -> Model:
    """Fit on about ``rows`` trusted positives and as many unlabelled documents, none of them held out."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = {r.quality: r.n for r in usable.groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = known.get(1, 0) / max(1, sum(known.values()))
    good = labelled_sample(usable.filter("quality = 1").select(F.col("doc_id").cast("long"), F.lit(1).alias("y")), "doc_id", rows, "y")
    web = labelled_sample(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(
        F.col("doc_id").cast("long"), F.lit(0).alias("y")), "doc_id", rows, "y")
    # bounded by 2 x rows, so it can be sent to every executor
    chosen = docs.select("doc_id", "text").join(F.broadcast(good.unionByName(web)), "doc_id").select("y", "text")
    got = ship(chosen).mapInArrow(_measured, "y int, x array<double>").toPandas()
    if not len(got) or prior in (0.0, 1.0) or not (got["y"] == 1).any() or not (got["y"] == 0).any():
        return Model(np.zeros((MEASURES, 1)), np.zeros(2 * MEASURES), float(np.clip(40 * (2 * prior - 1), -40, 40)))
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    model = Model(np.quantile(x, np.linspace(0.02, 0.98, cuts), axis=0).T, np.zeros(0), 0.0)
    model.weights, model.bias = nnpu(model.design(x[y == 1]), model.design(x[y == 0]), prior)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (score >= ``threshold``). Whole texts; a
    null, empty or blank text has all measures 0 and the score of that. A null id is not held out."""

    def run(batches):
        for part in slices(batches, "text"):
            s = model(np.array([measures(t) for t in part.column(1).to_pylist()], np.float64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    out = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
