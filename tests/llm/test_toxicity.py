import math
import unicodedata

import numpy as np
import xxhash
from cohortflow.llm.common import table
from cohortflow.llm.toxicity import cumulative_link, fit, score, without_toxic
from pyspark.sql import functions as F

from .conftest import SF


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit(docs, labels)
    out = score(docs, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    toxic, clean = [r for r in out if r.toxic], [r for r in out if not r.toxic]
    assert np.mean([r.rejected for r in toxic]) >= 0.9 and np.mean([r.rejected for r in clean]) <= 0.005
    assert np.mean([r.severity for r in toxic]) > 1 > 0.1 > np.mean([r.severity for r in clean])
    assert all(0 <= r.severity <= 2 for r in out)
    left = without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == score(docs, model).filter("not rejected").count()


def test_edge_cases(make):
    texts = ["you are an idiot and a moron", "the cat sat on the mat", "trash idiot moron scum", "a fine day by the sea"] * 30
    rows = [(i, f"{t} n{chr(97 + i % 26)}") for i, t in enumerate(texts)]
    labels = make([]).sparkSession.createDataFrame([(i, 1, int("idiot" in t)) for i, t in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = make(rows + [(900, None), (901, ""), (902, "12 !!"), (None, "idiot moron trash scum"), (903, "an idiot and a moron you are " * 50_000), (904, "calm " * 50_000)])
    model = fit(docs.withColumnRenamed("lang", "toxic"), labels)
    got = {}
    for r in score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.rejected)
    assert all(got[i] == ["idiot" in t] for i, t in rows)
    assert got[900] == got[901] == got[902] == [False] and got[None] == [True] and got[903] == [True] and got[904] == [False]
    empty = make([])
    untrained = fit(empty, labels.filter("false"))
    assert score(empty, untrained).collect() == [] and not any(r.rejected for r in score(docs, untrained).collect())


def test_thresholds_share_weights_and_order():
    rng = np.random.default_rng(0)
    n, x = 3000, None
    x = rng.standard_normal(n)
    latent = 2 * x + rng.logistic(size=n)
    grade = (latent > 0).astype(int) + (latent > 3)
    w, th = cumulative_link(np.arange(n), np.zeros(n, int), x, grade, 1, 1e-6, 800)
    assert abs(w[0] - 2) < 0.25 and abs(th[0]) < 0.2 and abs(th[1] - 3) < 0.35 and th[0] < th[1]


def plain_score(model, text):
    """Severity and p_toxic of one text by the book: runs of letters, each distinct word once, its weights summed, two logistic steps."""
    words, run = set(), ""
    for c in (text or "").lower() + " ":
        if c == "_" or not (c.isalnum() and not unicodedata.category(c) == "Nd"):
            words.add(run)
            run = ""
        else:
            run += c
    weights = dict(zip(map(int, model.names), model.weights, strict=True))
    x = 0.0
    for w in words - {""}:
        for name in ["=" + w] + [w[:n] for n in range(4, 8) if len(w) > n]:
            x += weights.get(xxhash.xxh3_64_intdigest(name) - 2**63, 0.0)
    steps = [1 / (1 + math.exp(min(60, t - x))) for t in model.thetas]
    return sum(steps), steps[0]


def test_equals_plain_scores(spark):
    """Every document of sf0.01, and hard texts, against the plain score of the fitted model."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit(docs, labels)
    assert len(model.names) and (model.weights > 0).any() and model.thetas[0] < model.thetas[1]
    odd = [(-1, None), (-2, ""), (-3, "a_b 1c2 \u00dfe \u0130x \u0663 na\u00efve"), (-4, "Idiot IDIOT idiot scum"), (-5, "trash " * 30_000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r for r in score(both, model).collect()}
    n = 0
    for r in both.collect():
        severity, p = plain_score(model, r.text)
        g = got[r.doc_id]
        assert abs(g.severity - severity) < 1e-9 and abs(g.p_toxic - p) < 1e-9 and (g.rejected == (p >= 0.5) or abs(p - 0.5) < 1e-9)
        n += 1
    assert n == len(got)
