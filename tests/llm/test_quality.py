import math
import zlib

import numpy as np
from cohortflow.llm.common import table
from cohortflow.llm.quality import MEASURES, fit, measures, nnpu, score

from .conftest import SF


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = score(docs, fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert np.mean([r.predicted for r in good]) >= 0.98 and np.mean([r.predicted for r in bad]) <= 0.08


def test_only_allowed_rows_are_learned_from(spark):
    """Wrong labels on held-out rows change nothing."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    wrong = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality")
    a, b = fit(docs, labels), fit(docs, wrong)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edge_cases(make):
    good, junk = "A calm sentence, with some words. Another one follows here.", "BUY!! NOW!! BUY!! NOW!! $$$ ### BUY!! NOW!!"
    rows = [(i, (good if i % 3 else junk) + f" w{i}" * (i % 5)) for i in range(300)]
    labels = make([]).sparkSession.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows if i % 2] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = make(rows + [(900, None), (901, ""), (902, " \n"), (None, good), (903, good * 20_000), (904, junk), (904, junk)])
    got = score(docs.withColumnRenamed("lang", "y").withColumnRenamed("source", "score"), fit(docs, labels)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) + 7 and len({r.score for i in (900, 901, 902) for r in by[i]}) == 1
    assert by[None][0].held_out is False and [r.predicted for r in by[904]] == [0, 0]
    assert np.mean([by[i][0].predicted == int(i % 3 > 0) for i, _ in rows]) > 0.95
    empty = make([])
    blank = fit(empty, labels.filter("false"))
    assert score(empty, blank).collect() == [] and all(0 <= r.score <= 1 for r in score(docs, blank).collect())
    assert len(measures("x")) == len(measures(None)) == MEASURES and np.isfinite(measures("a\x0b1\n\nB!!")).all()


def test_positive_unlabelled_posterior():
    """Two overlapping normals, 30 % positive: the score estimates the posterior without any negative label."""
    rng = np.random.default_rng(1)
    pos = rng.normal(1.5, 1, (4000, 1))
    y = rng.random(8000) < 0.3
    web = np.where(y, rng.normal(1.5, 1, 8000), rng.normal(-1.5, 1, 8000))[:, None]
    w, b = nnpu(pos, web, 0.3, penalty=1e-6, steps=1500)
    p = 1 / (1 + np.exp(-(web @ w + b)))
    true = 0.3 * np.exp(-((web[:, 0] - 1.5) ** 2) / 2)
    true = true / (true + 0.7 * np.exp(-((web[:, 0] + 1.5) ** 2) / 2))
    assert np.mean((p > 0.5) == y) > 0.92 and np.mean(np.abs(p - true)) < 0.06


def plain_measures(text):
    """The measures in the order of the model, counted one by one."""
    t = text or ""
    words = t.split()
    if not words:
        return [0.0] * MEASURES
    n, lows = len(words), [w.lower() for w in words]
    follow = [(lows[i], lows[i + 1]) for i in range(n - 1)]
    letters = 0
    for c in t:
        letters += c != "_" and c.isalnum() and not c.isdecimal()
    letters = letters or 1
    marks = len(t) - letters - sum(c in " \n" for c in t)
    stops = sum(c in ".," for c in t)
    lines = [x for x in t.split("\n") if x != ""]
    return [len(set(lows)) / n, sum(a == b for a, b in follow) / n, len(set(follow)) / n,
            sum(len(w) > 1 and w.upper() == w and w.lower() != w for w in words) / n, marks / len(t), (marks - stops) / len(t), stops / n,
            sum(all(c.isalpha() for c in w) for w in words) / n, sum(not (w[-1].isalnum() or w[-1] in ".,") for w in words) / n,
            sum(not [c for c in w if c.isalnum()] for w in words) / n, math.log(1 + n), letters / n, len(set(lines)) / len(lines),
            sum(c.isdigit() for c in t) / len(t)]


def plain_score(model, text):
    z = model.bias
    x = plain_measures(text)
    m = len(x)
    for j, knots in enumerate(model.knots.tolist()):
        ramp = (x[j] - knots[0]) / max(knots[-1] - knots[0], 1e-9)
        z += model.weights[j] * min(2, max(-1, ramp))
        for i, k in enumerate(knots):
            z += model.weights[m + i * m + j] * (x[j] > k)
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def test_equals_plain_scores(spark):
    """Every document of sf0.01, and hard texts, against the plain score of the fitted model."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit(docs, labels)
    assert np.abs(model.weights).max() > 0
    odd = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "A a_b 1c2 \u00df \u0663 !? ... x.\n\nx.\n"), (-5, "word, " * 30_000), (-6, "__ -- 12")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r for r in score(both, model).collect()}
    n = 0
    for r in both.collect():
        want, g = plain_score(model, r.text), got[r.doc_id]
        assert abs(g.score - want) < 1e-9 and (g.predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-9)
        n += 1
    assert n == len(got)
