import pytest
from pyspark.sql import functions as F

from cohortflow.functions.expr import cut
from cohortflow.operators import evaluate as EV
from cohortflow.operators.score import additive_score, reason_codes, risk_tier


def test_rule_score_fixture(spark):
    rows = [(76.0, 8, 2, 1, 1), (66.0, 3, 0, 0, 0), (80.0, 10, 4, 3, 1)]
    df = spark.createDataFrame(rows, "age double, los int, comorb int, prior int, emerg int")
    s = additive_score({"age": [(75, 2), (65, 1)], "los": [(7, 2), (3, 1)], "prior": [(2, 3), (0, 1)]},
                       counts=["comorb"], flags={"emerg": 1})
    out = df.select(F.round(s, 4).alias("s")).withColumn("t", risk_tier("s")).collect()
    assert [(r["s"], r["t"]) for r in out] == [(0.8, "High Risk"), (0.1, "Low Risk"), (0.95, "High Risk")]


def test_reason_codes_default(spark):
    df = spark.createDataFrame([(80.0,), (50.0,)], "age double")
    out = df.select(reason_codes([(F.col("age") > 75, "Advanced age")]).alias("r")).collect()
    assert out[0]["r"] == ["Advanced age"]
    assert out[1]["r"] == ["No major risk factors identified"]


SCORES = [(1, 1, .9), (2, 0, .8), (3, 1, .7), (4, 0, .7), (5, 0, .1)]


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(SCORES, "key long, label int, score double")


def test_auc_ap_fixture(scores):
    r = EV.ranking_metrics(scores, "label", "score").collect()[0]
    assert r["roc_auc"] == pytest.approx(0.75)
    assert r["average_precision"] == pytest.approx(0.75)


def test_auc_matches_spark_evaluator(spark, scores):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    auc = ev.evaluate(scores.withColumn("label", F.col("label").cast("double")))
    assert EV.roc_auc(scores, "label", "score").collect()[0][0] == pytest.approx(auc)


def test_confusion_fixture(scores):
    r = EV.binary_metrics(scores, "label", "score", 0.5).collect()[0]
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 2, 1, 0)
    assert r["accuracy"] == pytest.approx(0.6) and r["f1"] == pytest.approx(0.666667, abs=1e-6)
    assert r["sensitivity"] == 1.0 and r["specificity"] == pytest.approx(0.333333, abs=1e-6)
    assert r["ppv"] == 0.5 and r["npv"] == 1.0


def test_quartiles_and_capture_fixture(scores):
    g = {r["risk_group"]: r["n"] for r in EV.quartile_groups(scores, "label", "score").collect()}
    assert g == {"Low Risk": 3, "Medium-Low Risk": 0, "Medium-High Risk": 1, "High Risk": 1}
    c = EV.top_fraction_capture(scores, "label", "score", 0.2).collect()[0]
    assert c["threshold"] == pytest.approx(0.82)
    assert (c["n_top"], c["events_top"]) == (1, 1)
    assert c["capture"] == 0.5 and c["nns"] == 1.0


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0, 0.1)], "key long, label int, score double")
    r = EV.binary_metrics(df, "label", "score", 0.5).collect()[0]
    assert r["ppv"] == 0.0 and r["sensitivity"] == 0.0 and r["specificity"] == 1.0


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (3.5,), (30.0,), (1001.0,)], "x double")
    los = cut(F.col("x"), [0, 3, 7, 14, 30, 1000], ["Short", "Medium", "Long", "Extended", "Very_Long"])
    assert [r[0] for r in df.select(los).collect()] == [None, "Short", "Medium", "Extended", None]
    ages = spark.createDataFrame([(50.0,), (100.1,)], "x double")
    age = cut(F.col("x"), [0, 50, 65, 75, 85, 100], ["<50", "50-64", "65-74", "75-84", "85+"])
    assert [r[0] for r in ages.select(age).collect()] == ["<50", None]


def test_abnormality_and_clamp_keep_null(spark):
    from cohortflow.functions.expr import abnormality, clamp, scaled_cap
    df = spark.createDataFrame([(None,), (30.0,), (10.0,)], "x double")
    out = df.select(abnormality("x", 20, 5, "above", 1.0).alias("a"),
                    abnormality("x", 20, 5, "below", None).alias("b"),
                    clamp("x", 12, 25).alias("c"), scaled_cap("x", 20).alias("d")).collect()
    assert [tuple(r) for r in out] == [(None, None, None, None), (1.0, 0.0, 25.0, 1.0),
                                       (0.0, 2.0, 12.0, 0.5)]


def test_score_counts_many_buckets_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    n = 3000
    score = np.round(rng.beta(0.3, 3.0, size=n), 3)  # skewed, many ties
    label = (rng.random(n) < 0.2 + 0.5 * score).astype(int)
    df = spark.createDataFrame([(int(i), int(y), float(s)) for i, (y, s) in enumerate(zip(label, score))],
                               "key long, label int, score double")
    sc = {r["score"]: r for r in EV.score_counts(df, "label", "score").collect()}
    for s_val in list(sc)[:50]:
        r = sc[s_val]
        assert r["pos_below"] == int(((score < s_val) & (label == 1)).sum())
        assert r["neg_below"] == int(((score < s_val) & (label == 0)).sum())
        assert r["pos_from"] == int(((score >= s_val) & (label == 1)).sum())
        assert r["neg_from"] == int(((score >= s_val) & (label == 0)).sum())
    # brute-force tie-aware AUC and step-wise AP
    pos, neg = score[label == 1], score[label == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    ap = 0.0
    for t in np.unique(score)[::-1]:
        at = (score == t) & (label == 1)
        ge = score >= t
        ap += at.sum() / len(pos) * ((ge & (label == 1)).sum() / ge.sum())
    r = EV.ranking_metrics(df, "label", "score").collect()[0]
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-6)
    assert r["average_precision"] == pytest.approx(ap, abs=1e-6)


def test_ranking_without_positives_or_scores(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.7), ("b", 1, 0.5), ("c", 1, 0.5), ("c", 0, 0.5), (None, 1, 0.9), (None, 0, 0.2)],
                               "g string, label int, score double")
    got = {r["g"]: (r["roc_auc"], r["average_precision"]) for r in EV.ranking_metrics(df, "label", "score", ["g"]).collect()}
    assert got == {"a": (None, None), "b": (None, 1.0), "c": (0.5, 0.5), None: (1.0, 1.0)}
    assert EV.average_precision(df.filter("g = 'a'"), "label", "score").first()[0] is None
    for bad in (None, float("nan")):
        rows = spark.createDataFrame([(0, 0.1), (1, bad)], "label int, score double")
        for fn in (EV.binary_metrics, EV.roc_auc, EV.threshold_sweep):
            with pytest.raises(Exception, match="NULL or NaN"):
                fn(rows, "label", "score").collect()


def test_threshold_sweep_equals_separate_counts(spark):
    df = spark.range(500).selectExpr("cast(id % 3 = 0 as int) label", "(id * 37 % 101) / 100.0D as score")
    rows = df.collect()
    for r in EV.threshold_sweep(df, "label", "score", (0.9, 0.1, 0.5)).collect():
        t = r["threshold"]
        assert (r["tp"], r["fp"]) == tuple(sum(x["label"] == k and x["score"] >= t for x in rows) for k in (1, 0))
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 500


def test_vote_tie_goes_to_zero(spark):
    from cohortflow.operators.models import soft_vote
    s = spark.createDataFrame([(1, "m", 1, 0.25), (1, "n", 1, 0.75), (2, "m", 0, 0.5), (2, "n", 0, 0.75)], "k int, model string, label int, score double")
    assert {r["k"]: r["prediction"] for r in soft_vote(s, "k").collect()} == {1: 0, 2: 1}
