"""Evaluation: AUC equals the Mann-Whitney statistic; confusion edge cases."""

import itertools

import numpy as np

from loanlens.operators import evaluate, sample


def test_auc_is_mann_whitney(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 300)
    scores = np.round(rng.random(300) + labels * 0.3, 1)     # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores)],
                               "y int, s double").repartition(6)
    auc = evaluate.roc_auc(df, "y", "s").first()["auc"]
    pos, neg = scores[labels == 1], scores[labels == 0]
    mw = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(auc - mw) < 1e-12
    pts = evaluate.roc_points(df, "y", "s").orderBy("threshold", ascending=False).collect()
    assert pts[-1]["fpr"] == 1.0 and pts[-1]["tpr"] == 1.0


def test_confusion_absent_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    r = evaluate.confusion(df, "y", "p").first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (0, 0, 0, 2)
    assert r["precision"] == 1.0 and r["recall"] == 1.0
    df0 = spark.createDataFrame([(0, 0)], "y int, p int")
    r0 = evaluate.confusion(df0, "y", "p").first()
    assert r0["precision"] == 0.0 and r0["recall"] == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    r = evaluate.regression_metrics(df, "y", "p").first()
    assert r["mae"] == 0.33 and r["rmse"] == 0.41 and r["r2"] == 75.0


def test_split_is_stable_under_repartitioning(spark):
    df = spark.range(2000).selectExpr("format_string('R%04d', id) AS RespondentID")
    a = sample.split(df, 20, 42).where("is_test = 1").select("RespondentID")
    b = sample.split(df.repartition(13), 20, 42).where("is_test = 1").select("RespondentID")
    ra, rb = sorted(r[0] for r in a.collect()), sorted(r[0] for r in b.collect())
    assert ra == rb and 300 < len(ra) < 500


def test_sample_exact_n(spark):
    df = spark.range(1000).selectExpr("format_string('R%04d', id) AS RespondentID")
    s1 = [r[0] for r in sample.sample_n(df, 500, 42).collect()]
    s2 = [r[0] for r in sample.sample_n(df.repartition(9), 500, 42).collect()]
    assert len(set(s1)) == 500 and sorted(s1) == sorted(s2)
    assert sample.sample_n(df, 5000, 42).count() == 1000
