"""Registered queries over trained models (M3-M13, C1, C5, C7-C10, E8, T1-T3,
S6-S8). Trained-model outputs get the driver's rows-only check; their
quality is tested in tests/ with tolerances.

Models are trained once per input folder and preset, saved in the shared
checkpoint folder, and loaded by later queries (the reference's
train-if-missing behaviour, S8). A query names the models it reads; those are
trained and loaded, no others."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.operators import evaluate, segments
from loanlens.plans import models as M
from loanlens.plans.registry import register
from loanlens.plans.score import (RESULT_COLUMNS, agreement, model_probabilities,
                                  regression_predictions, score_with_models,
                                  segment_customers)
from loanlens.session import ensure_checkpoint_dir
from loanlens.sources.customers import load_customers
from loanlens.sources.fixtures import profiles
from loanlens.store import stored_table
from loanlens.streaming.score_stream import start_scoring_stream

PRESET = "fast"
#: The models of a scored application.
SCORING = (*M.CLASSIFIERS, "ridge", "kmeans")


def bundle_for(spark, d, *parts: str, preset: str = PRESET) -> M.Bundle:
    return M.ensure_artifacts(spark, lambda: load_customers(spark, d),
                              key=f"{d}|{M.input_version(spark, d)}", preset=preset, parts=parts)


def scored_batch(spark, d):
    """The batch scored once per session; the queries below read it."""
    return stored_table("scored", spark, d, lambda: score_with_models(
        batch_input(spark, d), bundle_for(spark, d, *SCORING), mode="batch"))


def probabilities(spark, d):
    """The loaded table's classifier probabilities, once per session."""
    return stored_table("probabilities", spark, d, lambda: model_probabilities(
        load_customers(spark, d), bundle_for(spark, d, *M.CLASSIFIERS)))


def predictions(spark, d):
    """C10 over the loaded table, once per session."""
    return stored_table("predictions", spark, d, lambda: regression_predictions(
        load_customers(spark, d), bundle_for(spark, d, *M.REGRESSORS)))


def labelled(spark, d):
    """The loaded table with the trained segment of every customer."""
    return segment_customers(load_customers(spark, d), bundle_for(spark, d, "kmeans"))


def batch_input(spark, d):
    """An uploaded batch as the reference receives it: the raw profile
    columns (derived ratios are recomputed by the batch formulas)."""
    return profiles(spark, d)


@register("train_metrics")
def train_metrics(spark, d):
    """T1 + E1/E2/E5: the five supervised models' metrics over the hold-out
    rows of the loaded table."""
    return M.evaluate_hold_out(load_customers(spark, d), bundle_for(spark, d, *M.SUPERVISED))


@register("model_comparison")
def model_comparison(spark, d):
    """One row per model."""
    return evaluate.comparison_table(M.evaluate_hold_out(load_customers(spark, d), bundle_for(spark, d, *M.SUPERVISED)))


@register("feature_importance")
def feature_importance(spark, d):
    """Top-20 forest importances, ascending, with band."""
    return M.feature_importance(spark, bundle_for(spark, d, "rf_clf"))


@register("ridge_coefficients")
def ridge_coefficients(spark, d):
    """M13."""
    return M.ridge_coefficients(spark, bundle_for(spark, d, "ridge"))


@register("kmeans_profile")
def kmeans_profile(spark, d):
    """M8 + A17 + M11: profile of the loaded table's customers by trained
    cluster, with segment names."""
    b = bundle_for(spark, d, "kmeans")
    rows = labelled(spark, d).na.fill(0.0, subset=b.clu_features)
    profile = segments.cluster_profile(rows, [c for c in b.clu_features if c != "CreditScore"], extra=["LoanApproved"])
    labels = spark.createDataFrame(sorted(b.segment_labels.items()), "Cluster int, label string")
    return profile.join(labels, "Cluster", "left").orderBy("Cluster")


@register("kmeans_segments")
def kmeans_segments(spark, d):
    """T3 + A18: customers of each trained segment."""
    return labelled(spark, d).groupBy("Cluster_Label").agg(F.count(F.lit(1)).alias("n"))


@register("kmeans_assignment")
def kmeans_assignment(spark, d):
    """The trained cluster and segment name of every customer of the
    loaded table."""
    return labelled(spark, d).select("RespondentID", "Cluster", "Cluster_Label")


@register("kmeans_segment_profile")
def kmeans_segment_profile(spark, d):
    """A16 on the trained segments."""
    from loanlens.operators.stats import segment_profile
    return segment_profile(labelled(spark, d), label="Cluster_Label")


@register("elbow")
def elbow(spark, d):
    """M9: inertia of the loaded table for k = 2..8 (best of 5 starts)."""
    b = bundle_for(spark, d, "elbow")
    vecs = M.assemble(load_customers(spark, d), b.clu_features, b.scalers["clu"])
    return M.elbow_table(vecs, b.elbow_centers)


def _pca(spark, d):
    b = bundle_for(spark, d, "kmeans")
    keep = ["RespondentID", "Cluster_Label"]
    vecs = M.assemble(labelled(spark, d), b.clu_features, b.scalers["clu"], keep=keep)
    return M.pca_projection(vecs, keep=keep)


@register("pca_projection")
def pca_projection(spark, d):
    """2-D PCA coordinates and trained segment of every customer."""
    return _pca(spark, d)[0]


@register("pca_variance")
def pca_variance(spark, d):
    """Explained-variance ratios of the two components."""
    ratios = _pca(spark, d)[1]
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)],
                                 "component int, explained_variance_ratio double")


@register("batch_scores")
def batch_scores(spark, d):
    """The scored batch (input columns + five result columns)."""
    return scored_batch(spark, d).select("RespondentID", *RESULT_COLUMNS)


@register("scored_preview")
def scored_preview(spark, d):
    """The first 30 rows of the scored batch."""
    from loanlens.sources.customers import preview
    b = scored_batch(spark, d).drop("p_gb", "p_rf", "p_lr", "ridge_pred")
    return preview(b, 30)


@register("batch_summary")
def batch_summary(spark, d):
    """Scored / approved / borderline / rejected / mean score."""
    from loanlens.operators.stats import batch_summary as summary
    return summary(scored_batch(spark, d))


@register("batch_decisions")
def batch_decisions(spark, d):
    """Counts by decision and by segment."""
    s = scored_batch(spark, d)
    by_dec = s.groupBy(F.lit("decision").alias("kind"), F.col("Loan_Decision").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))
    by_seg = s.groupBy(F.lit("segment").alias("kind"), F.col("Marketing_Segment").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return by_dec.unionByName(by_seg)


@register("model_votes")
def model_votes(spark, d):
    """C7 with the trained models."""
    return agreement(scored_batch(spark, d))


@register("regression_predictions")
def regression_predictions_q(spark, d):
    """Ridge and forest predictions for the whole table, with residuals."""
    return predictions(spark, d)


def _residuals(spark, d, model):
    return evaluate.residuals(predictions(spark, d), "actual", f"{model}_pred")


def _per_model(fn):
    """The same table for the ridge and the forest, one below the other."""
    def run(spark, d):
        parts = [fn(spark, d, m).withColumn("model", F.lit(n))
                 for m, n in (("ridge", "ridge"), ("rf", "random_forest"))]
        return parts[0].unionByName(parts[1])
    return run


@register("model_residual_histogram")
@_per_model
def model_residual_histogram(spark, d, model):
    """45-bin histogram of the trained regressors' residuals."""
    from loanlens.operators.histogram import histogram
    return histogram(_residuals(spark, d, model), "residual", 45)


@register("model_residual_summary")
@_per_model
def model_residual_summary(spark, d, model):
    """Mean and spread of the residuals."""
    return _residuals(spark, d, model).agg(
        F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"),
        F.stddev_samp("residual").alias("std_residual"))


@register("model_actual_vs_predicted")
@_per_model
def model_actual_vs_predicted(spark, d, model):
    """The 500-row actual-against-predicted sample."""
    from loanlens.operators.sample import sample_n
    return sample_n(_residuals(spark, d, model), 500, seed=0)


@register("model_trend_line")
@_per_model
def model_trend_line(spark, d, model):
    """E7 + A25: the trend line through that sample."""
    from loanlens.operators.distribution import fit_line
    from loanlens.operators.sample import sample_n
    return fit_line(sample_n(_residuals(spark, d, model), 500, seed=0), "actual", "predicted")


@register("feature_importance_top5")
def feature_importance_top5(spark, d):
    """The five most important features."""
    return M.feature_importance(spark, bundle_for(spark, d, "rf_clf"), 5)


@register("ridge_extremes")
def ridge_extremes(spark, d):
    """Three coefficients that push the score up and three down."""
    return M.ridge_extremes(spark, bundle_for(spark, d, "ridge"))


@register("model_roc_points")
def model_roc_points(spark, d):
    """E4 for the three classifiers on all rows (as the reference's page)."""
    s = probabilities(spark, d)
    parts = []
    for name, col in (("gradient_boosting", "p_gb"), ("random_forest", "p_rf"),
                      ("logistic_regression", "p_lr")):
        pts = evaluate.roc_points(s, "LoanApproved", col).select("threshold", "fpr", "tpr")
        parts.append(pts.withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("model_confusion")
def model_confusion(spark, d):
    """E3 for gradient boosting on all rows."""
    s = probabilities(spark, d)
    return evaluate.confusion(s.withColumn("pred", (F.col("p_gb") >= 0.5).cast("int")),
                              "LoanApproved", "pred")


@register("live_stream_scores")
def live_stream_scores(spark, d):
    """Applications arriving as files are scored by a Structured
    Streaming query with the live formulas; the sink is read back."""
    b = bundle_for(spark, d, *SCORING)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src, sink, ckpt = f"{root}/incoming", f"{root}/scored", f"{root}/_checkpoint"
    batch = batch_input(spark, d)
    derived = {"RiskScore", "EMI_to_Income", "SavingsToDebt", "FamilyBurdenScore",
               "RepaymentHistory_Ord"}
    apps = batch.select("RespondentID", *[
        c for c in K.CLF_FEATURES + ["RepaymentHistory", "CreditScore"]
        if c in batch.columns and c not in derived])
    apps.write.mode("overwrite").parquet(src)
    q = start_scoring_stream(spark, src, apps.schema, b, sink, ckpt, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)
