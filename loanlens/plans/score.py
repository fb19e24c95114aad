"""Scoring (C1-C8, C10): a map-only chain over the input batch.

The three feature vectors are built in one projection, each fitted model
appends its own output columns, and the decision, score, segment and action
are column expressions. There is no shuffle and no join: segment names and
actions are literal maps bounded by k. The same function serves batch
uploads (``mode="batch"``) and the incoming-application stream
(``mode="live"``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.functions.derive import derive
from loanlens.plans.models import Bundle, positive_probability, with_features

RESULT_COLUMNS = ["Approval_Probability_%", "Loan_Decision", "Predicted_CreditScore",
                  "Marketing_Segment", "Recommended_Action"]


#: What the live page shows of an application beside the result: the band of
#: its predicted score (F20) and the models' probabilities and votes.
LIVE_COLUMNS = [*RESULT_COLUMNS, "Score_Band", "p_gb", "vote_gb", "p_rf", "vote_rf", "p_lr", "vote_lr"]


def classified(v: DataFrame, bundle: Bundle) -> DataFrame:
    """Adds p_gb, p_rf and p_lr (and the classifiers' other outputs) to a table
    with the classifiers' vector."""
    for name, out in (("gb_clf", "p_gb"), ("rf_clf", "p_rf"), ("lr", "p_lr")):
        model = bundle.models[name].copy()
        model.setFeaturesCol("__f_clf").setPredictionCol(f"__pred_{name}")
        model.setProbabilityCol(f"__prob_{name}").setRawPredictionCol(f"__raw_{name}")
        v = model.transform(v).withColumn(out, positive_probability(f"__prob_{name}"))
    return v


def model_columns(df: DataFrame, bundle: Bundle, cluster_score: str = "input") -> DataFrame:
    """C1 + C4 + C5 inputs: adds p_gb, p_rf, p_lr, ridge_pred and cluster.

    ``cluster_score="input"`` clusters on the uploaded CreditScore (0 when
    absent, as the batch page does); ``"predicted"`` feeds the ridge
    prediction as CreditScore (the live form)."""
    cols = list(df.columns)
    m = bundle.models
    v = classified(with_features(with_features(df, bundle.features["clf"]), bundle.features["reg"]), bundle)
    ridge = m["ridge"].copy()
    ridge.setFeaturesCol("__f_reg").setPredictionCol("ridge_pred")
    v = ridge.transform(v).select(*cols, "p_gb", "p_rf", "p_lr", "ridge_pred")

    # The clustering features take another score; the table's own comes back after.
    if cluster_score == "predicted":
        used = C.clip("ridge_pred", 300.0, 900.0).cast("int").cast("double")
    else:
        used = F.col("CreditScore").cast("double") if "CreditScore" in cols else F.lit(0.0)
    held = v.withColumn("__own_score", F.col("CreditScore")) if "CreditScore" in cols else v
    v = with_features(held.withColumn("CreditScore", used), bundle.features["clu"])
    km = m["kmeans"].copy()
    km.setFeaturesCol("__f_clu").setPredictionCol("cluster")
    return km.transform(v).select(
        *[F.col("__own_score").alias(c) if c == "CreditScore" else c for c in cols],
        "p_gb", "p_rf", "p_lr", "ridge_pred", "cluster")


def score(df: DataFrame, bundle: Bundle, mode: str = "batch") -> DataFrame:
    """C8 (``mode="batch"``) and the live formulas (``mode="live"``): derive
    features with that mode's formulas, then add the five result columns and
    nothing else. NaN counts as null."""
    return score_with_models(df, bundle, mode).drop("p_gb", "p_rf", "p_lr", "ridge_pred")


def segment_customers(loaded: DataFrame, bundle: Bundle, out: str = "Cluster_Label") -> DataFrame:
    """T3 + J1: every customer of the loaded (median-filled) table with its
    trained cluster and segment name; map-only."""
    v = with_features(loaded, bundle.features["clu"])
    km = bundle.models["kmeans"].copy()
    km.setFeaturesCol("__f_clu").setPredictionCol("Cluster")
    named = km.transform(v).withColumn(
        out, C.map_lookup("Cluster", bundle.segment_labels, K.DEFAULT_SEGMENT))
    return named.select(*loaded.columns, "Cluster", out)


def model_probabilities(loaded: DataFrame, bundle: Bundle) -> DataFrame:
    """The three classifiers' probabilities over the loaded table's own
    columns, as the evaluation pages use them: adds p_gb, p_rf, p_lr."""
    return classified(with_features(loaded, bundle.features["clf"]), bundle).select(
        *loaded.columns, "p_gb", "p_rf", "p_lr")


def score_with_models(df: DataFrame, bundle: Bundle, mode: str = "batch") -> DataFrame:
    """``score`` with the models' own outputs (p_gb, p_rf, p_lr, ridge_pred),
    which C7 and C10 show."""
    from loanlens.operators.clean import nan_to_null

    derived = derive(nan_to_null(df), mode)
    v = model_columns(derived, bundle,
                      cluster_score="predicted" if mode == "live" else "input")
    return with_results(v, bundle.segment_labels, mode).drop("cluster")


def with_results(v: DataFrame, segment_labels: dict[int, str], mode: str = "batch") -> DataFrame:
    """The five result columns from the models' outputs (p_gb, p_rf,
    p_lr, ridge_pred, cluster). The batch rounds the score half-even, the live
    form truncates it."""
    ens = C.soft_vote("p_gb", "p_rf", "p_lr")
    clipped = C.clip("ridge_pred", 300.0, 900.0)
    pred = (C.round_half_even(clipped, 0) if mode == "batch" else clipped).cast("int")
    seg = C.map_lookup("cluster", segment_labels, K.DEFAULT_SEGMENT)
    out = v.withColumns({
        "Approval_Probability_%": C.round_half_even(ens * C.dlit(100), 2),
        "Loan_Decision": C.decision(ens),
        "Predicted_CreditScore": pred,
        "Marketing_Segment": seg,
    })
    return out.withColumn("Recommended_Action",
                          C.map_lookup("Marketing_Segment", K.SEGMENT_ACTIONS, K.DEFAULT_ACTION))


def with_votes(scored: DataFrame) -> DataFrame:
    """F20 + C7 beside the result: the predicted score's band (300 is in the
    lowest), and each model's vote at 0.5."""
    votes = {f"vote_{m}": F.when(F.col(f"p_{m}") >= C.dlit(0.5), "Approve").otherwise("Reject") for m in ("gb", "rf", "lr")}
    return scored.withColumns({"Score_Band": C.score_band("Predicted_CreditScore", include_lowest=True)} | votes)


def agreement(scored: DataFrame, key: str = "RespondentID") -> DataFrame:
    """Per model probability and Approve/Reject vote at 0.5."""
    long = scored.selectExpr(key, "stack(3, 'Gradient Boosting', p_gb, 'Random Forest', p_rf, "
                                  "'Logistic Reg', p_lr) AS (model, probability)")
    return long.withColumn("vote", F.when(F.col("probability") >= C.dlit(0.5), "Approve")
                           .otherwise("Reject"))


def regression_predictions(df: DataFrame, bundle: Bundle, key: str = "RespondentID"):
    """Whole-table predictions of both regressors (input to E6/E7)."""
    v = with_features(df, bundle.features["reg"])
    ridge = bundle.models["ridge"].copy()
    ridge.setFeaturesCol("__f_reg").setPredictionCol("ridge_pred")
    rfr = bundle.models["rf_reg"].copy()
    rfr.setFeaturesCol("__f_reg").setPredictionCol("rf_pred")
    out = rfr.transform(ridge.transform(v))
    return out.select(key, F.col("CreditScore").cast("double").alias("actual"),
                      "ridge_pred", "rf_pred",
                      (F.col("CreditScore").cast("double") - F.col("ridge_pred")).alias("residual"))
