"""Registered queries: evaluation on the deterministic scorecard (E1-E7),
segmentation with given centroids (M1, J3, A16-A18, K5, M11) and the
scoring rules on given probabilities (C2-C4, C6, C7).

The "model" here is the scorecard itself: probability = (CreditScore - 300)
/ 600 against LoanApproved, predicted score = clip(900 - 200 RiskScore,
300, 900) against CreditScore. Centroids are the per-marketing-segment
means of the scaled clustering features. Everything is SQL-expressible."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.operators import evaluate, histogram, sample, segments
from loanlens.operators.distribution import fit_line
from loanlens.oracle import LOADED_CTE, D, clip_sql, round_sql, with_customers
from loanlens.plans.catalog_dist import hist_sql_ctes, md5_order
from loanlens.plans.registry import register
from loanlens.sources.customers import customers, load_customers
from loanlens.store import stored_value

R6 = 6
def PROB():  # noqa: N802
    return (F.col("CreditScore") - C.dlit(300)) / C.dlit(600)


PROB_SQL = f"((CreditScore - {D(300)}) / {D(600)})"
def PRED():  # noqa: N802
    return C.clip(C.dlit(900) - F.col("RiskScore") * C.dlit(200), 300.0, 900.0)


PRED_SQL = clip_sql(f"{D(900)} - RiskScore * {D(200)}", D(300), D(900))


def scored(spark, d):
    return customers(spark, d).withColumns({"prob": PROB(), "pred_label": (PROB() >= C.dlit(0.5))
                                            .cast("int"), "pred_score": PRED()})


SCORED_CTE = (f"sc AS (SELECT *, {PROB_SQL} AS prob, CAST(CASE WHEN {PROB_SQL} >= {D(0.5)} "
              f"THEN 1 ELSE 0 END AS INTEGER) AS pred_label, {PRED_SQL} AS pred_score "
              "FROM customers)")

CONF_SQL = ("SELECT count(*) FILTER (WHERE LoanApproved = 0 AND pred_label = 0) AS tn, "
            "count(*) FILTER (WHERE LoanApproved = 0 AND pred_label = 1) AS fp, "
            "count(*) FILTER (WHERE LoanApproved = 1 AND pred_label = 0) AS fn, "
            "count(*) FILTER (WHERE LoanApproved = 1 AND pred_label = 1) AS tp FROM sc")

ROC_CTE = ("rg AS (SELECT CAST(prob AS DOUBLE) AS threshold, "
           "count(*) FILTER (WHERE LoanApproved = 1) AS pos, "
           "count(*) FILTER (WHERE LoanApproved <> 1) AS neg FROM sc "
           "WHERE prob IS NOT NULL AND LoanApproved IS NOT NULL GROUP BY 1),\n"
           "rc AS (SELECT threshold, pos, neg, "
           "CAST(coalesce(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED "
           "PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos_before, "
           "CAST(coalesce(sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED "
           "PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS neg_before FROM rg)")
AUC_SQL = ("(SELECT CAST(sum(neg * (pos_before * 2 + pos)) AS DOUBLE) / "
           "CAST(sum(pos) * sum(neg) * 2 AS DOUBLE) FROM rc)")


def _pct2_sql(x: str) -> str:
    return round_sql(f"{x} * {D(100)}", 2)


# --------------------------------------------------------------- E1 - E5 ---
@register("eval_confusion", with_customers(
    "SELECT tn, fp, fn, tp, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / "
    f"CAST(tp + fp AS DOUBLE) ELSE {D(0)} END AS precision, CASE WHEN tp + fn > 0 THEN "
    f"CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE {D(0)} END AS recall FROM ({CONF_SQL}) "
    "AS __c", SCORED_CTE), digits={"precision": R6, "recall": R6})
def eval_confusion(spark, d):
    """E3 on all rows, as the reference's confusion page."""
    return evaluate.confusion(scored(spark, d), "LoanApproved", "pred_label")


@register("eval_roc_points", with_customers(
    "SELECT threshold, pos, neg, pos_before, neg_before, "
    "CAST(neg_before + neg AS DOUBLE) / CAST((SELECT sum(neg) FROM rg) AS DOUBLE) AS fpr, "
    "CAST(pos_before + pos AS DOUBLE) / CAST((SELECT sum(pos) FROM rg) AS DOUBLE) AS tpr "
    "FROM rc UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0, 0, 0, 0, 0, 0 WHERE EXISTS (SELECT 1 FROM rg)",
    SCORED_CTE + ",\n" + ROC_CTE), digits={"fpr": R6, "tpr": R6})
def eval_roc_points(spark, d):
    """One ROC point per distinct score (ties collapsed), and the start."""
    return evaluate.roc_points(scored(spark, d), "LoanApproved", "prob")


@register("eval_roc_auc", with_customers(f"SELECT {AUC_SQL} AS auc",
                                          SCORED_CTE + ",\n" + ROC_CTE), digits={"auc": 9})
def eval_roc_auc(spark, d):
    """E2."""
    return evaluate.roc_auc(scored(spark, d), "LoanApproved", "prob")


@register("eval_classification", with_customers(
    f"SELECT {_pct2_sql('CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE)')} "
    "AS accuracy, "
    f"{_pct2_sql(f'CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(tp AS DOUBLE) * {D(2)} / CAST(2 * tp + fp + fn AS DOUBLE) ELSE {D(0)} END')} AS f1, "  # noqa: E501
    f"{_pct2_sql(AUC_SQL)} AS roc_auc FROM ({CONF_SQL}) AS __c",
    SCORED_CTE + ",\n" + ROC_CTE))
def eval_classification(spark, d):
    """E1 + E2: accuracy, F1, AUC x100 round 2."""
    return evaluate.classification_metrics(scored(spark, d), "LoanApproved", "prob")


@register("eval_regression", with_customers(
    f"SELECT {round_sql('sqrt(mse)', 2)} AS rmse, "
    f"{_pct2_sql(f'({D(1)} - mse / vy)')} AS r2, {round_sql('mae', 2)} AS mae FROM ("
    "SELECT avg((CAST(CreditScore AS DOUBLE) - pred_score) * (CAST(CreditScore AS DOUBLE) - "
    "pred_score)) AS mse, avg(abs(CAST(CreditScore AS DOUBLE) - pred_score)) AS mae, "
    "var_pop(CAST(CreditScore AS DOUBLE)) AS vy FROM sc WHERE CreditScore IS NOT NULL "
    "AND pred_score IS NOT NULL) AS __m", SCORED_CTE))
def eval_regression(spark, d):
    """E5: RMSE, R^2 %, MAE of the scorecard's score prediction."""
    return evaluate.regression_metrics(scored(spark, d), "CreditScore", "pred_score")


# ------------------------------------------------------------------ E6, E7 --
RES_SQL = ("SELECT RespondentID, CAST(CreditScore AS DOUBLE) AS actual, pred_score AS predicted, "
           "CAST(CreditScore AS DOUBLE) - pred_score AS residual FROM sc")


@register("eval_residuals", with_customers(RES_SQL, SCORED_CTE))
def eval_residuals(spark, d):
    """E6 per-row residual table."""
    return evaluate.residuals(scored(spark, d), "CreditScore", "pred_score")


@register("eval_residual_histogram", with_customers(
    'SELECT bin, bin_lo, bin_hi, "count" FROM h_out',
    SCORED_CTE + ",\n" + hist_sql_ctes(
        f"SELECT residual AS x FROM ({RES_SQL}) AS __r WHERE residual IS NOT NULL", 45, False)),
    digits={"bin_lo": R6, "bin_hi": R6})
def eval_residual_histogram(spark, d):
    """45-bin histogram of the residuals."""
    res = evaluate.residuals(scored(spark, d), "CreditScore", "pred_score")
    return histogram.histogram(res, "residual", 45)


@register("eval_residual_summary", with_customers(
    "SELECT count(residual) AS n, avg(residual) AS mean_residual, "
    "stddev_samp(residual) AS std_residual FROM r", SCORED_CTE + f",\nr AS ({RES_SQL})"),
    digits={"mean_residual": R6, "std_residual": R6})
def eval_residual_summary(spark, d):
    """Residual mean and spread."""
    res = evaluate.residuals(scored(spark, d), "CreditScore", "pred_score")
    return res.agg(F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"),
                   F.stddev_samp("residual").alias("std_residual"))


_AVP_CTE = (SCORED_CTE + ",\nr AS (" + RES_SQL + "),\n"
            "s AS (SELECT * FROM r ORDER BY " + md5_order("RespondentID", 0)
            + ", RespondentID LIMIT 500)")


@register("eval_actual_vs_predicted", with_customers("SELECT * FROM s", _AVP_CTE))
def eval_actual_vs_predicted(spark, d):
    """The 500-row actual-vs-predicted (and residual-vs-fitted) sample."""
    res = evaluate.residuals(scored(spark, d), "CreditScore", "pred_score")
    return sample.sample_n(res, 500, seed=0)


@register("eval_trend_line", with_customers(
    "SELECT count(*) AS n, regr_slope(predicted, actual) AS slope, "
    "regr_intercept(predicted, actual) AS intercept, covar_pop(actual, predicted) / "
    "(stddev_pop(actual) * stddev_pop(predicted)) AS r FROM s "
    "WHERE actual IS NOT NULL AND predicted IS NOT NULL", _AVP_CTE),
    digits={"slope": R6, "intercept": R6, "r": R6})
def eval_trend_line(spark, d):
    """E7 trend line (A25 on the sample)."""
    res = evaluate.residuals(scored(spark, d), "CreditScore", "pred_score")
    return fit_line(sample.sample_n(res, 500, seed=0), "actual", "predicted")


# ------------------------------------------------------------ segmentation --
CLU = [c for c in K.CLU_FEATURES if c in K.CUSTOMER_COLUMNS]
_ORDERED_SEGMENTS = sorted({"Prime", "Emerging", "AtRisk"})


def segmented(spark, d):
    """Scaled clustering features -> per-segment centroids (k rows) ->
    nearest-centroid cluster id for every row: a projection. Scaler and
    centroids are found once for the input's content."""
    base = load_customers(spark, d)
    zc = [f"z_{c}" for c in CLU]

    def fit():
        scaler = segments.fit_scaler(base.na.fill(0.0, subset=CLU), CLU)
        z = segments.standard_scale(base, CLU, stats=scaler, keep=["MarketingSegment"], prefix="z_")
        cents = segments.centroids_by(z, zc, "MarketingSegment").collect()
        return scaler, [[r[c] for c in zc] for r in cents]

    scaler, centers = stored_value("segment_centres", spark, d, fit)
    z = segments.standard_scale(base, CLU, stats=scaler, keep=base.columns, prefix="z_")
    return segments.assign(z, zc, centers)


def _segmented_ctes() -> str:
    st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                   for c in CLU)
    zs = ", ".join(f"(CAST(coalesce({c}, 0) AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = {D(0)} "
                   f"THEN {D(1)} ELSE s_{c} END AS z_{c}" for c in CLU)
    cents = ", ".join(f"max(CASE WHEN MarketingSegment = '{s}' THEN a_{c} END) AS c{k}_{c}"
                      for k, s in enumerate(_ORDERED_SEGMENTS) for c in CLU)
    avgs = ", ".join(f"avg(z_{c}) AS a_{c}" for c in CLU)
    dists = ", ".join(
        " + ".join(f"(z_{c} - c{k}_{c}) * (z_{c} - c{k}_{c})" for c in CLU) + f" AS d{k}"
        for k in range(len(_ORDERED_SEGMENTS)))
    n = len(_ORDERED_SEGMENTS)
    case = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"d{i} <= d{j}" for j in range(i + 1, n)) + f" THEN {i}"
        for i in range(n - 1)) + f" ELSE {n - 1} END"
    return (LOADED_CTE + ",\n"
            f"zst AS (SELECT {st} FROM (SELECT {', '.join(f'coalesce({c}, 0) AS {c}' for c in CLU)}"
            " FROM loaded) AS __f),\n"
            f"zl AS (SELECT loaded.*, {zs} FROM loaded, zst),\n"
            f"zc AS (SELECT MarketingSegment, {avgs} FROM zl GROUP BY MarketingSegment),\n"
            f"zcw AS (SELECT {cents} FROM zc),\n"
            f"zd AS (SELECT zl.*, {dists} FROM zl, zcw),\n"
            f"seg AS (SELECT *, CAST({case} AS INTEGER) AS Cluster FROM zd)")


SEG_CTES = _segmented_ctes()


@register("segment_assignment", with_customers(
    "SELECT RespondentID, MarketingSegment, Cluster FROM seg", SEG_CTES))
def segment_assignment(spark, d):
    """M1 + J3: every customer's nearest segment centroid."""
    return segmented(spark, d).select("RespondentID", "MarketingSegment", "Cluster")


def _profile_sql():
    cols = ", ".join(f"{round_sql(f'avg({c})', 2)} AS {c}" for c in [*CLU, "LoanApproved"])
    return (f"SELECT Cluster, {cols}, {round_sql('avg(CreditScore)', 2)} AS AvgCreditScore "
            "FROM seg GROUP BY Cluster")


@register("cluster_profile", with_customers(_profile_sql(), SEG_CTES))
def cluster_profile(spark, d):
    """A17 (+ LoanApproved, as the batch trainer stores it)."""
    return segments.cluster_profile(segmented(spark, d), CLU, extra=["LoanApproved"])


@register("cluster_sizes", with_customers(
    "SELECT Cluster, count(*) AS n FROM seg GROUP BY Cluster", SEG_CTES))
def cluster_sizes(spark, d):
    """A18."""
    return segments.cluster_sizes(segmented(spark, d))


_NAMES_CASE = "CASE rank " + " ".join(
    f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(K.CLUSTER_NAMES)) + " END"


@register("cluster_names", with_customers(
    f"SELECT Cluster, CAST(rank AS INTEGER) AS rank, {_NAMES_CASE} AS label FROM ("
    "SELECT Cluster, row_number() OVER (ORDER BY AvgCreditScore DESC, Cluster) AS rank FROM ("
    f"SELECT Cluster, {round_sql('avg(CreditScore)', 2)} AS AvgCreditScore FROM seg "
    "GROUP BY Cluster) AS __p) AS __r", SEG_CTES))
def cluster_names(spark, d):
    """K5 + M11: name clusters by mean score."""
    prof = segments.cluster_profile(segmented(spark, d), CLU)
    return segments.name_clusters(prof)


def _named_sql_ctes():
    return (SEG_CTES + ",\n"
            f"nm AS (SELECT Cluster, {_NAMES_CASE} AS label FROM ("
            "SELECT Cluster, row_number() OVER (ORDER BY AvgCreditScore DESC, Cluster) AS rank "
            f"FROM (SELECT Cluster, {round_sql('avg(CreditScore)', 2)} AS AvgCreditScore "
            "FROM seg GROUP BY Cluster) AS __p) AS __r),\n"
            "lab AS (SELECT seg.*, coalesce(nm.label, 'Emerging') AS Cluster_Label "
            "FROM seg LEFT JOIN nm USING (Cluster))")


def labelled(spark, d):
    seg = segmented(spark, d)
    names = segments.name_clusters(segments.cluster_profile(seg, CLU))
    return segments.label_segments(seg, names)


@register("segment_labels", with_customers(
    "SELECT RespondentID, Cluster, Cluster_Label FROM lab", _named_sql_ctes()))
def segment_labels(spark, d):
    """Cluster -> segment name for every customer."""
    return labelled(spark, d).select("RespondentID", "Cluster", "Cluster_Label")


def _seg_profile_sql():
    r2 = lambda x: round_sql(x, 2)
    order = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(K.CLUSTER_NAMES + ["AtRisk"]))
    metrics = ", ".join(f"{r2(f'avg({m})')} AS {m}" for m in K.PROFILE_METRICS
                        if m in K.CUSTOMER_COLUMNS)
    return (f"SELECT Cluster_Label, {metrics}, "
            f"{round_sql(f'avg(CAST(LoanApproved AS DOUBLE)) * {D(100)}', 1)} AS Approval_pct, "
            f"count(*) AS n, CAST(CASE Cluster_Label {order} ELSE 99 END AS INTEGER) AS seg_order "
            "FROM lab GROUP BY Cluster_Label")


@register("cluster_segment_profile", with_customers(_seg_profile_sql(), _named_sql_ctes()))
def cluster_segment_profile(spark, d):
    """A16 on the cluster segments."""
    from loanlens.operators.stats import segment_profile
    return segment_profile(labelled(spark, d), label="Cluster_Label")


# ------------------------------------------------- scoring rules (C2-C7) ----
def given_probabilities(spark, d):
    """Three deterministic stand-in model probabilities per customer."""
    df = customers(spark, d)
    return df.select(
        "RespondentID", "MarketingSegment", "RiskScore",
        F.col("ApprovalProbability").alias("p_gb"), PROB().alias("p_rf"),
        C.clip(C.dlit(1) - F.col("RiskScore") / C.dlit(3), 0.0, 1.0).alias("p_lr"))


GIVEN_CTE = ("gp AS (SELECT RespondentID, MarketingSegment, RiskScore, ApprovalProbability AS p_gb, "
             f"{PROB_SQL} AS p_rf, "
             f"{clip_sql(f'{D(1)} - RiskScore / {D(3)}', D(0), D(1))} AS p_lr FROM customers)")


@register("decision_rules", with_customers(
    "SELECT RespondentID, "
    f"{round_sql(f'ens * {D(100)}', 2)} AS Approval_Probability_pct, "
    f"CASE WHEN ens >= {D(0.6)} THEN 'Approved' WHEN ens >= {D(0.4)} THEN 'Borderline' "
    "ELSE 'Rejected' END AS Loan_Decision, "
    f"CAST(round_even({clip_sql(f'{D(900)} - RiskScore * {D(200)}', D(300), D(900))}, 0) "
    "AS INTEGER) AS Predicted_CreditScore, "
    f"CAST(trunc({clip_sql(f'{D(900)} - RiskScore * {D(200)}', D(300), D(900))}) AS INTEGER) "
    "AS Predicted_CreditScore_live, segment AS Marketing_Segment, "
    "coalesce(CASE segment " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in K.SEGMENT_ACTIONS.items())
    + f" END, '{K.DEFAULT_ACTION}') AS Recommended_Action FROM ("
    f"SELECT *, p_gb * {D(0.5)} + p_rf * {D(0.3)} + p_lr * {D(0.2)} AS ens, "
    "CASE WHEN MarketingSegment = 'AtRisk' THEN 'At-Risk' ELSE MarketingSegment END AS segment "
    "FROM gp) AS __e", GIVEN_CTE))
def decision_rules(spark, d):
    """C2 soft vote, C3 decision, C4 score (batch: half-even; live: truncated),
    C6 action lookup (segment spelling normalised)."""
    g = given_probabilities(spark, d)
    ens = C.soft_vote("p_gb", "p_rf", "p_lr")
    pred = C.clip(C.dlit(900) - F.col("RiskScore") * C.dlit(200), 300.0, 900.0)
    seg = F.when(F.col("MarketingSegment") == "AtRisk", F.lit("At-Risk")) \
        .otherwise(F.col("MarketingSegment"))
    out = g.select(
        "RespondentID",
        C.round_half_up(ens * C.dlit(100), 2).alias("Approval_Probability_pct"),
        C.decision(ens).alias("Loan_Decision"),
        C.round_half_even(pred, 0).cast("int").alias("Predicted_CreditScore"),
        pred.cast("int").alias("Predicted_CreditScore_live"),
        seg.alias("Marketing_Segment"))
    return segments.recommend(out)


@register("model_agreement", with_customers(
    " UNION ALL ".join(
        f"SELECT RespondentID, '{m}' AS model, {col} AS probability, "
        f"CASE WHEN {col} >= {D(0.5)} THEN 'Approve' ELSE 'Reject' END AS vote FROM gp"
        for m, col in [("Gradient Boosting", "p_gb"), ("Random Forest", "p_rf"),
                       ("Logistic Reg", "p_lr")]), GIVEN_CTE))
def model_agreement(spark, d):
    """Per model probability and Approve/Reject vote at 0.5."""
    g = given_probabilities(spark, d)
    long = g.selectExpr("RespondentID", "stack(3, 'Gradient Boosting', p_gb, "
                        "'Random Forest', p_rf, 'Logistic Reg', p_lr) AS (model, probability)")
    return long.withColumn("vote", F.when(F.col("probability") >= C.dlit(0.5), "Approve")
                           .otherwise("Reject"))
