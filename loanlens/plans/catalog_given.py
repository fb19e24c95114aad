"""Registered queries over given model outputs, so that SQL can check what
follows the models: the comparison table (E8), the whole batch and live result
(C8, C9), and segments by fitted centroids (T3, J3, M8's step)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.functions.derive import derive
from loanlens.operators import evaluate, segments
from loanlens.oracle import D, bands_sql, clip_sql, round_sql, with_customers, with_profiles
from loanlens.plans.catalog_eval import CLU, PRED, PRED_SQL, PROB, PROB_SQL, SEG_CTES, segmented
from loanlens.plans.catalog_stats import derived_columns_sql
from loanlens.plans.registry import register
from loanlens.plans.score import LIVE_COLUMNS, RESULT_COLUMNS, with_results, with_votes
from loanlens.sources.customers import customers
from loanlens.sources.fixtures import profiles
from loanlens.store import stored_value

# ------------------------------------------------------------------- E8 ---
#: Given classifiers: a probability column, and the same in SQL.
GIVEN_CLASSIFIERS = {
    "gradient_boosting": (lambda: F.col("ApprovalProbability"), "ApprovalProbability"),
    "random_forest": (PROB, PROB_SQL),
    "logistic_regression": (lambda: C.clip(C.dlit(1) - F.col("RiskScore") / C.dlit(3), 0.0, 1.0),
                            clip_sql(f"{D(1)} - RiskScore / {D(3)}", D(0), D(1))),
}
GIVEN_REGRESSORS = {
    "ridge": (PRED, PRED_SQL),
    "random_forest_regressor": (lambda: C.clip(C.dlit(820) - F.col("RiskScore") * C.dlit(150), 300.0, 900.0),
                                clip_sql(f"{D(820)} - RiskScore * {D(150)}", D(300), D(900))),
}


def _comparison_sql() -> str:
    ctes, rows = [], []
    pct = lambda x: round_sql(f"{x} * {D(100)}", 2)
    for k, (name, (_, p)) in enumerate(GIVEN_CLASSIFIERS.items()):
        ctes.append(f"""m{k} AS (SELECT LoanApproved AS y, {p} AS p FROM customers),
f{k} AS (SELECT count(*) FILTER (WHERE y = 0 AND p < {D(0.5)}) AS tn, count(*) FILTER (WHERE y = 0 AND p >= {D(0.5)}) AS fp,
         count(*) FILTER (WHERE y = 1 AND p < {D(0.5)}) AS fn, count(*) FILTER (WHERE y = 1 AND p >= {D(0.5)}) AS tp FROM m{k}),
g{k} AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM m{k}
         WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY p),
w{k} AS (SELECT pos, neg, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS above FROM g{k}),
a{k} AS (SELECT CAST(sum(neg * (above * 2 + pos)) AS DOUBLE) / CAST(sum(pos) * sum(neg) * 2 AS DOUBLE) AS auc FROM w{k})""")
        f1 = f"CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(tp AS DOUBLE) * {D(2)} / CAST(2 * tp + fp + fn AS DOUBLE) ELSE {D(0)} END"
        rows.append(f"SELECT '{name}' AS model, 'classification' AS task, "
                    f"{pct('CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE)')} AS accuracy, "
                    f"{pct('auc')} AS roc_auc, {pct(f'({f1})')} AS f1, CAST(NULL AS DOUBLE) AS r2, "
                    f"CAST(NULL AS DOUBLE) AS rmse, CAST(NULL AS DOUBLE) AS mae FROM f{k}, a{k}")
    for k, (name, (_, p)) in enumerate(GIVEN_REGRESSORS.items()):
        ctes.append(f"""e{k} AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS vy
         FROM (SELECT CAST(CreditScore AS DOUBLE) AS y, {p} AS p FROM customers) AS __y
         WHERE y IS NOT NULL AND p IS NOT NULL)""")
        rows.append(f"SELECT '{name}', 'regression', NULL, NULL, NULL, {pct(f'({D(1)} - mse / vy)')}, "
                    f"{round_sql('sqrt(mse)', 2)}, {round_sql('mae', 2)} FROM e{k}")
    return with_customers(" UNION ALL ".join(rows), ",\n".join(ctes))


@register("model_comparison_given", _comparison_sql())
def model_comparison_given(spark, d):
    """The comparison table of given models, one row per model."""
    df, rows = customers(spark, d), None
    for task, given, metrics in (
            ("classification", GIVEN_CLASSIFIERS, lambda s: evaluate.classification_metrics(s, "LoanApproved", "p")),
            ("regression", GIVEN_REGRESSORS, lambda s: evaluate.regression_metrics(s, "CreditScore", "p"))):
        for name, (p, _) in given.items():
            m = metrics(df.withColumn("p", p()))
            long = m.unpivot([], m.columns, "metric", "value").select(
                F.lit(name).alias("model"), F.lit(task).alias("task"), "metric", "value")
            rows = long if rows is None else rows.unionByName(long)
    return evaluate.comparison_table(rows)


# --------------------------------------------------------------- C8, C9 ---
#: Cluster 3 has no name: it gets the default segment.
GIVEN_LABELS = {0: "Prime", 1: "At-Risk", 2: "Rebuilder"}


def _given_outputs(derived):
    """Model outputs as functions of derived features."""
    risk = F.col("RiskScore")
    return derived.withColumns({
        "p_gb": C.clip(C.dlit(1) - risk / C.dlit(2), 0.0, 1.0),
        "p_rf": C.clip(F.col("SavingsToDebt"), 0.0, 1.0),
        "p_lr": C.clip(C.dlit(1) - F.col("EMI_to_Income"), 0.0, 1.0),
        "ridge_pred": C.dlit(880.25) - risk * C.dlit(260),
        "cluster": (F.col("NumDependents") % 4).cast("int")})


def _results_sql(mode: str) -> str:
    ens = f"(p_gb * {D(0.5)} + p_rf * {D(0.3)} + p_lr * {D(0.2)})"
    pred = clip_sql("ridge_pred", D(300), D(900))
    score = f"CAST({f'round_even({pred}, 0)' if mode == 'batch' else f'trunc({pred})'} AS INTEGER)"
    segment = "CASE cluster " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in GIVEN_LABELS.items()) \
        + f" ELSE '{K.DEFAULT_SEGMENT}' END"
    action = "coalesce(CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SEGMENT_ACTIONS.items()) \
        + f" END, '{K.DEFAULT_ACTION}')"
    derived = derived_columns_sql(mode)
    cte = (f"dv AS (SELECT RespondentID, RepaymentHistory_Ord, NumDependents, "
           + ", ".join(f"{v} AS {k}" for k, v in derived.items()) + " FROM profiles),\n"
           f"gv AS (SELECT *, {clip_sql(f'{D(1)} - RiskScore / {D(2)}', D(0), D(1))} AS p_gb, "
           f"{clip_sql('SavingsToDebt', D(0), D(1))} AS p_rf, "
           f"{clip_sql(f'{D(1)} - EMI_to_Income', D(0), D(1))} AS p_lr, "
           f"{D(880.25)} - RiskScore * {D(260)} AS ridge_pred, NumDependents % 4 AS cluster FROM dv),\n"
           f"rv AS (SELECT *, {ens} AS ens, {score} AS pred, {segment} AS segment FROM gv)")
    out = ("RespondentID, RepaymentHistory_Ord, " + ", ".join(derived) + ", "
           f'round_even(ens * {D(100)}, 2) AS "Approval_Probability_%", '
           f"CASE WHEN ens >= {D(0.6)} THEN 'Approved' WHEN ens >= {D(0.4)} THEN 'Borderline' ELSE 'Rejected' END "
           f"AS Loan_Decision, pred AS Predicted_CreditScore, segment AS Marketing_Segment, {action} AS Recommended_Action")
    if mode == "live":
        out += (", " + bands_sql("pred", K.SCORE_BAND_EDGES, K.SCORE_BAND_LABELS, True) + " AS Score_Band, "
                + ", ".join(f"p_{m}, CASE WHEN p_{m} >= {D(0.5)} THEN 'Approve' ELSE 'Reject' END AS vote_{m}"
                            for m in ("gb", "rf", "lr")))
    return with_profiles(f"SELECT {out} FROM rv", cte)


def _results(mode: str):
    def run(spark, d):
        given = _given_outputs(derive(profiles(spark, d).drop("MonthlyEMI_INR"), mode))
        out = with_results(given, GIVEN_LABELS, mode)
        more = RESULT_COLUMNS
        if mode == "live":
            out, more = with_votes(out), LIVE_COLUMNS
        return out.select("RespondentID", "RepaymentHistory_Ord", *derived_columns_sql(mode), *more)
    return run


for _mode, _name in (("batch", "batch_scores_given"), ("live", "live_scores_given")):
    register(_name, _results_sql(_mode))(_results(_mode))


# --------------------------------------------------------------- T3, J3 ---
_Z = [f"z_{c}" for c in CLU]


def fitted_centers(spark, d) -> list[list[float]]:
    """Centroids after one Lloyd step from the segments' means (k rows)."""
    def fit():
        means = segments.centroids_by(segmented(spark, d), _Z, "Cluster").collect()
        return [[r[z] for z in _Z] for r in means]
    return stored_value("fitted_centres", spark, d, fit)


def _fitted_sql(body: str) -> str:
    k = 3  # Prime, Emerging, AtRisk
    avgs = ", ".join(f"avg({z}) FILTER (WHERE Cluster = {j}) AS f{j}_{z}" for j in range(k) for z in _Z)
    dists = ", ".join(" + ".join(f"({z} - f{j}_{z}) * ({z} - f{j}_{z})" for z in _Z) + f" AS e{j}" for j in range(k))
    case = (f"CASE WHEN e0 <= e1 AND e0 <= e2 THEN 0 WHEN e1 <= e2 THEN 1 ELSE 2 END")
    return with_customers(body, SEG_CTES + ",\n"
                          f"fc AS (SELECT {avgs} FROM seg),\n"
                          f"fd AS (SELECT seg.*, {dists} FROM seg, fc),\n"
                          f"fit AS (SELECT * REPLACE (CAST({case} AS INTEGER) AS Cluster) FROM fd)")


def fitted(spark, d):
    z = segmented(spark, d).drop("Cluster")
    return segments.assign(z, _Z, fitted_centers(spark, d))


@register("fitted_assignment", _fitted_sql("SELECT RespondentID, MarketingSegment, Cluster FROM fit"))
def fitted_assignment(spark, d):
    """T3 + J3: every customer's nearest fitted centroid."""
    return fitted(spark, d).select("RespondentID", "MarketingSegment", "Cluster")


@register("fitted_sizes", _fitted_sql("SELECT Cluster, count(*) AS n FROM fit GROUP BY Cluster"))
def fitted_sizes(spark, d):
    """A18 over the fitted centroids."""
    return segments.cluster_sizes(fitted(spark, d))
