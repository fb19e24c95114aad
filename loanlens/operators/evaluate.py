"""Model evaluation on any ``(label, score)`` table.

Counts are single aggregates; the ROC curve collapses ties by grouping on
the score and takes running sums with the distributed cumulative recipe
(§4.3), so no step orders all rows in one task. AUC is the trapezoid sum
over those points, computed as one integer sum divided once (equal to the
Mann-Whitney statistic with ties counted half)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import columns as C
from loanlens.operators.quantiles import cumulative_before


def _pct2(c) -> F.Column:
    return C.round_half_up(c * C.dlit(100), 2)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Tn, fp, fn, tp, precision and recall (0 when undefined)."""
    y, p = F.col(label), F.col(pred)
    out = df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"),
                 F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"),
                 F.count_if((y == 1) & (p == 1)).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("tn", "fp", "fn", "tp",
                      F.when(tp + fp > 0, tp.cast("double") / (tp + fp).cast("double"))
                      .otherwise(C.dlit(0)).alias("precision"),
                      F.when(tp + fn > 0, tp.cast("double") / (tp + fn).cast("double"))
                      .otherwise(C.dlit(0)).alias("recall"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, pos, neg, pos_before, neg_before, fpr, tpr)`` for
    every distinct score, descending; ties collapsed into one point. Before them
    the curve's start (0, 0), above every score: its threshold is infinite."""
    g = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(F.col(score).cast("double").alias("threshold"))
         .agg(F.count_if(F.col(label) == 1).alias("pos"),
              F.count_if(F.col(label) != 1).alias("neg")))
    cum = cumulative_before(g, [], [F.col("threshold").desc()], weight=["pos", "neg"],
                            out=["pos_before", "neg_before"])
    totals = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = totals.select("P").scalar(), totals.select("N").scalar()
    zero = F.lit(0).cast("long")
    start = totals.where("P IS NOT NULL").select(
        F.lit(float("inf")).alias("threshold"), *[zero.alias(c) for c in ("pos", "neg", "pos_before", "neg_before")])
    return cum.select(*start.columns).unionByName(start).select(
        "threshold", "pos", "neg", "pos_before", "neg_before",
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), N.cast("double"))
        .alias("fpr"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), P.cast("double"))
        .alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve (null when a class is absent)."""
    pts = roc_points(df, label, score)
    return pts.agg(
        F.try_divide(
            F.sum(F.col("neg") * (F.col("pos_before") * 2 + F.col("pos"))).cast("double"),
            (F.sum("pos") * F.sum("neg") * 2).cast("double")).alias("auc"))


def classification_metrics(df: DataFrame, label: str, prob: str,
                           threshold: float = 0.5) -> DataFrame:
    """E1 + E2: accuracy, F1 of the positive class and ROC AUC, x100 round 2."""
    pred = (F.col(prob) >= C.dlit(threshold)).cast("int")
    cm = confusion(df.withColumn("__pred", pred), label, "__pred")
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    base = cm.select(
        _pct2((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        _pct2(F.when(tp * 2 + fp + fn > 0, tp * 2 / (tp * 2 + fp + fn)).otherwise(C.dlit(0)))
        .alias("f1"))
    auc = roc_auc(df, label, prob).select("auc").scalar()
    return base.select("accuracy", "f1", _pct2(auc).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """E5: RMSE, R^2 x100 and MAE (round 2) in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    both = df.where(y.isNotNull() & p.isNotNull())
    m = both.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.var_pop(y).alias("vy"))
    return m.select(C.round_half_up(F.sqrt("mse"), 2).alias("rmse"),
                    _pct2(C.dlit(1) - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"),
                    C.round_half_up(F.col("mae"), 2).alias("mae"))


def residuals(df: DataFrame, label: str, pred: str, key: str = "RespondentID") -> DataFrame:
    """Per-row actual, predicted and residual (actual - predicted)."""
    return df.select(key, F.col(label).cast("double").alias("actual"),
                     F.col(pred).cast("double").alias("predicted"),
                     (F.col(label).cast("double") - F.col(pred).cast("double")).alias("residual"))


def comparison_table(metrics: DataFrame) -> DataFrame:
    """Long metrics ``(model, task, metric, value)`` pivoted to one row
    per model (the metric names are a fixed, small set)."""
    names = ["accuracy", "roc_auc", "f1", "r2", "rmse", "mae"]
    return metrics.groupBy("model", "task").pivot("metric", names).agg(F.first("value"))
