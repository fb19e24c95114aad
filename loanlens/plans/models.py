"""Model training with Spark ML (M1-M13) and the training job.

Parity settings with the reference library (SURVEY §2.7):
* scaling uses the population std (M1), fitted on the training rows, or on
  all rows before the split like the reference (``scaler_fit="all"``);
* logistic regression: L2 with C = 1 and balanced class weights is
  regParam = 1/n_train with weights n/(2 n_class), no internal standardisation;
* ridge alpha: Spark scales the label, so regParam = alpha * std(y) / n;
* forest regressor considers all features per split (the reference default);
* K-Means has no multi-start in Spark: several seeds, least cost wins (the
  elbow table fits each k the same way).

Every fit reads one cached, assembled feature table; the iterative fits run
as Spark jobs (treeAggregate) over it. Trees will not equal the reference
bit for bit (histogram splits, maxBins=32).
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier,
                                       LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.functions import columns as C
from loanlens.functions.derive import prep_features
from loanlens.operators import segments
from loanlens.operators.evaluate import classification_metrics, regression_metrics
from loanlens.operators.sample import split
from loanlens.session import file_system, materialize, same_session
from loanlens.store import content_version

PRESETS = {
    # the batch trainer
    "full": dict(rf_trees=200, rf_depth=12, gb_rounds=150, rfr_trees=200, rfr_depth=12,
                 km_starts=15),
    # the dashboard's first-launch path
    "fast": dict(rf_trees=120, rf_depth=10, gb_rounds=100, rfr_trees=100, rfr_depth=10,
                 km_starts=10),
    # unit tests only: small ensembles so the suite stays quick
    "test": dict(rf_trees=10, rf_depth=5, gb_rounds=5, rfr_trees=10, rfr_depth=5,
                 km_starts=2),
}
SEED = 42
KMEANS_ITERATIONS = 300
LLOYD_ROWS = 1_024  # rows whose distances to all centres are held at once
START_WORKERS = 4  # starts whose first centres Spark seeks at a time
FOREST_ROWS = 1_024  # rows a task of the forest regressor's passes has at least, ...
FOREST_ROWS_MOST = 1 << 20  # ... and at most
FOREST_MB = 64  # room for a pass's sums by node in a task: more falls out of the processor's caches
CLASSIFIERS, REGRESSORS = ("lr", "rf_clf", "gb_clf"), ("ridge", "rf_reg")
SUPERVISED = CLASSIFIERS + REGRESSORS
#: What can be trained on its own; each has a sentinel in the artifact folder.
PARTS = (*SUPERVISED, "kmeans", "elbow")
VERSION = "5"  # bumped when training output changes; old artifacts are not reused


def present(df: DataFrame, cols) -> list[str]:
    """P1 on a feature list: keep the names the table has (model order kept)."""
    return [c for c in cols if c in df.columns]


def feature_pipeline(features: list[str], stats: dict, out: str = "features") -> PipelineModel:
    """P2 + M1 + vector as persistable stages: null and NaN -> 0, scaling by
    the given means and population deviations (a zero deviation scales by 1;
    Spark's own scaler has the sample deviation and makes such a column 0), one
    dense vector column ``out``."""
    def scaled(c: str) -> str:
        mean, std = float(stats[f"mean_{c}"]), float(stats[f"std_{c}"] or 1.0)
        x = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), 0.0D)"
        return f"({x} - ({mean!r}D)) / ({std!r}D) AS `{out}__{c}`"

    scaler = SQLTransformer(statement=f"SELECT *, {', '.join(map(scaled, features))} FROM __THIS__")
    vector = VectorAssembler(inputCols=[f"{out}__{c}" for c in features], outputCol=out)
    return PipelineModel([scaler, vector])


def with_features(df: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """``df`` and the pipeline's vector; a feature that the table has not is 0."""
    vector = pipeline.stages[-1]
    names = [c.removeprefix(vector.getOutputCol() + "__") for c in vector.getInputCols()]
    absent = {c: F.lit(0.0) for c in names if c not in df.columns}
    held = df.withColumns(absent) if absent else df
    return pipeline.transform(held).select(*df.columns, vector.getOutputCol())


def assemble(df: DataFrame, features: list[str], stats: dict, keep=(), out="features"):
    """The feature pipeline's vector beside the columns to ``keep``."""
    return with_features(df, feature_pipeline(features, stats, out)) \
        .select(*[k for k in keep if k not in features], out)


def positive_probability(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


@dataclass
class Bundle:
    """Everything the reference pickles: models, scalers, feature lists,
    metrics, segment labels and the cluster profile."""
    clf_features: list[str]
    reg_features: list[str]
    clu_features: list[str]
    scalers: dict[str, dict]
    models: dict[str, object]
    metrics: DataFrame | None = None
    segment_labels: dict[int, str] = field(default_factory=dict)
    cluster_profile: DataFrame | None = None
    inertias: list[tuple[int, float]] = field(default_factory=list)
    #: Customers of each cluster at training.
    cluster_sizes: dict[int, int] = field(default_factory=dict)
    elbow_centers: dict[int, list[list[float]]] = field(default_factory=dict)
    #: Feature stages (scaler and assembler) of the three tasks.
    features: dict[str, PipelineModel] = field(default_factory=dict)

    def __post_init__(self):
        lists = {"clf": self.clf_features, "reg": self.reg_features, "clu": self.clu_features}
        for task, names in lists.items():
            self.features.setdefault(task, feature_pipeline(names, self.scalers[task], f"__f_{task}"))


def balanced_weights(df: DataFrame, label: str, fit_on: DataFrame | None = None,
                     out: str = "w") -> DataFrame:
    """sklearn ``class_weight="balanced"``: n / (n_classes * n_c), the class
    counts of ``fit_on`` (the training rows) read once (two numbers)."""
    fit_on = df if fit_on is None else fit_on
    counts = {r[label]: r["n"] for r in fit_on.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .collect()}
    n, k = sum(counts.values()), len(counts)
    w = F.lit(None).cast("double")
    expr = None
    for c, m in counts.items():
        expr = (F.when(F.col(label) == c, C.dlit(n / (k * m))) if expr is None
                else expr.when(F.col(label) == c, C.dlit(n / (k * m))))
    return df.withColumn(out, expr if expr is not None else w)


def _parallel(fns, workers: int = 4):
    """Run independent fits as concurrent Spark jobs from driver threads
    (each fit is itself distributed; small fits then share the executors
    instead of queueing)."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(fns)))) as pool:
        return list(pool.map(lambda f: f(), fns))


def spark_kmeans_tol(vecs: DataFrame, rel_tol: float = 1e-4):
    """Spark's K-Means stops when *every* centre moved at most ``tol``; the
    reference library stops when the *summed* squared shift is at most
    ``rel_tol`` x the mean feature variance. A per-centre bound of
    sqrt(rel_tol * mean_var / k) implies the reference's rule. Returns the bound
    by k (one small aggregate over the cached vectors)."""
    from pyspark.ml.stat import Summarizer
    row = vecs.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    n = row["count"]
    mean_var = float(row["variance"].toArray().mean()) * (n - 1) / n if n > 1 else 0.0
    return lambda k: max(math.sqrt(rel_tol * mean_var / k), 1e-12)


def _kmeans(vecs: DataFrame, k: int, seed: int, tol: float):
    # Of the vectors alone: Spark then keeps them as its passes need them, and
    # does not read the cached table again in every pass.
    m = KMeans(k=k, seed=seed, featuresCol="features", maxIter=KMEANS_ITERATIONS, tol=tol).fit(vecs.select("features"))
    return m, m.summary.trainingCost


def kmeans_runs(vecs: DataFrame, starts: Sequence[tuple[int, int]]) -> list[tuple[int, float, np.ndarray]]:
    """(k, cost, centres) of each start (k, seed): Spark's own initial centres,
    then Lloyd iterations of all starts together, so that an iteration reads the
    vectors once. A centre without rows stays, a start ends when each of its centres
    moved at most its bound, and its cost is that of its last iteration, all as in
    Spark's K-Means. Tasks return sums by centre; no row leaves them."""
    tol, alone = spark_kmeans_tol(vecs), vecs.select("features")
    # Each keeps the vectors while it runs, so few run at a time.
    first = _parallel([lambda k=k, s=s: KMeans(k=k, seed=s, featuresCol="features", maxIter=0, solver="row").fit(alone)
                       for k, s in starts], workers=START_WORKERS)
    x = vecs.select(vector_to_array("features").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return lloyd_runs(x, starts, [np.array(m.clusterCenters()) for m in first], tol)
    finally:
        x.unpersist()


def lloyd_runs(x: DataFrame, starts: Sequence[tuple[int, int]], centers: list[np.ndarray],
               tol: Callable[[int], float]) -> list[tuple[int, float, np.ndarray]]:
    """(k, cost, centres) of each start from its first centres, over the cached
    rows ``x`` (array column): a pass decodes no vectors."""
    costs, going = [0.0] * len(starts), list(range(len(starts)))
    for _ in range(KMEANS_ITERATIONS):
        if not going:
            break
        sums = {(r["run"], r["center"]): r for r in lloyd_sums(x, {i: centers[i] for i in going}).collect()}
        moved = []
        for i in going:
            new = centers[i].copy()
            for j in range(len(new)):
                if (i, j) in sums:
                    new[j] = np.array(sums[i, j]["sums"]) / sums[i, j]["n"]
            costs[i] = sum(sums[i, j]["cost"] for j in range(len(new)) if (i, j) in sums)
            if (((new - centers[i]) ** 2).sum(1) > tol(starts[i][0]) ** 2).any():
                moved.append(i)
            centers[i] = new
        going = moved
    return [(k, costs[i], centers[i]) for i, (k, _) in enumerate(starts)]


def lloyd_sums(x: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """run, center, n, cost, sums: number, summed squared distance and sum of the
    rows (``x``: array column) nearest to each run's centres that have any; the
    first of equally near ones. Summed in the tasks, then over them."""
    table, d = np.concatenate(list(centers.values())), len(next(iter(centers.values()))[0])
    cuts = np.cumsum([0, *map(len, centers.values())])
    runs, norms = list(centers), (table * table).sum(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(len(table), np.int64), np.zeros(len(table)), np.zeros((len(table), d))
        for batch in it:
            for at in range(0, batch.num_rows, LLOYD_ROWS):
                rows = batch.column(0).slice(at, LLOYD_ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                far = table @ rows.T  # centres by rows: a run's centres lie one behind the other
                far *= -2
                far += norms[:, None]
                own, near = (rows * rows).sum(1), np.empty(far.shape, bool)
                for a, b in zip(cuts, cuts[1:]):
                    low = far[a:b].min(0)
                    np.equal(far[a:b], low, out=near[a:b])
                    if np.count_nonzero(near[a:b]) > len(rows):  # equally near centres
                        near[a:b] = np.arange(b - a)[:, None] == far[a:b].argmin(0)
                    low += own
                    far[a:b] = np.maximum(low, 0, out=low)
                n += near.sum(1)
                near = near.astype(np.float64)
                cost += np.einsum("cr,cr->c", near, far)
                total += near @ rows
        used = np.flatnonzero(n)
        run_of = np.searchsorted(cuts, used, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([runs[i] for i in run_of], pa.int32()), pa.array(used - cuts[run_of], pa.int32()),
             pa.array(n[used]), pa.array(cost[used]), *[pa.array(total[used, c]) for c in range(d)]],
            names=["run", "center", "n", "cost", *[f"s{c}" for c in range(d)]])

    columns = ", ".join(f"s{c} double" for c in range(d))
    return (x.mapInArrow(run, f"run int, center int, n long, cost double, {columns}").groupBy("run", "center")
            .agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                 F.array(*[F.sum(f"s{c}") for c in range(d)]).alias("sums")))


def fit_kmeans(vecs: DataFrame, k: int, starts: int, seed: int = SEED):
    """M8: best of ``starts`` K-Means runs (least within-cluster cost), fitted
    again by Spark ML, which makes the model."""
    runs = kmeans_runs(vecs, [(k, seed + s) for s in range(starts)])
    best = min(range(starts), key=lambda s: runs[s][1])
    return _kmeans(vecs, k, seed + best, spark_kmeans_tol(vecs)(k))


def elbow_fits(vecs: DataFrame, ks=range(2, 9), starts: int = 5, seed: int = SEED) -> list:
    """M9: (k, inertia, centres) for k = 2..8, best of 5 starts each, over the
    cached vectors that M8 uses, by the same runs as M8's, all together."""
    runs = kmeans_runs(vecs, [(k, seed + s) for k in ks for s in range(starts)])
    best = {k: min((r for r in runs if r[0] == k), key=lambda r: r[1]) for k in ks}
    return [(k, float(cost), centers.tolist()) for k, cost, centers in best.values()]


def elbow_table(vecs: DataFrame, centers: dict[int, list[list[float]]]) -> DataFrame:
    """M9 over any rows: the sum of squared distances to the nearest of the
    fitted centres, by k. One aggregate; the centres are literals."""
    x = vector_to_array(F.col("features"))

    def cost(rows: list[list[float]]):
        dist = [F.aggregate(F.zip_with(x, F.array(*map(C.dlit, row)), lambda a, b: (a - b) * (a - b)),
                            C.dlit(0), lambda acc, v: acc + v) for row in rows]
        return F.sum(F.least(*dist) if len(dist) > 1 else dist[0])

    row = vecs.agg(*[cost(c).alias(f"k{k}") for k, c in centers.items()])
    pairs = ", ".join(f"{k}, k{k}" for k in centers)
    return row.selectExpr(f"stack({len(centers)}, {pairs}) AS (k, inertia)").where("inertia IS NOT NULL")


def forest_rows(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (score, features, RespondentID) as the forest regressor reads
    them in every pass. A pass adds each row to the sums of one node of every tree
    and returns all sums of each task: so there are as many tasks as cores, however
    the table's files are cut, and a task's rows of near scores, which mostly meet in
    the same nodes, follow each other. Few rows stay as they are."""
    tasks = max(min(rows.sparkSession.sparkContext.defaultParallelism, n // FOREST_ROWS), -(-n // FOREST_ROWS_MOST))
    if tasks > 1:
        rows = rows.repartition(tasks).sortWithinPartitions("score", "RespondentID")
    return rows.select("score", "features")


def fit_forest(rows: DataFrame, n: int, trees: int, depth: int) -> RandomForestRegressionModel:
    """M7 over ``forest_rows``, held while Spark bins them."""
    held = forest_rows(rows, n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return RandomForestRegressor(
            featuresCol="features", labelCol="score", numTrees=trees, maxDepth=depth,
            featureSubsetStrategy="all", seed=SEED, maxMemoryInMB=FOREST_MB).fit(held)
    finally:
        held.unpersist()


def hold_out_metrics(test_c: DataFrame, test_r: DataFrame, models: dict) -> DataFrame:
    """E1, E2, E5 of the five supervised models on rows with ``features`` and
    ``label`` or ``score``: a long table of 15 rows."""
    spark, rows = test_c.sparkSession, []
    for name in ("lr", "rf_clf", "gb_clf"):
        # scored once: the metrics read the stored scores several times
        pred = materialize(models[name].transform(test_c)
                           .select("label", positive_probability().alias("p1")))
        m = classification_metrics(pred, "label", "p1").first()
        rows += [(name, "classification", k, float(m[k])) for k in ("accuracy", "roc_auc", "f1")]
    for name in ("ridge", "rf_reg"):
        pred = models[name].transform(test_r)
        m = regression_metrics(pred, "score", "prediction").first()
        rows += [(name, "regression", k, float(m[k])) for k in ("rmse", "r2", "mae")]
    return spark.createDataFrame(rows, "model string, task string, metric string, value double")


def evaluate_hold_out(df: DataFrame, bundle: Bundle) -> DataFrame:
    """The hold-out metrics of trained models over the rows that the split
    keeps apart (M2 is a function of the key, so these are training's)."""
    test = split(df, 20, SEED).where("is_test = 1")
    vectors = {task: with_features(test, bundle.features[task]).select(
        F.col("LoanApproved").cast("int").alias("label"), F.col("CreditScore").cast("double").alias("score"),
        F.col(f"__f_{task}").alias("features")) for task in ("clf", "reg")}
    return hold_out_metrics(vectors["clf"], vectors["reg"], bundle.models)


def train(df: DataFrame, preset: str = "fast", scaler_fit: str = "train",
          with_elbow: bool = False, timings: dict | None = None,
          parts: Sequence[str] | None = None, scalers: dict | None = None) -> Bundle:
    """Clean table -> features -> split -> six fitted models -> hold-out
    metrics -> cluster profile and names. ``timings`` (if given) receives the
    wall seconds of each fit.

    With ``parts`` (of ``PARTS``) only those are fitted, each as it is fitted
    beside the others: no fit reads another's result. The hold-out metrics need
    all supervised models, the profile and names the K-Means. ``scalers`` are
    those of parts fitted before."""
    import time as _time
    p = PRESETS[preset]
    timings = timings if timings is not None else {}

    def timed(name, fn):
        t0 = _time.time()
        out = fn()
        timings[name] = round(_time.time() - t0, 3)
        return out
    spark = df.sparkSession
    wanted = set(parts) if parts is not None else set(PARTS) - (set() if with_elbow else {"elbow"})
    clf_f, reg_f = present(df, K.CLF_FEATURES), present(df, K.REG_FEATURES)
    clu_f = present(df, K.CLU_FEATURES)
    keep = ["RespondentID", "label", "score", "is_test", "LoanApproved", "CreditScore"]
    data = split(df, 20, SEED).withColumn("label", F.col("LoanApproved").cast("int")) \
        .withColumn("score", F.col("CreditScore").cast("double"))
    data = data.select(*dict.fromkeys([*keep, *clf_f, *reg_f, *clu_f])).persist(StorageLevel.MEMORY_AND_DISK)
    cached = [data]
    try:
        if scalers is None:
            fit_rows = data if scaler_fit == "all" else data.where(F.col("is_test") == 0)
            filled = prep_features(fit_rows, sorted(set(clf_f + clu_f)))
            scalers = {"clf": segments.fit_scaler(filled, clf_f),
                       "reg": segments.fit_scaler(filled, reg_f),
                       "clu": segments.fit_scaler(filled, clu_f)}

        def vectors(features, task, keep=keep):
            frame = assemble(data, features, scalers[task], keep)
            if task == "clf":
                frame = balanced_weights(frame, "label", fit_on=data.where("is_test = 0"))
            cached.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
            return frame

        Xc = vectors(clf_f, "clf") if wanted & {*CLASSIFIERS} or reg_f == clf_f and wanted & {*REGRESSORS} else None
        if reg_f == clf_f:  # the same vectors: cached once
            Xr = Xc
        else:
            Xr = vectors(reg_f, "reg") if wanted & {*REGRESSORS} else None
        models, fits = {}, {}
        if wanted & {*CLASSIFIERS}:
            train_c = Xc.where("is_test = 0")
            n_train = train_c.count()
            fits |= {
                "lr": lambda: LogisticRegression(
                    featuresCol="features", labelCol="label", weightCol="w", maxIter=1000,
                    regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False,
                    tol=1e-8).fit(train_c),
                "rf_clf": lambda: RandomForestClassifier(
                    featuresCol="features", labelCol="label", weightCol="w",
                    numTrees=p["rf_trees"], maxDepth=p["rf_depth"], featureSubsetStrategy="sqrt",
                    seed=SEED).fit(train_c),
                "gb_clf": lambda: GBTClassifier(
                    featuresCol="features", labelCol="label", maxIter=p["gb_rounds"], maxDepth=5,
                    stepSize=0.1, seed=SEED).fit(train_c),
            }
        if wanted & {*REGRESSORS}:
            train_r = Xr.where("is_test = 0")
            n_r, sy = train_r.agg(F.count(F.lit(1)), F.stddev_pop("score")).first()
            fits |= {
                "ridge": lambda: LinearRegression(
                    featuresCol="features", labelCol="score", solver="normal", elasticNetParam=0.0,
                    standardization=False, regParam=1.0 * (sy or 1.0) / n_r).fit(train_r),
                "rf_reg": lambda: fit_forest(train_r, n_r, p["rfr_trees"], p["rfr_depth"]),
            }
        if wanted & {"kmeans", "elbow"}:
            Xk = assemble(data.withColumns({f"raw_{c}": F.coalesce(C.no_nan(c), C.dlit(0)) for c in clu_f}),
                          clu_f, scalers["clu"], [*keep, *[f"raw_{c}" for c in clu_f]])
            cached.append(Xk.persist(StorageLevel.MEMORY_AND_DISK))
            Xk.count()
            fits |= {"kmeans": lambda: fit_kmeans(Xk, 4, p["km_starts"])[0], "elbow": lambda: elbow_fits(Xk)}
        # The vectors are all cached now; the fits need the room of the table.
        data.unpersist()
        fits = {n: fit for n, fit in fits.items() if n in wanted}
        names = list(fits)
        results = _parallel([lambda n=n: timed("fit_" + n if n != "elbow" else n, fits[n])
                             for n in names], workers=len(names))
        for n, r in zip(names, results):
            if n != "elbow":
                models[n] = r
        fitted = results[names.index("elbow")] if "elbow" in wanted else []

        metrics = None
        if wanted >= {*SUPERVISED}:
            metrics = hold_out_metrics(Xc.where("is_test = 1"), Xr.where("is_test = 1"), models)

        profile, labels, sizes = None, {}, {}
        if "kmeans" in wanted:
            profile, labels, sizes = describe_clusters(models["kmeans"].transform(Xk), clu_f)
        return Bundle(clf_f, reg_f, clu_f, scalers, models, metrics, labels, profile,
                      [f[:2] for f in fitted], sizes, elbow_centers={f[0]: f[2] for f in fitted})
    finally:
        for frame in cached:
            frame.unpersist()


def describe_clusters(predicted: DataFrame, clu_f: list[str]) -> tuple[DataFrame, dict[int, str], dict[int, int]]:
    """Profile, names and sizes of the trained clusters. The raw features ride
    along with the vectors, so no join is needed."""
    clustered = predicted.withColumnRenamed("prediction", "Cluster")
    profile = segments.cluster_profile(
        clustered.select("Cluster", "LoanApproved", *[F.col(f"raw_{c}").alias(c) for c in clu_f]),
        [c for c in clu_f if c != "CreditScore"], extra=["LoanApproved"])
    profile = predicted.sparkSession.createDataFrame(profile.collect(), profile.schema)
    labels = {int(r["Cluster"]): r["label"] for r in segments.name_clusters(profile).collect()}
    return profile, labels, segments.cluster_size_map(clustered).first()["sizes"]


# ------------------------------------------------------------ S6 - S8 -------
_MODEL_TYPES = {"lr": LogisticRegressionModel, "rf_clf": RandomForestClassificationModel,
                "gb_clf": GBTClassificationModel, "ridge": LinearRegressionModel,
                "rf_reg": RandomForestRegressionModel, "kmeans": KMeansModel}


def save_artifacts(bundle: Bundle, path: str, add: bool = False) -> None:
    """Feature stages (PipelineModel) and models via Spark ML persistence;
    lists, scalers, labels and cluster sizes as small JSON documents; metrics and
    profile as parquet. A later session scores from the folder alone. With ``add``
    the bundle's parts, trained with the folder's scalers, join what is there. The
    sentinels are written last."""
    spark = SparkSession.getActiveSession()

    def document(name: str, content: dict) -> None:
        spark.createDataFrame([(json.dumps(content),)], "meta string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/{name}")

    if not add:
        for name in ["_done", *[f"_done_{n}" for n in PARTS]]:
            sentinel, fs = file_system(spark, f"{path}/{name}")
            fs.delete(sentinel, True)
        for task, pipeline in bundle.features.items():
            pipeline.write().overwrite().save(f"{path}/features_{task}")
        document("meta", {"clf_features": bundle.clf_features, "reg_features": bundle.reg_features,
                          "clu_features": bundle.clu_features, "scalers": bundle.scalers, "version": VERSION})
    for name, m in bundle.models.items():
        m.write().overwrite().save(f"{path}/{name}")
    if bundle.metrics is not None:
        bundle.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    if bundle.cluster_profile is not None:
        bundle.cluster_profile.write.mode("overwrite").parquet(f"{path}/cluster_profile")
        document("clusters", {"segment_labels": {str(k): v for k, v in bundle.segment_labels.items()},
                              "cluster_sizes": {str(k): v for k, v in bundle.cluster_sizes.items()}})
    if bundle.elbow_centers:
        document("elbow", {"inertias": bundle.inertias,
                           "elbow_centers": {str(k): v for k, v in bundle.elbow_centers.items()}})
    parts = [*bundle.models, *(["elbow"] if bundle.elbow_centers else [])]
    for name in ["_done", *[f"_done_{n}" for n in parts]]:
        document(name, {})


_LOADED: dict[tuple, tuple[SparkSession, Bundle]] = {}


def load_artifacts(spark: SparkSession, path: str, cached: bool = True,
                   parts: Sequence[str] | None = None) -> Bundle:
    """The folder's models, or those of ``parts``. A part that is complete is
    immutable (versioned path, sentinel written last), so loaded bundles are kept
    for the session that loaded them."""
    key = (path, tuple(sorted(parts)) if parts is not None else tuple(trained_parts(spark, path)))
    hit = _LOADED.get(key)
    if cached and hit is not None and same_session(hit[0], spark):
        return hit[1]
    bundle = _load_artifacts(spark, path, set(key[1]))
    if cached:
        _LOADED[key] = (spark, bundle)
    return bundle


def _load_artifacts(spark: SparkSession, path: str, parts: set[str]) -> Bundle:
    def document(name: str) -> dict:
        return json.loads(spark.read.parquet(f"{path}/{name}").first()["meta"])

    meta = document("meta")
    clusters = document("clusters") if "kmeans" in parts else {}
    elbow = document("elbow") if "elbow" in parts else {}
    models = {n: t.load(f"{path}/{n}") for n, t in _MODEL_TYPES.items() if n in parts}
    metrics = f"{path}/metrics"
    return Bundle(meta["clf_features"], meta["reg_features"], meta["clu_features"], meta["scalers"], models,
                  spark.read.parquet(metrics) if parts >= {*SUPERVISED} and _exists(spark, metrics) else None,
                  {int(k): v for k, v in clusters.get("segment_labels", {}).items()},
                  spark.read.parquet(f"{path}/cluster_profile") if clusters else None,
                  [tuple(x) for x in elbow.get("inertias", [])],
                  {int(k): v for k, v in clusters.get("cluster_sizes", {}).items()},
                  {int(k): v for k, v in elbow.get("elbow_centers", {}).items()},
                  {task: PipelineModel.load(f"{path}/features_{task}") for task in ("clf", "reg", "clu")})


def trained_parts(spark: SparkSession, path: str) -> list[str]:
    """Parts that are complete in an artifact folder."""
    return [n for n in PARTS if _exists(spark, f"{path}/_done_{n}")]


def _exists(spark: SparkSession, path: str) -> bool:
    hpath, fs = file_system(spark, path)
    return fs.exists(hpath)


def input_version(spark: SparkSession, sf_dir: str) -> str:
    """The content of the input: models of an input that changed are not used
    again."""
    return content_version(spark, sf_dir)


def artifact_dir(spark: SparkSession, key: str) -> str:
    """Default artifact folder: under the shared checkpoint folder."""
    from loanlens.session import ensure_checkpoint_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    h = hashlib.sha1(f"{key}|{VERSION}".encode()).hexdigest()[:12]
    return f"{base.rstrip('/')}/loanlens-models/{h}"


def ensure_artifacts(spark: SparkSession, df_factory, key: str, preset: str = "fast",
                     path: str | None = None, parts: Sequence[str] = PARTS) -> Bundle:
    """Train (and save) what of ``parts`` has no sentinel yet, with the
    scalers of the parts that are there."""
    path = path or artifact_dir(spark, f"{key}|{preset}")
    done = trained_parts(spark, path)
    missing = [n for n in parts if n not in done]
    if missing:
        begun = _exists(spark, f"{path}/_done")
        scalers = load_artifacts(spark, path, parts=()).scalers if begun else None
        save_artifacts(train(df_factory(), preset, parts=missing, scalers=scalers), path, add=begun)
    return load_artifacts(spark, path, parts=parts)


# ----------------------------------------------------------- M10, M12, M13 --
def pca_projection(vecs: DataFrame, keep=(), k: int = 2):
    """2-D PCA of scaled clustering vectors (input already centred by
    the scaler), sign fixed so each component's largest loading is positive;
    returns (projection, explained-variance ratios)."""
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vecs)
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array(F.col("pcs"))
    proj = model.transform(vecs).select(
        *keep, *[(arr[j] * C.dlit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])
    return proj, [float(v) for v in model.explainedVariance.toArray()]


def feature_importance(spark: SparkSession, bundle: Bundle, top: int = 20) -> DataFrame:
    """Forest importances with names, ascending, the ``top`` largest."""
    imp = bundle.models["rf_clf"].featureImportances.toArray()
    rows = [(f, round(float(v), 4)) for f, v in zip(bundle.clf_features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    top_df = df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
    return top_df.withColumn("band", C.importance_band("importance")) \
        .orderBy(F.asc("importance"), F.desc("feature"))


def ridge_extremes(spark: SparkSession, bundle: Bundle, n: int = 3) -> DataFrame:
    """The ``n`` largest positive and the ``n`` most negative ridge
    coefficients, each side from the strongest on."""
    c = ridge_coefficients(spark, bundle)
    up = c.where("coefficient > 0").orderBy(F.desc("coefficient"), "feature").limit(n)
    down = c.where("coefficient < 0").orderBy("coefficient", "feature").limit(n)
    return up.unionByName(down)


def ridge_coefficients(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """Ridge coefficients sorted ascending, with sign band."""
    coef = bundle.models["ridge"].coefficients.toArray()
    rows = [(f, float(v)) for f, v in zip(bundle.reg_features, coef)]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumn("sign", C.sign_band("coefficient")).orderBy("coefficient", "feature")
