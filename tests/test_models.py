"""Model parity and quality with tolerances, on sf0.001. All
models under test come from ``plans.models.train``."""

import os
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.operators import segments
from loanlens.plans import jobs
from loanlens.plans import models as M
from loanlens.plans.score import LIVE_COLUMNS, RESULT_COLUMNS, agreement, score, score_with_models, segment_customers
from loanlens.sources.customers import load_customers
from loanlens.sources.fixtures import profiles


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def base(spark, sf0001):
    return load_customers(spark, sf0001)


@pytest.fixture(scope="module")
def bundle(base):
    return M.train(base, "test", with_elbow=True)


@pytest.fixture(scope="module")
def artifacts(spark, bundle, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "art")
    M.save_artifacts(bundle, path)
    return path


def matrix(base, bundle, kind):
    """Scaled features, label and hold-out flag as training sees them."""
    feats = {"clf": bundle.clf_features, "reg": bundle.reg_features}[kind]
    flagged = M.split(base, 20, M.SEED)
    rows = M.assemble(flagged, feats, bundle.scalers[kind],
                      keep=["LoanApproved", "CreditScore", "is_test"]).collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([float(r["LoanApproved"] if kind == "clf" else r["CreditScore"]) for r in rows])
    return X, y, np.array([r["is_test"] for r in rows], bool)


def test_ridge_of_training_matches_closed_form(base, bundle):
    X, y, test = matrix(base, bundle, "reg")
    A, t = X[~test], y[~test]
    Ac, yc = A - A.mean(0), t - t.mean()
    w = np.linalg.solve(Ac.T @ Ac + np.eye(A.shape[1]), Ac.T @ yc)
    model = bundle.models["ridge"]
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6 * max(1, np.abs(w).max()))
    assert np.isclose(model.intercept, t.mean() - A.mean(0) @ w, atol=1e-6)


def test_logistic_of_training_matches_newton(base, bundle):
    """L2 with C = 1 and class weights balanced on the training rows."""
    X, y, test = matrix(base, bundle, "clf")
    A, t = np.c_[X[~test], np.ones((~test).sum())], y[~test]
    n = len(t)
    weight = np.where(t == 1, n / (2 * (t == 1).sum()), n / (2 * (t == 0).sum()))
    penalty = np.r_[np.ones(X.shape[1]), 0.0]
    w = np.zeros(A.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ w))
        gradient = A.T @ (weight * (p - t)) + penalty * w
        hessian = A.T @ (A * (weight * p * (1 - p))[:, None]) + np.diag(penalty)
        w -= np.linalg.solve(hessian, gradient)
    model = bundle.models["lr"]
    assert np.allclose(model.coefficients.toArray(), w[:-1], atol=2e-3)
    assert np.isclose(model.intercept, w[-1], atol=2e-3)


def test_class_weights_come_from_training_rows(spark):
    df = spark.createDataFrame([(1, 0)] * 3 + [(0, 0)] * 1 + [(0, 1)] * 50, "label int, is_test int")
    w = {r["label"]: r["w"] for r in M.balanced_weights(df, "label", df.where("is_test = 0")).collect()}
    assert w == {1: 4 / (2 * 3), 0: 4 / (2 * 1)}


def test_hold_out_scores_of_every_model(base, bundle):
    met = {(r["model"], r["metric"]): r["value"] for r in bundle.metrics.collect()}
    assert met[("lr", "roc_auc")] > 85 and met[("ridge", "r2")] > 90
    # ten shallow trees or five rounds on 120 rows; the full presets do better
    assert met[("rf_clf", "roc_auc")] > 90 and met[("gb_clf", "roc_auc")] > 80
    assert met[("rf_reg", "r2")] > 50
    assert min(v for (m, k), v in met.items() if k == "accuracy") > 70


def test_segments_and_elbow(bundle):
    assert sorted(bundle.segment_labels.values()) == sorted(K.CLUSTER_NAMES)
    assert [k for k, _ in bundle.inertias] == list(range(2, 9))
    costs = [v for _, v in bundle.inertias]
    assert all(a > b for a, b in zip(costs, costs[1:]))
    # the same fit as M8, with more starts
    assert dict(bundle.inertias)[4] <= bundle.models["kmeans"].summary.trainingCost * 1.05


def test_elbow_table_and_metrics_over_the_rows(base, bundle):
    """Over the training table they are what training found; over more rows
    they follow the rows."""
    vecs = M.assemble(base, bundle.clu_features, bundle.scalers["clu"])
    got = {r["k"]: r["inertia"] for r in M.elbow_table(vecs, bundle.elbow_centers).collect()}
    assert sorted(got) == list(range(2, 9))
    for k, cost in bundle.inertias:
        assert np.isclose(got[k], cost, rtol=1e-6)
    twice = {r["k"]: r["inertia"] for r in M.elbow_table(vecs.unionByName(vecs), bundle.elbow_centers).collect()}
    assert all(np.isclose(twice[k], 2 * v) for k, v in got.items())
    key = lambda r: (r["model"], r["metric"])
    a, b = ({key(r): r["value"] for r in m.collect()} for m in (M.evaluate_hold_out(base, bundle), bundle.metrics))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=0.011) for k in a)


def test_cluster_profile_is_of_the_trained_clusters(base, bundle):
    named = segment_customers(base, bundle)
    want = segments.cluster_profile(named.na.fill(0), [c for c in bundle.clu_features if c != "CreditScore"],
                                    extra=["LoanApproved"]).collect()
    got = bundle.cluster_profile.orderBy("Cluster").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_segments_assign_the_loaded_table(spark, sf0001, base, bundle):
    """Nulls count as the column's median, as in the fit; nearest centre by
    numpy. Scoring the raw profiles (nulls as 0) gives other segments."""
    named = {r["RespondentID"]: r for r in segment_customers(base, bundle).collect()}
    st, centers = bundle.scalers["clu"], np.array(bundle.models["kmeans"].clusterCenters())
    for r in base.collect():
        x = np.array([((r[c] or 0.0) - st[f"mean_{c}"]) / (st[f"std_{c}"] or 1.0) for c in bundle.clu_features])
        k = int(((centers - x) ** 2).sum(axis=1).argmin())
        assert named[r["RespondentID"]]["Cluster"] == k
        assert named[r["RespondentID"]]["Cluster_Label"] == bundle.segment_labels[k]
    raw = {r["RespondentID"]: r["Marketing_Segment"]
           for r in score(profiles(spark, sf0001), bundle, "batch").collect()}
    assert sum(raw[k] != r["Cluster_Label"] for k, r in named.items()) > 10


def test_artifacts_round_trip(spark, bundle, artifacts):
    b2 = M.load_artifacts(spark, artifacts)
    assert b2.segment_labels == bundle.segment_labels
    assert b2.clf_features == bundle.clf_features
    assert b2.metrics.count() == bundle.metrics.count()
    assert M.load_artifacts(spark, artifacts) is b2
    assert M.load_artifacts(spark, artifacts, cached=False) is not b2


def test_artifact_key_follows_the_input(spark, sf0001, tmp_path):
    for t in ("customer", "nation", "orders", "lineitem", "events"):
        spark.read.parquet(f"{sf0001}/{t}.parquet").limit(3).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    one = M.input_version(spark, str(tmp_path))
    assert one == M.input_version(spark, str(tmp_path))
    spark.read.parquet(f"{sf0001}/events.parquet").limit(4).coalesce(1).write.mode("overwrite").parquet(
        f"{tmp_path}/events.parquet")
    assert one != M.input_version(spark, str(tmp_path))


def test_pca_matches_numpy(base, bundle):
    feats = bundle.clu_features
    vecs = M.assemble(base, feats, bundle.scalers["clu"], keep=["RespondentID"])
    proj, ratios = M.pca_projection(vecs, keep=["RespondentID"])
    A = np.array([r["features"].toArray() for r in vecs.collect()])
    ev = np.sort(np.linalg.eigvalsh(np.cov(A.T)))[::-1]
    assert np.allclose(ratios, ev[:2] / ev.sum(), atol=1e-8)
    assert proj.count() == base.count()


def test_batch_scoring_columns_and_halves(spark, sf0001, bundle):
    batch = profiles(spark, sf0001)
    full = score(batch, bundle, "batch")
    added = [c for c in full.columns if c not in batch.columns]
    assert set(RESULT_COLUMNS) <= set(added) and not {"p_gb", "p_rf", "p_lr", "ridge_pred"} & set(full.columns)
    a, b = batch.randomSplit([0.5, 0.5], seed=3)
    halves = score(a, bundle, "batch").unionByName(score(b, bundle, "batch"))
    key = ["RespondentID", *RESULT_COLUMNS]
    assert sorted(full.select(key).collect()) == sorted(halves.select(key).collect())
    dec = {r[0] for r in full.select("Loan_Decision").distinct().collect()}
    assert dec <= {"Approved", "Borderline", "Rejected"}
    assert full.where((F.col("Predicted_CreditScore") < 300) |
                      (F.col("Predicted_CreditScore") > 900)).count() == 0
    assert agreement(score_with_models(batch, bundle)).count() == 3 * batch.count()


def test_scoring_reads_nan_as_null(spark, sf0001, bundle):
    batch = profiles(spark, sf0001).limit(20)
    holes = [c for c in ("CreditUtilization", "EmergencyFundMonths", "CreditScore", "AnnualIncome_INR")]
    nan = batch.withColumns({c: F.lit(float("nan")) for c in holes})
    null = batch.withColumns({c: F.lit(None).cast("double") for c in holes})
    key = ["RespondentID", *RESULT_COLUMNS]
    assert sorted(map(str, score(nan, bundle).select(key).collect())) == sorted(
        map(str, score(null, bundle).select(key).collect()))


def test_importances_and_coefficients(spark, bundle):
    top = M.feature_importance(spark, bundle, 5).collect()
    assert len(top) == 5 and [r["importance"] for r in top] == sorted(r["importance"] for r in top)
    ends = M.ridge_extremes(spark, bundle).collect()
    every = sorted(bundle.models["ridge"].coefficients.toArray())
    assert [r["coefficient"] for r in ends] == every[::-1][:3] + every[:3]


def test_stream_equals_live_batch(spark, sf0001, bundle, tmp_path):
    from loanlens.streaming.score_stream import start_scoring_stream
    apps = profiles(spark, sf0001).select("RespondentID", "Age", "AnnualIncome_INR",
                                          "DebtToIncomeRatio", "CreditUtilization",
                                          "ExistingDebt_INR", "SavingsBalance_INR",
                                          "MissedPayments", "RepaymentHistory")
    src = str(tmp_path / "in")
    apps.repartition(3).write.parquet(src)
    q = start_scoring_stream(spark, src, apps.schema, bundle, str(tmp_path / "out"),
                             str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = score(apps, bundle, "live").select("RespondentID", *RESULT_COLUMNS)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert got.columns == ["RespondentID", *LIVE_COLUMNS]
    bands = list(zip(K.SCORE_BAND_EDGES, K.SCORE_BAND_EDGES[1:], K.SCORE_BAND_LABELS))
    for r in got.collect():
        low = max(r["Predicted_CreditScore"], 301)  # 300 is in the lowest band
        assert r["Score_Band"] == next(lab for lo, hi, lab in bands if lo < low <= hi)
        for m in ("gb", "rf", "lr"):
            assert r[f"vote_{m}"] == ("Approve" if r[f"p_{m}"] >= 0.5 else "Reject")
        mean = 0.5 * r["p_gb"] + 0.3 * r["p_rf"] + 0.2 * r["p_lr"]
        assert abs(r["Approval_Probability_%"] - 100 * mean) < 0.006


def test_stream_recovers_from_its_checkpoint(spark, sf0001, bundle, tmp_path):
    """A batch fails in the middle (one of its files cannot be read); after the
    file is mended the query goes on, no application lost or doubled. Files that
    came meanwhile are scored too."""
    from loanlens.streaming.score_stream import start_scoring_stream
    apps = profiles(spark, sf0001).select("RespondentID", "Age", "AnnualIncome_INR", "MissedPayments",
                                          "ExistingDebt_INR", "RepaymentHistory").orderBy("RespondentID").toPandas()
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = spark.createDataFrame(apps.head(1)).schema
    parts = [apps.iloc[k::6] for k in range(6)]

    def run():
        q = start_scoring_stream(spark, str(src), schema, bundle, out, str(tmp_path / "ckpt"), available_now=True,
                                 files_per_batch=2)
        q.awaitTermination()

    def seen():
        return sorted(r["RespondentID"] for r in spark.read.parquet(out).select("RespondentID").collect())

    start = time.time() - 100

    def arrive(k, data=None):
        if data is None:
            parts[k].to_parquet(src / f"part{k}.parquet")
        else:
            (src / f"part{k}.parquet").write_bytes(data)
        os.utime(src / f"part{k}.parquet", (start + k, start + k))

    for k in range(4):
        arrive(k)
    whole = (src / "part3.parquet").read_bytes()
    arrive(3, whole[:len(whole) // 2])
    with pytest.raises(StreamingQueryException):
        run()
    assert seen() == sorted([*parts[0]["RespondentID"], *parts[1]["RespondentID"]])  # the whole batches only
    arrive(3, whole)
    arrive(4)
    arrive(5)
    run()
    assert seen() == sorted(apps["RespondentID"])
    run()  # nothing new: nothing is added
    assert seen() == sorted(apps["RespondentID"])


def test_a_fresh_session_scores_from_the_saved_folder(spark, sf0001, bundle, artifacts, tmp_path):
    """Feature stages, models, labels and sizes are in the folder."""
    batch = profiles(spark, sf0001)
    want = sorted(map(str, score(batch, bundle).select("RespondentID", *RESULT_COLUMNS).collect()))
    batch.write.parquet(str(tmp_path / "batch"))
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from loanlens.session import build_session
from loanlens.plans import models as M
from loanlens.plans.score import LIVE_COLUMNS, RESULT_COLUMNS, score
spark = build_session("local[2]", 2)
bundle = M.load_artifacts(spark, {artifacts!r})
assert type(bundle.features["clf"]).__name__ == "PipelineModel" and len(bundle.features["clf"].stages) == 2
assert bundle.cluster_sizes == {bundle.cluster_sizes!r}
score(spark.read.parquet({str(tmp_path / "batch")!r}), bundle).select("RespondentID", *RESULT_COLUMNS) \\
    .write.parquet({str(tmp_path / "scored")!r})
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "scored")).collect())) == want


def test_feature_stages(spark, tmp_path):
    """Null, NaN and absent features count as 0; a zero deviation scales by 1."""
    rows = spark.createDataFrame([(1.0, float("nan"), "a"), (None, 4.0, "b")], "x double, y double, k string")
    stats = {"mean_x": -1.5, "std_x": 2.0, "mean_y": 1e-7, "std_y": 0.0, "mean_z": 3.0, "std_z": 1.5}
    pipeline = M.feature_pipeline(["x", "y", "z"], stats, "v")
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    for p in (pipeline, M.PipelineModel.load(str(tmp_path / "p"))):
        got = [(r["k"], r["v"].toArray().tolist()) for r in M.with_features(rows, p).collect()]
        assert got == [("a", [1.25, -1e-7, -2.0]), ("b", [0.75, 4.0 - 1e-7, -2.0])]


def test_cluster_sizes_are_of_the_trained_clusters(base, bundle):
    sizes = {r["Cluster"]: r["n"] for r in segments.cluster_sizes(segment_customers(base, bundle)).collect()}
    assert bundle.cluster_sizes == sizes and sum(sizes.values()) == base.count()


# ------------------------------------------------------------------ jobs -----
def test_job_file_starts_by_itself():
    out = subprocess.run([sys.executable, jobs.__file__, "--help"], cwd="/tmp", capture_output=True, text=True,
                         timeout=120)
    assert out.returncode == 0 and "segments" in out.stdout


def test_train_job(spark, sf0001, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "train", lambda df, preset, with_elbow: M_TRAIN(df, "test"))
    jobs.main(["train", "--input", sf0001, "--out", str(tmp_path / "m"), "--preset", "test"])
    assert M.load_artifacts(spark, str(tmp_path / "m")).segment_labels


M_TRAIN = M.train


def test_segment_and_score_jobs(spark, sf0001, base, bundle, artifacts, tmp_path):
    jobs.main(["segments", "--input", sf0001, "--out", str(tmp_path / "seg"), "--models", artifacts])
    got = spark.read.parquet(str(tmp_path / "seg"))
    want = segment_customers(base, bundle).select("RespondentID", "Cluster", "Cluster_Label")
    assert sorted(got.collect()) == sorted(want.collect())
    batch = profiles(spark, sf0001)
    batch.write.parquet(str(tmp_path / "upload"))
    batch.withColumn("EmergencyFundMonths", F.coalesce(F.col("EmergencyFundMonths").cast("string"), F.lit("NaN"))) \
        .write.option("header", True).csv(str(tmp_path / "upload.csv"))
    results = []
    for name in ("upload", "upload.csv"):
        out = str(tmp_path / f"scored-{name}")
        jobs.main(["score", "--input", str(tmp_path / name), "--out", out, "--models", artifacts])
        results.append(sorted(map(str, spark.read.parquet(out).select("RespondentID", *RESULT_COLUMNS).collect())))
    assert results[0] == results[1] and len(results[0]) == batch.count()


def test_profile_job(spark, sf0001, tmp_path):
    names = ["kpis", "box_CreditScore_by_CityTier", "qq_fit_CreditScore", "value_shares_Persona", "capped_table",
             "grouped_stats_RiskScore_by_RepaymentHistory", "category_headline_Persona", "linregress"]
    jobs.main(["profile", "--input", sf0001, "--out", str(tmp_path), "--only", *names])
    for name in names:
        assert spark.read.parquet(f"{tmp_path}/{name}").count() > 0
    with pytest.raises(KeyError):
        jobs.profiling_job(spark, sf0001, str(tmp_path), ["kpis", "no_such_thing"])


def test_profile_covers_the_default_lists(base):
    have = set(jobs.profile_analyses(base))
    for c in K.BOX_NUMERIC:
        for g in K.BOX_GROUPS:
            if {c, g} <= set(base.columns):
                assert {f"box_{c}_by_{g}", f"grouped_stats_{c}_by_{g}"} <= have
    for c in K.EDA_NUMERIC:
        if c in base.columns:
            assert {f"qq_points_{c}", f"histogram_{c}_by_LoanApproved"} <= have
    for c in K.EDA_CATEGORICAL:
        if c in base.columns:
            assert {f"category_headline_{c}", f"value_shares_{c}"} <= have


def test_only_the_parts_asked_for_are_trained_and_later_ones_join(spark, base, bundle, tmp_path):
    path = str(tmp_path / "parts")
    one = M.ensure_artifacts(spark, lambda: base, "k", "test", path, parts=("ridge",))
    assert M.trained_parts(spark, path) == ["ridge"] and list(one.models) == ["ridge"]
    assert np.allclose(one.models["ridge"].coefficients.toArray(), bundle.models["ridge"].coefficients.toArray())
    two = M.ensure_artifacts(spark, lambda: base, "k", "test", path, parts=("ridge", "kmeans"))
    assert sorted(M.trained_parts(spark, path)) == ["kmeans", "ridge"] and two.scalers == one.scalers
    assert sorted(two.segment_labels.values()) == sorted(K.CLUSTER_NAMES)
    assert two.cluster_sizes and sum(two.cluster_sizes.values()) == base.count()

    def none():
        raise AssertionError("trained again")
    assert M.ensure_artifacts(spark, none, "k", "test", path, parts=("kmeans",)).cluster_profile.count() == 4
    M.save_artifacts(one, path)  # anew: what was there is no longer valid
    assert M.trained_parts(spark, path) == ["ridge"]


@pytest.mark.parametrize("query, parts", [
    ("feature_importance", {"rf_clf"}), ("feature_importance_top5", {"rf_clf"}), ("ridge_coefficients", {"ridge"}),
    ("ridge_extremes", {"ridge"}), ("elbow", {"elbow"}), ("kmeans_segments", {"kmeans"}), ("pca_variance", {"kmeans"}),
    ("train_metrics", set(M.SUPERVISED)), ("batch_summary", {*M.CLASSIFIERS, "ridge", "kmeans"}),
    ("model_roc_points", set(M.CLASSIFIERS)), ("model_residual_summary", set(M.REGRESSORS))])
def test_a_query_trains_the_models_it_reads(spark, sf0001, monkeypatch, query, parts):
    asked = []

    def stop(*args, parts=M.PARTS, **kw):
        asked.extend(parts)
        raise InterruptedError

    from loanlens.plans import catalog_models
    monkeypatch.setattr(M, "ensure_artifacts", stop)
    monkeypatch.setattr(catalog_models, "stored_table", lambda kind, spark, d, build: build())
    with pytest.raises(InterruptedError):
        getattr(catalog_models, query)(spark, sf0001)
    assert set(asked) == parts


def test_kmeans_runs_together_equal_runs_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(v.tolist(),) for v in np.r_[rng.normal(size=(150, 3)), rng.normal(4, 2, (100, 3)), np.zeros((30, 3))]]
    from pyspark.ml.functions import array_to_vector
    vecs = spark.createDataFrame(rows, "x array<double>").select(array_to_vector("x").alias("features")).persist()
    starts, tol = [(4, 1), (4, 2), (7, 1), (2, 9)], M.spark_kmeans_tol(vecs)
    for (k, cost, centers), (_, seed) in zip(M.kmeans_runs(vecs, starts), starts):
        model, alone = M._kmeans(vecs, k, seed, tol(k))
        assert np.isclose(cost, alone) and np.allclose(centers, model.clusterCenters())
    vecs.unpersist()


def test_kmeans_reads_the_vectors_alone(spark, monkeypatch):
    """No pass of a fit reads the table that the vectors stand in."""
    fit, seen = M.KMeans.fit, []
    monkeypatch.setattr(M.KMeans, "fit", lambda self, df, *a: seen.append(df.columns) or fit(self, df, *a))
    from pyspark.ml.functions import array_to_vector
    rows = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(25)], "id int, x array<double>")
    vecs = rows.select("id", array_to_vector("x").alias("features")).persist()
    try:
        M.fit_kmeans(vecs, 2, 3)
        M.elbow_fits(vecs, ks=(2, 3), starts=2)
    finally:
        vecs.unpersist()
    assert len(seen) == 8 and all(c == ["features"] for c in seen)


def test_equally_near_centres_go_to_the_first(spark):
    x = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],), ([9.0, 0.0],)], "x array<double>")
    centers = {0: np.array([[1.0, 0], [1.0, 0], [8.0, 0]]), 4: np.array([[1.0, 1.0], [1.0, -1.0]])}
    got = {(r.run, r.center): (r.n, r.cost, r.sums) for r in M.lloyd_sums(x, centers).collect()}
    assert got == {(0, 0): (2, 2.0, [2.0, 0.0]), (0, 2): (1, 1.0, [9.0, 0.0]), (4, 0): (3, 69.0, [11.0, 0.0])}


def test_fits_hold_the_vectors_alone(base, spark, monkeypatch):
    """The table is let go before the fits begin, and the passes of K-Means read
    cached rows; nothing stays cached."""
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, seen, read = held(), [], []
    together, passes = M._parallel, M.lloyd_runs
    monkeypatch.setattr(M, "_parallel", lambda fns, **k: seen.append(held() - before) or together(fns, **k))
    monkeypatch.setattr(M, "lloyd_runs", lambda x, *a: read.append(x.storageLevel.useMemory) or passes(x, *a))
    M.train(base, "test", parts=["ridge", "kmeans"])
    assert seen[0] == 2 and read == [True] and held() == before


def test_the_forest_regressor_reads_its_rows_in_as_many_tasks_as_cores(spark):
    rows = spark.createDataFrame([(float(k * 37 % 601), [float(k)], None if k % 5 == 0 else f"R{k % 900}")
                                  for k in range(3000)], "score double, features array<double>, RespondentID string")
    cores = spark.sparkContext.defaultParallelism
    for parts in (1, 40):  # few and many pieces of the table's files
        read = M.forest_rows(rows.repartition(parts), 3000)
        tasks = read.rdd.glom().collect()
        assert len(tasks) == min(cores, 2)
        assert max(map(len, tasks)) < 1.2 * 3000 / len(tasks)
        assert all([r["score"] for r in t] == sorted(r["score"] for r in t) for t in tasks)
        assert sorted(r["features"][0] for t in tasks for r in t) == [float(k) for k in range(3000)]
    few = M.forest_rows(rows.limit(900).coalesce(1), 900)
    assert few.rdd.getNumPartitions() == 1 and few.collect() == rows.limit(900).coalesce(1).select("score", "features").collect()
