"""Distributed ordered statistics against numpy / single-partition results."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanlens.operators import clean, distribution, histogram
from loanlens.operators.quantiles import (cumulative_before, exact_quantiles, expand_positions,
                                          global_positions, quantiles_wide)



def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=300), np.full(50, 0.25), rng.integers(0, 5, 100)])
    groups = np.arange(len(vals)) % 3
    rows = [(int(g), float(v)) for g, v in zip(groups, vals)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["x"], probs, ["g"]).collect()}
    for g in range(3):
        for p in probs:
            assert np.isclose(got[(g, p)], np.quantile(vals[groups == g], p), rtol=0, atol=1e-12)
    assert all(k[0] != 9 for k in got)        # an all-null group has no quantile


def test_quantiles_wide_single_row_group(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "g int, x double")
    got = {r["g"]: r["median"] for r in quantiles_wide(df, ["x"], [0.5], ["median"], ["g"])
           .collect()}
    assert got == {1: 5.0, 2: 2.0}


def test_cumulative_matches_one_partition_window(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v), int(c)) for k, v, c in
            zip(rng.integers(0, 3, 500), rng.normal(size=500), rng.integers(1, 4, 500))]
    df = spark.createDataFrame(rows, "k int, x double, cnt int").dropDuplicates(["k", "x"])
    got = cumulative_before(df.repartition(7), ["k"], ["x"]).select("k", "x", "before")
    w = Window.partitionBy("k").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "x", F.coalesce(F.sum("cnt").over(w), F.lit(0)).alias("before"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_positions_and_hot_value_chunking(spark):
    # one value holds a third of the rows; chunked expansion keeps positions exact
    vals = [1.0] * 40 + [float(i) for i in range(2, 82)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    pos = global_positions(df, "x")
    pts = expand_positions(pos, chunk=7).select("i", "x").orderBy("i").collect()
    assert [r["i"] for r in pts] == list(range(len(vals)))
    assert [r["x"] for r in pts] == sorted(vals)


def test_running_sums_carry_across_batches(spark):
    """The in-place local prefix streams each range partition in Arrow
    batches; with 7-row batches the per-key totals must carry over. Keys
    include a null, the order is descending, weights are uneven."""
    import pandas as pd
    from pyspark.sql import functions as F

    from loanlens.operators.quantiles import cumulative_before
    rows = [(k, float(x), (x * 7 + i) % 5 + 1)
            for i, k in enumerate(["a", "b", None, "c"]) for x in range(40)]
    df = spark.createDataFrame(rows, "g string, x double, w long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = cumulative_before(df, ["g"], [F.col("x").desc()], weight="w",
                                out="before").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pdf = pd.DataFrame(rows, columns=["g", "x", "w"]).sort_values(["g", "x"],
                                                                  ascending=[True, False])
    pdf["before"] = pdf.groupby("g", dropna=False)["w"].cumsum() - pdf["w"]
    key = lambda d: d.fillna({"g": "<null>"}).set_index(["g", "x"])["before"].sort_index()
    assert key(got).to_dict() == key(pdf).to_dict()


def test_no_single_partition_sort_of_rows(spark):
    """Without a key nothing but the small table of partition totals may be
    gathered in one partition."""
    df = spark.createDataFrame([(float(k),) for k in range(500)], "x double").repartition(6)
    plan = global_positions(df, "x")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Exchange SinglePartition")
    assert len(above) <= 2
    if len(above) == 2:
        assert "__ptot0" in above[1].split("\n")[1]


def test_null_group_and_all_nan_column(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, nan), ("a", 3.0, nan), (None, 5.0, nan), (None, nan, nan)],
                               "g string, x double, y double")
    got = {r["g"]: r["median"] for r in quantiles_wide(df, ["x"], [0.5], ["median"], ["g"]).collect()}
    assert got == {"a": 2.0, None: 5.0}
    assert quantiles_wide(df, ["y"], [0.5], ["median"]).count() == 0


# ------------------------------------------- plans that move no raw row -----
@pytest.fixture()
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows_shuffled(df):
    """Rows that the shuffles over the scan wrote, from the run's own metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("kind", ["grid", "one", "by", "box", "fliers"])
def test_only_partial_counts_are_shuffled(spark, no_auto_broadcast, kind):
    n = 40_000
    df = spark.range(0, n, 1, 4).selectExpr("id as RespondentID", "cast(id as double) as x", "cast(id % 977 as double) as y",
                                            "concat('g', id % 3) as g")
    made = {"grid": lambda: histogram.histogram_grid(df, ["x", "y"], 30), "one": lambda: histogram.histogram(df, "x", 30),
            "by": lambda: histogram.histogram_by(df, "x", "g", 30), "box": lambda: distribution.box_stats(df, "g", "x"),
            "fliers": lambda: distribution.box_fliers(df, "g", "x")}[kind]()
    assert rows_shuffled(made) < n / 10


def test_many_groups_take_the_counted_path(spark):
    """More groups than may be broadcast: the same results."""
    df = spark.range(3000).selectExpr("concat('g', id % 40) as g", "cast((id * 37) % 211 as double) as x")
    for few, many in ((histogram.histogram_by(df, "x", "g", 12), histogram.histogram_by(df, "x", "g", 12, small=3)),
                      (distribution.box_stats(df, "g", "x"), distribution.box_stats(df, "g", "x", small=3)),
                      (distribution.box_fliers(df, "g", "x", whis=0.1), distribution.box_fliers(df, "g", "x", whis=0.1, small=3))):
        a, b = sorted(map(tuple, few.collect())), sorted(map(tuple, many.select(few.columns).collect()))
        assert a == b and a


def test_approximate_median_rank_error_in_one_pass(spark):
    n = 60_000
    df = spark.range(n).selectExpr("cast(pow(id * 7919 % 60013, 1.5) as double) as a",
                                   "if(id % 5 = 0, null, cast(id % 1000 as double)) as b",
                                   "if(id % 7 = 0, double('NaN'), cast((id * 31) % 50021 as double)) as c", "id as d")
    approximate = clean.fit_medians(df, ["a", "b", "c"], exact=False)
    assert set(approximate) == {"b", "c"}  # the columns with nulls or NaN
    for c, m in approximate.items():
        x = np.sort([r[0] for r in df.select(c).collect() if r[0] is not None and r[0] == r[0]])
        low, high = np.searchsorted(x, m, "left"), np.searchsorted(x, m, "right")
        middle = len(x) / 2
        assert low - len(x) / clean.ACCURACY - 1 <= middle <= high + len(x) / clean.ACCURACY + 1
    exact = clean.impute_median(df, ["a", "b", "c"])
    rough = clean.impute_median(df, ["a", "b", "c"], exact=False)
    assert rough.where("b is null or isnan(c)").count() == exact.where("b is null or isnan(c)").count() == 0


def test_label_codes_model(spark, tmp_path):
    from pyspark.ml.feature import StringIndexerModel
    df = spark.createDataFrame([("b", 1, "x"), ("a", 2, None), (None, 2, "nan"), ("c", 1, "x")], "k string, n int, m string")
    model = clean.fit_label_codes(df, ["k", "n", "m", "absent"])
    model.write().overwrite().save(str(tmp_path / "codes"))
    loaded = StringIndexerModel.load(str(tmp_path / "codes"))
    want = [("b", 1, "x", 1, 0, 1), ("a", 2, None, 0, 1, 0), (None, 2, "nan", 3, 1, 0), ("c", 1, "x", 2, 0, 1)]
    for m in (None, model, loaded):
        got = clean.label_encode(df, ["k", "n", "m"], model=m)
        assert got.columns == ["k", "n", "m", "k_Enc", "n_Enc", "m_Enc"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    other = clean.label_encode(spark.createDataFrame([("zz", 7)], "k string, n int"), ["k", "n"], model=loaded)
    assert tuple(other.first()) == ("zz", 7, 4, 2)  # unseen: the number of labels
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    df.write.parquet(str(tmp_path / "in"))
    stream = clean.label_encode(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k", "n", "m"], model=loaded)
    (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(map(str, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))) == sorted(map(str, want))
    assert clean.label_encode(df, ["absent"]).columns == df.columns
