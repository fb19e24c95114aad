import math
import zlib

import numpy as np
from loanlens.llm import quality
from loanlens.llm.common import read_table

LABELS = "doc_id long, quality int, toxic int"


def test_buckets_count_repeats_and_ignore_nothing():
    assert len(quality.buckets(b"a b a b")) == 7
    assert len(quality.buckets(None)) == len(quality.buckets(b" \t")) == 0
    assert len(quality.buckets("é!! ###".encode())) == 5


def test_ratios_equal_brute_force(spark, make_docs):
    rows = [(k, f"good words {k % 3} here") for k in range(30)] + [(100 + k, "### junk $$$") for k in range(30)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(k, 0, 0) for k in range(100, 110)], LABELS)
    ids, share = quality.target_ids(labels)
    chosen = {r.doc_id for r in ids.collect()}
    assert chosen == {k for k in range(20) if zlib.crc32(str(k).encode()) % 4 != 2} and share == 20 / 30
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for k, text in rows:
        seen = np.bincount(quality.buckets(text.encode()), minlength=quality.BUCKETS)
        raw += seen
        target += seen * (k in chosen)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = quality.log_ratios(make_docs(rows).repartition(5), ids)
    assert np.allclose(got, want)
    scored = quality.score_documents(make_docs(rows), got).collect()
    for r, (_, text) in zip(sorted(scored), sorted(rows)):
        assert math.isclose(r.log_weight, want[quality.buckets(text.encode())].sum(), abs_tol=1e-9)


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 1e-300, 1.0, 7.5, np.inf])
    assert (np.diff(quality.ordered_bits(x)) >= 0).all()


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(-2 ** 63, 2 ** 63 - 1, 300)] + [5, 5, 5, -1, 0]
    table = spark.createDataFrame([(v,) for v in values], "bits long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 150, 304, 305):
        assert quality.kth_largest(table, k) == ordered[k - 1]
    assert quality.kth_largest(table, 306) is None


def test_gumbel_draws_in_proportion_to_weights(spark, make_docs):
    """The share of draws of one of two documents follows their weights."""
    ratios = np.zeros(quality.BUCKETS)
    ratios[quality.buckets(b"x")] = math.log(3.0)
    wins = 0
    for seed in range(60):
        rows = quality.score_documents(make_docs([(1, "x"), (2, "y")]), ratios, seed=seed).collect()
        wins += max(rows, key=lambda r: r.key).doc_id == 1
    assert 33 <= wins <= 56


def test_held_out_selection(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.resample(read_table(spark, sf, "documents"), read_table(spark, sf, "labels")).collect()
    good = {r.doc_id: (r.quality == 1 and r.toxic == 0) for r in read_table(spark, sf, "labels").collect()}
    tested = [r for r in rows if r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    weight = np.array([r.log_weight for r in tested])
    is_good = np.array([good[r.doc_id] for r in tested])
    order = weight.argsort().argsort() + 1
    n = is_good.sum()
    auc = (order[is_good].sum() - n * (n + 1) / 2) / n / (len(tested) - n)
    assert auc > 0.8
    chosen = np.array([r.selected for r in tested])
    assert chosen[is_good].mean() > 0.85 and chosen[~is_good].mean() < 0.4


def test_odd_rows(spark, make_docs, odd_rows, clashing):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, None), (9, None, None), (None, 1, 0), (5, 1, 0)], LABELS)
    docs = clashing(make_docs(odd_rows))
    rows = quality.resample(docs, clashing(labels), k=3).collect()
    assert len(rows) == len(odd_rows) and sum(r.selected for r in rows) >= 3
    assert all(r.n_grams == 0 and r.log_weight == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert sum(r.selected for r in quality.resample(docs, labels, k=0).collect()) == 0
    assert all(r.selected for r in quality.resample(docs, labels, k=99).collect())
    none = spark.createDataFrame([], LABELS)
    assert all(r.selected for r in quality.resample(docs, none).collect())
    assert quality.resample(make_docs([]), labels).count() == 0
