"""Derived tables are known by the content of their input, shared by the
sessions of an application, and gone when nobody holds them."""

import os
import shutil
import subprocess
import sys

import pytest
from loanlens import store
from loanlens.sources.customers import customers, load_customers
from loanlens.sources.fixtures import profiles

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def own_copy(tmp_path, sf0001):
    folder = tmp_path / "sf"
    folder.mkdir()
    for t in ("customer", "nation", "orders", "lineitem", "events"):
        shutil.copyfile(f"{sf0001}/{t}.parquet", folder / f"{t}.parquet")
    return str(folder)


def test_a_changed_file_is_seen(spark, own_copy):
    before = customers(spark, own_copy)
    n = before.count()
    medians = store.stored_value("medians", spark, own_copy, lambda: None)
    assert customers(spark, own_copy).inputFiles() == before.inputFiles()
    fewer = spark.read.parquet(f"{own_copy}/customer.parquet").toPandas().head(n - 40)
    fewer.to_parquet(f"{own_copy}/customer.parquet")
    spark.catalog.refreshByPath(own_copy)
    after = customers(spark, own_copy)
    assert after.count() == n - 40 and set(after.inputFiles()) != set(before.inputFiles())
    assert load_customers(spark, own_copy).count() == n - 40
    assert before.count() == n  # who holds the old table can still read it
    assert medians is None


def test_tables_go_with_the_last_session_that_holds_them(spark, own_copy):
    one, two = spark.newSession(), spark.newSession()
    a, b = profiles(one, own_copy), profiles(two, own_copy)
    assert a.inputFiles() == b.inputFiles()
    path = a.inputFiles()[0].split(":", 1)[-1].replace("//", "/")
    store.release(one)
    assert b.count() > 0 and os.path.exists(path)
    store.release(two)
    assert not os.path.exists(os.path.dirname(path))
    assert profiles(one, own_copy).count() > 0  # made anew
    store.release(one)


def test_a_failed_build_leaves_no_entry(spark, own_copy):
    def fail():
        raise RuntimeError("no table")
    with pytest.raises(RuntimeError):
        store.stored_table("failing", spark, own_copy, fail)
    table = store.stored_table("failing", spark, own_copy, lambda: spark.range(3))
    assert table.count() == 3


def test_the_folder_is_empty_afterwards(tmp_path, sf0001):
    """Tables, checkpoints and streams of an application go when it ends."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from loanlens.session import build_session
import __spark_entry__ as entry
import os
spark = build_session("local[2]", 2)
assert spark.sparkContext.getCheckpointDir().startswith("file:{tmp_path}")
for name in ("kpis", "box_CreditScore_by_MarketingSegment", "csv_customers"):
    assert entry.queries()[name](spark, {sf0001!r}).count() > 0
assert sum(len(f) for _, _, f in os.walk({str(tmp_path)!r})) > 10
if {{stop}}:
    spark.stop()
"""
    for stop in (True, False):
        env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir=file:{tmp_path} pyspark-shell"}
        out = subprocess.run([sys.executable, "-c", code.replace("{stop}", str(stop))], env=env, capture_output=True,
                             text=True, timeout=300)
        assert out.returncode == 0, out.stderr[-2000:]
        left = [os.path.join(d, f) for d, _, files in os.walk(tmp_path) for f in files]
        assert left == [], left[:5]
