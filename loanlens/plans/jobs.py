"""Batch jobs (T1-T3), runnable with spark-submit:

    spark-submit loanlens/plans/jobs.py train    --input DIR --out DIR [--preset full]
    spark-submit loanlens/plans/jobs.py profile  --input DIR --out DIR [--only NAME ...]
    spark-submit loanlens/plans/jobs.py segments --input DIR --out DIR --models DIR
    spark-submit loanlens/plans/jobs.py score    --input FILE --out DIR --models DIR [--format csv]

``--input`` is a folder of the driver-style parquet tables (for ``score``: a
CSV or parquet batch). Every job writes parquet result tables (S3); none
collects row-level data. The customer table is stored once in the shared
checkpoint folder and reused by all analyses of the profiling job (S9)."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from loanlens.plans.table_profile import profile_analyses  # noqa: E402
from loanlens.session import ensure_checkpoint_dir  # noqa: E402
from loanlens.sources.customers import customers, load_customers, read_batch, write_table  # noqa: E402


def training_job(spark: SparkSession, sf_dir: str, out: str, preset: str = "full"):
    """Train the six models on the loaded table and save the artifacts."""
    from loanlens.plans import models as M
    bundle = M.train(load_customers(spark, sf_dir), preset, with_elbow=True)
    M.save_artifacts(bundle, out)
    return bundle


def profiling_job(spark: SparkSession, sf_dir: str, out: str, names=None) -> list[str]:
    """The profiling analyses (all, or ``names``), one parquet result
    table each, from the shared passes of ``table_profile.Profile``. An unknown name
    is an error."""
    analyses = profile_analyses(customers(spark, sf_dir))
    unknown = sorted(set(names or ()) - set(analyses))
    if unknown:
        raise KeyError(f"no such analysis: {', '.join(unknown)}")
    done = list(names or analyses)
    for name in done:
        write_table(analyses[name](), f"{out}/{name}")
    return done


def segment_job(spark: SparkSession, sf_dir: str, out: str, models_dir: str):
    """The trained segment of every customer of the loaded table."""
    from loanlens.plans import models as M
    from loanlens.plans.score import segment_customers
    bundle = M.load_artifacts(spark, models_dir)
    named = segment_customers(load_customers(spark, sf_dir), bundle)
    write_table(named.select("RespondentID", "Cluster", "Cluster_Label"), out)


def scoring_job(spark: SparkSession, batch_path: str, out: str, models_dir: str,
                fmt: str = "parquet", input_fmt: str | None = None):
    """C8 as a job: read an uploaded batch (CSV or parquet), check the
    required columns, score it and write the full scored table."""
    from loanlens.plans import models as M
    from loanlens.plans.score import score
    batch = read_batch(spark, batch_path, fmt=input_fmt)
    write_table(score(batch, M.load_artifacts(spark, models_dir), "batch"), out, fmt)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="loanlens-jobs")
    ap.add_argument("job", choices=["train", "profile", "segments", "score"])
    ap.add_argument("--input", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--models")
    ap.add_argument("--preset", default="full")
    ap.add_argument("--only", nargs="*", help="profile: the analyses to run")
    ap.add_argument("--format", help="score: csv or parquet (default: by the input's suffix)")
    args = ap.parse_args(argv)
    if args.job in ("segments", "score") and not args.models:
        ap.error(f"{args.job} needs --models")
    spark = SparkSession.builder.appName(f"loanlens-{args.job}").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.job == "train":
        training_job(spark, args.input, args.out, args.preset)
    elif args.job == "profile":
        profiling_job(spark, args.input, args.out, args.only)
    elif args.job == "segments":
        segment_job(spark, args.input, args.out, args.models)
    else:
        scoring_job(spark, args.input, args.out, args.models, input_fmt=args.format)


if __name__ == "__main__":
    main()
