"""Quality selection by importance resampling (Xie et al., "Data Selection for
Language Models via Importance Resampling", 2023).

Two bags of hashed n-grams of one and two tokens (words, and runs of
punctuation) are generative models of
the target and of the raw text. A document's log importance weight is the sum
over its n-grams of log target share less log raw share. Gumbel noise, drawn
from the id, is added and the k largest sums are the sample: drawing without
replacement in proportion to the weights.

Raw counts cover all documents. The target is a sample of labelled rows of a
documented bound (``TARGET_DOCS`` expected).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import batches, stored, text_bytes

BUCKETS = 65_536
TARGET_DOCS = 20_000
SMOOTHING = 1.0
SEED = 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Words, and runs of other characters that are no white space.
tokens_of = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+").findall


def buckets(data: bytes | None, n: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams of one and two tokens of a text, repeats
    included."""
    tokens = tokens_of(data) if data else []
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    grams = np.concatenate([h, h[:-1] * np.uint64(31) + h[1:] + np.uint64(1 << 33)]) * _MIX
    return ((grams >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def target_ids(labels: DataFrame, target_docs: int = TARGET_DOCS) -> tuple[DataFrame, float]:
    """(id) of a sample of the labelled documents of good quality that are not
    toxic, and their share of all labelled documents. Rows whose id's CRC-32
    is 2 modulo 4 are left for testing. Nulls in a label are not good."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    flagged = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(good, F.lit(False)).alias("good"))
    row = flagged.agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good")).first()
    n, n_good = row["n"], row["good"] or 0
    chance = min(1.0, target_docs / max(1, n_good * 3 / 4))
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1_000_000)) / 1_000_000.0 < chance
    ids = flagged.where(F.col("good") & learn & drawn).select("doc_id").distinct()
    return ids, (n_good / n if n else 1.0)


def log_ratios(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               n: int = BUCKETS) -> np.ndarray:
    """log target share - log raw share of each bucket. A task returns one row
    a bucket at most, so no more than tasks x buckets rows are shuffled and
    ``n`` rows reach the driver."""
    schema = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for whole in it:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                grams = [buckets(data, n) for data in b.column(0).to_pylist()]
                raw += np.bincount(np.concatenate(grams), minlength=n)
                good = [g for g, is_target in zip(grams, b.column(1).to_pylist()) if is_target]
                if good:
                    target += np.bincount(np.concatenate(good), minlength=n)
        some = np.flatnonzero(raw)
        yield from batches(schema, [[some, raw[some], target[some]]])

    # The sample is bounded by TARGET_DOCS ids, so it may be broadcast.
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data")).join(
        F.broadcast(targets.withColumn("is_target", F.lit(True))), "doc_id", "left")
    rows = (marked.select("data", F.coalesce("is_target", F.lit(False)).alias("is_target"))
            .mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.full(n, SMOOTHING), np.full(n, SMOOTHING)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    bits = np.ascontiguousarray(x + 0.0, np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def score_documents(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                    seed: int = SEED) -> DataFrame:
    """doc_id long, n_grams long, log_weight double, key double, bits long (the
    key's order as an integer) for every row. The Gumbel noise comes from the
    id alone, so a lost task draws the same again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()),
                        ("key", pa.float64()), ("bits", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value

        def rows():
            for b in it:
                found = [buckets(t, len(ratio)) for t in b.column(1).to_pylist()]
                weight = np.array([ratio[g].sum() for g in found], np.float64)
                uniform = (b.column(2).to_numpy(zero_copy_only=False).astype(np.float64) + 0.5) / 2.0 ** 52
                key = weight - np.log(-np.log(uniform))
                yield [b.column(0), [len(g) for g in found], weight, key, ordered_bits(key)]
        yield from batches(schema, rows())

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"),
                        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 12).alias("draw"))
            .mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double, bits long"))


def kth_largest(scored: DataFrame, k: int) -> int | None:
    """The k-th largest ``bits``, found 16 bits at a time: each of four
    aggregations returns 65,536 rows at most. None if there are fewer rows."""
    fixed = None
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("bits", shift)
        part = scored if fixed is None else scored.where(F.shiftright("bits", shift + 16) == fixed)
        counts = part.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["digit"]):
            if r["n"] >= k:
                fixed = r["digit"]
                break
            k -= r["n"]
        else:
            return None
    return fixed


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id",
             text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id long, n_grams long, log_weight
    double, key double (weight with noise), selected boolean: whether it is of
    the k with the largest keys. ``k`` by default: the good share of the
    labelled documents, of all documents.

    Null, empty and blank texts have no n-grams and weight 0. Rows whose
    key equals the k-th largest (repeated rows) are all selected; with k = 0
    none is, with k over the number of rows all are. Without labels all ratios
    rest on the smoothing. An empty table gives no rows; other columns are
    ignored."""
    targets, good_share = target_ids(labels)
    scored = stored(score_documents(docs, log_ratios(docs, targets, id_col, text_col), id_col, text_col, seed),
                    "quality")
    if k is None:
        k = round(good_share * scored.count())
    cut = kth_largest(scored, k) if k > 0 else None
    chosen = F.lit(k > 0) if cut is None else F.col("bits") >= cut
    return scored.select("doc_id", "n_grams", "log_weight", "key", chosen.alias("selected"))
