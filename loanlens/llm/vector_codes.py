"""Compression of vectors to codes of four bytes: product quantisation with
codebooks refined by Lloyd rounds in integer arithmetic, nearest entries by
Orchard search (``orchard``).

Each round is one pass over the vectors: a task keeps sums and counts of its
parts by codebook entry (bounded by the codebooks, whatever it reads), and one
aggregation adds the tasks' rows. Only codebooks reach the driver: parts x
entries vectors. Integer sums do not depend on how rows are dealt, so a lost
task gives the same codes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stored
from loanlens.llm.orchard import Orchard, exact_type

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BATCH_ROWS = 8192
SALT = 32


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (array of double) of the rows whose vector is neither
    null nor holds a null or non-finite component."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                           F.col(vector_col).cast("array<double>").alias("v"))
            .where(v.isNotNull() & ~F.coalesce(bad, F.lit(False))))


def scaled(x: Column) -> Column:
    return F.floor(x * F.lit(float(SCALE)))


class Codebooks:
    """``parts`` codebooks of integer entries over vectors of ``width``."""

    def __init__(self, books: list[np.ndarray], width: int, number: type):
        self.books, self.width, self.number = books, width, number

    def digest(self) -> str:
        text = ",".join(str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(text.encode()).hexdigest()

    def parts(self, column: pa.ListArray) -> list[np.ndarray]:
        """The integer parts of the vectors of one batch."""
        flat = column.flatten().to_numpy(zero_copy_only=False)
        whole = np.floor(flat * float(SCALE)).astype(self.number).reshape(-1, self.width)
        return np.split(whole, len(self.books), axis=1)


def slices(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size, and which of their vectors have the width."""
    for whole in it:
        for k in range(0, whole.num_rows, BATCH_ROWS):
            b = whole.slice(k, BATCH_ROWS)
            yield b, np.asarray(b.column("v").value_lengths().to_numpy(zero_copy_only=False) == width)


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the ``entries`` smallest ids' vectors (ties: by components;
    null ids last). None without vectors."""
    seeds = (kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect())
    if not seeds:
        return None
    width = len(seeds[0]["v"])
    if width == 0 or width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    first = np.array([r["v"] for r in seeds if len(r["v"]) == width], np.float64)
    most = (kept.where(F.size("v") == width)
            .agg(F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("m")).first()["m"])
    number = exact_type(int(most * SCALE) + 1, width)
    whole = np.floor(first * SCALE).astype(number)
    return Codebooks([np.ascontiguousarray(b) for b in np.split(whole, parts, axis=1)], width, number)


def refined(kept: DataFrame, codes: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, then each entry becomes
    the floor of its parts' mean; an entry without parts stays."""
    spark = kept.sparkSession
    shared = spark.sparkContext.broadcast(codes)
    step = codes.width // len(codes.books)
    names = [f"s{k}" for k in range(step)]
    schema = pa.schema([(n, pa.int64()) for n in ("part", "entry", "n", *names)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        orchards = [Orchard(book) for book in codes.books]
        sums = [np.zeros((len(o.entries), step), np.int64) for o in orchards]
        counts = [np.zeros(len(o.entries), np.int64) for o in orchards]
        for b, fits in slices(it, codes.width):
            parts = codes.parts(b.filter(pa.array(fits)).column("v"))
            for part, orchard, total, count in zip(parts, orchards, sums, counts):
                part = np.ascontiguousarray(part)
                entry, _ = orchard.nearest(part)
                order = np.argsort(entry, kind="stable")
                used, starts = np.unique(entry[order], return_index=True)
                if len(used):
                    total[used] += np.add.reduceat(part[order].astype(np.int64), starts, axis=0)
                    count += np.bincount(entry, minlength=len(count))
        for k, (total, count) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(count)
            columns = [np.full(len(used), k), used, count[used], *total[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns],
                                             schema=schema)

    # As decimals: a hot entry's sum over all rows may leave 64 bits.
    total = [F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in ("n", *names)]
    rows = (kept.select("v").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))
            .groupBy("part", "entry").agg(*total).collect())
    books = [book.copy() for book in codes.books]
    for r in rows:
        books[r["part"]][r["entry"]] = [int(r[n]) // int(r["n"]) for n in names]
    return Codebooks(books, codes.width, codes.number)


def encode(kept: DataFrame, codes: Codebooks) -> DataFrame:
    """vec_id, label, code, error of each row."""
    shared = kept.sparkSession.sparkContext.broadcast(codes)
    given = kept.schema["label"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        orchards = [Orchard(book) for book in codes.books]
        for b, fits in slices(it, codes.width):
            parts = codes.parts(b.filter(pa.array(fits)).column("v"))
            found = [o.nearest(np.ascontiguousarray(p)) for o, p in zip(orchards, parts)]
            entry = np.stack([e for e, _ in found], axis=1).astype(">u2")
            error = np.sum([d for _, d in found], axis=0).astype(np.int64)
            names = [bytes(row.astype(np.uint8)).hex() for row in entry]
            places = np.where(fits, np.cumsum(fits) - 1, -1)
            at = pa.array(places, mask=~fits)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(names, pa.string()).take(at),
                 pa.array(error, pa.int64()).take(at)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {given}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and label_error: the error summed over its label's rows, null
    labels together. Rows meet their label's sum under one of SALT keys, so a
    label of most rows is spread over tasks."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salts = F.explode(F.array([F.lit(k) for k in range(SALT)]))
    right = sums.select(F.col("label").alias("of"), "label_error", salts.alias("salt"))
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    return (left.join(right, left["label"].eqNullSafe(right["of"]) & (left["salt"] == right["salt"]), "left")
            .select("vec_id", "label", "code", "error", "label_error"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(one row per kept row of ``vectors``: vec_id long, label, code string (two
    hex digits a part), error long (squared distance to the code's entries),
    label_error long; the final codebooks).

    Rows whose vector is null or holds a null or non-finite component are
    left out. A vector whose length differs from that of the smallest id's keeps its row
    with null code and error and teaches nothing. Ties of distance go to the lower
    index, ties of seed ids are ordered by components; null ids come last among the
    seeds. Repeated rows count each time. An empty table has no codebooks and gives
    no rows; other columns are ignored. Raises if the vectors can't be cut into equal
    parts, or if squared distances don't fit 64 bits."""
    if entries > 256:
        raise ValueError("a code has one byte a part")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    codes = first_codebooks(kept, parts, entries)
    if codes is None:
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"))
        return none, None
    for _ in range(rounds):
        codes = refined(kept, codes)
    return with_label_error(stored(encode(kept, codes), "vector-codes")), codes


def code_digest(coded: DataFrame, codes: Codebooks | None) -> DataFrame:
    """The rows of ``compress`` with the digest of its codebooks' components."""
    return coded.select("vec_id", "code", "error", "label_error",
                        F.lit(codes.digest() if codes else "").alias("codebooks_sha256"))
