"""SimHash near-duplicates: fingerprints, then a tiled exact comparison.

Every pair of distinct fingerprints within the radius is found. Fingerprints
are dealt into tiles by population count; a pair of tiles whose counts differ
by more than the radius is never formed, because two words at Hamming distance
d have population counts that differ by at most d. Inside a pair of tiles the
same test runs on 16-bit quarters: rows are ordered by the quarters' counts,
cut into blocks, and two blocks are compared (numpy exclusive-or and bit
counts) only if the gaps between their quarter counts sum to the radius or
less.

Equal fingerprints are merged before any comparison, and each pair of tiles
returns a spanning forest of its links instead of the links, so a group of
copies of any size costs no more than its distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import batches, stored, text_bytes
from loanlens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Least and most rows of a tile. Between them a tile has a 64th of the
#: distinct fingerprints, so that each goes to a few dozen pairs of tiles
#: whatever their number, and a pair of tiles stays a short task.
TILE_ROWS = (16_384, 262_144)
BLOCK = 512
SEED = 42
#: Shingles of a text that are counted at a time.
SLICE = 1 << 16

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_POSITION = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(data: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes: bit 1 where over half of the
    shingles' XXH64 values have it; no words: 0."""
    tokens = data.lower().split() if data else []
    if not tokens:
        return 0
    if len(tokens) < shingle_words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(islice(tokens, k, None) for k in range(shingle_words))))
    digests, n, ones = map(xxhash.xxh64_digest, shingles, repeat(SEED)), 0, 0
    while part := b"".join(islice(digests, SLICE)):  # a long text is counted in slices
        hashes = np.frombuffer(part, dtype=np.uint8).reshape(-1, 8)
        n += len(hashes)
        if len(hashes) > 96:
            seen = np.bincount((hashes + _POSITION).ravel(), minlength=2048).reshape(8, 256)
            ones = ones + (seen @ _BIT_OF_BYTE).ravel()
        else:
            ones = ones + np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n)
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id long, fp long) for every row; null or wordless text: fp 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(schema, (
            [b.column(0), [fingerprint(t, shingle_words) for t in b.column(1).to_pylist()]]
            for b in it))

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
            .mapInArrow(run, "doc_id long, fp long"))


class Forest:
    """Union-find over positions 0..n-1 with whole arrays of links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up


def _ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints ordered by the population counts of their quarters."""
    counts = np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    return values[order], counts[order]


def _boxes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(counts), BLOCK)
    return np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (node, root) arrays, of the links between the
    distinct uint64 fingerprints of ``a`` and ``b`` (None: within ``a``)."""
    one = b is None
    a, counts_a = _ordered(a)
    b, counts_b = (a, counts_a) if one else _ordered(b)
    if not len(a) or not len(b):
        return a[:0], a[:0]
    forest, shift = Forest(len(a) + (0 if one else len(b))), 0 if one else len(a)
    low_a, high_a = _boxes(counts_a)
    low_b, high_b = _boxes(counts_b)
    xor = np.empty((BLOCK, BLOCK), np.uint64)
    ones = np.empty((BLOCK, BLOCK), np.uint8)
    for k in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[k], low_a[k] - high_b)).sum(axis=1)
        x = a[k * BLOCK:(k + 1) * BLOCK, None]
        for m in np.flatnonzero(gap <= radius):
            if one and m < k:
                continue
            y = b[None, m * BLOCK:(m + 1) * BLOCK]
            view = xor[:x.shape[0], :y.shape[1]]
            bits = ones[:x.shape[0], :y.shape[1]]
            np.bitwise_xor(x, y, out=view)
            np.bitwise_count(view, out=bits)
            i, j = np.nonzero(bits <= radius)
            if len(i):
                forest.link(i + k * BLOCK, j + m * BLOCK + shift)
    everything = a if one else np.concatenate([a, b])
    moved = np.flatnonzero(forest.parent != np.arange(len(everything)))
    return everything[moved], everything[forest.parent[moved]]


def links(distinct: DataFrame, radius: int = MAX_BITS, tile_rows: int | None = None) -> DataFrame:
    """(u long, v long): links whose components are those of all pairs of
    ``distinct`` fingerprints (column fp) within ``radius`` bits. Tile numbers
    come from counts per population count (65 rows at most)."""
    counted = distinct.withColumn("p", F.bit_count("fp").cast("int"))
    counts = {r["p"]: r["n"] for r in counted.groupBy("p").agg(F.count("*").alias("n")).collect()}
    tile_rows = tile_rows or min(max(sum(counts.values()) // 64, TILE_ROWS[0]), TILE_ROWS[1])
    sizes = {p: -(-n // tile_rows) for p, n in counts.items()}
    tiles = F.array([F.lit(sizes.get(p, 0)) for p in range(65)])
    dealt = (
        counted
        .withColumn("s", F.pmod(F.xxhash64("fp"), F.element_at(tiles, F.col("p") + 1)).cast("int"))
        .withColumn("p2", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - radius),
                                               F.least(F.lit(64), F.col("p") + radius))))
        .withColumn("n2", F.element_at(tiles, F.col("p2") + 1))
        .where("n2 > 0")
        .withColumn("s2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
        .withColumn("one", F.struct("p", "s"))
        .withColumn("two", F.struct(F.col("p2").alias("p"), F.col("s2").alias("s")))
        .select(F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high"),
                (F.col("one") <= F.col("two")).alias("is_low"), "fp"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        low = pdf["is_low"].to_numpy()
        same = pdf["same"].iloc[0]
        a = np.ascontiguousarray(fp[low]).view(np.uint64)
        b = None if same else np.ascontiguousarray(fp[~low]).view(np.uint64)
        node, root = tile_forest(a, b, radius)
        return pd.DataFrame({"u": node.view(np.int64), "v": root.view(np.int64)})

    # Tasks by number: a pair's cost is in its comparisons, not in its bytes, by
    # which small partitions would be put together.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.select("low", "high", "is_low", "fp", (F.col("low") == F.col("high")).alias("same"))
            .repartition(tasks, "low", "high").groupBy("low", "high").applyInPandas(compare, "u long, v long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, radius: int = MAX_BITS,
                       tile_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id long, fingerprint string (16 hex
    digits), component_id long.

    Documents are linked when their fingerprints differ in ``radius`` bits or
    fewer; component_id is the smallest doc_id that can be reached. Null, empty
    and blank texts have fingerprint 0 and link to one another. Repeated rows
    give repeated results. A null doc_id never becomes a component_id; a
    component of null ids only has a null component_id. An empty table gives
    no rows; other columns of ``docs`` are ignored."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    named = named_fingerprints(marked, radius, tile_rows)
    return (marked.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def named_fingerprints(marked: DataFrame, radius: int, tile_rows: int | None = None) -> DataFrame:
    """(fp, component_id, keeper): for each distinct fingerprint of ``marked``
    (doc_id, fp) its component's smallest doc_id, and the least fingerprint of the
    component that has a row with it (of all its fingerprints if all ids are null)."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius, tile_rows))
    member = (distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    first = F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "fp"))
    least = member.groupBy("root").agg(first.alias("first"))
    return member.join(least, "root").select("fp", F.col("first.least_id").alias("component_id"),
                                             F.col("first.fp").alias("keeper"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
             radius: int = MAX_BITS, tile_rows: int | None = None) -> DataFrame:
    """Rows of ``docs``, all columns: exactly one of each component, that with
    the smallest doc_id (null ids last; of its rows the one with the least
    fingerprint, and one of those that have both in common)."""
    at, spot = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = b.column(at).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([fingerprint(t, shingle_words) for t in texts], pa.int64())],
                    names=[*b.schema.names, "__fp"])

    marked = stored(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])),
                    "simhash")
    ids = marked[marked.columns[spot]].cast("long")
    named = named_fingerprints(marked.select(ids.alias("doc_id"), F.col("__fp").alias("fp")), radius, tile_rows)
    stay = stored(named.where("fp = keeper").select("fp", "component_id"), "simhash-kept")
    kept = marked.join(stay, (marked["__fp"] == stay["fp"]) & ids.eqNullSafe(stay["component_id"]), "left_semi")
    if not marked.groupBy(id_col, "__fp").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__fp"])
    return kept.drop("__fp")
