"""Exact deduplication by a streaming query with keyed state on disk.

Rows stream as (digest, identifier, locator) through a keyed aggregate whose
state never expires and lives in RocksDB, with its changes in the stream's
checkpoint in the shared folder. For each digest the state keeps the smallest
identifier, the content's locator (source file and row key) and the number of
rows. A new micro-batch only touches the digests it brings. Once the input is
used up the state is read back from the checkpoint as a table.

A digest met more than once is a hit. The texts behind all hits are then
compared whole: rows of hit digests are grouped by their full normalised text.
Where one digest stands for several texts, each text is a group of its own.
Other texts are not moved: the first bits of the hits' digests, a table of
bounded size, leave them out where they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import shared_folder, stored

#: Files of the digest table that a micro-batch takes at most.
FILES_PER_BATCH = 4096
#: Parts that the rows of one digest are spread over while texts are fetched.
SALTS = 16

#: Bits of a digest by which rows are sifted before hits are fetched: the table
#: of hit prefixes has 2^PREFIX_BITS rows at most, so it may be broadcast.
PREFIX_BITS = 20

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def prefix(digest: Column) -> Column:
    """The first PREFIX_BITS bits of a digest (of all its bits if it has fewer)."""
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    spare = F.greatest(F.lit(0), F.length(F.substring(digest, 1, 4)) * 8 - PREFIX_BITS)
    return F.floor(head / F.pow(F.lit(2.0), spare)).cast("int")


def hit_prefixes(hits: DataFrame) -> DataFrame:
    """(prefix) of the digests met more than once: bounded by PREFIX_BITS."""
    return F.broadcast(hits.select(prefix(F.col("digest")).alias("prefix")).distinct())


def stream_state(spark: SparkSession, folder: str, schema, files_per_batch: int = FILES_PER_BATCH,
                 checkpoint: str | None = None) -> DataFrame:
    """Run the digest table in ``folder`` through the stateful query and return
    the state: digest, n, and first (struct of the row that stays). With an
    earlier run's ``checkpoint`` only files that are new are read."""
    checkpoint = checkpoint or shared_folder(spark, "dedup-state")
    session = spark.newSession()  # the stream's settings stay its own
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Many small stores: no disk space taken ahead of need.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    keyed = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    (keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return (session.read.format("statestore").load(checkpoint)
            .select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"),
                    F.col("value.min").alias("first")))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              digest: Callable[[Column], Column] = sha256_digest,
              files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per row of ``docs``: doc_id long, keep_id long, group_size long,
    kept boolean, text_sha256 string.

    Texts are equal when they are after each run of white space (space, U+0009
    to U+000D) has become one space; null counts as empty. The row with the
    smallest doc_id stays, a null doc_id after all others; of rows with equal
    text and doc_id one stays. An empty table gives no rows; other columns are
    ignored."""
    spark = docs.sparkSession
    ident = F.col(id_col).cast("long")
    base = docs.select(ident.alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id",
                     F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file"))
    folder = shared_folder(spark, "dedup-digests")
    (base.select(digest(F.col("text")).alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"), first.alias("first"))
     .write.parquet(folder))
    table = spark.read.parquet(folder)
    state = stream_state(spark, folder, table.schema, files_per_batch)
    hits = stored(state.where("n > 1"), "dedup-hits")
    # A row whose digest is no hit is its own group; no other row is moved.
    prefixes = hit_prefixes(hits)
    marked = table.withColumn("prefix", prefix(F.col("digest")))
    spread = hits.select("digest", "n", F.col("first").alias("keeper"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    moved = (marked.join(prefixes, "prefix", "left_semi")
             .withColumn("salt", F.pmod(F.xxhash64("first.row"), F.lit(SALTS)).cast("int"))
             .join(spread, ["digest", "salt"], "left"))
    alone = (marked.join(prefixes, "prefix", "left_anti")
             .withColumn("n", F.lit(None).cast("long")).withColumn("keeper", F.lit(None).cast(table.schema["first"].dataType)))
    columns = ("digest", "sha", "first", "n", "keeper")
    decided = moved.select(*columns).unionByName(alone.select(*columns)).select(
        F.col("first.doc_id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("first.doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("keeper.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "digest")
    return _with_checked_bytes(base, decided, hits, digest).drop("digest")


def _with_checked_bytes(base: DataFrame, decided: DataFrame, found: DataFrame,
                        digest: Callable[[Column], Column]) -> DataFrame:
    """``decided`` after the full texts of all hits were compared."""
    every = base.withColumn("digest", digest(F.col("text")))
    keyed = (every.withColumn("prefix", prefix(F.col("digest")))
             .join(hit_prefixes(found), "prefix", "left_semi").drop("prefix"))
    hits = found.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    texts = (keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
             .join(hits, ["digest", "salt"], "left_semi")
             .groupBy("digest", "text").agg(F.count("*").alias("n")))
    clashes = stored(texts.groupBy("digest").agg(F.count("*").alias("texts"))
                     .where("texts > 1").select("digest"), "dedup-clashes")
    if clashes.isEmpty():
        return decided
    apart = keyed.join(clashes, "digest", "left_semi").select(
        "digest", "doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    groups = apart.groupBy("digest", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = (apart.groupBy("digest", "text", "doc_id", "text_sha256").agg(F.count("*").alias("copies"))
            .join(groups, ["digest", "text"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    "text_sha256", "digest"))
    return decided.join(clashes, "digest", "left_anti").select(same.columns).unionByName(same)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of
    equal texts. Rows whose digest has no prefix of a repeated text stay where
    they are; only the others are moved."""
    names = docs.columns
    found = stored(decisions(docs, id_col, text_col).select(
        F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"), "group_size", "kept"), "dedup-decided")
    repeated = found.where("group_size > 1")
    hits = F.broadcast(repeated.select(prefix(F.unhex("stay_sha")).alias("prefix")).distinct())
    sha = F.sha2(normalised(docs[text_col]), 256)
    keyed = docs.select("*", sha.alias("__sha"), prefix(F.unhex(sha)).alias("__prefix"))
    alone = keyed.join(hits, keyed["__prefix"] == hits["prefix"], "left_anti")
    moved = keyed.join(hits, keyed["__prefix"] == hits["prefix"], "left_semi")
    stay = found.where("kept").select("stay_id", "stay_sha")
    same = moved[id_col].cast("long").eqNullSafe(stay["stay_id"]) & (moved["__sha"] == stay["stay_sha"])
    kept = moved.join(stay, same, "left_semi")
    # A row that stays may be there several times, with its doc_id.
    if not repeated.groupBy("stay_id", "stay_sha").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__sha"])
    return alone.select(names).unionByName(kept.select(names))
