"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.session import ensure_checkpoint_dir, table_path

#: Bytes of a word (0-9, a-z after lowering, and every byte of a non-ASCII
#: character) map to themselves, A-Z to a-z, all others to a space. After it
#: ``bytes.split()`` yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A
    else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
    else 0x20
    for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    with files that outlive any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes; null has none."""
    return data.translate(WORD_TABLE).split() if data else []


def text_bytes(text: str = "text"):
    """The text column as UTF-8 bytes (null stays null)."""
    return F.col(text).cast("string").cast("binary")


def with_row_key(docs: DataFrame, columns: dict) -> DataFrame:
    """Only the named columns, whatever else (clashing names too) ``docs`` has."""
    return docs.select([c.alias(name) for name, c in columns.items()])


def batches(schema: pa.Schema, rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """Column lists to record batches of ``schema``."""
    for cols in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
