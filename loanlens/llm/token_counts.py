"""Token counts: an exact histogram of encoded lengths, and suffix sums over
it that answer totals, quantiles and truncated totals for every context limit.

Documents are counted where they are encoded and aggregated by length before
anything is shuffled, so the histogram has one row for each distinct length.
The sums run in two levels, within ranges of ``RANGE`` lengths and over the
ranges, so no task orders the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.llm.bpe import coder, utf8_text
from loanlens.llm.common import batches, stored, text_bytes

RANGE = 4096


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens long) for every row; null and empty texts have 0."""
    schema = pa.schema([("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = coder(ranks_path, pattern)
        yield from batches(schema, (
            [[encoder.count(utf8_text(t)) for t in b.column(0).to_pylist()]] for b in it))
        encoder.rest()

    return docs.select(text_bytes(text_col).alias("data")).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens long, n_docs long): documents of each encoded length."""
    return (encoded_lengths(docs, ranks_path, pattern, text_col)
            .groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def context_limits(histogram: DataFrame) -> DataFrame:
    """The answers at each length that occurs, taken as a context limit:

    n_tokens, n_docs; docs_over and tokens_over: documents longer than the
    limit and their tokens (suffix sums); docs_within and tokens_within: the
    rest; truncated_tokens: tokens left when every document is cut at the
    limit; padded_tokens: tokens when each document within it is filled up to
    it and longer ones are cut; quantile: share of documents within the limit.

    Between two rows docs_over and tokens_over do not change, so the table
    answers every limit (``truncated_total``). No documents: no rows."""
    h = stored(histogram.withColumn("part", F.floor(F.col("n_tokens") / RANGE)), "lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    ranges = h.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = ranges.select(
        "part", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("docs").over(everything).alias("all_docs"), F.sum("tokens").over(everything).alias("all_tokens"))
    over = (Window.partitionBy("part").orderBy(F.col("n_tokens").desc())
            .rowsBetween(Window.unboundedPreceding, -1))
    x = h.join(ranges, "part").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(over), F.lit(0))).alias("docs_over"),
        (F.col("later_tokens") + F.coalesce(F.sum(tokens).over(over), F.lit(0))).alias("tokens_over"))
    return x.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over"))
        .alias("truncated_tokens"),
        (F.col("n_tokens") * F.col("all_docs")).alias("padded_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"))


def truncated_total(limits: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, any number from 0."""
    below = limits.where(F.col("n_tokens") <= limit).orderBy(F.col("n_tokens").desc()).first()
    if below is not None:
        return below["tokens_within"] + limit * below["docs_over"]
    row = limits.agg(F.sum("n_docs")).first()
    return limit * (row[0] or 0)


def length_quantile(limits: DataFrame, q: float) -> int | None:
    """The least length that a share of at least ``q`` of the documents has
    or is below; None without documents."""
    row = limits.where(F.col("quantile") >= q).orderBy("n_tokens").first()
    return None if row is None else row["n_tokens"]
