"""Periodic runs of words in each text (online dyadic square catching, see
``squares``), and texts in which each run is collapsed to its first period.

Map-only. The words of neighbouring documents of a batch are appended to one
catcher, with a number of its own between two documents, so that no run
crosses; a document of more words than that has a catcher to itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import text_bytes
from loanlens.llm.squares import SquareCatcher

MIN_EXPONENT = 4
MIN_LENGTH = 6
GROUP_WORDS = 1 << 16
BATCH_ROWS = 256

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)),
                     ("collapsed", pa.binary())])


def text_words(data: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes; null has none."""
    return data.split() if data else []


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a made period: of ids whose CRC-32 is 0 modulo 10, each
    word from the a-th on is the original word a + (i - a) % p. A null id has
    none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    copies, rest = divmod(n - a, p)
    return words[:a] + words[a:a + p] * copies + words[a:a + rest]


def runs_of_documents(documents: list[list[bytes]], min_exponent: int = MIN_EXPONENT,
                      min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs (start, length, period) of each document, by start and period."""
    index: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    for k, words in enumerate(documents):
        for w in dict.fromkeys(words):
            index.setdefault(w, len(index))
        parts += [np.fromiter(map(index.__getitem__, words), np.int64, len(words)),
                  np.array([-1 - k], np.int64)]
        begins.append(at)
        at += len(words) + 1
    catcher = SquareCatcher(min_exponent, min_length, max(map(len, documents), default=0))
    if parts:
        catcher.append(np.concatenate(parts))
    runs = catcher.runs()
    cuts = np.searchsorted(runs[:, 0], [*begins, at])
    return [runs[i:j] - np.array([begin, 0, 0]) for i, j, begin in zip(cuts, cuts[1:], begins)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, one space between."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def groups(rows: Iterator[tuple[int | None, list[bytes]]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Neighbouring documents of up to GROUP_WORDS words together."""
    group: list = []
    size = 0
    for row in rows:
        if group and size + len(row[1]) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1]) + 1
    if group:
        yield group


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH,
              prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id long, n_words long, runs array of
    (start, length, period) by start then period, collapsed string (the text's
    words without those that a run holds after its first period, joined by one
    space). A run is a maximal stretch of words with smallest period q and
    length >= max(min_length, min_exponent x q). ``prepare`` may change a
    document's words first.

    Null, empty and blank texts have no words, no runs and an empty collapsed
    text. A text of any length is handled whole, in time that grows as its words
    times their logarithm. A null doc_id stays; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for whole in it:
                for k in range(0, whole.num_rows, BATCH_ROWS):
                    b = whole.slice(k, BATCH_ROWS)
                    for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        words = text_words(data)
                        yield doc_id, prepare(doc_id, words) if prepare else words

        for group in groups(rows()):
            documents = [words for _, words in group]
            found = runs_of_documents(documents, min_exponent, min_length)
            every = np.concatenate(found)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            runs = pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(every[:, c])) for c in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_id for doc_id, _ in group], pa.int64()),
                 pa.array([len(words) for words in documents], pa.int64()), runs,
                 pa.array([collapsed(w, r) for w, r in zip(documents, found)], pa.binary())], schema=_SCHEMA)

    made = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
            .mapInArrow(run, "doc_id long, n_words long, "
                             "runs array<struct<start:long,length:long,period:long>>, collapsed binary"))
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period;
    nulls without a run) with floor(1000 x exponent), and the digests of all
    runs' lines and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.finer")).alias("period"),
        F.expr("(1000 * best.length) div (-best.finer)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
