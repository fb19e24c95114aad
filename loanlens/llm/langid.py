"""Language identification by compression: a text is encoded with one
zstandard raw-content dictionary per language, and the language whose
dictionary gives the smallest frame is chosen. A narrow margin rejects.

A long text is encoded in chunks of ``CHUNK_BYTES``, each a frame of its own
with a fresh dictionary, and the languages' sums over the whole text are
compared: so the margin grows with the text, as the margin needed does.

Two things are learned, both from labelled rows that are not held out. The
dictionaries: each holds slices of ``SLICE_CHARS`` characters from a sample of
texts, ``DICT_BYTES`` in all. The margins: other labelled texts, of which no
dictionary has a slice, are classified, and a text is rejected if its margin is
less than half of what all but one in a hundred of the rightly classified have.
They are learned by size of the frames a chunk (in steps of a factor of four):
texts of a few words compress to nearly the same size everywhere. Both samples
have a documented bound (``SAMPLE_DOCS`` and ``MARGIN_DOCS`` expected texts a
language, drawn by a hash of the id) and fit the driver at any size.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import batches, text_bytes

DICT_BYTES = 65_536
SLICE_CHARS = 256
SAMPLE_DOCS = 640
LEVEL = 6
CHUNK_BYTES = 16_384
#: Texts of a language whose margins are looked at, and the least number in a
#: size from which a margin is learned (nothing is rejected in other sizes).
MARGIN_DOCS = 1_500
LEAST_IN_SIZE = 25
#: Of a small table no more than this share goes into the dictionaries.
MOST_SAMPLED = 0.75
UNKNOWN = "und"

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]").search


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER(text)) or any(map(str.isalpha, text))


def letters(text: str) -> bytes:
    """Lower-cased words: ASCII bytes other than letters become one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Learned:
    """Slices by language, languages by falling number of texts, and the least
    margin (share of the best frames) by size of the frames."""

    slices: dict[str, list[str]]
    margins: dict[int, float] = field(default_factory=dict)


def size_of(frame_bytes: float) -> int:
    """The number of a size: frames of 4^k bytes to less than 4^(k+1) have k."""
    return int(math.log2(max(1.0, frame_bytes)) // 2)


def drawn() -> Column:
    """A number from 0 to 1 by a hash of the id."""
    return F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0


def learnable_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull()
                   & ~held_out("id")))


def sampled_shares(counts: dict[str, int], sample_docs: int) -> dict[str, float]:
    return {lang: min(MOST_SAMPLED, sample_docs / n) for lang, n in counts.items()}


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, margin_docs: int = MARGIN_DOCS) -> Learned:
    """Dictionaries and margins from rows that are not held out."""
    rows = learnable_rows(docs, id_col, text_col, lang_col)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Learned({})
    slices = language_slices(rows, counts, sample_docs)
    return Learned(slices, learned_margins(rows, counts, slices, sample_docs, margin_docs))


def language_slices(rows: DataFrame, counts: dict[str, int], sample_docs: int) -> dict[str, list[str]]:
    """Slices of a sample of texts for each language, languages by falling
    number of texts. The sampled rows come by a hash of their id, so no row of
    the rest is moved."""
    share = F.create_map([F.lit(x) for item in sampled_shares(counts, sample_docs).items() for x in item])
    start = 1 + F.pmod(F.xxhash64("id", F.lit("slice")),
                       F.greatest(F.lit(1), F.length("text") - SLICE_CHARS + 1))
    found = (rows.where(drawn() < share[F.col("lang")])
             .select("lang", "id", drawn().alias("drawn"),
                     F.substring(F.col("text"), start.cast("int"), F.lit(SLICE_CHARS)).alias("slice"))
             .collect())
    out: dict[str, list[str]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in sorted(found, key=lambda r: (r["drawn"], r["id"], r["slice"])):
        out[r["lang"]].append(r["slice"])
    return out


def learned_margins(rows: DataFrame, counts: dict[str, int], slices: dict[str, list[str]], sample_docs: int,
                    margin_docs: int) -> dict[int, float]:
    """The least margin by size, from a sample of texts that gave no slice to a
    dictionary. The texts are classified where they are; (size, margin) of the
    rightly classified reach the driver."""
    first = F.create_map([F.lit(x) for item in sampled_shares(counts, sample_docs).items() for x in item])
    more = F.create_map([F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, margin_docs / n))])
    shared = rows.sparkSession.sparkContext.broadcast(slices)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(Learned(shared.value))
        for b in it:
            found = [languages.compare(t) for t in b.column(1).to_pylist()]
            right = [(size_of(f[2]), f[3]) for f, lang in zip(found, b.column(0).to_pylist())
                     if f and f[0] == lang]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in right], pa.int32()),
                                              pa.array([x for _, x in right], pa.float64())], names=["size", "margin"])

    seen = (rows.where((drawn() >= first[F.col("lang")]) & (drawn() < first[F.col("lang")] + more[F.col("lang")]))
            .select("lang", "text").mapInArrow(run, "size int, margin double").collect())
    by_size: dict[int, list[float]] = defaultdict(list)
    for r in seen:
        by_size[r["size"]].append(r["margin"])
    return {size: 0.5 * sorted(all_)[len(all_) // 100] for size, all_ in by_size.items()
            if len(all_) >= LEAST_IN_SIZE}


class Languages:
    """Compressors with a raw-content dictionary each."""

    def __init__(self, learned: Learned, dict_bytes: int = DICT_BYTES, level: int = LEVEL):
        self.compressors, self.margins = [], learned.margins
        for lang, parts in learned.slices.items():
            content = b" ".join(dict.fromkeys(map(letters, parts)))[:dict_bytes]
            if len(content) < 8:  # the least that zstandard takes as a dictionary
                content = content.ljust(8)
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.compressors.append((lang, zstandard.ZstdCompressor(
                level=level, dict_data=raw, write_checksum=False, write_content_size=False,
                write_dict_id=False)))

    def compare(self, text: str | None) -> tuple[str, float, float, float] | None:
        """Language, score, the best frames' bytes a chunk, and the margin to
        the next language as a share of the best. Ties go to the language with
        more learned texts (the order of the compressors). The score is the
        winner's share of 2^-(extra bytes). None without a letter."""
        if not text or not self.compressors or not has_letter(text):
            return None
        data = letters(text) or text.lower().encode("utf-8", "replace")
        chunks = [data[k:k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for _, c in self.compressors]
        least = min(sizes)
        best = sizes.index(least)
        others = sizes[:best] + sizes[best + 1:]
        margin = min(others) - least if others else least
        score = 1.0 / sum(2.0 ** -min(60, s - least) for s in sizes)
        return self.compressors[best][0], score, least / len(chunks), margin / least

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        found = self.compare(text)
        if found is None:
            return UNKNOWN, 0.0, True
        lang, score, frame, margin = found
        return lang, score, margin < self.margins.get(size_of(frame), 0.0)


def predict_language(docs: DataFrame, learned: Learned, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id long, held_out boolean, lang_pred
    string, score double (0 to 1), rejected boolean, from the text alone.

    Null texts, texts without a letter, and all texts when no language was
    learned: ``und``, score 0, rejected. A null doc_id is not held out and
    nothing is learned from it. Repeated rows give repeated results; other
    columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                        ("score", pa.float64()), ("rejected", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(shared.value)

        def rows():
            for b in it:
                found = [languages.classify(None if t is None else t.decode("utf-8", "replace"))
                         for t in b.column(2).to_pylist()]
                yield [b.column(0), b.column(1), *([x[k] for x in found] for k in range(3))]
        yield from batches(schema, rows())

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                        text_bytes(text_col).alias("data"))
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"))


def drop_rejected(docs: DataFrame, learned: Learned, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected; no row
    moves to another task."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(shared.value)
        for b in it:
            yield b.filter(pa.array([not languages.classify(t)[2] for t in b.column(at).to_pylist()],
                                    pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
