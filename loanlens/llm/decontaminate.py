"""Benchmark decontamination with an FM-index per training shard.

A task reads its documents in shards of a bounded number of words, indexes
each shard's words (``fmindex``), searches all windows of the benchmark items
backwards through it, locates the occurrences and merges them into spans of
words to remove. No document is moved between tasks; a document longer than a
shard is cut into parts that overlap by a window less one word.

The index's alphabet is the words of its shard; words are numbered by their
bytes, so an occurrence is exact. Separators stand between documents.

The benchmark's distinct items go to the tasks in blocks of a fixed number of
bytes, each a broadcast of its own; a shard is indexed once and searched for each
block. A worker holds ``RESIDENT_BYTES`` of items at most: a larger benchmark is
searched in several passes over the documents, and what a pass has found is
written down before the next.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import WORD_TABLE, batches, stored, text_bytes, words
from loanlens.llm.fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 400_000
BLOCK_BYTES = 8 << 20
RESIDENT_BYTES = 64 << 20
LOCATE_SLOTS = 1 << 20


class Phrases:
    """Windows of a block of benchmark items: distinct rows of word numbers
    (from 1, filled up with 0), and for each row the items that have it."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        number: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str | None] = []
        for name, data in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words(data)]
            item = len(self.names)
            self.names.append(name)
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(tuple(ids[k:k + window]), set()).add(item)
        self.vocabulary = list(number)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, :len(r)] = r
        self.owners = list(rows.values())


class Shard:
    """Documents (or parts of long ones) whose words are indexed together."""

    def __init__(self):
        self.parts: list[tuple[int, int]] = []  # document, and its word that the part begins with
        self.tokens: list[list[bytes]] = []
        self.words = 0

    def add(self, document: int, first: int, tokens: list[bytes]) -> None:
        self.parts.append((document, first))
        self.tokens.append(tokens)
        self.words += len(tokens)

    def index(self) -> None:
        """Number the shard's words, lay the parts out with a separator before
        each and one at the end, and index them."""
        number: dict[bytes, int] = defaultdict(lambda: len(number) + 1)
        text = np.zeros(self.words + len(self.tokens) + 1, np.int64)
        at, starts = 1, []
        for tokens in self.tokens:
            starts.append(at)
            text[at:at + len(tokens)] = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
            at += len(tokens) + 1
        self.starts = np.array(starts)
        self.number = number
        self.fm = FMIndex(text, len(number) + 1)

    def occurrences(self, phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
        """(phrase row, document, first word, words) of every occurrence."""
        symbol = np.array([0, *(self.number.get(w, -1) for w in phrases.vocabulary)], np.int64)
        rows = symbol[phrases.rows]
        here = np.flatnonzero((rows >= 0).all(axis=1))  # of words that the shard has
        low, high = self.fm.search(rows[here], phrases.lengths[here])
        some = high > low
        found, low, sizes = here[some], low[some], (high - low)[some]
        ends = np.cumsum(sizes)
        for k in range(0, int(ends[-1]) if len(ends) else 0, LOCATE_SLOTS):
            # Slots k.. of all intervals laid end to end.
            nth = np.arange(k, min(int(ends[-1]), k + LOCATE_SLOTS))
            which = np.searchsorted(ends, nth, "right")
            where = self.fm.locate(low[which] + nth - (ends - sizes)[which])
            part = np.searchsorted(self.starts, where, "right") - 1
            for row, p, w in zip(found[which].tolist(), part.tolist(), (where - self.starts[part]).tolist()):
                document, first = self.parts[p]
                yield row, document, first + w, int(phrases.lengths[row])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (first, end) spans of words, ordered."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(x) for x in out]


def search_documents(texts: list[bytes | None], blocks: list[Phrases], window: int,
                     shard_words: int) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: words, merged spans, names of the items found."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str | None]] = [set() for _ in texts]
    counts = [0] * len(texts)

    def search(shard: Shard) -> None:
        if not shard.words:
            return
        shard.index()
        for phrases in blocks:
            for row, document, first, length in shard.occurrences(phrases):
                spans[document].append((first, first + length))
                items[document].update(phrases.names[k] for k in phrases.owners[row])
            for document, _ in shard.parts:
                spans[document] = merge_spans(spans[document])

    shard = Shard()
    for number, data in enumerate(texts):
        tokens = words(data)
        counts[number] = len(tokens)
        if shard.words and shard.words + len(tokens) > shard_words:
            search(shard)
            shard = Shard()
        for k in range(0, len(tokens), shard_words):  # parts overlap by a window less one word
            shard.add(number, k, tokens[k:k + shard_words + window - 1])
            if shard.words >= shard_words:
                search(shard)
                shard = Shard()
    search(shard)
    for n, s, i in zip(counts, spans, items):
        yield n, s, sorted(x for x in i if x is not None)


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int,
                  block_bytes: int, resident_bytes: int) -> list[list]:
    """Broadcasts of at most ``block_bytes`` of item text each (an item larger
    than that is a block of its own), in groups that a worker may hold. Equal
    rows count once. The items' bytes are summed in Spark to choose the number of
    blocks; one block at a time is in the driver."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             text_bytes(text_col).alias("data")).distinct()
    size = items.agg(F.sum(F.length("data"))).first()[0] or 0
    n = 1 + size // block_bytes
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "data"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(((r["item"], bytes(r["data"]) if r["data"] is not None else None)
                       for r in part.collect()), key=lambda r: (r[0] or "", r[1] or b""))
        out.append(sc.broadcast(Phrases(rows, window)))
    held = max(1, resident_bytes // block_bytes)
    return [out[k:k + held] for k in range(0, len(out), held)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, shard_words: int = SHARD_WORDS,
                       block_bytes: int = BLOCK_BYTES, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id long, n_words long, spans
    array<struct<first long, end long>> (words to remove, merged, in order),
    items array<string> (found item ids, sorted).

    A window is ``window`` consecutive words of an item, or the whole item if
    it has fewer but not none. Null and wordless texts have no words and no
    spans; null and wordless items have no windows; an item with a null id
    marks words but is not listed. Repeated rows of ``docs`` give repeated
    results, repeated items count once; an empty benchmark finds nothing; other
    columns are ignored."""
    groups = phrase_blocks(benchmark, item_col, item_text_col, window, block_bytes, resident_bytes)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
    for k, blocks in enumerate(groups):
        last = k == len(groups) - 1
        found = _searched(found, blocks, k > 0, last, window, shard_words)
        if not last:
            found = stored(found, "decontamination")
    return found


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def as_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"first": a, "end": b} for a, b in spans]


def _searched(rows: DataFrame, blocks: list, again: bool, last: bool, window: int, shard_words: int) -> DataFrame:
    """One pass: doc_id, data (not in the last pass), n_words, spans, items;
    with those of earlier passes (``again``)."""
    held = [("doc_id", pa.int64())] + [("data", pa.binary())] * (not last)
    schema = pa.schema([*held, ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
    fields = "doc_id long, " + "data binary, " * (not last) + \
        "n_words long, spans array<struct<first:long,end:long>>, items array<string>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.value for b in blocks]

        def flush(group: list[dict]) -> list:
            out = []
            for row, (n, spans, items) in zip(group, search_documents([r["data"] for r in group], found, window,
                                                                      shard_words)):
                if again:
                    spans = merge_spans([*spans, *((s["first"], s["end"]) for s in row["spans"])])
                    items = sorted({*items, *row["items"]})
                out.append((row["doc_id"], *([row["data"]] * (not last)), n, as_spans(spans), items))
            return list(map(list, zip(*out)))

        def columns():
            group, size = [], 0
            for b in it:
                for row in b.to_pylist():
                    group.append(row)
                    size += len(row["data"] or b"")
                    if size >= 6 * shard_words:
                        yield flush(group)
                        group, size = [], 0
            if group:
                yield flush(group)
        yield from batches(schema, columns())

    return rows.mapInArrow(run, fields)


def contamination_digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from found spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the words of the spans; what lay between two removed
    words goes with them, and a space stays in a span's place."""
    lowered = data.translate(WORD_TABLE)
    places = [m.span() for m in re.finditer(rb"[^ ]+", lowered)]
    out, at = [], 0
    for first, end in spans:
        out.append(data[at:places[first][0]])
        at = places[end - 1][1]
    out.append(data[at:])
    return b"".join(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text",
                         window: int = WINDOW, shard_words: int = SHARD_WORDS,
                         block_bytes: int = BLOCK_BYTES, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """``docs`` with the found spans cut out of ``text_col``; texts without
    any, nulls too, are as they were. A long column n_chars, where there is
    one, is set to the new length of a text that was cut. All rows and columns
    stay."""
    groups = phrase_blocks(benchmark, item_col, item_text_col, window, block_bytes, resident_bytes)
    at = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns

    def spans_of(b: pa.RecordBatch, texts: list, found: list) -> list[list[tuple[int, int]]]:
        """Those of earlier passes (a column behind the table's own) too."""
        mine = [s for _, s, _ in search_documents(texts, found, window, shard_words)]
        if b.num_columns > len(names):
            mine = [merge_spans([*s, *((x["first"], x["end"]) for x in old)])
                    for s, old in zip(mine, b.column(len(names)).to_pylist())]
        return mine

    def search(blocks: list, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.value for b in blocks]
        for whole in it:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                spans = spans_of(b, b.column(at).cast(pa.binary()).to_pylist(), found)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:len(names)], pa.array(list(map(as_spans, spans)), pa.list_(_SPAN))],
                    names=[*names, "__spans"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.value for b in groups[-1]]
        for whole in it:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                texts = b.column(at).cast(pa.binary()).to_pylist()
                short = {n: cut_words(texts[n], s) for n, s in enumerate(spans_of(b, texts, found)) if s}
                columns = b.columns[:len(names)]
                if short:
                    columns[at] = pa.array([short.get(n, t) for n, t in enumerate(texts)],
                                           pa.binary()).cast(b.schema.field(at).type)
                    if chars is not None:
                        counts = b.column(chars).to_pylist()
                        columns[chars] = pa.array([len(short[n].decode("utf-8", "replace")) if n in short else c
                                                   for n, c in enumerate(counts)], b.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(b.schema)[:len(names)]))

    current = docs
    for blocks in groups[:-1]:
        fields = T.StructType([*docs.schema.fields, T.StructField("__spans", T.ArrayType(T.StructType(
            [T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))])
        current = stored(current.mapInArrow(lambda it, blocks=blocks: search(blocks, it), fields), "decontamination")
    return current.mapInArrow(cut, docs.schema)
