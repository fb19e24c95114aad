import hashlib
import re

from loanlens.llm import exact_dedup
from pyspark.sql import functions as F


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def want(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        first = True
        for i in ids:
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def run(docs, **kw):
    return sorted(str(tuple(r)) for r in exact_dedup.decisions(docs, **kw).collect())


ROWS = [(5, "a  b"), (3, "a\tb"), (4, "a b "), (9, "a\x0bb"), (8, "a b"), (1, "x"), (2, "y")]


def test_odd_rows(make_docs, odd_rows, clashing):
    rows = [*odd_rows, *ROWS]
    assert run(make_docs(rows)) == want(rows)
    assert run(clashing(make_docs(rows))) == want(rows)
    assert run(make_docs([])) == []


def test_state_carries_over_batches(make_docs):
    rows = [(k, f"text {k % 7}") for k in range(60, 0, -1)]
    docs = make_docs(rows).repartition(9)
    assert run(docs, files_per_batch=1) == want(rows)


def test_full_bytes_are_compared_on_hits(make_docs, odd_rows):
    """With a digest of one byte different texts share digests; the results
    must not change."""
    rows = [*odd_rows, *ROWS, *((100 + k, f"t{k % 90}") for k in range(400))]

    def weak(text):
        return F.substring(F.unhex(F.sha2(text, 256)), 1, 1)
    assert run(make_docs(rows), digest=weak) == want(rows)


def test_a_later_run_goes_on_from_the_state(spark, make_docs):
    from loanlens.llm.common import shared_folder

    folder, state = shared_folder(spark, "in"), shared_folder(spark, "state")
    first = F.struct(F.lit(False).alias("no_id"), "doc_id", F.col("doc_id").alias("row"), F.lit("f").alias("file"))
    table = make_docs([(1, "a"), (5, "b")]).select(F.unhex(F.sha2("text", 256)).alias("digest"), first.alias("first"))
    table.write.parquet(folder)
    exact_dedup.stream_state(spark, folder, table.schema, checkpoint=state)
    more = make_docs([(0, "b"), (7, "c")]).select(F.unhex(F.sha2("text", 256)).alias("digest"), first.alias("first"))
    more.write.mode("append").parquet(folder)
    found = exact_dedup.stream_state(spark, folder, table.schema, checkpoint=state).collect()
    assert sorted((r.n, r["first"].doc_id) for r in found) == [(1, 1), (1, 7), (2, 0)]


def test_keep_first_keeps_rows_and_columns(make_docs, clashing, odd_rows):
    docs = clashing(make_docs([*odd_rows, *ROWS]))
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in [*odd_rows, *ROWS]})
