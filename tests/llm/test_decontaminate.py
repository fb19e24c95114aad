import random

import numpy as np
import pytest
from loanlens.llm import decontaminate as D
from loanlens.llm.common import words
from loanlens.llm.fmindex import FMIndex, WaveletMatrix, suffix_order

BENCH = "item_id long, text string"


def slow(text, items):
    """Words, hit words and item ids by the definition."""
    w, hit, found = words(text), set(), set()
    for name, data in items:
        q = words(data)
        for k in range(max(1, len(q) - 9) if q else 0):
            p = q[k:k + 10]
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(name)
    return len(w), hit, sorted(x for x in found if x is not None)


def test_suffix_order_and_rank():
    rng = np.random.default_rng(1)
    for top in (2, 3, 9):
        text = np.r_[0, rng.integers(0, top, 300), 0].astype(np.int64)
        # Each separator is a symbol of its own, before all words, by position.
        keys = [tuple((0, k + j) if x == 0 else (1, int(x)) for j, x in enumerate(text[k:])) for k in range(len(text))]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=keys.__getitem__)
        tree = WaveletMatrix(text, 4)
        for symbol in range(top):
            i = np.arange(len(text))
            low, high = tree.rank(np.full(len(text), symbol), i, i + 1)
            before = np.cumsum(text == symbol) - (text == symbol)
            assert (low == before).all() and (high == before + (text == symbol)).all()
        values, ranks = tree.access_rank(np.arange(len(text)))
        assert (values == text).all()
        assert all(r == np.count_nonzero(text[:k] == text[k]) for k, r in enumerate(ranks.tolist()))


def test_search_and_locate():
    rng = np.random.default_rng(2)
    text = np.r_[0, rng.integers(1, 4, 400), 0, rng.integers(1, 4, 200), 0].astype(np.int64)
    index = FMIndex(text, 4)
    phrases = [rng.integers(1, 4, n) for n in (1, 2, 3, 5, 5, 8) for _ in range(10)]
    rows = np.zeros((len(phrases), 8), np.int64)
    for k, p in enumerate(phrases):
        rows[k, :len(p)] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [k for k in range(len(text)) if text[k:k + len(p)].tolist() == p.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard_words", [3, 20, 1000])
def test_equals_brute_force(shard_words):
    rng = random.Random(shard_words)
    for trial in range(60):
        vocabulary = [b"a", b"b", b"c", b"dd", "é".encode()]
        items = [(str(k), b" ".join(rng.choice(vocabulary[:3 + trial % 3]) for _ in range(rng.choice([0, 1, 3, 9, 10, 12]))))
                 for k in range(rng.randint(0, 5))]
        texts = [b" ".join(rng.choice([*vocabulary, b"x"]) for _ in range(rng.choice([0, 1, 5, 30, 80]))) for _ in range(6)]
        texts += [None, b""]
        if items:
            texts += [items[0][1] * 2, b"x " + items[0][1] + b"! " + items[-1][1]]
        blocks = [D.Phrases(items[:2], 10), D.Phrases(items[2:], 10)]
        for (n, spans, found), text in zip(D.search_documents(texts, blocks, 10, shard_words), texts):
            hit = {k for a, b in spans for k in range(a, b)}
            assert (n, hit, found) == slow(text, items)


def test_query_columns_and_odd_rows(spark, make_docs, odd_rows, clashing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (10, "one two three four"), (2, None), (3, ""), (4, "!!"), (None, "é ß"), (5, "word word word")]
    bench = spark.createDataFrame(items, BENCH)
    rows = [*odd_rows, (20, "x " + item.upper().replace(" ", ", ") + " y"), (21, item.replace("mu", "nu"))]
    want = []
    for doc_id, text in rows:
        n, hit, found = slow(None if text is None or len(text) > 10_000 else text.encode(),
                             [(None if i is None else str(i), None if t is None else t.encode()) for i, t in items])
        if text and len(text) > 10_000:
            n, hit, found = 30_000, set(range(30_000)), ["5"]
        want.append((str(doc_id), n, len(hit), len(found), bool(hit)))
    for size, held in ((D.BLOCK_BYTES, D.RESIDENT_BYTES), (40, D.RESIDENT_BYTES), (40, 80), (40, 1)):
        got = D.contamination_digest(D.find_contamination(clashing(make_docs(rows)), clashing(bench), block_bytes=size,
                                                          resident_bytes=held))
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()) == sorted(want)
    empty = spark.createDataFrame([], BENCH)
    assert {r.n_hit for r in D.contamination_digest(D.find_contamination(make_docs(rows), empty)).collect()} == {0}
    assert D.find_contamination(make_docs([]), bench).count() == 0


def test_item_ids_are_sorted_as_strings(spark, make_docs):
    bench = spark.createDataFrame([(2, "a b"), (10, "b c"), (1, "zz")], BENCH)
    row = D.find_contamination(make_docs([(1, "a b c")]), bench).first()
    assert row["items"] == ["10", "2"] and [tuple(s) for s in row["spans"]] == [(0, 3)]


def test_removal_cuts_words_and_leaves_the_rest(spark, make_docs, clashing, odd_rows):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], BENCH)
    docs = clashing(make_docs([*odd_rows, (30, "Well, Alpha-beta gamma! Done. alpha beta"), (31, "clean é text")]))
    out = D.remove_contamination(docs, bench)
    check_removal(docs, out, odd_rows)


def test_removal_in_several_passes(spark, make_docs, clashing, odd_rows):
    """Words that one pass finds are not cut before the next has searched."""
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "nothing of it"), (3, "other things")], BENCH)
    docs = clashing(make_docs([*odd_rows, (30, "Well, Alpha-beta gamma! Done. alpha beta"), (31, "clean é text")]))
    check_removal(docs, D.remove_contamination(docs, bench, block_bytes=8, resident_bytes=8), odd_rows)
    overlap = spark.createDataFrame([(k, w) for k, w in enumerate(["a b c", "c d", "b c d e", "x e"])], BENCH)
    for block, held in ((1 << 20, 1 << 20), (2, 2), (2, 4)):
        got = D.remove_contamination(make_docs([(1, "y a b c d e z x")]), overlap, block_bytes=block, resident_bytes=held)
        assert got.first().text.split() == ["y", "z", "x"]


def test_an_item_repeated_many_times_counts_once(spark, make_docs):
    bench = spark.range(100_000).selectExpr("7L as item_id", "'alpha beta gamma delta' as text")
    groups = D.phrase_blocks(bench, "item_id", "text", 10, 1000, 1000)
    assert [len(b.value.names) for g in groups for b in g] == [1]
    got = D.find_contamination(make_docs([(1, "x alpha beta gamma delta")]), bench, block_bytes=1000).first()
    assert [tuple(s) for s in got.spans] == [(1, 5)] and got["items"] == ["7"]


def check_removal(docs, out, odd_rows):
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[30].text == "Well, ! Done. alpha beta" and got[30].n_chars == len(got[30].text)
    assert got[31].text == "clean é text"
    assert sorted(map(str, (r.text for r in out.collect() if r.doc_id != 30))) == sorted(
        [str(t) for _, t in odd_rows] + ["clean é text"])
