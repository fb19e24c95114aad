import random

import numpy as np
import xxhash
from loanlens.llm import components, simhash
from pyspark.sql import functions as F


def slow_fingerprint(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)] or [b" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """pairs of (id, fingerprint): smallest reachable id per row."""
    out = list(range(len(pairs)))
    todo = set(out)
    while todo:
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            near = {j for j in todo if any((pairs[i][1] ^ pairs[j][1]).bit_count() <= 3 for i in edge)}
            todo -= near
            edge = near
        ids = [pairs[i][0] for i in group if pairs[i][0] is not None]
        for i in group:
            out[i] = min(ids, default=None)
    return out


def check(make_docs, rows, **kw):
    docs = make_docs(rows)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(docs, **kw).collect())
    pairs = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted((str(i), f"{fp:016x}", str(c)) for (i, fp), c in zip(pairs, slow_components(pairs)))
    assert got == want


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 97, 98, 99, 400):
        text = " ".join(rng.choice(["the", "The", "é", "b", "cat"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) % 2 ** 64 == slow_fingerprint(text)


def test_components_equal_brute_force(make_docs, odd_rows):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(12)]
    rows = [*odd_rows]
    for k in range(150):
        tokens = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            tokens[rng.randrange(len(tokens))] = rng.choice("xyz") * 4
        rows.append((100 + k, " ".join(tokens)))
    check(make_docs, rows)
    check(make_docs, rows, tile_rows=7)


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    values = [int(c) for c in centres]
    for c in centres:
        v = int(c)
        for _ in range(30):  # a chain: neighbours differ by up to 3 bits
            for bit in rng.choice(64, 3, replace=False):
                v ^= 1 << int(bit)
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    node, root = simhash.tile_forest(values, None, 3)
    parent = {int(v): int(v) for v in values} | {int(a): int(b) for a, b in zip(node, root)}
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    i, j = np.nonzero(bits <= 3)
    assert all(parent[int(values[a])] == parent[int(values[b])] for a, b in zip(i, j))
    # and links nothing else: as many components as a breadth-first search finds
    todo, n = set(range(len(values))), 0
    while todo:
        n, edge = n + 1, {todo.pop()}
        while edge:
            edge = {int(b) for a in edge for b in np.flatnonzero(bits[a] <= 3) if int(b) in todo}
            todo -= edge
    assert n == len(set(parent.values()))


def test_two_tiles(spark):
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2 ** 63, 3000, dtype=np.uint64))
    b = np.unique(a[::3] ^ np.uint64(5))
    node, root = simhash.tile_forest(a, np.setdiff1d(b, a), 3)
    assert len(node) == len(np.setdiff1d(b, a))


def test_connected_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (200, 201)]
    rng = random.Random(5)
    names = list(range(-150, 150))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for part in (range(0, 61), range(100, 150), range(200, 202)):
        least = min(names[k] for k in part)
        assert {got[names[k]] for k in part} == {least}
    assert len(got) == 61 + 50 + 2
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table_and_clashing_columns(spark, make_docs, clashing, odd_rows):
    assert simhash.simhash_components(make_docs([])).count() == 0
    rows = odd_rows[:6]
    plain = simhash.simhash_components(make_docs(rows))
    assert sorted(plain.collect()) == sorted(simhash.simhash_components(clashing(make_docs(rows))).collect())


def test_one_of_each_component_stays_with_all_columns(make_docs, clashing):
    docs = clashing(make_docs([(1, "a b c d e"), (2, "a b c d e"), (1, "a b c d e"), (None, "zz yy xx"), (5, "q w e r t")]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "None"]
    assert kept.where(F.col("data") != "x").count() == 0


def test_ids_that_stand_for_several_texts(make_docs, odd_rows):
    """Rows with one id and different texts are different documents."""
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue black"
    kept = simhash.keep_one(make_docs([(5, a), (5, b), (2, b), (None, b), (None, c), (None, c), (7, c)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, b), (5, a), (7, c)]
    kept = simhash.keep_one(make_docs([(None, a), (None, a), (None, c)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(None, a), (None, c)]
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        assert simhash.keep_one(docs).count() == len({slow_fingerprint(t) for _, t in rows})


def test_a_long_text_is_counted_in_slices(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3000))
    for size in (1, 7, 97, 1000):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash.fingerprint(text.encode()) % 2 ** 64 == slow_fingerprint(text)
