import hashlib
import random
import zlib

import numpy as np
from loanlens.llm import periodic, squares


def slow_runs(words, exponent=4, least=6):
    """Maximal runs by trying every period."""
    out = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in out.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    rng = np.random.default_rng(seed)
    for k in range(n):
        w = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 110)))
        if k % 3 == 0 and len(w):
            a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 15))
            w = np.concatenate([w[:a], np.resize(w[a:a + p], len(w) - a), rng.integers(0, 3, 5)])
        yield w


def caught(w, exponent, chunks=None):
    c = squares.SquareCatcher(exponent)
    for part in [w] if chunks is None else np.split(w, chunks):
        c.append(part)
    return [tuple(r) for r in c.runs()]


def test_runs_equal_brute_force_however_words_are_appended():
    rng = np.random.default_rng(3)
    for k, w in enumerate(sequences(1, 600)):
        e = (4, 3, 2)[k % 3]
        want = slow_runs(list(w), e)
        assert caught(w, e) == want
        cuts = np.unique(rng.integers(0, len(w) + 1, 12))
        assert caught(w, e, cuts) == want
    for w in list(sequences(2, 30)):
        assert caught(w, 4, range(1, len(w))) == slow_runs(list(w))  # word by word


def test_false_catches_of_fingerprints_change_nothing(monkeypatch):
    monkeypatch.setattr(squares, "mixed", lambda ids: np.asarray(ids % 2).astype(np.uint64))
    for w in sequences(4, 200):
        assert caught(w, 4) == slow_runs(list(w))


def test_long_and_periodic_sequences_stay_fast():
    for w in (np.zeros(400_000, np.int64), np.arange(400_000) % 90_000,
              np.array([bin(i).count("1") % 2 for i in range(1 << 16)])):
        c = squares.SquareCatcher()
        c.append(w)
        if len(w) == 400_000:
            p = int(w.max()) + 1
            assert [tuple(r) for r in c.runs()] == [(0, 400_000, p)]
        else:  # the Thue-Morse sequence has no cube
            assert not len(c.runs())


def slow_row(doc_id, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (str(doc_id), len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def compare(df, rows, plant):
    got = sorted(((str(r.doc_id), *r[1:]) for r in periodic.run_digest(df).collect()), key=str)
    assert got == sorted((slow_row(i, t, plant) for i, t in rows), key=str)


def test_documents_equal_brute_force(make_docs, odd_rows, clashing, monkeypatch):
    rng = random.Random(5)
    rows = [r for r in odd_rows if r[0] != 9] + [(9, "word " * 700)]
    for k in range(150):
        text = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        rows.append((100 + k, " \n".join(text + text[-rng.randint(1, 6):] * rng.randint(0, 7))))
    docs = make_docs(rows)
    compare(periodic.find_runs(docs), rows, False)
    compare(periodic.find_runs(clashing(docs), prepare=periodic.planted_words), rows, True)
    monkeypatch.setattr(periodic, "GROUP_WORDS", 50)  # in this process: the groups of a list
    for group in periodic.groups((i, periodic.text_words((t or "").encode())) for i, t in rows):
        found = periodic.runs_of_documents([w for _, w in group])
        assert [[tuple(r) for r in f] for f in found] == [slow_runs(w) for _, w in group]


def test_edge_cases(make_docs, odd_rows):
    got = {(r.doc_id, r.collapsed): r for r in periodic.find_runs(make_docs(odd_rows)).collect()}
    assert got[3, ""].n_words == 0 and got[3, ""].runs == []
    assert [tuple(x) for x in got[9, "word"].runs] == [(0, 30_000, 1)]
    assert got[None, "one two three four"].n_words == 4
    assert periodic.find_runs(make_docs([])).count() == 0
    assert sum(r.doc_id == 7 for r in periodic.find_runs(make_docs(odd_rows)).collect()) == 2
