import random
import time

from loanlens.llm import licenses as L
from loanlens.llm.common import words


def slow_base(tokens):
    out = []
    for phrase, label in L.BASE_PHRASES.items():
        p = [w.encode() for w in phrase.split()]
        out += [(k, label) for k in range(len(tokens) - len(p) + 1) if tokens[k:k + len(p)] == p]
    return sorted(out)


def test_join_finds_every_pair():
    rng = random.Random(1)
    letters = [chr(97 + k) for k in range(26)]
    for threshold in (0.5, 0.8, 1.0):
        templates = [(str(k), " ".join(rng.sample(letters, rng.randint(1, 12)))) for k in range(15)]
        cut = L.Templates(templates, threshold)
        for counts in ({}, {w.encode(): rng.randint(0, 50) for w in letters}):
            cut.order_by(counts)
            for _ in range(300):
                block = cut.vocabulary.intersection(w.encode() for w in rng.sample(letters, rng.randint(0, 20)))
                want = {(t, len(s & block) / len(s)) for t, s in enumerate(cut.sets)
                        if len(s & block) >= threshold * len(s) - 1e-9}
                assert set(cut.matches(block)) == want


def test_every_stretch_of_a_template_is_in_a_block():
    cut = L.Templates([("x", "a b c d")])
    for n in range(0, 40):
        for at in range(0, max(0, n - 3)):
            tokens = [b"z"] * n
            tokens[at:at + 4] = [b"a", b"b", b"c", b"d"]
            assert any(block == {b"a", b"b", b"c", b"d"} for block in cut.blocks(tokens))


def test_base_places():
    phrases = [(p.encode(), len(p.split()), label) for p, label in L.BASE_PHRASES.items()]
    rng = random.Random(2)
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "20", "cc", "by", "nc", "ncc"]
    for _ in range(400):
        tokens = words(" ".join(rng.choice([*parts, "cc by nc", "under the mit license", "apache license version 2"])
                                for _ in range(rng.randint(0, 25))).encode())
        assert sorted(L.base_places(tokens, phrases)) == slow_base(tokens)


def test_query_on_odd_rows(make_docs, odd_rows, clashing):
    mit = L.TEMPLATES[0][1]
    rows = [*odd_rows, (20, "Released under the MIT License. cc-by-nc, CC BY NC"), (21, "\n".join(mit.upper().split())),
            (22, "word " * 700 + mit + " word" * 700), (23, " ".join(mit.split()[:30])),
            (24, "Apache License, Version 2.0; Apache License, Version 2.0")]
    got = {str(r.doc_id): r for r in L.scan_licenses(clashing(make_docs(rows))).collect() if r.doc_id and r.doc_id > 9}
    assert (got["20"].n_base, got["20"].first_word, got["20"].last_word) == (3, 1, 8)
    assert got["20"].base_labels == "cc-by-nc,mit" and got["20"].score == 1.0
    for k in ("21", "22"):
        assert (got[k].n_base, got[k].first_word, got[k].base_labels, got[k].labels, got[k].score) == (0, None, "", "mit", 1.0)
    assert got["23"].labels == ""
    assert (got["24"].n_base, got["24"].labels) == (2, "apache-2")
    every = L.scan_licenses(make_docs(rows)).collect()
    assert len(every) == len(rows)
    for r in every:
        if r.doc_id in (1, 2, 3, 6):
            assert (r.n_words, r.n_base, r.last_word, r.labels, r.score) == (0, 0, None, "", 0.0)
    assert L.scan_licenses(make_docs([])).count() == 0


CC = "This work is licensed under a Creative Commons Attribution%s 4.0 International License"
FSF = ("This %s is free software%s you can redistribute it and/or modify it under the terms of the GNU %s as published "
       "by the Free Software Foundation%s either version %s of the License, or (at your option) any later version.")
#: Notices as projects word them, and the one label of each.
NOTICES = [
    (CC % "", "cc-by"), (CC % "-ShareAlike", "cc-by-sa"), (CC % "-NonCommercial", "cc-by-nc"),
    (CC % "-NoDerivatives", "cc-by-nd"), (CC % "-NonCommercial-ShareAlike", "cc-by-nc-sa"),
    (CC % "-NonCommercial-NoDerivatives", "cc-by-nc-nd"), (CC % "-Share Alike", "cc-by-sa"),
    (CC % " Non-Commercial", "cc-by-nc"), (CC % " Non-Commercial No-Derivatives", "cc-by-nc-nd"),
    (CC % "" + " (BY-NC-SA 4.0)", "cc-by-nc-sa"),
    (FSF % ("program", ":", "General Public License", ",", "3"), "gpl"),
    (FSF % ("library", ";", "Lesser General Public License", ";", "2.1"), "lgpl"),
    (FSF % ("program", ":", "Lesser General Public License", ",", "3"), "lgpl"),
    (FSF % ("program", ":", "Affero General Public License", ",", "3"), "agpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This project is licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
    ("This work is licensed under the GNU Affero General Public License, version 3", "agpl-3"),
    (dict(L.TEMPLATES)["mit"] + ": the above copyright notice shall be included in all copies", "mit"),
    (dict(L.TEMPLATES)["bsd"] + ". Redistributions in binary form must reproduce it", "bsd"),
    (dict(L.TEMPLATES)["unlicense"].replace("Anyone is", "Everyone is"), "unlicense"),
]


def test_one_label_for_each_notice(make_docs):
    rows = [(k, text) for k, (text, _) in enumerate(NOTICES)]
    rows += [(100 + k, "x " * 400 + text + " x" * 400) for k, text in rows]
    rows += [(200 + k, "\n".join(text.upper().split(" "))) for k, text in rows[:len(NOTICES)]]
    got = L.scan_licenses(make_docs(rows)).collect()
    assert {r.doc_id: r.labels for r in got} == {
        base + k: label for base in (0, 100, 200) for k, (_, label) in enumerate(NOTICES)}
    assert all(0.8 <= r.score <= 1 for r in got)
    # The join's other pairs are there too.
    by = {r.doc_id: {p.label for p in r.pairs} for r in got}
    assert by[1] >= {"cc-by", "cc-by-sa", "cc-by-nc"} and by[13] >= {"gpl", "agpl"}


def test_several_notices_in_a_text(make_docs):
    text = (CC % "-ShareAlike") + " . " * 3 + "filler " * 200 + (CC % "-NoDerivatives") + " and " + "filler " * 90 + (
        FSF % ("program", ":", "Affero General Public License", ",", "3"))
    got = L.scan_licenses(make_docs([(1, text)])).first()
    assert got.labels == "agpl,cc-by-nd,cc-by-sa"


def test_words_of_a_short_notice_strewn_over_a_text_are_none(make_docs):
    strewn = " filler filler filler filler ".join((CC % "").split())
    got = L.scan_licenses(make_docs([(1, strewn)])).first()
    assert (got.labels, got.score, got.pairs) == ("", 0.0, [])


def test_all_pairs_equal_brute_force(make_docs):
    rng = random.Random(4)
    classes = L.length_classes(L.TEMPLATES)
    notices = [t.split() for _, t in L.TEMPLATES]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += [w for w in rng.choice(notices) if rng.random() < 0.93] + ["x"] * rng.randint(0, 30)
        tokens = words(" ".join(parts).encode())
        want = []
        for cut in classes:
            step = cut.longest
            for at in range(0, max(1, len(tokens) - step), step):
                block = set(tokens[at:at + 2 * step])
                want += [(at, cut.labels[t], len(s & block) / len(s)) for t, s in enumerate(cut.sets)
                         if len(s & block) >= 0.8 * len(s) - 1e-9]
        got = L.matched_pairs(tokens, classes)
        assert sorted((at, label, share) for at, _, label, share, _ in got) == sorted(want)


def test_base_places_of_a_long_text_take_linear_time():
    phrases = [(p.encode(), len(p.split()), label) for p, label in L.BASE_PHRASES.items()]
    start = time.process_time()
    assert len(L.base_places(words(b"cc by nc " * 200_000), phrases)) == 200_000
    assert time.process_time() - start < 5


def test_frequencies_cover_all_blocks(make_docs):
    cut = L.Templates(L.TEMPLATES)
    docs = make_docs([(k, "license free") for k in range(50)] + [(51, "license"), (52, None)])
    counts, = L.block_frequencies(docs.repartition(5), [cut])
    assert counts == {b"license": 51, b"free": 50}
