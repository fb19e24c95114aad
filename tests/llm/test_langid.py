import random
import zlib

import pytest
from loanlens.llm import langid
from loanlens.llm.common import read_table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    return langid.learn(read_table(spark, SF, "documents"))


@pytest.fixture(scope="module")
def slices(learned):
    return learned.slices


def test_held_out_accuracy(spark, learned):
    docs = read_table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predict_language(docs, learned).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_learns_nothing_from_held_out_rows(spark, make_docs):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    docs = make_docs([(k, "der die das und nicht " * 5, "xx") for k in held] + [(None, "abc def", "yy"), (3, None, "zz")])
    learned = langid.learn(docs)
    assert learned == langid.Learned({}, {})
    assert {(r.lang_pred, r.score) for r in langid.predict_language(docs, learned).collect()} == {("und", 0.0)}


def test_changed_held_out_rows_change_nothing(spark, learned):
    """Texts and labels of held-out rows, of every size, are replaced: what is
    learned, margins included, stays."""
    docs = read_table(spark, SF, "documents")
    other = docs.withColumn("text", F.when(langid.held_out(), F.concat(F.lit("zz xx "), F.reverse("text")))
                            .otherwise(F.col("text")))
    other = other.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.learn(other) == learned
    assert learned.margins and all(0 <= m < 0.2 for m in learned.margins.values())
    # No constant stands in for them: without margins nothing with letters is rejected.
    bare = langid.Languages(langid.Learned(learned.slices))
    assert not any(bare.classify(r.text)[2] for r in docs.limit(300).collect() if r.text and langid.has_letter(r.text))


def test_margins_equal_brute_force(spark, learned):
    """Half of the first hundredth by size, of texts that gave no slice."""
    docs = read_table(spark, SF, "documents").where(~langid.held_out() & F.col("lang").isNotNull()
                                                    & F.col("text").isNotNull())
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").select(
        "*", langid.drawn().alias("drawn")).collect()
    counts = {lang: sum(r.lang == lang for r in rows) for lang in learned.slices}
    languages, seen = langid.Languages(langid.Learned(learned.slices)), {}
    for r in rows:
        first = min(langid.MOST_SAMPLED, langid.SAMPLE_DOCS / counts[r.lang])
        found = languages.compare(r.text)
        if r.drawn >= first and found and found[0] == r.lang:
            seen.setdefault(langid.size_of(found[2]), []).append(found[3])
    want = {size: sorted(m)[len(m) // 100] / 2 for size, m in seen.items() if len(m) >= langid.LEAST_IN_SIZE}
    assert learned.margins == want and len(want) >= 2


def test_odd_rows(make_docs, odd_rows, clashing, learned):
    docs = clashing(make_docs(odd_rows))
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict_language(docs, learned).collect()]
    assert len(got) == len(odd_rows)
    for doc_id, pred, rejected in got:
        if doc_id in (1, 2, 3, 6):
            assert pred == "und" and rejected
    texts = sorted(map(str, (r.text for r in langid.drop_rejected(docs, learned).collect())))
    assert texts == sorted(str(t) for i, t in odd_rows if t and any(map(str.isalpha, t)))
    assert langid.drop_rejected(docs, learned).columns == docs.columns
    assert langid.predict_language(make_docs([]), learned).count() == 0


def test_ignores_labels_and_names(make_docs, learned):
    text = "the of and that with this from they are not"
    a = langid.predict_language(make_docs([(1, text, "fr")]), learned).first()
    b = langid.predict_language(make_docs([(2, text, None)]), learned).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_a_narrow_margin_rejects():
    one = langid.Learned({k: ["lorem ipsum dolor sit amet " * 8] for k in ("aa", "bb")}, {k: 0.01 for k in range(3, 9)})
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("aeioulrstnd") for _ in range(6)) for _ in range(80))
    assert langid.Languages(one).classify(text) == ("aa", 0.5, True)
    assert langid.Languages(one).classify("sed " * 5000) == ("aa", 0.5, False)


def test_the_best_dictionary_wins(learned, slices):
    languages = langid.Languages(learned)
    for lang, parts in slices.items():
        assert languages.classify(" ".join(parts[:5]))[0] == lang


def test_long_clean_texts_stay(spark, learned, slices):
    """5 MB in each language: runs of five words of held-out texts."""
    languages, rng = langid.Languages(learned), random.Random(5)
    docs = read_table(spark, SF, "documents").where(langid.held_out()).select("lang", "text").collect()
    for lang in slices:
        words = " ".join(r.text for r in docs if r.lang == lang and r.text).split()
        runs, size = [], 0
        while size < 5_000_000:
            k = rng.randrange(len(words))
            runs.append(" ".join(words[k:k + 5]))
            size += len(runs[-1]) + 1
        pred, _, rejected = languages.classify(" ".join(runs))
        assert (pred, rejected) == (lang, False)


def test_long_texts_near_to_no_language_are_rejected():
    one = langid.Learned({k: ["lorem ipsum dolor sit amet " * 8] for k in ("aa", "bb")}, {k: 0.01 for k in range(3, 9)})
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("aeioulrstnd") for _ in range(6)) for _ in range(100_000))
    assert langid.Languages(one).classify(text) == ("aa", 0.5, True)
    assert langid.Languages(one).classify("sed " * 500_000) == ("aa", 0.5, False)


def test_texts_of_unlearned_languages_are_rejected(spark, learned, slices):
    docs = [r for r in read_table(spark, SF, "documents").where(langid.held_out()).collect()
            if r.text and langid.has_letter(r.text)]
    gone = [langid.Languages(learned).classify(r.text)[2] for r in docs]
    assert sum(gone) <= 0.01 * len(gone)
    for lang in slices:
        languages = langid.Languages(langid.Learned({k: v for k, v in slices.items() if k != lang}, learned.margins))
        out = [languages.classify(r.text)[2] for r in docs if r.lang == lang]
        assert sum(out) >= 0.75 * len(out)
