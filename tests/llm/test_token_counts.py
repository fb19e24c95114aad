import random

import tiktoken
from loanlens.llm import bpe, token_counts
from loanlens.llm.queries import PATTERN, RANKS


def test_equals_brute_force(make_docs, odd_rows, clashing):
    rng = random.Random(1)
    rows = [*odd_rows, *((100 + k, "tokens of text " * rng.randint(0, 40)) for k in range(200))]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    lengths = sorted(len(library.encode_ordinary(t or "")) for _, t in rows)
    limits = token_counts.context_limits(
        token_counts.length_histogram(clashing(make_docs(rows)), RANKS, PATTERN)).cache()
    got = {r.n_tokens: r for r in limits.collect()}
    assert sorted(got) == sorted(set(lengths))
    for c, r in got.items():
        over = [n for n in lengths if n > c]
        assert (r.n_docs, r.docs_over, r.tokens_over) == (lengths.count(c), len(over), sum(over))
        assert (r.docs_within, r.tokens_within) == (len(lengths) - len(over), sum(lengths) - sum(over))
        assert r.truncated_tokens == sum(min(n, c) for n in lengths)
        assert r.padded_tokens == c * len(lengths)
        assert r.quantile == (len(lengths) - len(over)) / len(lengths)
    for c in (0, 1, 2, 5, 17, 100, 10_000, 10 ** 6):
        assert token_counts.truncated_total(limits, c) == sum(min(n, c) for n in lengths)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        want = min(n for n in lengths if sum(m <= n for m in lengths) >= q * len(lengths))
        assert token_counts.length_quantile(limits, q) == want


def test_long_histogram_across_ranges(spark):
    rng = random.Random(2)
    counts = {rng.randint(0, 60_000): rng.randint(1, 5) for _ in range(400)}
    limits = token_counts.context_limits(spark.createDataFrame(list(counts.items()), "n_tokens long, n_docs long"))
    for r in limits.collect():
        assert r.docs_over == sum(d for n, d in counts.items() if n > r.n_tokens)
        assert r.tokens_over == sum(n * d for n, d in counts.items() if n > r.n_tokens)


def test_no_documents(make_docs):
    limits = token_counts.context_limits(token_counts.length_histogram(make_docs([]), RANKS, PATTERN))
    assert limits.count() == 0
    assert token_counts.truncated_total(limits, 5) == 0
    assert token_counts.length_quantile(limits, 0.5) is None
