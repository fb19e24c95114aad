import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from loanlens.llm import bpe
from loanlens.llm.queries import PATTERN, RANKS

ODD_TEXTS = ["", " ", "\n\n  \t x", "a" * 5000, " " * 3000 + "x", "ab" * 2000, "it's we'll I'D", "日本語のテキスト",
             "👨‍👩‍👧 family é́", "<|endoftext|>", "\x00\x7f  ", "token = \"04dbeb\"", "ǅ ﬃ ½ ٣٤"]


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.coder(path, PATTERN), library


def test_equals_the_library(both):
    (encoder, decoder), library = both
    rng = random.Random(0)
    texts = [*ODD_TEXTS]
    for _ in range(1500):
        texts.append("".join(rng.choice("ab cdeéß日本語\n\t 's123!?😀the ing") for _ in range(rng.randint(0, 90))))
        texts.append("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF),
                                             rng.randint(0x1F000, 0x1FFFF)])) for _ in range(rng.randint(0, 40))))
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.count(text) == len(ids)
        assert decoder.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    encoder, decoder = bpe.coder(RANKS, PATTERN)
    library = _library()
    assert encoder.encode(text) == library.encode_ordinary(text)
    assert decoder.decode(encoder.encode(text)) == text


_KEPT = {}


def _library():
    if not _KEPT:
        _KEPT["x"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    return _KEPT["x"]


def test_stable_pairs_are_those_that_the_merges_leave_apart():
    machine, rng = bpe.Transducer(bpe.load_ranks(RANKS)), random.Random(5)
    for _ in range(4000):
        one = rng.randrange(50_000)
        tail = machine.token[one][-1:]
        near = [machine.ranks[t] for t in (tail + b"e", tail + b"in", tail, b"e" + tail) if t in machine.ranks]
        two = rng.choice([rng.randrange(50_000), *near])
        both = [machine.token[one], machine.token[two]]
        assert machine.stable(one, two) == (machine.merge(b"".join(both)) == both)


def test_words_and_blanks_between_them(both):
    (path_coder, _), library = both
    small = bpe.Encoder(path_coder.transducer.ranks, PATTERN, max_chunks=5)
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "word", " ", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "\u3000", ",", "'s", "1", "é"])
                       for _ in range(rng.randint(0, 20)))
        assert small.encode(text) == library.encode_ordinary(text)


def test_small_store_starts_anew():
    small = bpe.Transducer(bpe.load_ranks(RANKS), max_transitions=50)
    library = _library()
    for word in ["unbelievably", "zzqqxxyyzz", "éèêëēė", "abcabcabcabcabc"] * 3:
        assert small.run(word.encode()) == library.encode_ordinary(word)
        assert len(small.next) <= 50 + 60 and len(small.pair) <= 100 + 200


def test_tokens_come_out_early():
    """Lookahead is bounded: the window of a long piece stays short."""
    machine, seen = bpe.Transducer(bpe.load_ranks(RANKS)), []
    shift = machine._shift

    def watched(state, last, out):
        left = shift(state, last, out)
        seen.append(len(left))
        return left
    machine._shift = watched
    data = b"xyzzyplugh" * 200
    assert machine.run(data) == _library()._encode_single_piece(data)
    assert seen and max(seen) < 64


@settings(max_examples=500, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=6))
def test_utf8_machine_in_parts(parts):
    machine = bpe.Utf8()
    text = "".join(map(machine.feed, parts)) + machine.finish()
    assert text == b"".join(parts).decode("utf-8", "replace")


def test_streaming_decode_gives_whole_characters():
    encoder, decoder = bpe.coder(RANKS, PATTERN)
    text = "naïve 日本語 👨‍👩‍👧 fin"
    parts = list(decoder.stream(encoder.encode(text)))
    assert "".join(parts) == text and "�" not in "".join(parts)


def test_rows(make_docs, odd_rows, clashing):
    docs = clashing(make_docs(odd_rows))
    got = bpe.encode_documents(docs, RANKS, PATTERN).collect()
    assert len(got) == len(odd_rows)
    want = sorted((str(i), tuple(_library().encode_ordinary(t or "")), t or "") for i, t in odd_rows)
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in got) == want
    digests = bpe.token_digests(docs, RANKS, PATTERN).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (i, len(ids), sha(",".join(map(str, ids))), sha(t)) for i, ids, t in want)
    assert bpe.token_digests(make_docs([]), RANKS, PATTERN).count() == 0


def test_large_vocabularies_keep_their_pairs_apart():
    """Ranks beyond 2^17: the same tokens as with small ranks; ranks that the
    pair's key can't hold are refused."""
    small = {bytes([k]): k for k in range(256)}
    for k, pair in enumerate(("ab", "bc", "abc", "ca", "cab")):
        small[pair.encode()] = 256 + k
    large = {t: (r if r < 256 else r + 200_000) for t, r in small.items()}
    for text in (b"abcabcab", b"cabcabab", b"bcabca", b"aabbcc"):
        one, two = (bpe.Transducer(r).run(text) for r in (small, large))
        assert [r if r < 256 else r + 200_000 for r in one] == list(two)
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 1 << 20})
