"""Byte-level BPE encoding and decoding.

Encoding. The rank file's merges are compiled into a finite-state transducer
over bytes. A state is the set of tokens in progress (nodes of the
vocabulary's trie, one for each place where a token may have begun); reading a
byte gives the next set and the tokens that end there. States and transitions
are determinised when first met and kept, in a store that starts anew when
full. Beside the state the transducer has a register for each byte of its
window: the last token of the encoding up to there. Of the tokens that end at
a byte exactly one may follow the last token before it: a pair of tokens must
be stable under the merges (encoding the two tokens' bytes gives the two tokens
again), and a sequence all of whose neighbours are stable is the BPE encoding
(Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023). Tokens
leave the window as soon as all tokens in progress begin after them, which is
after bounded lookahead. Runs over short chunks of text are kept too.

Decoding. Tokens are decoded one at a time by an incremental UTF-8 state
machine: a character that a token leaves unfinished waits for the next token;
bytes that are not UTF-8 become U+FFFD as in ``bytes.decode(errors="replace")``.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import batches, text_bytes

MAX_TRANSITIONS = 400_000
MAX_CHUNKS = 150_000
CHUNK_CHARS = 48
#: Bytes of a piece's beginning after which state and registers are kept.
HEAD_BYTES = 6
MAX_HEADS = 80_000
#: Bytes that are read before tokens are emitted.
WINDOW = 256
_NEVER = 1 << 60


#: Bits of a rank in the key of a pair of tokens (written out where it is used most).
RANK_BITS = 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS):
        if max(ranks.values(), default=0) >> RANK_BITS:
            raise ValueError(f"ranks of 2^{RANK_BITS} and more are not told apart")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.max_transitions = max_transitions
        # Trie: child[node << 8 | byte] -> node; a node's depth, and its token
        # where it has one.
        self.child: dict[int, int] = {}
        self.depth = [0]
        self.at_node: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                below = self.child.get(key)
                if below is None:
                    below = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.at_node[node] = rank
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pair: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        """State 0 is a piece's start: no token in progress."""
        self.states: list[tuple[int, ...]] = [()]
        self.number: dict[tuple[int, ...], int] = {(): 0}
        self.next: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        #: State and registers after the first bytes of a piece.
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Tokens of a short byte string by merging the lowest-ranked
        neighbours first, until ``stop`` tokens are left or none merge."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from; None if it is a byte,
        or not what the merges make of its bytes."""
        if token not in self.split:
            data = self.token[token]
            parts = self.merge(data, 2) if len(data) > 1 else []
            whole = len(parts) == 2 and parts[0] + parts[1] == data
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else None
        return self.split[token]

    def stable(self, one: int, two: int) -> bool:
        """Whether token ``two`` may follow ``one`` (-1: the piece's start).

        Both tokens' last merges are undone, the latest first. What then meets
        at the border met there while the merges were done; the pair is not
        stable if those two would have merged before either was used up. At
        equal ranks the left merge comes first."""
        key = one << 20 | two
        known = self.pair.get(key)
        if known is None:
            if one < 0:
                known = self.halves(two) is not None or len(self.token[two]) == 1
            else:
                known = self._stable(one, two)
            self.pair[key] = known
        return known

    def _stable(self, one: int, two: int) -> bool:
        token, rank_of = self.token, self.ranks.get
        if len(token[two]) > 1 and self.halves(two) is None:
            return False
        left, right, left_until, right_until = one, two, _NEVER, _NEVER
        while True:
            rank = rank_of(token[left] + token[right])
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            a = self.halves(left) if len(token[left]) > 1 else None
            b = self.halves(right) if len(token[right]) > 1 else None
            if a is not None and (b is None or left > right):
                left_until, left = left, a[1]
            elif b is not None:
                right_until, right = right, b[0]
            else:
                return True

    def _step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The transition: the next state, and the tokens that end with this
        byte with their lengths, longest first."""
        going = [self.child[n << 8 | byte] for n in (*self.states[state], 0) if n << 8 | byte in self.child]
        threads = tuple(going)
        to = self.number.get(threads)
        if to is None:
            to = self.number[threads] = len(self.states)
            self.states.append(threads)
        ends = tuple((self.at_node[n], self.depth[n]) for n in going if n in self.at_node)
        hop = self.next[state << 8 | byte] = (to, ends)
        return hop

    def run(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.next) > self.max_transitions:
            self._reset()
        if len(self.pair) > 2 * self.max_transitions:
            self.pair.clear()
        head = data[:HEAD_BYTES]
        kept = self.heads.get(head)
        if kept is None:
            last = [-1]
            state = self._read(0, head, last)
            if len(self.heads) >= MAX_HEADS:
                self.heads.clear()
            self.heads[head] = state, tuple(last)
        else:
            state, last = kept[0], list(kept[1])
        out: list[int] = []
        for k in range(HEAD_BYTES, len(data), WINDOW):
            state = self._read(state, data[k:k + WINDOW], last)
            if k + WINDOW < len(data):
                last = self._shift(state, last, out)
        out.extend(self._back(last, len(last) - 1))
        return out

    def _read(self, state: int, data: bytes, last: list[int]) -> int:
        """Read bytes into the window; the state after them."""
        known, stable, put, at = self.next.get, self.pair.get, last.append, len(last)
        for at, byte in enumerate(data, at):
            state, ends = known(state << 8 | byte) or self._step(state, byte)
            for token, length in ends:
                before = last[at - length]
                fits = stable(before << 20 | token)
                if fits or (fits is None and self.stable(before, token)):
                    put(token)
                    break
            else:
                raise ValueError("the vocabulary has no stable token for these bytes")
        return state

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens of the window up to byte ``at``, by its registers."""
        found = []
        while at > 0:
            found.append(last[at])
            at -= len(self.token[last[at]])
        return found[::-1]

    def _shift(self, state: int, last: list[int], out: list[int]) -> list[int]:
        """Emit the tokens that all threads share; the window without them."""
        at = len(last) - 1
        shared = None
        for start in {at, *(at - self.depth[n] for n in self.states[state])}:
            ends = {start}
            while start > 0:
                start -= len(self.token[last[start]])
                ends.add(start)
            shared = ends if shared is None else shared & ends
        cut = max(shared)
        out.extend(self._back(last, cut))
        return last[cut:]


#: Letters below this are letters for the pattern's engine and for Python alike.
_PLAIN_LETTERS = "\u0250"


class Encoder:
    """Pieces of a text by a pattern, each encoded by the transducer.

    The text is first cut at single spaces between two characters that are no
    white space: no piece of the pattern goes past such a place, and what comes
    before it does not change how the rest is cut. The run over a short chunk
    is kept, so that a word met again costs one look-up. Kept runs are in two
    generations: when the young one is full it becomes the old one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_chunks: int = MAX_CHUNKS):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.max_chunks = max_chunks
        self.young: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}
        self.marks: dict[str, tuple[tuple[int, ...], str]] = {}

    def _run(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """Token ids of a chunk, and the same in decimal. A piece that is a
        space and a word is looked up like a chunk; other pieces have a store
        of their own."""
        if chunk[0] == " " and chunk[1:].isalpha() and max(chunk) < _PLAIN_LETTERS:
            return self._ids(chunk)  # a piece for certain
        parts = []
        for piece in self.pieces(chunk):
            if piece[0] == " " and len(piece) > 1:
                hit = self._known(piece[1:]) or self._keep(piece[1:], self._ids(piece))
            else:
                hit = self.marks.get(piece)
                if hit is None:
                    hit = self._ids(piece)
                    if len(piece) <= CHUNK_CHARS:
                        if len(self.marks) >= self.max_chunks // 4:
                            self.marks.clear()
                        self.marks[piece] = hit
            parts.append(hit)
        if len(parts) == 1:
            return parts[0]
        return tuple(chain.from_iterable([p[0] for p in parts])), ",".join([p[1] for p in parts])

    def rest(self) -> None:
        """Drop what was kept; an idle worker holds the vocabulary only."""
        for store in (self.young, self.old, self.marks, self.transducer.heads, self.transducer.pair):
            store.clear()

    def _ids(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = self.transducer.run(piece.encode("utf-8"))
        return tuple(ids), ",".join(map(str, ids))

    def _known(self, word: str) -> tuple[tuple[int, ...], str] | None:
        return self.young.get(word) or self.old.get(word)

    def _keep(self, word: str, hit: tuple[tuple[int, ...], str]) -> tuple[tuple[int, ...], str]:
        if len(word) <= CHUNK_CHARS:
            if len(self.young) >= self.max_chunks:
                self.young, self.old = {}, self.young
            self.young[word] = hit
        return hit

    def _word(self, word: str) -> tuple[tuple[int, ...], str]:
        """The kept run over a space and ``word``."""
        return self._keep(word, self._known(word) or self._run(" " + word))

    def _open(self, word: str) -> bool:
        """Whether a cut beside ``word`` is not allowed: it is empty or has
        white space at an end (``isspace`` has all that the pattern's class
        has, and a few controls more)."""
        return not word or word[0].isspace() or word[-1].isspace()

    def _chunks(self, words: list[str]) -> Iterator[tuple[tuple[int, ...], str]]:
        """Runs of a text with words that may not be cut off: they stay with
        their neighbours."""
        at, n = 0, len(words)
        opened = [self._open(w) for w in words]
        while at < n:
            end = at + 1
            while end < n and (opened[end - 1] or opened[end]):
                end += 1
            if end == at + 1 and at:
                yield self._word(words[at])
            else:
                yield self._run((" " if at else "") + " ".join(words[at:end]))
            at = end

    def runs(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Runs of the text's chunks, in order."""
        if not text:
            return []
        words = text.split(" ")
        found = list(map(self.young.get, words))
        # The young store has only words that may be cut off.
        new = [k for k, hit in enumerate(found) if hit is None]
        if any([self._open(words[k]) for k in new]) or self._open(words[0]):
            return list(self._chunks(words))
        for k in new:
            word = words[k]
            found[k] = self.young.get(word) or self._keep(word, self.old.get(word) or self._run(" " + word))
        found[0] = self._run(words[0])
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([r[0] for r in self.runs(text)]))

    def count(self, text: str) -> int:
        return sum([len(r[0]) for r in self.runs(text)])

    def decimal(self, text: str) -> tuple[list[int], str]:
        """Token ids, and the same in decimal joined by commas."""
        runs = self.runs(text)
        return list(chain.from_iterable([r[0] for r in runs])), ",".join([r[1] for r in runs])


#: Classes of bytes that the decoder tells apart: first byte of the class, and
#: for each state the state that follows (-1: not UTF-8). State 0 is between
#: characters; 1, 2, 3 want that many continuation bytes of any value; 4-7 want
#: a continuation byte in a narrower range after E0, ED, F0 and F4. The ranges
#: are those of the Unicode standard's table of well-formed sequences.
_FIRST = {**{b: 0 for b in range(0x80)}, **{b: 1 for b in range(0xC2, 0xE0)},
          **{b: 2 for b in range(0xE1, 0xF0)}, **{b: 3 for b in range(0xF1, 0xF4)},
          0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
_NARROW = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


class Utf8:
    """Incremental UTF-8 state machine."""

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        """Characters finished by ``data``."""
        state, held, out = self.state, bytearray(self.held), []
        for byte in data:
            if state:
                low, high, then = _NARROW.get(state, (0x80, 0xBF, state - 1))
                if low <= byte <= high:
                    held.append(byte)
                    state = then
                    if not state:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")
                held.clear()
            state = _FIRST.get(byte, -1)
            if state < 0:
                out.append("�")
                state = 0
            elif state == 0:
                out.append(chr(byte))
            else:
                held.append(byte)
        self.state, self.held = state, bytes(held)
        return "".join(out)

    def finish(self) -> str:
        left, self.state, self.held = bool(self.held), 0, b""
        return "�" if left else ""


class Decoder:
    """Token ids to text, one token at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: token for token, rank in ranks.items()}
        #: Text of the tokens that begin and end between characters.
        self.closed: dict[int, str | None] = {}
        for rank, token in self.token.items():
            machine = Utf8()
            text = machine.feed(token)
            self.closed[rank] = text if not machine.state and "�" not in text else None

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete."""
        machine, closed, token = Utf8(), self.closed, self.token
        for i in ids:
            text = closed[i] if not machine.state else None
            yield machine.feed(token[i]) if text is None else text
        yield machine.finish()

    def decode(self, ids: list[int]) -> str:
        """All of ``stream`` in one text. While the machine stands between
        characters, closed tokens lead back there, so runs of them are joined
        at once."""
        parts = list(map(self.closed.__getitem__, ids))
        if None not in parts:
            return "".join(parts)
        machine, at, out = Utf8(), 0, []
        while at < len(ids):
            if machine.state:
                out.append(machine.feed(self.token[ids[at]]))
                at += 1
                continue
            try:
                end = parts.index(None, at)
            except ValueError:
                end = len(ids)
            out.extend(parts[at:end])
            if end < len(ids):
                out.append(machine.feed(self.token[ids[end]]))
            at = end + 1
        out.append(machine.finish())
        return "".join(out)


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per Python worker and vocabulary."""
    ranks = load_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks)


def utf8_text(data: bytes | None) -> str:
    """Text of UTF-8 bytes; null is empty."""
    return codecs.decode(data, "utf-8", "replace") if data else ""


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id long, ids array<int>, decoded string for every row. Null and
    empty texts have no ids and decode to the empty text; a null doc_id stays;
    repeated rows give repeated results; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(ranks_path, pattern)

        def rows():
            for b in it:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    ids = [encoder.encode(utf8_text(t)) for t in part.column(1).to_pylist()]
                    yield [part.column(0), ids, list(map(decoder.decode, ids))]
        yield from batches(schema, rows())
        encoder.rest()

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
            .mapInArrow(run, "doc_id long, ids array<int>, decoded string"))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string:
    the digests of ``encode_documents``'s ids (decimal, joined by commas) and
    decoded bytes, taken where they are made so that ids and texts need not
    leave the Python worker. Same treatment of edge cases."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(ranks_path, pattern)

        def rows():
            for b in it:
                counts, id_shas, text_shas = [], [], []
                for t in b.column(1).to_pylist():
                    ids, decimal = encoder.decimal(utf8_text(t))
                    counts.append(len(ids))
                    id_shas.append(sha(decimal.encode()))
                    text_shas.append(sha(decoder.decode(ids).encode()))
                yield [b.column(0), counts, id_shas, text_shas]
        yield from batches(schema, rows())
        encoder.rest()

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
