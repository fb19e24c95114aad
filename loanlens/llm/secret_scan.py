"""Secret scan: base patterns, and literals assigned to sensitive names.

The second part lexes source and configuration text into names, literals and
operators, parses name-literal pairs (``name = "x"``, ``name: x``, ``"name":
"x"``, ``name := "a" + "b"``, ``export NAME=x``, ``name => 'x'``), follows
constants (``a = "x"`` then ``password = a``) and scores each literal by the
words of the names it ends up in and by its own form. Comments are lexed as the
rest: their marker only ends a statement, and the ``//`` of a URL is none. An
apostrophe within a word begins no literal.

An unquoted value is one run of ``[A-Za-z0-9+/_.=-]``. A type between ``:`` and
``=`` (``key: str = "x"``) is stepped over, a subscript's string key
(``env["KEY"] = "x"``) is the target's name, and a PEM block of a private key
is a secret whatever name it has.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import batches, text_bytes

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.6
MIN_LITERAL = 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ of 24 or more

_HEX_BYTES = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * 24
_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: How much a word of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "token": 0.9, "private": 0.6, "auth": 0.6, "access": 0.4,
             "key": 0.5, "signing": 0.5, "encryption": 0.5, "api": 0.3, "client": 0.2, "session": 0.3}
_NAME_HINTS = tuple((w.encode(), weight) for w, weight in SENSITIVE.items())
#: Characters of a sum, from its first PEM mark on, that are looked at for a private key.
PEM_CHARS = 16_384
#: Words of a literal that stands in for a secret.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "redacted", "xxxx", "****")

LEXEME = re.compile(r"""
    (?P<pem>-----BEGIN\ (?:[A-Z0-9]+\ )*PRIVATE\ KEY(?:\ BLOCK)?-----
        (?:(?:(?!-----(?:BEGIN|END)\ )(?s:.))*-----END\ (?:[A-Z0-9]+\ )*PRIVATE\ KEY(?:\ BLOCK)?-----
          |(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})+))
  | (?P<subscript>\[[ \t]*(?:"[^"\\\n]*"|'[^'\\\n]*')[ \t]*\](?=[ \t]*(?::=|=(?![=>]))))
  | (?P<prefix>\b[bBrRuUfF]{1,2}(?=["']))
  | (?P<end>\#|(?<!:)//|\n|;|,|\{|\}|\(|\)|\[|\])
  | (?P<string>"(?:[^"\\\n]|\\.)*"|(?:(?<![A-Za-z0-9_\u00c0-\u024f])|(?<=\b[bBrRuUfF])|(?<=\b[bBrRuUfF]{2}))
        '(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z0-9_]+)*)
  | (?P<bare>(?!//)[A-Za-z0-9/][A-Za-z0-9+/_.-]*=*)
  | (?P<assign>:=|=>|=(?!=)|:(?!:))
  | (?P<plus>\+)
  | (?P<other>==|::|[^\sA-Za-z0-9_])
""", re.VERBOSE | re.ASCII)
#: What may follow an assignment: an unquoted value, or a type and ``=``.
VALUE = re.compile(r"[ \t]*(?!//)([A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]*)", re.ASCII)
_VALUE_HERE = re.compile(r"([A-Za-z0-9+/_.=-]+)", re.ASCII)
TYPE = re.compile(r"""[ \t]*(?:[&*][ \t]*)?(?:'[A-Za-z_]+[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)
    (?:\[[^\[\]=\n"']*(?:\[[^\[\]=\n"']*\][^\[\]=\n"']*)*\]|<[^<>=\n"']*>)*[?!]?
    (?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\[\]=\n"']*\])*)*[ \t]*(?==(?![=>]))""",
                  re.VERBOSE | re.ASCII)
_NAME_ONLY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z0-9_]+)*", re.ASCII)
_PEM_BODY = re.compile(r"PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END |\Z)", re.DOTALL)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """0 to 1 by the words of a name (snake, kebab, dotted or camel case)."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(parts)))


def is_private_key(value: str) -> bool:
    """Whether there is a PEM block of a private key in it, with a body that is
    no placeholder."""
    at = value.find("-----BEGIN ")
    m = LEXEME.search(value, at) if at >= 0 and "PRIVATE KEY" in value else None
    if not m or m.lastgroup != "pem":
        return False
    body = _PEM_BODY.search(m.group())[1].replace("\\n", "\n").replace("\\r", "\r")
    return (re.search(r"[A-Za-z0-9+/=]{8}", body) is not None
            and not (len(body) < 64 and any(p in body.lower() for p in PLACEHOLDERS)))


_NO_LITERAL = re.compile(r"\s|\$\{|\{\{|%\(|://")
_EDGE = 16  # longer than what _NO_LITERAL and PLACEHOLDERS look for


def mentions_placeholder(text: str) -> bool:
    low = text.lower()
    return any(p in low for p in PLACEHOLDERS)


class Value:
    """What the score of a literal, or of a sum of literals, rests on. Two
    values add up in time that does not depend on their lengths."""

    __slots__ = ("length", "counts", "plain", "head", "tail", "pem", "is_key")

    def __init__(self, text: str = ""):
        self.length = float(len(text))
        self.counts = {c: float(n) for c, n in Counter(text).items()}
        self.plain = not (_NO_LITERAL.search(text) or mentions_placeholder(text))
        self.head, self.tail = text[:_EDGE], text[-_EDGE:]
        at = text.find("-----BEGIN ")
        self.pem = self.tail if at < 0 else text[at:at + PEM_CHARS]
        self.is_key = is_private_key(text)

    def __add__(self, more: Value) -> Value:
        out = Value()
        out.length = self.length + more.length
        out.counts = dict(self.counts)
        for c, n in more.counts.items():
            out.counts[c] = out.counts.get(c, 0.0) + n
        if out.length > 1e200:  # a sum doubled hundreds of times: shares are all that counts
            out.length /= 1e100
            out.counts = {c: n / 1e100 for c, n in out.counts.items()}
        seam = self.tail + more.head
        out.plain = self.plain and more.plain and not (_NO_LITERAL.search(seam) or mentions_placeholder(seam))
        out.head = self.head if len(self.head) == _EDGE else (self.head + more.head)[:_EDGE]
        out.tail = more.tail if len(more.tail) == _EDGE else (self.tail + more.tail)[-_EDGE:]
        if len(self.pem) == PEM_CHARS and self.pem.startswith("-----BEGIN "):
            out.pem, out.is_key = self.pem, self.is_key
        else:
            # From the first mark on; a value without one may end in its beginning.
            marked = self.pem.startswith("-----BEGIN ")
            whole = self.pem + more.pem if marked else self.tail + more.pem
            at = whole.find("-----BEGIN ")
            out.pem = out.tail if at < 0 else whole[at:at + PEM_CHARS]
            out.is_key = is_private_key(out.pem)
        return out

    def score(self) -> float:
        """0 to 1 by form: length, no white space, variety. A PEM block of a
        private key has 1."""
        if self.is_key:
            return 1.0
        if self.length < MIN_LITERAL or not self.plain:
            return 0.0
        shares = [n / self.length for n in self.counts.values()]
        entropy = -sum(x * math.log2(x) for x in shares if x)
        kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "."
                 for c in self.counts}
        return min(1.0, entropy / 4.0) * (1.0 if len(kinds) > 1 else 0.6)


class Constant:
    """An assigned value with its parts: spans, and constants in it."""

    __slots__ = ("parts", "value", "reported")

    def __init__(self, parts: list, value: Value):
        self.parts, self.value, self.reported = parts, value, False

    def report(self, found: set) -> None:
        """Adds the spans of the value to ``found``; each constant is gone
        through once, whatever number of sums it is in."""
        stack = [self]
        while stack:
            constant = stack.pop()
            if not constant.reported:
                constant.reported = True
                for part in constant.parts:
                    if isinstance(part, Constant):
                        stack.append(part)
                    else:
                        found.add(part)


def literal_score(value: str) -> float:
    return Value(value).score()


def lexemes(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of each lexeme. An unquoted value after an
    assignment is one lexeme: a ``name``, ``bare`` (begins with a digit or a
    slash) or a ``run`` of names and other characters."""
    def value_kind(run: str) -> str:
        return "name" if _NAME_ONLY.fullmatch(run) else "bare" if run[0] in "0123456789/" else "run"

    at = 0
    while m := LEXEME.search(text, at):
        kind, value, start, at = m.lastgroup, m.group(), m.start(), m.end()
        if kind == "prefix":
            continue
        if kind == "subscript":
            yield "name", value[1:-1].strip()[1:-1], start, at
            continue
        yield kind, value, start, at
        if kind != "assign":
            continue
        if value == ":" and (m := TYPE.match(text, at)):
            yield "name", m[1], m.start(1), m.end(1)
            at = m.end()
            continue
        # '//' after '=' begins a value, after ':' the rest of a URL.
        m = (_VALUE_HERE if value != ":" and text.startswith("//", at) else VALUE).match(text, at)
        if m is None or text.startswith("-----BEGIN ", m.start(1)):
            continue
        start, end = m.span(1)
        quoted = text[end:end + 1] in ('"', "'", "`")
        if quoted and end - start <= 2 and LEXEME.match(text, start).lastgroup == "prefix":
            continue
        if quoted or text[end:end + 1] == ">":  # a=b="x", a = b+"x", a = b->x
            while end > start and text[end - 1] in "=+-":
                end -= 1
        elif text[end - 1] == "+" and re.match(r"[ \t]+[\"'`A-Za-z_]", text[end:end + 8]):  # a = b+ c
            end -= 1
        while end > start and text[end - 1] == ".":
            end -= 1
        if end == start:
            continue
        run, at = text[start:end], end
        yield value_kind(run), run, start, end
        head, _, rest = run.partition("=")
        if rest.strip("=") and _NAME_ONLY.fullmatch(head):  # env=KEY=x is KEY=x too
            yield "end", "", end, end
            yield "name", head, start, start + len(head)
            yield "assign", "=", start + len(head), start + len(head) + 1
            yield value_kind(rest), rest, start + len(head) + 1, end


def assignments(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(name, parts) of each assignment: a part is its kind (``name``, ``run``
    or ``literal``), and the span of the name or of the literal."""
    # Lexemes since the last statement end: (kind, text, start, end).
    pending: list[tuple[str, str, int, int]] = []
    first = 0  # where the last assignment begins, if more parts may follow it

    def parse(ended: bool = True) -> Iterator[tuple[str, list]]:
        nonlocal first
        k, first = 0, len(pending)
        while k + 2 < len(pending):
            kind, value, _, _ = pending[k]
            if kind not in ("name", "string") or pending[k + 1][0] != "assign":
                k += 1
                continue
            begin, names = k, [value if kind == "name" else value[1:-1]]
            if (kind == "name" and pending[k + 1][1] == ":" and k + 4 < len(pending)
                    and pending[k + 2][0] == "name" and pending[k + 3][:2] == ("assign", "=")):
                k += 2  # name: type = value, or a label before name = value
                names.append(pending[k][1])
            k += 2
            parts: list = []
            while k < len(pending):
                kind, value, start, end = pending[k]
                follows = pending[k + 1][0] if k + 1 < len(pending) else ""
                if kind == "string":
                    parts.append(("literal", start + 1, end - 1))
                elif kind in ("bare", "pem"):
                    parts.append(("literal", start, end))
                elif kind == "run" or kind == "name" and follows != "assign":
                    parts.append((kind, start, end))
                else:
                    break
                k += 1
                if k < len(pending) and pending[k][0] == "plus":
                    k += 1
                    continue
                break
            if k >= len(pending) and not ended:
                first = begin
            elif parts:
                for name in names:
                    yield name, parts

    limit = 4096
    for kind, value, start, end in lexemes(text):
        if kind == "end":
            yield from parse()
            pending.clear()
            limit = 4096
        else:
            if kind == "pem":  # wherever it stands
                yield "", [("literal", start, end)]
            pending.append((kind, value, start, end))
            if len(pending) > limit:  # prose without an end: only the last assignment may go on
                yield from parse(ended=False)
                del pending[:min(first, len(pending) - 8)]
                limit = 4096 + 2 * len(pending)
    yield from parse()


def assigned_literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of literals that end up in a sensitive name: straight, or through
    constants. A constant stands for all literals last assigned to it; a name
    that is no constant is a bare literal if it has a digit, as in
    configuration files, and else nothing. So is a run, unless a name in it is a
    constant: then it is a sum. Time grows in proportion to the text."""
    constants: dict[str, Constant] = {}
    found: set[tuple[int, int]] = set()
    for name, parts in assignments(text):
        value: list = []
        for kind, a, b in parts:
            if kind == "literal":
                value.append((a, b))
                continue
            pieces = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^+]+", text[a:b])]
            if not any(text[c:d] in constants for c, d in pieces):
                pieces = [(a, b)]
            for c, d in pieces:
                if text[c:d] in constants:
                    value.append(constants[text[c:d]])
                elif any(map(str.isdigit, text[c:d])):
                    value.append((c, d))
        total = None
        for x in value:
            part = x.value if isinstance(x, Constant) else Value(text[x[0]:x[1]])
            if part.is_key and not isinstance(x, Constant):
                found.add(x)
            total = part if total is None else total + part
        constants[name] = constant = Constant(value, total or Value())
        weight = sensitivity(name)
        if weight and value and weight * constant.value.score() >= threshold:
            constant.report(found)
    return sorted(found)


def scan(data: bytes | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans (start, end, kind) of a text, in code points."""
    if not data:
        return [], []
    lowered = data.lower()
    has_assign = any(h in lowered for h in _ASSIGN_HINTS)
    has_hex = _HEX_RUN in data.translate(_HEX_BYTES)
    has_access = b"AKIA" in data
    # A name's weight is at most that of all sensitive words in the text.
    has_name = b"PRIVATE KEY" in data or (
        (b"=" in data or b":" in data)
        and sum(weight for word, weight in _NAME_HINTS if word in lowered) >= THRESHOLD - 1e-9)
    if not (has_assign or has_hex or has_access or has_name):
        return [], []
    text = data.decode("utf-8", "replace")
    base: list[tuple[int, int, str]] = []
    if has_assign:
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if has_access:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if has_hex:
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    more = [(a, b, "literal") for a, b in assigned_literals(text)] if has_name else []
    return base, sorted(base + more, key=order)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id long, n_assign, n_access, n_hex,
    n_literal long, base_sha256 string, spans string (kind:start:end by start,
    then kind, end exclusive, in code points).

    Null and empty texts have no spans. A null doc_id stays; repeated rows
    give repeated results; an empty table gives no rows; other columns are
    ignored."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def row(data: bytes | None) -> tuple:
        base, every = scan(data)
        counts = Counter(kind for _, _, kind in every)
        return (*(counts[k] for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(schema, (
            [b.column(0), *map(list, zip(*map(row, b.column(1).to_pylist())))]
            for b in it if b.num_rows))

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
            .mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, "
                             "base_sha256 string, spans string"))
