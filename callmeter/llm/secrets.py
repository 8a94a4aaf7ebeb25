"""Secret scans by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the scan's contract: the patterns of the three base kinds and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "lexed")

#: Target names that make a literal sensitive, by how much; matched against the parts of a name (`dbPassword`: db, password).
NAMES = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.0, "apikey": 3.0, "credential": 2.5,
         "credentials": 2.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.0, "private": 1.0, "key": 1.5, "access": 1.0, "client": 0.5,
         "salt": 1.0, "signing": 1.0, "encryption": 1.0, "session": 0.5, "dsn": 1.0}
#: Literals that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{?\w*\}?|\{\{.*\}\}|change_?me|your[_-].*|example.*|none|null|true|false|todo|redacted)$")

#: What a longer value is told by: the characters at its ends, and those of PLACEHOLDER that leave the end open.
HEAD = 64
OPEN_END = re.compile(r"(?i)^(?:your[_-]|example)")

_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_TARGET = r"(?<![\w.\-$])(?P<name>[A-Za-z_][\w.\-]*+)[\"']?\]?[ \t]*+(?::[ \t]*+\w++[ \t]*+(?==[^=]))?(?::=|=>|=(?!=)|:(?!:))[ \t]*+"
_TERM = r"\"[^\"\n]*+\"|'[^'\n]*+'|`[^`\n]*+`|[^\s\"'`,;(){}\[\]<>+]++"
PAIR = re.compile(rf"{_TARGET}(?P<value>(?:{_TERM})(?:[ \t]*+\+[ \t]*+(?:{_TERM}))*+)", re.ASCII)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)>(?P<value>[^<>\n]++)</", re.ASCII)
TERM = re.compile(_TERM)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


@dataclass(frozen=True)
class Profile:
    """What scoring asks of a value, whatever its length: profiles of parts add up to that of the whole."""
    length: int
    chars: Counter
    head: str  # the first and last HEAD characters: all of a value not longer
    tail: str
    ink: bool  # a character that is not white space
    blank: bool  # a space anywhere, with ink somewhere behind it, before it, on both sides
    before: bool
    after: bool
    between: bool

    @staticmethod
    def of(text: str) -> Profile:
        bare = text.strip()
        blank, ink = " " in text, bool(bare)
        return Profile(len(text), Counter(text), text[:HEAD], text[-HEAD:], ink, blank, ink and " " in text.rstrip(), ink and " " in text.lstrip(), " " in bare)

    def __add__(self, o: Profile) -> Profile:
        return Profile(self.length + o.length, self.chars + o.chars, (self.head + o.head)[:HEAD] if self.length < HEAD else self.head,
                       (self.tail + o.tail)[-HEAD:] if o.length < HEAD else o.tail, self.ink or o.ink, self.blank or o.blank,
                       self.before or o.before or self.blank and o.ink, self.after or o.after or self.ink and o.blank,
                       self.between or o.between or self.after and o.ink or self.ink and o.before)

    def placeholder(self) -> bool:
        """Whether PLACEHOLDER matches the value."""
        if self.length <= HEAD:
            return bool(PLACEHOLDER.match(self.head))
        chars, first, last = set(self.chars), self.head, self.tail
        if chars <= {"x", "X"} or chars in ({"*"}, {"."}) or OPEN_END.match(first):
            return True
        if "\n" not in chars and (first[0] == "<" and last[-1] == ">" or first[:2] == "{{" and last[-2:] == "}}"):
            return True
        shell = self.chars["{"] == (first[1] == "{") and self.chars["}"] == (last[-1] == "}") and self.chars["$"] == 1
        return first[0] == "$" and shell and all(re.match(r"\w", c) for c in chars - set("${}"))


class Pair:
    """A name and what it is given: literals with their places, and links to earlier pairs whose constants stand in it."""

    def __init__(self, name: str, parts: list[tuple[str, int, int] | Pair], quoted: bool) -> None:
        self.name, self.parts, self.quoted, self._profile = name, parts, quoted, None

    @property
    def profile(self) -> Profile:
        """Of the value with constants put in; each pair's is added up once, from its parts'."""
        todo = [self]
        while todo:
            p = todo[-1]
            unknown = [q for q in p.parts if isinstance(q, Pair) and q._profile is None]
            if unknown:
                todo += unknown
                continue
            todo.pop()
            if p._profile is None:
                p._profile = reduce(add, (q._profile if isinstance(q, Pair) else Profile.of(q[0]) for q in p.parts))
        return self._profile

    @property
    def value(self) -> str:
        return "".join(q.value if isinstance(q, Pair) else q[0] for q in self.parts)


def base_spans(text: str) -> list[Span]:
    """The spans of the three fixed patterns: leftmost matches that don't overlap within a kind, too short ones left out."""
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in the order of the text: `name = "x" + other`, `name: x`, `"name": "x"`, `<name>x</name>`.

    A bare word that names an earlier literal stands for that literal's value (constants are propagated), else for itself.
    """
    known: dict[str, Pair] = {}
    out = []
    matches = list(PAIR.finditer(text)) if "=" in text or ":" in text else []
    if "</" in text:
        matches = sorted(matches + list(ELEMENT.finditer(text)), key=lambda m: m.start())
    for m in matches:
        parts, quoted = [], m.re is ELEMENT
        at = m.start("value")
        for t in [m] if m.re is ELEMENT else TERM.finditer(m["value"]):
            s, e = m.span("value") if t is m else (at + t.start(), at + t.end())
            raw = text[s:e]
            if raw[0] in "\"'`":
                parts.append((raw[1:-1], s + 1, e - 1))
                quoted = True
            else:
                parts.append(known.get(raw) or (raw, s, e))
        pair = Pair(m["name"], parts, quoted)
        known[pair.name] = pair
        out.append(pair)
    return out


def entropy(chars: Counter) -> float:
    """Bits per character."""
    n = sum(chars.values())
    return -sum(c / n * math.log2(c / n) for c in chars.values()) if n else 0.0


def score(pair: Pair) -> float:
    """How likely the pair's literal is a secret: sensitivity of the name, plus what the literal looks like; 4 or more is reported."""
    parts = [p.lower() for p in _NAME.findall(pair.name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    name = sum(NAMES.get(p, 0.0) for p in {*parts, *joined})
    if not name:
        return 0.0
    v = pair.profile
    if v.length < 8 or v.placeholder() or v.between and not pair.quoted:
        return 0.0
    chars = "".join(v.chars)
    classes = sum(bool(re.search(c, chars)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(name, 4.0) + (entropy(v.chars) >= 3.0) + 0.5 * (classes >= 2) + 0.5 * (v.length >= 16) + 0.5 * pair.quoted - 1.5 * (chars.isalpha() and not pair.quoted)


def lexed_spans(text: str, least: float = 4.0) -> list[Span]:
    """Spans of the literals that the lexer finds behind sensitive names, constants used elsewhere included."""
    found, walked = set(), set()
    for pair in pairs(text):
        todo = [pair] if score(pair) >= least else []
        while todo:  # each pair is walked once in a text, however many others it stands in
            p = todo.pop()
            if id(p) in walked:
                continue
            walked.add(id(p))
            found |= {q[1:] for q in p.parts if not isinstance(q, Pair) and q[2] > q[1]}
            todo += [q for q in p.parts if isinstance(q, Pair)]
    return [Span("lexed", *s) for s in found]


def joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in order)


def scan_text(text: str, least: float = 4.0) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the lexer adds: literals that lie in no base span."""
    base = base_spans(text)
    lexed = lexed_spans(text, least)
    if not lexed:
        return base, lexed
    ends: list[tuple[int, int]] = []
    for s in sorted(base, key=lambda s: s.start):  # start, and the furthest end so far
        ends.append((s.start, max(s.end, ends[-1][1] if ends else 0)))
    out, i = [], 0
    for s in sorted(lexed, key=lambda s: s.start):
        while i < len(ends) and ends[i][0] <= s.start:
            i += 1
        if not (i and ends[i - 1][1] >= s.end):
            out.append(s)
    return base, out


def scan(documents: DataFrame, least: float = 4.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of documents; spans count code points, end exclusive.

    Each text is read whole, in one pass per pattern, in time linear in its length; no row needs another. Null text counts as empty:
    counts 0, `spans` empty, the digest of an empty string. Repeated rows each get a row. No rows: none. Other columns are left out.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, more = scan_text(t.as_py() or "", least)
                n = Counter(s.kind for s in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
