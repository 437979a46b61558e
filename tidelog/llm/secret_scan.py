"""Secret scan: fixed patterns, and an assignment-aware lexer that scores literals by the names they are given to."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import text_or_empty

# The patterns that the query's contract names.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Kinds of spans in their order; those of the patterns come first.
KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]

# Words of a name, and how far each makes what is assigned to it a secret.
NAME_WORDS = {
    "apikey": 0.9,
    "auth": 0.5,
    "bearer": 0.7,
    "credential": 0.8,
    "credentials": 0.8,
    "key": 0.4,
    "passphrase": 0.9,
    "passwd": 0.9,
    "password": 0.9,
    "private": 0.4,
    "pwd": 0.8,
    "secret": 0.9,
    "signature": 0.5,
    "token": 0.8,
}
# Literals that stand where a secret would be filled in.
PLACEHOLDERS = ("changeme", "example", "placeholder", "redacted", "your", "dummy", "xxxx", "****", "....")
LEAST_SCORE = 0.5
LEAST_LITERAL = 8

_HINTS = ("pass", "secret", "token", "api")
_NAME_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "private", "bearer", "signature")
# Runs are possessive and begin at the edge of a word, so that long words and lines take time in proportion to them.
_LONG_STRING = r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''"
_STRING = _LONG_STRING + r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
_PAIR = re.compile(
    rf"""(?<![\w.\-])(?P<quote>["']?)(?P<name>[A-Za-z_][\w.\-]*+)(?P=quote)(?:\[[^\[\]\n]*+\])?[ \t]*+(?::[ \t]*+[A-Za-z_][\w.\[\]]*+[ \t]*+=|:=|=>|(?<![=!<>])=(?!=)|:(?!//))[ \t]*+
    (?:(?P<strings>(?:{_STRING})(?:[ \t]*+\+?[ \t]*+(?:{_STRING}))*+)|(?P<bare>[^\s,;"'`<>(){{}}\[\]]++)(?P<more>(?:[ \t]*+\+[ \t]*+[A-Za-z_][\w.]*+)*+))""",
    re.VERBOSE | re.ASCII,
)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)(?:[ \t][^<>\n]*+)?>(?P<bare>[^<>\n]++)</(?P=name)>", re.ASCII)
_FLAG = re.compile(r"(?<!\S)--(?P<name>[A-Za-z][\w\-]*+)[ \t]++(?:(?P<strings>" + _STRING + r")|(?P<bare>[^\s\-][^\s]*+))", re.ASCII)
# A name and a literal as the first arguments of a call.
_CALL = re.compile(r"\(\s*+(?P<quote>[\"'])(?P<name>[A-Za-z_][\w.\-]*+)(?P=quote)\s*+,\s*+(?P<strings>" + _STRING + ")", re.ASCII)
# A line that opens a block of deeper lines, and a line of such a block that gives the block's name its value.
_OPENING = re.compile(r"^(?P<indent>[ \t]*+)(?:-[ \t]++)?(?P<quote>[\"']?)(?P<name>[A-Za-z_][\w.\-]*+)(?P=quote)[ \t]*+:[ \t]*+\r?$", re.ASCII | re.MULTILINE)
_VALUE = re.compile(r"(?:\r?\n(?P<indent>[ \t]++)(?:(?P<quote>[\"']?)(?P<key>[A-Za-z_][\w.\-]*+)(?P=quote)[ \t]*+:[ \t]*+(?:(?P<strings>" + _STRING + r")|(?P<bare>[^\s,;\"'`<>(){}\[\]]++))[^\n]*+))", re.ASCII)
# Keys of a block that hold what its name stands for.
VALUE_KEYS = ("value", "default", "data", "literal", "content", "plain", "text")
_ONE_STRING = re.compile(_STRING)
_NAMES = re.compile(r"[A-Za-z_][\w.]*")
_REFERENCE = re.compile(r"\$?\{?(?:process\.env\.|os\.environ\.|env\.|self\.|this\.)?(?P<name>[A-Za-z_]\w*)\}?", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    stop: int
    name: str | None
    score: float


class Pair(NamedTuple):
    """A name and the literal given to it; a bare word may be the name of another literal."""

    name: str
    literal: str
    start: int
    stop: int
    bare: bool


def name_score(name: str) -> float:
    """How far a name calls for a secret: words in snake, kebab, dotted or camel case add up, 1 at most."""
    words = {x.lower() for x in _PARTS.findall(name)}
    joined = name.lower().replace("_", "").replace("-", "")
    found = [NAME_WORDS[w] for w in words if w in NAME_WORDS] or [v for k, v in NAME_WORDS.items() if v >= 0.8 and joined.endswith(k)]
    if "api" in words and "key" in words or "access" in words and "key" in words:
        found.append(0.5)
    return min(1.0, sum(found))


def literal_score(literal: str) -> float:
    """How far a literal looks like a secret: 0 for short or filler text, more for mixed and evenly spread characters."""
    lower = literal.lower()
    if len(literal) < LEAST_LITERAL or any(p in lower for p in PLACEHOLDERS) or any(c.isspace() for c in literal):
        return 0.0
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, min(1.0, entropy / 4) * (0.4 + 0.3 * min(classes, 3))) if classes > 1 else 0.5 * min(1.0, entropy / 4)


def pairs(text: str) -> list[Pair]:
    """Names and literals in source and configuration syntax: assignments, mappings, elements, flags, calls and blocks.

    Names that are joined to a sum give a pair each. Strings of three quotes may go over lines.
    """
    found = []
    for pattern in (_PAIR, _ELEMENT, _FLAG, _CALL):
        for match in pattern.finditer(text):
            found.append(_pair(match["name"], match))
            if match.groupdict().get("more"):
                found += [Pair(match["name"], m[0], m.start(), m.end(), True) for m in _NAMES.finditer(text, match.start("more"), match.end("more"))]
    return found + _block_values(text)


def _pair(name: str, match: re.Match) -> Pair:
    if not match.groupdict().get("strings"):
        literal = match["bare"].rstrip(".,:")
        return Pair(name, literal, match.start("bare"), match.start("bare") + len(literal), True)
    parts = [m[0] for m in _ONE_STRING.finditer(match["strings"])]
    edges = [3 if len(p) >= 6 and p[:3] in ('"""', "'''") else 1 for p in parts]
    literal = "".join(p[n:-n] for p, n in zip(parts, edges, strict=True))
    return Pair(name, literal, match.start("strings") + edges[0], match.end("strings") - edges[-1], False)


def _block_values(text: str) -> list[Pair]:
    """Pairs of a block's name and the literal that one of VALUE_KEYS has in the lines right under it."""
    found = []
    for opening in _OPENING.finditer(text):
        at = opening.end("name")
        at = text.find("\n", at) - (text[opening.end() - 1 : opening.end()] == "\r")
        while (line := _VALUE.match(text, at)) and len(line["indent"]) > len(opening["indent"]):
            if line["key"].lower() in VALUE_KEYS:
                found.append(_pair(opening["name"], line))
            at = line.end()
    return found


def _references(own: list[Pair]) -> tuple[dict[str, list[int]], list[str | None]]:
    """The pairs that define each name, and for each pair the name that it holds; none where that leads to no literal."""
    defined: dict[str, list[int]] = {}
    for k, pair in enumerate(own):
        defined.setdefault(pair.name.rpartition(".")[2], []).append(k)
    held: list[str | None] = []
    users: dict[str, list[int]] = {}
    for k, pair in enumerate(own):
        named = _REFERENCE.fullmatch(pair.literal) if pair.bare else None
        held.append(named["name"] if named and named["name"] in defined else None)
        users.setdefault(held[-1], []).append(k)
    # From the literals back along the names; names that lead only to each other are not reached.
    ends, known = users.pop(None, []), set()
    while ends:
        name = own[ends.pop()].name.rpartition(".")[2]
        if name not in known:
            known.add(name)
            ends += users.get(name, [])
    return defined, [name if name in known else None for name in held]


def literal_spans(text: str) -> list[Span]:
    """Literals that reach LEAST_SCORE by the name they are given to, or that a name so given leads to.

    A name leads to all literals that it is given in the text, over any number of other names.
    """
    own = pairs(text)
    defined, held = _references(own)
    weights = [name_score(pair.name) for pair in own]
    best: dict[tuple[int, int], Span] = {}
    # From the heaviest name on, so that what is reached a second time, a pair or a name, needs no second look.
    seen: set[int] = set()
    for source in sorted((k for k, weight in enumerate(weights) if weight), key=lambda k: -weights[k]):
        todo = [source]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if held[at] is not None:
                todo += defined.pop(held[at], [])
                continue
            pair = own[at]
            score, key = weights[source] * literal_score(pair.literal), (pair.start, pair.stop)
            if score >= LEAST_SCORE and (key not in best or best[key].score < score):
                best[key] = Span("literal", *key, own[source].name, score)
    return list(best.values())


def find_secrets(text: str) -> list[Span]:
    """All spans of a text, in code points, by start, then kind, then end."""
    found = []
    lower = text.lower()
    if any(x in lower for x in _HINTS):
        found += [Span("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", *m.span(), None, 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [Span("hex", *m.span(), None, 1.0) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text or "</" in text or "--" in text or "(" in text) and any(x in lower for x in _NAME_HINTS):
        found += literal_spans(text)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.stop))


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and spans(kind, start, stop, name, score), in order.

    Spans of the kinds assign, access and hex are the leftmost matches of the fixed patterns that don't overlap others
    of their kind. A literal's span is one that the lexer found: the text is read as pairs of a name and a literal,
    strings that are joined count as one, names that stand for constants of the same text lead on to all their literals,
    and the literal's score is that of the name times that of its own look. Texts are scanned whole, each on its own,
    without a shuffle. Null text counts as empty and has no spans. Row order, repeated rows and null ids don't matter.
    Other columns of docs are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            spans = [[s._asdict() for s in find_secrets(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = "array<struct<kind: string, start: long, stop: long, name: string, score: double>>"
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(scan, f"doc_id {kind}, spans {found}")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """:func:`secret_spans` as counts of the patterns' spans, the digest of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return secret_spans(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
