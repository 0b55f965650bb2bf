"""Secrets in texts, with multipart credential linking.

Base matches stand alone: assignments to a password-like name, access identifiers and long hexadecimal runs. Weak candidates
(user-like names with a value, short or unlabelled tokens, hosts and addresses) prove nothing alone. They are joined by
interval, within scopes: a scope is a paragraph. A weak secret is reported when its scope holds an identifier, a weak
identifier when it holds a secret, and an endpoint when it holds both.
Candidates are linked before overlaps are resolved, so the parts of one URL are found. Parts whose values overlap are one
piece of text and do not prove each other.

A text is one row, whole; nothing is shuffled. Offsets are code points, end exclusive.

Defined cases: a null text counts as empty and has no spans. A weak identifier or secret that overlaps a base match is left
out, and so is an endpoint that lies within one. A linked candidate that lies within a reported identifier or secret is left
out too; other overlaps are all reported, an endpoint beside the parts that it holds. Repeated rows are judged alike. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.words import slices
from claimloom.session import spread

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# maximal runs: these are the leftmost matches of the open forms, less those that are too short
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})|\bA(?:KIA|SIA)[A-Z0-9]{8,}""", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""", re.IGNORECASE | re.ASCII)
_BREAK = re.compile(r"\n[\x20\t\r]*\n\s*")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the matches that stand alone, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return _sorted(found)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def weak_spans(text: str, base: list[Span]) -> list[tuple[Span, int]]:
    """Candidates that are reported only beside complementary parts, and where the value of each begins. They may overlap."""
    found = [((m.start(), m.end(), "identifier"), m.start(1) if m[1] else m.start()) for m in _IDENTIFIER.finditer(text)]
    found += [((m.start(), m.end(), "secret"), m.start(2)) for m in _ASSIGN.finditer(text) if 6 <= len(m[2]) < 12]
    found += [((m.start(), m.end(), "secret"), m.start()) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    found += [((m.start(), m.end(), "endpoint"), m.start()) for m in _ENDPOINT.finditer(text)]
    taken = [(s, e) for s, e, _ in base]

    def free(span: Span) -> bool:
        start, end, kind = span
        clear = (lambda s, e: start < s or e < end) if kind == "endpoint" else (lambda s, e: end <= s or e <= start)
        return all(clear(s, e) for s, e in _near(taken, span))

    return sorted((x for x in found if free(x[0])), key=lambda x: (x[0][0], KINDS.index(x[0][2]), x[0][1]))


def _near(taken: list[tuple[int, int]], span: Span) -> list[tuple[int, int]]:
    """Base matches that may overlap span; those of one kind never overlap, so three precede it at most."""
    i = bisect_left(taken, (span[1], -1))
    return taken[max(0, bisect_left(taken, (span[0], -1)) - 3) : i]


class _Parts:
    """Parts of one role, as spans and the starts of their values, for the interval join. A value ends with its span."""

    def __init__(self, parts: list[tuple[Span, int]]):
        parts = sorted(parts)
        self.starts = [span[0] for span, _ in parts]
        self.values = list(accumulate((value for _, value in parts), max))
        self.ends = sorted(span[1] for span, _ in parts)

    def met(self, low: int, high: int) -> bool:
        """Whether a part overlaps [low, high]: more have begun by its end than have ended before its start."""
        return bisect_right(self.starts, high) > bisect_left(self.ends, low)

    def last(self, high: int) -> float:
        """The last start of a value among the parts that begin by high."""
        i = bisect_right(self.starts, high)
        return self.values[i - 1] if i else -inf

    def first(self, low: int) -> float:
        """The first end among the parts that end at low or later."""
        i = bisect_left(self.ends, low)
        return self.ends[i] if i < len(self.ends) else inf


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak candidates whose complementary parts co-occur in their scope, less those within a reported one."""
    weak = weak_spans(text, base)
    if not weak:
        return []
    breaks = [0, *(m.end() for m in _BREAK.finditer(text)), len(text) + 1]
    assigned = {m.start(): m.start(2) for m in _ASSIGN.finditer(text)}
    proof = [(span, assigned[span[0]] if span[2] == "assign" else span[0]) for span in base]
    of = lambda parts, kinds: _Parts([x for x in parts if x[0][2] in kinds])
    sure = [of(proof, kinds) for kinds in (("assign", "hex"), ("access",))]
    secrets, identifiers = (of(proof + weak, kinds) for kinds in (("assign", "hex", "secret"), ("access", "identifier")))
    out, covered = [], 0
    for (start, end, kind), value in weak:
        i = bisect_right(breaks, start) - 1
        low, high = breaks[i], breaks[i + 1] - 1
        if kind == "endpoint":
            # a secret and an identifier, of two values; matches that stand alone need not be two
            linked = all(parts.met(low, high) for parts in sure) or secrets.first(low) <= identifiers.last(high) or identifiers.first(low) <= secrets.last(high)
        else:
            others = identifiers if kind == "secret" else secrets
            linked = others.first(low) <= value or others.last(high) >= end
        if linked and end > covered:
            out.append((start, end, kind))
            covered = covered if kind == "endpoint" else end
    return out


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text or "")
    return base, _sorted(base + linked_spans(text or "", base))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [spans_of(x) for x in batch.column(1).to_pylist()]
                counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS[:3]]
                shas = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *counts, pa.array(shas, pa.string()), pa.array([_written(every) for _, every in found], pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64())],
                    [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(of, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every reported span of text_col replaced by its kind in angle brackets; null texts stay null."""
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = [x if x is None else redacted(x, spans_of(x)[1]) for x in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return spread(docs).mapInArrow(of, docs.schema)
