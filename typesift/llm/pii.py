"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes, identifier
cues, a plus before a digit, and neighbouring digits (plain, or joined by one
dot, space or hyphen).  From each anchor a deterministic parser walks to the
boundaries of the value and validates it.

Kinds, in order: email, ip, card, phone (the base), then link (a URL with a
user and password before its host), iban (after the cue, checked modulo 97)
and ssn (after the cue, no impossible area, group or serial).

Definite results: null or empty texts have no spans; spans are code points,
end exclusive, leftmost and non-overlapping within a kind, ordered by start
and then by kind; repeated rows each give a row; an empty table gives no rows;
other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm.secrets import digest_columns, masked
from typesift.llm.session import shipped

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "link", "iban", "ssn")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")

_automaton: list = []


def anchors():
    """The automaton of all anchors, built once per process; values: the parser's name."""
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        for d in "0123456789":
            a.add_word("+" + d, ("phone", 2))
            for e in "0123456789":
                a.add_word(d + "." + e, ("ip", 3))
                for joint in ("", " ", "-"):
                    a.add_word(d + joint + e, ("card", 2 + len(joint)))
        for scheme in ("http://", "https://", "ftp://"):
            a.add_word(scheme, ("link", len(scheme)))
        for cue in ("IBAN", "iban", "Iban"):
            a.add_word(cue, ("iban", len(cue)))
        for cue in ("SSN", "ssn"):
            a.add_word(cue, ("ssn", len(cue)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def _run(text: str, at: int, members: frozenset) -> int:
    """End of the run of ``members`` from ``at``."""
    n = len(text)
    while at < n and text[at] in members:
        at += 1
    return at


def _email(text: str, at: int, floor: int):
    """Around the at-sign at ``at``: local part, then labels joined by single dots."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    whole = end
    while whole < len(text) and text[whole] == "." and (nxt := _run(text, whole + 1, _LABEL)) > whole + 1:
        whole = nxt
    return (start, whole, True) if whole > end else None


def _ip(text: str, at: int, floor: int):
    """Around a digit-dot-digit: four groups of digits from the first group of the chain."""
    start = at
    while start > floor and (text[start - 1] in _DIGITS or text[start - 1] == "." and start - 1 > floor
                             and text[start - 2] in _DIGITS and text[start] in _DIGITS):
        start -= 1
    end, parts = _run(text, start, _DIGITS), 1
    while parts < 4 and end < len(text) and text[end] == "." and (nxt := _run(text, end + 1, _DIGITS)) > end + 1:
        end, parts = nxt, parts + 1
    if parts < 4:
        return None
    return start, end, all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text[start:end].split("."))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card(text: str, at: int, floor: int):
    """The run of digits, joined by at most one space or hyphen, that begins at ``at`` (or after ``floor``)."""
    start = end = max(at, floor)
    n = len(text)
    count = 0
    while end < n:
        if text[end] in _DIGITS:
            end += 1
            count += 1
        elif text[end] in " -" and count and end + 1 < n and text[end + 1] in _DIGITS:
            end += 1
        else:
            break
    if count < 2:
        return None
    return start, end, 14 <= count <= 19 and luhn("".join(c for c in text[start:end] if c in _DIGITS))


def _phone(text: str, at: int, floor: int):
    """From a plus and a digit: to the last digit of the run that follows, with something between."""
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15


_LINK = re.compile(r"[A-Za-z0-9._~%+-]+:[^\s@/]+@[A-Za-z0-9.-]+", re.ASCII)
_IBAN = re.compile(r"[:\x20]*([A-Z]{2}[0-9]{2}[A-Z0-9]+)", re.ASCII)
_SSN = re.compile(r"[:#\x20]*([0-9]{3})-([0-9]{2})-([0-9]+)", re.ASCII)


def _link(text: str, at: int, floor: int, width: int):
    m = _LINK.match(text, at + width)
    return (at, m.end(), True) if m else None


def _iban(text: str, at: int, floor: int, width: int):
    m = _IBAN.match(text, at + width)
    if not m:
        return None
    code = m[1][4:] + m[1][:4]
    return m.start(1), m.end(1), 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def _ssn(text: str, at: int, floor: int, width: int):
    m = _SSN.match(text, at + width)
    if not m:
        return None
    area, group, serial = m.groups()
    return m.start(1), m.end(), area not in ("000", "666") and area < "900" and group != "00" and len(serial) == 4 and serial != "0000"


_PLAIN = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}
_CUED = {"link": _link, "iban": _iban, "ssn": _ssn}


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind."""
    done = dict.fromkeys(KINDS, 0)  # nothing of the kind begins before
    out = []
    for last, (kind, width) in anchors().iter(text):
        at = last - width + 1
        if at < done[kind]:
            # the anchor's first character belongs to what was parsed before
            if kind != "card" or last < done[kind]:
                continue
            at = done[kind]
        found = _PLAIN[kind](text, at, done[kind]) if kind in _PLAIN else _CUED[kind](text, at, done[kind], width)
        if found:
            start, end, valid = found
            done[kind] = end
            if valid:
                out.append((start, end, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (kind, start, end)."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """The documents with every span replaced by ``mark``; all columns kept."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, [(s, e) for s, e, _ in spans_of(t)], mark) if t else t for t in b.column("text").to_pylist()]
            field = b.schema.field("text")
            yield b.set_column(b.schema.get_field_index("text"), field, pa.array(texts, field.type))

    return docs.mapInArrow(run, docs.schema)


def op10(docs: DataFrame) -> DataFrame:
    return digest_columns(find(docs), BASE)
