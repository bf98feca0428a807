"""Secret scans by one combined deterministic automaton.

All rules' regexes are compiled into one minimised automaton (see dfa), which
reads each byte of a text once and gives the regions that all matches of a
rule begin in.  The rule itself is then only run there, to set the ends of
the span and the length of its secret.  No rule crosses a line break.

Definite results: null or empty texts have no spans; spans are code points,
end exclusive, leftmost and non-overlapping within a kind, ordered by start
and then by kind as listed in ``RULES``; repeated rows each give a row; an
empty table gives no rows; other columns are ignored by ``find`` and kept by
``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.dfa import Scanner, compile_rules
from typesift.llm.session import shipped

BASE = ("assign", "access", "hex")

#: kind: (regex, group that holds the secret, least length of that group); base kinds first
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
}

_OPEN_END = re.compile(r"(.*)(\[[^]]+\])\+(\)?)")


def scanned(rule: str, least: int) -> str:
    """What the automaton looks for: the rule up to the first byte that completes a match.

    A last ``[class]+`` is cut to one byte, since open ends of several rules at
    once would multiply the states; the least length of a rule that is one
    class alone is put in.  The rule matches from just the places where this does,
    but for lengths, which are checked on the whole match.
    """
    end = _OPEN_END.fullmatch(rule)
    if not end:
        return rule
    return end[1] + end[2] + end[3] if end[1] else f"{end[2]}{{{least}}}"


KINDS = list(RULES)
_PATTERNS = [re.compile(r.encode()) for r, _, _ in RULES.values()]
_CHARS = ~tb.byte_table(range(0x80, 0xC0))  # one byte of each code point

_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """The combined automaton, built once per process."""
    if not _scanner:
        _scanner.append(compile_rules([scanned(rule, least) for rule, _, least in RULES.values()]))
    return _scanner[0]


def scan_block(block: tb.Block) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind number, end) of the spans of the texts that have any."""
    spans, least, group = [], [r[2] for r in RULES.values()], [r[1] for r in RULES.values()]
    done = [0] * len(KINDS)  # end of each kind's last match
    for text, kind, lo, hi in zip(*(x.tolist() for x in scanner().regions(block))):
        rule, at = _PATTERNS[kind], max(lo, done[kind])
        while at < hi and (first := rule.search(block.bytes, at, hi)):
            match = rule.match(block.bytes, first.start())  # to its end, which may lie beyond the region
            at = done[kind] = match.end()
            if match.end(group[kind]) - match.start(group[kind]) >= least[kind]:
                spans.append((text, match.start(), kind, at))
    if not spans:
        return {}
    chars = np.concatenate(([0], np.cumsum(_CHARS[block.data], dtype=np.int64)))  # code points before each byte
    text, start, kind, end = np.array(sorted(spans), dtype=np.int64).T
    before = chars[block.bounds[text]]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, s, k, e in zip(text.tolist(), (chars[start] - before).tolist(), kind.tolist(), (chars[end] - before).tolist()):
        found.setdefault(i, []).append((s, k, e))
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (kind, start, end)."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, block in tb.blocks(b.column("text")):
                found = scan_block(block)
                rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found.get(i, ())] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(rows, _SPANS)], names=["doc_id", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; all columns kept."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = b.schema.get_field_index("text")
            for lo, hi, _, block in tb.blocks(b.column("text")):
                part = b.slice(lo, hi - lo)
                found = scan_block(block)
                if found:
                    texts = part.column("text").to_pylist()
                    for i, spans in found.items():
                        texts[i] = masked(texts[i], [(s, e) for s, _, e in spans], mark)
                    part = part.set_column(where, b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each span, and each group of overlapping ones, replaced."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest_columns(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    of_base = F.filter("found", lambda s: s["kind"].isin(list(base)))
    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(text(of_base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op9(docs: DataFrame) -> DataFrame:
    return digest_columns(find(docs), BASE)
