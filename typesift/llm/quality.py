"""Quality rules as a short-circuit cascade.

Every document gets the base measures.  Those that pass the base limits go
through the rules of ``RULES``, each only over what the earlier ones left, and
with what was measured already.  The order is fitted: on the texts of a bounded
sample that pass the base, each rule's cost (seconds of CPU beyond the base
measures) and selectivity (share rejected) are measured, and rules run by
rejection per cost.  The verdict is the same in any order; the time isn't.

Definite results: null or empty texts have no words and fail the base; equal
lines count from the second on; repeated rows each give a row; an empty table
gives no rows (and the rules' listed order); other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.session import shipped

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows of the sample that the cascade's order is fitted on.
SAMPLE_ROWS = 2000

_CHARS = tb.NON_SPACE & ~tb.byte_table(range(0x80, 0xC0))  # one per code point
_SYMBOLS = tb.byte_table(b"#*$%&|<>")
_UPPER = tb.byte_table(range(0x41, 0x5B))
_LETTER = tb.byte_table({*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})
_ASCII_LETTER = tb.byte_table({*range(0x41, 0x5B), *range(0x61, 0x7B)})
_EXCLAIM = tb.byte_table(b"!")


#: Counts of a view, one for each text.
_COUNTS = {"n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}


class View:
    """What the rules measure on a block of texts, each thing once."""

    def __init__(self, raw: list[bytes], block: tb.Block | None = None):
        self.raw = raw
        if block is not None:
            self.block = block

    def part(self, at: np.ndarray) -> View:
        """A view of the texts ``at``, with those of their counts that are known."""
        view = View([self.raw[i] for i in at.tolist()])
        for name in _COUNTS & self.__dict__.keys():
            view.__dict__[name] = self.__dict__[name][at]
        return view

    def copy(self) -> View:
        """The same texts and all that is known of them; what is measured later stays apart."""
        view = View(self.raw)
        view.__dict__.update(self.__dict__)
        return view

    @cached_property
    def block(self) -> tb.Block:
        return tb.Block(self.raw)

    @cached_property
    def words(self):
        starts, ends = self.block.runs(tb.NON_SPACE)
        return starts, ends, self.block.first_of(starts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def lines(self):
        """(starts, ends, first of each text) of the lines with a word."""
        starts, ends = self.block.lines()
        some = np.searchsorted(self.words[0], ends) > np.searchsorted(self.words[0], starts)
        starts, ends = starts[some], ends[some]
        return starts, ends, self.block.first_of(starts)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.diff(self.lines[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.block.counts(_CHARS)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.block.counts(_SYMBOLS)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        starts, ends, first = self.lines
        again = _again(self.block.hashes(starts, ends), tb.owners(first), "first")
        return tb.per_text(first, again)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self.words
        h, doc, at = tb.shingles(self.block.hashes(starts, ends), first, 3)
        at = at[_again(h, doc, False)]
        covered = np.zeros(len(starts), dtype=bool)
        for i in range(3):
            covered[at + i] = True
        return tb.per_text(first, covered)


def _again(h: np.ndarray, doc: np.ndarray, keep) -> np.ndarray:
    """Which values occur more than once in their text."""
    return pd.Series(tb.mix(h + tb.mix(doc.astype(np.uint64) + np.uint64(1)))).duplicated(keep=keep).to_numpy()


def _symbol_share(v: View) -> np.ndarray:
    return 10 * v.n_symbols > v.n_words


def _shouting(v: View) -> np.ndarray:
    return 100 * v.block.counts(_UPPER) > 40 * v.block.counts(_ASCII_LETTER)


def _exclaiming(v: View) -> np.ndarray:
    return 10 * v.block.counts(_EXCLAIM) > v.n_words


def _repeated_lines(v: View) -> np.ndarray:
    return 100 * v.n_dup_lines > 30 * v.n_lines


def _word_length(v: View) -> np.ndarray:
    return (v.word_chars < 3 * v.n_words) | (v.word_chars > 10 * v.n_words)


def _few_letters(v: View) -> np.ndarray:
    starts, ends, first = v.words
    sums = np.concatenate(([0], np.cumsum(_LETTER[v.block.data], dtype=np.int64)))
    with_letter = sums[ends] > sums[starts]
    return 100 * tb.per_text(first, with_letter) < 80 * v.n_words


def _trailing_off(v: View) -> np.ndarray:
    starts, ends, first = v.lines
    dots = ends - starts >= 3
    for i in (1, 2, 3):
        dots &= v.block.data[ends - i] == 0x2E
    return 100 * tb.per_text(first, dots) > 30 * v.n_lines


#: name: which texts a rule rejects
RULES: dict[str, Callable[[View], np.ndarray]] = {
    "symbol_share": _symbol_share, "shouting": _shouting, "exclaiming": _exclaiming, "repeated_lines": _repeated_lines,
    "word_length": _word_length, "few_letters": _few_letters, "trailing_off": _trailing_off}


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A view is cut down to the texts left when they are less than this share of it.
LEAST_SHARE = 0.7


def passes_base(view: View) -> np.ndarray:
    """Which texts pass the base limits; afterwards the view holds all base measures."""
    for name in MEASURES:
        getattr(view, name)
    return ~((view.n_words < MIN_WORDS) | (100 * view.n_repeat_words > MAX_REPEAT_PERCENT * view.n_words))


def narrowed(view: View, at: np.ndarray, left: np.ndarray) -> tuple[View, np.ndarray]:
    """The view of the texts ``at``, or one of those ``left`` if they are few."""
    if len(left) >= LEAST_SHARE * len(at):
        return view, at
    return view.part(np.searchsorted(at, left)), left


def verdict(view: View, left: np.ndarray, order: list[str]) -> tuple[np.ndarray, list[str | None]]:
    """(kept, rule that rejected) for the view's texts; rules see the texts ``left`` (ascending), each what is left of them."""
    kept, by = np.zeros(len(view.raw), dtype=bool), [None] * len(view.raw)
    at = np.arange(len(view.raw))  # texts of the view
    for name in order:
        if not len(left):
            break
        view, at = narrowed(view, at, left)
        out = RULES[name](view)[np.searchsorted(at, left)]
        for i in left[out].tolist():
            by[i] = name
        left = left[~out]
    kept[left] = True
    return kept, by


def cascade(raw: list[bytes], order: list[str]) -> tuple[np.ndarray, list[str | None]]:
    """(kept, rule that rejected) for texts; each rule sees only what is left."""
    return verdict(View(raw), np.arange(len(raw)), order)


def measured(view: View) -> tuple[int, dict[str, float], dict[str, int]]:
    """(texts that pass the base, each rule's CPU seconds over them, how many it rejects).

    The seconds are what the cascade would spend on the rule beyond the base measures.
    """
    passed = np.flatnonzero(passes_base(view))
    spent, out = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
    if len(passed):
        view, at = narrowed(view, np.arange(len(view.raw)), passed)
        view.block  # each cascade needs it, whatever its order
        for name, rule in RULES.items():
            own = view.copy()
            t = time.process_time()
            rejected = rule(own)
            spent[name] = time.process_time() - t
            out[name] = int(rejected[np.searchsorted(at, passed)].sum())
    return len(passed), spent, out


def fit_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, CPU seconds a text, share rejected) over texts that pass the base, by rejection per cost, best first."""
    shipped(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    chosen = texts.select("h").orderBy("h").limit(sample_rows)  # by a hash of the id, not the table's order
    few = texts.join(F.broadcast(chosen.distinct()), "h", "left_semi").select("text").limit(2 * sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, out, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for b in batches:
            for _, _, raw, block in tb.blocks(b.column("text")):
                passed, seconds, rejected = measured(View(raw, block))
                n += passed
                for name in RULES:
                    spent[name] += seconds[name]
                    out[name] += rejected[name]
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "spent": list(spent.values()), "out": list(out.values()), "n": [n] * len(RULES)})

    rows = few.repartition(1).mapInArrow(measure, "rule string, spent double, out long, n long").groupBy("rule").agg(
        F.sum("spent").alias("spent"), F.sum("out").alias("out"), F.sum("n").alias("n")).collect()
    found = {r["rule"]: (r["spent"] / max(r["n"], 1), r["out"] / max(r["n"], 1)) for r in rows}
    return by_rejection([(name, *found.get(name, (0.0, 0.0))) for name in RULES])


def by_rejection(table: list[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """(rule, cost, share rejected) by rejection per cost; of equal ones the cheaper first."""
    return sorted(table, key=lambda r: (-r[2] / max(r[1], 1e-9), r[1]))


def score(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    shipped(docs.sparkSession)
    order = order or [name for name, _, _ in fit_order(docs)]
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, block in tb.blocks(b.column("text")):
                view = View(raw, block)
                passed = passes_base(view)
                base = {m: np.asarray(getattr(view, m), dtype=np.int64) for m in MEASURES}
                kept, _ = verdict(view, np.flatnonzero(passed), order)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *map(pa.array, base.values()), pa.array(~passed), pa.array(kept)],
                    names=["doc_id", *MEASURES, "base_failed", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean"
    return texts.mapInArrow(rate, schema)


op4 = score
