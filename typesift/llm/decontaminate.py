"""Benchmark decontamination by a generalised suffix automaton.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  The automaton of all benchmark items is streamed over each
document's words; where the longest match reaches ``k`` words (or a whole
shorter item), the words of that window are hit.  Only runs of words whose
neighbouring pairs occur in some item, and which are long enough for the
shortest window, are streamed; no other place can hold a window.

Definite results: null or empty texts have no words; items without words or
with null text have no windows; a null item_id counts as hits but is not
listed; an item_id on several rows is one item; repeated document rows each
give a row; empty tables give no rows (documents) or no hits (benchmark);
extra columns are ignored by ``find`` and kept by ``decontaminate``.

The benchmark is a stated query set.  Its items go to the executors in blocks
of at most ``BLOCK_BYTES``; with more than one block the documents are read
once per block and the spans are joined by (doc_id, text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.session import shipped
from typesift.llm.suffix_automaton import SuffixAutomaton

WINDOW = 13
#: A document is contaminated when at least one word in so many is hit.
COVERAGE = 20
#: Item text in one automaton (about 500 bytes of automaton for each word).
BLOCK_BYTES = 4 << 20

SPAN = "array<struct<start: long, end: long>>"


class Matcher:
    """The automaton of a block of items, and the filters in front of it."""

    def __init__(self, items: list[tuple[str | None, bytes]], k: int):
        block = tb.Block([t for _, t in items]) if items else tb.Block([b""])
        starts, ends = block.runs(tb.ALNUM)
        h = block.hashes(starts, ends, tb.FOLDED_VALUES)
        first = block.first_of(starts)
        self.k, self.words = k, np.unique(h)
        ids = np.searchsorted(self.words, h)
        size = np.diff(first)
        size = size[size > 0]
        self.shortest = int(min(k, size.min())) if len(size) else 0
        at = np.flatnonzero(np.diff(tb.owners(first)) == 0) if len(h) else np.zeros(0, dtype=np.int64)
        self.pairs = np.unique(ids[at] * len(self.words) + ids[at + 1])
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.automaton = SuffixAutomaton(k).build(
            (name, ids[first[i]:first[i + 1]].tolist()) for i, (name, _) in enumerate(items))

    def match(self, block: tb.Block):
        """(word starts, word ends, first word of each text, hit words, items by text)."""
        starts, ends = block.runs(tb.ALNUM)
        first = block.first_of(starts)
        hit = np.zeros(len(starts), dtype=bool)
        found: dict[int, set[str]] = {}
        if not self.shortest or not len(starts):
            return starts, ends, first, hit, found
        h = block.hashes(starts, ends, tb.FOLDED_VALUES)
        ids = np.full(len(h), -1, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        known = self.words[place] == h[at]
        ids[at[known]] = place[known]
        text = tb.owners(first)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (text[:-1] == text[1:]))
        joined = np.zeros(len(ids) + 1, dtype=bool)  # joined[i]: word i follows word i - 1 in some item
        if len(self.pairs):
            pair = ids[both] * len(self.words) + ids[both + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[place] == pair] + 1] = True
        begins = np.flatnonzero((ids >= 0) & ~joined[:-1])
        stops = np.flatnonzero((ids >= 0) & ~joined[1:]) + 1
        long = stops - begins >= self.shortest
        for b, e in zip(begins[long].tolist(), stops[long].tolist()):
            for i, n, names in self.automaton.scan(ids[b:e].tolist()):
                hit[b + i + 1 - n:b + i + 1] = True
                found.setdefault(int(text[b]), set()).update(names)
        return starts, ends, first, hit, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str | None, bytes]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    out, size = [[]], 0
    for r in rows.where(F.length("text") > 0).toLocalIterator():  # the query set, one partition at a time
        raw = r["text"].encode("utf-8", "replace")
        if out[-1] and size + len(raw) > block_bytes:
            out.append([])
            size = 0
        out[-1].append((r["item_id"], raw))
        size += len(raw)
    return out


def _spans(first: np.ndarray, hit: np.ndarray, i: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[first[i]:first[i + 1]].astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, items, k: int) -> Matcher:
    """Built once per process."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items.value, k)
    return _matchers[name]


def _share(docs: DataFrame, items: list, k: int):
    import uuid

    spark = shipped(docs.sparkSession)
    return uuid.uuid4().hex, spark.sparkContext.broadcast(items), k


def _hits(rows: DataFrame, keys: list[str], items: list, k: int) -> DataFrame:
    """``keys`` of each row, with n_words, n_hit, items and spans against one block of items."""
    shared = _share(rows, items, k)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(*shared)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for lo, hi, _, block in tb.blocks(b.column("text")):
                _, _, first, hit, found = matcher.match(block)
                spans = [[{"start": s, "end": e} for s, e in _spans(first, hit, i)] if i in found else [] for i in range(hi - lo)]
                names = [sorted(n for n in found.get(i, ()) if n is not None) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in keys), pa.array(np.diff(first)),
                     pa.array(tb.per_text(first, hit)), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)],
                    names=[*keys, "n_words", "n_hit", "items", "spans"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", n_words long, n_hit long, items array<string>, spans {SPAN}"
    return rows.mapInArrow(find, schema)


def _joined(docs: DataFrame, blocks: list, k: int) -> DataFrame:
    """(doc_id, h, copies, n_words, n_hit, items, spans) over several blocks; h: hash of the text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
                        F.col("text").cast("string").alias("text"))
    parts = None
    for n, items in enumerate(blocks):
        one = _hits(keyed, ["doc_id", "h"], items, k).withColumn("block", F.lit(n))
        parts = one if parts is None else parts.unionByName(one)
    # rows with equal id and text have equal results: keep one, and how many there were
    once = parts.groupBy("doc_id", "h", "block").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_words", "items", "spans")))
    whole = once.groupBy("doc_id", "h").agg(
        F.first("copies").alias("copies"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    end = F.element_at
    merged = F.aggregate(
        "spans", F.expr(f"cast(array() as {SPAN})"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (end(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                end(done, -1)["start"].alias("start"), F.greatest(end(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    whole = whole.withColumn("spans", F.when(F.size("spans") > 1, merged).otherwise(F.col("spans")))
    return whole.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def find(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (hit word ranges, end exclusive)."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return _hits(rows, ["doc_id"], blocks[0], k)
    return (_joined(docs, blocks, k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_words", "n_hit", "items", "spans"))


def contaminated(n_words, n_hit, coverage: int = COVERAGE):
    return (n_hit > 0) & (coverage * n_hit >= n_words)


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word ranges, each from its first to its last word."""
    block = tb.Block([raw])
    starts, ends = block.runs(tb.ALNUM)
    rest, at = [], 0
    for s, e in spans:
        rest.append(raw[at:starts[s]])
        at = int(ends[e - 1])
    return b"".join([*rest, raw[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, coverage: int = COVERAGE, cut: bool = False,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without those over the coverage limit; all columns kept.

    cut: also remove the hit spans from the other texts (length limit ``k``).
    """
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        found = _joined(docs, blocks, k).where("n_hit > 0").select(
            F.col("doc_id").alias("doc_id_"), F.col("h").alias("h_"),
            contaminated(F.col("n_words"), F.col("n_hit"), coverage).alias("drop_"), F.col("spans").alias("spans_"))
        plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no clash with the joined columns
        doc_id, text = (plain[f"c{docs.columns.index(c)}"] for c in ("doc_id", "text"))
        rows = plain.join(found, doc_id.cast("long").eqNullSafe(F.col("doc_id_")) & (F.xxhash64(text) == F.col("h_")), "left")
        rows = rows.where(~F.coalesce("drop_", F.lit(False)))
        if cut:
            cutter = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: x if y is None or not len(y) else cut_spans(
                x.encode(), [(r["start"], r["end"]) for r in y]).decode("utf-8", "replace")), "string")
            rows = rows.withColumn(f"c{docs.columns.index('text')}", cutter(text, F.col("spans_")))
        return rows.select(*plain.columns).toDF(*docs.columns)
    shared = _share(docs, blocks[0], k)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(*shared)
        for b in batches:
            where = b.schema.get_field_index("text")
            for lo, hi, raw, block in tb.blocks(b.column("text")):
                _, _, first, hit, found = matcher.match(block)
                keep = ~contaminated(np.diff(first), tb.per_text(first, hit), coverage)
                part = b.slice(lo, hi - lo)
                if cut and any(keep[i] for i in found):
                    texts = part.column("text").to_pylist()
                    for i in (i for i in found if keep[i]):
                        texts[i] = cut_spans(raw[i], _spans(first, hit, i)).decode("utf-8", "replace")
                    part = part.set_column(where, b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = find(docs, benchmark)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))
