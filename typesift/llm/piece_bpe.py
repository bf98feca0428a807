"""SentencePiece BPE, encoding and decoding, by merge rounds over arrays.

A batch of texts is one array of code points.  It is cut where no piece of the
vocabulary holds both neighbours, so that no merge can cross; the parts are the
words.  Each distinct word of the batch is merged once: in every round each word's
smallest pair rank is found (a segmented minimum), the leftmost of its pairs are
merged at once, and the arrays are compacted, until no word has a pair left.

The library merges one pair at a time, the best score first and the leftmost of
equals.  A round does the same for a word as long as no merge makes a pair of the
same or a better rank; the word's later pairs then wait for the next round.  Words
that still have pairs after ``MAX_ROUNDS`` rounds (runs of one character, long
random strings) are finished by the library's rule with a queue.  Characters
without a piece become the pieces of their bytes.

Decoding gathers the bytes of all pieces of a batch in one step.

Scale: texts are encoded where they are read; nothing is shuffled.  A text over
1 MiB is taken in pieces cut between words, so memory is bounded by the longest
run of characters that vocabulary pieces may join.  Words are grouped by a hash
and compared character by character, so a collision can't change an id.

Definite results: null text is empty, an empty text has no ids; a byte that is
not UTF-8 is U+FFFD; every row gives a row, also repeated ones and those without
a doc_id; an empty table gives no rows; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.longtext import PIECE_BYTES, groups
from typesift.llm.session import shipped
from typesift.llm.tokens import vocabulary

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
MAX_ROUNDS = 48
#: Rank of a pair that is no piece.
NONE = np.int32(2**31 - 1)

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """A SentencePiece BPE model with byte fallback and no normalisation but the space mark."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        t, n = proto.trainer_spec, proto.normalizer_spec
        if t.model_type != BPE or not t.byte_fallback or t.treat_whitespace_as_suffix or n.precompiled_charsmap \
                or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces \
                or {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, a leading space mark and plain pieces are supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self._number(normal, {p.piece: p.score for p in proto.pieces})
        self.byte_id = np.zeros(256, dtype=np.int32)
        raw = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                raw.append({NORMAL: p.piece.replace(SPACE, " "), UNKNOWN: t.unk_surface, CONTROL: ""}[p.type].encode())
        kind = np.array([p.type for p in proto.pieces])
        self.is_byte, self.is_control = kind == BYTE, kind == CONTROL
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
        self.length = np.array([len(x) for x in raw], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def _number(self, normal: dict[str, int], score: dict[str, float]) -> None:
        """Symbols are piece ids; characters that pieces hold but that are none follow; others are negative."""
        self.n_pieces = max(normal.values()) + 1
        symbol = dict(normal)
        long = [p for p in normal if len(p) > 1]
        for c in sorted({c for p in long for c in p}):
            symbol.setdefault(c, self.n_pieces + len(symbol))
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = s
        best = {s: r for r, s in enumerate(sorted({score[p] for p in normal}, reverse=True))}
        self.rank_of = np.full(self.n_pieces + 1, NONE, dtype=np.int32)  # the last: no piece
        for p, i in normal.items():
            self.rank_of[i] = best[score[p]]
        pairs = {(symbol[p[:k]] << 32) + symbol[p[k:]]: normal[p] for p in long for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self._index(pairs)
        # characters that a piece joins to others, numbered from 1, and which of them may follow each other
        joined = {c: k + 1 for k, c in enumerate(sorted({c for p in long for c in p}))}
        self.join_class = np.zeros(0x110000, dtype=np.uint16)
        for c, k in joined.items():
            self.join_class[ord(c)] = k
        self.may_join = np.zeros((len(joined) + 1, len(joined) + 1), dtype=bool)
        for p in long:
            for a, b in zip(p, p[1:]):
                self.may_join[joined[a], joined[b]] = True

    def _index(self, pairs: dict[int, int]) -> None:
        """Pairs of symbols to pieces, by open addressing in two arrays; an empty place holds -1."""
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift = tb.U64(64 - bits)
        self.pair = np.full((1 << bits) + len(pairs), -1, dtype=np.int64)  # no place wraps around
        self.merged = np.full(len(self.pair), self.n_pieces, dtype=np.int32)
        for key, piece in pairs.items():
            at = (key * tb.BASE & 0xFFFFFFFFFFFFFFFF) >> 64 - bits
            while self.pair[at] >= 0:
                at += 1
            self.pair[at], self.merged[at] = key, piece

    # ---- encoding ---------------------------------------------------------

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, ``n_pieces`` if none."""
        key = (left.astype(np.int64) << 32) + right
        key[(left < 0) | (right < 0)] = -1
        at = ((key.view(np.uint64) * tb.U64(tb.BASE)) >> self.shift).astype(np.int64)
        there = self.pair[at]
        out = self.merged[at]
        wrong = np.flatnonzero((there != key) & (there >= 0))
        out[there != key] = self.n_pieces
        at, key = at[wrong], key[wrong]
        while len(wrong):
            at = at + 1
            there = self.pair[at]
            hit = there == key
            out[wrong[hit]] = self.merged[at[hit]]
            more = ~hit & (there >= 0)
            at, key, wrong = at[more], key[more], wrong[more]
        out[(left < 0) | (right < 0)] = self.n_pieces
        return out

    def joins(self, points: np.ndarray) -> np.ndarray:
        """Whether each character and the next may be in one piece."""
        k = self.join_class[points]
        return self.may_join.ravel()[k[:-1].astype(np.int64) * self.may_join.shape[1] + k[1:]]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, word, place of its first character) after all merges; word ascends."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.arange(len(symbols))
        made = np.full(len(symbols), self.n_pieces, dtype=np.int32)  # with the next symbol of the word
        pairs = np.flatnonzero(word[1:] == word[:-1])
        made[pairs] = self.pairs(symbols[pairs], symbols[pairs + 1])
        rounds = 0
        while len(symbols):
            rank = self.rank_of[made]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            left = least != NONE
            if not left.all():  # finished words go
                done.append((symbols[~left], word[~left], at[~left]))
                symbols, word, at, made, rank, least = (x[left] for x in (symbols, word, at, made, rank, least))
                if not len(symbols):
                    break
            if rounds == MAX_ROUNDS:
                done += self._queued(symbols, word, at)
                break
            rounds += 1
            p = np.flatnonzero(rank == least)
            run = np.concatenate(([True], np.diff(p) != 1))  # pairs that share a symbol: every second of a run
            k = np.arange(len(p))
            p = p[(k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0]
            p = p[self._safe(symbols, word, made, least, p)]
            symbols[p] = made[p]
            stale = np.zeros(len(symbols), dtype=bool)
            stale[p] = True
            stale[np.maximum(p - 1, 0)] = True
            keep = np.ones(len(symbols), dtype=bool)
            keep[p + 1] = False
            symbols, word, at, made, stale = (x[keep] for x in (symbols, word, at, made, stale))
            new = np.flatnonzero(stale)
            made[new] = self.n_pieces
            new = new[new < len(word) - 1]
            new = new[word[new] == word[new + 1]]
            made[new] = self.pairs(symbols[new], symbols[new + 1])
        symbols, word, at = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (zip(*done) if done else ((), (), ())))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order], at[order]

    def _safe(self, symbols, word, made, least, p) -> np.ndarray:
        """Which merges at ``p`` come before any pair that they bring: up to the first of each word that brings a rank as good."""
        new, n = made[p], len(symbols)
        before = np.where(p > 0, symbols[p - 1], -1)
        touching = np.concatenate(([False], np.diff(p) == 2))
        before = np.where(touching, np.concatenate((new[:1], new[:-1])), before)
        before = np.where((p > 0) & (word[p - 1] == word[p]), before, -1)
        after = np.minimum(p + 2, n - 1)
        following = np.where((p + 2 < n) & (word[after] == word[p]), symbols[after], -1)
        brings = np.minimum(self.rank_of[self.pairs(before, new)], self.rank_of[self.pairs(new, following)]) <= least[p]
        own = word[p]
        earlier = np.cumsum(brings) - brings
        start = np.concatenate(([True], own[1:] != own[:-1]))
        return earlier == np.maximum.accumulate(np.where(start, earlier, 0))

    def _queued(self, symbols, word, at) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The rest of the merges of each word, one at a time from a queue."""
        bounds = np.append(np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))), len(word)).tolist()
        table = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(m) for k, m in zip(self.pair.tolist(), self.merged.tolist()) if k >= 0}
        rank = self.rank_of.tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            s = symbols[lo:hi].tolist()
            n = len(s)
            nxt, prev, queue = [*range(1, n), -1], [*range(-1, n - 1)], []

            def offer(i: int, j: int) -> None:
                if i >= 0 and j >= 0 and (m := table.get((s[i], s[j]))) is not None:
                    heapq.heappush(queue, (rank[m], i, m, s[i], s[j]))

            for i in range(n - 1):
                offer(i, i + 1)
            while queue:
                _, i, m, a, b = heapq.heappop(queue)
                j = nxt[i]
                if s[i] != a or j < 0 or s[j] != b:
                    continue
                s[i], s[j] = m, None
                nxt[i] = nxt[j]
                if nxt[j] >= 0:
                    prev[nxt[j]] = i
                offer(prev[i], i)
                offer(i, nxt[i])
            kept = np.array([k for k in range(n) if s[k] is not None]) + lo
            yield np.array([x for x in s if x is not None], dtype=np.int32), word[kept], at[kept]

    def encode_points(self, points: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each code point's word, told at the word's first character).

        points: normalised texts in a row; firsts: where texts begin.
        """
        n = len(points)
        cut = np.ones(n, dtype=bool)
        cut[1:] = ~self.joins(points)
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, n))
        # distinct words: by hash, then compared
        values = tb.mix((points.astype(np.uint64) + tb.U64(1)) * tb.U64(tb.BASE))
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * power, out=sums[1:])
        code, _ = pd.factorize(tb.mix(((sums[starts + size] - sums[starts]) * inverse[starts]) ^ size.astype(np.uint64)))
        one = np.empty(code.max() + 1, dtype=np.int64)
        one[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        same = size == size[one[code]]
        shift = np.where(same, starts[one[code]] - starts, 0)
        equal = points == points[np.arange(n) + np.repeat(shift, size)]
        other = np.flatnonzero(~same | ~np.logical_and.reduceat(equal, starts))
        if len(other):  # another word of the same hash
            code[other] = len(one) + np.arange(len(other))
            one = np.concatenate([one, other])
        length = size[one]
        word = np.repeat(np.arange(len(one)), length)
        place = np.arange(len(word)) + np.repeat(starts[one] - (np.cumsum(length) - length), length)
        chars = points[place]
        symbols, word, at = self.merge(self.symbol_of[chars], word)
        ids, word = self._with_bytes(symbols, word, chars[at])
        many = np.bincount(word, minlength=len(one))
        offset = np.cumsum(many) - many
        out = many[code]
        flat = ids[np.arange(int(out.sum())) + np.repeat(offset[code] - (np.cumsum(out) - out), out)]
        count = np.zeros(n, dtype=np.int64)
        count[starts] = out
        return flat, count

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece as the ids of their character's bytes."""
        bare = np.flatnonzero((symbols < 0) | (symbols >= self.n_pieces))
        if not len(bare):
            return symbols, word
        raw = [chr(c).encode("utf-8", "replace") for c in chars[bare].tolist()]
        n = np.ones(len(symbols), dtype=np.int64)
        n[bare] = [len(r) for r in raw]
        ids = np.repeat(symbols, n)
        first = np.cumsum(n) - n
        inside = np.repeat(first[bare], n[bare]) + np.arange(int(n[bare].sum())) - np.repeat(np.cumsum(n[bare]) - n[bare], n[bare])
        ids[inside] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return ids, np.repeat(word, n)

    def encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        texts = [t.decode("utf-8", "each-byte") for t in raw]
        size = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(size)))
        points = np.frombuffer("".join(SPACE + t for t in texts if t).encode("utf-32-le", "replace"), dtype=np.uint32).copy()
        points[points == 0x20] = ord(SPACE)
        ids, counts = [np.zeros(0, dtype=np.int32)], np.zeros(len(points) + 1, dtype=np.int64)
        for lo, hi in self._steps(points):
            own = bounds[(bounds >= lo) & (bounds < hi)] - lo
            found, counts[lo:hi] = self.encode_points(points[lo:hi], own)
            ids.append(found)
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.concatenate(ids), total[bounds[1:]] - total[bounds[:-1]]

    def _steps(self, points: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of about ``limit`` characters that end between words."""
        lo = 0
        while lo < len(points):
            hi = min(lo + limit, len(points))
            while hi < len(points):
                cuts = np.flatnonzero(~self.joins(points[hi - 1:hi + limit]))
                if len(cuts):
                    hi += int(cuts[0])
                    break
                hi = min(hi + limit, len(points))
            yield lo, hi
            lo = hi

    # ---- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of ids in a row, ``counts`` of them each."""
        n = self.length[ids]
        shift = self.offset[ids] - (np.cumsum(n) - n)
        flat = self.bytes[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        begin, end = ends[bounds[:-1]], ends[bounds[1:]]
        # the mark of the first piece is no space
        real = np.append(np.flatnonzero(~self.is_control[ids]), len(ids))
        first = real[np.searchsorted(real, bounds[:-1])]
        begin = begin + ((first < bounds[1:]) & np.append(self.marked[ids], False)[first])
        # runs of byte pieces are decoded each on its own; a control piece ends one too
        loose = np.concatenate(([0], np.cumsum(self.is_byte[ids])))
        loose = loose[bounds[1:]] > loose[bounds[:-1]]
        out = [flat[b:e] for b, e in zip(begin.tolist(), end.tolist())]
        for i in np.flatnonzero(loose).tolist():
            kind = self.is_byte[ids[bounds[i]:bounds[i + 1]]].astype(np.int8) + 2 * self.is_control[ids[bounds[i]:bounds[i + 1]]]
            cuts = np.maximum(ends[bounds[i] + 1 + np.flatnonzero(np.diff(kind))], begin[i]).tolist()
            parts = zip([int(begin[i]), *cuts], [*cuts, int(end[i])])
            out[i] = "".join(flat[b:e].decode("utf-8", "each-byte") for b, e in parts).encode()
        return out


_power_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """tb.BASE**i and its inverse, kept per process."""
    if not _power_tables or len(_power_tables[0][0]) < n:
        tables = []
        for base in (tb.BASE, tb.BASE_INVERSE):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t))
        _power_tables[:] = [tuple(tables)]
    power, inverse = _power_tables[0]
    return power[:n], inverse[:n]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The process's model of a file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


# ---- Spark ----------------------------------------------------------------

def _texts_of(docs: DataFrame) -> DataFrame:
    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for lo, hi, raw in groups(b.column("text")):
                ids, n = m.encode(raw)
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))],
                                                 names=["doc_id", "ids"])

    return _texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids; null ids are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            lists = b.column("ids")
            n = np.array([x or 0 for x in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
            texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    shipped(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _ids_digest(ids: np.ndarray, step: int = 1 << 18) -> str:
    """SHA-256 of the decimal ids, joined by commas."""
    h = hashlib.sha256()
    for lo in range(0, len(ids), step):
        h.update(("," if lo else "").encode() + ",".join(map(str, ids[lo:lo + step].tolist())).encode())
    return h.hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for lo, hi, raw in groups(b.column("text")):
                ids, n = m.encode(raw)
                ends = np.cumsum(n).tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.array([_ids_digest(ids[s:e]) for s, e in zip([0, *ends], ends)], pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in m.decode(ids, n)], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11(docs: DataFrame) -> DataFrame:
    return digests(docs, vocabulary("piece_bpe_32k.model"))
