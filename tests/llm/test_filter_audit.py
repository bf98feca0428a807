"""The filter audit against brute force, and its defined results on odd input."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from typesift.llm import filter_audit as A
from typesift.llm import longtext

SCHEMA = "doc_id long, text string, source string, part int, fails string, first boolean, good string, a0 long"
LABELS = "doc_id long, quality int, toxic int, good string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", True, "g", 5) for i, t, s in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LABELS)


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append({c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                                    bool(re.search(r"[#$%&*|]", t)), smaller)) if bad})
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(f, i in good, i in toxic) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone, left = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(c in f for f, _, _ in own) - len(gone), sum(f == {c} for f, _, _ in own),
                                                    sum(g for _, g, _ in gone), sum(t for _, _, t in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: list(r[3:]) for r in rows}


def test_positional_popcounts():
    r = np.random.default_rng(1)
    for n, parts in ((0, 1), (1, 1), (5000, 7), (3000, 1)):
        words, groups = r.integers(0, 1 << 32, n, dtype=np.uint32), r.integers(0, parts, n)
        want = np.zeros((parts, 32), dtype=np.int64)
        for w, g in zip(words.tolist(), groups.tolist()):
            want[g] += [w >> b & 1 for b in range(32)]
        assert np.array_equal(A.positional_popcounts(words, groups, parts), want)


def test_audit_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["X", "A$", "ß", "É"]
    texts = [" ".join(r.choices(vocabulary[:r.choice([20, 150, 304])], k=r.choice([0, 5, 199, 200, 260]))) for _ in range(25)] + [None, "", " \n\t", "word"]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["a", "b", "", None])) for _ in range(150)]
    rows += [(1000 + i, "one common text", "a") for i in range(100)]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    assert got(A.op13(docs_of(spark, rows), labels_of(spark, labels))) == brute(rows, labels)


def test_odd_tables(spark):
    assert A.op13(docs_of(spark, []), labels_of(spark, [])).count() == 0
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None)]
    assert got(A.op13(docs_of(spark, rows), labels_of(spark, []))) == brute(rows, [])
    many = [(i, f"text {i}", f"source {i}") for i in range(700)]
    assert got(A.op13(docs_of(spark, many), labels_of(spark, [(5, 1, 1)]))) == brute(many, [(5, 1, 1)])


@pytest.mark.parametrize("limit", [8, 64])
def test_long_texts_in_pieces(monkeypatch, limit):
    r = random.Random(4)
    monkeypatch.setattr(A, "PIECE_BYTES", limit)
    monkeypatch.setattr(A, "pieces", lambda raw: longtext.pieces(raw, limit))
    for _ in range(300):
        t = "".join(r.choices(["a", "Bb", "é", " ", "\n", "word ", "x" * limit, "%"], k=r.randint(0, 60)))
        raw = t.encode()
        assert b"".join(longtext.pieces(raw, limit)) == raw
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert A._long(raw) == (len(re.findall("[A-Z]", t)), len(t), t.count("%"), len(words), len(set(words)))


def test_whole_long_text(spark):
    t = "one two three " * 300_000 + "#"  # four million bytes, the mark at its end
    rows = [(1, t, "s"), (2, "y" * 3_000_000, "s")]
    assert got(A.op13(docs_of(spark, rows), labels_of(spark, [(1, 0, 1)]))) == brute(rows, [(1, 0, 1)])
