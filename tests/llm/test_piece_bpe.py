"""Piece encoding and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random
import string

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from typesift.llm import piece_bpe as B
from typesift.llm.tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", "▁", "▁a b ▁▁", "<s> <unk> <0x0A>", "\n\n\t ", "é ñ　ü 𝒳 \u0000 x", "日本語 テスト", "=" * 500, "�", "á"]
SCHEMA = "doc_id long, text string, ids string, n_tokens int, c0 string"


def same(model, texts):
    ids, n = model.encode([t.encode() for t in texts])
    ends = np.cumsum(n)
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    want = [LIBRARY.encode(t) for t in texts]
    assert got == want
    assert [t.decode() for t in model.decode(ids, n)] == [LIBRARY.decode(w) for w in want]


def random_texts(seed, n=400):
    r = random.Random(seed)
    parts = ["a", "aa", "b", " ", "  ", " " * 9, "the", "in", "ing", "er", "\n", "é", "日", "1", "▁", "=", "--", "A", "z", "</s>"]
    return ["".join(r.choices(parts, k=r.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, B.MAX_ROUNDS])  # 0: the queue alone
def test_equals_library(monkeypatch, rounds):
    monkeypatch.setattr(B, "MAX_ROUNDS", rounds)
    model, r = B.model(PATH), random.Random(5)
    same(model, ODD + random_texts(rounds))
    same(model, [" " * k + "x" + " " * 3 * k for k in range(60)] + ["a" * k for k in range(0, 200, 3)])
    same(model, ["".join(r.choices(string.ascii_letters + string.digits + "+/", k=5000))])
    same(model, [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()])


def test_steps_of_long_texts(monkeypatch):
    model = B.model(PATH)
    steps = model._steps
    monkeypatch.setattr(model, "_steps", lambda points: steps(points, 7))
    same(model, ODD + random_texts(9, 100))


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(B.tb, "mix", lambda h: h & np.uint64(3))  # nearly all words collide
    same(B.PieceModel(PATH), random_texts(11, 60))


def test_decode_of_any_ids():
    model, r = B.model(PATH), random.Random(6)
    for _ in range(300):
        rows = [[r.choice([r.randrange(32000), r.randrange(3, 259), 1, 2, 28705]) for _ in range(r.randint(0, 12))] for _ in range(5)]
        rows = [[i for i in row if i != 0] for row in rows]
        flat = np.array([i for row in rows for i in row], dtype=np.int64)
        assert [t.decode() for t in model.decode(flat, np.array([len(row) for row in rows]))] == [LIBRARY.decode(row) for row in rows]


def test_bytes_that_are_no_text():
    model = B.model(PATH)
    raw = [b"ok \xe2\x96 bad \xff\xfe", b"\xf0\x9f\x98"]
    ids, n = model.encode(raw)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [LIBRARY.encode(x.decode("utf-8", "each-byte")) for x in raw]


def test_operator(spark):
    rows = [(1, None), (None, "no id"), (2, "twice"), (2, "twice"), (3, "one two " * 200_000), *((10 + i, t) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))) for i, t in rows for ids in [LIBRARY.encode(t or "")])
    assert sorted((str(r[0]), *r[1:]) for r in B.op11(docs).collect()) == want
    tokens = B.encode(docs.where("doc_id <> 3"), PATH)
    assert {r["doc_id"]: r["ids"] for r in tokens.collect()}[2] == LIBRARY.encode("twice")
    back = {r["doc_id"]: r["text"] for r in B.decode(tokens, PATH).collect()}
    assert back[2] == "twice" and back[1] == "" and back[15] == LIBRARY.decode(LIBRARY.encode(ODD[5]))
    assert B.op11(docs.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        B.PieceModel(str(tmp_path / "m.model"))
