"""Byte ranges cut at true record ends, against csv.reader."""

from __future__ import annotations

import csv
import io
import random

import numpy as np
import pytest

from typesift.sources import ranges as R


def expected(text, delimiter):
    """(records) as csv.reader finds them, as field lists; blank lines are none."""
    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if row]


def split_file(raw, encoding, delimiter, range_bytes):
    """The file's records by ranges: scan, compose, read."""
    f = R.Bytes("", raw)
    spans = [R.measure(f, at, at + range_bytes, ["utf-8", "cp932"], [delimiter]) for at in range(0, len(raw), range_bytes)]
    state, out = 0, []
    for s in spans:
        key = delimiter + "\n" if encoding in R.SHIFTED and delimiter + "\n" in s["turns"] else delimiter
        skip = {"utf-16le": 2, "utf-16be": 2}.get(encoding, 3 if raw.startswith(R.UTF8_BOM) else 0)
        start = max(s["start"], skip) if s["start"] == 0 else s["start"]
        for at, texts in R.range_records(f, start, s["end"], state, encoding, delimiter):
            out += zip(at.tolist(), texts)
        state = s["turns"][key] >> state & 1
    assert [a for a, _ in out] == sorted({a for a, _ in out})
    return [t for _, t in out]


PIECES = ['"', '""', ",", "\n", "\r", "\r\n", "a", "b ", "é", "|", '"x', 'y"', ',"', '",', "日ー", "ソ|", 'ポ"', " "]


@pytest.mark.parametrize("encoding", ["utf-8", "cp932", "utf-16le", "utf-16be"])
@pytest.mark.parametrize("delimiter", [",", "|"])
def test_records_equal_csv_reader(encoding, delimiter):
    r = random.Random(f"{encoding}{delimiter}")
    codec = {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(encoding, encoding)
    for _ in range(150):
        text = "".join(r.choices([p for p in PIECES if encoding != "cp932" or p != "é"], k=r.randint(0, 60)))
        raw = R.BOMS.get(encoding, b"") + text.encode(codec)
        want = expected(text, delimiter)
        for size in (2, 6, 16, 1000):
            got = split_file(raw, encoding, delimiter, size)
            fields = [row for t in got for row in [next(csv.reader([t] if "\n" not in t and "\r" not in t else io.StringIO(t, newline=""), delimiter=delimiter), [])] if row]
            assert fields == want, (text, size, got)


def test_states_after_equal_one_by_one():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 255, 256, 257, 3000):
        m = np.stack([r.integers(0, 2, n), r.choice([0, 2], n), np.ones(n, dtype=int)], axis=1).astype(np.uint8)
        for start in (0, 1):
            state, want = start, []
            for row in m.tolist():
                state = row[state]
                want.append(state)
            assert R.states_after(m, start).tolist() == want
            assert int(R.composed(m)[start]) == (want[-1] if want else start)


def test_lines_longer_than_the_search_step(monkeypatch):
    monkeypatch.setattr(R, "STEP_BYTES", 4)
    raw = b"a,b\r\n" + b"x" * 50 + b',"1\r\n2"\r\n' + b'y,"' + b"z\n" * 30 + b'"\n'
    want = ["a,b", "x" * 50 + ',"1\r\n2"', 'y,"' + "z\n" * 30 + '"']
    for size in (1, 3, 7, 64, 500):
        assert split_file(raw, "utf-8", ",", size) == want
    f = R.Bytes("", raw)
    assert R.first_record(f, 5, "utf-8", ",") == (want[1], len(b"a,b\r\n") + 50 + len(b',"1\r\n2"\r\n'))
    assert R.head(f, 1) == b"a,b\r\n"


def test_measure_counts_lines_and_breaks():
    m = R.measure(R.Bytes("", b"\n \t\r\n\rab\rc\r\n\n x"), 0, 100, ["utf-8"], [","])
    assert (m["n_lf"], m["n_cr"], m["n_crlf"], m["n_text_lines"], m["first_text"], m["last_text"]) == (2, 2, 2, 3, 6, 14)
    m = R.measure(R.Bytes("", b"\n" * 70_000 + b"a,b\n1,2\n"), 0, 1 << 20, ["utf-8"], [","])
    assert m["first_text"] == 70_000 and m["n_text_lines"] == 2


def test_bad_characters():
    assert R.bad_characters("日本".encode(), "utf-8") == 0 and R.bad_characters("a�".encode(), "utf-8") == 0
    assert R.bad_characters("日本".encode("cp932"), "utf-8") > 0 and R.bad_characters("日本".encode("cp932"), "cp932") == 0
