"""physical delimited files in several encodings, written into a fresh folder."""

from __future__ import annotations

import os

HEADER = ["品目コード", "数量", "単価", "売上日", "メモ"]
ROWS = [["A001", "10", "1500", "20240101", "x"],
        ["A002", "20", "2000.5", "20240102", "y"],
        ["A003", "5-", "3500", "20240103", "z"]]


def _text(sep: str, header=HEADER, rows=ROWS) -> str:
    return "\n".join(sep.join(r) for r in [header, *rows]) + "\n"


def write_f6(folder: str) -> dict[str, dict]:
    """Write the F6 files; return expected encoding/delimiter per file."""
    files = {
        "a_utf8.csv": ("utf-8", ",", _text(",")),
        "b_cp932.txt": ("cp932", "\t", _text("\t", ["①番号", *HEADER[1:]])),
        "c_sjis.txt": ("shift_jis", "|", _text("|")),
        "d_utf16.txt": ("utf-16", "\t", _text("\t")),
        "e_tie.csv": ("utf-8", ",", "a,b;c\n1,2;3\n"),
        "f_spaces.txt": ("utf-8", ",", "name,note\nfoo bar baz,one two three\nqux quux,a b c d\n"),
        "g_header_only.csv": ("utf-8", ",", "a,b,c\n"),
        "h_ragged.csv": ("utf-8", ",", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n"),
    }
    expected = {}
    for name, (enc, sep, text) in files.items():
        pyenc = {"utf-16": "utf-16", "cp932": "cp932", "shift_jis": "shift_jis"}.get(enc, "utf-8")
        with open(os.path.join(folder, name), "wb") as f:
            f.write(text.encode(pyenc))
        expected[name] = {"encoding": enc, "delimiter": sep}
    # Irregular layout: 38 tab-separated header names, body separated by runs of spaces.
    hdr = "\t".join(f"項目{i}" for i in range(38))
    body = "\n".join("   ".join(f"v{r}_{i}" for i in range(38)) for r in range(5))
    with open(os.path.join(folder, "k_irregular.csv"), "wb") as f:
        f.write((hdr + "\n" + body + "\n").encode("cp932"))
    expected["k_irregular.csv"] = {"encoding": "cp932", "delimiter": "\t"}
    with open(os.path.join(folder, "m_sheet.xlsx"), "wb") as f:
        f.write(b"PK\x03\x04")
    for name in ("skip.log", "skip.py", "skip.bak", "skip.db"):
        with open(os.path.join(folder, name), "w") as f:
            f.write("ignored\n")
    return expected
