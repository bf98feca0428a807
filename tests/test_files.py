"""physical files in several encodings through probe, scan, analyze, load."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from f6_files import write_f6
from typesift.plans import jobs as J
from typesift.sources import files as S


def test_listing_skips_extensions(spark, scratch):
    write_f6(scratch)
    kinds = {r["file_name"]: r["kind"] for r in S.list_files(spark, scratch).collect()}
    assert all(kinds[f"skip{e}"] == "skip" for e in (".log", ".py", ".bak", ".db"))
    assert kinds["a_utf8.csv"] == "text"


def test_probe_encoding_and_delimiter(spark, scratch):
    exp = write_f6(scratch)
    got = {r["file_name"]: r for r in S.probe(S.list_files(spark, scratch)).collect()}
    assert got["a_utf8.csv"]["encoding"] == "utf-8"
    assert got["b_cp932.txt"]["encoding"] == "cp932"
    assert got["c_sjis.txt"]["encoding"] == "cp932"          # cp932 is tried first
    assert got["d_utf16.txt"]["encoding"] == "utf-16"
    for name in ("a_utf8.csv", "b_cp932.txt", "c_sjis.txt", "d_utf16.txt"):
        assert got[name]["delimiter"] == exp[name]["delimiter"], name
    assert got["e_tie.csv"]["delimiter"] == ","               # tie -> earlier candidate
    assert got["g_header_only.csv"]["status"] == "empty"


def test_analyze_variant_uses_space_candidate(spark, scratch):
    write_f6(scratch)
    got = {r["file_name"]: r["delimiter"] for r in
           S.probe(S.list_files(spark, scratch), delimiter_variant="analyze").collect()}
    assert got["f_spaces.txt"] == " "
    assert got["e_tie.csv"] == ","


def test_scan_names_pads_and_quarantines(spark, scratch):
    write_f6(scratch)
    cells, quarantine = S.read_cells(S.probe(S.list_files(spark, scratch)))
    b = cells.filter(F.col("file_name") == "b_cp932.txt")
    assert {r["column_name"] for r in b.select("column_name").distinct().collect()} == \
        {"①番号", "数量", "単価", "売上日", "メモ"}
    d = cells.filter(F.col("file_name") == "d_utf16.txt")
    assert "品目コード" in {r["column_name"] for r in d.select("column_name").distinct().collect()}
    rag = cells.filter(F.col("file_name") == "h_ragged.csv")
    assert rag.count() == 9 and rag.filter(F.col("value").isNull()).count() == 1
    assert [r["value"] for r in quarantine.collect()] == ["9"]


def test_analyze_load_fix(spark, scratch):
    write_f6(scratch)
    out = os.path.join(scratch, "typed")
    a = J.analyze_folder(spark, scratch)
    types = {(r["file_name"], r["column_name"]): r["Inferred_Type"] for r in a.analysis.collect()}
    assert types[("a_utf8.csv", "数量")] == "INTEGER"
    assert types[("a_utf8.csv", "単価")] == "REAL"
    assert types[("a_utf8.csv", "売上日")] == "DATETIME"
    assert types[("a_utf8.csv", "品目コード")] == "TEXT"
    assert a.registry.count() == len(types)
    ld = J.load_folder(spark, scratch, a.registry, out_dir=out)
    rep = {(r["File"], r["Column"]): r for r in ld.report.collect()}
    assert rep[("a_utf8.csv", "数量")]["Match"] == "○"
    assert rep[("a_utf8.csv", "売上日")]["Actual_Type"] == "TEXT"     # stored as text (parity)
    t = J.read_typed_table(spark, out, "a_utf8")
    assert dict(t.dtypes)["数量"] == "bigint" and dict(t.dtypes)["単価"] == "double"
    vals = sorted((r["数量"] for r in t.collect()), key=lambda x: (x is None, x))
    assert vals == [10, 20, None]                       # "5-" does not parse on load
    fc = J.fix_cycle(a.registry)
    assert {r["pattern"]: r["fixes"] for r in fc.summary.collect()}["total"] == 0


def test_read_methods_agree(spark, scratch):
    write_f6(scratch)
    files = S.list_files(spark, scratch)
    a, b = (S.probe(files, method=m) for m in ("open", "spark"))
    assert sorted(str(r) for r in a.collect()) == sorted(str(r) for r in b.collect())
    a, b = (sorted(str(r) for r in S.read_rows(a, m).collect()) for m in ("open", "spark"))
    assert a == b and len(a) > 20


def test_excel_listed_as_unsupported(spark, scratch):
    write_f6(scratch)
    st = {r["file_name"]: r["status"] for r in S.probe(S.list_files(spark, scratch)).collect()}
    assert st["m_sheet.xlsx"] == "unsupported"


def test_layout_report_irregular(spark, scratch):
    write_f6(scratch)
    probed = S.probe(S.list_files(spark, scratch))
    expected = spark.createDataFrame([("k_irregular.csv", 38)], "file_name string, expected_columns int")
    rep = {os.path.basename(r["File Path"]): r for r in
           S.layout_report(probed, S.head_lines(probed), expected).collect()}
    k = rep["k_irregular.csv"]
    assert k["header_columns"] == 38 and k["body_columns"] == 38
    assert k["Irregular"] == "Yes (Known Irregular - Resolved)"
    assert rep["c_sjis.txt"]["Irregular"] == "Yes (Unusual Delimiter)"
    assert rep["a_utf8.csv"]["Irregular"] == "No"


def test_duplicate_and_quoted_headers(spark, scratch):
    with open(os.path.join(scratch, "i_dups.csv"), "w", encoding="utf-8") as f:
        f.write('a,a,"x,y",b\n1,2,"3,5",4\n')
    cells, _ = S.read_cells(S.probe(S.list_files(spark, scratch)))
    got = {r["column_name"]: r["value"] for r in cells.collect()}
    assert got == {"a": "1", "a.1": "2", "x,y": "3,5", "b": "4"}


def test_quoted_line_breaks(spark, scratch):
    with open(os.path.join(scratch, "j_multiline.csv"), "w", encoding="utf-8") as f:
        f.write('id,note\n1,"first line\nsecond line"\n2,plain\n')
    cells, _ = S.read_cells(S.probe(S.list_files(spark, scratch)))
    notes = sorted(r["value"] for r in cells.filter(F.col("column_name") == "note").collect())
    assert notes == ["first line\nsecond line", "plain"]


def put(folder, name, raw):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(raw)


def rows_of(spark, folder):
    """{file: rows as dicts} and the quarantined values, read back from the cells."""
    probed = S.probe(S.list_files(spark, folder))
    cells, quarantine = S.read_cells(probed)
    rows = {}
    for r in cells.collect():
        rows.setdefault(r["file_name"], {}).setdefault(r["row_id"], {})[r["column_name"]] = r["value"]
    return {f: sorted(x.values(), key=str) for f, x in rows.items()}, sorted((r["file_name"], r["value"]) for r in quarantine.collect()), probed


def test_any_file_name_is_read(spark, scratch):
    folder = os.path.join(scratch, "in [x] 払 {a}")
    os.makedirs(folder)
    names = ["払出明細（大阪）.txt", "with space.csv", "br[1].csv", "p+q%20.csv", "q?.csv"]
    for n in names:
        put(folder, n, b"a\tb\n1\t2\n")
    for n in ("_hidden.csv", ".dotted.csv"):
        put(folder, n, b"a,b\n1,2\n")
    rows, _, probed = rows_of(spark, folder)
    assert rows == {n: [{"a": "1", "b": "2"}] for n in [*names, "_hidden.csv", ".dotted.csv"]}


def test_encoding_is_decided_on_the_whole_file(spark, scratch):
    put(scratch, "late.csv", b"a,b\n" + b"1,2\n" * 30_000 + "x,日本\n".encode("cp932"))
    put(scratch, "replacement.csv", "a,b\n1,\ufffd\n".encode())
    rows, _, probed = rows_of(spark, scratch)
    got = {r["file_name"]: r for r in probed.collect()}
    assert got["late.csv"]["encoding"] == "cp932" and got["late.csv"]["bad_characters"]["utf-8"] > 0
    assert len(rows["late.csv"]) == 30_001 and {"a": "x", "b": "日本"} in rows["late.csv"]
    assert got["replacement.csv"]["encoding"] == "utf-8" and rows["replacement.csv"] == [{"a": "1", "b": "\ufffd"}]


def test_cp932_first(spark, scratch):
    put(scratch, "ascii.csv", b"a,b\n1,2\n")
    order = ("cp932", "shift_jis", "utf-8")
    assert S.probe(S.list_files(spark, scratch), encodings=order).first()["encoding"] == "cp932"


def test_rows_keep_every_cell(spark, scratch):
    put(scratch, "quotes.csv", b'a,b\n"say ""hi"", ok",2\n"x"y,"1,2"\nin"ner,\n')
    put(scratch, "wide.csv", b"a,,c\n1,2,3,4,5\n\na,,c\n6\n")
    put(scratch, "crlf.txt", "a\tb\r\n1\t上\r\n\t\r\n".encode("cp932"))
    put(scratch, "lead.csv", b"\n  \nx,y\n1,2\n")
    put(scratch, "le.txt", "日付\t上\r\n《\t20240101\r\n".encode("utf-16"))
    put(scratch, "be.txt", b"\xfe\xff" + "日付\t上\r\n《\t20240101\r\n".encode("utf-16-be"))
    rows, quarantine, _ = rows_of(spark, scratch)
    assert rows["quotes.csv"] == sorted([{"a": 'say "hi", ok', "b": "2"}, {"a": "xy", "b": "1,2"}, {"a": 'in"ner', "b": ""}], key=str)
    assert rows["wide.csv"] == sorted([{"a": "1", "Unnamed: 1": "2", "c": "3"}, {"a": "a", "Unnamed: 1": "", "c": "c"},
                                       {"a": "6", "Unnamed: 1": None, "c": None}], key=str)
    assert quarantine == [("wide.csv", "4"), ("wide.csv", "5")]
    assert rows["crlf.txt"] == sorted([{"a": "1", "b": "上"}, {"a": "", "b": ""}], key=str)
    assert rows["lead.csv"] == [{"x": "1", "y": "2"}]
    assert rows["le.txt"] == rows["be.txt"] == [{"日付": "《", "上": "20240101"}]


def test_unreadable_store_raises(spark, scratch):
    import pytest
    gone = S.listed(spark.createDataFrame([(os.path.join(scratch, "gone.csv"), 9)], "path string, length long"))
    with pytest.raises(Exception, match="gone.csv"):
        S.probe(gone)


def test_line_breaks_of_any_kind(spark, scratch):
    put(scratch, "cr.csv", b"a,b\r1,2\r3,4\r")
    put(scratch, "crlf.csv", b'a,b\r\n1,"x\r\ny"\r\n')
    put(scratch, "lf.csv", b"a,b\n1,2")
    put(scratch, "mixed.csv", b"a,b\n1,2\r3,4\r\n5,6")
    put(scratch, "cr16.txt", b"\xff\xfe" + "a\tb\r1\t2\r".encode("utf-16-le"))
    rows, _, probed = rows_of(spark, scratch)
    assert rows["cr.csv"] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}] and rows["cr16.txt"] == [{"a": "1", "b": "2"}]
    assert rows["crlf.csv"] == [{"a": "1", "b": "x\r\ny"}] and len(rows["mixed.csv"]) == 3
    assert {r["file_name"]: (r["line_break"], r["status"]) for r in probed.collect()} == {
        "cr.csv": ("CR", "ok"), "crlf.csv": ("CRLF", "ok"), "lf.csv": ("LF", "ok"), "mixed.csv": ("mixed", "ok"), "cr16.txt": ("CR", "ok")}


def test_header_after_a_long_blank_head(spark, scratch):
    put(scratch, "late.csv", b"\n" * 70_000 + b"a,b\n1,2\n")
    put(scratch, "blank.csv", b"\n \n" * 50)
    put(scratch, "nothing.csv", b"")
    put(scratch, "header.csv", b'\n"a\nb",c\n\n')
    rows, _, probed = rows_of(spark, scratch)
    assert rows == {"late.csv": [{"a": "1", "b": "2"}]}
    assert {r["file_name"]: r["status"] for r in probed.collect()} == {"late.csv": "ok", "blank.csv": "empty", "nothing.csv": "empty", "header.csv": "empty"}


def test_one_file_over_many_ranges(spark, scratch):
    import csv
    import io
    import random
    r = random.Random(2)
    table = [[str(i), r.choice(["plain", "two\nlines", 'say "hi"', "a,b", "", "\r\n\r\n", "end\""]), "x" * r.randint(0, 90)] for i in range(4000)]
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["id", "note", "x"], *table])
    put(scratch, "big.csv", out.getvalue().encode())
    put(scratch, "open.csv", b'a,b\n1,"never\nclosed,\n')
    probed = S.probe(S.list_files(spark, scratch), range_bytes=4096)
    assert {x["file_name"]: x["open_quote"] for x in probed.collect()} == {"big.csv": False, "open.csv": True}
    rows = S.read_rows(probed).orderBy("row_id").collect()
    assert [x["fields"] for x in rows if x["file_name"] == "big.csv"] == table
    assert [x["fields"] for x in rows if x["file_name"] == "open.csv"] == [["1", "never\nclosed,\n"]]
    assert probed.where("file_name = 'big.csv'").first()["ranges"].__len__() > 50


def test_load_reports_collisions_and_uses_the_registered_format(spark, scratch):
    folder, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(folder)
    put(folder, "dup-x.csv", b"a\tb\n1\t2\n")
    put(folder, "dup_x.txt", b"a\tb\n3\t4\n")
    put(folder, "same1.csv", b"n|d\n1|20240101\n2|x\n")
    put(folder, "same2.csv", b"n|d\n3|20240102\n")
    reg = spark.createDataFrame([(f, c, t, t, "utf-8", "|") for f in ("same1.csv", "same2.csv") for c, t in (("n", "INTEGER"), ("d", "DATETIME"))],
                                "file_name string, column_name string, data_type string, initial_inferred_type string, encoding string, delimiter string")
    done = J.load_folder(spark, folder, reg, out_dir=out)
    assert {r["status"]: r["files"] for r in done.tally.collect()} == {"collision": 2, "loaded": 2}
    assert done.tables.where("status = 'loaded'").select("layout").distinct().count() == 1
    assert sorted(map(tuple, J.read_typed_table(spark, out, "same1").select("n", "d").collect())) == [(1, "2024-01-01 00:00:00"), (2, None)]
    assert J.read_typed_table(spark, out, "same2").columns == ["n", "d"]


def test_one_failing_layout_leaves_the_others(spark, scratch):
    folder, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(folder)
    put(folder, "good.csv", b"a,b\n1,2\n")
    put(folder, "bad.csv", b"a,a,a.1\n1,2,3\n")  # two columns named a.1
    put(folder, "plain.csv", b"__table__,b\n1,2\n")
    done = J.load_folder(spark, folder, J.analyze_folder(spark, folder).registry, out_dir=out)
    got = {r["file_name"]: (r["status"], r["problem"]) for r in done.tables.collect()}
    assert got == {"good.csv": ("loaded", None), "bad.csv": ("failed", "columns share a name: a.1"), "plain.csv": ("loaded", None)}


def test_many_layouts_in_one_job_and_their_readback(spark, scratch):
    import pyarrow.parquet as pq
    folder, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(folder)
    n = 120
    for i in range(n):
        put(folder, f"f{i}.csv", (",".join(f"c{i}_{k}" for k in range(1 + i % 5)) + ",d\n" + "".join(
            ",".join(str(i * k + r) for k in range(1 + i % 5)) + f',"2024-01-0{r}"\n' for r in range(1, 5))).encode())
    registry = J.analyze_folder(spark, folder).registry
    done = J.load_folder(spark, folder, registry, out_dir=out)
    assert [(r["status"], r["files"]) for r in done.tally.collect()] == [("loaded", n)]
    assert done.tables.select("layout").distinct().count() == n and done.tables.where("rows = 4").count() == n
    probed = S.probe(S.list_files(spark, folder))
    manifest = spark.read.parquet(f"{out}/_tables")
    checked = J.readback(probed, manifest, done.decisions)
    assert checked.count() == sum(2 + i % 5 for i in range(n)) and checked.where("not same").count() == 0
    assert J.stored_consistency(manifest, registry).where("Match = '○'").count() > 0
    one = manifest.where("table_name = 'f7'").first()["files"][0].removeprefix("file:")
    t = pq.read_table(one)
    pq.write_table(t.set_column(0, t.column_names[0], [[99, *t.column(0).to_pylist()[1:]]]), one)  # one altered cell
    assert [(r["table"], r["column"]) for r in J.readback(probed, manifest, done.decisions).where("not same").collect()] == [("f7", "c7_0")]


def test_last_date_column_of_a_crlf_utf16_file_loads(spark, scratch):
    folder, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(folder)
    put(folder, "d.txt", "品\t売上日\r\na\t20240101\r\nb\t20240102\r\n".encode("utf-16"))
    a = J.analyze_folder(spark, folder)
    assert {r["column_name"]: r["Inferred_Type"] for r in a.analysis.collect()}["売上日"] == "DATETIME"
    J.load_folder(spark, folder, a.registry, out_dir=out)
    assert sorted(r["売上日"] for r in J.read_typed_table(spark, out, "d").collect()) == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]


def cell_batches(rows, per):
    """Batches as the writer takes them, of (table, layout, int_value, text_value)."""
    import pyarrow as pa
    for at in range(0, len(rows), per):
        part = [list(c) for c in zip(*rows[at:at + per])]
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.nulls(len(part[0]), pa.int32()),
                                          pa.array(part[2], pa.int64()), pa.nulls(len(part[0]), pa.float64()), pa.array(part[3], pa.string())],
                                         names=["table", "layout", "pos", "int_value", "real_value", "text_value"])


def manifest_lines(writer, batches):
    import json
    name = writer.write(batches).name
    with open(f"{writer.root}/_commits/{writer.job}/{name}.json") as f:
        return [json.loads(line) for line in f]


def test_writer_holds_one_row_group_whatever_the_rows(scratch):
    import json
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from typesift.sources import typed_tables as TT
    width, n, held = 5, 240, []
    layout = json.dumps([[f"a_long_name_of_a_column_{i}", "INTEGER" if i else "TEXT", None] for i in range(width)])
    one = next(cell_batches([("t" if i % width == 0 else None, layout if i % width == 0 else None, i if i % width else None, None if i % width else f"text {i}")
                             for i in range(10_000)], 10_000))  # each row tells its table and layout
    sent = pa.BufferOutputStream()
    with pa.ipc.new_stream(sent, one.schema) as stream:
        stream.write_batch(one)
    sent = sent.getvalue()

    def batches():
        before = pa.total_allocated_bytes()
        for _ in range(n):
            held.append(pa.total_allocated_bytes() - before)
            body = pa.allocate_buffer(sent.size)  # as from Spark, one block of memory a batch
            np.frombuffer(body, np.uint8)[:] = np.frombuffer(sent, np.uint8)
            yield pa.ipc.open_stream(body).read_next_batch()
    lines = manifest_lines(TT._Writer({"path": scratch, "job": "j"}), batches())
    assert sum(r["rows"] for r in lines) == n * 10_000 // width
    assert max(held) < 64 << 20
    tables = [pq.read_table(r["file"]) for r in lines]
    assert len(tables) == 1 and pq.ParquetFile(lines[0]["file"]).metadata.num_row_groups > 1
    assert tables[0].column(0).to_pylist() == [f"text {i}" for i in range(0, 10_000, width)] * n
    assert tables[0].column(4).to_pylist() == list(range(4, 10_000, width)) * n


def test_rows_cut_by_batches_and_row_groups_stay_whole(scratch, monkeypatch):
    import json
    import os
    import pyarrow.parquet as pq
    from typesift.sources import typed_tables as TT
    monkeypatch.setattr(TT, "HELD_BYTES", 200)
    monkeypatch.setattr(TT, "FILE_CELLS", 60)
    layout = json.dumps([["n", "INTEGER", None], ["d", "DATETIME", "%Y-%m-%d"], ["s", "TEXT", None]])

    def cells(table, n, bad=None):
        return [c for k in range(n) for c in ((table, layout, k, None), (None, None, None, "never" if k == bad else "2024-01-02 03:04:05"), (None, None, None, f"é{k}"))]
    rows = cells("a", 50) + cells("b", 18, bad=17) + cells("c", 1) + cells("a", 7)
    lines = manifest_lines(TT._Writer({"path": scratch, "job": "j", "parity": "false"}), cell_batches(rows, 7))
    found = {t: [k for r in lines if r["table"] == t and r["file"] for k in pq.read_table(r["file"]).to_pydict()["s"]] for t in "abc"}
    assert found == {"a": [f"é{k}" for k in [*range(50), *range(7)]], "b": [], "c": ["é0"]}
    assert sum(r["rows"] for r in lines if r["table"] == "a") == 57 and sum(r["rows"] for r in lines if r["table"] == "b") == 18
    assert [bool(r["problem"]) for r in lines if r["table"] == "b"] == [True]
    assert max(pq.ParquetFile(r["file"]).metadata.num_row_groups for r in lines if r["file"]) > 1
    # A file of which a later row group fails is not left.
    assert not os.listdir(os.path.join(scratch, "tables", "b"))
