"""Extract-file sources (S01-S10, S12): listing, format probing, corpus scans.

Shape of the jobs
-----------------
* Listing (S01/S05) reads file metadata only, of files with any name.
* First scan (S02): every file in byte ranges (``sources.ranges``).  Each range
  counts the characters that do not decode under each encoding; the first encoding
  in order without any in the whole file is the file's.  The same scan gives the
  file's first line with text, and what its quotes do.
* Header (S03/S06): the delimiter is chosen from the first lines, and the record at
  the first line with text, however late, is the header.
* Second scan (S04): the ranges again, cut at true record ends; a task decodes its
  records, and one expression splits each into an array of fields, so a row has no
  width limit and a quoted field may hold line breaks.  Cells beyond the header go
  to the quarantine, missing ones are NULL, empty ones ``''``.

Decoding is Python's, so no session setting changes it.  No list of paths goes
through the driver, and files that are not read are not opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from typesift.functions import constants as K
from typesift.functions import text as X
from typesift.session import materialize
from typesift.sources import dialect as DI
from typesift.sources import ranges as B

BYTE_ENCODINGS = tuple(e for e in K.ENCODINGS if e != "utf-16")


# --------------------------------------------------------------------------
# Listing and dispatch
# --------------------------------------------------------------------------

def literal_path(path: str) -> str:
    """A path for Spark's readers in which no character is a glob."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def plain_path(encoded: Column) -> Column:
    """A scan's URI-encoded file path as the listing has it."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def _named(df: DataFrame) -> DataFrame:
    name = X.base_name(F.col("path"))
    low = F.lower(name)
    skip = F.lit(False)
    for ext in K.SKIP_EXTENSIONS:
        skip = skip | low.endswith(ext)
    excel = low.endswith(K.EXCEL_EXTENSIONS[0]) | low.endswith(K.EXCEL_EXTENSIONS[1])
    kind = F.when(skip, "skip").when(excel, "excel").otherwise("text")
    return df.select("path", name.alias("file_name"), X.extension(F.col("path")).alias("extension"),
                     "length", "modificationTime", kind.alias("kind"))


def _listing(batches: Iterator) -> Iterator:
    """(path, length, modificationTime) of the files in each folder."""
    import pyarrow as pa
    from pyarrow import fs
    for b in batches:
        for folder in b.column("path").to_pylist():
            store, inner = B.located(folder)
            found = [i for i in store.get_file_info(fs.FileSelector(inner)) if i.is_file]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{i.base_name}" for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()),
                 pa.array([i.mtime_ns // 1000 if i.mtime_ns is not None else None for i in found], pa.int64()).cast(pa.timestamp("us", "UTC"))],
                names=["path", "length", "modificationTime"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files in a folder (not recursive) with name, extension, size and kind.

    kind: ``skip`` (.py .log .bak .db), ``excel`` (listed, not read), ``text``.
    A task lists the folder through pyarrow: also empty files, and names that begin
    with ``_`` or ``.``, but for the marks that Spark itself leaves beside its files.
    Stores that pyarrow does not know are listed by Spark, which passes over both.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = store.makeQualified(folder).toString().rstrip("/")
    if whole.partition(":")[0] in B.ARROW_SCHEMES:
        one = spark.createDataFrame([(whole,)], "path string").coalesce(1)
        seen = one.mapInArrow(_listing, "path string, length long, modificationTime timestamp")
        name = X.base_name(F.col("path"))
        seen = seen.where(~(name.startswith(".") & name.endswith(".crc")) & (name != "_SUCCESS"))
    else:
        seen = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(literal_path(path)).select("path", "length", "modificationTime")
    return _named(seen)


def listed(paths: DataFrame) -> DataFrame:
    """Files given as (path, length), as ``list_files`` describes them."""
    return _named(paths.withColumn("modificationTime", F.lit(None).cast("timestamp")))


def count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def pick_delimiter(text: Column, candidates, fallback: str) -> Column:
    """Most frequent candidate, ties to the earlier one; ``fallback`` when all are zero."""
    scored = F.array(*[F.struct(count_char(text, d).alias("n"), F.lit(-i).alias("p"), F.lit(d).alias("d"))
                       for i, d in enumerate(candidates)])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["d"]).otherwise(F.lit(fallback))


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


# --------------------------------------------------------------------------
# Records to fields
# --------------------------------------------------------------------------

def quoted(delimiter: Column) -> Column:
    """The delimiter as a literal regex."""
    return F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))


def fields_of(line: Column, delimiter: Column) -> Column:
    """A decoded record as an array of fields; a quoted field may hold delimiters, line breaks and doubled quotes,
    and goes on to the end if nothing closes it."""
    d = quoted(delimiter)
    pattern = F.concat(F.lit("(?s)"), d, F.lit('("[^"]*+(?:""[^"]*+)*+(?:"(?:(?!'), d, F.lit(").)*+|\\z)|(?:(?!"), d, F.lit(").)*+)"))
    parts = F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(1))
    inner = F.transform(parts, lambda f: F.when(f.startswith('"'), F.replace(
        F.regexp_replace(f, '^"([^"]*+(?:""[^"]*+)*+)(?:"|\\z)', "$1"), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(line.contains('"'), inner).otherwise(F.split(line, d, -1))


def column_names(header: Column) -> Column:
    """Header fields as pandas names them: blank ones ``Unnamed: n``, repeats ``.1``, ``.2``, ..."""
    filled = F.transform(header, lambda h, i: F.when(h == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(h))

    def unique(h, i):
        before = F.size(F.filter(F.slice(filled, F.lit(1), i), lambda x: x == h))
        return F.when(before > 0, F.concat(h, F.lit("."), before.cast("string"))).otherwise(h)
    return F.transform(filled, unique)


# --------------------------------------------------------------------------
# Encoding and delimiter probe
# --------------------------------------------------------------------------

def _codec(scan_as: str) -> str:
    return {"utf-8": "utf-8-sig", "utf-16le": "utf-16", "utf-16be": "utf-16"}.get(scan_as, scan_as)


def _with_sample(rows: DataFrame, n: int, method: str) -> DataFrame:
    """``rows`` (path, scan_as, first_text, ...) with sample, the text of the file's first lines, or of those from its first text on if they are blank."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["first_text"] is None or r["scan_as"] is None:
                    found.append(None)
                    continue
                f = B.Bytes(r["path"], r["content"])
                text = B.head(f, n).decode(_codec(r["scan_as"]), "replace")
                found.append(text if text.strip() else B.head(f, n, r["first_text"]).decode(B.codec(r["scan_as"]), "replace"))
                f.close()
            yield b.append_column("sample", pa.array(found, pa.string()))

    rows = B.with_content(rows, method)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("sample", StringType())])).drop("content")


def _with_header(rows: DataFrame, method: str) -> DataFrame:
    """``rows`` (path, scan_as, first_text, delimiter, ...) with header_line and header_end, the place after it."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["first_text"] is None or r["scan_as"] is None:
                    found.append((None, None))
                else:
                    f = B.Bytes(r["path"], r["content"])
                    found.append(B.first_record(f, r["first_text"], r["scan_as"], r["delimiter"]))
                    f.close()
            yield b.append_column("header_line", pa.array([x for x, _ in found], pa.string())).append_column(
                "header_end", pa.array([x for _, x in found], pa.int64()))

    rows = B.with_content(rows, method)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("header_line", StringType()), StructField("header_end", LongType())])).drop("content")


def probe(files: DataFrame, *, delimiter_variant: str = "load", file_rules: DataFrame | None = None,
          encodings: tuple[str, ...] = K.ENCODINGS, method: str = "auto", range_bytes: int = B.RANGE_BYTES) -> DataFrame:
    """Encoding, delimiter, header, status and byte ranges of each file.

    ``encodings`` is the order of trial (``K.ENCODINGS``, or with cp932 first);
    UTF-16 is known by its byte order mark.  bad_characters maps each encoding
    to the characters of the whole file that do not decode under it.  The
    delimiter is the most frequent candidate in the first five lines, or from the
    first text on if they are blank (``load``
    variant: tab , | ; with tab as fallback; ``analyze`` variant: , tab ; |
    space with comma as fallback).  Files with a file rule take its hints.
    line_break: LF, CR, CRLF or mixed.  open_quote: whether the file ends inside
    quotes.  status: ``ok``; ``empty``, nothing but a header; ``unreadable``, no
    encoding fits; ``unsupported``, Excel.  method: how bytes are read, see
    ``ranges.with_content``.
    """
    text_files = files.filter(F.col("kind") == "text")
    cands, fb = ((K.LOAD_DELIMITERS, "\t") if delimiter_variant == "load" else (K.ANALYZE_DELIMITERS, ","))
    given = {} if file_rules is None else {r[0]: None for r in file_rules.select("separator").distinct().collect() if r[0]}  # rules are a table that a person edits
    scanned = materialize(B.scan(text_files, list(BYTE_ENCODINGS), list({**dict.fromkeys(cands), **given}), range_bytes=range_bytes, method=method), "ranges")
    checked = scanned.groupBy("path").agg(
        F.max("utf16").alias("utf16"), F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text"),
        *[F.sum(c).alias(c) for c in ("n_lf", "n_cr", "n_crlf", "n_text_lines")],
        *[F.sum(F.try_element_at("bad", F.lit(e))).alias(f"bad_{e}") for e in BYTE_ENCODINGS])
    enc = F.lit(None).cast("string")
    for e in reversed([e for e in encodings if e in BYTE_ENCODINGS]):
        enc = F.when(F.col(f"bad_{e}") == 0, e).otherwise(enc)
    out = text_files.select("path", "file_name", "length").join(checked, "path", "left")
    hint_enc = hint_sep = F.lit(None).cast("string")
    if file_rules is not None:
        rules = file_rules.groupBy(F.col("file_name").alias("rule_file")).agg(
            F.max("encoding").alias("rule_enc"), F.max("separator").alias("rule_sep"))
        out = out.join(rules, out["file_name"] == F.col("rule_file"), "left")
        hint_enc = F.when(F.lower("rule_enc").isin(*BYTE_ENCODINGS), F.lower("rule_enc"))
        hint_sep = F.when(F.length("rule_sep") > 0, F.col("rule_sep"))
    # scan_as: the encoding by which records are cut and decoded; utf-16 by its byte order
    out = out.withColumn("scan_as", F.coalesce(F.col("utf16"), hint_enc, enc)).withColumn("hint_sep", hint_sep)
    out = _with_sample(out, K.DELIMITER_SAMPLE_LINES, method)
    out = out.withColumn("delimiter", F.coalesce(F.col("hint_sep"), pick_delimiter(F.coalesce("sample", F.lit("")), cands, fb)))
    out = _with_header(out.drop("sample"), method)
    out = out.withColumn("header", fields_of(F.col("header_line"), F.col("delimiter")))

    turns = scanned.select("path", "range", "start", "end", "turns").join(out.select("path", "delimiter", "scan_as"), "path")
    turns = B.start_states(turns.withColumn("turn", B.turn_of(F.col("delimiter"), F.col("scan_as"))).drop("turns"))
    spans = turns.groupBy("path").agg(  # a range is megabytes of its file
        F.array_sort(F.collect_list(F.struct("range", "start", "end", "state"))).alias("ranges"),
        F.max_by(F.when(F.col("state") == 1, F.col("turn").bitwiseAND(2) / 2).otherwise(F.col("turn").bitwiseAND(1)), "range").alias("end_state"))
    out = out.join(spans, "path", "left")

    some = F.coalesce("n_text_lines", F.lit(0)) > 0
    more = F.col("last_text") >= F.col("header_end")
    status = F.when(~some, "empty").when(F.col("scan_as").isNull(), "unreadable").when(~more, "empty").otherwise("ok")
    bad = F.create_map(*[x for e in BYTE_ENCODINGS for x in (F.lit(e), F.coalesce(f"bad_{e}", F.lit(0)).cast("long"))])
    kinds = [("LF", "n_lf"), ("CR", "n_cr"), ("CRLF", "n_crlf")]
    n_kinds = sum((F.coalesce(c, F.lit(0)) > 0).cast("int") for _, c in kinds)
    line_break = F.when(n_kinds > 1, "mixed")
    for name, c in kinds:
        line_break = line_break.when(F.col(c) > 0, name)
    res = out.select(
        "path", "file_name", "length", F.when(F.col("scan_as").startswith("utf-16"), "utf-16").otherwise(F.col("scan_as")).alias("encoding"),
        F.when(F.col("scan_as").isNotNull(), F.col("delimiter")).alias("delimiter"),
        F.when(F.col("header_line").isNotNull(), F.size("header")).alias("n_header_cols"), status.alias("status"), "header_line",
        "scan_as", "header", column_names(F.col("header")).alias("names"), "header_end", line_break.alias("line_break"),
        (F.col("end_state") == 1).alias("open_quote"), "ranges", F.when(F.col("utf16").isNull(), bad).alias("bad_characters"))
    other = files.filter(F.col("kind") == "excel")
    res = res.unionByName(other.select("path", "file_name", "length", F.lit("unsupported").alias("status")), allowMissingColumns=True)
    # One row per file, reused by every later step: written once, so files
    # are probed once and later plans stay small.
    return materialize(res, "probe")


# --------------------------------------------------------------------------
# Corpus scan to rows and cells
# --------------------------------------------------------------------------

ROW_COLUMNS = ("file_name", "path", "row_id", "fields", "names")


def read_chunks(probed: DataFrame, shared: tuple[str, ...], method: str = "auto") -> DataFrame:
    """``ranges.records`` of what lies below the header of the readable files, with some of their columns."""
    ok = probed.filter(F.col("status") == "ok")
    spans = ok.select("path", "delimiter", F.col("scan_as").alias("encoding"), F.col("header_end").alias("skip"), *shared, F.inline("ranges"))
    return B.records(spans.where(F.col("end") > F.col("skip")), method)


def read_rows(probed: DataFrame, method: str = "auto") -> DataFrame:
    """(file_name, path, row_id, fields, names) of every record below the header of the readable files.

    row_id: the place of the record's first byte in its file.
    """
    chunks = read_chunks(probed, ("file_name", "names"), method)
    rows = chunks.select("path", "file_name", "names", "delimiter", F.inline(F.arrays_zip("row_id", "record")))
    return rows.withColumn("fields", fields_of(F.col("record"), F.col("delimiter"))).select(*ROW_COLUMNS)


def cells_of_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, quarantine): each row's fields under their names; what the header does not cover."""
    width = F.size("names")
    padded = F.concat("fields", F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size("fields"), F.lit(0))))
    long = rows.select("file_name", "path", "row_id", "names", F.posexplode(padded).alias("pos", "value"))
    cells = long.where(F.col("pos") < width).select(
        "file_name", "path", "row_id", F.element_at("names", F.col("pos") + 1).alias("column_name"), "value")
    beyond = rows.where(F.size("fields") > width).select(
        "file_name", "path", "row_id", "names", F.posexplode("fields").alias("pos", "value"))
    return cells, beyond.where(F.col("pos") >= width).select(
        "file_name", "path", "row_id", "pos", F.lit(None).cast("string").alias("column_name"), "value")


def read_cells(probed: DataFrame, *, with_row_id: bool = True, method: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Scan all readable files into cells; returns (cells, quarantine).

    cells: (file_name, path, row_id, column_name, value); quarantine: cells
    beyond the header of their file.
    """
    cells, quarantine = cells_of_rows(read_rows(probed, method))
    return (cells if with_row_id else cells.drop("row_id")), quarantine


# --------------------------------------------------------------------------
# Layout scoring of irregular files
# --------------------------------------------------------------------------

def _parts(line: Column, splitter: str) -> Column:
    """Number of non-blank parts of a line."""
    pattern = splitter if splitter == r"\s+" else "\\Q" + splitter + "\\E"
    return F.size(F.filter(F.split(line, pattern), lambda s: F.btrim(s) != ""))


def _closest(counts: list[Column], least: int, expected: Column) -> Column:
    """Of the counts over ``least``, the one closest to the expectation, else the first; earlier ones win ties."""
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("n")) for i, c in enumerate(counts)])
    big = F.filter(numbered, lambda x: x["n"] > least)
    best = F.array_min(F.transform(big, lambda x: F.struct(F.abs(x["n"] - expected).alias("d"), x["i"].alias("i"), x["n"].alias("n"))))
    return F.when(expected.isNotNull(), best["n"]).otherwise(F.try_element_at(big, F.lit(1))["n"])


def header_columns(line: Column, expected: Column) -> Column:
    """Columns of a header line under the splitter that fits the expectation (or the first that gives enough)."""
    return _closest([_parts(line, s) for s in K.HEADER_SPLITTERS], K.HEADER_MIN_COLUMNS, expected)


def body_columns(lines: Column, expected: Column) -> Column:
    """Columns of the widest of some body lines: by white space, tab, white space by hand, comma."""
    def widest(count):
        return F.coalesce(F.array_max(F.transform(lines, count)), F.lit(0))
    space = widest(lambda x: _parts(x, r"\s+"))
    return _closest([space, widest(lambda x: F.size(F.split(x, "\t"))), space, widest(lambda x: F.size(F.split(x, ",", -1)))],
                    K.BODY_MIN_COLUMNS, expected)


def layout_report(probed: DataFrame, lines: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Header and body column counts under several splitters, and the verdict.

    ``lines``: (path, line_no, line) for the first lines of each file (line 0
    is the header); ``expected``: (file_name, expected_columns, and optionally
    regular) - the files of irregular layout, with NULL where the number of
    columns is not known; ``regular`` ones are only checked for their width.
    """
    spark = probed.sparkSession
    if expected is None:
        expected = spark.createDataFrame(list(K.KNOWN_IRREGULAR_FILES), "file_name string, expected_columns int")
    if "regular" not in expected.columns:
        expected = expected.withColumn("regular", F.lit(False))
    # six lines of a file at most
    few = lines.where("line_no <= 5").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    few = few.select("path", F.try_element_at(F.filter("l", lambda x: x["line_no"] == 0), F.lit(1))["line"].alias("head"),
                     F.transform(F.filter("l", lambda x: x["line_no"] > 0), lambda x: x["line"]).alias("body"))
    types = headerless_probe(spark, probed).select("path", "data_types", F.size(F.split("data_types", ", ")).alias("probed_columns"))
    j = probed.join(few, "path", "left").join(expected, "file_name", "left").join(types, "path", "left")
    exp, irregular_file = F.col("expected_columns"), F.coalesce(~F.col("regular"), F.lit(False))
    header_cols, body_cols = header_columns(F.col("head"), exp), body_columns(F.col("body"), exp)
    limit = K.LAYOUT_DIFF_LIMIT
    verdict = (F.when(irregular_file & exp.isNull(), "Yes (Unknown Structure)")
               .when(irregular_file & (F.abs(header_cols - exp) > limit), "Yes (Header Column Mismatch)")
               .when(irregular_file & (F.abs(body_cols - exp) > limit), "Yes (Data Column Mismatch)")
               .when(irregular_file, "Yes (Known Irregular - Resolved)")
               .when(~F.coalesce(F.col("delimiter"), F.lit("N/A")).isin(",", "\t", "N/A"), "Yes (Unusual Delimiter)")
               .when(exp.isNotNull() & (F.coalesce("probed_columns", F.lit(0)) != exp), "Yes (Column Mismatch)")
               .otherwise("No"))
    actual = F.when(irregular_file, F.coalesce(exp, body_cols, header_cols)).otherwise(F.col("probed_columns"))
    return j.select(F.col("path").alias("File Path"), verdict.alias("Irregular"),
                    exp.alias("Expected Columns"), actual.alias("Actual Columns"),
                    F.coalesce(F.col("delimiter"), F.lit("N/A")).alias("Delimiter"),
                    F.col("encoding").alias("Encoding"), F.coalesce("data_types", F.lit("N/A")).alias("Data Types"),
                    header_cols.alias("header_columns"), body_cols.alias("body_columns"))


def head_lines(probed: DataFrame, n: int = 6, method: str = "auto") -> DataFrame:
    """(path, line_no, line) of the first ``n`` lines of each probed file."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for r in b.to_pylist():
                f = B.Bytes(r["path"], r["content"])
                text = B.head(f, n).decode(_codec(r["scan_as"]), "replace")
                f.close()
                lines = re.split("\r\n|\r|\n", text)[:n]
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int32()),
                                                  pa.array(lines, pa.string())], names=["path", "line_no", "line"])

    known = probed.filter(F.col("encoding").isNotNull()).select("path", "scan_as")
    return B.with_content(known, method).mapInArrow(run, "path string, line_no int, line string")


# --------------------------------------------------------------------------
# Report scan
# --------------------------------------------------------------------------

def read_compare_report(spark: SparkSession, path: str) -> DataFrame:
    """A comparison report written as CSV (UTF-8, optional BOM in the first name)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("\ufeff"))


# --------------------------------------------------------------------------
# Header-less probe
# --------------------------------------------------------------------------

HEADERLESS_CANDIDATES = (",", "\t", ";", "|", " ")


def _holds(delimiter: str):
    return lambda line: line.contains(delimiter)


def first_splitting(lines: Column) -> Column:
    """The first candidate that splits any of the lines, ``N/A`` when none does."""
    out = F.lit("N/A")
    for d in reversed(HEADERLESS_CANDIDATES):
        out = F.when(F.exists(lines, _holds(d)), F.lit(d)).otherwise(out)
    return out


def headerless_probe(spark: SparkSession, probed: DataFrame, n_lines: int = 10) -> DataFrame:
    """Per file a delimiter for its first ``n_lines`` lines, and a dtype label
    per column of those lines read without a header.

    The delimiter is that of the dialect whose rows are most alike
    (``sources.dialect``), or the first candidate that splits any of the lines.
    """
    from typesift.operators import profile as P
    lines = head_lines(probed, n_lines).filter(F.col("line") != "")
    few = lines.groupBy("path").agg(F.collect_list("line").alias("l"))  # n_lines at most
    sniffed = DI.detect(lines, "path", "line").select("path", F.nullif("delimiter", F.lit("N/A")).alias("sniffed"))
    chosen = few.join(sniffed, "path", "left").select("path", F.coalesce("sniffed", first_splitting(F.col("l"))).alias("delimiter"))
    split = (lines.join(chosen, "path")
             .filter(F.col("delimiter") != "N/A")
             .select("path", "line_no", F.posexplode(F.split(F.col("line"), quoted(F.col("delimiter"))))
                     .alias("pos", "value")))
    cells = split.select(F.col("path").alias("file_name"), F.col("pos").cast("string").alias("column_name"), "value")
    labels = P.dtype_label(P.profile_cells(cells, na_tokens=("",)))
    per_file = labels.groupBy("file_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("column_name").cast("int").alias("p"),
                                                                          F.col("dtype").alias("d")))),
                                 lambda x: x["d"]), ", ").alias("data_types"))
    return chosen.join(per_file.withColumnRenamed("file_name", "path"), "path", "left")
