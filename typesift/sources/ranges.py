"""Text files in byte ranges, cut at true record ends.

A delimited file's line break ends a record only outside quotes, and whether a
place is inside quotes depends on all bytes before it.  Two scans make that
parallel, for files of any size:

1. ``scan`` cuts every file into ranges of about ``RANGE_BYTES``, each moved to the
   next line break (LF, CR or CRLF, whatever the file has).  At a line break there
   are two states, outside and inside a quoted field; a task finds for its range and
   each delimiter that may apply where either state leads.  It also counts the
   characters that do not decode under each encoding, and the lines with text.
2. ``start_states`` composes those maps along each file (windows over one small row a
   range), which tells the state in which every range begins.
3. ``records`` reads the ranges again.  A range that begins inside quotes leaves its
   head to the range before it; a record that runs over the end is read on.

Quotes are those of ``csv.reader``: one opens a field only at the field's first
character, a doubled one inside is text, and what follows a closing one is text.
Within a range, quotes are maps of three states (outside, inside, first of a
doubled pair) that are composed over arrays, never one by one.

Files are opened in tasks through pyarrow's file systems.  Where pyarrow does not
know the store, each file's bytes come from Spark's binary reader, as one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BYTES = 16 << 20
#: Bytes looked at on the search for a line break, and read on for a record that is not at its end.
STEP_BYTES = 1 << 18
BATCH_BYTES = 4 << 20

LF, CR, QUOTE = 10, 13, 34
UTF8_BOM = b"\xef\xbb\xbf"
BOMS = {"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}
UNITS = {"utf-16le": np.dtype("<u2"), "utf-16be": np.dtype(">u2")}
#: Encodings whose two-byte characters may end in a byte below 0x80.
SHIFTED = ("cp932", "shift_jis")
#: Stores that pyarrow opens, and its name for their scheme.
ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfss": "abfss"}


# ---- files ----------------------------------------------------------------

def located(path: str):
    """(pyarrow file system, path in it) of a Spark path; its name is never parsed as a URI."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/")
    store, base = fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}://{authority}/")
    return store, (f"{base.rstrip('/')}/{inner}" if base.strip("/") else (f"/{inner}" if scheme == "hdfs" else f"{authority}/{inner}"))


class Bytes:
    """A file's bytes by place: from the store, or given whole."""

    def __init__(self, path: str, content: bytes | None = None):
        self.content = content
        if content is None:
            store, inner = located(path)
            self.file = store.open_input_file(inner)
            self.length = self.file.size()
        else:
            self.length = len(content)

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.length - at))
        if self.content is not None:
            return self.content[at:at + n]
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        if self.content is None:
            self.file.close()

    def byte_order(self) -> str | None:
        """The UTF-16 byte order by the mark at the file's start."""
        start = self.read(0, 2)
        return next((name for name, bom in BOMS.items() if start == bom), None)

    def line_start(self, at: int, unit: np.dtype) -> int:
        """The first line start at or after ``at``: the place after a line break, or the file's start or end."""
        w = unit.itemsize
        at = -(-at // w) * w
        if at == 0 or at >= self.length:
            return min(at, self.length)
        lo = at - w
        while lo < self.length:
            u = units(self.read(lo, STEP_BYTES + w), unit)  # one more, to tell CRLF from CR
            last = len(u) * w + lo >= self.length // w * w
            found = breaks(u)
            found = found if last else found[found < len(u) - 1]
            if len(found):
                return lo + (int(found[0]) + 1) * w
            if last:
                break
            lo += (len(u) - 1) * w
        return self.length


def units(raw: bytes, unit: np.dtype) -> np.ndarray:
    """The bytes as an array of code units; an odd byte at the end is left out."""
    return np.frombuffer(raw, dtype=unit, count=len(raw) // unit.itemsize)


def breaks(u: np.ndarray) -> np.ndarray:
    """Places of the last unit of each line break: LF, or CR without LF after it."""
    lf, cr = u == LF, u == CR
    if cr.any():
        cr[:-1] &= ~lf[1:]
        lf |= cr
    return np.flatnonzero(lf)


# ---- quotes ---------------------------------------------------------------

OUTSIDE, INSIDE, DOUBLED = 0, 1, 2
_NO_CHANGE = np.array([0, 1, 2], dtype=np.uint8)


def quote_maps(u: np.ndarray, quotes: np.ndarray, delimiter: str, shifted: bool = False) -> np.ndarray:
    """Per quote: the states after it, from each state before it."""
    m = np.empty((len(quotes), 3), dtype=np.uint8)
    before = np.maximum(quotes - 1, 0)
    opens = (quotes == 0) | (u[before] == LF) | (u[before] == CR)
    sep = np.frombuffer(delimiter.encode() if u.itemsize == 1 else delimiter.encode("utf-16-be" if u.dtype.byteorder == ">" else "utf-16-le"), dtype=u.dtype)
    ends = quotes >= len(sep)
    for k, c in enumerate(sep[::-1], 1):
        ends &= u[np.maximum(quotes - k, 0)] == c
    if shifted and 0x40 <= sep[-1] < 0x80:  # not where that byte is the second of a character
        for k in np.flatnonzero(ends):
            i = j = int(quotes[k]) - 2
            while j >= 0 and (0x81 <= u[j] <= 0x9F or 0xE0 <= u[j] <= 0xFC):
                j -= 1
            ends[k] = (i - j) % 2 == 0
    m[:, OUTSIDE] = opens | ends
    doubled = np.zeros(len(quotes), dtype=bool)
    doubled[:-1] = np.diff(quotes) == 1
    m[:, INSIDE] = np.where(doubled, DOUBLED, OUTSIDE)
    m[:, DOUBLED] = INSIDE
    return m


def composed(m: np.ndarray) -> np.ndarray:
    """Maps [..., n, 3] in a row as one map [..., 3]."""
    while m.shape[-2] > 1:
        if m.shape[-2] % 2:
            m = np.concatenate([m, np.broadcast_to(_NO_CHANGE, (*m.shape[:-2], 1, 3))], axis=-2)
        m = np.take_along_axis(m[..., 1::2, :], m[..., 0::2, :], axis=-1)
    return m[..., 0, :] if m.shape[-2] else np.broadcast_to(_NO_CHANGE, (*m.shape[:-2], 3))


def states_after(m: np.ndarray, start: int, width: int = 256) -> np.ndarray:
    """The state after each quote, from the state before the first one."""
    n = len(m)
    width = max(1, min(width, int(n ** 0.5)))
    rows = -(-n // width)
    full = np.concatenate([m, np.broadcast_to(_NO_CHANGE, (rows * width - n, 3))]).reshape(rows, width, 3)
    state = np.empty(rows, dtype=np.uint8)
    for i, whole in enumerate(composed(full).tolist()):
        state[i] = start
        start = whole[start]
    out = np.empty((rows, width), dtype=np.uint8)
    every = np.arange(rows)
    for k in range(width):
        state = full[every, k, state]
        out[:, k] = state
    return out.ravel()[:n]


def record_ends(u: np.ndarray, state: int, delimiter: str, shifted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places after the line breaks that end a record, places where those records' texts end)."""
    at = breaks(u)
    quotes = np.flatnonzero(u == QUOTE)
    if len(quotes):
        after = np.concatenate(([state], states_after(quote_maps(u, quotes, delimiter, shifted), state)))
        at = at[after[np.searchsorted(quotes, at)] == OUTSIDE]
    elif state == INSIDE:
        at = at[:0]
    crlf = (u[at] == LF) & (at > 0) & (u[np.maximum(at - 1, 0)] == CR)
    return at + 1, at - crlf


# ---- first scan -----------------------------------------------------------

SCAN_SCHEMA = ("path string, range int, start long, end long, utf16 string, n_lf long, n_cr long, n_crlf long, "
               "first_text long, last_text long, n_text_lines long, bad map<string,bigint>, turns map<string,int>")


def bad_characters(raw: bytes, encoding: str) -> int:
    """How many characters do not decode."""
    if raw.isascii():
        return 0
    try:
        raw.decode(encoding)
        return 0
    except UnicodeDecodeError:
        n = raw.decode(encoding, "replace").count("�")
        return max(1, n - (raw.count("�".encode()) if encoding == "utf-8" else 0))


def measure(f: Bytes, at: int, upto: int, encodings: list[str], delimiters: list[str]) -> dict:
    """What the first scan tells of the range that begins at the first line start from ``at`` on."""
    utf16 = f.byte_order()
    unit = UNITS.get(utf16, np.dtype("u1"))
    start, end = f.line_start(at, unit), f.line_start(upto, unit)
    raw = f.read(start, end - start)
    mark = 0 if start else (2 if utf16 else len(UTF8_BOM) if raw.startswith(UTF8_BOM) else 0)
    u = units(raw, unit)[mark // unit.itemsize:]
    cr, lf, found = u == CR, u == LF, breaks(u)
    crlf = int((cr[:-1] & lf[1:]).sum()) if len(u) else 0
    text = ~(cr | lf | (u == 0x20) | (u == 0x09))
    some = np.flatnonzero(text)
    base = start + mark
    first = last = None
    n_lines = 0
    if len(some):
        starts = np.concatenate(([0], found + 1))
        first = base + int(starts[np.searchsorted(starts, some[0], side="right") - 1]) * unit.itemsize
        last = base + int(some[-1]) * unit.itemsize
        n_lines = int(np.logical_or.reduceat(text, starts[starts < len(u)]).sum())
    quotes = np.flatnonzero(u == QUOTE)
    turns = {}
    for d in delimiters:
        for shifted in ((False, True) if unit.itemsize == 1 and "@" <= d[-1] < "\x80" else (False,)):
            to = composed(quote_maps(u, quotes, d, shifted))
            turns[d + ("\n" if shifted else "")] = int(to[OUTSIDE]) + 2 * int(to[INSIDE])
    return {"start": start, "end": end, "utf16": utf16, "n_lf": int(lf.sum()) - crlf, "n_cr": int(cr.sum()) - crlf, "n_crlf": crlf,
            "first_text": first, "last_text": last, "n_text_lines": n_lines,
            "bad": {} if utf16 else {e: bad_characters(raw, e) for e in encodings}, "turns": turns}


def with_content(rows: DataFrame, method: str = "auto") -> DataFrame:
    """``rows`` (path, ...) with ``content``, the file's bytes where tasks can't open it, else null.

    method: ``open`` (tasks open the files through pyarrow), ``spark`` (Spark's
    binary reader hands over the bytes: any store, but no name that begins with
    ``_`` or ``.``), or ``auto``, by the scheme of each path.
    """
    scheme = F.regexp_extract("path", "^([A-Za-z0-9+.-]+):/", 1)
    known = {"open": F.lit(True), "spark": F.lit(False), "auto": (scheme == "") | scheme.isin(*ARROW_SCHEMES)}[method]
    none = F.lit(None).cast("binary").alias("content")
    if method == "open" or not rows.where(~known).limit(1).count():
        return rows.select("*", none)
    from typesift.sources.files import literal_path, plain_path
    others = rows.where(~known)
    folders = [r[0] for r in others.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]  # normally one
    whole = rows.sparkSession.read.format("binaryFile").load([literal_path(p) for p in folders])
    whole = whole.select(plain_path(F.col("_metadata.file_path")).alias("path"), "content")
    return rows.where(known).select("*", none).unionByName(others.join(whole, "path"))


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES, method: str = "auto") -> DataFrame:
    """(path, range, at, upto, content) of files(path, length)."""
    at = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    cut = files.where("length > 0").select("path", F.posexplode(at).alias("range", "at"))
    return with_content(cut.withColumn("upto", F.col("at") + range_bytes), method)


def _spread(rows: DataFrame) -> DataFrame:
    """Ranges dealt over the cluster: a range is work enough for its move."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), "path", "range")


def scan(files: DataFrame, encodings: list[str], delimiters: list[str], *, range_bytes: int = RANGE_BYTES, method: str = "auto") -> DataFrame:
    """One row a range of files(path, length); turns: per delimiter, bit 0 is the end state from outside, bit 1 that from inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f = Bytes(r["path"], r["content"])  # an error fails the task: no file is dropped in silence
                found = measure(f, r["at"], r["upto"], encodings, delimiters)
                f.close()
                found = {"path": r["path"], "range": r["range"], **found} | {k: list(found[k].items()) for k in ("bad", "turns")}
                yield pa.RecordBatch.from_pylist([found], schema=_SCAN_ARROW)

    return _spread(ranges_of(files, range_bytes, method)).mapInArrow(run, SCAN_SCHEMA)


_SCAN_ARROW = pa.schema([("path", pa.string()), ("range", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                         ("utf16", pa.string()), ("n_lf", pa.int64()), ("n_cr", pa.int64()), ("n_crlf", pa.int64()), ("first_text", pa.int64()),
                         ("last_text", pa.int64()), ("n_text_lines", pa.int64()), ("bad", pa.map_(pa.string(), pa.int64())),
                         ("turns", pa.map_(pa.string(), pa.int32()))])


def turn_of(delimiter: Column, encoding: Column) -> Column:
    """The map of a scanned range for a file's delimiter and encoding."""
    key = F.when(encoding.isin(*SHIFTED), F.concat(delimiter, F.lit("\n"))).otherwise(delimiter)
    return F.coalesce(F.try_element_at("turns", key), F.try_element_at("turns", delimiter))


def start_states(scanned: DataFrame) -> DataFrame:
    """Adds ``state``, in which each range begins, to rows (path, range, turn, ...).

    A map is one of four: it keeps the state, swaps it, or leads to one state
    whatever was before.  The state is that of the last such range, swapped as
    often as there are swaps since.
    """
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("turn").isin(0, 3)  # turn: 0 both outside, 1 swaps, 2 keeps, 3 both inside
    rows = scanned.withColumn("since", F.coalesce(F.sum(F.when(fixed, 1).otherwise(0)).over(before), F.lit(0)))
    rows = rows.withColumn("known", F.coalesce(F.last(F.when(fixed, F.when(F.col("turn") == 3, 1).otherwise(0)), ignorenulls=True).over(before), F.lit(0)))
    within = Window.partitionBy("path", "since").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("turn") == 1, 1).otherwise(0)).over(within), F.lit(0))
    return rows.withColumn("state", ((F.col("known") + swaps) % 2).cast("int")).drop("since", "known")


# ---- second scan ----------------------------------------------------------

def codec(encoding: str) -> str:
    """Python's name of an encoding, for bytes without a mark."""
    return {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(encoding, encoding)


def texts_of(raw: bytes, starts: np.ndarray, ends: np.ndarray, encoding: str) -> list[str]:
    name = "ascii" if raw.isascii() and encoding == "utf-8" else codec(encoding)
    return [raw[s:e].decode(name, "replace") for s, e in zip(starts.tolist(), ends.tolist())]


def range_records(f: Bytes, start: int, end: int, state: int, encoding: str, delimiter: str, skip: int = 0) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, texts) of the records that begin in [start, end) at ``skip`` or later."""
    unit = UNITS.get(encoding, np.dtype("u1"))
    w, shifted = unit.itemsize, encoding in SHIFTED
    raw = f.read(start, end - start)
    after, texts_end = record_ends(units(raw, unit), state, delimiter, shifted)
    if state == INSIDE:  # the head belongs to the range before
        begin = after
        after, texts_end = after[1:], texts_end[1:]
    else:
        begin = np.concatenate(([0], after))
    begin = begin * w
    stop = len(raw) // w * w
    begin = begin[begin < stop]
    texts_end = texts_end * w
    if len(begin) > len(texts_end):  # the last one is not at its end here
        more, at = [], end
        while at < f.length:
            to = f.line_start(at + STEP_BYTES, unit)
            piece = f.read(at, to - at)
            there, text_end = record_ends(units(piece, unit), INSIDE, delimiter, shifted)
            if len(there):
                more.append(piece[:int(text_end[0]) * w])
                break
            more.append(piece)
            at = to
        raw += b"".join(more)
        texts_end = np.append(texts_end, len(raw))
    own = begin + start >= skip
    begin, texts_end = begin[own], texts_end[:len(own)][own]
    size, lo = np.cumsum(texts_end - begin), 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + BATCH_BYTES)))
        yield begin[lo:hi] + start, texts_of(raw, begin[lo:hi], texts_end[lo:hi], encoding)
        lo = hi


#: Records handed on as one row.
CHUNK_RECORDS = 1024


_SPAN_COLUMNS = ("path", "range", "start", "end", "state", "encoding", "delimiter", "skip")


def is_blank(record: str, delimiter: str) -> bool:
    """Whether a record is one field of spaces."""
    return not record.strip(' "') and delimiter not in record and not record.replace('"', "").strip(" ")


def records(spans: DataFrame, method: str = "auto") -> DataFrame:
    """(path, delimiter, row_id array, record array, ...) of rows (path, range, start, end, state, encoding, delimiter, skip, ...).

    row_id: the place of each record's first byte; blank records are left out.
    Further columns, strings or arrays of them, are what the rows of a file share:
    they go with every chunk of rows, so rows need no join to their file.
    """
    shared = [f for f in spans.schema.fields if f.name not in _SPAN_COLUMNS]
    kept = ["path", "delimiter", *(f.name for f in shared)]
    schema = ("path string, delimiter string, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shared)
              + "row_id array<bigint>, record array<string>")
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([("path", pa.string()), ("delimiter", pa.string()), *((f.name, kinds[f.dataType.simpleString()]) for f in shared),
                       ("row_id", pa.list_(pa.int64())), ("record", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f, own, d = Bytes(r["path"], r["content"]), {k: r[k] for k in kept}, r["delimiter"]
                for at, texts in range_records(f, r["start"], r["end"], r["state"], r["encoding"], d, r["skip"]):
                    some = [k for k, t in enumerate(texts) if not is_blank(t, d)]
                    at = at.tolist()
                    chunks = [some[lo:lo + CHUNK_RECORDS] for lo in range(0, len(some), CHUNK_RECORDS)]
                    if chunks:
                        yield pa.RecordBatch.from_pylist([own | {"row_id": [at[k] for k in c], "record": [texts[k] for k in c]} for c in chunks], schema=arrow)
                f.close()

    return with_content(_spread(spans), method).mapInArrow(run, schema)


# ---- heads ----------------------------------------------------------------

def head(f: Bytes, n_lines: int, start: int = 0) -> bytes:
    """The bytes from ``start`` to the end of the ``n_lines``-th line, however long."""
    unit = UNITS.get(f.byte_order(), np.dtype("u1"))
    at = start
    for _ in range(n_lines):
        if at >= f.length:
            break
        at = f.line_start(at + unit.itemsize, unit)
    return f.read(start, at - start)


def first_record(f: Bytes, start: int, encoding: str, delimiter: str) -> tuple[str, int]:
    """(text, place after it) of the record that begins at ``start``."""
    unit = UNITS.get(encoding, np.dtype("u1"))
    at = start
    while True:
        at = f.line_start(at + STEP_BYTES, unit)
        raw = f.read(start, at - start)
        after, text_end = record_ends(units(raw, unit), OUTSIDE, delimiter, encoding in SHIFTED)
        if len(after):
            return texts_of(raw, np.array([0]), text_end[:1] * unit.itemsize, encoding)[0], start + int(after[0]) * unit.itemsize
        if at >= f.length:
            return texts_of(raw, np.array([0]), np.array([len(raw) // unit.itemsize * unit.itemsize]), encoding)[0], f.length
