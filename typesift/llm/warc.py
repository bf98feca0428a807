"""WARC archives: a writer with revisit records and a salvage reader.

``write_warc`` deals the pages out by payload digest and writes gzip-per-record
archives to a shared folder.  Of equal payloads of at least ``min_bytes`` the
one with the smallest page_id is a response and the others are revisits of it.

``read_warc`` reads archives (gzip members of one or more records, or plain
records; WARC/0.x and 1.x, folded header lines) in byte ranges.  Every record is
checked: the member's CRC, the header, the block's length and its digests, in the
algorithm and spelling that they declare; an unknown one is not checked.  After a
failed check the reader searches for the next valid
member or version line, recovers what follows, and logs the bytes between as a
quarantined gap.

Definite results: a null payload is empty; a null url leaves the header out; a
null page_id sorts after all others (such rows are revisits if any equal
payload has a page_id, else responses); rows that share the smallest page_id
are all responses; an empty table writes no archive and reads no record;
columns other than page_id, url and html are ignored.  The records of one member
share its offset and length.  A member is held whole by the task that reads it.

Archives go through pyarrow's file systems, so the folder may be local to all
(shared) or a store that pyarrow reaches.  Each attempt of a task writes files
of its own; only those of the attempt that Spark committed are in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm.session import materialize, partitions, scratch_dir, shipped

MIN_BYTES = 0
ROLL_BYTES = 128 << 20
RANGE_BYTES = 32 << 20
GZIP_LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_records long, bytes long"
RECORD = ("path string, offset long, length long, problem string, type string, record_id string, target_uri string, "
          "payload_digest string, payload_bytes long, refers_to string, payload binary")


def filesystem(uri: str):
    """(file system, path) of a folder or file."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- write ----------------------------------------------------------------

def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One record; a revisit keeps the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "bytes": [size]})

        for b in batches:
            for page_id, url, html, digest, rep in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "rep"))):
                if out is None or size >= roll_bytes:
                    if out is not None:
                        yield done()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, path, n, size = fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                refers_to = None if rep is None or rep == page_id else rep
                member = gzip_member(record_bytes(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                out.write(member)
                n += 1
                size += len(member)
        if out is not None:
            yield done()

    return write


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (path, n_records, bytes), itself stored."""
    shipped(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("rep"))
    dealt = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "rep")
    return materialize(dealt.mapInArrow(_writer(folder, roll_bytes), MANIFEST), "warc-manifest")


# ---- read -----------------------------------------------------------------

class Damaged(Exception):
    pass


class _Source:
    """A file read at any place through one buffer."""

    STEP = 1 << 20

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.buffer = 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.buffer)):
            self.file.seek(start)
            self.at, self.buffer = start, self.file.read(max(n, self.STEP))
        return self.buffer[start - self.at:start - self.at + n]

    def candidate(self, start: int) -> int:
        """The next place that looks like a member or a version line; -1 if none."""
        while start < self.size:
            chunk = self.read(start, self.STEP)
            m = _CANDIDATE.search(chunk)
            if m:
                return start + m.start()
            if start + len(chunk) >= self.size:
                break
            start += len(chunk) - 6  # a candidate may lie across the end
        return -1


_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.")
_VERSION = re.compile(rb"WARC/[01]\.[0-9]+")
_HEAD_END = b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    """Names (lower case) and values; a line that begins with white space goes on with the value before it."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/[01]\.[0-9]+", lines[0]):
        raise Damaged("no version line")
    out, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        name = name.strip().lower()
        out[name] = value.strip()
    if "warc-type" not in out or "warc-record-id" not in out or not out.get("content-length", "").isdigit():
        raise Damaged("required header missing")
    return out


#: Digest labels and the names hashlib has for them.
ALGORITHMS = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha384": "sha384", "sha-384": "sha384",
              "sha512": "sha512", "sha-512": "sha512", "md5": "md5"}


def digest_differs(declared: str, data: bytes) -> bool:
    """Whether a declared digest is one that can be checked and is not the data's.

    The value may be hex, base32 or base64, in any case that its alphabet allows;
    an algorithm that is not known is not checked.
    """
    label, colon, value = declared.partition(":")
    name = ALGORITHMS.get(label.strip().lower())
    if not colon or name is None:
        return not declared.isascii()  # a damaged label
    want, value = hashlib.new(name, data).digest(), value.strip()
    bare = value.rstrip("=")
    if re.fullmatch("[0-9A-Fa-f]+", value) and len(value) == 2 * len(want):
        return value.lower() != want.hex()
    if re.fullmatch("[A-Za-z2-7]+", bare) and len(bare) == -(-8 * len(want) // 5):
        return bare.upper() != base64.b32encode(want).decode().rstrip("=")
    if re.fullmatch("[A-Za-z0-9+/_-]+", bare) and len(bare) == -(-8 * len(want) // 6):
        return bare.replace("-", "+").replace("_", "/") != base64.b64encode(want).decode().rstrip("=")
    return True  # no spelling of such a digest


def _checked(head: dict[str, str], block: bytes) -> dict:
    """The record's fields, after the digests."""
    if digest_differs(head.get("warc-block-digest", ""), block):
        raise Damaged("block digest")
    is_http = head.get("content-type", "").startswith("application/http")
    http, _, payload = block.partition(_HEAD_END) if is_http else (b"", b"", block)
    declared = head.get("warc-payload-digest", "")
    n, digest = len(payload), None
    if head["warc-type"] == "revisit":
        digest = declared.partition(":")[2] or None  # of the payload that is elsewhere
        found = re.search(rb"(?i)\r\ncontent-length:[ ]*([0-9]+)", http)
        n = int(found[1]) if found else 0
        payload = b""
    elif digest_differs(declared, payload):
        raise Damaged("payload digest")
    return {"type": head["warc-type"], "record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"),
            "payload_digest": digest or base32_sha1(payload), "payload_bytes": n,
            "refers_to": head.get("warc-refers-to"), "payload": payload}


def _parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(fields, end) of the record at a place of a member's data."""
    end = data.find(_HEAD_END, at)
    if end < 0:
        raise Damaged("no header end")
    head = _headers(data[at:end])
    start, n = end + 4, int(head["content-length"])
    if data[start + n:start + n + 4] != _HEAD_END:
        raise Damaged("block length")
    return _checked(head, data[start:start + n]), start + n + 4


def _all(data: bytes) -> list[dict]:
    """The records of a member, normally one; what lies between them is told as a problem.  Damaged if there is none."""
    out, at, first = [], 0, None
    while at < len(data):
        try:
            fields, at = _parse(data, at)
            out.append(fields)
        except Damaged as e:
            first = first or e
            out.append({"problem": str(e)})
            while True:  # on to the next version line with a whole record
                m = _VERSION.search(data, at + 1)
                if m is None:
                    at = len(data)
                    break
                at = m.start()
                try:
                    _parse(data, at)
                    break
                except Damaged:
                    pass
    if first is not None and all("problem" in r for r in out):
        raise first
    return out


def _member(src: _Source, at: int) -> tuple[bytes, int]:
    """(data, end) of the gzip member at ``at``; its CRC is checked."""
    z, parts, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        chunk = src.read(pos, 1 << 16)
        if not chunk:
            raise Damaged("member cut off")
        try:
            parts.append(z.decompress(chunk))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        if len(parts) == 1 and len(parts[0]) >= 5 and not parts[0].startswith(b"WARC/"):
            raise Damaged("no version line")
        pos += len(chunk)
    return b"".join(parts), pos - len(z.unused_data)


def _plain_head(src: _Source, at: int) -> int:
    """Length of the header of the plain record at ``at``, however long."""
    n = 1 << 16
    while (found := src.read(at, n).find(_HEAD_END)) < 0:
        if at + n >= src.size:
            raise Damaged("no header end")
        n *= 2
    return found


def _records(src: _Source, at: int) -> tuple[list[dict], int]:
    """(records, end) of the member or plain record at ``at``; Damaged has ``end`` where that is known."""
    if src.read(at, 3) == b"\x1f\x8b\x08":
        data, end = _member(src, at)
        try:
            return _all(data), end
        except Damaged as e:
            e.end = end
            raise
    if not _VERSION.match(src.read(at, 16)):
        raise Damaged("neither member nor version line")
    head_end = _plain_head(src, at)
    head = _headers(src.read(at, head_end))
    start, n = at + head_end + 4, int(head["content-length"])
    if start + n + 4 > src.size or src.read(start + n, 4) != _HEAD_END:
        raise Damaged("block length")
    return [_checked(head, src.read(start, n))], start + n + 4


def _next_valid(src: _Source, at: int) -> int:
    """Where the next readable record begins, or the end of the file."""
    while (at := src.candidate(at)) >= 0:
        try:
            _records(src, at)
            return at
        except Damaged:
            at += 1
    return src.size


def salvage(file, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """Records that begin in [start, end), and gaps (with ``problem``) of the bytes that no record covers.

    A gap goes with the record before it, so that each is told once, whatever
    the ranges; one at the start of the file goes with the first range.
    """
    src = _Source(file)
    end = src.size if end is None else end
    at = start if start == 0 else _next_valid(src, start)
    inside = at < end
    while inside and at < src.size:
        try:
            found, after = _records(src, at)
        except Damaged as e:
            after = _next_valid(src, getattr(e, "end", at + 1))
            yield {"offset": at, "length": after - at, "problem": str(e)}
            inside = after < end
        else:
            if at >= end:  # the next range's
                return
            for fields in found:
                yield fields | {"offset": at, "length": after - at}
        at = after


def _reader(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("problem", pa.string()),
                            ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end"))):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    rows, held = [], 0
                    for r in salvage(f, start, end):
                        if not payloads:
                            r.pop("payload", None)
                        rows.append(r | {"path": path})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_warc(files: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records and quarantined gaps (``problem`` not null) of archives (path, bytes), in byte ranges."""
    shipped(files.sparkSession)
    step = F.lit(range_bytes).cast("long")
    ranges = files.where("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + step).alias("end"))
    # a number of partitions, so that the few small rows aren't put together again
    return ranges.repartition(partitions(files.sparkSession), "path", "start").mapInArrow(_reader(payloads), RECORD)


def op2(pages: DataFrame) -> DataFrame:
    manifest = write_warc(pages, scratch_dir(pages.sparkSession, "warc"))
    records = read_warc(manifest, payloads=False).where("problem is null")
    def page(c):
        return F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]+|null)>$", 1), F.lit("null")).cast("long")
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                          F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
