"""WARC archives: a writer with revisit records, and a salvage reader.

``write_archives`` writes one gzip member per record.  ``read_archives``
checks each record (gzip stream and checksum, version line, headers, length,
closing blank lines, payload digest).  Where a check fails it searches
byte by byte for the next gzip member or version line at which a whole valid
record starts, goes on from there, and logs the bytes between as one
quarantined gap.  A gzip member may hold any number of records: they are
walked in its unpacked bytes in the same way, with gaps of their own; a
member too large to keep is unpacked a second time, record by record.
Payload digests are checked in hex or base32 for the usual algorithms, and
not where the algorithm is unknown.

Tasks write files of unique names and report them; the reported names (a
table) are the archive, so files left by a lost task attempt are never read.
Files are streamed: a task holds one read window and one record.

Defined results: NULL payloads are empty; a NULL id is written as an empty
id and read as NULL; records of one group that share the largest id are all
responses, as are groups without any id; an empty table gives no file;
columns other than id, url and payload are ignored.  An empty or cut file
yields what is whole and a gap for the rest.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepared, staged

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
LINE = re.compile(rb"WARC/1\.")
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}   # bytes of the digests that are checked
WINDOW = 4 << 20          # bytes a reader holds of a file
RECORD_LIMIT = 1 << 30    # longest block of a record that is read
HEADER_LIMIT = 1 << 20    # longest header block of a record that is read
STEP = 1 << 14            # bytes given to the decompressor at once
FILE_BYTES = 16 << 20     # a writer starts a new file beyond this size
BATCH_BYTES = 8 << 20     # payload bytes per returned Arrow batch

MANIFEST = "path string, bytes long, records long"
RECORDS = ("path string, offset long, length long, kind string, reason string, record_type string, record_id string, "
           "target_uri string, refers_to string, header_digest string, header_bytes long, payload binary, "
           "inner_offset long, inner_length long")


class Limits(NamedTuple):
    record: int = RECORD_LIMIT
    header: int = HEADER_LIMIT


# ---------------------------------------------------------------- writing ----

def mark_revisits(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_bytes: int = 1000,
                  salts: int = 32) -> DataFrame:
    """``id, url, payload, digest, bytes, refers_to``; ``refers_to`` is set for revisits.

    Groups of equal payloads are summed up before the shuffle; only groups of
    two or more take part in the join, ``salts`` times, so that the copies of
    one hot page spread over as many tasks.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = (base.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
              .agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
              .select("digest", "bytes", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")
    joined = base.withColumn("salt", salt).join(groups, ["digest", "bytes", "salt"], "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("id", "url", "payload", "digest", "bytes", refers.alias("refers_to"))


def record_bytes(kind: str, record_id: str, url: str, digest: str, size: int, payload: bytes,
                 refers_to: str | None = None) -> bytes:
    """One uncompressed WARC/1.1 record with its closing blank lines."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{refers_to}>"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                 .encode()) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]},
                                              pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for ident, url, payload, digest, nbytes, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, n = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                kind = "response" if refers is None else "revisit"
                rid = f"urn:page:{'' if ident is None else ident}"
                gz = member(record_bytes(kind, rid, url, digest, nbytes, payload,
                                         None if refers is None else f"urn:page:{refers}"))
                out.write(gz)
                size, n = size + len(gz), n + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
    return write


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark itself gives it (a bare path is on the cluster's default file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as ``*.warc.gz`` into ``folder`` (shared storage); returns the manifest ``path, bytes, records``."""
    spark = prepared(pages.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    folder = _qualified(spark, folder)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = mark_revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    return staged(rows.mapInArrow(_writer(folder, file_bytes), MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reading ----

class Broken(Exception):
    """A record fails a check; the text says which."""


class Window:
    """Random reads over a file through one buffer."""

    def __init__(self, handle, size: int, span: int | None = None):
        self.handle, self.size, self.span, self.start, self.data = handle, size, span or WINDOW, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        end = min(pos + n, self.size)
        if pos < self.start or end > self.start + len(self.data):
            self.load(pos, max(n, self.span))
        return self.data[pos - self.start:end - self.start]

    def load(self, pos: int, n: int) -> None:
        self.handle.seek(pos)
        self.start, self.data = pos, self.handle.read(n)

    def find(self, pos: int, pattern: re.Pattern) -> int:
        """The next place from ``pos`` that may start a record, or the end."""
        while pos < self.size:
            chunk = self.at(pos, self.span)
            if m := pattern.search(chunk):
                return pos + m.start()
            pos += max(1, len(chunk) - len(VERSION) + 1) if pos + len(chunk) < self.size else len(chunk)
        return self.size


class Unpacked(Window):
    """The same reads over the contents of a gzip member, unpacked as far as needed and kept one buffer at a time."""

    def __init__(self, win: Window, pos: int, size: int, data: bytes | None):
        super().__init__(None, size, win.span)
        self.win, self.first = win, pos
        if data is not None:
            self.data = data
        else:
            self.rewind()

    def rewind(self) -> None:
        self.z, self.next, self.start, self.data = zlib.decompressobj(31), self.first, 0, b""

    def load(self, pos: int, n: int) -> None:
        if pos < self.start:
            self.rewind()
        parts, have = [self.data[pos - self.start:]], max(0, self.start + len(self.data) - pos)
        at = self.start + len(self.data)
        while have < n and not self.z.eof:
            chunk = self.win.at(self.next, STEP)
            part = self.z.decompress(chunk)
            self.next += len(chunk)
            at += len(part)
            if at > pos:
                parts.append(part[max(0, len(part) - (at - pos)):])
                have += len(parts[-1])
        self.start, self.data = pos, b"".join(parts)


def _member(win: Window, pos: int) -> tuple[Unpacked, int]:
    """The contents of the gzip member at ``pos``, read once to its checksum, and where the member ends."""
    z, parts, total, first = zlib.decompressobj(31), [], 0, pos
    while not z.eof:
        chunk = win.at(pos, STEP)
        if not chunk:
            raise Broken("cut gzip member")
        try:
            part = z.decompress(chunk)
        except zlib.error as e:
            raise Broken("bad gzip member") from e
        total += len(part)
        if parts is not None:
            parts.append(part)
            if total > 2 * win.span:
                parts = None  # too large to keep: its records are unpacked again one by one
        pos += len(chunk)
    return Unpacked(win, first, total, None if parts is None else b"".join(parts)), pos - len(z.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[0-9]", lines[0]):
        raise Broken("bad version line")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        found[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not found.get("content-length", "").isdigit() or "warc-type" not in found:
        raise Broken("no valid length or type")
    return found


def _digest(header: str) -> tuple[str | None, str | None]:
    """(algorithm, lower-case hex) of a digest header in hex or base32; (None, text) where the algorithm is unknown."""
    label, colon, value = header.strip().partition(":")
    label = label.lower().replace("-", "") if colon else "sha1"
    value = value if colon else header.strip()
    size = DIGESTS.get(label)
    if size is None:
        return None, value or None
    if re.fullmatch(r"[0-9A-Fa-f]*", value) and len(value) == 2 * size:
        return label, value.lower()
    try:
        raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        raw = b""
    if len(raw) != size:
        raise Broken("unreadable payload digest")
    return label, raw.hex()


def _checked(head: bytes, block: bytes, tail: bytes) -> dict:
    """The row of a record; raises ``Broken``."""
    f = _fields(head)
    if len(block) != int(f["content-length"]):
        raise Broken("cut block")
    if tail != b"\r\n\r\n":
        raise Broken("no blank lines after the block")
    payload = block
    if f.get("content-type", "").startswith("application/http"):
        _, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Broken("no end of HTTP headers")
    algorithm, digest = _digest(f["warc-payload-digest"]) if f.get("warc-payload-digest") else (None, None)
    if f["warc-type"] != "revisit" and algorithm and hashlib.new(algorithm, payload).hexdigest() != digest:
        raise Broken("payload digest differs")
    size = f.get("x-payload-length", "")
    return {"record_type": f["warc-type"], "record_id": f.get("warc-record-id", "").strip("<>"),
            "target_uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to", "").strip("<>") or None,
            "header_digest": digest, "header_bytes": int(size) if size.isdigit() else None, "payload": payload}


def _plain_at(win: Window, pos: int, limits: Limits) -> tuple[dict, int]:
    """The record whose version line is at ``pos`` and where it ends; raises ``Broken``."""
    if win.at(pos, len(VERSION)) != VERSION:
        raise Broken("no gzip member or version line")
    span = STEP
    while (at := (data := win.at(pos, span)).find(b"\r\n\r\n")) < 0:
        if span >= limits.header or pos + span >= win.size:
            raise Broken("no end of headers")
        span *= 4
    if at > limits.header:
        raise Broken("headers over the size limit")
    n = int(_fields(data[:at])["content-length"])
    if n > limits.record:
        raise Broken("record over the size limit")
    if pos + at + 4 + n + 4 > win.size:
        raise Broken("cut block")
    whole = win.at(pos + at + 4, n + 4)
    return _checked(data[:at], whole[:n], whole[n:]), pos + at + 4 + n + 4


def _walk(win: Window, pattern: re.Pattern, read) -> Iterator[tuple[int, int, list[dict] | str]]:
    """(start, end, rows or the failed check): what ``read(pos) -> rows, end`` finds, and the gaps between."""
    pos = 0
    while pos < win.size:
        try:
            rows, end = read(pos)
        except Broken as why:
            start, reason = pos, str(why)
            while (pos := win.find(pos + 1, pattern)) < win.size:
                try:
                    rows, end = read(pos)
                    break
                except Broken:
                    continue
            yield start, pos, reason
            if pos >= win.size:
                return
        yield pos, end, rows
        pos = end


def salvage(handle, size: int, limits: Limits | None = None) -> Iterator[dict]:
    """Rows of kind ``record`` and ``gap`` that together cover the file.

    ``offset`` and ``length`` are the bytes of the file: a plain record, a
    gzip member or a gap.  The records and gaps inside a member also have
    ``inner_offset`` and ``inner_length`` in its unpacked bytes.
    """
    win, limits = Window(handle, size), limits or Limits()

    def read(pos: int) -> tuple[Iterator[dict], int]:
        if not win.at(pos, len(VERSION)).startswith(MAGIC):
            row, end = _plain_at(win, pos, limits)
            return iter([{"kind": "record", **row}]), end
        inside, end = _member(win, pos)

        def rows() -> Iterator[dict]:
            def plain(at: int) -> tuple[list[dict], int]:
                row, stop = _plain_at(inside, at, limits)
                return [row], stop

            for start, stop, found in _walk(inside, LINE, plain):
                place = {"inner_offset": start, "inner_length": stop - start}
                if isinstance(found, str):
                    yield {"kind": "gap", "reason": found, **place}
                else:
                    yield {"kind": "record", **place, **found[0]}

        # A member without any record is part of a gap: only its leading gaps are held until that is known.
        found, held = rows(), []
        for row in found:
            held.append(row)
            if row["kind"] == "record":
                return itertools.chain(held, found), end
        raise Broken(held[0]["reason"] if held else "empty gzip member")

    for start, end, found in _walk(win, START, read):
        if isinstance(found, str):
            yield {"kind": "gap", "offset": start, "length": end - start, "reason": found}
        else:
            for row in found:
                yield {"offset": start, "length": end - start, **row}


def _reader(schema: pa.Schema, limits: Limits, counted: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            expected = batch.column(1).to_pylist() if counted else [None] * batch.num_rows
            for path, n in zip(batch.column(0).to_pylist(), expected, strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                seen = 0
                with fs.open_input_file(name) as handle:
                    for row in salvage(handle, handle.size(), limits):
                        seen += row["kind"] == "record"
                        rows.append({"path": path, **row})
                        held += len(row.get("payload") or b"") + 200
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if n is not None and seen != n:
                    raise ValueError(f"{path}: {n} records were written, {seen} could be read")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_archives(files: DataFrame, *, record_limit: int = RECORD_LIMIT, header_limit: int = HEADER_LIMIT,
                  whole: bool = False) -> DataFrame:
    """Records and gaps of the files in column ``path`` (one row per file; see ``RECORDS``).

    ``kind`` is ``record`` or ``gap``; a gap has offset, length and the failed
    check as ``reason``.  A record over ``record_limit`` bytes, or with
    headers over ``header_limit``, is a gap whose reason says so: a task holds
    one record.  With ``whole`` the table is a manifest of ``write_archives``,
    and a file that yields another number of records than were written fails
    the job instead of losing rows.
    """
    spark = prepared(files.sparkSession)
    n = max(1, files.count())
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RECORDS.split(", "))])
    spread = files.select("path", *(["records"] if whole else [])).repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(_reader(schema, Limits(record_limit, header_limit), whole), RECORDS)
