"""WARC archives: written with revisit records, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
AHEAD = 1 << 18
VERSION = b"WARC/1."
MANIFEST = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
RECORD = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("error", pa.string()), ("agrees", pa.bool_()), ("payload", pa.binary())])


def with_types(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 100) -> DataFrame:
    """(id, url, payload, digest, refers_to) for each row; refers_to is the smallest id with an equal payload of `least` bytes or more, unless that is the row's own.

    Only (digest, id) pairs are aggregated, before the shuffle; payloads move
    once, in a join that may split a digest that very many rows have.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))


def record(id_: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """One gzip member with one record; a revisit has no payload but states its length."""
    block = HTTP if refers is not None else HTTP + payload
    name = f"<urn:page:{id_}>" if id_ is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def write_warc(typed: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", roll: int = 1 << 27) -> DataFrame:
    """(path, size, records) of the archives written below folder from what with_types() gives.

    Each task attempt writes files of its own name, of about `roll` bytes at
    most. The returned table is written too, so it names just the files of the
    attempts that Spark counts; what a lost attempt left is in no list and never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = files.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for id_, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, n = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(id_, url, payload, digest, refers, date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], schema=MANIFEST)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], schema=MANIFEST)

    rows = typed.select(F.col("id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return written(rows.mapInArrow(run, "path string, size long, records long"))


class Window:
    """Bytes of a file from a moving position on, read as needed."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held = file, at, bytearray()
        file.seek(at)

    def want(self, n: int) -> bytearray:
        while len(self.held) < n and (more := self.file.read(max(AHEAD, n - len(self.held)))):
            self.held += more
        return self.held

    def skip(self, n: int) -> None:
        self.at += n
        del self.held[:n]


def header_size(window: Window) -> int | None:
    """Length of the gzip header at the window's start; None if it isn't a whole one."""
    flags, at = (window.want(AHEAD)[3:4] or b"\xff")[0], 10
    if flags & 0xE0:
        return None
    held = window.held
    if flags & 4:
        at += 2 + int.from_bytes(held[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = held.find(0, at)
            if end < 0:
                return None
            at = end + 1
    return at + (2 if flags & 2 else 0)


def salvaged(inflate, part: bytes, step: int = 64) -> bytes:
    """What can be decompressed of a part that is damaged somewhere."""
    out = []
    try:
        for i in range(0, len(part), step):
            out.append(inflate.decompress(part[i : i + step]))
    except zlib.error:
        pass
    return b"".join(out)


def member(window: Window) -> tuple[bytes, int, str | None] | None:
    """(contents, compressed size, what is wrong with it) of the gzip member at the window's start, if it is one and holds a WARC record.

    The size of a member that ends too early or is damaged within is 1, from where to look for the next.
    """
    used = header_size(window)
    if used is None:
        return None
    inflate, out, head, error = zlib.decompressobj(-15), [], b"", None
    while not inflate.eof and error is None:
        held = window.want(used + 1)
        part, before = bytes(held[used : used + AHEAD]), inflate.copy()
        try:
            out.append(inflate.decompress(part))
        except zlib.error:
            out.append(salvaged(before, part))
            error = "its compressed data are damaged"
        used += len(part) - len(inflate.unused_data)
        if not part:
            error = "the archive ends within it"
        if len(head) < len(VERSION):
            head = b"".join(out)[: len(VERSION)]
            if len(head) == len(VERSION) and head != VERSION:
                return None
    if head != VERSION:
        return None
    data = b"".join(out)
    if error:
        return data, 1, error
    end = bytes(window.want(used + 8)[used : used + 8])
    if len(end) < 8:
        return data, 1, "the archive ends within it"
    return data, used + 8, None if zlib.crc32(data) == int.from_bytes(end[:4], "little") else "its checksum differs"


def records(file, start: int, end: int) -> Iterator[tuple]:
    """Records whose gzip member starts in [start, end); the last one may end beyond."""
    window = Window(file, start)
    while window.at < end:
        held = window.want(AHEAD)
        at = held.find(MAGIC)
        if at < 0:
            if len(held) < len(MAGIC):
                return
            window.skip(max(1, len(held) - len(MAGIC) + 1))
            continue
        window.skip(at)
        if window.at >= end:
            return
        found = member(window)
        if found is None:
            window.skip(1)
            continue
        window.skip(found[1])
        yield from contained(found[0], found[2])


def contained(data: bytes, error: str | None = None) -> Iterator[tuple]:
    """The rows of all records of a member; what is wrong with the member is said of the last one, or of all if they seem whole."""
    rows, at = [], 0
    while data.startswith(VERSION, at):
        row, at = parsed(data, at)
        rows.append(row)
    if at < len(data):
        rows.append((*[None] * 7, f"{len(data) - at} bytes after a record are none", None, None))
    for i, row in enumerate(rows):
        said = error if i == len(rows) - 1 or error and "checksum" in error else None
        yield (*row[:7], said or row[7], *row[8:])


def payload_of(kind: str, fields: dict[str, str], block: bytes) -> bytes | None:
    """What a record holds: an HTTP message's body, or else the whole block; a revisit holds nothing."""
    if kind == "revisit":
        return None
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def agrees(payload: bytes, digest: str) -> bool | None:
    """Whether a labelled digest is the payload's; null for a kind of digest that isn't known."""
    label, _, value = digest.partition(":")
    name = label.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    found = hashlib.new(name, payload)
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def parsed(data: bytes, start: int = 0) -> tuple[tuple, int]:
    """The columns of RECORD of any record type, and where the next record may begin.

    A payload's length and SHA-256 come from itself. A payload that this module
    wrote must agree with its header; others say in `agrees` whether they do,
    since writers differ in what they digest. A revisit has the digest that its
    header gives, without the label if it is sha256. error says what is wrong:
    no end of the header, no length or none that is a number, fewer bytes than
    that. Such a record has no payload, and nothing is measured.
    """
    end = data.find(b"\r\n\r\n", start)
    head, at = (data[start:end], end + 4) if end >= 0 else (data[start:], len(data))
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    name, kind, stated = fields.get("warc-record-id", ""), fields.get("warc-type", ""), fields.get("content-length", "")
    size = int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None
    error = None
    if end < 0:
        error = "its header has no end"
    elif size is None:
        error = f"its length is given as {stated[:40]!r}"
    elif at + size > len(data):
        error = f"it has {len(data) - at} of {size} bytes"
    page, refers = re.fullmatch(r"<urn:page:(.*)>", name), re.fullmatch(r"<(?:urn:page:)?(.*)>", fields.get("warc-refers-to", ""))
    known = (page and page[1], fields.get("warc-target-uri"), kind or None, refers and refers[1])
    if error:
        return (*known, None, None, name.strip("<>") or None, error, None, None), len(data)
    block, digest = data[at : at + size], fields.get("warc-payload-digest")
    payload = payload_of(kind, fields, block)
    same = agrees(payload, digest) if payload is not None and digest else None
    if same is False and page:
        raise ValueError(f"record {name} has another payload than its digest says")
    stated = fields.get("x-payload-length", "")
    length = len(payload) if payload is not None else int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None
    own = hashlib.sha256(payload).hexdigest() if payload is not None else digest and digest.removeprefix("sha256:")
    at += size
    while data[at : at + 1] in (b"\r", b"\n"):
        at += 1
    return (*known, length, own, name.strip("<>") or None, None, same, payload), at


def read_warc(archives: DataFrame, split: int = 1 << 25, payload: bool = True) -> DataFrame:
    """(id, url, record_type, refers_to, payload_bytes, payload_digest, record_id, error, agrees, payload) for each record of (path, size), of whatever type.

    A file is cut into ranges of `split` bytes, dealt to tasks. A range's task
    looks for gzip magic, takes what decodes to a WARC header for a record, and
    owns the records that start inside. Ids are strings, null where the record
    is no page of write_warc(); record_id has every record's name. See parsed()
    for digests; a revisit's payload is null. Files of any size and
    archives without records are fine. A member that ends too early, is damaged
    or has a wrong checksum, a record with a bad header or fewer bytes than it
    says, and bytes that are no record give rows whose `error` says so. All
    records of a member are read. A member whose first bytes are damaged can't
    be told from noise; a manifest's count shows that one is missing.
    """
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    ranges = archives.where("size > 0").select("path", "size", step.alias("start"))
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = files.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for r in records(file, start, min(size, start + split)):
                        rows.append(r if payload else (*r[:-1], None))
                        held += r[4] or 64 if payload else 64
                        if held > 1 << 24:
                            yield block(rows)
                            rows, held = [], 0
                if rows:
                    yield block(rows)

    schema = "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, record_id string, error string, agrees boolean, payload binary"
    return ranges.repartition(tasks, "path", "start").select("path", "size", "start").mapInArrow(run, schema)


def block(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)


def through_warc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, roll: int = 1 << 27, split: int = 1 << 25, payload: bool = False) -> DataFrame:
    """read_warc() of the archives written from df, in a new shared folder.

    Of rows with equal payloads of at least `least` bytes the one with the
    smallest id is a response, and rows with that same id too; the others
    revisit it. Null payloads count as empty, and short ones are all responses.
    Null ids revisit, but are referred to by none; where there are only null
    ids, all are responses. A null url is left out. What was read is a written
    table; if it isn't as many records as were written, or any has an error,
    that is an error here.
    """
    archives = write_warc(with_types(df, id_col, url_col, payload_col, least), shared_folder(df.sparkSession), roll=roll)
    rows = written(read_warc(archives, split, payload))
    wrote = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    read, wrong, said = rows.agg(F.count("*"), F.count("error"), F.min("error")).first()
    if (read, wrong) != (wrote, 0):
        raise ValueError(f"{wrote} records were written and {read} read, {wrong} of them with errors ({said})")
    return rows
