"""WARC records in ZIP packages: a writer, and a reader that takes ranges of stored members.

A package that is written here holds an archive of records, each compressed by itself, and an index of
their ranges (CDXJ), both stored. The reader looks up the central directory (of ZIP64 too), finds all
stored members that are archives (.warc, .warc.gz) or indexes (.cdxj), and reads records by range; nothing
is extracted. An archive without index entries is walked through once to find its records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh_dir, in_arrow, join_skewed, settled

REVISIT_BYTES = 1000
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes of records that one reading task takes from an archive, and of payloads that it holds at once.
SLICE_BYTES, HELD_BYTES = 8 << 20, 4 << 20
_SPACE_ID = uuid.UUID("5f0d7f4e-4b0e-5a7c-9d55-3f6f4b7a9d11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: the payload behind an HTTP header, or, for a revisit, the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields += [("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def url_key(url: str) -> str:
    """The key of an index line: the host's labels from the last to the first, then the path and the rest."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return quote(url, safe="") or "-"
    return quote(f"{host}){parts.path}{'?' + parts.query if parts.query else ''}".lower(), safe="/,)?&=.", errors="replace")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


@dataclass
class Member:
    name: str
    method: int
    offset: int  # of its local header
    size: int  # in the package


class Package:
    """The directory of a ZIP file, read by ranges. `source` has size() and seek/read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<Q", tail, locator + 8)
            wide = self.read(at, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", wide, 32)
        self.members = list(self._directory(self.read(start, length), count))

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(n)
        if len(got) != n:
            raise ValueError("the package ends early")
        return got

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", raw, at + 20)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            e, stop = at + 46 + n, at + 46 + n + extra
            while e + 4 <= stop:
                kind, size = struct.unpack_from("<HH", raw, e)
                if kind == 1:  # only the fields that did not fit are there, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", raw, e + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                e += 4 + size
            yield Member(name, method, offset, packed)
            at = stop + comment

    def data_at(self, member: Member) -> int:
        """Where a stored member's bytes begin: behind its local header."""
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{member.name} is not stored")
        head = self.read(member.offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return member.offset + 30 + n + extra


class _Writer:
    """One package after another in a folder; each is complete under its name, or not there."""

    def __init__(self, folder: str, task: int, attempt: int, limit: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.task, self.attempt, self.limit, self.number = task, attempt, limit, 0
        self.fs.create_dir(self.folder, recursive=True)
        self.zip: zipfile.ZipFile | None = None

    def add(self, page_id, url, payload, digest, refers_to) -> str | None:
        if self.zip is None:
            self.name = f"{self.folder}/part-{self.task:06d}-{self.number:04d}.wacz"
            self.out = self.fs.open_output_stream(f"{self.name}.{self.attempt}.tmp", buffer_size=1 << 20)
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
            self.member, self.at, self.index = self.zip.open("archive/data.warc.gz", "w", force_zip64=True), 0, []
        deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
        raw = deflate.compress(record(page_id, url, payload, digest, refers_to)) + deflate.flush()
        self.member.write(raw)
        shown = {"url": url or "", "mime": "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(raw)), "offset": str(self.at), "filename": "data.warc.gz"}
        self.index.append(f"{url_key(url or '')} 19700101000000 {json.dumps(shown)}\n")
        self.at += len(raw)
        return self.close() if self.at >= self.limit else None

    def close(self) -> str | None:
        if self.zip is None:
            return None
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(sorted(self.index)))
        self.zip.close()
        self.out.close()
        self.fs.move(f"{self.name}.{self.attempt}.tmp", self.name)
        self.zip, self.number = None, self.number + 1
        return self.name


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least `least` bytes all but that
    with the largest page_id revisit it. Null html is empty; a null page_id never is the largest."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    first = F.when(F.max("size") >= least, F.max("page_id")).alias("first")  # small ones too, as their digest may be hot
    facts = settled(slim.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1"))
    joined = join_skewed(rows, facts, "digest", "n", pages.count())
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the packages' paths (path).

    Null html is an empty payload; repeated rows are records each; a long payload is one record, which a task holds.
    The folder is in the shared folder unless given. A task writes its packages under its own names, each
    moved into place once complete, so a task that is run again replaces them.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out = _Writer(folder, task.partitionId(), task.taskAttemptId(), archive_bytes)
        paths = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if path := out.add(**row):
                    paths.append(path)
        if path := out.close():
            paths.append(path)
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths)], names=["path"])

    written = settled(decided(pages, least).mapInArrow(run, "path string"))
    root = folder if "://" not in folder else folder.split("://", 1)[0] + "://"
    return written.select(F.concat(F.lit(root if "://" in root else ""), "path").alias("path"))


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _walk(package: Package, base: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the records of a member, compressed one by one or plain."""
    at = base
    while at < base + size:
        left = base + size - at
        if package.read(at, min(2, left)) == b"\x1f\x8b":
            unpack, pos = zlib.decompressobj(31), at
            while not unpack.eof:
                part = package.read(pos, min(1 << 16, base + size - pos))
                if not part:
                    raise ValueError("a compressed record ends early")
                unpack.decompress(part)
                pos += len(part)
            n = pos - len(unpack.unused_data) - at
        else:
            head = b""
            while b"\r\n\r\n" not in head and len(head) < left:
                head += package.read(at + len(head), min(4096, left - len(head)))
            if not head.strip(b"\r\n"):
                return
            fields, _ = parse_record(head)
            n = head.index(b"\r\n\r\n") + 8 + int(fields["content-length"])
        yield at, n
        at += n


def _ranges(package: Package) -> Iterator[tuple[int, int]]:
    """(start, length) of all records of the package, by its indexes, or by a walk through archives that they don't name."""
    archives = [m for m in package.members if m.name.endswith((".warc", ".warc.gz"))]
    bases = [package.data_at(m) for m in archives]
    by_name = {m.name.rsplit("/", 1)[-1]: k for k, m in enumerate(archives)}
    found: list[set[tuple[int, int]]] = [set() for _ in archives]
    for index in (m for m in package.members if m.name.endswith(".cdxj")):
        for line in package.read(package.data_at(index), index.size).decode("utf-8").splitlines():
            entry = json.loads(line[line.index("{") :]) if "{" in line else {}
            k = by_name.get(entry.get("filename", "").rsplit("/", 1)[-1], 0 if len(archives) == 1 and "filename" not in entry else None)
            if k is not None and "offset" in entry and "length" in entry:
                found[k].add((int(entry["offset"]), int(entry["length"])))
    for member, base, ranges in zip(archives, bases, found, strict=True):
        yield from ((base + at, n) for at, n in sorted(ranges)) if ranges else _walk(package, base, member.size)


def _hex_digest(said: str | None) -> str | None:
    """A record's SHA-1 in lower-case hexadecimal digits; archives often write it in base 32. None for others."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1" or len(value) not in (32, 40):
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


_RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_record string"


def read_record(raw: bytes) -> tuple:
    """The columns of read_archives of one record. ValueError if a payload doesn't match its digest."""
    number = lambda x: int(x) if x else None
    fields, block = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
    kind, payload, size, digest = fields.get("warc-type"), None, number(fields.get("x-payload-length")), _hex_digest(fields.get("warc-payload-digest"))
    http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    if kind != "revisit":
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        own = hashlib.sha1(payload).hexdigest()
        coded = http and b"transfer-encoding:" in block.partition(b"\r\n\r\n")[0].lower()  # the digest may be of what was coded
        if not coded and ((digest or own) != own or (size is not None and size != len(payload))):
            raise ValueError("the payload doesn't match its digest")
        size, digest = len(payload), own
    elif size is None and http:
        lengths = [x.partition(b":")[2].strip() for x in block.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        size = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    return (
        number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, payload, size, digest, number(fields.get("x-refers-to-page")),
        fields.get("warc-record-id"), fields.get("warc-refers-to"),
    )


def read_archives(paths: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, record_id, refers_to_record) of
    each record of the packages (path), of whatever type.

    One step reads directories and indexes and cuts the records' ranges into slices; the next, dealt
    out anew, reads the slices. payload is the body of an HTTP message, else the whole block; null for a
    revisit. payload_bytes and the digest are those of the full payload: taken from the payload where there
    is one, else from the record's fields (null where they don't say). page_id and refers_to are only in
    records that are written here; other archives have record ids. A member that is not stored is an error.
    """

    def slices(batch: pa.RecordBatch):
        for path in batch.column("path").to_pylist():
            with _open(path) as source:
                starts, lengths, held = [], [], 0
                for at, n in _ranges(Package(source)):
                    starts.append(at), lengths.append(n)
                    held += n
                    if held >= slice_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([starts]), pa.array([lengths])], names=["path", "starts", "lengths"])
                        starts, lengths, held = [], [], 0
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([starts]), pa.array([lengths])], names=["path", "starts", "lengths"])

    def records(batch: pa.RecordBatch):
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for row in batch.to_pylist():
            out, held = [], 0
            with _open(row["path"]) as source:
                for at, n in zip(row["starts"], row["lengths"], strict=True):
                    source.seek(at)
                    try:
                        out.append(read_record(source.read(n)))
                    except ValueError as e:
                        raise ValueError(f"{row['path']} at {at}: {e}") from e
                    held += len(out[-1][3] or b"")
                    if held >= HELD_BYTES:
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    schema = to_arrow_schema(T._parse_datatype_string(_RECORD))
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = in_arrow(paths.repartition(n), "path string, starts array<long>, lengths array<long>", slices)
    return in_arrow(settled(cut).repartition(n), _RECORD, records)
