"""WARC records in ZIP archives, read by ranges.

An archive holds a member of WARC records, each packed by itself, a member with their places, and one that describes the package; all are stored, so
that a record is a range of the archive's bytes. A reader asks for the archive's end, finds the central directory there (32-bit or ZIP64), and
in it the members: their data begin after each member's local header. The index member, or where there is none a walk over the records, gives ranges, which
are dealt to tasks by archive and place and read without unpacking anything else.

Archives are files of a bounded size in the shared folder. A task that fails leaves a file that no row names; the rows that name archives are written by Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import few_rows, saved, text_slices

# Fixed values of the ZIP format: marks of its records, and what stands for a number that the ZIP64 field has.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16, ZIP64 = 0xFFFFFFFF, 0xFFFF, 0x0001
STORED, UTF8, ENCRYPTED, DESCRIBED = 0, 0x800, 0x1, 0x8

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
Read = Callable[[int, int], bytes]  # (start, size) -> bytes


class BadArchive(ValueError):
    """What is no readable archive, member or record."""


@dataclass
class Member:
    name: str
    method: int
    flags: int
    size: int  # of the stored bytes
    header_at: int

    @property
    def readable(self) -> bool:
        return self.method == STORED and not self.flags & ENCRYPTED


# ---------------------------------------------------------------- reading archives


def directory(read: Read, size: int) -> list[Member]:
    """The members of an archive of ``size`` bytes, from its end; bytes before the archive are allowed, other disks aren't."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise BadArchive("no end of a central directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at += 3
    disk, first_disk, _, count, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    end = tail_at + at  # where the central directory ends
    if end >= 20 and (locator := read(end - 20, 20))[:4] == LOCATOR:
        place = struct.unpack_from("<Q", locator, 8)[0]
        # With bytes before the archive the record stands before its locator.
        for end64 in (place, end - 76):
            if 0 <= end64 <= end - 76 and (record := read(end64, 56))[:4] == END64:
                disk, first_disk, _, count, length, start = struct.unpack_from("<IIQQQQ", record, 16)
                end = end64
                break
        else:
            raise BadArchive("no ZIP64 end of a central directory")
    elif FULL32 in (length, start) or count == FULL16:
        raise BadArchive("no ZIP64 locator")
    if disk or first_disk:
        raise BadArchive("an archive of several disks")
    before = end - length - start
    if before < 0:
        raise BadArchive("the central directory lies outside")
    entries = read(start + before, length)
    out, p = [], 0
    for _ in range(count):
        if entries[p : p + 4] != CENTRAL or p + 46 > len(entries):
            raise BadArchive("a broken central directory")
        flags, method = struct.unpack_from("<HH", entries, p + 8)
        packed, unpacked, n, extra_n, comment_n, disk = struct.unpack_from("<IIHHHH", entries, p + 20)
        header = struct.unpack_from("<I", entries, p + 42)[0]
        name = entries[p + 46 : p + 46 + n].decode("utf-8" if flags & UTF8 else "cp437")
        extra = entries[p + 46 + n : p + 46 + n + extra_n]
        while len(extra) >= 4:
            kind, m = struct.unpack_from("<HH", extra)
            if kind == ZIP64:
                # Only the numbers that didn't fit, in this order.
                wide = iter(struct.unpack_from(f"<{min(m, len(extra) - 4) // 8}Q", extra, 4))
                unpacked = next(wide, unpacked) if unpacked == FULL32 else unpacked
                packed = next(wide, packed) if packed == FULL32 else packed
                header = next(wide, header) if header == FULL32 else header
            extra = extra[4 + m :]
        out.append(Member(name, method, flags, packed, header + before))
        p += 46 + n + extra_n + comment_n
    return out


def data_at(read: Read, m: Member) -> int:
    """Where a member's bytes begin: the local header may be longer than the directory says."""
    head = read(m.header_at, 30)
    if head[:4] != LOCAL or len(head) < 30:
        raise BadArchive(f"no local header of {m.name}")
    n, extra = struct.unpack_from("<HH", head, 26)
    return m.header_at + 30 + n + extra


def lines(read: Read, start: int, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a range, read piece by piece."""
    rest = b""
    for at in range(start, start + size, step):
        *full, rest = (rest + read(at, min(step, start + size - at))).split(b"\n")
        yield from full
    if rest:
        yield rest


def walk(read: Read, start: int, size: int, packed: bool, step: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(place, length) of each record of a member without an index, read piece by piece."""
    at, end = start, start + size
    while at < end:
        if packed:
            d, p = zlib.decompressobj(31), at
            while not d.eof:
                piece = read(p, min(step, end - p))
                if not piece:
                    raise BadArchive("a record is cut off")
                d.decompress(piece)
                p += len(piece)
            length = p - len(d.unused_data) - at
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                piece = read(at + len(head), min(4096, end - at - len(head)))
                if not piece:
                    raise BadArchive("a record is cut off")
                head += piece
            found = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", head[: head.index(b"\r\n\r\n") + 2])
            if not found:
                raise BadArchive("a record without a length")
            length = head.index(b"\r\n\r\n") + 8 + int(found[1])
        if at + length > end:
            raise BadArchive("a record is cut off")
        yield at, length
        at += length


def places(read: Read, size: int) -> Iterator[tuple[str, int, int]]:
    """(member, place, length) of every record of an archive: from its index members, and by a walk over members that none names."""
    members = directory(read, size)
    warcs = {m.name: m for m in members if re.search(r"\.warc(\.gz)?\Z", m.name)}
    for m in warcs.values():
        if not m.readable:
            raise BadArchive(f"{m.name} isn't stored as it is")
    starts = {name: data_at(read, m) for name, m in warcs.items()}
    named = set()
    for m in members:
        if not re.search(r"\.cdxj?\Z", m.name) or not m.readable:
            continue
        for line in lines(read, data_at(read, m), m.size):
            brace = line.find(b"{")
            if brace < 0:
                continue
            r = json.loads(line[brace:])
            name = r.get("filename", "")
            name = name if name in warcs else f"archive/{name}"
            offset, length = int(r["offset"]), int(r["length"])
            if name not in warcs or offset < 0 or length < 0 or offset + length > warcs[name].size:
                raise BadArchive("the index names what isn't there")
            named.add(name)
            yield name, starts[name] + offset, length
    for name, m in warcs.items():
        if name not in named:
            for at, length in walk(read, starts[name], m.size, name.endswith(".gz")):
                yield name, at, length


# ---------------------------------------------------------------- records


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def record(data: bytes, packed: bool) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's fields, the fields of the HTTP head within its block, and the payload."""
    if packed:
        d = zlib.decompressobj(31)
        data = d.decompress(data)
        if not d.eof or d.unused_data:
            raise BadArchive("a record's range isn't one packed record")
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise BadArchive("no WARC record")
    fields = _fields(head)
    n = fields.get("content-length", "")
    if not n.isdigit() or int(n) > len(rest):
        raise BadArchive("a record is cut off")
    block, http = rest[: int(n)], {}
    if "application/http" in fields.get("content-type", ""):
        http_head, _, block = block.partition(b"\r\n\r\n")
        http = _fields(http_head)
    return fields, http, block


def text_of(n: str | int | None) -> str:
    return f"<urn:page:{n}>" if n is not None else f"<urn:uuid:{uuid.uuid4()}>"


def warc_record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit of the record ``refers_to``: the HTTP head alone, whose length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {text_of(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {text_of(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


# ---------------------------------------------------------------- writing archives


class Archive:
    """A ZIP archive that is written from front to end: one streamed member of records, then the index and the description. Directory and end are in ZIP64 form."""

    def __init__(self, out, level: int = 4):
        self.out, self.level, self.at, self.crc, self.index, self.n = out, level, 0, 0, [], 0
        self.entries: list[bytes] = []
        # Sizes follow the data, in 64 bits as the field says.
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45, DESCRIBED | UTF8, STORED, 0, 0x21, 0, FULL32, FULL32, len(DATA), 20) + DATA.encode() + struct.pack("<HHQQ", ZIP64, 16, 0, 0))
        self.data = self.at

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: str | None, url: str | None, raw: bytes, digest: str) -> None:
        c = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = c.compress(raw) + c.flush()
        self.index.append(f"{re.sub(r'[^!-z|~]', '_', url or '-')} {self.n:09d} " + json.dumps({"id": key, "digest": f"sha256:{digest}", "filename": DATA, "offset": self.at - self.data, "length": len(packed)}))
        self.crc, self.n = zlib.crc32(packed, self.crc), self.n + 1
        self._write(packed)

    def _entry(self, name: str, flags: int, crc: int, size: int, header_at: int) -> None:
        extra = struct.pack("<HHQQQ", ZIP64, 24, size, size, header_at)
        self.entries.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, flags, STORED, 0, 0x21, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name.encode() + extra)

    def close(self) -> int:
        """The archive's size."""
        size = self.at - self.data
        self._write(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, size, size))
        self._entry(DATA, DESCRIBED | UTF8, self.crc, size, 0)
        self.index.sort()
        listing = ("\n".join(self.index) + "\n").encode()
        about = json.dumps({"profile": "data-package", "resources": [{"name": "data", "path": DATA, "bytes": size}, {"name": "index", "path": INDEX, "bytes": len(listing), "hash": "sha256:" + hashlib.sha256(listing).hexdigest()}]}).encode()
        for name, data in ((INDEX, listing), (PACKAGE, about)):
            self._entry(name, UTF8, zlib.crc32(data), len(data), self.at)
            self._write(LOCAL + struct.pack("<HHHHHIIIHH", 20, UTF8, STORED, 0, 0x21, zlib.crc32(data), len(data), len(data), len(name), 0) + name.encode() + data)
        start, n = self.at, len(self.entries)
        for e in self.entries:
            self._write(e)
        length, end64 = self.at - start, self.at
        self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
        self._write(LOCATOR + struct.pack("<IQI", 0, end64, 1))
        self._write(END + struct.pack("<HHHHIIH", 0, 0, n, n, FULL32, FULL32, 0))
        self.out.close()
        return self.at


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """(id, url, html, digest, refers_to): of rows with equal payloads of at least ``least`` bytes all but those with the smallest id refer to that id.

    Null html is empty; null ids refer to nothing, and nothing refers to them; rows that repeat the smallest id refer to nothing either. The digests of the hundred
    largest groups of copies are joined by a broadcast, so that of the others none has over a hundredth of the rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = rows.filter((F.octet_length("html") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = saved(firsts)
    hot = saved(firsts.orderBy(F.desc("n"), "digest").limit(100))
    rest = firsts.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("digest", F.col("first").alias("other"))
    if firsts.isEmpty():
        found = rows.withColumn("to", F.lit(None).cast(dict(rows.dtypes)["id"]))
    else:
        found = rows.join(F.broadcast(hot.select("digest", "first")), "digest", "left")
        found = found.withColumn("to", F.col("first")) if rest.isEmpty() else found.join(rest, "digest", "left").withColumn("to", F.coalesce("first", "other"))
    return found.select("id", "url", "html", "digest", F.when(F.col("to") < F.col("id"), F.col("to")).alias("refers_to"))


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(rows: DataFrame, max_bytes: int = 256 << 20, max_records: int = 1 << 17, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write rows of :func:`records` to archives; (path, size, records) of each, as a table.

    Each task writes its own archives, record by record, and begins another one at ``max_bytes`` or ``max_records``. ``folder`` is one that driver and executors share (by default below
    ``spark.checkpoint.dir``, and deleted with the application). Repeated rows give repeated records. An empty table gives no archives.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, archive, path = [], None, ""
        where, base = _opened(folder)
        where.create_dir(base, recursive=True)
        for batch, html in text_slices(batches, "html", 4 << 20):
            keys, urls, digests, refers = (batch.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to"))
            for key, url, text, digest, to in zip(keys, urls, html.to_pylist(), digests, refers, strict=True):
                if archive is None:
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    archive = Archive(where.open_output_stream(path))
                archive.add(None if key is None else str(key), url, warc_record(None if key is None else str(key), url, text.encode(), digest, None if to is None else str(to), date), digest)
                if archive.at >= max_bytes or archive.n >= max_records:
                    made.append((path, archive.close(), archive.n))
                    archive = None
        if archive is not None:
            made.append((path, archive.close(), archive.n))
        for path, size, n in made:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([size]), pa.array([n])], names=["path", "size", "records"])

    with few_rows(spark, 1000, "4m"):
        return saved(rows.select("id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, size long, records long"))


def _reader(path: str) -> tuple[Read, Callable[[], None]]:
    where, name = fs.FileSystem.from_uri(path)
    f = where.open_input_file(name)

    def read(start: int, size: int) -> bytes:
        f.seek(start)
        return f.read(size)

    return read, f.close


def locate(archives: DataFrame) -> DataFrame:
    """(path, member, place, length, error) of every record of the archives (path, size): end, directory and index members are read, nothing else. An archive that can't be read gives one row with its ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(path: str, rows: list[tuple], error: str | None = None) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)), pa.array([error] * len(rows), pa.string())], names=["path", "member", "place", "length", "error"])

        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                held: list[tuple] = []
                read, close = _reader(path)
                try:
                    for row in places(read, size):
                        held.append(row)
                        if len(held) >= 10_000:
                            yield out(path, held)
                            held = []
                    yield out(path, held)
                except (BadArchive, struct.error, zlib.error, ValueError, KeyError) as e:
                    yield out(path, held)
                    yield out(path, [(None, None, None)], str(e) or type(e).__name__)
                finally:
                    close()

    return archives.select("path", "size").mapInArrow(run, "path string, member string, place long, length long, error string")


def read_records(archives: DataFrame, bytes_per_task: int = 32 << 20, gap: int = 1 << 16, most: int = 4 << 20) -> DataFrame:
    """The records of archives (path, size): path, place, record_type, record_id, target_uri, refers_to, payload_digest (as the record has it), http_length, payload and error.

    Ranges are sorted by archive and place and dealt so that a large archive has several tasks; neighbouring ones are read at once, up to ``most`` bytes. A revisit has
    no payload. A record that can't be read has its ``error``, as has an archive.
    """
    spark = archives.sparkSession
    with few_rows(spark, 1000, "4m"):
        found = saved(locate(archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")))
    total = archives.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_per_task))
    dealt = found.filter("error is null").repartitionByRange(tasks, "path", "place").sortWithinPartitions("path", "place")
    names = ["path", "place", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "http_length", "payload", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, read, close = None, None, None

        def parsed(path: str, member: str, place: int, data: bytes) -> tuple:
            try:
                fields, http, payload = record(data, member.endswith(".gz"))
            except (BadArchive, zlib.error) as e:
                return (path, place, *[None] * 7, str(e))
            kind, n = fields.get("warc-type"), http.get("content-length", "")
            return (path, place, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), int(n) if n.isdigit() else None, None if kind == "revisit" else payload, None)

        def ranges() -> Iterator[list[tuple]]:
            near: list[tuple] = []
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("path", "member", "place", "length")), strict=True):
                    if near and (r[0] != near[0][0] or r[2] - (near[-1][2] + near[-1][3]) > gap or r[2] + r[3] - near[0][2] > most):
                        yield near
                        near = []
                    near.append(r)
            if near:
                yield near

        try:
            for near in ranges():
                path, start = near[0][0], near[0][2]
                if path != current:
                    if close:
                        close()
                    read, close = _reader(path)
                    current = path
                data = read(start, max(p + n for _, _, p, n in near) - start)
                held, size = [], 0
                for _, member, place, n in near:
                    held.append(parsed(path, member, place, data[place - start : place - start + n]))
                    size += len(held[-1][8] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        finally:
            if close:
                close()

    good = dealt.select("path", "member", "place", "length").mapInArrow(run, "path string, place long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary, error string")
    bad = found.filter("error is not null")
    return good.unionByName(bad.select("path", "error"), allowMissingColumns=True)


def pages(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that were read. A response's digest is that of the payload as it was read, and an error if
    the record names another one; a revisit's are those that its head has.
    """
    key = lambda c: F.regexp_extract(c, r"\A<urn:page:(-?[0-9]+)>\z", 1).try_cast("bigint")
    named = F.regexp_extract("payload_digest", r"\Asha256:([0-9a-f]{64})\z", 1)
    digest = F.when(F.col("payload").isNull(), named).otherwise(F.sha2("payload", 256))
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("record of "), "path", F.lit(": "), "error"))).when(digest != named, F.raise_error(F.concat(F.lit("digest of "), "record_id"))).otherwise(digest)
    size = F.when(F.col("payload").isNull(), F.col("http_length")).otherwise(F.octet_length("payload").cast("long"))
    return read.select(key("record_id").alias("page_id"), size.alias("payload_bytes"), sound.alias("payload_digest"), "record_type", key("refers_to").alias("refers_to"))


#: The contract's result from the table alone.
SQL = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM q"""
