import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from rollcall.llm import warczip as W

SCHEMA = "page_id long, url string, html string, digest string, path string, payload string"


def want_of(rows):
    """By a plain pass over the rows."""
    out, first = [], {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, h in rows:
        b = (h or "").encode()
        to = first.get(b) if len(b) >= 100 and i is not None and first[b] < i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, f"http://x/{i} ä\n" if i else None, h, "a", "b", "c") for i, h in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in W.pages(W.read_records(W.write_archives(W.records(df), **options))).collect()), key=repr)


def test_round_trip_with_odd_rows(spark):
    """Null and empty pages, copies below and above 100 bytes, a group of a third of all, repeated rows, null and negative ids, a long page, headers within a page."""
    long = "абв<p>" * 400_000
    rows = [(i, f"page {i} " * 30) for i in range(40)] + [(100 + i, "copy " * 40) for i in range(40)] + [(200 + i, "short") for i in range(3)]
    rows += [(300, None), (301, ""), (302, long), (303, long), (304, "a" * 99), (305, "a" * 99), (306, "a" * 100), (307, "a" * 100), (308, "ї" * 50), (309, "ї" * 50), (310, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9)]
    rows += [(None, "copy " * 40), (None, "x"), (-5, "copy " * 40), (100, "copy " * 40), (-5, "copy " * 40)]
    assert run(spark, rows) == want_of(rows)
    assert run(spark, rows, max_records=7) == want_of(rows) == run(spark, rows, max_bytes=2000)


def test_no_rows(spark):
    assert run(spark, []) == []


def in_memory(data):
    return (lambda start, size: data[start : start + size]), len(data)


def archive(n=5):
    """An archive of ours, and its records."""
    class Kept(io.BytesIO):
        def close(self):
            pass

    out, raw = Kept(), []
    a = W.Archive(out)
    for i in range(n):
        raw.append(W.warc_record(str(i), f"http://y/{i}", f"page {i}".encode(), "0" * 64, None, "2020-01-01T00:00:00Z"))
        a.add(str(i), f"http://y/{i}", raw[-1], "0" * 64)
    assert a.close() == len(out.getvalue())
    return out.getvalue(), raw


def test_our_archives_are_zip_archives():
    data, raw = archive()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [W.DATA, W.INDEX, W.PACKAGE]
        packed = z.read(W.DATA)
    d = zlib.decompressobj(31)
    assert d.decompress(packed) == raw[0]


@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 9])
def test_ranges_give_records(before):
    data, raw = archive()
    read, size = in_memory(before + data)
    got = [(n, W.record(read(at, length), True)) for n, at, length in W.places(read, size)]
    assert [b for _, (_, _, b) in got] == [f"page {i}".encode() for i in range(5)] and {n for n, _ in got} == {W.DATA}
    assert got[2][1][0]["warc-record-id"] == "<urn:page:2>" and got[2][1][1]["content-length"] == "6"


def made(members, comment=b"", zip64=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in members:
            with z.open(zipfile.ZipInfo(name) if method == 0 else name, "w", force_zip64=zip64) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"hello PK\x05\x06 there", b"c" * 65535])
@pytest.mark.parametrize("zip64", [False, True])
def test_archives_of_others_without_an_index(comment, zip64):
    """Members of packed and plain records, in 32-bit and ZIP64 form, with comments that look like an end."""
    raw = [W.warc_record(str(i), None, b"p" * i * 1000, "0" * 64, None if i != 2 else "1", "2020-01-01T00:00:00Z") for i in range(4)]
    gz = b"".join(zlib.compressobj(6, zlib.DEFLATED, 31).compress(r) + b"" for r in [])
    for r in raw:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        gz += c.compress(r) + c.flush()
    data = made([("a/b.warc", b"".join(raw), 0), ("readme.txt", b"x", 0), ("c.warc.gz", gz, 0)], comment, zip64)
    read, size = in_memory(data)
    got = [(n, *W.record(read(at, length), n.endswith(".gz"))) for n, at, length in W.places(read, size)]
    assert [n for n, *_ in got] == ["a/b.warc"] * 4 + ["c.warc.gz"] * 4
    assert [len(b) for *_, b in got] == [0, 1000, 0, 3000] * 2 and got[2][1]["warc-refers-to"] == "<urn:page:1>"


def test_broken_archives_say_so():
    data, _ = archive()
    bad = {"nothing": b"", "text": b"hello" * 100, "cut": data[:-5], "directory": data.replace(W.CENTRAL, b"PKxx"), "header": data.replace(W.LOCAL, b"PKyy"), "locator": data.replace(W.END64, b"PKzz")}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.warc.gz", b"x" * 100)
    bad["packed member"] = out.getvalue()
    bad["cut records"] = made([("a.warc", b"WARC/1.0\r\nContent-Length: 50\r\n\r\nabc", 0)])
    for name, x in bad.items():
        with pytest.raises((W.BadArchive, struct.error)):
            list(W.places(*in_memory(x)))
        assert name


def test_an_unreadable_archive_is_a_row(spark, tmp_path):
    data, _ = archive()
    (tmp_path / "a.wacz").write_bytes(data)
    (tmp_path / "b.wacz").write_bytes(b"no archive")
    broken = bytearray(data)
    broken[90:94] = b"\0\0\0\0"  # within the first packed record
    (tmp_path / "c.wacz").write_bytes(broken)
    files = spark.createDataFrame([(f"file://{p}", p.stat().st_size) for p in sorted(tmp_path.iterdir())], "path string, size long")
    rows = W.read_records(files).collect()
    by = lambda n: [r for r in rows if r.path.endswith(n)]
    assert [r.error for r in by("a.wacz")] == [None] * 5 and len(by("b.wacz")) == 1 and by("b.wacz")[0].error
    assert sum(r.error is not None for r in by("c.wacz")) == 1 and len(by("c.wacz")) == 5


def test_a_large_directory_is_zip64():
    """More members than 16 bits count."""
    data = made([(f"m{i}", b"", 0) for i in range(66_000)] + [("z.warc", W.warc_record("1", None, b"abc", "0" * 64, None, "d"), 0)])
    read, size = in_memory(data)
    assert len(W.directory(read, size)) == 66_001 and [W.record(read(at, n), False)[2] for _, at, n in W.places(read, size)] == [b"abc"]


def test_members_beyond_four_gigabytes():
    """Sizes and places that need 64 bits, of a file that is mostly empty."""
    raw = W.warc_record("1", None, b"abc", "0" * 64, None, "d")
    far = 5 << 30
    name, extra = b"z.warc", struct.pack("<HHQQ", W.ZIP64, 16, len(raw), len(raw))
    local = W.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0x21, zlib.crc32(raw), W.FULL32, W.FULL32, len(name), len(extra)) + name + extra + raw
    wide = struct.pack("<HHQ", W.ZIP64, 8, far)
    entry = W.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0x21, zlib.crc32(raw), len(raw), len(raw), len(name), len(wide), 0, 0, 0, 0, W.FULL32) + name + wide
    start = far + len(local)
    end = W.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start) + W.LOCATOR + struct.pack("<IQI", 0, start + len(entry), 1) + W.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), W.FULL32, 0)
    pieces = {far: local, start: entry, start + len(entry): end}
    size, asked = start + len(entry) + len(end), []

    def read(at, n):
        asked.append(n)
        out = bytearray(max(0, min(n, size - at)))
        for p, data in pieces.items():
            for i in range(max(at, p), min(at + len(out), p + len(data))):
                out[i - at] = data[i - p]
        return bytes(out)

    assert [W.record(read(at, n), False)[2] for _, at, n in W.places(read, size)] == [b"abc"]
    assert max(asked) < 1 << 17
