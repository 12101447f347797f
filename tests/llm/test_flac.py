import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import flac
from rollcall.llm.queries import op1_flac_media

rng = np.random.default_rng(3)
PAYLOADS = [
    bytes(64), b"a" * 64, bytes(range(256)) * 8, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"hello world " * 500, bytes(63) + b"\xff" + bytes(4000),
    (np.sin(np.arange(9999) / 20) * 100 + 128).astype(np.uint8).tobytes(), b"abc", b"ab" * 2048 + b"q" * 300, bytes(4096),
]


def samples(s):
    return (np.concatenate([b for _, b in s.blocks])[:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def test_round_trip():
    media = flac.encode_many(PAYLOADS)
    for p, s in zip(PAYLOADS, flac.decode_many(media), strict=True):
        assert s.error is None and samples(s) == p
        assert [o for o, _ in s.blocks] == [*range(0, len(p), 2048)]
        assert s.md5 == hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()


def test_without_seek_table():
    for m, p in zip(flac.encode_many(PAYLOADS), PAYLOADS, strict=True):
        n = int.from_bytes(m[43:46], "big")
        bare = m[:4] + b"\x80" + m[5:42] + m[46 + n :]
        (s,) = flac.decode_many([bare])
        assert s.error is None and samples(s) == p and not s.seek


def test_unknown_total():
    """A stream whose header names no number of samples is read to its end, with and without a seek table."""
    for m, p in zip(flac.encode_many(PAYLOADS), PAYLOADS, strict=True):
        x = int.from_bytes(m[18:26], "big")
        open_ = m[:18] + (x >> 36 << 36).to_bytes(8, "big") + m[26:]
        n = int.from_bytes(m[43:46], "big")
        bare = open_[:4] + b"\x80" + open_[5:42] + open_[46 + n :]
        for data in (open_, bare, bare[:26] + bytes(16) + bare[42:]):
            (s,) = flac.decode_many([data])
            assert s.error is None and s.total == 0 and samples(s) == p
        assert flac.decode_many([bare[:-3]])[0].error


def test_long_text_in_bounded_memory():
    """Beyond the stream itself, memory is a few times the text's bytes."""
    import tracemalloc

    text = b"".join(b"line %d of a long text\n" % i for i in range(300_000))
    tracemalloc.start()
    (media,) = flac.encode_many([flac.payload(text)])
    (s,) = flac.decode_many([media])
    assert s.error is None and samples(s) == flac.payload(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(len(text), peak)
    assert peak < 12 * len(text) + (400 << 20)


def test_feature():
    x = rng.integers(-128, 128, 5000).astype(np.int8)
    f = x.astype(float)
    turns = (np.signbit(f[1:]) != np.signbit(f[:-1])).sum()
    assert flac.feature(x) == f"rms={np.sqrt(np.mean(f * f)):.4f};zcr={turns / 4999:.6f};peak=128;std={f.std():.4f}"


def test_damage_is_told():
    (m,) = flac.encode_many([b"hello world " * 500])
    for at in (len(m) - 1, len(m) - 400, len(m) // 2, 100, 2):
        bad = bytearray(m)
        bad[at] ^= 0x10
        assert flac.decode_many([bytes(bad)])[0].error
    assert flac.decode_many([m[:-30], m, b""])[1].error is None
    assert flac.decode_many([m[:-30]])[0].error and flac.decode_many([b""])[0].error


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, x, k):
        u = -2 * x - 1 if x < 0 else 2 * x
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return int(b, 2).to_bytes(len(b) // 8, "big")


def crc16(data):
    c = 0
    for x in data:
        c ^= x << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def stream(channels, bps, size, assignment, write):
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bps - 1) << 36 | size).to_bytes(8, "big") + bytes(16)
    head = bytes([0xFF, 0xF8, 0x60, assignment << 4, 0, size - 1])
    w = Writer()
    write(w)
    frame = head + bytes([flac.crc8(head)]) + w.bytes()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + crc16(frame).to_bytes(2, "big")


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_stereo_16_bits(assignment):
    left = rng.integers(-30000, 30000, 32)
    right = left + rng.integers(-500, 500, 32)
    side, mid = left - right, (left + right) >> 1
    a, b = {1: (left, right), 8: (left, side), 9: (side, right), 10: (mid, side)}[assignment]

    def write(w):
        for c, x in enumerate((a, b)):
            bps = 16 + (assignment == 9 and c == 0 or assignment in (8, 10) and c == 1)
            w.put(8 + 1 << 1, 8)  # fixed predictor of order 1
            w.put(int(x[0]), bps)
            w.put(1, 2)  # parameters of 5 bits
            w.put(1, 4)  # two partitions: Rice and escape
            d = np.diff(x)
            w.put(3, 5)
            for v in d[:15].tolist():
                w.rice(v, 3)  # long runs of zeros
            w.put(31, 5)
            w.put(18, 5)
            for v in d[15:].tolist():
                w.put(v, 18)

    (s,) = flac.decode_many([stream(2, 16, 32, assignment, write)])
    assert s.error is None
    assert s.blocks[0][1].tolist() == np.stack([left, right], 1).tolist()
    assert np.frombuffer(flac.pcm_bytes(s), "<i2").tolist() == np.stack([left, right], 1).ravel().tolist()


def test_wasted_bits_and_lpc():
    x = rng.integers(-20, 20, 48)
    coefs, shift = [3, -2, 1], 1

    def write(w):
        w.put((32 + 2) << 1 | 1, 8)
        w.bits += "001"  # three wasted bits
        for v in x[:3].tolist():
            w.put(v, 13)
        w.put(4, 4)
        w.put(shift, 5)
        for c in coefs:
            w.put(c, 5)
        w.put(0, 2)
        w.put(0, 4)
        w.put(4, 4)
        for i in range(3, 48):
            w.rice(int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(coefs)) >> shift), 4)

    (s,) = flac.decode_many([stream(1, 16, 48, 0, write)])
    assert s.error is None and s.blocks[0][1][:, 0].tolist() == (x << 3).tolist()


def test_rows(spark):
    rows = [(1, "héllo", b"x"), (2, None, None), (2, "", b"y"), (3, "wort " * 3000, b""), (3, "wort " * 3000, b""), (None, "a" * 64, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    got = flac.media_digest(flac.to_flac(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.error is None
        t = next((x[1] or "").encode() for x in rows if x[0] == r.doc_id and len((x[1] or "").encode()) == r.n_bytes)
        p = flac.payload(t)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1
    named = df.withColumns({"id": F.lit(1), "n_bytes": F.lit("x"), "error": F.lit("y")})
    assert flac.media_digest(flac.to_flac(named)).count() == len(rows)
    assert flac.to_flac(df.limit(0)).count() == 0 and flac.media_digest(flac.to_flac(df.limit(0))).count() == 0


def test_pcm_blocks(spark):
    df = spark.createDataFrame([(1, bytearray(flac.encode_many([b"hello world " * 500])[0])), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    got = flac.pcm_blocks(df).orderBy("doc_id", "block").collect()
    assert [(r.doc_id, r.block, r.sample_offset, r.n_samples) for r in got] == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 1904), (2, None, None, None), (3, None, None, None)]
    data = b"".join(bytes(r.pcm) for r in got[:3])
    assert (np.frombuffer(data, np.uint8) ^ 0x80).tobytes() == b"hello world " * 500
    assert got[3].error and got[4].error


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in op1_flac_media(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        p, r = flac.payload((d.text or "").encode()), got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
