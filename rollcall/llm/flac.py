"""FLAC media columns: store bytes as 8-bit mono FLAC, read them back as seekable PCM blocks.

The decoder reads any 8- to 24-bit FLAC stream of one or two channels: constant, verbatim, fixed and LPC subframes, both Rice
methods with escapes, wasted bits and stereo decorrelation. Frame headers are checked against their CRC-8, whole frames against
their CRC-16 and the stream against its MD5; a stream that fails is told by ``error``, not by an exception.

Codewords can't be found before those in front of them are read, so work goes across frames instead of along
them: step ``i`` decodes sample ``i`` of all frames of a batch at once. Streams with a seek table start all their frames
together; others offer one frame at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
PRECISION = 12
RUN = 1024  # frames that are written or read at once: so many hold about 2 million samples


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """CRC of every value of ``bits`` bits, most significant bit first."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    x = np.arange(1 << bits, dtype=np.uint32) << max(0, width - bits)
    for _ in range(bits):
        x = np.where(x & top, (x << 1) ^ poly, x << 1) & mask
    return x


CRC8 = _crc_table(0x07, 8, 8).tolist()
CRC16 = _crc_table(0x8005, 16, 16)


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = CRC8[c ^ x]
    return c


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for every frame, two bytes a step across all frames."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    s, n = starts[order], n[order]
    crc = np.zeros(len(s), np.uint32)
    odd = (n & 1).astype(bool)
    crc[odd] = CRC16[data[s[odd]].astype(np.uint32)]  # as if a zero byte came first
    s = s + odd
    pairs = n >> 1
    live = np.searchsorted(-pairs, -np.arange(int(pairs.max(initial=0))), side="left")
    for i, k in enumerate(live.tolist()):
        at = s[:k] + 2 * i
        crc[:k] = CRC16[crc[:k] ^ (data[at].astype(np.uint32) << 8 | data[at + 1])]
    out = np.empty(len(s), np.uint32)
    out[order] = crc
    return out


# ---------------------------------------------------------------- writing


def write_bits(total: int, start: np.ndarray, width: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bytes with each value's ``width`` (0 to 32) lowest bits at bit ``start``; fields don't overlap."""
    start, width, value = (np.asarray(x).astype(np.uint64) for x in (start, width, value))
    word = (start >> np.uint64(5)).astype(np.int64)
    wide = value << (np.uint64(64) - (start & np.uint64(31)) - width)
    n = (total + 31) // 32 + 2
    out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return out.astype(np.uint32).astype(">u4").view(np.uint8)[: (total + 7) // 8]


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (nearest sample first) and shifts of each row, by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(order + 1)])
    err = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((order, len(x)))
    for i in range(order):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.abs(a).max(0)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(most, 1e-9))), 0, 15).astype(np.int64)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * 2.0**shift), -limit, limit - 1).astype(np.int64), shift


def _utf8_number(n: int) -> bytes:
    """The frame number, coded as UTF-8 codes a character (to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size & 0xFF) | n, *reversed(tail)])


def _frames(x: np.ndarray, numbers: list[int], lpc_order: int) -> list[bytes]:
    """A frame without its CRC-16 for each row of 8-bit samples; all rows are equally long."""
    count, size = x.shape
    x = x.astype(np.int64)
    coefs, shift = _lpc(x, lpc_order)
    pred = np.zeros_like(x[:, lpc_order:])
    for j in range(lpc_order):
        pred += coefs[j][:, None] * x[:, lpc_order - 1 - j : size - 1 - j]
    choices = [(lpc_order, x[:, lpc_order:] - (pred >> shift[:, None]))]
    d = x
    for order in range(3):
        choices.append((order, d))
        d = np.diff(d, axis=1)
    order_of = np.array([o for o, _ in choices])
    best = np.argmin(np.stack([np.abs(r).mean(1) for _, r in choices]), 0)
    res = np.zeros_like(x)
    for c, (o, r) in enumerate(choices):
        res[best == c, o:] = r[best == c]
    order = order_of[best]
    u = np.where(res < 0, -2 * res - 1, 2 * res)
    warm = np.arange(size)[None, :] < order[:, None]
    u[warm] = 0
    po = 0
    while po < 3 and size % (2 << po) == 0 and size >> (po + 1) >= 64:
        po += 1
    part = size >> po
    mean = u.reshape(count, 1 << po, part).mean(2)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.72, 1))), 0, 14).astype(np.int64)
    ks = np.repeat(k, part, axis=1)
    width = (u >> ks) + 1 + ks
    width[warm] = 0
    head = 8 + order * 8 + np.where(best == 0, 4 + 5 + lpc_order * PRECISION, 0) + 6
    rice = head + (4 << po) + width.sum(1)
    flat = (x == x[:, :1]).all(1)
    raw = ~flat & (rice >= 8 + 8 * size)
    coded = ~flat & ~raw
    heads = []
    for n in numbers:
        code = 0xB0 if size == 2048 else 0x70 if size > 256 else 0x60
        h = bytes([0xFF, 0xF8, code | 4, 0x02]) + _utf8_number(n)
        if size != 2048:
            h += (size - 1).to_bytes(2 if size > 256 else 1, "big")
        heads.append(h + bytes([crc8(h)]))
    out: list[bytes] = [b""] * count
    for i in np.flatnonzero(flat).tolist():
        out[i] = heads[i] + bytes([0, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(raw).tolist():
        out[i] = heads[i] + bytes([2]) + x[i].astype(np.int8).tobytes()
    rows = np.flatnonzero(coded)
    if not len(rows):
        return out
    # All coded frames as one run of bits, each from a whole byte on.
    bits = rice[rows]
    nbytes = (bits + 7) // 8
    first = (np.cumsum(nbytes) - nbytes) * 8
    starts, widths, values = [], [], []

    def put(at, w, v):
        starts.append(at.ravel())
        widths.append(np.broadcast_to(np.asarray(w), at.shape).ravel())
        values.append(np.broadcast_to(np.asarray(v), at.shape).ravel())

    o, isl = order[rows], best[rows] == 0
    put(first, 8, np.where(isl, (0x20 | (lpc_order - 1)) << 1, (0x08 | o) << 1))
    at = first + 8
    for j in range(int(o.max(initial=0))):
        sel = o > j
        put(at[sel] + 8 * j, 8, x[rows[sel], j] & 0xFF)
    at = at + 8 * o
    put(at[isl], 4, PRECISION - 1)
    put(at[isl] + 4, 5, shift[rows[isl]])
    for j in range(lpc_order):
        put(at[isl] + 9 + PRECISION * j, PRECISION, coefs[j][rows[isl]] & ((1 << PRECISION) - 1))
    at = at + np.where(isl, 9 + PRECISION * lpc_order, 0)
    put(at, 2, 0)
    put(at + 2, 4, po)
    w = width[rows]
    w[:, ::part] += 4
    ends = at[:, None] + 6 + np.cumsum(w, axis=1)
    kr = ks[rows]
    put((ends - w)[:, ::part], 4, k[rows])
    live = ~warm[rows]
    ends, kr, ur = ends[live], kr[live], u[rows][live]
    put(ends - kr - 1, kr + 1, (1 << kr) | (ur & ((1 << kr) - 1)))
    data = write_bits(int(first[-1] + 8 * nbytes[-1]), np.concatenate(starts), np.concatenate(widths), np.concatenate(values)).tobytes()
    # A partition whose samples are all warm-up still names its parameter; parts hold 64 samples at least, so none is.
    for i, a, n in zip(rows.tolist(), (first // 8).tolist(), nbytes.tolist(), strict=True):
        out[i] = heads[i] + data[a : a + n]
    return out


def encode_many(payloads: list[bytes], block: int = 2048, lpc_order: int = 8, rate: int = 8000) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes become samples of 8 bits (byte minus 128). With a seek point for each frame."""
    by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    frames: list[list[bytes]] = []
    for p, data in enumerate(payloads):
        x = (np.frombuffer(data, np.uint8) ^ 0x80).view(np.int8)
        frames.append([b""] * (-(-len(x) // block)))
        for n in range(len(frames[-1])):
            b = x[n * block : (n + 1) * block]
            by_size.setdefault(len(b), []).append((p, n, b))
    for size, items in by_size.items():
        if size <= lpc_order:
            for p, n, b in items:
                h = bytes([0xFF, 0xF8, 0x64, 0x02]) + _utf8_number(n) + bytes([size - 1])
                frames[p][n] = h + bytes([crc8(h), 2]) + b.tobytes()
        else:
            for i in range(0, len(items), RUN):
                part = items[i : i + RUN]
                for (p, n, _), f in zip(part, _frames(np.stack([b for _, _, b in part]), [n for _, n, _ in part], lpc_order), strict=True):
                    frames[p][n] = f
    every = [f for fs in frames for f in fs]
    data = np.frombuffer(b"".join(every), np.uint8)
    ends = np.cumsum([len(f) for f in every]) if every else np.zeros(0, np.int64)
    crcs = iter(crc16_many(data, ends - np.array([len(f) for f in every], np.int64), ends).tolist()) if every else iter(())
    out = []
    for data, fs in zip(payloads, frames, strict=True):
        body = [f + next(crcs).to_bytes(2, "big") for f in fs]
        sizes = [len(f) for f in body] or [0]
        n = len(data)
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5((np.frombuffer(data, np.uint8) ^ 0x80).tobytes()).digest()
        seek, at = [], 0
        for i, f in enumerate(body):
            seek.append((i * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, n - i * block).to_bytes(2, "big"))
            at += len(f)
        table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(body))
    return out


# ---------------------------------------------------------------- reading


class Bits:
    """Reads fields of one frame's headers."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the stream ends early")
        x = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return x

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


@dataclass
class Sub:
    """A subframe that is being read."""

    frame: int
    bps: int
    start: int = 0  # bit of the first partition's parameter
    order: int = 0
    coefs: tuple[int, ...] = ()
    shift: int = 0
    warm: list[int] = field(default_factory=list)
    param: int = 4
    po: int = 0
    size: int = 0
    wasted: int = 0
    samples: np.ndarray | None = None


@dataclass
class Stream:
    data: bytes
    rate: int = 0
    channels: int = 1
    bps: int = 8
    total: int = 0
    block: int = 0
    md5: bytes = b""
    first: int = 0  # byte of the first frame
    seek: list[tuple[int, int]] = field(default_factory=list)
    blocks: list[tuple[int, np.ndarray]] = field(default_factory=list)  # sample offset, samples x channels
    error: str | None = None


def parse_stream(data: bytes) -> Stream:
    s = Stream(data)
    if data[:4] != b"fLaC":
        raise ValueError("no fLaC marker")
    at, last = 4, False
    while not last:
        head = data[at : at + 4]
        if len(head) < 4:
            raise ValueError("the metadata ends early")
        last, kind, n = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            s.block = int.from_bytes(body[2:4], "big")
            x = int.from_bytes(body[10:18], "big")
            s.rate, s.channels, s.bps, s.total = x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1
            s.md5 = body[18:34]
        elif kind == 3:
            points = (body[i : i + 18] for i in range(0, n - 17, 18))
            s.seek = [(int.from_bytes(p[:8], "big"), int.from_bytes(p[8:16], "big")) for p in points if p[:8] != b"\xff" * 8]
        at += 4 + n
    s.first = at
    return s


def _number(b: Bits) -> int:
    x = b.take(8)
    n = 0
    while x & 0x80 >> n:
        n += 1
    v = x & 0x7F >> n
    for _ in range(max(0, n - 1)):
        v = v << 6 | b.take(8) & 0x3F
    return v


def frame_head(s: Stream, at: int) -> tuple[int, int, int, int, int]:
    """Sample offset, block size, channel assignment, bits a sample, and the bit where subframes start."""
    b = Bits(s.data, at * 8)
    if b.take(14) != 0x3FFE:
        raise ValueError(f"no frame at byte {at}")
    b.take(1)
    variable, bs, sr, ch, ss = b.take(1), b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    number = _number(b)
    size = 192 if bs == 1 else 576 << (bs - 2) if 2 <= bs <= 5 else b.take(8) + 1 if bs == 6 else b.take(16) + 1 if bs == 7 else 256 << (bs - 8)
    if sr in (12, 13, 14):
        b.take(8 if sr == 12 else 16)
    if crc8(s.data[at : b.at >> 3]) != b.take(8):
        raise ValueError(f"CRC-8 of the frame at byte {at}")
    bps = {0: s.bps, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(ss, s.bps)
    return number if variable else number * s.block, size, ch, bps, b.at


def sub_head(data: bytes, at: int, bps: int, size: int, frame: int) -> tuple[Sub, int]:
    """The subframe at that bit; if its samples are known without residuals, and where it then ends, else 0."""
    b = Bits(data, at)
    b.take(1)
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
    bps -= wasted
    sub = Sub(frame, bps, size=size, wasted=wasted)
    if kind == 0:
        sub.samples = np.full(size, b.signed(bps), np.int64)
        return sub, b.at
    if kind == 1:
        if not b.at & 7 and bps == 8:
            a = b.at >> 3
            if a + size > len(data):
                raise ValueError("the stream ends early")
            sub.samples = np.frombuffer(data, np.int8, size, a).astype(np.int64)
            b.at += 8 * size
        else:
            sub.samples = np.array([b.signed(bps) for _ in range(size)], np.int64)
        return sub, b.at
    if 8 <= kind <= 12:
        sub.order = kind - 8
        sub.warm = [b.signed(bps) for _ in range(sub.order)]
        sub.coefs = FIXED[sub.order]
    elif kind >= 32:
        sub.order = kind - 31
        sub.warm = [b.signed(bps) for _ in range(sub.order)]
        precision = b.take(4) + 1
        sub.shift = b.signed(5)
        sub.coefs = tuple(b.signed(precision) for _ in range(sub.order))
    else:
        raise ValueError(f"subframe type {kind}")
    method = b.take(2)
    if method > 1:
        raise ValueError("residual method")
    sub.param, sub.po = 4 + method, b.take(4)
    sub.start = b.at
    return sub, 0


def decode_subs(words: np.ndarray, base: np.ndarray, subs: list[Sub], limit: np.ndarray) -> np.ndarray:
    """Fill the samples of subframes with residuals; returns each one's end bit. ``words``: all streams' bytes as big-endian
    32-bit words; ``base``: the bit where each subframe's stream starts; ``limit``: where it ends. A subframe
    that runs past its limit is left without samples.
    """
    n = len(subs)
    order = np.argsort([-s.size for s in subs], kind="stable")
    subs = [subs[i] for i in order]
    size = np.array([s.size for s in subs])
    warm = np.array([s.order for s in subs])
    depth = max(1, int(warm.max()))
    coefs = np.zeros((depth, n), np.int64)
    shift = np.array([s.shift for s in subs], np.int64)
    steps = int(size.max())
    out = np.zeros((steps + depth, n), np.int64)
    for i, s in enumerate(subs):
        coefs[depth - s.order :, i] = s.coefs[::-1]
        out[depth : depth + s.order, i] = s.warm
    pos = (np.array([s.start for s in subs]) + base[order]).astype(np.int64)
    stop = limit[order]
    param = np.array([s.param for s in subs])
    part = size >> np.array([s.po for s in subs])
    left = part - warm
    k = np.zeros(n, np.int64)
    escape = np.zeros(n, bool)
    fresh = np.ones(n, bool)
    live_at = np.searchsorted(-size, -np.arange(steps), side="left")
    begun = int(warm.min()) if n else 0
    same = bool((warm == begun).all())
    last = len(words) - 2
    u32, u64 = np.uint64(32), np.uint64

    def window(p):
        w = np.minimum(p >> 5, last)
        return ((words[w] << u32) | words[w + 1]) << (p & 31).astype(u64)

    for i in range(begun, steps):
        m = int(live_at[i])
        at = slice(0, m) if same or i >= depth else np.flatnonzero(warm[:m] <= i)
        new = fresh[at]
        if new.any():
            idx = np.flatnonzero(new) if isinstance(at, slice) else at[new]
            while len(idx):
                v, w = window(pos[idx]), param[idx]
                p = (v >> (u64(64) - w.astype(u64))).astype(np.int64)
                esc = p == (1 << w) - 1
                bits = ((v << w.astype(u64)) >> u64(59)).astype(np.int64)
                k[idx] = np.where(esc, bits, p)
                escape[idx] = esc
                pos[idx] += w + np.where(esc, 5, 0)
                idx = idx[left[idx] <= 0]  # a partition of warm-up samples only
                left[idx] = part[idx]
            fresh[at] = False
        p, kk = pos[at], k[at]
        v = window(p)
        top = v >> u64(12)
        q = 52 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        far = (top == 0) | (q + kk > 31)
        e = escape[at]
        slow = far | e
        rest = ((v << (q + 1).astype(u64)) >> u64(1)) >> (63 - kk).astype(u64) if not far.any() else ((v << np.minimum(q + 1, 63).astype(u64)) >> u64(1)) >> (63 - kk).astype(u64)
        u = (q << kk) | rest.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        step = q + 1 + kk
        if slow.any():
            names = np.arange(m) if isinstance(at, slice) else at
            for j in np.flatnonzero(slow).tolist():
                r[j], step[j] = _slow(words, int(p[j]), int(kk[j]), bool(e[j]), int(stop[names[j]]))
        pos[at] = p + step
        pred = (coefs[:, at] * out[i : i + depth, at]).sum(0) >> shift[at]
        out[depth + i, at] = r + pred
        left[at] -= 1
        done = left[at] == 0
        if done.any():
            idx = np.flatnonzero(done) if isinstance(at, slice) else at[done]
            left[idx] = part[idx]
            fresh[idx] = True
    ends = np.empty(n, np.int64)
    for i, s in enumerate(subs):
        if pos[i] <= stop[i]:
            s.samples = out[depth : depth + s.size, i].copy()
        ends[order[i]] = pos[i] - base[order[i]]
    return ends


def _slow(words: np.ndarray, p: int, k: int, escape: bool, stop: int) -> tuple[int, int]:
    """One residual, bit by bit: long unary runs and escaped partitions."""

    def take(at: int, n: int) -> int:
        x = 0
        for w in range(at >> 5, ((at + n - 1) >> 5) + 1 if n else at >> 5):
            x = x << 32 | (int(words[w]) if w < len(words) else 0)
        end = ((at + n - 1) >> 5) + 1 << 5
        return x >> (end - at - n) & ((1 << n) - 1)

    if escape:
        x = take(p, k) if k else 0
        return (x - (1 << k) if k and x >> (k - 1) else x), k
    q = 0
    while p + q < stop:
        x = take(p + q, 32)
        if x:
            q += 32 - x.bit_length()
            break
        q += 32
    u = q << k | (take(p + q + 1, k) if k else 0)
    return (u >> 1) ^ -(u & 1), q + 1 + k


def decode_many(media: list[bytes]) -> list[Stream]:
    """Every stream with its PCM blocks in order, or with ``error``."""
    streams: list[Stream] = []
    for data in media:
        try:
            streams.append(parse_stream(data))
        except (ValueError, IndexError) as e:
            streams.append(Stream(data, error=str(e)))
    sizes = [(len(s.data) + 3) // 4 * 4 for s in streams]
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    joined = np.frombuffer(b"".join(s.data + b"\0" * (z - len(s.data)) for s, z in zip(streams, sizes, strict=True)) + b"\0" * 12, np.uint8)
    words = joined.view(">u4").astype(np.uint64)
    # Frames to read: all that the seek table names, and after the last of these one by one.
    todo = []
    for i, s in enumerate(streams):
        if s.error is None and (s.total or s.first < len(s.data)):
            at = sorted({o for _, o in s.seek} | {0})
            todo += [(i, s.first + a, (s.first + b) if b is not None else None) for a, b in zip(at, [*at[1:], None], strict=True)]
    todo = deque(todo)
    while todo:
        heads, subs = [], []
        for i, at, end in [todo.popleft() for _ in range(min(RUN, len(todo)))]:
            s = streams[i]
            if s.error is not None:
                continue
            try:
                offset, size, ch, bps, bit = frame_head(s, at)
                heads.append({"i": i, "at": at, "next": end, "offset": offset, "size": size, "ch": ch, "bps": bps, "bit": bit, "subs": []})
            except (ValueError, IndexError) as e:
                s.error = str(e)
        waiting = heads
        for c in range(2):
            turn, waiting = waiting, []
            subs = []
            for h in turn:
                s = streams[h["i"]]
                side = h["ch"] == 8 and c == 1 or h["ch"] == 9 and c == 0 or h["ch"] == 10 and c == 1
                try:
                    sub, end = sub_head(s.data, h["bit"], h["bps"] + side, h["size"], 0)
                except (ValueError, IndexError) as e:
                    s.error = str(e)
                    continue
                h["subs"].append(sub)
                if sub.samples is None:
                    subs.append((h, sub))
                else:
                    h["bit"] = end
                if c == 0 and (h["ch"] >= 8 or h["ch"] == 1):
                    waiting.append(h)
                elif h["ch"] > 10 or 1 < h["ch"] < 8:
                    s.error = "more than two channels"
            if subs:
                of = np.array([h["i"] for h, _ in subs])
                ends = decode_subs(words, base[of] * 8, [x for _, x in subs], (base[of] + [len(streams[i].data) for i in of]) * 8)
                for (h, sub), e in zip(subs, ends.tolist(), strict=True):
                    h["bit"] = e
                    if sub.samples is None:
                        streams[h["i"]].error = "the stream ends early"
            waiting = [h for h in waiting if streams[h["i"]].error is None]
        heads = [h for h in heads if streams[h["i"]].error is None]
        if not heads:
            continue
        ends = np.array([(h["bit"] + 7) // 8 for h in heads])
        of = np.array([h["i"] for h in heads])
        inside = np.array([e + 2 <= len(streams[h["i"]].data) for h, e in zip(heads, ends.tolist(), strict=True)])
        crc = crc16_many(joined, base[of] + [h["at"] for h in heads], base[of] + np.where(inside, ends, [h["at"] for h in heads]))
        for h, e, x, ok in zip(heads, ends.tolist(), crc.tolist(), inside.tolist(), strict=True):
            s = streams[h["i"]]
            if not ok or int.from_bytes(s.data[e : e + 2], "big") != x:
                s.error = f"CRC-16 of the frame at byte {h['at']}"
                continue
            pcm = [x.samples << x.wasted for x in h["subs"]]
            if h["ch"] == 8:
                pcm = [pcm[0], pcm[0] - pcm[1]]
            elif h["ch"] == 9:
                pcm = [pcm[0] + pcm[1], pcm[1]]
            elif h["ch"] == 10:
                mid = pcm[0] << 1 | pcm[1] & 1
                pcm = [(mid + pcm[1]) >> 1, (mid - pcm[1]) >> 1]
            s.blocks.append((h["offset"], np.stack(pcm, 1).astype(np.int8 if s.bps <= 8 else np.int16 if s.bps <= 16 else np.int32)))
            # A total of 0 is an unknown one: then frames go on to the end of the stream.
            if (h["offset"] + h["size"] < s.total or not s.total and e + 2 < len(s.data)) and (h["next"] is None or h["next"] > e + 2):
                todo.append((h["i"], e + 2, h["next"]))
    for s in streams:
        s.blocks.sort(key=lambda x: x[0])
        if s.error is None and s.total and sum(len(b) for _, b in s.blocks) != s.total:
            s.error = "samples are missing"
        if s.error is None and s.md5 != bytes(16) and hashlib.md5(pcm_bytes(s)).digest() != s.md5:
            s.error = "MD5 of the samples"
    return streams


def pcm_bytes(s: Stream, first: int = 0, last: int | None = None) -> bytes:
    """Interleaved little-endian samples of the blocks."""
    width = (s.bps + 7) // 8
    return b"".join(b.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes() if width > 1 else b.astype(np.int8).tobytes() for _, b in s.blocks[first:last])


# ---------------------------------------------------------------- DataFrames


def payload(text: bytes, unit: int = 64) -> bytes:
    """The bytes, and bytes 0 up to a positive multiple of ``unit``."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def to_flac(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (of the text in UTF-8) and ``media``, one row per row.

    Null texts count as empty, and empty ones become 64 bytes 0. Texts are stored whole, however long; frames are made in runs of ``RUN``, so that memory
    grows with the text's bytes only. Repeated rows give equal rows, null ids are kept; other columns aren't carried, whatever their
    names. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_slices(batches, "text", 1 << 20):
            texts = [x.encode() for x in col.to_pylist()]
            media = encode_many([payload(x) for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _decoded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[Stream]]]:
    for batch in batches:
        col, i = batch.column(column), 0
        while i < len(batch):
            j, size = i, 0
            while j < len(batch) and (j == i or size < 1 << 20):
                size += len(col[j].as_buffer()) if col[j].is_valid else 0
                j += 1
            media = col.slice(i, j - i).to_pylist()
            yield batch.slice(i, j - i), media, decode_many([m or b"" for m in media])
            i = j


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: ``id_col``, block, sample_offset, n_samples, rate, channels, bits, pcm (interleaved little-endian
    samples), so that any sample is found by its offset without decoding again. A stream that can't be read, or
    fails a check sum, gives a single row with its ``error`` and no block, null media likewise.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media, streams in _decoded(batches, "media"):
            at, out = [], []
            for i, (m, s) in enumerate(zip(media, streams, strict=True)):
                if m is None or s.error is not None:
                    at.append(i)
                    out.append((None, None, None, None, None, None, None, "no media" if m is None else s.error))
                    continue
                for b, (offset, x) in enumerate(s.blocks):
                    at.append(i)
                    out.append((b, offset, len(x), s.rate, s.channels, s.bps, pcm_bytes(s, b, b + 1), None))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "block", "sample_offset", "n_samples", "rate", "channels", "bits", "pcm", "error"])

    return rows.mapInArrow(run, f"id {kind}, block int, sample_offset long, n_samples int, rate int, channels int, bits int, pcm binary, error string").withColumnRenamed("id", id_col)


def feature(x: np.ndarray) -> str:
    """Loudness, sign changes, peak and spread of 8-bit samples; summed in whole numbers, a part at a time."""
    n, total, square, peak = max(1, len(x)), 0, 0, 0
    for i in range(0, len(x), 1 << 20):
        part = x[i : i + (1 << 20)].astype(np.int64)
        total, square, peak = total + int(part.sum()), square + int((part * part).sum()), max(peak, int(np.abs(part).max()))
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={(square / n) ** 0.5:.4f};zcr={turns / max(1, len(x) - 1):.6f};peak={peak};std={max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f}"


def media_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of rows of :func:`to_flac`: what the stored bytes give when they are read back: ``payload_bytes`` and ``payload_sha256``, ``tail_crc32`` (of the last 64
    bytes), ``media_bytes`` and ``media_sha256`` (the stored form), and ``feature``; one row per row, equal ones for equal texts.

    ``error`` is null, or tells why a stream can't be read or fails a check sum; then the other results are null. Null ids are kept; other columns aren't
    carried, whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media, streams in _decoded(batches, "media"):
            out = []
            for m, s in zip(media, streams, strict=True):
                if m is None or s.error is not None:
                    out.append((None, None, None, None if m is None else len(m), None, None, "no media" if m is None else s.error))
                    continue
                x = np.concatenate([b for _, b in s.blocks])[:, 0].astype(np.int8, copy=False)
                data = (x.view(np.uint8) ^ 0x80).tobytes()
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(x), None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
