"""Lossless audio-style storage of byte strings: a FLAC coder and decoder in numpy, many frames at a time.

Streams are plain mono 8-bit FLAC: STREAMINFO with the PCM's md5, a SEEKTABLE of sample offsets, then frames
with CRC-8 and CRC-16. The coder picks, for each frame, the shortest of a constant, verbatim, fixed-predictor
(order 0 to 2) and linear-predictor (order 2) subframe with Rice residuals. The decoder also takes orders up to
32, partitioned and escaped residuals, and every block size. Frames are independent, so the Rice codes of
thousands of frames are decoded in step: one numpy operation handles one sample of each of them.

Streams are written to a table in the shared folder and read back from it: as PCM blocks, one for each seek point
with the offset of its first sample, each decoded from where the seek table says it begins.

Null and empty texts store one padded block of spaces. Texts of any length are coded in frames of bounded
size, at most ``LANES`` at a time. Repeated rows and equal texts give equal results; empty tables give none; other
columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common

BLOCK, LANES, SEEK_EVERY, PAD = 576, 4096, 8, 192
#: Fixed by the FLAC format: block-size codes that need no further bytes, and how the others are made.
SIZES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}
CODES = {v: k for k, v in SIZES.items()}
U64 = np.uint64


def _crc_table(poly: int, width: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        t = ((t << 1) ^ np.where(t >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return t.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


@lru_cache(maxsize=4)
def _crc16_far(n: int) -> np.ndarray:
    """[d, b]: what byte b adds to the CRC-16 when d bytes follow it."""
    out = np.empty((n, 256), np.uint16)
    out[0] = _CRC16
    for d in range(1, n):
        out[d] = (out[d - 1] << 8) ^ _CRC16[out[d - 1] >> 8]
    return out


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _crc16s(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each flat[start:end]; the stretches lie one after another without overlap."""
    sizes = ends - starts
    far = _crc16_far(1 << int(sizes.max()).bit_length())
    out = np.empty(len(starts), np.uint16)
    for i in range(0, len(starts), LANES):
        n = sizes[i : i + LANES]
        first = np.cumsum(n) - n
        at = np.repeat(starts[i : i + LANES] - first, n) + np.arange(int(n.sum()))
        left = np.repeat(first + n, n) - 1 - np.arange(len(at))
        out[i : i + LANES] = np.bitwise_xor.reduceat(far[left, flat[at]], first)
    return out


@lru_cache(maxsize=65536)
def _header(number: int, size: int) -> bytes:
    head = bytes([0xFF, 0xF8, SIZES.get(size, 7) << 4, 0x02])
    if number < 0x80:
        head += bytes([number])
    else:
        tail, lead = [], 0x3F
        while number > lead:
            tail.append(0x80 | number & 0x3F)
            number, lead = number >> 6, lead >> 1
        head += bytes([(~lead << 1) & 0xFF | number, *tail[::-1]])
    if size not in SIZES:
        head += struct.pack(">H", size - 1)
    return head + bytes([_crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (values >> (width - 1 - b)) & 1


def _residuals(x: np.ndarray, order: int, q: np.ndarray | None = None) -> np.ndarray:
    if q is not None:
        return x[:, 2:] - ((q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> 10)
    return np.diff(x, n=order, axis=1) if order else x


def _lpc2(x: np.ndarray) -> np.ndarray:
    """Quantised order-2 predictors of the rows (shift 10), by the normal equations."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1) + 1e-9, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    det = np.where(np.abs(det) < 1e-6, np.inf, det)
    a = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    return np.clip(np.rint(a * 1024), -2048, 2047).astype(np.int32)


def _subframes(x: np.ndarray) -> list[bytes]:
    """The coded subframe of each row of samples."""
    rows, n = x.shape
    q = _lpc2(x)
    cand = [(0, None), (1, None), (2, None), (2, q)]  # order, predictor
    cost = np.full((len(cand), rows), np.inf)
    extra = [order * 8 + 18 + (33 if p is not None else 0) for order, p in cand]
    for c, (order, p) in enumerate(cand):
        r = _residuals(x, order, p)
        mean = np.abs(r).sum(1) * 2 / r.shape[1] + 1e-9
        k = np.clip(np.floor(np.log2(mean * 0.75 + 1e-9)), 0, 14)
        cost[c] = extra[c] + r.shape[1] * (1 + k + mean / 2**k)
    best = cost.argmin(0)
    flat = (x == x[:, :1]).all(1)
    out: list[bytes] = [b""] * rows
    raw = ~flat & (cost.min(0) >= 8 * n + 8)
    for c, (order, p) in enumerate(cand):
        mine = np.flatnonzero((best == c) & ~flat & ~raw)
        if not len(mine):
            continue
        xs, m = x[mine], n - order
        r = _residuals(xs, order, p[mine] if p is not None else None)
        u = ((r << 1) ^ (r >> 31)).astype(np.int32)
        k0 = np.clip(np.floor(np.log2(u.mean(1) * 0.75 + 1e-9)), 0, 14).astype(np.int32)
        tries = np.clip(np.stack([k0 - 1, k0, k0 + 1]), 0, 14)
        k = tries[np.stack([m * (1 + t) + (u >> t[:, None]).sum(1) for t in tries]).argmin(0), np.arange(len(mine))]
        high = u >> k[:, None]
        size = high + (1 + k)[:, None]
        head = extra[c]
        total = (head + size.sum(1) + 7) // 8
        raw[mine[total > n + 1]] = True
        start = np.cumsum(total) - total
        bits = np.zeros(int(total.sum()) * 8, np.uint8)
        at = start * 8
        kind = (32 | order - 1) if p is not None else 8 | order
        _put(bits, at, np.full(len(mine), kind << 1), 8)
        for j in range(order):
            _put(bits, at + 8 + 8 * j, xs[:, j] & 255, 8)
        at = at + 8 + 8 * order
        if p is not None:
            _put(bits, at, np.full(len(mine), 11 << 5 | 10), 9)
            for j in range(2):
                _put(bits, at + 9 + 12 * j, p[mine, j] & 4095, 12)
            at = at + 33
        _put(bits, at, k, 10)  # method 0, one partition, its parameter
        pos = np.cumsum(size, 1)
        pos += (at + 10)[:, None] - size
        pos += high
        bits[pos] = 1
        for kk in np.unique(k):
            sel = k == kk
            ps, us = pos[sel] + 1, u[sel]
            for b in range(kk):
                bits[ps + b] = (us >> (kk - 1 - b)) & 1
        data = np.packbits(bits).tobytes()
        for i, a, b in zip(mine.tolist(), start.tolist(), (start + total).tolist()):
            out[i] = data[a:b]
    for i in np.flatnonzero(raw):
        out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
    for i in np.flatnonzero(flat):
        out[i] = b"\x00" + x[i, :1].astype(np.int8).tobytes()
    return out


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload; byte b is the sample b - 128."""
    if not payloads:
        return []
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    frames = -(-sizes // block)
    first = np.cumsum(frames) - frames
    number = np.arange(frames.sum()) - np.repeat(first, frames)
    start = np.repeat(np.cumsum(sizes) - sizes, frames) + number * block
    size = np.minimum(block, np.repeat(sizes, frames) - number * block)
    subs: list[bytes] = [b""] * len(size)
    for n in np.unique(size):
        mine = np.flatnonzero(size == n)
        for i in range(0, len(mine), LANES):
            some = mine[i : i + LANES]
            x = flat[start[some][:, None] + np.arange(n)].astype(np.int32) - 128
            for j, s in zip(some.tolist(), _subframes(x)):
                subs[j] = s
    made = [_header(k, n) + s for k, n, s in zip(number.tolist(), size.tolist(), subs)]
    length = np.array([len(m) for m in made])
    ends = np.cumsum(length)
    crc = _crc16s(np.frombuffer(b"".join(made), np.uint8), ends - length, ends).astype(">u2").tobytes()
    out = []
    for d, p in enumerate(payloads):
        a, b = first[d], first[d] + frames[d]
        whole = [made[j] + crc[2 * j : 2 * j + 2] for j in range(a, b)]
        lens = [len(w) for w in whole]
        offset = np.cumsum([0, *lens])
        points = b"".join(struct.pack(">QQH", j * block, int(offset[j]), int(size[a + j])) for j in range(0, b - a, SEEK_EVERY))
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", block, block) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big") + (8000 << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(whole))
    return out


def metadata(data: bytes) -> dict:
    """block, samples, md5, the seek points (sample, offset from the first frame, samples) and where frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, out, last = 4, {"seek": []}, False
    while not last:
        last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
                raise ValueError("only mono 8-bit streams")
            out |= {"block": int.from_bytes(body[2:4], "big"), "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack_from(">QQH", body, i) for i in range(0, n, 18)]
        at += 4 + n
    return out | {"frames": at}


def _frame_head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Frame number, samples and length of the header at a sync code, or None if its CRC-8 disagrees."""
    if at + 6 > len(data) or data[at + 3] & 0xFE not in (0x02, 0x00) or data[at + 2] >> 4 == 0:
        return None
    lead, i = data[at + 4], at + 5
    if lead < 0x80:
        number = lead
    else:
        more = 8 - (lead ^ 0xFF).bit_length() - 1
        if more < 1:
            return None
        number = lead & (0x3F >> more)
        for b in data[i : i + more]:
            number = number << 6 | b & 0x3F
        i += more
    code = data[at + 2] >> 4
    if code in (6, 7):
        size, i = int.from_bytes(data[i : i + code - 5], "big") + 1, i + code - 5
    else:
        size = CODES.get(code, 0)
    if i >= len(data) or _crc8(data[at:i]) != data[i]:
        return None
    return number, size, i + 1 - at


_HEADS: dict[bytes, tuple[int, int, int] | None] = {}


def _split(data: bytes, at: int, number: int, samples: int, stop: int | None = None) -> list[tuple[int, int, int, int]]:
    """(header start, subframe start, end before the CRC-16, samples) of the frames from ``at`` on, the last up to ``stop``."""
    found, left = [], samples
    here = at
    while left > 0:
        key = data[here : here + 16]
        head = _HEADS.get(key[:7]) if len(key) == 16 else None
        if head is None:
            head = _frame_head(data, here)
            if head and len(_HEADS) < 65536 and head[2] <= 7:
                _HEADS[key[:7]] = head
        if data[here : here + 2] != b"\xff\xf8" or not head or head[0] != number:
            raise ValueError("damaged frame header")
        left -= head[1]
        number = head[0] + 1
        if left <= 0:
            after = len(data) if stop is None else stop
        else:
            after = data.find(b"\xff\xf8", here + head[2] + 3)
            while after > 0 and not ((h := _frame_head(data, after)) and h[0] == number):
                after = data.find(b"\xff\xf8", after + 1)
            if after < 0:
                raise ValueError("frames are missing")
        found.append((here, here + head[2], after - 2, head[1]))
        here = after
    return found


_LEAD = np.array([16] + [16 - i.bit_length() for i in range(1, 1 << 16)], np.uint8)


class _Bits:
    """Big-endian bit reader at many positions at once."""

    def __init__(self, flat: np.ndarray):
        padded = np.concatenate([flat, np.zeros(16, np.uint8)]).astype(U64)
        n = len(flat) + 8
        self.window = np.zeros(n, U64)
        for j in range(8):
            self.window |= padded[j : j + n] << U64(56 - 8 * j)

    def top(self, at: np.ndarray) -> np.ndarray:
        """64 bits from ``at``, of which at least the first 57 are right."""
        return self.window[at >> 3] << (at & 7).astype(U64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        w = np.asarray(width)
        return np.where(w == 0, 0, (self.top(at) >> U64(1)) >> (63 - w).astype(U64)).astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v, w = self.take(at, width), np.asarray(width)
        return np.where(w > 0, v - ((v >> np.maximum(w - 1, 0) & 1) << w), 0)


def _rice(bits: _Bits, at: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Residuals [sample, frame]; the ``order`` first samples of a frame have none."""
    if (bits.take(at, 2) > 1).any():
        raise ValueError("unknown residual coding")
    wide = bits.take(at, 2) + 4  # bits of a parameter
    parts = bits.take(at + 2, 4)
    at = at + 6
    step = n >> parts
    out = np.zeros((n, len(at)), np.int32)
    k, raw = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    escaped = np.zeros(len(at), bool)
    bounds = np.unique(np.concatenate([np.arange(0, n, s) for s in np.unique(step)]))
    begins, any_escape, ku, kr = set(bounds.tolist()), False, None, None
    late = int(order.max())
    for t in range(n):
        if t in begins:
            new = np.flatnonzero(t % step == 0)
            k[new] = bits.take(at[new], wide[new])
            at[new] += wide[new]
            escaped[new] = k[new] == (1 << wide[new]) - 1
            esc = new[escaped[new]]
            raw[esc] = bits.take(at[esc], 5)
            at[esc] += 5
            any_escape = bool(escaped.any())
            ku, kr = (k + 1).astype(np.int64), (63 - k).astype(U64)
        x = bits.window[at >> 3] << (at & 7).astype(U64)
        q = _LEAD[(x >> U64(48)).astype(np.intp)].astype(np.int64)
        if (q == 16).any():
            for i in np.flatnonzero((q == 16) & ~escaped & (t >= order)):
                p, c = int(at[i]), 0
                while not int(bits.take(np.array([p]), 1)[0]):
                    p, c = p + 1, c + 1
                q[i] = c
                if c > 16:
                    x[i] = bits.top(np.array([p - 16]))[0]
        shown = np.minimum(q, 16) + 1
        low = ((x << shown.astype(U64)) >> U64(1)) >> kr
        u = (q << k) | low.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        use = q + ku
        if any_escape:
            r = np.where(escaped, bits.signed(at, raw), r)
            use = np.where(escaped, raw, use)
        if t < late:
            live = t >= order
            r, use = np.where(live, r, 0), np.where(live, use, 0)
        out[t] = r
        at = at + use
    return out


#: Fixed by the FLAC format.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _decode_frames(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Samples [frame, n] of the subframes that start at the bytes ``at``."""
    out = np.zeros((len(at), n), np.int32)
    head = flat[at]
    if (head & 0x81).any():
        raise ValueError("wasted bits aren't used in 8-bit streams")
    kind = head >> 1
    for i in np.flatnonzero(kind == 0):
        out[i] = np.int8(flat[at[i] + 1].astype(np.int8))
    for i in np.flatnonzero(kind == 1):
        out[i] = flat[at[i] + 1 : at[i] + 1 + n].view(np.int8)
    coded = np.flatnonzero((kind & 0x38 == 8) | (kind >= 32))
    if len(coded):
        lo, hi = int(at[coded].min()), min(len(flat), int(at[coded].max()) + 4 * n + 256)
        bits, lpc = _Bits(flat[lo:hi]), kind[coded] >= 32
        order = np.where(lpc, (kind[coded] & 31).astype(np.int64) + 1, kind[coded] & 7).astype(np.int64)
        pos = (at[coded] - lo) * 8 + 8
        warm = np.zeros((32, len(coded)), np.int32)
        for j in range(int(order.max())):
            has = order > j
            warm[j, has] = bits.signed(pos[has] + 8 * j, 8)
        pos = pos + 8 * order
        coef, shift = np.zeros((32, len(coded)), np.int64), np.zeros(len(coded), np.int64)
        if lpc.any():
            i = np.flatnonzero(lpc)
            wide, shift[i] = bits.take(pos[i], 4) + 1, bits.signed(pos[i] + 4, 5)
            pos[i] += 9
            for j in range(int(order[i].max())):
                has = order[i] > j
                coef[j, i[has]] = bits.signed(pos[i[has]], wide[has])
                pos[i[has]] += wide[has]
        for o in np.unique(order[~lpc]):
            for j, c in enumerate(FIXED[int(o)]):
                coef[j, ~lpc & (order == o)] = c
        res = _rice(bits, pos, order, n)
        for o, is_lpc in sorted(set(zip(order.tolist(), lpc.tolist()))):
            mine = np.flatnonzero((order == o) & (lpc == is_lpc))
            x = res[:, mine].astype(np.int64)
            x[:o] = warm[:o, mine]
            if not is_lpc and o == 1:
                x = np.cumsum(x, 0)
            elif o:
                c, s = coef[:o, mine], shift[mine]
                for t in range(o, n):
                    x[t] += sum(c[j] * x[t - 1 - j] for j in range(o)) >> s
            out[coded[mine]] = x.T
    if len(coded) + (kind < 2).sum() < len(at):
        raise ValueError("reserved subframe type")
    return out


def _decode(flat: np.ndarray, frames: list[tuple[int, int, int, int]]) -> list[bytes]:
    """PCM bytes of each frame, its CRC-16 verified."""
    f = np.array(frames, np.int64).reshape(-1, 4)
    crc = _crc16s(flat, f[:, 0], f[:, 2])
    if (crc != (flat[f[:, 2]].astype(np.uint16) << 8 | flat[f[:, 2] + 1])).any():
        raise ValueError("a frame's CRC-16 disagrees")
    out: list[bytes] = [b""] * len(f)
    for n in np.unique(f[:, 3]):
        mine = np.flatnonzero(f[:, 3] == n)
        for i in range(0, len(mine), LANES):
            some = mine[i : i + LANES]
            x = (_decode_frames(flat, f[some, 1], int(n)) + 128).astype(np.uint8)
            for j, row in zip(some.tolist(), x):
                out[j] = row.tobytes()
    return out


def _blocks(info: dict, length: int) -> list[tuple[int, int, int, int]]:
    """(first sample, samples, start, end in the stream) of the stretches between seek points; all of it without any."""
    points = [(p[0], info["frames"] + p[1]) for p in info["seek"] if p[0] < info["samples"]] or [(0, info["frames"])]
    if points[0] != (0, info["frames"]):
        points.insert(0, (0, info["frames"]))
    ends = [*points[1:], (info["samples"], length)]
    return [(a, c - a, b, d) for (a, b), (c, d) in zip(points, ends)]


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """(first sample, PCM) of the blocks of each stream, every one from its seek point; checksums and the md5 are verified."""
    if not streams:
        return []
    frames, counts, at, infos = [], [], 0, []
    for s in streams:
        info = metadata(s)
        own = []
        for sample, n, begin, end in _blocks(info, len(s)):
            found = _split(s, begin, sample // info["block"], n, end)
            frames += [(a + at, b + at, c + at, k) for a, b, c, k in found]
            own.append((sample, len(found)))
        counts.append(own)
        infos.append(info)
        at += len(s)
    pcm = iter(_decode(np.frombuffer(b"".join(streams), np.uint8), frames))
    out = []
    for own, info in zip(counts, infos):
        made = [(sample, b"".join(next(pcm) for _ in range(n))) for sample, n in own]
        if hashlib.md5((np.frombuffer(b"".join(p for _, p in made), np.uint8) ^ 128).tobytes()).digest() != info["md5"]:
            raise ValueError("the stream's md5 disagrees")
        out.append(made)
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream."""
    return [b"".join(p for _, p in made) for made in decode_blocks(streams)]


def read_samples(data: bytes, start: int, count: int) -> bytes:
    """Samples start to start + count, decoding only the blocks that hold them."""
    info = metadata(data)
    count = max(0, min(count, info["samples"] - start))
    need = [b for b in _blocks(info, len(data)) if b[0] < start + count and b[0] + b[1] > start]
    if not count:
        return b""
    frames = [f for sample, n, begin, end in need for f in _split(data, begin, sample // info["block"], n, end)]
    pcm = b"".join(_decode(np.frombuffer(data, np.uint8), frames))
    return pcm[start - need[0][0] :][:count]


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about so many bytes in the second column, one row at least."""
    sizes = [len(v) if v is not None else 0 for v in (x.as_buffer() if x.is_valid else None for x in batch.column(1))]
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)


def code(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with spaces to a multiple of 192, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                raw = [x or b"" for x in some.column(1).to_pylist()]
                media = encode([x.ljust(max(PAD, -(-len(x) // PAD) * PAD), b" ") for x in raw], block)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(common.trimmed(run), "doc_id long, n_bytes long, media binary")


def store(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """The streams of ``code``, written under path (a new one in the shared folder if None) and read from there."""
    spark = docs.sparkSession
    path = path or common.scratch_path(spark, "flac-streams")
    coded = code(docs, block)
    coded.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(coded.schema).parquet(path)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample, pcm: the PCM blocks of stored streams(doc_id, media) with the offset of their first sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                rows = [(d, k, sample, p) for d, made in zip(some.column(0).to_pylist(), decode_blocks(some.column(1).to_pylist())) for k, (sample, p) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["doc_id", "block", "sample", "pcm"])

    return media.select("doc_id", "media").mapInArrow(common.trimmed(run), "doc_id long, block int, sample long, pcm binary")


def features(pcm: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples around 0, from the decoded PCM."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    cross = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={cross}"


def digest(media: DataFrame) -> DataFrame:
    """What the stored streams hold, read back from them."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch.select([0, 2, 1])):
                stored = some.column(1).to_pylist()
                read = ((m, b"".join(p for _, p in made)) for m, made in zip(stored, decode_blocks(stored)))
                rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(p)) for m, p in read]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *(pa.array(c) for c in zip(*rows))], names=[x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(common.trimmed(run), schema)


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(common.table(spark, sf_dir, "documents")))
