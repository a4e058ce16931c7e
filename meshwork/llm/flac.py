"""FLAC for byte payloads: 8-bit mono frames, many at once in numpy.

Writing: a stream is STREAMINFO (with the MD5 of its samples), a SEEKTABLE with one point per frame, and frames
of BLOCK samples (the last may be shorter). A frame is CONSTANT, VERBATIM, or has a linear predictor (FIXED of
order 0 to 4, or LPC of order LPC_ORDER) and Rice residuals, whichever is least; it ends with its CRC-16, its header with a CRC-8.

Reading: all frames that the seek tables name are decoded side by side, one sample of each a step; streams
without a full table go frame after frame. Both checksums, the sample count and the MD5 are verified.
PCM blocks come with the sample offset of their start, so that a reader may seek: op8 reads payloads and tails by them.
A metadata block holds 2^24 bytes: streams of over 900,000 frames have no seek table and are read frame after frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE, PAD = 1024, 8000, 64
#: Bytes that are encoded at once, and frames that are decoded at once.
SLICE, AT_ONCE = 1 << 20, 3000
ORDERS = 5
LPC_BITS, LPC_ORDER = 12, 4


def _table(poly: int, width: int) -> np.ndarray:
    rows = []
    for i in range(256):
        v = i << (width - 8)
        for _ in range(8):
            v = (v << 1 ^ poly if v >> (width - 1) else v << 1) & ((1 << width) - 1)
        rows.append(v)
    return np.array(rows, np.uint16)


#: x^8 + x^2 + x + 1 over headers, x^16 + x^15 + x^2 + 1 over frames.
CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for many ranges, a byte of each at a step."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(order), np.uint16)
    live = len(order)
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-left, -step, "left")) if left[live - 1] <= step else live
        c = crc[:live]
        crc[:live] = c << np.uint16(8) ^ CRC16[c >> np.uint16(8) ^ data[at[:live] + step]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 that FLAC uses."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 + 5 * k))
    tail = [0x80 | n >> 6 * k & 0x3F for k in reversed(range(more))]
    return bytes([0xFF << (7 - more) & 0xFF | n >> 6 * more, *tail])


@cache
def _header(number: int, samples: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x74, 0x02]) + _coded_number(number) + struct.pack(">H", samples - 1)
    crc = 0
    for b in head:
        crc = int(CRC8[crc ^ b])
    return head + bytes([crc])


def _lpc(samples: np.ndarray, starts: np.ndarray, frame: np.ndarray, inside: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients by frame, residuals of all samples): least squares on the autocorrelation, shift LPC_BITS - 2."""
    s = samples.astype(np.float32)
    back = [s]
    for k in range(1, order + 1):
        # the sample k places before, 0 beyond the frame's start
        d = np.zeros_like(s)
        d[k:] = s[:-k]
        d[inside < k] = 0
        back.append(d)
    r = np.stack([np.add.reduceat(s * d, starts, dtype=np.float64) for d in back])
    lag = np.abs(np.arange(order)[:, None] - np.arange(order))
    m = r[lag].transpose(2, 0, 1) + np.eye(order) * (1e-3 * r[0] + 1e-9)[:, None, None]
    top = (1 << (LPC_BITS - 1)) - 1
    coef = np.clip(np.round(np.linalg.solve(m, r[1:].T[:, :, None])[:, :, 0] * (1 << (LPC_BITS - 2))), -top - 1, top)
    # 8-bit samples times 12-bit coefficients: sums of a few are whole numbers that 32-bit floats hold exactly
    told = sum(coef[:, k].astype(np.float32)[frame] * back[k + 1] for k in range(order))
    return coef.astype(np.int64), samples - (told.astype(np.int32) >> (LPC_BITS - 2))


def _frames(data: np.ndarray, lengths: np.ndarray, firsts: np.ndarray, block: int, lpc_order: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(frames of all pieces, bytes of each frame, frames of each piece); firsts are the pieces' first frame numbers."""
    x = data.astype(np.int32) - 128
    per = -(-lengths // block)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    number = nth + np.repeat(firsts, per)
    starts = np.repeat(np.cumsum(lengths) - lengths, per) + nth * block
    sizes = np.minimum(block, np.repeat(lengths, per) - nth * block)
    frame = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(x)) - starts[frame]

    # predictors: least sum of |residual| among the orders that a frame is long enough for
    res, sums, d = [], [], x
    for order in range(ORDERS):
        if order:
            d = np.diff(d, prepend=d[:1])
        res.append(d)
        sums.append(np.where(sizes > order, np.add.reduceat(np.where(inside >= order, np.abs(d), 0), starts), np.iinfo(np.int64).max))
    order = np.argmin(sums, axis=0)
    coef = None
    if lpc_order:
        coef, lpc_res = _lpc(x, starts, frame, inside, lpc_order)
        lpc_sum = np.where(sizes > lpc_order, np.add.reduceat(np.where(inside >= lpc_order, np.abs(lpc_res), 0), starts), np.iinfo(np.int64).max)
        # coefficients cost bits as well: about as many as their residuals must save
        use_lpc = lpc_sum + LPC_BITS * lpc_order < np.min(sums, axis=0)
    else:
        use_lpc = np.zeros(len(starts), bool)
    r = res[0].astype(np.int64)
    for k in range(1, ORDERS):
        r = np.where(order[frame] == k, res[k], r)
    if lpc_order:
        r = np.where(use_lpc[frame], lpc_res, r)
    warm = np.where(use_lpc, lpc_order, order)
    is_warm = inside < warm[frame]
    u = np.where(is_warm, 0, r << 1 ^ r >> 63)

    # Rice parameter: least bits
    costs = [np.add.reduceat(u >> k, starts) + (sizes - warm) * (k + 1) for k in range(9)]
    k = np.argmin(costs, axis=0)
    lpc_bits = np.where(use_lpc, 9 + LPC_BITS * max(lpc_order, 1), 0)
    rice_bits = np.min(costs, axis=0) + 8 * warm + 10 + lpc_bits
    constant = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    verbatim = ~constant & (rice_bits >= 8 * sizes)
    coded = ~constant & ~verbatim
    use_lpc &= coded

    # every sample is q zeros, then `tail` bits of v
    raw = is_warm | ~coded[frame]
    kf = k[frame]
    q = np.where(raw, 0, u >> kf)
    v = np.where(raw, x & 0xFF, 1 << kf | u & (1 << kf) - 1)
    tail = np.where(raw, 8, kf + 1)
    tail[constant[frame] & (inside > 0)] = 0
    bits = q + tail
    # side fields between the warm-up samples and the residuals
    side = np.where(coded, 10 + np.where(use_lpc, 9 + LPC_BITS * lpc_order, 0), 0)
    heads = [_header(int(n), int(m)) for n, m in zip(number, sizes, strict=True)]
    head_bytes = np.array([len(h) for h in heads], np.int64)
    body_bits = 8 + np.add.reduceat(bits, starts) + side
    frame_bytes = head_bytes + (body_bits + 7) // 8 + 2
    at = np.cumsum(frame_bytes) - frame_bytes
    begin = np.cumsum(bits) - bits
    pos = (8 * (at + head_bytes) + 8)[frame] + begin - begin[starts][frame] + np.where(raw & coded[frame], 0, side[frame])
    out = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            out[where + (width - 1 - b)] = value >> b & 1

    last = pos + bits - 1
    for b in range(int(tail.max())):
        on = (tail > b) & (v >> b & 1).astype(bool)
        out[last[on] - b] = 1
    sub = 8 * (at + head_bytes)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(use_lpc, 0x20 | max(lpc_order - 1, 0), 8 | order)))
    put(sub, kind << 1, 8)
    side_at = sub + 8 + 8 * warm
    if use_lpc.any():
        f = np.flatnonzero(use_lpc)
        put(side_at[f], np.full(len(f), LPC_BITS - 1), 4)
        put(side_at[f] + 4, np.full(len(f), LPC_BITS - 2), 5)
        for j in range(lpc_order):
            put(side_at[f] + 9 + LPC_BITS * j, coef[f, j] & (1 << LPC_BITS) - 1, LPC_BITS)
    f = np.flatnonzero(coded)
    put(side_at[f] + side[f] - 4, k[f], 4)
    packed = np.packbits(out)
    for a, h in zip(at.tolist(), heads, strict=True):
        packed[a : a + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(packed, at, at + frame_bytes - 2)
    packed[at + frame_bytes - 2], packed[at + frame_bytes - 1] = crc >> 8, crc & 0xFF
    return packed.tobytes(), frame_bytes, per


def encode(payloads: list[bytes], block: int = BLOCK, lpc_order: int = 0) -> list[bytes]:
    """A FLAC stream for each payload of one byte or more; long payloads are worked on piece by piece."""
    if not all(payloads):
        raise ValueError("a payload has no bytes")
    step = max(SLICE // block, 1) * block
    pieces = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), step)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    cuts = [payloads[i][at : at + step] for i, at in pieces]
    for part in _parts([len(c) for c in cuts]):
        own = cuts[part]
        flat, each, per = _frames(np.frombuffer(b"".join(own), np.uint8), np.array([len(c) for c in own], np.int64), np.array([at // block for _, at in pieces[part]], np.int64), block, lpc_order)
        begin = 0
        for (i, _), mine in zip(pieces[part], np.split(each, np.cumsum(per)[:-1]), strict=True):
            end = begin + int(mine.sum())
            frames[i].append(flat[begin:end])
            sizes[i].append(mine)
            begin = end
    made = []
    for p, own, each in zip(payloads, frames, sizes, strict=True):
        size = np.concatenate(each)
        info = struct.pack(">HH", max(block, 16), max(block, 16)) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        points = np.empty(len(size), [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"] = np.arange(len(size)) * block, np.cumsum(size) - size
        points["size"] = np.minimum(block, len(p) - np.arange(len(size)) * block)
        # a metadata block holds 2^24 - 1 bytes: longer tables stay out, and the stream is read frame by frame
        table = points.tobytes() if 18 * len(size) < 1 << 24 else b""
        made.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return made


class Stream:
    """The metadata of a stored stream."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek = 4, False, np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        while not last:
            last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            body = media[at + 4 : at + 4 + size]
            if len(body) != size:
                raise ValueError("metadata break off")
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.total, self.md5 = struct.unpack(">H", body[2:4])[0], packed & (1 << 36) - 1, body[18:34]
                if (packed >> 36 & 31) != 7 or packed >> 41 & 7:
                    raise ValueError("only 8-bit mono is stored here")
            elif kind == 3:
                self.seek = np.frombuffer(body, self.seek.dtype)
            at += 4 + size
        self.frames = at
        s = self.seek
        self.full = len(s) == -(-self.total // self.block) and bool((np.cumsum(s["size"].astype(np.int64)) - s["size"] == s["sample"]).all()) and int(s["size"].sum()) == self.total


def _frame_heads(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, where the subframe starts) of frames; checks sync, fields and CRC-8."""
    sizes, body = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for i, a in enumerate(at.tolist()):
        h = data[a : a + 16].tobytes()
        lead = h[4]
        more = 0 if lead < 0x80 else 6 if lead == 0xFE else 8 - (lead ^ 0xFF).bit_length() - 1
        n = struct.unpack(">H", h[5 + more : 7 + more])[0] + 1
        number = lead if more == 0 else lead & (0x3F >> more)
        for b in h[5 : 5 + more]:
            number = number << 6 | b & 0x3F
        if h[: 8 + more] != _header(number, n):
            raise ValueError("a frame header is damaged")
        sizes[i], body[i] = n, a + 8 + more
    return sizes, body


def _decode_frames(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(samples of each frame, where each ends) for frames that start at byte `at` of data, which has 16 bytes to spare."""
    sizes, body = _frame_heads(data, at)
    order = np.argsort(-sizes, kind="stable")
    n, pos = sizes[order], 8 * body[order]
    windows = np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1))

    def peek(bit: np.ndarray) -> np.ndarray:
        w = windows[bit >> 3].view(">u8").ravel().astype(np.uint64)
        return w << (bit & 7).astype(np.uint64)

    def take(rows: np.ndarray, width: int) -> np.ndarray:
        got = peek(pos[rows]) >> np.uint64(64 - width)
        pos[rows] += width
        return got.astype(np.int64)

    every = np.arange(len(n))
    kind = take(every, 8) >> 1
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >> 3) == 1, (kind >> 5) == 1
    if not (constant | verbatim | (fixed & (kind & 7 < ORDERS)) | lpc).all():
        raise ValueError("a subframe of unknown type")
    warm = np.where(fixed, kind & 7, np.where(lpc, (kind & 31) + 1, 0))
    out = np.zeros((len(n), int(n.max())), np.int64)
    signed = lambda v: (v ^ 0x80) - 0x80
    if constant.any():
        out[constant] = signed(take(np.flatnonzero(constant), 8))[:, None]
    raw = np.where(verbatim, n, warm)
    for i in range(int(raw.max())):
        rows = np.flatnonzero(raw > i)
        out[rows, i] = signed(take(rows, 8))
    coef, shift = np.zeros((len(n), int(np.max(warm, where=lpc, initial=1))), np.int64), np.zeros(len(n), np.int64)
    for o in np.unique(warm[lpc]).tolist():
        mine = np.flatnonzero(lpc & (warm == o))
        precision = take(mine, 4) + 1
        shift[mine] = take(mine, 5)
        for width in np.unique(precision).tolist():
            some = mine[precision == width]
            for j in range(o):
                c = take(some, width)
                coef[some, j] = np.where(c >> (width - 1), c - (1 << width), c)
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        if (take(coded, 6) != 0).any():
            raise ValueError("only one Rice partition of 4-bit parameters is stored here")
        k = take(coded, 4)
        if (k == 15).any():
            raise ValueError("escaped partitions are not stored here")
        todo = n[coded] - warm[coded]
        by = np.argsort(-todo, kind="stable")
        rows, todo, k = coded[by], todo[by], k[by]
        p, ku, first = pos[rows], k.astype(np.uint64), warm[rows]
        res = np.zeros((int(todo.max(initial=0)), len(rows)), np.int64)
        live = np.searchsorted(-todo, -np.arange(len(res)), "left")
        one = np.uint64(1)
        for i, m in enumerate(live.tolist()):
            w = peek(p[:m])
            top = w >> np.uint64(32)
            zeros = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            far = None
            if not top.all():
                far, bit = np.zeros(m, np.int64), p[:m].copy()
                while len(long := np.flatnonzero(peek(bit) >> np.uint64(32) == 0)):
                    bit[long] += 32
                    far[long] += 32
                    if (bit[long] >> 3 >= len(data) - 8).any():
                        raise ValueError("a frame breaks off")
                w = peek(bit)
                zeros = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            km = ku[:m]
            rest = (w << (zeros.astype(np.uint64) + one)) >> one >> (np.uint64(63) - km)
            if far is not None:
                zeros = zeros + far
            u = zeros << k[:m] | rest.astype(np.int64)
            res[i, :m] = u >> 1 ^ -(u & 1)
            p[:m] += zeros + 1 + k[:m]
        pos[rows] = p
        for o in range(ORDERS):
            mine = np.flatnonzero(fixed[rows] & (first == o))
            if len(mine):
                # undo o differences: each level starts at the warm-up's own difference
                warmup = out[rows[mine], :o].T
                d, level, levels = res[: out.shape[1] - o, mine], warmup, []
                for _ in range(o):
                    levels.append(level[-1:])
                    level = np.diff(level, axis=0)
                for start in reversed(levels):
                    d = start + np.cumsum(d, axis=0)
                out[rows[mine], o : o + len(d)] = d.T
        for o in np.unique(first[lpc[rows]]).tolist():
            # frames of one order go side by side, the longest first, a sample of each at a step
            mine = np.flatnonzero(lpc[rows] & (first == o))
            c, by, size = coef[rows[mine], :o].T[::-1].copy(), shift[rows[mine]], todo[mine]
            x, r = np.ascontiguousarray(out[rows[mine]].T), res[:, mine]
            for i, m in enumerate(np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left").tolist()):
                x[o + i, :m] = r[i, :m] + (np.einsum("jm,jm->m", c[:, :m], x[i : o + i, :m]) >> by[:m])
            out[rows[mine]] = x.T
    ends = np.empty(len(n), np.int64)
    ends[order] = (pos + 7 >> 3) + 2
    back = np.argsort(order)
    if (ends > len(data) - 16).any():
        raise ValueError("a frame breaks off")
    stored = data[ends - 2].astype(np.uint16) << np.uint16(8) | data[ends - 1]
    if (crc16(data, at, ends - 2) != stored).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return [out[b, :m] for b, m in zip(back.tolist(), sizes.tolist(), strict=True)], ends


def decode(medias: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks (sample offset, signed samples) of each stream, verified."""
    streams = [Stream(m) for m in medias]
    data = np.frombuffer(b"".join(medias) + bytes(16), np.uint8)
    base = np.cumsum([0, *map(len, medias)])
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in medias]
    ready = [i for i, s in enumerate(streams) if s.full]
    if ready:
        at = np.concatenate([base[i] + streams[i].frames + streams[i].seek["offset"].astype(np.int64) for i in ready])
        found = [x for k in range(0, len(at), AT_ONCE) for x in _decode_frames(data, at[k : k + AT_ONCE])[0]]
        f = 0
        for i in ready:
            offset = 0
            for x in found[f : f + len(streams[i].seek)]:
                blocks[i].append((offset, x))
                offset += len(x)
            f += len(streams[i].seek)
    rest = [(i, int(base[i]) + s.frames, 0) for i, s in enumerate(streams) if not s.full]
    while rest:
        found, ends = _decode_frames(data, np.array([a for _, a, _ in rest]))
        for (i, _, offset), x in zip(rest, found, strict=True):
            blocks[i].append((offset, x))
        rest = [(i, int(e), o + len(x)) for (i, _, o), x, e in zip(rest, found, ends, strict=True) if o + len(x) < streams[i].total]
    for s, found in zip(streams, blocks, strict=True):
        pcm = b"".join(x.astype(np.int8).tobytes() for _, x in found)
        if len(pcm) != s.total or hashlib.md5(pcm).digest() != s.md5:
            raise ValueError("the samples are not those of the stream's MD5")
    return blocks


class Pcm:
    """Written PCM blocks of one stream (signed 8-bit samples) and the sample offset of each, which a reader seeks by."""

    def __init__(self, blocks: list[tuple[int, np.ndarray]]):
        self.offsets = np.array([o for o, _ in blocks], np.int64)
        self.blocks = [x.astype(np.int8).tobytes() for _, x in blocks]
        self.total = int(self.offsets[-1]) + len(self.blocks[-1])
        if (np.cumsum([0, *map(len, self.blocks[:-1])]) != self.offsets).any():
            raise ValueError("blocks don't follow each other")

    def read(self, start: int, count: int) -> bytes:
        """The payload's bytes of so many samples from one on; only the blocks that hold them are touched."""
        at = int(np.searchsorted(self.offsets, start, "right")) - 1
        skip = start - int(self.offsets[at])
        end = int(np.searchsorted(self.offsets, start + count, "left"))
        joined = b"".join(self.blocks[at:end])[skip : skip + count]
        return (np.frombuffer(joined, np.uint8) ^ 0x80).tobytes()


def payload_of(blocks: list[tuple[int, np.ndarray]]) -> bytes:
    pcm = Pcm(blocks)
    return pcm.read(0, pcm.total)


def padded(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD if text else PAD)


def features(payload: bytes) -> str:
    """Length, sum, energy, crossings of the mean and peak of the decoded samples, as exact integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    above = x * len(x) > x.sum()
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(above[1:] != above[:-1])};peak={np.abs(x).max()}"


def _parts(sizes: list[int], most: int = SLICE) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs (doc_id, text) as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            for part in _parts([len(r) for r in raw], 2 * SLICE):
                media = encode([padded(r) for r in raw[part]], lpc_order=LPC_ORDER)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array([len(r) for r in raw[part]], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return _bytes(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, pcm) of (doc_id, n_bytes, media): seekable blocks of signed 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, stored = b.column(0).to_pylist(), b.column(2).to_pylist()
            for part in _parts([len(m) for m in stored], 3 * SLICE):
                rows = [(i, n, o, x.astype(np.int8).tobytes()) for i, found in zip(ids[part], decode(stored[part]), strict=True) for n, (o, x) in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "block", "sample_offset", "pcm"])

    return media.mapInArrow(run, "doc_id long, block long, sample_offset long, pcm binary")


def read_back(media: DataFrame) -> DataFrame:
    """Per row of (doc_id, n_bytes, media): digests and features of what the stored bytes decode to."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored = b.column(2).to_pylist()
            for part in _parts([len(m) for m in stored], 3 * SLICE):
                pcm = [Pcm(x) for x in decode(stored[part])]
                got = [x.read(0, x.total) for x in pcm]
                cols = [
                    pa.array([len(p) for p in got], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in got]),
                    pa.array([zlib.crc32(x.read(x.total - PAD, PAD)) for x in pcm], pa.int64()), pa.array([len(m) for m in stored[part]], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in stored[part]]), pa.array([features(p) for p in got]),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], *cols], names)

    return media.mapInArrow(run, schema)
