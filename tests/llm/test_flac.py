import hashlib
import os
import zlib

import numpy as np
import pytest

from meshwork.llm import flac

PAYLOADS = [os.urandom(n) for n in (1, 2, 3, 5, 64, 100, 1024, 1025, 5000)] + [b"\0" * 64, b"a" * 5000, bytes(1023) + b"\xff" * 3, b"\0\xff" * 700, bytes([128]) * 500 + b"\xff" + bytes([128]) * 600, b"ab" * 3, bytes(range(256)) * 9, b"the cat sat on the mat. " * 900]


def bare(media):
    """A stream without its seek table."""
    s = flac.Stream(media)
    return media[:4] + b"\x80" + media[5:42] + media[s.frames :]


@pytest.mark.parametrize("lpc", [0, 1, 4, 8])
def test_round_trip(lpc):
    media = flac.encode(PAYLOADS, lpc_order=lpc)
    assert [flac.payload_of(b) for b in flac.decode(media)] == PAYLOADS
    assert [flac.payload_of(b) for b in flac.decode([bare(m) for m in media])] == PAYLOADS
    for blocks, p in zip(flac.decode(media), PAYLOADS, strict=True):
        for offset, x in blocks:
            assert (x + 128).astype(np.uint8).tobytes() == p[offset : offset + len(x)]


class Bits:
    def __init__(self, data, at):
        self.n, self.at, self.end = int.from_bytes(data, "big"), 8 * at, 8 * len(data)

    def take(self, width):
        self.at += width
        return self.n >> (self.end - self.at) & (1 << width) - 1

    def signed(self, width):
        v = self.take(width)
        return v - (1 << width) if v >> (width - 1) else v


def crc(data, poly, width):
    v = 0
    for byte in data:
        v ^= byte << (width - 8)
        for _ in range(8):
            v = (v << 1 ^ poly if v >> (width - 1) & 1 else v << 1) & (1 << width) - 1
    return v


def slow_decode(media, seen):
    """A decoder of its own, bit by bit, from the format's description: samples of an 8-bit mono stream."""
    assert media[:4] == b"fLaC"
    at, last, out = 4, 0, []
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        if kind == 0:
            info = media[at + 4 : at + 4 + size]
            total, md5 = int.from_bytes(info[13:18], "big") & (1 << 36) - 1, info[18:34]
            assert int.from_bytes(info[10:13], "big") >> 4 == 8000 and (info[12] & 1) << 4 | info[13] >> 4 == 7
        at += 4 + size
    while at < len(media):
        b = Bits(media[at : at + 20_000], 0)
        assert b.take(14) == 0b11111111111110 and b.take(2) == 0
        sizes, rate = b.take(4), b.take(4)
        assert (rate, b.take(4), b.take(3), b.take(1)) == (rate, 0, 1, 0)
        lead = b.take(8)
        more = 0 if lead < 0x80 else format(lead, "08b").index("0") - 1 if lead != 0xFF else None
        number = lead if not more else lead & (1 << (6 - more)) - 1
        for _ in range(more):
            number = number << 6 | b.take(8) & 63
        n = {6: lambda: b.take(8) + 1, 7: lambda: b.take(16) + 1}[sizes]()
        assert rate not in (12, 13, 14)
        assert b.take(8) == crc(media[at : at + b.at // 8 - 1], 0x07, 8)
        assert b.take(1) == 0
        kind, wasted = b.take(6), b.take(1)
        assert wasted == 0 and number * 1024 == len(out)
        x = []
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(8) for _ in range(order)]
            if kind >= 32:
                width, shift = b.take(4) + 1, b.signed(5)
                coef = [b.signed(width) for _ in range(order)]
            else:
                coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            assert b.take(2) == 0
            parts = 1 << b.take(4)
            for p in range(parts):
                k = b.take(4)
                assert k != 15
                for _ in range(n // parts - (order if p == 0 else 0)):
                    q = 0
                    while not b.take(1):
                        q += 1
                    u = q << k | b.take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(coef, reversed(x[-order:] if order else []))) >> shift))
        seen.add("constant" if kind == 0 else "verbatim" if kind == 1 else "lpc" if kind >= 32 else "fixed")
        end = at + (b.at + 7) // 8
        assert int.from_bytes(media[end : end + 2], "big") == crc(media[at:end], 0x8005, 16)
        out += x
        at = end + 2
    pcm = bytes(v & 255 for v in out)
    assert len(out) == total and hashlib.md5(pcm).digest() == md5
    return bytes(v + 128 for v in out)


def test_an_independent_decoder_reads_what_is_written():
    """Every kind of subframe, and documents as the query stores them."""
    tone = bytes(int(128 + 90 * np.sin(i / 9) + 20 * np.sin(i / 2.3)) for i in range(3000))
    texts = [b"It is a truth universally acknowledged, that words follow words. " * 30, "é ü ß 日本 ".encode() * 120, b"x", b""]
    seen = set()
    for p in [*PAYLOADS, tone, *map(flac.padded, texts)]:
        assert slow_decode(flac.encode([p], lpc_order=flac.LPC_ORDER)[0], seen) == p
        assert slow_decode(flac.encode([p])[0], seen) == p
    assert seen == {"constant", "verbatim", "fixed", "lpc"}


def test_blocks_are_read_by_their_offsets():
    p = bytes(i * 7 % 256 for i in range(5000))
    pcm = flac.Pcm(flac.decode(flac.encode([p], lpc_order=4))[0])
    for a, n in ((0, 5000), (0, 1), (1023, 2), (1024, 1024), (4936, 64), (3000, 0), (4999, 1)):
        assert pcm.read(a, n) == p[a : a + n]
    with pytest.raises(ValueError):
        flac.Pcm([(0, np.zeros(5)), (6, np.zeros(5))])


def test_long_payloads_go_piece_by_piece(monkeypatch):
    p = [os.urandom(20_000) + b"words and more words " * 3000, b"short"]
    whole = flac.encode(p, block=64)
    monkeypatch.setattr(flac, "SLICE", 4096)
    monkeypatch.setattr(flac, "AT_ONCE", 100)
    assert flac.encode(p, block=64) == whole and [flac.payload_of(b) for b in flac.decode(whole)] == p


def test_checksums():
    assert flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9])).tolist() == [0xFEE8]
    media = bytearray(flac.encode([b"some words of text, " * 200])[0])
    s = flac.Stream(bytes(media))
    for at in (s.frames + 1, s.frames + 40, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([bytes(media[:-300])])
    with pytest.raises(ValueError):
        flac.encode([b""])


def test_coded_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 0x1FFFFF, 0x200000, 0x7FFFFFFF):
        b = flac._coded_number(n)
        if n < 0x110000 and not 0xD800 <= n < 0xE000:
            assert b == chr(n).encode()
        assert len(b) == (1 if n < 128 else next(k for k in range(2, 8) if n < 1 << (5 * k + 1)))


def test_rows(spark):
    rows = [(1, "text of some length " * 30), (2, None), (3, ""), (4, "x" * 64), (None, "é😀"), (5, "y" * 200_000), (1, "text of some length " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes")
    media = flac.store(df)
    out = sorted(flac.read_back(media).collect(), key=repr)
    want = []
    for i, t in rows:
        p = flac.padded((t or "").encode())
        m = flac.encode([p], lpc_order=flac.LPC_ORDER)[0]
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), flac.features(p)))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    blocks = flac.pcm_blocks(media).where("doc_id = 5").orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == list(range(0, 200_000, flac.BLOCK)) and sum(len(b.pcm) for b in blocks) == 200_000
    assert flac.read_back(flac.store(df.limit(0))).count() == 0 and flac.pcm_blocks(flac.store(df.limit(0))).count() == 0
