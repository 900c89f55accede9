"""Hashes and the QOI image codec for tiles of BGRA bytes. Use them after deduplication: they are Python."""

import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F


#: What a broken stream may raise.
BROKEN = (zlib.error, struct.error)


def tile_hash_of(width: int, height: int, bgra: bytes) -> int:
    """Signed bit pattern of XXH3-64 over width, height (16 bits each) and pixels; 0 becomes 1."""
    h = xxhash.xxh3_64_intdigest(struct.pack("<HH", width, height) + bgra) or 1
    return h - (1 << 64) if h >> 63 else h


def window_id_of(process: str, title: str) -> int:
    """XXH32 of process (lower case) and title; nothing known: 0, and 0 becomes 1."""
    if not process and not title:
        return 0
    return xxhash.xxh32_intdigest(f"{(process or '').lower()}|{title or ''}".encode()) or 1


def window_id(process, title):
    """Column of window_id_of, over Arrow batches; use it on distinct pairs."""
    import pandas as pd

    @F.pandas_udf("long")
    def ids(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([window_id_of(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="int64")

    return ids(process, title)


def tile_hash(width, height, bgra):
    import pandas as pd

    @F.pandas_udf("long")
    def run(w: pd.Series, h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tile_hash_of(*x) for x in zip(w, h, b)])

    return run(width, height, bgra)


def rgb565(bgra: bytes) -> bytes:
    """Pixels cut to 5, 6 and 5 bits."""
    return (np.frombuffer(bgra, np.uint8).reshape(-1, 4) & np.array([0xF8, 0xFC, 0xF8, 0xFF], np.uint8)).tobytes()


def qoi_encode(width: int, height: int, bgra: bytes) -> bytes:
    """A QOI stream (public format, four channels) of BGRA pixels."""
    out = bytearray(b"qoif" + struct.pack(">IIBB", width, height, 4, 0))
    seen, before, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for b, g, r, a in zip(*(bgra[i::4] for i in range(4))):
        px = (r, g, b, a)
        if px == before:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (r * 3 + g * 5 + b * 7 + a * 11) % 64
        if seen[slot] == px:
            out.append(slot)
        else:
            seen[slot] = px
            if a == before[3]:
                dr, dg, db = ((x - y + 128) % 256 - 128 for x, y in zip(px[:3], before))
                if -2 <= dr <= 1 and -2 <= dg <= 1 and -2 <= db <= 1:
                    out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
                elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                    out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
                else:
                    out += bytes((0xFE, r, g, b))
            else:
                out += bytes((0xFF, r, g, b, a))
        before = px
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + b"\0" * 7 + b"\1"


def qoi_decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and BGRA pixels of a QOI stream."""
    if data[:4] != b"qoif":
        raise ValueError("no QOI stream")
    width, height = struct.unpack(">II", data[4:12])
    out, seen, px, at = bytearray(), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14
    while len(out) < width * height * 4:
        tag, n = data[at], 1
        at += 1
        r, g, b, a = px
        if tag == 0xFE:
            px, at = (*data[at : at + 3], a), at + 3
        elif tag == 0xFF:
            px, at = tuple(data[at : at + 4]), at + 4
        elif tag >> 6 == 0:
            px = seen[tag]
        elif tag >> 6 == 1:
            px = ((r + (tag >> 4 & 3) - 2) % 256, (g + (tag >> 2 & 3) - 2) % 256, (b + (tag & 3) - 2) % 256, a)
        elif tag >> 6 == 2:
            dg, low, at = (tag & 63) - 32, data[at], at + 1
            px = ((r + dg + (low >> 4) - 8) % 256, (g + dg) % 256, (b + dg + (low & 15) - 8) % 256, a)
        else:
            n = (tag & 63) + 1
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out += bytes((px[2], px[1], px[0], px[3])) * n
    return width, height, bytes(out)


def encode(codec: int, width: int, height: int, bgra: bytes) -> bytes:
    """Codec 1: QOI; 2: QOI of pixels cut to RGB565; 3: deflated QOI."""
    data = qoi_encode(width, height, rgb565(bgra) if codec == 2 else bgra)
    return zlib.compress(data)[2:-4] if codec == 3 else data


def decode(codec: int, data: bytes) -> tuple[int, int, bytes]:
    return qoi_decode(zlib.decompress(data, -15) if codec == 3 else data)


#: Tiles decoded side by side; tiles encoded at once, whose pixels fit a processor's cache (1024 at most, for 16-bit keys).
LANES, GROUP = 1024, 64
_INDEX, _DIFF, _LUMA, _RUN, _RGB, _RGBA = range(6)


def _tags() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By a tag's byte: its kind, its length, what it adds to a pixel (RGBA), and what the byte after a luma tag adds."""
    n = np.arange(256)
    kind = np.select([n == 0xFE, n == 0xFF], [_RGB, _RGBA], n >> 6)  # the first four kinds are a tag's two upper bits
    step = np.zeros((256, 4), np.int64)
    for at, shift in ((2, 0), (1, 2), (0, 4)):
        step[:, at] = np.where(kind == _DIFF, (n >> shift & 3) - 2, np.where(kind == _LUMA, (n & 63) - 32, 0))
    after = np.stack([(n >> 4) - 8, 0 * n, (n & 15) - 8, 0 * n], 1)
    words = [x.astype(np.uint8).view("<u4").ravel() for x in (step, after)]
    return kind.astype(np.uint8), np.array([1, 1, 2, 1, 4, 5])[kind], *words


def qoi_decode_many(streams: list[bytes]) -> list[tuple[int, int, bytes] | None]:
    """qoi_decode of many streams, a tag of each at a time; None for one that is broken, cut short or too long."""
    out: list = [None] * len(streams)
    good = [i for i, s in enumerate(streams) if len(s) >= 14 and s[:4] == b"qoif"]
    for at in range(0, len(good), LANES):
        some = sorted(good[at : at + LANES], key=lambda i: -len(streams[i]))  # long ones first: those that end go from the back
        for i, pixels in zip(some, _decoded([streams[i] for i in some])):
            if pixels is not None:
                out[i] = (*struct.unpack(">II", streams[i][4:12]), pixels.tobytes())
    return out


def _decoded(streams: list[bytes]) -> list[np.ndarray | None]:
    """Pixels (BGRA) of streams whose heads are in order. A pixel is one number, red in its lowest byte."""
    kinds, lengths, steps, afters = _tags()
    sizes = np.array([len(s) for s in streams])
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    words = np.ndarray(len(data) - 3, "<u4", data, 0, (1,))  # the four bytes from each place on
    ends = np.cumsum(sizes)
    at, lane, slots = ends - sizes + 14, np.arange(len(streams), dtype=np.uint16), np.arange(len(streams)) * 64
    left = np.array([min(62 * len(s) + 1, int.from_bytes(s[4:8]) * int.from_bytes(s[8:12])) for s in streams])
    seen = np.zeros(len(streams) * 64, np.uint32)
    pixel = np.full(len(streams), 0xFF000000, np.uint32)
    low, red, green = np.uint32(0x00FF00FF), np.uint32(3 << 16 | 7), np.uint32(5 << 16 | 11)
    bad = np.zeros(len(streams), bool)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ones = np.ones(len(streams), np.uint8)
    while len(lane):
        alive = (left > 0) & (at < ends)
        if not alive.all():
            bad[lane[~alive & ((left != 0) | (at > ends))]] = True
            lane, slots, at, ends, left, pixel, ones = lane[alive], slots[alive], at[alive], ends[alive], left[alive], pixel[alive], ones[alive]
            if not len(lane):
                break
        tag = data[at]
        kind = kinds[tag]
        pixel = (pixel.view(np.uint8) + steps[tag].view(np.uint8)).view(np.uint32)
        if len(some := np.flatnonzero(kind == _LUMA)):
            pixel[some] = (pixel[some].view(np.uint8) + afters[data[at[some] + 1]].view(np.uint8)).view(np.uint32)
        if len(some := np.flatnonzero(kind >= _RGB)):
            keep = np.where(kind[some] == _RGB, np.uint32(0xFF000000), np.uint32(0))
            pixel[some] = words[at[some] + 1] & ~keep | pixel[some] & keep
        if len(some := np.flatnonzero(kind == _INDEX)):
            pixel[some] = seen[slots[some] + tag[some]]
        seen[slots + (((pixel & low) * red + (pixel >> 8 & low) * green) >> 16 & 63)] = pixel
        runs = kind == _RUN
        count = np.where(runs, (tag & 63) + 1, ones) if runs.any() else ones
        made.append((lane, pixel, count))
        left, at = left - count, at + lengths[tag]
    if not made:
        return [None if b else np.zeros(0, np.uint32) for b in bad]
    lanes, values, counts = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(lanes, kind="stable")
    values = values[order]
    values = values & np.uint32(0xFF00FF00) | values >> 16 & np.uint32(255) | (values & np.uint32(255)) << 16
    pixels = np.repeat(values, counts[order])
    found = np.bincount(lanes, counts, len(streams)).astype(np.int64)
    begins = np.cumsum(found) - found
    return [None if b else pixels[a : a + n] for b, a, n in zip(bad.tolist(), begins.tolist(), found.tolist())]


def qoi_encode_many(tiles: list[tuple[int, int, bytes]]) -> list[bytes]:
    """qoi_encode of many tiles (width, height, BGRA): all pixels of all tiles at once."""
    return [s for at in range(0, len(tiles), GROUP) for s in _encoded(tiles[at : at + GROUP])]


def _encoded(tiles: list[tuple[int, int, bytes]]) -> list[bytes]:
    px = np.frombuffer(b"".join(t[2] for t in tiles), np.uint8).reshape(-1, 4)
    flat, counts = px.view(np.uint32).ravel(), np.array([len(t[2]) // 4 for t in tiles])
    ends = np.cumsum(counts)
    begins = (ends - counts)[counts > 0]
    before = np.empty_like(flat)
    before[1:], before[begins] = flat[:-1], 0xFF000000
    same = flat == before
    # runs: a byte at every 62nd pixel of one and at its end
    at = np.arange(len(flat), dtype=np.int32)
    since = np.where(same, np.int32(-1), at)
    since[begins] = np.maximum(since[begins], begins - 1)
    length = at - np.maximum.accumulate(since) if len(at) else at
    last = np.ones(len(flat), bool)
    last[:-1] = ~same[1:]
    last[ends[counts > 0] - 1] = True
    run = np.flatnonzero(same & ((length % 62 == 0) | last))
    # other pixels: the last one of its slot in its tile, a small step, a larger one, or the pixel itself; bytes wrap around
    fresh = np.flatnonzero(~same)
    now = flat[fresh]
    b, g, r, a = np.ascontiguousarray(now.view(np.uint8).reshape(-1, 4).T)
    slot = r * np.uint8(3) + g * np.uint8(5) + b * np.uint8(7) + a * np.uint8(11) & np.uint8(63)
    owner = np.searchsorted(ends, fresh, "right").astype(np.uint16)
    key = owner * np.uint16(64) + slot
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_now = key[order], now[order]
    held = np.zeros(len(fresh), np.uint32)
    held[1:] = np.where(sorted_key[1:] == sorted_key[:-1], sorted_now[:-1], np.uint32(0))
    index = np.empty(len(fresh), bool)
    index[order] = held == sorted_now
    db, dg, dr, da = np.ascontiguousarray((now.view(np.uint8) - before[fresh].view(np.uint8)).reshape(-1, 4).T)
    rest = ~index & (da == 0)
    diff = rest & (db + np.uint8(2) < 4) & (dg + np.uint8(2) < 4) & (dr + np.uint8(2) < 4)
    luma = rest & ~diff & (dg + np.uint8(32) < 64) & (dr - dg + np.uint8(8) < 16) & (db - dg + np.uint8(8) < 16)
    rgb, rgba = rest & ~diff & ~luma, ~index & (da != 0)
    sizes = np.zeros(len(flat), np.uint8)
    sizes[run] = 1
    sizes[fresh] = 1 + luma + rgb * np.uint8(3) + rgba * np.uint8(4)
    total = np.cumsum(sizes, dtype=np.int64)
    out = np.zeros(int(total[-1]) if len(total) else 0, np.uint8)
    out[total[run] - 1] = 0xC0 | (length[run] - 1) % 62
    to = total[fresh] - sizes[fresh]
    out[to[index]] = slot[index]
    some = np.flatnonzero(diff)
    out[to[some]] = 0x40 | dr[some] + np.uint8(2) << 4 | dg[some] + np.uint8(2) << 2 | db[some] + np.uint8(2)
    some = np.flatnonzero(luma)
    out[to[some]] = 0x80 | dg[some] + np.uint8(32)
    out[to[some] + 1] = dr[some] - dg[some] + np.uint8(8) << 4 | db[some] - dg[some] + np.uint8(8)
    for some, tag, parts in ((rgb, 0xFE, (r, g, b)), (rgba, 0xFF, (r, g, b, a))):
        if len(some := np.flatnonzero(some)):
            place = to[some]
            out[place] = tag
            for n, channel in enumerate(parts, 1):
                out[place + n] = channel[some]
    bounds = [0, *(int(total[e - 1]) if e else 0 for e in ends.tolist())]
    return [b"qoif" + struct.pack(">IIBB", w, h, 4, 0) + out[x:y].tobytes() + bytes(7) + b"\1" for (w, h, _), x, y in zip(tiles, bounds, bounds[1:])]


def decode_many(codecs: list[int], payloads: list[bytes]) -> list[tuple[int, int, bytes] | None]:
    """decode of many payloads side by side; None for one that can't be decoded."""
    streams = []
    for codec, data in zip(codecs, payloads):
        try:
            streams.append(zlib.decompress(data, -15) if codec == 3 else data)
        except zlib.error:
            streams.append(b"")
    return qoi_decode_many(streams)


def encode_many(codec: int, tiles: list[tuple[int, int, bytes]]) -> list[bytes]:
    """encode of many tiles (width, height, BGRA) side by side."""
    streams = qoi_encode_many([(w, h, rgb565(p)) for w, h, p in tiles] if codec == 2 else tiles)
    return [zlib.compress(s)[2:-4] for s in streams] if codec == 3 else streams


def blend(src: np.ndarray, dst: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """(s * a + d * (255 - a) + 127) / 255 in whole numbers."""
    s, d, a = (x.astype(np.int64) for x in (src, dst, alpha))
    return ((s * a + d * (255 - a) + 127) // 255).astype(np.uint8)


def png(width: int, height: int, bgra: bytes) -> bytes:
    """An opaque PNG image (public format, eight bits, RGBA)."""
    rows = np.frombuffer(bgra, np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]].copy()
    rows[:, :, 3] = 255
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, width * 4)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
