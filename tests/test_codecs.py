import random
import time

import numpy as np
import pytest

from chronolith.functions import codec


def tile(rng, kind, w, h):
    if kind == "flat":
        px = np.tile(rng.integers(0, 256, 4, dtype=np.uint8), (h, w, 1))
    elif kind == "noise":
        px = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
    elif kind == "smooth":
        px = (np.cumsum(rng.integers(-3, 3, (h * w, 4)), 0) % 256).astype(np.uint8).reshape(h, w, 4)
    else:
        px = rng.choice(np.array([[0, 0, 0, 255], [0, 0, 0, 0], [9, 9, 9, 255], [200, 30, 60, 255]], np.uint8), (h, w))
    if kind != "noise":
        px[..., 3] = 255 if rng.random() < 0.8 else px[..., 3]
    return w, h, px.tobytes()


def many(seed, n=300):
    rng = np.random.default_rng(seed)
    return [tile(rng, rng.choice(["flat", "noise", "smooth", "few"]), int(rng.choice([1, 2, 22, 64, 63])), int(rng.choice([1, 3, 64, 0]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_lanes_give_the_bytes_of_the_plain_codec(seed):
    tiles = many(seed)
    for c in (1, 2, 3):
        streams = codec.encode_many(c, tiles)
        assert streams == [codec.encode(c, *t) for t in tiles]
        assert codec.decode_many([c] * len(tiles), streams) == [codec.decode(c, s) for s in streams]
    assert codec.encode_many(1, []) == [] and codec.decode_many([], []) == []


def test_broken_streams_are_none_and_harm_no_other():
    rnd, tiles = random.Random(5), [t for t in many(7) if t[1]]
    streams = codec.encode_many(1, tiles)
    spoilt, good = [], []
    for n, s in enumerate(streams):
        kind = rnd.randrange(5)
        cut = rnd.randrange(14, len(s) - 8)
        huge = s[:4] + b"\xff" * 8 + s[12:]
        spoilt.append([s, s[:cut], b"", b"none" + s, huge][kind])
        good += [n] if kind == 0 else []
    found = codec.decode_many([1] * len(spoilt), spoilt)
    for n, (got, s) in enumerate(zip(found, spoilt)):
        if n in good:
            assert got == tiles[n]
        else:
            assert got is None, n
    assert codec.decode_many([3, 3], [b"\x00junk", codec.encode(3, *tiles[0])]) == [None, tiles[0]]


def test_a_run_past_the_last_pixel_is_broken():
    data = codec.qoi_encode(8, 8, bytes([0, 0, 0, 255]) * 64)
    assert codec.qoi_decode_many([data.replace(b"\xc1", b"\xc5", 1)]) == [None] and codec.qoi_decode_many([data])[0][:2] == (8, 8)


def test_lanes_are_faster():
    tiles = [tile(np.random.default_rng(n), "smooth" if n % 2 else "few", 64, 64) for n in range(256)]

    def took(f):
        began = time.thread_time()
        out = f()
        return time.thread_time() - began, out

    slow, plain = took(lambda: [codec.qoi_encode(*t) for t in tiles[:64]])
    fast, streams = took(lambda: codec.qoi_encode_many(tiles))
    assert streams[:64] == plain and slow / 64 > 2 * fast / 256  # about 7 on an idle processor
    slow, _ = took(lambda: [codec.qoi_decode(s) for s in streams[:64]])
    fast, back = took(lambda: codec.qoi_decode_many(streams))
    assert back == tiles and slow / 64 > 1.5 * fast / 256  # about 6
