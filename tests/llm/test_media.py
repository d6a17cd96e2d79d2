import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from walkloom.llm import jpeg
from walkloom.llm.jpeg import Progressive, coefficients_to_payload, encode_payload
from walkloom.llm.media import decode_file, decode_media, encode_media


class BitByBit(Progressive):
    def _at_once(self, *a):
        return False


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 20), st.randoms())
def test_round_trip(blocks, rng):
    payload = bytes(rng.choices([0, 1, 127, 128, 254, 255, *range(256)], k=64 * blocks))
    data = encode_payload(payload, b"bytes=1")
    fast, slow = Progressive(data), BitByBit(data)
    assert coefficients_to_payload(fast)[: len(payload)] == payload
    assert all((a == b).all() for a, b in zip(fast.coefficients, slow.coefficients, strict=True))


def write_general(coef: np.ndarray) -> bytes:
    """A grey progressive file with runs of zeros, end-of-band runs and refinements, by an encoder of the test's own."""
    seg, bits = jpeg._segment, []
    ac = {s: n for n, s in ((4, 0x00), (4, 0x01), (4, 0x02), (4, 0x03), (5, 0x11), (5, 0x21), (5, 0x12), (6, 0x10), (6, 0x20), (6, 0xF0), (7, 0x31), (7, 0x41))} | {s: 12 for s in range(256) if s & 15 in (0, 1, 2, 3, 4, 5, 6) and s not in (0x00, 0x01, 0x02, 0x03, 0x11, 0x21, 0x12, 0x10, 0x20, 0xF0, 0x31, 0x41)}
    table = jpeg._table(ac)
    code = jpeg.canonical(*table)
    dc = jpeg._table(dict.fromkeys(range(12), 4))
    dcode = jpeg.canonical(*dc)

    def put(v, n):
        bits.extend(v >> (n - 1 - i) & 1 for i in range(n))

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        out = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
        bits.clear()
        return out

    def value(v, n):
        put(v if v > 0 else v + (1 << n) - 1, n)

    flat = coef.reshape(-1, 64)
    last = 0
    for d in flat[:, 0] >> 1:
        n = abs(int(d - last)).bit_length()
        put(*dcode[n])
        if n:
            value(int(d - last), n)
        last = d
    scans = [jpeg._scan(1, 0x00, 0, 0, 0, 1, flush())]
    for d in flat[:, 0] & 1:
        put(int(d), 1)
    scans.append(jpeg._scan(1, 0x00, 0, 0, 1, 0, flush()))
    top = np.sign(flat) * (np.abs(flat) >> 1)
    run = 0

    def end_run():
        nonlocal run
        if run:
            k = run.bit_length() - 1
            put(*code[k << 4])
            put(run - (1 << k), k) if k else None
            run = 0

    for b in top:
        zeros = 0
        for k in range(1, 64):
            v = int(b[k])
            if not v:
                zeros += 1
                continue
            end_run()
            while zeros > 15:
                put(*code[0xF0])
                zeros -= 16
            n = abs(v).bit_length()
            put(*code[zeros << 4 | n])
            value(v, n)
            zeros = 0
        run += zeros > 0
    end_run()
    scans.append(jpeg._scan(1, 0x00, 1, 63, 0, 1, flush()))
    for b, old in zip(flat, top, strict=True):
        zeros, fix = 0, []
        news = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        for k in range(1, 64):
            if old[k]:
                fix.append(abs(int(b[k])) & 1)
            elif k in news:
                put(*code[zeros << 4 | 1])
                put(int(b[k] > 0), 1)
                bits.extend(fix)
                zeros, fix, news = 0, [], news[1:]
            else:
                zeros += 1
                if zeros == 16 and news:
                    put(*code[0xF0])
                    bits.extend(fix)
                    zeros, fix = 0, []
        if zeros or fix:
            put(*code[0x00])
            bits.extend(fix)
    scans.append(jpeg._scan(1, 0x00, 1, 63, 1, 0, flush()))
    rows, cols, _ = coef.shape
    frame = b"\x08" + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    head = b"\xff\xd8" + jpeg._HEAD + seg(0xC2, frame) + seg(0xC4, b"\x00" + b"".join(dc)) + seg(0xC4, b"\x10" + b"".join(table))
    return head + b"".join(scans) + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(4))
def test_general_scans(seed):
    rng = np.random.default_rng(seed)
    coef = np.where(rng.random((3, 4, 64)) < (0.08, 0.3, 0.02, 0.6)[seed], rng.integers(-40, 41, (3, 4, 64)), 0).astype(np.int32)
    coef[:, :, 0] = rng.integers(-500, 500, (3, 4))
    got = Progressive(write_general(coef))
    assert (got.coefficients[0] == coef).all()


def test_transform_and_colour():
    c = np.zeros((1, 1, 64), np.int32)
    c[0, 0, :3] = 80, 30, -20
    pix = Progressive(write_general(c)).planes()[0]
    x = np.arange(8)
    want = 80 / 8 + 30 / 4 / np.sqrt(2) * np.cos((2 * x[None, :] + 1) * np.pi / 16) - 20 / 4 / np.sqrt(2) * np.cos((2 * x[:, None] + 1) * np.pi / 16)
    assert np.abs(pix - 128 - want).max() < 1e-3
    rgb = Progressive(encode_payload(bytes(64 * 7))).rgb()
    assert rgb.shape == (16, 32, 3) and rgb.dtype == np.uint8


def test_media_columns(spark):
    texts = ["", None, "a", "é" * 100, "x" * 64, "long " * 5000, "a"]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)] + [(None, "a", b"")], "doc_id long, text string, media binary")
    got = decode_media(encode_media(df)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        b = ("a" if r.id is None else texts[r.id] or "").encode()
        pad = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, bytes(r.payload)) == (len(b), pad) and len(r.rgb) == r.height * r.width * 3
        assert zlib.crc32(bytes(r.payload)[-64:]) == zlib.crc32(pad[-64:])
    same = {(hashlib.sha256(r.media).hexdigest(), r.feature) for r in got if r.id in (2, 6, None)}
    assert len(same) == 1
    broken = spark.createDataFrame([(1, None), (2, b"\xff\xd8nothing"), (3, b"")], "id long, media binary")
    assert all(r.payload is None and r.rgb is None for r in decode_media(broken).collect())
    assert decode_media(encode_media(df.limit(0))).count() == 0


def test_damaged_files_give_nulls():
    """Cut, overwritten, spliced and lengthened files of both kinds of scans: a result or nulls, never an error."""
    rng = np.random.default_rng(4)
    good = [encode_payload(bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)), b"bytes=%d" % (64 * n)) for n in (1, 3, 9)]
    good.append(write_general(rng.integers(-3, 4, (2, 2, 64))))
    read = 0
    for k in range(10_000):
        x = bytearray(good[k % 4])
        how = rng.integers(0, 4)
        if how == 0:
            x = x[: rng.integers(0, len(x))]
        elif how == 1:
            for p in rng.integers(0, len(x), rng.integers(1, 5)):
                x[p] = rng.integers(0, 256)
        elif how == 2:
            a, b = sorted(rng.integers(0, len(x), 2))
            del x[a:b]
        else:
            p = rng.integers(2, min(len(x), 400))
            x[p:p] = bytes(rng.integers(0, 256, 6, dtype=np.uint8))
        read += decode_file(bytes(x))[2] is not None
    assert read < 10_000
    huge = good[0].replace(b"\x08\x00\x10\x00\x10\x03", b"\x08\xff\xff\xff\xff\x03")
    assert huge != good[0] and decode_file(huge) == (None,) * 6
    assert decode_file(encode_payload(bytes(64), b"bytes=9999"))[:2] == (None, None) and decode_file(encode_payload(bytes(64), b"bytes=x"))[2] == 16


def test_the_tensor_is_stored(spark):
    media = encode_media(spark.createDataFrame([(1, "é" * 70_000), (2, None)], "doc_id long, text string"))
    got = {r.id: r for r in decode_media(media.withColumn("rgb", F.lit(1))).collect()}
    for i, text in ((1, "é" * 70_000), (2, "")):
        r = got[i]
        assert len(r.rgb) == 3 * r.height * r.width and r.payload[: r.n_bytes].decode() == text
        assert bytes(r.rgb) == Progressive(bytes(r.media)).rgb().tobytes()
