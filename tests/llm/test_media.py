import hashlib
import struct
import zlib

import numpy as np
import pytest

from lodspark.llm import common, media, mjpeg


def naive_decode(scan: bytes) -> list[list[int]]:
    """A frame's coefficients, bit by bit."""
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
    at = 0

    def symbol(table):
        nonlocal at
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(bits[at])
            at += 1
            for s in table.by_length[n - 1]:
                if int(table.code[s]) == code and table.size[s] == n:
                    return s
        raise AssertionError

    def extra(size):
        nonlocal at
        v = int(bits[at : at + size] or "0", 2)
        at += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    out, last = [], 0
    for _ in range(mjpeg.BLOCKS):
        block = [0] * 64
        last += extra(symbol(mjpeg.DC))
        block[0], k = last, 1
        while k < 64:
            s = symbol(mjpeg.AC)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                block[k] = extra(s & 15)
            k += 1
        out.append(block)
    return out


def test_scans_decode_bit_by_bit():
    rng = np.random.default_rng(1)
    units = rng.integers(-128, 128, (6, mjpeg.BLOCKS, 64))
    units[1] = 0
    units[2][rng.random((mjpeg.BLOCKS, 64)) < 0.95] = 0
    units[3, :, 1:] = 0
    units[4, :, 1:63] = 0
    scans = mjpeg.encode_scans(units)
    assert (mjpeg.decode_scans(scans) == units).all()
    assert all(naive_decode(s) == u.tolist() for s, u in zip(scans, units, strict=True))


def test_pixels_are_the_inverse_transform():
    u = np.zeros((1, mjpeg.BLOCKS, 64), int)
    u[0, 0, 0] = 80
    assert (mjpeg.pixels(u)[0, 0] == 138).all()
    u[0, 1, 1] = 40  # zigzag place 1 is the first horizontal frequency
    p = mjpeg.pixels(u)[0, 1].astype(int)
    assert (p == p[0]).all() and p[0, 0] > 128 > p[0, 7]


def test_round_trip_of_odd_texts(odd, odd_rows, none):
    files = media.to_media(odd)
    rows = media.read_media(files).collect()
    want = []
    for i, t, _, _ in odd_rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    clips = media.clips(files).filter("doc_id = 65").orderBy("clip").collect()
    assert clips[0].first_frame == 0 and all(a.stop_s == b.start_s for a, b in zip(clips[:-1], clips[1:], strict=True))
    assert media.read_media(media.to_media(none)).count() == 0


def test_query_reads_files_that_are_stored(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a few words"), (2, None), (3, "x" * 5000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/shared")
    out = {r.doc_id: r for r in media.query(spark, str(tmp_path)).collect()}
    stored = spark.read.parquet(*map(str, tmp_path.glob("shared/media-*"))).collect()
    assert sorted(r.doc_id for r in stored) == [1, 2, 3]
    assert all(hashlib.sha256(r.media).hexdigest() == out[r.doc_id].media_sha256 for r in stored)


def test_clashing_columns_are_replaced(spark):
    files = media.to_media(spark.createDataFrame([(1, "some text"), (1, "some text"), (None, None)], "doc_id long, text string"))
    clash = files.selectExpr("*", "'x' as n_frames", "2 as Clips", "'y' as payload_sha256", "'kept' as clip")
    out = media.read_media(clash)
    assert out.columns == ["doc_id", "n_bytes", "clip", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "clips"]
    key = lambda df: sorted(map(str, df.drop("clip").collect()))
    assert key(out) == key(media.read_media(files)) and {r.clip for r in out.collect()} == {"kept"}
    assert media.clips(clash).columns == ["doc_id", "n_bytes", "clip", "first_frame", "frames", "start_s", "stop_s"] and media.clips(clash).count() >= 3


def test_shots_follow_adaptive_threshold():
    a, b = np.eye(16)[0], np.eye(16)[9]
    grams = np.array([a] * 5 + [b] * 5 + [0.9 * b + 0.1 * a] * 3)
    assert media.shots(grams) == [0, 5] and media.shots(grams[:0]) == []


def avi_of(frames, absolute=False, index=True, junk=False, groups=False):
    """An AVI file around given frames, laid out as other writers do."""
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, 10, 0, len(frames), 0, 0, 0, 0, 0, 0, 0)
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    head = part(b"LIST", b"hdrl" + part(b"avih", bytes(56)) + part(b"LIST", b"strl" + part(b"strh", b"auds" + bytes(52))) + part(b"LIST", b"strl" + part(b"strh", strh)))
    head += part(b"JUNK", b"abcd") if junk else b""
    start = 12 + len(head) + 8
    movi, entries = b"movi", []
    for f in frames:
        sound = part(b"00wb", b"abc")
        at = len(movi) + len(sound) + (12 if groups else 0)
        entries.append(b"01dc" + struct.pack("<III", 16, at + (start if absolute else 0), len(f)))
        movi += part(b"LIST", b"rec " + sound + part(b"01dc", f)) if groups else sound + part(b"01dc", f)
    body = b"AVI " + head + part(b"LIST", movi) + (part(b"idx1", b"".join(entries)) if index else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def jpeg_of(spark, picture, quality):
    """A colour JPEG (4:2:0, quantisers, typical tables) by the Java library, and the samples that it reads back from it."""
    jvm = spark._jvm
    h, w, _ = picture.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    rgb = (picture[..., 0].astype(int) << 16 | picture[..., 1].astype(int) << 8 | picture[..., 2]).ravel().tolist()
    numbers = spark.sparkContext._gateway.new_array(jvm.int, w * h)
    for k, v in enumerate(rgb):
        numbers[k] = v
    image.setRGB(0, 0, w, h, numbers, 0, w)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)  # explicit
    param.setCompressionQuality(quality)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.dispose()
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    seen = np.array([int(x) & 0xFFFFFF for x in back.getRGB(0, 0, w, h, None, 0, w)]).reshape(h, w)
    return raw, np.stack([seen >> 16, seen >> 8 & 255, seen & 255], -1)


@pytest.mark.parametrize("size", [(40, 24), (33, 19)])
def test_frames_of_another_writer(spark, size):
    h, w = size
    y, x = np.mgrid[:h, :w]
    pictures = [np.stack([(x * 5 + k * 40) % 256 // 2 + 40, y * 4 + 20, np.full((h, w), 60 + 50 * k)], -1).astype(np.uint8) for k in range(3)]
    made = [jpeg_of(spark, p, 0.9) for p in pictures]
    for kind in ({}, {"absolute": True, "junk": True}, {"index": False}, {"groups": True}, {"groups": True, "index": False}):
        data = avi_of([raw for raw, _ in made], **kind)
        frames, rate = mjpeg.read_avi(data)
        assert rate == 10.0 and frames == [raw for raw, _ in made]
        texts, grams, _ = media.decode_all([data])
        assert texts == [None] and grams[0].shape == (3, media.BINS)
    tables = mjpeg.Tables()
    for raw, seen in made:
        frame = mjpeg.parse_frame(raw, tables)
        assert {k: t.by_length for k, t in tables.huffman.items()} == {k: t.by_length for k, t in mjpeg.standard_tables().items()}
        assert (frame.width, frame.height) == (w, h) and len(frame.sampling) == 3 and frame.sampling[0] == (2, 2)
        luma = mjpeg.plane(frame, mjpeg.decode_frames([frame])[0])[0].astype(float)
        want = seen @ [0.299, 0.587, 0.114]
        assert luma.shape == (h, w) and np.abs(luma - want).mean() < 2 and np.abs(luma - want).max() < 25
    row = spark.createDataFrame([(1, bytearray(avi_of([raw for raw, _ in made])))], "id long, media binary")
    got = media.read_media(row).collect()[0]
    assert got.payload_bytes is None and got.n_frames == 3 and got.clips[-1].stop_s == 0.3


def stored_frame(units, quantisers, restart, tables=True):
    """A grey frame of one row of blocks with quantisers and restart markers, coded bit by bit with the typical tables."""
    std = mjpeg.standard_tables()
    bits, runs, last = "", [], 0

    def put(table, symbol, value, size):
        code = f"{int(table.code[symbol]):0{int(table.size[symbol])}b}"
        return code + (f"{value if value >= 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    for k, block in enumerate(units):
        if restart and k and k % restart == 0:
            runs.append(bits)
            bits, last = "", 0
        d, last = int(block[0]) - last, int(block[0])
        size = abs(d).bit_length()
        bits += put(std[0x00], size, d, size)
        gap = 0
        for v in map(int, block[1:]):
            if not v:
                gap += 1
                continue
            while gap > 15:
                bits, gap = bits + put(std[0x10], 0xF0, 0, 0), gap - 16
            size = abs(v).bit_length()
            bits, gap = bits + put(std[0x10], gap << 4 | size, v, size), 0
        if gap:
            bits += put(std[0x10], 0, 0, 0)
    runs.append(bits)
    raw = b""
    for k, r in enumerate(runs):
        r += "1" * (-len(r) % 8)
        raw += (b"" if not k else bytes([255, 0xD0 + (k - 1) % 8])) + bytes(int(r[i : i + 8], 2) for i in range(0, len(r), 8)).replace(b"\xff", b"\xff\0")
    w = 8 * len(units) - 3
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(quantisers.tolist()) + (b"\xff\xdd" + struct.pack(">HH", 4, restart) if restart else b"")
    head += b"".join(std[k].segment(k) for k in (0x00, 0x10)) if tables else b""
    return head + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 7, w, 1) + b"\x07\x22\x00" + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x07\x00\x00\x3f\x00" + raw + b"\xff\xd9"


def test_quantisers_restarts_and_missing_tables():
    rng = np.random.default_rng(6)
    units = rng.integers(-9, 10, (11, 64)) * (rng.random((11, 64)) < 0.3)
    quantisers = rng.integers(1, 30, 64)
    for restart in (0, 1, 4):
        for tables in (True, False):
            frame = mjpeg.parse_frame(stored_frame(units, quantisers, restart, tables), mjpeg.Tables())
            back = mjpeg.decode_frames([frame, frame])[0]
            assert (back[1, 0] == units).all()
            got = mjpeg.plane(frame, back)[0].astype(float)
            full = np.zeros((11, 64))
            full[:, mjpeg.ZIGZAG] = units * quantisers
            k = np.arange(8)
            basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, 8**-0.5, 0.5)
            want = np.concatenate([basis @ b.reshape(8, 8) @ basis.T for b in full], axis=1) + 128
            assert got.shape == (7, 85) and np.abs(got - np.clip(np.rint(want), 0, 255)[:7, :85]).max() <= 1
    with pytest.raises(ValueError, match="sequential"):
        mjpeg.parse_frame(stored_frame(units, quantisers, 0).replace(b"\xff\xc0", b"\xff\xc2", 1), mjpeg.Tables())


def test_junk_chunks_and_payloads():
    units = np.random.default_rng(2).integers(-60, 60, (3, mjpeg.BLOCKS, 64))
    avi = mjpeg.write_avi(mjpeg.encode_scans(units))
    at = avi.index(b"LIST", 12)
    moved = avi[:4] + int.to_bytes(len(avi) - 8 + 12, 4, "little") + avi[8:at] + b"JUNK" + int.to_bytes(4, 4, "little") + b"abcd" + avi[at:]
    for data in (avi, moved):
        text, grams, rates = media.decode_all([data])
        assert text[0] == (units + 128).astype(np.uint8).tobytes() and len(grams[0]) == 3 and rates == [24.0]
