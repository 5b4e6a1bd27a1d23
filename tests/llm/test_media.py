import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tributary.llm import media


def test_round_trips():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (8, 9), (7, 64), (4, 6, 3), (1, 3, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(media.decode(media.encode_netpbm(image)), image)
        back = media.decode(media.encode_bmp(image))
        assert np.array_equal(back, image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2))


def test_other_netpbm():
    assert media.decode(b"P1\n# a note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n15\n7 15\n").tolist() == [[119, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3 ").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n" + bytes([1, 2])).tolist() == [[258]]


def test_resize_is_the_area_mean(monkeypatch):
    rng = np.random.default_rng(2)
    for h, w, to in ((8, 8, (2, 4)), (5, 7, (3, 2)), (2, 3, (8, 9)), (1, 64, (8, 9))):
        image = rng.integers(0, 256, (h, w)).astype(float)
        fine = np.kron(image, np.ones(to))  # each pixel as to[0] x to[1] samples, each cell as h x w of them
        want = fine.reshape(to[0], h, to[1], w).mean(axis=(1, 3))
        assert np.allclose(media.resize_area(image, *to), want)
        monkeypatch.setattr(media, "STRIP", 2)
        assert np.allclose(media.resize_area(image, *to), want)
        monkeypatch.undo()


def plain_feature(padded):
    """Hash and checksum from area means by fractions, pixel by pixel."""
    h = len(padded) // 64

    def means(height, width):
        by_row = np.zeros((height, h))
        for i in range(height):
            for y in range(h * i // height, min(h, -(-h * (i + 1) // height))):
                by_row[i, y] = min(y + 1, h * (i + 1) / height) - max(y, h * i / height)
        by_column = np.zeros((64, width))
        for j in range(width):
            for x in range(64 * j // width, min(64, -(-64 * (j + 1) // width))):
                by_column[x, j] = min(x + 1, 64 * (j + 1) / width) - max(x, 64 * j / width)
        return by_row @ np.frombuffer(padded, np.uint8).reshape(h, 64).astype(float) @ by_column / (h / height * 64 / width)

    small = np.round(means(8, 9), 6)
    bits = "".join("1" if a < b else "0" for row in small.tolist() for a, b in zip(row, row[1:], strict=False))
    out = io.BytesIO()
    np.save(out, np.rint(np.round(means(16, 16), 6)).astype(np.uint8))
    return f"{int(bits, 2):016x}-{zlib.crc32(out.getvalue()):08x}"


def test_samples_are_scaled():
    tile = lambda data: np.load(io.BytesIO(media.tile(media.decode(data))))
    assert (tile(b"P5 2 2 65535\n" + (1000).to_bytes(2, "big") * 4) == 4).all() and (tile(b"P2 2 1 15 15 15 ") == 255).all() and (tile(b"P2 2 1 1000 1000 1000 ") == 255).all()
    for bad in (b"P2 2 1 15 15 ", b"P5 2 2 0\n1234", b"P5 2 2 70000\n" + bytes(8)):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_other_bmp():
    palette = bytes([1, 2, 3, 0, 250, 240, 230, 0])
    head = lambda bits, packed, colours, more, size=40: b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + size + len(more)) + struct.pack("<IiiHHIIiiII", size, 3, 2, 1, bits, packed, 0, 0, 0, colours, 0) + more
    dark, light = [3, 2, 1], [230, 240, 250]
    want = [[light, dark, light], [dark, light, dark]]
    assert media.decode(head(1, 0, 2, palette) + bytes([0b01000000, 0, 0, 0, 0b10100000, 0, 0, 0])).tolist() == want
    assert media.decode(head(4, 0, 2, palette) + bytes([0x01, 0x00, 0, 0, 0x10, 0x10, 0, 0])).tolist() == want
    old = b"BM" + struct.pack("<IHHI", 0, 0, 0, 26 + 6) + struct.pack("<IHHHH", 12, 3, 2, 1, 1) + palette[:3] + palette[4:7]
    assert media.decode(old + bytes([0b01000000, 0, 0, 0, 0b10100000, 0, 0, 0])).tolist() == want
    red = struct.pack("<HHHH", 0x7C00, 0x3E0, 0x1F, 0)
    assert media.decode(head(16, 0, 0, b"") + red + red).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255]]] * 2
    wide = struct.pack("<III", 0xFF000000, 0xFF0000, 0xFF00) * 2
    assert media.decode(head(32, 3, 0, struct.pack("<III", 0xFF000000, 0xFF0000, 0xFF00)) + wide).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255]]] * 2


def test_text_media(documents):
    texts = ["", None, "abc", "é" * 32, "x" * 65, "long " * 40_000, "abc"]
    rows = {r["doc_id"]: r for r in media.text_media(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == plain_feature(padded)
        assert np.load(io.BytesIO(r["tile"])).shape == (16, 16)
    assert rows[2]["feature"] == rows[6]["feature"] != rows[4]["feature"]
    assert media.text_media(documents([])).collect() == []


def test_image_features(spark):
    good = media.encode_bmp(np.arange(48, dtype=np.uint8).reshape(4, 4, 3))
    df = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"P5 9 9 255\nxx"), (5, good)], "k int, img binary")
    rows = {r["k"]: r for r in media.image_features(df, "img", "k").collect()}
    assert (rows[1]["width"], rows[1]["height"], rows[1]["channels"], rows[1]["error"]) == (4, 4, 3, None)
    assert rows[1]["dhash"] == rows[5]["dhash"] and all(rows[k]["error"] for k in (2, 3, 4))


def test_bad_image():
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
