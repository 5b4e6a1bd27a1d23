"""Media columns: Netpbm (P1-P6) and BMP images in a binary column, as numpy arrays.

Images are decoded to arrays of height x width x channels, made smaller by area with an integral image, and come back as NPY
tiles and difference hashes. Bytes of any kind can be stored as samples of a grey image without loss.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of a stored payload; payloads are padded to whole rows.
ROW = 64
TILE = 16


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for two dimensions, P6 for three channels; 8-bit samples."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit rows from the bottom up, padded to four bytes."""
    if image.ndim == 2:
        image = np.repeat(image[:, :, None], 3, 2)
    height, width = image.shape[:2]
    rows = np.zeros((height, (3 * width + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * width] = image[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _header(data: bytes, numbers: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, comments skipped, and the place after the one blank that ends it."""
    found, at = [], 2
    while len(found) < numbers:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("no number where the header needs one")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6; 16-bit samples are big-endian. Bitmaps give 0 for black and 255 for white. Samples are scaled from the image's own largest value to 255, or to 65,535 where it is over 255."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (width, height), at = _header(data, 2)
        if kind == b"P1":
            bits = np.frombuffer(b"".join(data[at - 1 :].split()), np.uint8)[: width * height] - 48
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits.reshape(height, width)) * 255).astype(np.uint8)
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    (width, height, largest), at = _header(data, 3)
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at - 1 :].split()[:n], np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if largest < 256 else ">u2", n, at)
    if len(samples) < n or not 0 < largest < 65_536:
        raise ValueError("too few samples, or a largest value out of range")
    kind, full = (np.uint8, 255) if largest < 256 else (np.uint16, 65_535)
    if largest != full:
        samples = (np.minimum(samples, largest).astype(np.int64) * full + largest // 2) // largest
    return samples.reshape((height, width, 3) if channels == 3 else (height, width)).astype(kind)


def _expanded(samples: np.ndarray, mask: int) -> np.ndarray:
    """The masked bits of 16- or 32-bit pixels, scaled to 8 bits."""
    shift = (mask & -mask).bit_length() - 1
    most = mask >> shift
    return (((samples & np.uint32(mask)) >> np.uint32(shift)).astype(np.int64) * 255 + most // 2) // most


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 1, 4 or 8 (palette), 16, 24 or 32 bits a pixel, headers of 12 bytes too, bit masks or not; alpha is dropped."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, size = struct.unpack_from("<II", data, 10)
    packed = 0
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
    else:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (1, 4, 8, 16, 24, 32) or packed not in ((0, 3) if bits in (16, 32) else (0,)):
        raise ValueError(f"BMP of {bits} bits a pixel, compression {packed}, isn't read")
    stride = (bits * width + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        entry = 3 if size == 12 else 4
        colours = (0 if size == 12 else struct.unpack_from("<I", data, 46)[0]) or 1 << bits
        palette = np.frombuffer(data, np.uint8, entry * colours, 14 + size).reshape(-1, entry)
        places = rows if bits == 8 else (np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(len(rows), -1))
        return palette[places[:, :width]][:, :, 2::-1]
    if bits == 16 or packed == 3:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        pixels = rows[:, : width * bits // 8].copy().view(f"<u{bits // 8}").astype(np.uint32)
        return np.stack([_expanded(pixels, m) for m in masks], axis=2).astype(np.uint8)
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


#: Rows of an image whose integral is in memory at once.
STRIP = 4096


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, parts of pixels by their share, from one integral image; float64.

    Of the integral image only the rows at the cells' edges are kept; it is made in strips, so memory doesn't grow with the image.
    """
    h, w = image.shape[:2]
    edge = np.arange(height + 1) * (h / height)
    low = np.minimum(edge.astype(np.int64), h - 1)
    wanted = np.unique(np.concatenate([low, low + 1]))
    kept = np.zeros((len(wanted), w + 1))
    above = np.zeros(w + 1)
    for first in range(0, h, STRIP):
        grey = image[first : first + STRIP].astype(np.float64)
        if grey.ndim == 3:
            grey = grey.mean(axis=2)
        strip = np.zeros((len(grey) + 1, w + 1))
        strip[1:, 1:] = grey.cumsum(0).cumsum(1)
        strip += above
        here = (wanted >= first) & (wanted <= first + len(grey))
        kept[here] = strip[wanted[here] - first]
        above = strip[-1]
    row = dict(zip(wanted.tolist(), range(len(wanted)), strict=True))
    part = (edge - low)[:, None]
    rows = kept[[row[k] for k in low.tolist()]] * (1 - part) + kept[[row[k + 1] for k in low.tolist()]] * part
    across = np.arange(width + 1) * (w / width)
    left = np.minimum(across.astype(np.int64), w - 1)
    share = across - left
    at = rows[:, left] * (1 - share) + rows[:, left + 1] * share
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 area means is less than its right neighbour; 16 hexadecimal digits."""
    small = np.round(resize_area(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """NPY bytes of the image as side x side grey samples of 8 bits."""
    out = io.BytesIO()
    scale = 257 if image.dtype == np.uint16 else 1
    np.save(out, np.clip(np.rint(np.round(resize_area(image, side, side) / scale, 6)), 0, 255).astype(np.uint8, order="C"))
    return out.getvalue()


def image_features(df: DataFrame, image_column: str, id_column: str) -> DataFrame:
    """id, width, height, channels, tile (NPY bytes), dhash and error of each image.

    Null, empty and broken images give a row with an error and nulls, so no row is lost and no task fails.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1):
                try:
                    image = decode(data.as_py() or b"")
                    out.append((image.shape[1], image.shape[0], image.shape[2] if image.ndim == 3 else 1, tile(image), difference_hash(image), None))
                except (ValueError, struct.error, IndexError, ZeroDivisionError) as e:
                    out.append((None, None, None, None, None, str(e)[:200]))
            columns = zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in columns)], ["id", "width", "height", "channels", "tile", "dhash", "error"])

    kind = df.schema[id_column].dataType.simpleString()
    narrow = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{image_column}`").cast("binary").alias("image"))
    out = narrow.mapInArrow(features, f"id {kind}, width int, height int, channels int, tile binary, dhash string, error string")
    return out.withColumnRenamed("id", id_column)


def store_payload(payload: bytes) -> bytes:
    """The payload as samples of a grey Netpbm image, ROW to a row, zeros up to a positive number of whole rows."""
    height = max(1, -(-len(payload) // ROW))
    image = np.zeros(height * ROW, np.uint8)
    image[: len(payload)] = np.frombuffer(payload, np.uint8)
    return encode_netpbm(image.reshape(height, ROW))


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text stored as an image, read back from the stored bytes, with what was read back and its features.

    Null text is empty. Columns: id, n_bytes, media (the stored image), and of what the stored bytes decode to: payload_bytes,
    payload_sha256, tail_crc32 (last ROW bytes), media_bytes, media_sha256, feature (difference hash and checksum of the NPY tile), tile.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part, out = batch.slice(first, 1000), []
                for text in part.column(1):
                    raw = (text.as_py() or "").encode()
                    media = store_payload(raw)
                    image = decode(media)
                    back, small = image.tobytes(), tile(image)
                    out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}-{zlib.crc32(small):08x}", small))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(stored, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
