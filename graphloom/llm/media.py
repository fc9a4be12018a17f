"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, materialise

#: Side of a tile; a tile has TILE * TILE samples.
TILE = 24
_NETPBM = re.compile(rb"(P[1-6])(?:\s*#[^\n]*\n|\s)+(\d+)(?:\s*#[^\n]*\n|\s)+(\d+)(?:(?:\s*#[^\n]*\n|\s)+(\d+))?")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greyscale Netpbm (P5) of a two-dimensional array of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed 8-bit greyscale BMP, rows bottom-up and padded to four bytes."""
    height, width = samples.shape
    rows = np.zeros((height, -(-width // 4) * 4), dtype=np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6, up to 8 bits) or uncompressed BMP (8, 24 or 32 bits) image as (height, width[, 3])."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    found = _NETPBM.match(data)
    if not found:
        raise ValueError("neither Netpbm nor BMP")
    kind = found[1]
    width, height = int(found[2]), int(found[3])
    bitmap = kind in (b"P1", b"P4")
    if bitmap and found[4] is not None:
        found = re.match(_NETPBM.pattern.removesuffix(rb"(?:(?:\s*#[^\n]*\n|\s)+(\d+))?"), data)
    most = 1 if bitmap else int(found[4] or 0)
    if not 1 <= most <= 255:
        raise ValueError("samples must have 1 to 8 bits")
    if not 0 < width * height <= 8 * len(data):  # no sample takes less than a bit
        raise ValueError("the image is empty or cut short")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n, body = int(np.prod(shape)), data[found.end() + (kind in (b"P4", b"P5", b"P6")) :]
    if kind == b"P1":
        out = np.frombuffer(re.sub(rb"\s", b"", body), dtype=np.uint8)[:n] - 48
        if (out > 1).any():
            raise ValueError("a bit must be 0 or 1")
    elif kind in (b"P2", b"P3"):
        out = np.array(body.split()[:n], dtype=np.int64)
    elif kind == b"P4":
        stride = -(-width // 8)
        out = np.unpackbits(np.frombuffer(body, dtype=np.uint8, count=stride * height).reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        out = np.frombuffer(body, dtype=np.uint8, count=n)
    if len(out) != n:
        raise ValueError("the image is cut short")
    if len(out) and not 0 <= int(out.min()) <= int(out.max()) <= most:
        raise ValueError("a sample is above the largest")
    if bitmap:
        out = (1 - out) * 255
    elif most != 255:
        out = (out.astype(np.uint32) * 255 + most // 2) // most
    return out.astype(np.uint8).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    if width <= 0 or not height or start > len(data) or width * abs(height) * bits > 8 * len(data):
        raise ValueError("the image is empty or cut short")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        if colours > 256:
            raise ValueError("more than 256 colours")
        palette = np.frombuffer(data, dtype=np.uint8, count=4 * colours, offset=14 + size).reshape(-1, 4)
        if rows[:, :width].max(initial=0) >= colours:
            raise ValueError("a sample is beyond the palette")
        full = palette[rows[:, :width]][..., 2::-1]
        return full[..., 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else full
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, from the integral image (a cell has one source pixel at least)."""
    grey = image if image.ndim == 2 else image.astype(np.float64).mean(axis=2)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def edges(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(k) * n // k
        return low, np.maximum((np.arange(1, k + 1) * n + k - 1) // k, low + 1)

    (y0, y1), (x0, x1) = edges(grey.shape[0], height), edges(grey.shape[1], width)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each cell of a 9 x 8 area resize brighter than its left neighbour?"""
    small = resize(image, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def write_npy(tiles: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tiles), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def to_tiles(image: np.ndarray, side: int = TILE) -> np.ndarray:
    """A greyscale image as tiles (n, side, side) in reading order; edges are padded with 255."""
    grey = image if image.ndim == 2 else np.rint(image.astype(np.float64).mean(axis=2)).astype(np.uint8)
    h, w = -(-grey.shape[0] // side) * side, -(-grey.shape[1] // side) * side
    full = np.full((h, w), 255, dtype=np.uint8)
    full[: grey.shape[0], : grey.shape[1]] = grey
    return full.reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side, side)


def media_tiles(media: DataFrame, side: int = TILE) -> DataFrame:
    """``media(doc_id, media)`` of Netpbm or BMP images to ``(doc_id, tiles)``, NPY files of 8-bit tiles.

    Null and undecodable images (cut short, empty, of other kinds, with samples beyond their range) give null tiles. Other columns
    are ignored, whatever their names; repeated rows stay; no rows give no rows; an image is decoded whole.
    """

    def make():
        def each(c):
            for doc, data in zip(c["doc_id"], c["media"], strict=True):
                try:
                    yield doc, None if data is None else write_npy(to_tiles(decode(bytes(data)), side))
                except (ValueError, struct.error, OverflowError):
                    yield doc, None

        return each

    return map_rows(media.select("doc_id", "media"), make, "doc_id long, tiles binary", flush=200)


def text_images(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as greyscale Netpbm images of width TILE: ``(doc_id, n_bytes, media)``.

    The UTF-8 bytes of the whole text (null: empty) are the samples, with 255 appended up to a positive multiple of TILE * TILE.
    """

    def make():
        def each(c):
            for doc, text in zip(c["doc_id"], c["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                full = raw + b"\xff" * (-len(raw) % TILE**2 or (0 if raw else TILE**2))
                yield doc, len(raw), encode_pgm(np.frombuffer(full, dtype=np.uint8).reshape(-1, TILE))

        return each

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary", flush=200)


def stored_text_media(docs: DataFrame) -> DataFrame:
    """Texts stored as NPY tiles in the shared folder, read back and described.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32`` (of the payload as read back),
    ``media_bytes, media_sha256`` (of the stored NPY file) and ``feature`` (difference hash of the tiles' image).
    Null is an empty text; equal texts give equal values; a very long text is one large image; repeated rows stay; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    images = text_images(docs)

    def store():
        def each(c):
            for doc, n, data in zip(c["doc_id"], c["n_bytes"], c["media"], strict=True):
                yield doc, n, write_npy(to_tiles(decode(bytes(data))))

        return each

    stored = materialise(map_rows(images, store, "doc_id long, n_bytes long, tiles binary", flush=200), "tiles")

    def features():
        def each(c):
            for doc, n, data in zip(c["doc_id"], c["n_bytes"], c["tiles"], strict=True):
                data = bytes(data)
                tiles = read_npy(data)
                payload = tiles.tobytes()
                yield doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tiles.reshape(-1, tiles.shape[2]))

        return each

    return map_rows(stored, features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
