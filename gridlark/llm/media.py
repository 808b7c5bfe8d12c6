"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

``decode`` reads P1-P6 Netpbm (8-bit samples, maxval up to 255) and uncompressed BMP of 1, 4, 8, 24 or 32 bits.
``area_resize`` averages the luminance over the cells of a small grid with an integral image, taken in bands of rows so
that memory doesn't grow with the picture; the tile is written as NPY and the signs of its horizontal differences are its hash.

Defined results: null bytes give null fields; bytes that aren't such a picture, or are cut short, give null fields and
the reason in ``error``. A null text is an empty one. Equal bytes give equal values. An empty table gives none. All columns of the input
are kept; what is added is one struct under the caller's name, behind which underscores come while the input has such a column
(``common.unused``).
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches, unused

#: Samples in a row of a stored payload.
WIDTH = 64
#: Rows and columns of a tile; the hash compares neighbouring columns and so has 8 x 8 bits.
TILE = (8, 9)
#: Rows of a picture that are summed at once.
BAND = 4096


class BadMedia(ValueError):
    """The bytes aren't a picture of a known kind."""


def pad(text: str | None, block: int = WIDTH) -> tuple[int, bytes]:
    """The text's number of UTF-8 bytes, and these bytes with zeros up to a positive multiple of ``block``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % block or (0 if raw else block))


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the bottom up."""
    h, w = samples.shape
    stride = -(-w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    grey[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 256)
    return head + grey.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3 samples."""
    if data[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise BadMedia("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    wanted = 2 if kind in (1, 4) else 3
    while len(numbers) < wanted:
        while at < len(data) and data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.find(b"\n", at) % (len(data) + 1) if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit() and end - at < 10:
            end += 1
        if end == at:
            raise BadMedia("Netpbm header is cut short")
        numbers.append(int(data[at:end]))
        at = end
    (w, h), top = numbers[:2], numbers[2] if wanted == 3 else 1
    deep = 3 if kind in (3, 6) else 1
    if not (w and h and 0 < top < 256):
        raise BadMedia("Netpbm size or maxval isn't supported")
    n = w * h * deep
    if kind in (4, 5, 6):
        stride = -(-w // 8) if kind == 4 else w * deep
        body = np.frombuffer(data, np.uint8, offset=at + 1)[: h * stride]
        if body.size < h * stride:
            raise BadMedia("Netpbm samples are cut short")
        flat = (1 - np.unpackbits(body.reshape(h, stride), axis=1)[:, :w].ravel()) if kind == 4 else body
    elif kind == 1:
        digits = np.frombuffer(data, np.uint8, offset=at)
        flat = 1 - (digits[(digits == 48) | (digits == 49)][:n] - 48)
    else:
        flat = np.array(data[at:].split()[:n], dtype=np.int64)
    if flat.size < n or flat.size and int(flat.max()) > top:
        raise BadMedia("Netpbm samples are cut short or over maxval")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    shape = (h, w, 3) if deep == 3 else (h, w)
    return flat.astype(np.uint8, copy=False).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise BadMedia("BMP header is cut short")
    start, size, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    if size < 40 or packing or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise BadMedia("BMP kind isn't supported")
    stride, rows = (w * bits + 31) // 32 * 4, abs(h)
    body = np.frombuffer(data, np.uint8)[start : start + rows * stride]
    if body.size < rows * stride:
        raise BadMedia("BMP samples are cut short")
    body = body.reshape(rows, stride)
    if bits >= 24:
        out = body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        n = min(used or 1 << bits, 1 << bits)
        colours = np.frombuffer(data, np.uint8)[14 + size : 14 + size + 4 * n]
        if colours.size < 4 * n:
            raise BadMedia("BMP palette is cut short")
        colours = colours.reshape(n, 4)[:, 2::-1]
        index = body if bits == 8 else (np.unpackbits(body, axis=1) if bits == 1 else np.stack([body >> 4, body & 15], 2).reshape(rows, -1))
        index = index[:, :w]
        if int(index.max()) >= n:
            raise BadMedia("BMP index is over its palette")
        out = colours[:, 0][index] if (colours == colours[:, :1]).all() else colours[index]
    return out[::-1] if h > 0 else out


def area_resize(picture: np.ndarray, rows: int = TILE[0], cols: int = TILE[1]) -> np.ndarray:
    """Mean luminance of each cell of a rows x cols grid; cells that cut samples take their share of them.

    The integral image is read at cell borders only, so it is built band by band and kept at those rows.
    """
    grey = picture if picture.ndim == 2 else picture[:, :, :3] @ np.array([299, 587, 114]) / 1000
    h, w = grey.shape
    edges_y, edges_x = np.arange(rows + 1) * (h / rows), np.arange(cols + 1) * (w / cols)
    wanted = np.unique(np.minimum(np.concatenate([np.floor(edges_y), np.ceil(edges_y)]).astype(int), h))
    integral = np.zeros((len(wanted), w + 1))
    total = np.zeros(w + 1)
    for top in range(0, h, BAND):
        band = np.cumsum(grey[top : top + BAND], axis=0, dtype=np.float64)
        here = np.flatnonzero((wanted > top) & (wanted <= top + len(band)))
        integral[here, 1:] = total[1:] + np.cumsum(band[wanted[here] - top - 1], axis=1)
        total[1:] += np.cumsum(band[-1])

    def at(values: np.ndarray, edges: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
        low = np.minimum(np.floor(edges).astype(int), top)
        high = np.minimum(low + 1, top)
        part = (edges - low)[:, None]
        a, b = np.searchsorted(known, low), np.searchsorted(known, high)
        b = np.where(part[:, 0] > 0, b, a)
        return values[a] * (1 - part) + values[b] * part

    by_row = at(integral, edges_y, wanted, h)
    cells = at(by_row.T, edges_x, np.arange(w + 1), w).T
    return np.diff(np.diff(cells, axis=0), axis=1) / ((h / rows) * (w / cols))


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tile_of(picture: np.ndarray) -> np.ndarray:
    return np.floor(area_resize(picture) + 0.5).clip(0, 255).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


MEDIA_TYPE = "height int, width int, channels int, tile binary, dhash string, error string"


def with_media(df: DataFrame, media_col: str = "media", to: str = "decoded") -> DataFrame:
    """Adds a struct: the picture's size, its NPY tile, its difference hash, or why it can't be read."""

    @F.pandas_udf(MEDIA_TYPE)
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            yield pd.DataFrame([_described(x) for x in column], columns=["height", "width", "channels", "tile", "dhash", "error"]).astype({c: "Int32" for c in ("height", "width", "channels")})

    return in_small_batches(df).withColumn(unused(df, to), decoded(F.col(f"`{media_col}`")))


def _described(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 6
    try:
        picture = decode(data)
    except (BadMedia, struct.error, ValueError) as why:
        return (None, None, None, None, None, str(why))
    tile = tile_of(picture)
    return (*picture.shape[:2], 3 if picture.ndim == 3 else 1, npy(tile), difference_hash(tile), None)


def store_text(df: DataFrame, text_col: str = "text", to: str = "media") -> DataFrame:
    """Adds a struct: each text's payload, padded to whole rows, as the ``bytes`` of a grey picture, and the text's length (``n_bytes``).

    Payloads of an odd number of rows are stored as BMP, the others as PGM: both are lossless.
    """

    @F.pandas_udf("n_bytes long, bytes binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                n, payload = pad(text)
                samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
                out.append((n, (encode_bmp if len(samples) % 2 else encode_pgm)(samples)))
            yield pd.DataFrame(out, columns=["n_bytes", "bytes"])

    return in_small_batches(df).withColumn(unused(df, to), stored(F.col(f"`{text_col}`")))


DIGEST_TYPE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string"


def _digest(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 8
    stored = len(data), hashlib.sha256(data).hexdigest()
    try:
        picture = decode(data)
    except (BadMedia, struct.error, ValueError) as why:
        return (None, None, None, *stored, None, None, str(why))
    payload, tile = picture.tobytes(), tile_of(picture)
    made = npy(tile)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *stored, f"{difference_hash(tile)}:{zlib.crc32(made):08x}", made, None)


def digests(df: DataFrame, media_col: str = "media.bytes", to: str = "digest") -> DataFrame:
    """Adds a struct of what is read back from stored payloads: length, hashes, the feature (difference hash and the tile's checksum) and the NPY tile.

    media_col may name a struct's field. Bytes that aren't a picture have their own length and hash and the reason in ``error``.
    """

    @F.pandas_udf(DIGEST_TYPE)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            names = [c.split()[0] for c in DIGEST_TYPE.split(", ")]
            yield pd.DataFrame([_digest(x) for x in column], columns=names).astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return in_small_batches(df).withColumn(unused(df, to), digest(F.col(media_col)))
