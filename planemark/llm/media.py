"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY tiles with
difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

WIDTH = 64


class MediaError(ValueError):
    pass


def _header(raw: bytes, wanted: int) -> tuple[list[int], int]:
    """Whole numbers of a Netpbm header after its two magic bytes, and where the samples begin."""
    out: list[int] = []
    at = 2
    while len(out) < wanted:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at] == 35):
            if raw[at] == 35:
                at = raw.find(b"\n", at)
                at = len(raw) if at < 0 else at
            else:
                at += 1
        to = at
        while to < len(raw) and 48 <= raw[to] <= 57:
            to += 1
        if to == at:
            raise MediaError("broken Netpbm header")
        out.append(int(raw[at:to]))
        at = to
    return out, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as an array of (height, width) or (height, width, 3): samples as stored, bitmaps as 0 for black and 1."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not Netpbm")
    bitmap, planes = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(raw, 2 if bitmap else 3)
    w, h = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not w or not h or not 0 < top < 65536:
        raise MediaError("broken Netpbm header")
    n = w * h * planes
    if kind == b"P4":
        rows = -(-w // 8)
        packed = np.frombuffer(raw, np.uint8, offset=at, count=min(len(raw) - at, rows * h))
        if len(packed) < rows * h:
            raise MediaError("too few samples")
        return 1 - np.unpackbits(packed.reshape(h, rows), axis=1)[:, :w]
    if kind in (b"P5", b"P6"):
        unit = np.dtype(">u2" if top > 255 else np.uint8)
        if len(raw) - at < n * unit.itemsize:
            raise MediaError("too few samples")
        flat = np.frombuffer(raw, unit, offset=at, count=n).astype(unit.newbyteorder("="), copy=False)
    else:
        text = b"\n".join(x.split(b"#")[0] for x in raw[at - 1 :].split(b"\n"))
        values = [int(c) for c in text.decode("ascii", "replace") if c in "01"] if bitmap else [int(x) for x in text.split()]
        if len(values) < n:
            raise MediaError("too few samples")
        flat = np.array(values[:n], np.uint16 if top > 255 else np.uint8)
        flat = 1 - flat if bitmap else flat
    return flat.reshape((h, w, 3) if planes == 3 else (h, w))


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; grey palettes give (height, width), others RGB."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise MediaError("not BMP")
    at, size, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if packing or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise MediaError("kind of BMP not supported")
    row = (w * bits + 31) // 32 * 4
    if len(raw) < at + row * abs(h):
        raise MediaError("too few samples")
    lines = np.frombuffer(raw, np.uint8, offset=at, count=row * abs(h)).reshape(abs(h), row)
    lines = lines[::-1] if h > 0 else lines
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(lines[:, : w * step].reshape(abs(h), w, step)[:, :, 2::-1])
    colours = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    palette = np.zeros((256, 3), np.uint8)
    given = np.frombuffer(raw, np.uint8, offset=14 + size, count=4 * colours).reshape(-1, 4)[:, 2::-1]
    palette[: len(given)] = given
    if bits < 8:
        lines = np.unpackbits(lines, axis=1).reshape(abs(h), -1, bits)
        lines = (lines * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    image = palette[lines[:, :w]]
    return np.ascontiguousarray(image[:, :, 0]) if (given[:, 0] == given[:, 1]).all() and (given[:, 1] == given[:, 2]).all() else image


_GREYS = b"".join(bytes((i, i, i, 0)) for i in range(256))


def encode_bmp(image: np.ndarray) -> bytes:
    """8 bits a pixel with a palette of 256 greys, bottom row first."""
    h, w = image.shape
    row = -(-w // 4) * 4
    lines = np.zeros((h, row), np.uint8)
    lines[:, :w] = image[::-1]
    at = 14 + 40 + len(_GREYS)
    head = struct.pack("<2sIHHI", b"BM", at + lines.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, lines.size, 2835, 2835, 256, 256)
    return head + _GREYS + lines.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma for RGB; greys as they are."""
    if image.ndim == 2:
        return image
    return (image.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def area_sums(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over h x w equal cells of a grey image, times h * w: integers, cut at fractional edges, from its integral image."""
    rows, cols = image.shape
    whole = np.zeros((rows + 1, cols + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=whole[1:, 1:])

    def at(table: np.ndarray, n: int, cells: int) -> np.ndarray:
        q, r = np.divmod(np.arange(cells + 1) * n, cells)
        low, high = table[q], table[np.minimum(q + 1, n)]
        return low * cells + (high - low) * r[:, None]

    edges = at(at(whole, rows, h).T, cols, w).T
    return edges[1:, 1:] - edges[:-1, 1:] - edges[1:, :-1] + edges[:-1, :-1]


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """The mean of each of h x w equal cells, rounded half up; planes one by one."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, k], h, w) for k in range(image.shape[2])], axis=2)
    area = image.shape[0] * image.shape[1]
    return ((2 * area_sums(image, h, w) + area) // (2 * area)).astype(image.dtype)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side * side bits, row by row: whether a cell of the side x (side + 1) grid is darker than its right neighbour."""
    cells = area_sums(grey(image), side, side + 1)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
    """NPY files of at most side x side pixels with the row and column of their upper left corner."""
    return [(y, x, npy(image[y : y + side, x : x + side])) for y in range(0, image.shape[0], side) for x in range(0, image.shape[1], side)]


def decode_media(df: DataFrame, content: str = "content", side: int = 32, tile: int = 32) -> DataFrame:
    """Adds the struct column `media` (height, width, planes, dhash, resized NPY tiles of `side` x `side`, error) to df.

    content: a binary column. Null or broken content gives a null hash and the reason in `error`; other columns stay; a column
    named "media" or "_media_row" in df is an error, as the result would be ambiguous.
    """
    if {"media", "_media_row"} & {c.lower() for c in df.columns}:
        raise ValueError('df has a column named "media" or "_media_row"')
    ship(df.sparkSession)
    result = "struct<height:int,width:int,planes:int,dhash:string,tiles:array<struct<y:int,x:int,npy:binary>>,error:string>"

    @F.pandas_udf(result)
    def decoded(raw):  # type: ignore[no-untyped-def]
        import pandas as pd

        rows = []
        for x in raw:
            row = {"height": None, "width": None, "planes": None, "dhash": None, "tiles": None, "error": None}
            try:
                if x is None:
                    raise MediaError("no content")
                image = decode(bytes(x))
                small = area_resize(image, side, side)
                row |= {"height": image.shape[0], "width": image.shape[1], "planes": 1 if image.ndim == 2 else 3, "dhash": difference_hash(image), "tiles": [{"y": a, "x": b, "npy": c} for a, b, c in tiles(small, tile)]}
            except (MediaError, ValueError, struct.error) as e:
                row["error"] = str(e)
            rows.append(row)
        return pd.DataFrame(rows, columns=["height", "width", "planes", "dhash", "tiles", "error"], dtype=object)

    decoded = decoded.asNondeterministic()
    return df.withColumn("media", decoded(F.col(content)))


def payload(text: bytes) -> bytes:
    """text with bytes 0 appended up to a positive multiple of WIDTH."""
    return text + b"\0" * (WIDTH * max(1, -(-len(text) // WIDTH)) - len(text))


def encode(payload_: bytes) -> bytes:
    """The payload as a grey image of 64 columns: PGM for an odd number of rows, else BMP."""
    image = np.frombuffer(payload_, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(image) if image.shape[0] % 2 else encode_bmp(image)


TEXT_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_format string, tile_crc32 long"


def text_media(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Every text of `docs` (doc_id, text) stored as an image, read back and described; with keep_bytes also `media` and `tile`.

    A null text is empty; an empty text is one row of zeros. Equal texts give equal values; repeated rows, null ids and extra
    columns do no harm (extra columns are left out). An empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(11)]
                for text in some.column("text").cast(pa.binary()):
                    raw = text.as_py() or b""
                    media = encode(payload(raw))
                    image = decode(media)
                    back = image.tobytes()
                    tile = npy(area_resize(image, 16, 16))
                    row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), "bmp" if media[:2] == b"BM" else "pgm", zlib.crc32(tile)]
                    for k, x in enumerate(row + [media, tile] if keep_bytes else row):
                        out[k].append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                names = [x.split()[0] for x in TEXT_MEDIA.split(", ")] + ["media", "tile"]
                cols = [some.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True) if x)]
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, TEXT_MEDIA + (", media binary, tile binary" if keep_bytes else ""))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an image, read back and described; nulls and repeats as in text_media."""
    return text_media(read(spark, sf_dir, "documents"))
