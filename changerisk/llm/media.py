"""Media columns: Netpbm and BMP images as numpy arrays, tiles and hashes.

Decoders read the uncompressed formats byte by byte without an image library.
Area resizing reads an integral image at fractional places, so the sum over
any output cell takes four look-ups and every input sample counts in full.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name

#: Samples in a row of the image that holds a payload; payloads are padded to it.
PAYLOAD_WIDTH = 64


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """Header numbers after the magic, and where the samples start; '#' opens a comment."""
    fields: list[int] = []
    at = 2
    while len(fields) < count:
        while at < len(data) and (data[at:at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[start:at]))
    return fields, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or, with a maximum over 255, uint16; rows, columns and channels."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456":
        raise ValueError("not a Netpbm image")
    bitmap, channels = kind in b"14", 3 if kind in b"36" else 1
    fields, at = _netpbm_fields(data, 2 if bitmap else 3)
    width, height = fields[:2]
    largest = 1 if bitmap else fields[2]
    if not 0 < largest < 65536:
        raise ValueError("bad Netpbm maximum")
    shape = (height, width, channels) if channels > 1 else (height, width)
    count = width * height * channels
    if kind == b"1":
        flat = np.frombuffer(data, np.uint8, offset=at - 1)
        flat = flat[(flat == 48) | (flat == 49)][:count] - 48
    elif kind in b"23":
        flat = np.array(data[at - 1:].split()[:count], dtype=np.int64)
    elif kind == b"4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at).reshape(height, row)
        flat = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if largest < 256 else ">u2", count, at)
    if flat.size != count:
        raise ValueError("short Netpbm image")
    if bitmap:
        return ((1 - flat) * 255).astype(np.uint8).reshape(shape)
    return flat.astype(np.uint8 if largest < 256 else np.uint16).reshape(shape)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary grey map with 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 1, 4, 8 (palette), 24 or 32 bits as RGB rows from the top."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")

    def number(at: int, size: int, signed: bool = False) -> int:
        return int.from_bytes(data[at:at + size], "little", signed=signed)

    start, header = number(10, 4), number(14, 4)
    width, height = number(18, 4, True), number(22, 4, True)
    depth, compression = number(28, 2), number(30, 4)
    if compression not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP image")
    row = (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if depth <= 8:
        colours = number(46, 4) or 1 << depth
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)
        bits = np.unpackbits(raw, axis=1)[:, :width * depth].reshape(abs(height), width, depth)
        index = bits @ (1 << np.arange(depth - 1, -1, -1))
        image = palette[index][:, :, 2::-1]
    else:
        image = raw[:, :width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: the image itself, or the mean of its channels."""
    return image.astype(np.float64) if image.ndim == 2 else image.mean(axis=2)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal, possibly fractional cells, from the integral image."""
    rows, columns = image.shape
    integral = np.zeros((rows + 1, columns + 1))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=integral[1:, 1:])

    def cuts(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (size / parts)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    y, fy = cuts(rows, height)
    x, fx = cuts(columns, width)
    along = integral[y] + (integral[y + 1] - integral[y]) * fy[:, None]
    corners = along[:, x] + (along[:, x + 1] - along[:, x]) * fx
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (rows / height * columns / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 by 9 reduction is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image reduced to ``side`` by ``side`` bytes, in NPY format 1.0."""
    out = io.BytesIO()
    tile = np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def payload_image(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the grey map that stores them padded with zero bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // PAYLOAD_WIDTH))
    samples = np.frombuffer(raw.ljust(rows * PAYLOAD_WIDTH, b"\0"), np.uint8)
    return len(raw), encode_pgm(samples.reshape(rows, PAYLOAD_WIDTH))


def text_images(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as grey maps: ``(key, n_bytes, media)``.

    A null text is an empty one; an empty text is one row of zero samples.
    Equal texts give equal images. Rows are independent: no shuffle.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [payload_image(t) for t in batch["__text"]]
            yield pd.DataFrame({"key": batch["__key"], "n_bytes": [m[0] for m in made],
                                "media": [m[1] for m in made]})

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
            .mapInPandas(run, f"key {kind}, n_bytes long, media binary"))


def media_features(media: DataFrame, *, side: int = 32) -> DataFrame:
    """What the stored bytes of every image hold.

    ``media(key, media, ..)`` with Netpbm or BMP bytes. Adds ``samples`` and
    ``samples_sha256`` (of the decoded samples), ``tail_crc32`` (of the last 64
    of them), ``media_bytes``, ``media_sha256``, ``feature`` (difference hash),
    ``tile`` (NPY) and ``error``. Bytes that are null or no such image give
    null features and a reason in ``error``; no row is dropped. A name that the
    input has already, ``media`` apart, gets ``_1`` after it.
    """
    added = ("samples long, samples_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string, tile binary, error string")

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7 + ("no bytes",)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            image = decode_image(data)
            flat = np.ascontiguousarray(image).tobytes()
            plane = grey(image)
            return (len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-64:]),
                    *stored, difference_hash(plane), npy_tile(plane, side), None)
        except (ValueError, IndexError) as e:
            return (None, None, None, *stored, None, None, str(e))

    own = [c for c in media.columns if c != "media"]
    kinds = {own_name(own, c.split()[0]): c.split()[1] for c in added.split(", ")}
    added = ", ".join(f"{c} {kind}" for c, kind in kinds.items())
    names = list(kinds)
    longs = [c for c, kind in kinds.items() if kind == "long"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(m if m is None else bytes(m)) for m in batch.pop("media")]
            made = pd.DataFrame(found, columns=names).astype(
                {c: "Int64" for c in longs})
            yield pd.concat([batch.reset_index(drop=True), made], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema
                     if f.name != "media")
    return media.mapInPandas(run, f"{kept}, {added}")


def write_tiles(features: DataFrame, path: str) -> None:
    """Tiles as a table of NPY files' bytes beside their keys and hashes."""
    features.select("key", "feature", "tile").write.parquet(path)
