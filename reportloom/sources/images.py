"""Radiographs as rows: uncompressed DICOM files decoded to bytes, and images brought to a square by bicubic resampling.

Decoding walks the tags of an explicit little-endian file, takes 8 or 16 bits a pixel, applies slope and intercept, scales the
range to 0..255 in single precision, and inverts where low values are bright. Resampling weighs pixels by a cubic kernel, wider
where an image shrinks, rows first and then columns, in whole numbers of 22 bits; the weights of one size are made once and applied
to all images of that size in a batch. The image stands in the middle of a black square.

Defined results: null bytes give null; bytes that are no such file (another syntax, compressed, cut off) give null pixels and the
reason in `problem`; an image of one value is black, inverted white; a side shorter than a pixel after scaling has one.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from reportloom.session import ship

# The format's syntax, its long value types, and the tags that are read.
EXPLICIT = "1.2.840.10008.1.2.1"
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"}
_SYNTAX, _PHOTOMETRIC, _ROWS, _COLUMNS, _BITS, _SIGNED, _INTERCEPT, _SLOPE, _PIXELS = (0x00020010, 0x00280004, 0x00280010, 0x00280011, 0x00280100, 0x00280103, 0x00281052, 0x00281053, 0x7FE00010)
_ITEM, _ITEM_END, _SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
_UNKNOWN = 0xFFFFFFFF


def _element(data: bytes, at: int) -> tuple[int, bytes, int, int]:
    """(tag, type, place of the value, its length) of the element at a place."""
    group, element = struct.unpack_from("<HH", data, at)
    tag = group << 16 | element
    if group == 0xFFFE:
        return tag, b"", at + 8, struct.unpack_from("<I", data, at + 4)[0]
    kind = data[at + 4 : at + 6]
    if kind in _LONG:
        return tag, kind, at + 12, struct.unpack_from("<I", data, at + 8)[0]
    return tag, kind, at + 8, struct.unpack_from("<H", data, at + 6)[0]


def _after_sequence(data: bytes, at: int) -> int:
    """The place behind a sequence of unknown length whose items begin here."""
    depth = 1
    while depth:
        tag, kind, value, n = _element(data, at)
        at = value if tag in (_ITEM, _ITEM_END, _SEQUENCE_END) and n in (0, _UNKNOWN) else value + (0 if n == _UNKNOWN else n)
        depth += (kind == b"SQ" and n == _UNKNOWN) - (tag == _SEQUENCE_END)
    return at


def decode_dicom(data: bytes) -> np.ndarray:
    """Rows x columns of bytes; ValueError where the bytes are no uncompressed explicit little-endian image."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    found: dict[int, bytes] = {}
    at = 132
    try:
        while at < len(data):
            tag, kind, value, n = _element(data, at)
            if n == _UNKNOWN:
                if tag == _PIXELS:
                    raise ValueError("compressed")
                at = _after_sequence(data, value)
                continue
            found[tag] = data[value : value + n]
            at = value + n
        text = lambda tag: found[tag].decode("ascii").strip(" \0") if tag in found else ""
        if text(_SYNTAX) != EXPLICIT:
            raise ValueError(f"syntax {text(_SYNTAX)}")
        rows, columns, bits = (struct.unpack("<H", found[t])[0] for t in (_ROWS, _COLUMNS, _BITS))
        signed = _SIGNED in found and struct.unpack("<H", found[_SIGNED])[0] == 1
        pixels = np.frombuffer(found[_PIXELS], f"<{'i' if signed else 'u'}{bits // 8}", rows * columns).reshape(rows, columns)
        slope, intercept = float(text(_SLOPE) or 1), float(text(_INTERCEPT) or 0)
    except (KeyError, struct.error, TypeError, UnicodeDecodeError) as e:
        raise ValueError(f"cut off or incomplete: {type(e).__name__}") from e
    if (slope, intercept) != (1.0, 0.0):
        pixels = pixels * slope + intercept
    x = pixels.astype(np.float32)
    low, high = x.min(), x.max()
    x = (x - low) / (high - low) if high > low else np.zeros_like(x)
    x = np.clip(x, np.float32(0), np.float32(1))
    if text(_PHOTOMETRIC) == "MONOCHROME1":
        x = np.float32(1) - x
    return (x * np.float32(255)).astype(np.uint8)


def encode_dicom(pixels: np.ndarray, photometric: str = "MONOCHROME2", slope: float = 1, intercept: float = 0) -> bytes:
    """A file of 16-bit pixels that decode_dicom reads: a sink for synthetic images."""

    def element(tag: int, kind: bytes, value: bytes) -> bytes:
        value += (b"\0" if kind in (b"UI", b"OW") else b" ") * (len(value) % 2)
        size = struct.pack("<2xI", len(value)) if kind in _LONG else struct.pack("<H", len(value))
        return struct.pack("<HH", tag >> 16, tag & 0xFFFF) + kind + size + value

    rows, columns = pixels.shape
    signed = bool((pixels < 0).any())
    word = lambda x: struct.pack("<H", x)
    body = [(_PHOTOMETRIC, b"CS", photometric.encode()), (_ROWS, b"US", word(rows)), (_COLUMNS, b"US", word(columns)), (_BITS, b"US", word(16)), (_SIGNED, b"US", word(signed))]
    body += [(_INTERCEPT, b"DS", str(intercept).encode()), (_SLOPE, b"DS", str(slope).encode()), (_PIXELS, b"OW", pixels.astype("<i2" if signed else "<u2").tobytes())]
    return bytes(128) + b"DICM" + element(_SYNTAX, b"UI", EXPLICIT.encode()) + b"".join(element(*x) for x in body)


def decoded(df: DataFrame, column: str = "content") -> DataFrame:
    """df with rows, columns, pixels (bytes, row by row) and problem of the DICOM files in a binary column, which is dropped."""
    ship(df.sparkSession)
    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    new = [StructField("rows", IntegerType()), StructField("columns", IntegerType()), StructField("pixels", BinaryType()), StructField("problem", StringType())]
    names = {column, *(f.name for f in new)}
    schema = StructType([*[f for f in df.schema.fields if f.name not in names], *new])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None
        try:
            x = decode_dicom(bytes(data))
        except ValueError as e:
            return None, None, None, str(e)
        return x.shape[0], x.shape[1], x.tobytes(), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = pd.DataFrame([one(x) for x in f[column]], columns=[x.name for x in new], index=f.index).astype({"rows": "Int32", "columns": "Int32"})
            yield pd.concat([f.drop(columns=[c for c in names if c in f.columns]), got], axis=1)

    return df.mapInPandas(run, schema)


_BITS_OF_WEIGHTS = 22


@functools.lru_cache(64)
def weights(size: int, new: int) -> np.ndarray:
    """new x size whole numbers, 2**22 times the share of each old pixel in each new one: a cubic kernel (a = -1/2), two pixels wide, or two new ones where the image shrinks."""
    scale = size / new
    wide = max(scale, 1.0)
    out = np.zeros((new, size))
    for k in range(new):
        center = (k + 0.5) * scale
        low, high = max(0, int(center - 2 * wide + 0.5)), min(size, int(center + 2 * wide + 0.5))
        x = np.abs((np.arange(low, high) - center + 0.5) / wide)
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
        out[k, low:high] = w / w.sum()
    return np.trunc(out * (1 << _BITS_OF_WEIGHTS) + np.copysign(0.5, out))


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (n x h x w, bytes) at another size; sums are whole numbers below 2**53, so exact as doubles."""

    def rounded(x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x + (1 << _BITS_OF_WEIGHTS - 1)) / (1 << _BITS_OF_WEIGHTS)), 0, 255)

    x = images.astype(np.float64)
    if width != x.shape[2]:
        x = rounded(x @ weights(x.shape[2], width).T)
    if height != x.shape[1]:
        x = rounded(weights(x.shape[1], height) @ x)
    return x.astype(np.uint8)


def fitted(height: int, width: int, side: int) -> tuple[int, int, int, int]:
    """(new height, new width, top, left) of an image whose longer side becomes the square's."""
    scale = side / max(height, width)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    return h, w, (side - h) // 2, (side - w) // 2


def squared(df: DataFrame, side: int = 896) -> DataFrame:
    """Df (rows, columns, pixels) with `square`, side x side bytes: each image resampled onto a black square; null stays null."""
    ship(df.sparkSession)
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*[f for f in df.schema.fields if f.name != "square"], StructField("square", BinaryType())])
    together = max(1, (16 << 20) // (8 * side * side))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), together):  # a batch has ten thousand rows, whose squares aren't held at once
                part = f.iloc[k : k + together].reset_index(drop=True)
                out: list[bytes | None] = [None] * len(part)
                for (h, w), own in part[part["pixels"].notna()].groupby(["rows", "columns"]):
                    h, w = int(h), int(w)
                    nh, nw, top, left = fitted(h, w, side)
                    x = np.frombuffer(b"".join(map(bytes, own["pixels"])), np.uint8).reshape(-1, h, w)
                    canvas = np.zeros((len(own), side, side), np.uint8)
                    canvas[:, top : top + nh, left : left + nw] = resized(x, nh, nw)
                    for i, c in zip(own.index.tolist(), canvas, strict=True):
                        out[i] = c.tobytes()
                yield part.drop(columns=["square"], errors="ignore").assign(square=out)

    return df.mapInPandas(run, schema)
