"""Telephony audio in media columns: mu-law and A-law by lookup table, IMA ADPCM with numpy across blocks, resampled PCM out.

A media column is a binary column of whole RIFF/WAVE files, so rows are read back without outside knowledge.

Defined results: a null or empty payload is stored as silence of the shortest unit; nulls in other columns pass through, null
ids stay null; equal payloads, in repeated rows too, give equal files and features; an empty table gives an empty result;
text_media ignores other columns, store and to_pcm keep them but replace one of the name of their output; a file that is no
WAVE file of a known codec raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import as_bytes, map_arrow

#: WAVE format tags (fixed values).
FORMATS = {"pcm": 0x0001, "alaw": 0x0006, "mulaw": 0x0007, "adpcm": 0x0011}
RATE = 8000
BLOCK = 64

# The IMA ADPCM step sizes and index adjustments.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
ADJUST = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law code, by the G.711 rule."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law code, by the G.711 rule."""
    a = np.arange(256) ^ 0x55
    seg, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(seg == 0, low + 8, (low + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(data: bytes, block: int = BLOCK) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (int16 first sample, index byte, reserved byte, nibbles low first).

    One step of the loop decodes the same nibble of every block at once. A step index above 88 counts as 88.
    """
    if len(data) % block:
        raise ValueError("ADPCM data isn't a multiple of its block size")
    b = np.frombuffer(data, np.uint8).reshape(-1, block)
    sample = b[:, :2].copy().view("<i2").reshape(-1).astype(np.int32)
    index = np.minimum(b[:, 2].astype(np.int32), 88)
    out = np.empty((len(b), 2 * (block - 4) + 1), np.int16)
    out[:, 0] = sample
    for k in range(2 * (block - 4)):
        code = (b[:, 4 + k // 2] >> (4 * (k % 2))).astype(np.int32) & 15
        step = STEPS[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        sample = np.clip(sample + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + ADJUST[code], 0, 88)
        out[:, k + 1] = sample
    return out.reshape(-1)


def wave(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file around coded data."""
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    align = {"pcm": 2, "adpcm": BLOCK}.get(codec, 1)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * bits // 8, align, bits)
    if codec == "adpcm":
        fmt += struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1)
    elif codec != "pcm":
        fmt += struct.pack("<H", 0)
    fact = b"fact" + struct.pack("<II", 4, len(data) // align * (2 * (BLOCK - 4) + 1 if codec == "adpcm" else 1))
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + (fact if codec != "pcm" else b"") + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(file: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, coded data) of a WAVE file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
        if kind == b"data":
            codec = {v: k for k, v in FORMATS.items()}.get(tag)
            if codec is None:
                raise ValueError(f"unknown WAVE format {tag}")
            return codec, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(codec: str, data: bytes) -> np.ndarray:
    if codec == "adpcm":
        return decode_adpcm(data)
    return np.frombuffer(data, "<i2") if codec == "pcm" else TABLES[codec][np.frombuffer(data, np.uint8)]


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers, round half up; the last sample is held."""
    n = len(x) * to // rate
    if rate == to or not n:
        return x[:n].copy()
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        out[::2] = x
        out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:] + 1) >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(x) - 1)
    return ((x[left] * (to - part) + x[right] * part + to // 2) // to).astype(np.int16)


def features(x: np.ndarray) -> str:
    """Energy, peak and sign changes of PCM, in integers."""
    if not len(x):
        return "n=0"
    wide = x.astype(np.int64)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};ms={int((wide * wide).sum()) // len(x)};mean={int(wide.sum()) // len(x)};peak={int(np.abs(wide).max())};zc={changes}"


def store(df: DataFrame, payload: str = "payload", codec: str = "mulaw", out: str = "media") -> DataFrame:
    """df with the WAVE file of each payload of coded samples as column out; a null payload counts as empty."""
    return _with_binary(df, payload, out, lambda x: wave(codec, x))


def to_pcm(df: DataFrame, media: str = "media", out: str = "pcm", rate: int = 16000) -> DataFrame:
    """df with column out: each file of the media column expanded, resampled to rate and stored as a PCM WAVE file (null stays null)."""

    def one(file: bytes) -> bytes:
        codec, own, data = read_wave(file)
        return wave("pcm", resample(decode(codec, data), own, rate).tobytes(), rate)

    return _with_binary(df, media, out, one, keep_null=True)


def _with_binary(df: DataFrame, source: str, out: str, f, keep_null: bool = False) -> DataFrame:
    from pyspark.sql.types import BinaryType, StructField, StructType

    from reportloom.llm.common import ship

    df = df.drop(out)  # a column of that name is replaced
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            got = [None if x is None and keep_null else f(x or b"") for x in b.column(b.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, BinaryType())]))


def pad(data: bytes, unit: int = BLOCK) -> bytes:
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def _parts(raws, size: int = 1 << 21):
    """Lists of consecutive byte strings of about `size` bytes together, or one longer string."""
    part, total = [], 0
    for raw in raws:
        part.append(raw)
        total += len(raw)
        if total >= size or len(part) == 4096:
            yield part
            part, total = [], 0
    if part:
        yield part


def decode_all(codec: str, coded: list[bytes]) -> list[np.ndarray]:
    """decode of each; blocks of ADPCM don't depend on each other, so those of all texts are decoded together."""
    if codec != "adpcm":
        return [decode(codec, x) for x in coded]
    samples = decode_adpcm(b"".join(coded))
    ends = np.cumsum([len(x) // BLOCK * (2 * (BLOCK - 4) + 1) for x in coded])
    return np.split(samples, ends[:-1])


def text_media(docs: DataFrame, codec: str = "mulaw", rate: int = 16000) -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded, as telephony codes in a WAVE file, read back, expanded, resampled and described.

    docs: doc_id, text (null: empty). One row in, one row out, no exchange: columns as registered in queries.py. The first columns
    are of `codec`; digests of the file and of the resampled PCM file and features of the other codecs follow, by their names.
    """
    others = [c for c in ("mulaw", "alaw", "adpcm") if c != codec]
    last = ["pcm_sha256", *[f"{c}_{k}" for c in others for k in ("media_sha256", "pcm_sha256", "feature")]]

    def f(b: pa.RecordBatch) -> dict:
        got: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *last)}
        for part in _parts(as_bytes(b.column(1))):
            payloads = [pad(raw) for raw in part]
            for c in (codec, *others):
                files = [wave(c, x) for x in payloads]
                coded = [read_wave(x) for x in files]
                prefix = "" if c == codec else f"{c}_"
                for raw, file, (_, own, data), samples in zip(part, files, coded, decode_all(c, [x[2] for x in coded]), strict=True):
                    pcm = wave("pcm", resample(samples, own, rate).tobytes(), rate)
                    row = {f"{prefix}media_sha256": hashlib.sha256(file).hexdigest(), f"{prefix}pcm_sha256": hashlib.sha256(pcm).hexdigest(), f"{prefix}feature": features(np.frombuffer(read_wave(pcm)[2], "<i2"))}
                    if c == codec:
                        row |= {"n_bytes": len(raw), "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-BLOCK:]), "media_bytes": len(file)}
                    for k, v in row.items():
                        got[k].append(v)
        return got | {"doc_id": b.column(0)}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    schema += ", ".join(f"{k} string" for k in last)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, f)
