"""Files that rows name, DICOM files and resampling, against Python."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.sources import files, images, io


def test_read_look_and_write(spark, tmp_path):
    rows = [(k, f"file://{tmp_path}/a b/{k % 3}/f{k}.bin", bytes([k]) * k) for k in range(150)]
    df = spark.createDataFrame(rows, "content long, path string, data binary").repartition(3)
    files.write_files(df.where("content <> 5"), "path", "data")
    files.write_files(spark.createDataFrame([(None, b"x"), ("", b"y"), (f"{tmp_path}/none", None)], "path string, data binary"), "path", "data")
    assert not (tmp_path / "none").exists()
    more = df.unionByName(spark.createDataFrame([(900, None, None), (901, "", None), (902, str(tmp_path), None), (903, f"{tmp_path}/a b/1/f1.bin", None)], df.schema))
    got = {r.content: r.bytes for r in files.read_files(more, "path", "bytes").collect()}
    assert got == {**{k: bytearray(d) for k, _, d in rows if k != 5}, 5: None, 900: None, 901: None, 902: None, 903: bytearray(b"\x01")}
    assert {r.content for r in files.existing_files(more, "path").collect()} == {*range(150), 903} - {5}
    assert {r.path[-6:]: r.content for r in files.read_files(df.where("content < 3"), "path").collect()}["f2.bin"] == bytearray(b"\x02\x02")
    assert files.read_files(df.where("false"), "path", "bytes").count() == 0
    assert files.reachable(str(tmp_path)) and files.reachable(f"file:{tmp_path}") and not files.reachable("viewfs://in/x")


def test_reports_by_name_and_by_listing(spark, tmp_path, monkeypatch):
    """Both ways give the same texts and rows."""
    root = tmp_path / "files"
    for subject, study, data in ((1234, 1, b"FINDINGS: a\xff\nIMPRESSION: b"), (1234, 2, "INDICATION: é".encode()), (99, 3, b"\n")):
        p = root / f"p{str(subject)[:2]}" / f"p{subject}" / f"s{study}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    df = spark.createDataFrame([(1234, 1), (1234, 2), (99, 3), (99, 4), (None, 1), (1234, 1)], "subject_id long, study_id long")
    by_name = sorted(map(tuple, io.with_sections(df, str(root)).collect()), key=str)
    paths = df.where("subject_id IS NOT NULL").select(io.report_path(F.col("subject_id"), F.col("study_id"), str(root)).alias("p"))
    looked = sorted(r.p for r in io.existing(paths, "p", str(root), "s*.txt").collect())
    assert io.existing(paths, "p", str(root), "s[1].*").count() == 0 and io.existing(paths, "p", str(tmp_path / "fil")).count() == 0
    monkeypatch.setattr(files, "reachable", lambda _: False)
    assert sorted(map(tuple, io.with_sections(df, str(root)).collect()), key=str) == by_name
    assert sorted(r.p for r in io.existing(paths, "p", str(root), "s*.txt").collect()) == looked and len(looked) == 4
    assert (1234, 1, "", "a", "b") in by_name and (99, 4, "", "", "") in by_name and (None, 1, "", "", "") in by_name


def expected(pixels, invert, slope=1, intercept=0):
    x = (pixels * float(slope) + intercept).astype(np.float32)
    out = np.zeros(x.shape, np.uint8)
    for i in np.ndindex(x.shape):
        u = (x[i] - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.float32(0)
        out[i] = int((np.float32(1) - u if invert else u) * np.float32(255))
    return out


def test_dicom():
    r = np.random.default_rng(3)
    for k in range(12):
        x = r.integers(-2000 if k % 2 else 0, 4000, (r.integers(1, 9), r.integers(1, 9)))
        slope, intercept = ((1, 0), (0.5, -1024), (2, 7.25))[k % 3]
        data = images.encode_dicom(x, "MONOCHROME1" if k % 4 == 1 else "MONOCHROME2", slope, intercept)
        assert (images.decode_dicom(data) == expected(x, k % 4 == 1, slope, intercept)).all()
    flat = images.encode_dicom(np.full((2, 2), 9), "MONOCHROME1")
    assert (images.decode_dicom(flat) == 255).all() and (images.decode_dicom(images.encode_dicom(np.full((2, 2), 9))) == 0).all()


def test_dicom_sequences_and_what_is_no_image():
    data = images.encode_dicom(np.arange(6).reshape(2, 3))
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + struct.pack("<HH2sH", 0x0008, 0x1150, b"UI", 4) + b"1.2\0" + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    inner = struct.pack("<HH2s2xI", 0x0008, 0x1111, b"SQ", 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    known = struct.pack("<HHI", 0xFFFE, 0xE000, 12) + struct.pack("<HH2sH", 0x0008, 0x1150, b"UI", 4) + b"1.3\0"
    outer = struct.pack("<HH2s2xI", 0x0008, 0x1112, b"SQ", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + inner + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + known + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    at = data.index(struct.pack("<HH", 0x0028, 0x0004))
    assert (images.decode_dicom(data[:at] + outer + data[at:]) == images.decode_dicom(data)).all()
    for bad in (b"", b"x" * 500, data[:-5], data[:140], data.replace(b"1.2.840.10008.1.2.1", b"1.2.840.10008.1.2.2"), data.replace(b"OW\0\0\x0c\0\0\0", b"OB\0\0\xff\xff\xff\xff")):
        with pytest.raises(ValueError):
            images.decode_dicom(bad)


def cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def direct(x, height, width):
    """Each new pixel as the weighted sum of its old ones, across, then down."""

    def line(values, new):
        n, out = len(values), []
        scale = n / new
        wide = max(scale, 1.0)
        for k in range(new):
            center = (k + 0.5) * scale
            own = range(max(0, int(center - 2 * wide + 0.5)), min(n, int(center + 2 * wide + 0.5)))
            w = [cubic((i - center + 0.5) / wide) for i in own]
            fixed = [int(v / sum(w) * (1 << 22) + (0.5 if v / sum(w) >= 0 else -0.5)) for v in w]
            total = sum(f * int(values[i]) for f, i in zip(fixed, own, strict=True))
            out.append(min(255, max(0, math.floor((total + (1 << 21)) / (1 << 22)))))
        return out

    across = [line(row, width) for row in x.tolist()] if width != x.shape[1] else x.tolist()
    down = [line(col, height) for col in zip(*across, strict=True)] if height != x.shape[0] else list(zip(*across, strict=True))
    return np.array(list(zip(*down, strict=True)), np.uint8)


def test_resampling():
    r = np.random.default_rng(4)
    for h, w, nh, nw in ((5, 7, 20, 28), (20, 31, 6, 9), (8, 8, 8, 8), (1, 9, 3, 27), (13, 4, 40, 12), (9, 1, 9, 2)):
        x = np.stack([r.integers(0, 256, (h, w)), np.where(r.random((h, w)) < 0.5, 0, 255)]).astype(np.uint8)
        got = images.resized(x, nh, nw)
        assert all((got[k] == direct(x[k], nh, nw)).all() for k in range(2)), (h, w, nh, nw)


def test_decoded_and_squared_columns(spark):
    x = np.arange(12).reshape(3, 4)
    df = spark.createDataFrame([(1, images.encode_dicom(x), "a"), (2, None, "b"), (3, b"nothing", "c"), (4, images.encode_dicom(x.T.copy()), "d"), (1, images.encode_dicom(x), "a")], "id long, content binary, rows string")
    got = images.squared(images.decoded(df), 8).collect()
    by = {r.id: r for r in got}
    assert len(got) == 5 and (by[1].rows, by[1].columns, by[4].rows, by[4].columns) == (3, 4, 4, 3)
    assert by[2].square is None and by[2].problem is None and by[3].pixels is None and by[3].problem == "no DICOM file"
    s = np.frombuffer(by[1].square, np.uint8).reshape(8, 8)
    assert (s[1:7] == direct(expected(x, False), 6, 8)).all() and not s[0].any() and not s[7].any()
    assert (np.frombuffer(by[4].square, np.uint8).reshape(8, 8)[:, 1:7] == direct(expected(x.T, False), 8, 6)).all()
    assert images.squared(images.decoded(df.where("false"))).count() == 0
