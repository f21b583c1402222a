"""Operators over documents against brute force."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportloom.llm import bpe, jaccard, licenses, media, packing, quality, sharding, suffixes

from .fixtures import SCHEMA, documents


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# ------------------------------------------------------------ 1


def components(rows, k, num, den):
    sets = []
    for r in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(r[1])]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {(len(w), *w)} if w else set())
    label = {}
    of = [r[0] if r[0] is not None else ("null", n) for n, r in enumerate(rows)]
    up = {x: x for x in of}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(of[i]), root(of[j])
                if a != b:
                    up[a] = b
    for x in of:
        label.setdefault(root(x), []).append(x)
    least = {x: min([y for y in g if not isinstance(y, tuple)], default=None) for g in label.values() for x in g}
    return Counter((r[0], len(s), least[o]) for r, s, o in zip(rows, sets, of, strict=True))


@pytest.mark.parametrize("k,num,den,chunk", [(3, 90, 100, 512), (5, 8, 10, 512), (5, 8, 10, 2)])
def test_jaccard(docs, rows, k, num, den, chunk):
    got = Counter(tuple(r) for r in jaccard.join(docs, k, num, den, chunk).collect())
    known = [r for r in rows if r[0] is not None]
    assert Counter({x: n for x, n in got.items() if x[0] is not None}) == Counter({x: n for x, n in components(known, k, num, den).items()})
    assert sum(n for x, n in got.items() if x[0] is None) == 2


def test_jaccard_of_large_groups_without_bitmaps(docs, rows, monkeypatch):
    """Groups beyond PRUNED keep all their nodes: the result is the same."""
    monkeypatch.setattr(jaccard, "PRUNED", 1)
    known = [r for r in rows if r[0] is not None]
    got = Counter(tuple(r) for r in jaccard.join(docs, 5, 8, 10, 3).collect())
    assert Counter({x: n for x, n in got.items() if x[0] is not None}) == Counter({x: n for x, n in components(known, 5, 8, 10).items()})


def test_join_beyond_the_broadcast_size(docs, monkeypatch):
    from reportloom.llm import common

    want = Counter(tuple(r) for r in jaccard.join(docs, 5, 8, 10).collect())
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert Counter(tuple(r) for r in jaccard.join(docs, 5, 8, 10).collect()) == want


def test_one_of_each(spark):
    r = __import__("random").Random(3)
    a, b, c = (" ".join(str(r.randrange(10**6)) for _ in range(60)) for _ in range(3))
    near = a + " tail"
    rows = [(1, a), (1, a), (2, near), (7, near), (7, b), (None, a), (None, a), (9, ""), (9, ""), (11, None), (12, "  "), (5, c), (5, c + " x")]
    got = Counter(tuple(x) for x in jaccard.one_of_each(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, tid string"), 5, 8, 10).select("doc_id", "text").collect())
    (five,) = [t for i, t in got if i == 5]
    assert five in (c, c + " x")
    assert got == Counter([(1, a), (7, b), (None, a), (None, a), (9, ""), (9, ""), (11, None), (12, "  "), (5, five)])


def changed(a, num, den, r):
    """A set as far from a as the threshold lets it be."""
    b = a.copy()
    while True:
        c = b[r.permutation(len(b))[: len(b) - 1]] if r.random() < 0.5 and len(b) > 1 else np.append(b, r.integers(0, 1 << 64, 1, dtype=np.uint64))
        c = np.unique(c)
        both = len(np.intersect1d(a, c))
        if den * both < num * (len(a) + len(c) - both):
            return b
        b = c


def test_pairs_that_link_share_a_key():
    r = np.random.default_rng(1)
    for num, den in ((9, 10), (8, 10), (6, 10)):
        classes = jaccard.Classes(num, den)
        for n in (1, 2, 5, 9, 10, 11, 19, 30, 47, 48, 49, 120, 500):
            for _ in range(20):
                a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
                b = changed(a, num, den, r)
                assert (len(a) == len(b) and (a == b).all()) or set(classes.keys(a).tolist()) & set(classes.keys(b).tolist())


def test_pairs_that_link_share_a_key_when_bins_stay_empty(monkeypatch):
    """Too few bins in the first rounds, so that sets need several."""
    r = np.random.default_rng(4)
    plain = jaccard.Classes.bins
    monkeypatch.setattr(jaccard.Classes, "bins", lambda self, level, round_: max(2, plain(self, level, round_) // 4))
    classes = jaccard.Classes(8, 10)
    for n in (6, 10, 40, 200):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            b = changed(a, 8, 10, r)
            assert (len(a) == len(b) and (a == b).all()) or set(classes.keys(a).tolist()) & set(classes.keys(b).tolist())


@pytest.mark.parametrize("n,low,high", [(2000, 40, 60), (5000, 300, 500), (20000, 40, 60)])
def test_unrelated_sets_share_no_key(n, low, high):
    r = np.random.default_rng(n)
    classes = jaccard.Classes(8, 10)
    keys = np.concatenate([classes.keys(np.unique(r.integers(0, 1 << 64, int(r.integers(low, high)), dtype=np.uint64))) for _ in range(n)])
    assert len(np.unique(keys)) == len(keys)


def test_long_texts_in_windows():
    r = __import__("random").Random(8)
    texts = [" ".join("".join(r.choice("abC") for _ in range(r.randrange(1, 30))) for _ in range(n)) + " " * (n % 3) for n in (0, 1, 3, 40, 200)] + ["x" * 500, " " * 90, "  a  "]
    for window in (1, 5, 64, 1000):
        for t in texts:
            (a,), (b,) = list(jaccard.shingle_sets([t.encode()], 5)), list(jaccard.shingle_sets([t.encode()], 5, window))
            assert a.tolist() == b.tolist()
        assert [x.tolist() for x in jaccard.shingle_sets([t.encode() for t in texts], 5, window)] == [x.tolist() for x in jaccard.shingle_sets([t.encode() for t in texts], 5)]


def near_sets(r, n=12):
    sets = []
    for _ in range(n):
        base = np.unique(r.integers(0, 1 << 64, int(r.integers(5, 300)), dtype=np.uint64))
        sets += [base, np.unique(np.append(base[1:], r.integers(0, 1 << 64, 1, dtype=np.uint64)))]
    return sets


def test_bitmaps_prune_no_link():
    r = np.random.default_rng(2)
    groups = [near_sets(r, n) for n in (1, 12, 3, 40)]
    alive = jaccard.with_partner([([jaccard.signature(x) for x in sets], [len(x) for x in sets]) for sets in groups], 8, 10)
    found = jaccard.Links(8, 10)
    at, every, whole = 0, [], set()
    for sets, left in zip(groups, alive, strict=True):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 8 * (len(sets[i]) + len(sets[j]) - b)}
        assert {k for p in want for k in p} <= set(np.flatnonzero(left).tolist())
        ids = list(range(at, at + len(sets)))
        every.append((ids, sets, ids, None))
        whole |= {(at + i, at + j) for i, j in want}
        at += len(sets)
    found.add(every)
    assert {tuple(sorted(x, reverse=True)) for x in found.found} <= whole
    joined, exact = {found.root(i): 0 for i in range(at)}, jaccard.Links(8, 10)
    for i, j in whole:
        exact.link(i, j, (i, j))
    assert len(joined) == len({exact.root(i) for i in range(at)})
    tiles = jaccard.Links(8, 10)
    half = [(ids, sets, ids, len(sets) // 2) for ids, sets, *_ in every]
    tiles.add(half)
    assert {tuple(sorted(x, reverse=True)) for x in tiles.found} == {(i, j) for i, j in whole for ids, _, _, n in half if j in ids[:n] and i in ids[n:]}


# ------------------------------------------------------------ 2


@pytest.mark.parametrize("count", ["documents", "texts"])
def test_quality(spark, count):
    """With twelve copies of one text in a host: lines of theirs are frequent by documents, and one line by texts."""
    rows = documents()
    rows += [(1000 + k, rows[0][1], "en", "src0", None) for k in range(12)] + [(1000, rows[3][1], "en", "src0", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.doc_id, r.n_chars0): r for r in quality.apply_rules(docs, count=count).select("*", F.coalesce(F.length("row.text"), F.lit(-1)).alias("n_chars0")).collect()}
    lines = Counter()
    texts, units = {}, {}
    for r in rows:
        unit = r[0] if count == "documents" else r[1] or ""
        texts.setdefault(r[3], set()).add(unit)
        units.setdefault((r[3], unit), []).append(r[1] or "")
    norm = lambda x: " ".join(x.split()).lower()
    for (host, _), ts in units.items():
        lines.update({(host, norm(x)) for t in ts for x in t.split("\n") if x.split()})
    for r in rows:
        t = r[1] or ""
        w = words(t)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(g)
        hit = {j for i, x in enumerate(g) if n[x] > 1 for j in range(i, i + 5)}
        own = [x for x in t.split("\n") if x.split()]
        often = [x for x in own if lines[r[3], norm(x)] > 10 and 100 * lines[r[3], norm(x)] > 5 * len(texts[r[3]])]
        x = got[r[0], -1 if r[1] is None else len(r[1])]
        assert (x.n_words, x.word_chars, x.n_repeat_words, x.n_dup_lines) == (len(w), len(b"".join(w).decode()), len(hit), len(own) - len(set(own)))
        assert x.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert x.n_removed_words == sum(len(y.split()) for y in often)


def test_quality_plan_is_native(docs):
    plan = quality.op2(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------ 3


def test_license_files_as_they_are_found(spark):
    mit, isc, bsd = licenses.KNOWN["MIT (no title)"], licenses.KNOWN["ISC"], licenses.KNOWN["BSD-3-Clause"]
    wrap = lambda t, n=70: "\n\n".join(textwrap.fill(x, n) for x in t.split("\n\n"))
    line = isc.replace("the above copyright notice", "the above\ncopyright notice")
    whole = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    cases = [
        ("The MIT License (MIT)\n\nCopyright (c) 2019 Some Body\n\n" + wrap(mit), "MIT"), ("Copyright 2019 Some Body\n\n" + wrap(mit, 60), "MIT"), ("Released under the MIT License.", "MIT notice"),
        ("ISC License\n\nCopyright (c) 2004-2010, Some Body\n\n" + line, "ISC"), (line.replace("and/or", "and"), "ISC"), ("ISC License\n" + licenses.KNOWN["0BSD"], None),
        *[(wrap(isc, n), "ISC") for n in range(40, 90)],
        ("BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n" + wrap(bsd), "BSD-3-Clause"), (bsd.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* "), "BSD-3-Clause"),
        *[(t, k) for k, t in whole.items()], *[(t.replace("\n", "\r\n").upper(), k) for k, t in whole.items()],
        ("Copyright 2024 Some Body\n\n" + whole["Apache-2.0"].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS", "Apache-2.0"),
        *[(wrap(whole["Apache-2.0"], n), "Apache-2.0") for n in (50, 61, 72)],
        (whole["GPL-3.0"][:-400], None), (isc.replace("copyright notice", "notice"), None),
    ]
    got = licenses.op3(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(k, r.license_id) for k, r in enumerate(got)] == [(k, want) for k, (_, want) in enumerate(cases)]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "BSL-1.0"} <= set(whole)


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, mit.upper().replace("\n", "\r\n"), mit.replace("<year> <holder>", "1999-2024 Some Body"), mit + " extra", mit.replace("sublicense", "sub license"), licenses.KNOWN["0BSD"].replace("LIABLE", "liable;"), "", None, "Copyright 2020 X", "Licenced", licenses.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement")]
    got = [r.license_id for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "MIT", None, None, "0BSD", None, None, None, None, "Zlib"]
    own = spark.createDataFrame([("a", "Some Licence"), ("b", "some LICENSE!")], "license_id string, text string")
    assert [r.license_id for r in licenses.scan(spark.createDataFrame([(1, "SOME license")], "doc_id long, text string"), own).collect()] == ["a"]
    plan = licenses.op3(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------ 5


def test_shards(docs, rows):
    got = sharding.op5(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))

    def key(r):
        return int(hashlib.md5((r[1] or "").encode()).hexdigest()[:10] + hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:5], 16)

    total = sum(r.size for r in got)
    want = Counter()
    keyed = sorted(((key(r), len((r[1] or "").encode()) + 1, -1 if r[0] is None else r[0]) for r in rows))
    for k, _, i in keyed:
        want[i, min(15, sum(s for q, s, _ in keyed if q < k) * 16 // total)] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.shard) for r in got) == want


def test_shards_refine(spark):
    sized = spark.createDataFrame([(k * k * k + 5, 1 + k % 7) for k in range(3000)], "key long, size long")
    starts, _ = sharding.splitters(sized, 9, 5)
    total = sum(1 + k % 7 for k in range(3000))
    for i, s in enumerate(starts, 1):
        below = sum(1 + k % 7 for k in range(3000) if k * k * k + 5 < s)
        assert 0 <= below * 9 - i * total < 7 * 9
    assert len(sharding.splitters(sized, 9, 5, 0.01)[0]) == 8


# ------------------------------------------------------------ 6


def removed(rows, length=50):
    first = {}
    for r in rows:
        b, d = (r[1] or "").encode(), (1 << 63) - 1 if r[0] is None else r[0]
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = Counter()
    for r in rows:
        b, d = (r[1] or "").encode(), (1 << 63) - 1 if r[0] is None else r[0]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out[r[0], len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(docs, rows):
    assert Counter(tuple(r) for r in suffixes.dedup_digests(docs).collect()) == removed(rows)


def test_suffix_dedup_by_small_buckets(docs, rows, monkeypatch, spark):
    from reportloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1 << 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert Counter(tuple(r) for r in suffixes.dedup_digests(docs).collect()) == removed(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_extents_of_long_texts_in_windows(rows):
    texts = [(r[1] or "").encode()[:3000] for r in rows]

    def strings(window):
        return {(int(t), int(a), s) for n, anchors, lo, hi in suffixes.extents(texts, window=window) for t, a, i, j in zip(n, anchors, lo, hi, strict=True) for s in range(i, j - 49)}

    want = strings(None)
    assert {(t, s) for t, _, s in want} == {(k, s) for k, x in enumerate(texts) for s in range(len(x) - 49)}
    for window in (7, 50, 333, 2048):
        assert strings(window) == want


def test_merged_spans():
    r = np.random.default_rng(6)
    tid, start = r.integers(0, 4, 200), r.integers(0, 900, 200)
    end = start + r.integers(1, 30, 200)
    for most in (7, 1000):
        got = list(zip(*map(np.ndarray.tolist, suffixes.merged(tid, start, end, most)), strict=True))
        assert sorted((t, x) for t, s, n in got for x in range(s, s + n)) == sorted({(t, x) for t, i, j in zip(tid.tolist(), start.tolist(), end.tolist(), strict=True) for x in range(i, j)})
        assert all(0 < n <= most for *_, n in got)


def test_one_text_of_twenty_megabytes(spark):
    r = np.random.default_rng(11)
    words = np.array(["".join(r.choice(list("abcdefghij"), 6)) for _ in range(5000)])
    long = " ".join(words[r.integers(0, 5000, 3_000_000)])
    passage = long[9_000_000:9_000_200]
    docs = spark.createDataFrame([(1, long), (2, "start " + passage + " end"), (3, "nothing of it")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.dedup_digests(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 200, 1, 0) or (got[2].n_removed, got[2].n_spans) in ((201, 1), (202, 1))
    n = {r.doc_id: r.n_shingles for r in jaccard.join(docs, 5, 8, 10).collect()}
    assert n[3] == 1 and n[1] > 2_900_000


def test_suffix_dedup_low_entropy(spark):
    r = np.random.default_rng(3)
    rows = [(k, "".join(r.choice(list("ab"), int(r.integers(0, 400))))) for k in range(30)] + [(40, "a" * 300), (41, "a" * 120 + "b"), (42, "ab" * 100), (43, "b" + "ab" * 60)]
    rows += [(50 + k, rows[3][1][20:90] + "x" * k + rows[4][1][:80]) for k in range(5)]
    got = Counter(tuple(x) for x in suffixes.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == removed(rows)


def test_interval_groups():
    exts = [b"xxabcdefghij", b"yyabcdefghij", b"zzabcdefghiq"]
    got = {(p, tuple(sorted(zip(e.tolist(), o.tolist(), strict=True)))) for p, e, o in suffixes.interval_groups(exts, np.array([1, 2, 3]), 5)}
    assert got == {(10, ((0, 2), (1, 2))), (9, ((0, 2), (1, 2), (2, 2)))}


def test_dedup_texts_keeps_columns_and_characters(docs, rows):
    out = suffixes.dedup_texts(docs.withColumn("tid", F.lit("clash")).withColumn("spans", F.lit(1)))
    assert out.columns == [*docs.columns, "tid", "spans"]
    got = out.collect()
    assert {r.tid for r in got} == {"clash"} and all((r.text is not None) for r in got)
    assert {r[0] for r in rows if r[1] and len(r[1].encode()) < 50} <= {r.doc_id for r in got}


# ------------------------------------------------------------ 8


def test_expansion_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def scalar_adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + int(media.ADJUST[code])))
            out.append(sample)
    return out


def test_adpcm():
    data = np.random.default_rng(4).integers(0, 256, 64 * 50, dtype=np.uint8).tobytes()
    assert media.decode_adpcm(data).tolist() == [x for k in range(50) for x in scalar_adpcm(data[64 * k : 64 * k + 64])]


def test_media(docs, rows, spark):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.text_media(docs).collect())
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want
    t = spark.createDataFrame([(1, bytearray(b"\x00\xff" * 64)), (2, None)], "id long, payload binary")
    for codec in ("mulaw", "alaw", "adpcm"):
        for r in media.to_pcm(media.store(t, codec=codec)).collect():
            assert media.read_wave(bytes(r.media))[::2] == (codec, bytes(r.payload or b"")) and media.read_wave(bytes(r.pcm))[:2] == ("pcm", 16000)
    x = np.arange(-50, 50, dtype=np.int16) * 300
    assert media.resample(x, 8000, 8000).tolist() == x.tolist() and len(media.resample(x, 8000, 12000)) == 150


# ------------------------------------------------------------ 9, 10

ODD = ["<|endoftext|>a <|startoftext|>", "can't I'LL  x'd", "a b c", "é É ́x", "\x1c\x1d a\x00b", "İSTANBUL ΣΑΣ ǅ", "日本語 12345 ４５", "a\u0085b​c", "🙂🙂 ok", "x" * 3000, "﻿ bom", "it's 'S 'ſ ''t rock'n'roll 12'34 x''s", "naïve ÀÉÎ-ÿ ×÷ µ ª Œuvre straße à", "[a]{b}~`^_@  ab\ncd", "<|x|> a<|endoftext|>b"]


def test_bpe(spark, rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    every = [(r[0], r[1]) for r in rows] + [(100 + k, x) for k, x in enumerate(ODD)]
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in bpe.encode_decode(docs, block_bytes=9000).collect())
    want = Counter()
    for i, x in every:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_packing(spark, rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    every = [(n, r[1]) for n, r in enumerate(rows)] + [(100 + k, x) for k, x in enumerate(ODD)]
    got = packing.pack_documents(spark.createDataFrame(every, "doc_id long, text string").coalesce(1), with_ids=True).collect()
    for i, x in every:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [y for r in own for y in r.ids] == ids.tolist() and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 2048, 64)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= total // 2048 + 2


def test_many_rows_of_one_id_and_one_text(spark):
    """One doc_id of 10,000 rows and copies of one text: blocks stay small, and every row gets its answer."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, f"row {k} of one id") for k in range(10_000)] + [(k, "a copy") for k in range(2, 2002)] + [(5, "a copy")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.ids_sha256) for r in bpe.encode_decode(docs, block_bytes=20_000).collect())
    digest = lambda x: hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest()
    assert got == Counter((i, digest(x)) for i, x in rows)
    from reportloom.llm import common

    single, ids = common.one_per_text(docs.withColumn("tid", F.xxhash64("text")))
    assert single.where("text = 'a copy'").count() == 1 and ids.count() == 10_001


def check_sequences(pieces, capacity, segments):
    by = {}
    for s, o, n in pieces:
        by.setdefault(s, []).append((o, n))
    for x in by.values():
        x.sort()
        assert all(o == sum(n for _, n in x[:k]) for k, (o, _) in enumerate(x)) and sum(n for _, n in x) <= capacity and len(x) <= segments


def test_packing_limits():
    r = np.random.default_rng(5)
    p = packing.Packer(100, 4, 40, 5)
    items = {k: (int(n), int(r.integers(0, n + 1))) for k, n in enumerate(r.integers(1, 350, 500))}
    pieces = [x for k, (n, loss) in items.items() for x in p.add(k, n, loss)] + list(p.pack(last=True))
    check_sequences([(s, o, n) for _, _, n, s, o in pieces], 100, 4)
    borne = Counter()
    for k, start, n, s, _ in pieces:
        first = items[k][0] - items[k][1]
        borne[s] += max(0, start + n - max(start, first))
    assert max(borne.values()) <= 40
    for k, (n, _) in items.items():
        own = sorted((a, b) for t, a, b, _, _ in pieces if t == k)
        assert sum(b for _, b in own) == n and all(a == sum(b for _, b in own[:j]) for j, (a, _) in enumerate(own))


# ------------------------------------------------------------ all


def test_text_media_runs_all_codecs(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    got = media.text_media(docs).collect()
    data = spark.createDataFrame([(k, media.pad((t or "").encode())) for k, (_, t, *_) in enumerate(documents())], "k long, payload binary")
    for codec, prefix in (("mulaw", ""), ("alaw", "alaw_"), ("adpcm", "adpcm_")):
        want = Counter()
        for r in media.to_pcm(media.store(data, codec=codec)).collect():
            pcm = bytes(r.pcm)
            want[hashlib.sha256(bytes(r.media)).hexdigest(), hashlib.sha256(pcm).hexdigest(), media.features(np.frombuffer(media.read_wave(pcm)[2], "<i2"))] += 1
        assert Counter((r[f"{prefix}media_sha256"], r[f"{prefix}pcm_sha256"], r[f"{prefix}feature"]) for r in got) == want


def test_near_copies_with_null_ids_only(spark):
    text = " ".join(f"w{k}" for k in range(200))
    other = " ".join(f"v{k}" for k in range(200))
    rows = [(5, text), (None, text + " tail"), (None, text + " tail"), (None, "x " + text), (6, other), (None, "far from all of these " * 9)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(5, 198, 5): 1, (None, 199, 5): 3, (6, 198, 6): 1, (None, 5, None): 1}


_CLASH = ("tid", "rep", "n", "key", "cell", "shard", "slot", "node", "size", "row", "h", "digest", "spans", "block", "words", "start", "payload", "media", "id", "label", "kept", "marks")


@pytest.mark.parametrize("op", [jaccard.op1, quality.op2, licenses.op3, sharding.op5, suffixes.dedup_digests, media.text_media, bpe.encode_decode])
def test_columns_that_clash_change_nothing(docs, op):
    plain = Counter(tuple(r) for r in op(docs).collect())
    assert Counter(tuple(r) for r in op(docs.withColumns({c: F.lit("x") for c in _CLASH})).collect()) == plain
    assert sum(plain.values()) == docs.count()


def test_packing_ignores_columns_that_clash(docs):
    more = docs.withColumns({c: F.lit("x") for c in _CLASH})
    sizes = lambda d: Counter((r.doc_id, r.doc_tokens) for r in packing.pack_documents(d).where("start = 0").collect())
    assert sizes(more) == sizes(docs) and sum(sizes(docs).values()) == docs.count()


def test_license_rows_repeat_and_variants_hit(spark, docs):
    row = (None, licenses.KNOWN["ISC"], "id")
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame([row, row, (3, None, "x"), (4, "", "x")], "doc_id long, text string, license_id string")).select("doc_id", "license_id").collect()]
    assert Counter(got) == Counter({(None, "ISC"): 2, (3, None): 1, (4, None): 1})
    found = licenses.variants(docs).where("variant >= 0").collect()
    assert all((r.license_id is not None) == (r.variant < 4) for r in found) and len(found) == 5 * len(licenses.KNOWN)


@pytest.mark.parametrize("op", [jaccard.op1, quality.op2, licenses.op3, sharding.op5, suffixes.dedup_digests, media.text_media, bpe.encode_decode, packing.pack_documents])
def test_empty_table(docs, op):
    assert op(docs.where("false")).count() == 0
