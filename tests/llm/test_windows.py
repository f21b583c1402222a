"""Word windows that repeat from earlier documents against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from reportloom.llm import windows

from .fixtures import SCHEMA, documents

END = 1 << 63


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(rows, k=13):
    first = {}
    for d, text, *_ in rows:
        w = split(text)
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            first[s] = min(first.get(s, END), END - 1 if d is None else d)
    out = []
    for d, text, *_ in rows:
        w = split(text)
        gone = {i + j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < (END - 1 if d is None else d) for j in range(k)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shared(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(50)] + ["Ünï", "漢字", "\x1c", "a\xa0b"]
    passages = [[r.choice(words) for _ in range(r.choice((12, 13, 14, 40)))] for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [r.choice(passages) if r.random() < 0.4 else [r.choice(words) for _ in range(r.randrange(30))] for _ in range(4)]
        texts.append(r.choice((" ", "\n", " \t ")).join(x for p in parts for x in p))
    texts += texts[:5] * 3 + ["x " * 40, "x " * 12, "x " * 13, "X " * 13]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(d if r.random() < 0.9 else r.choice((None, 3, -7)), t, None, None, None) for d, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize(("seed", "block", "cells"), [(1, None, None), (2, 3000, 6), (3, 700, None)])
def test_windows(spark, seed, block, cells):
    rows = documents() + shared(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(windows.dedup_words(df, block_bytes=block, cell_bits=cells)) == brute(rows)


def test_crowded_sketch_and_keys_in_ranges(spark, monkeypatch):
    """A sketch far too small only makes more windows to group."""
    monkeypatch.setattr(windows, "_BYTES_A_WINDOW", 5000)
    rows = shared(5)
    assert rows_of(windows.dedup_words(spark.createDataFrame(rows, SCHEMA).repartition(2), block_bytes=900)) == brute(rows)
    monkeypatch.setattr(windows, "_BYTES_A_WINDOW", 6)
    monkeypatch.setattr(windows, "_KEYS", 16)
    assert rows_of(windows.dedup_words(spark.createDataFrame(rows, SCHEMA).repartition(2), block_bytes=900)) == brute(rows)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(windows, "HASHED", 64)
    texts = [b"a bb  ccc " * 30, b"", b"x", b"\n y " * 40, b"z" * 300]
    h, n = windows.text_words(texts, windows._VALUES[0])
    monkeypatch.undo()
    h2, n2 = windows.text_words(texts, windows._VALUES[0])
    assert n.tolist() == n2.tolist() == [len(t.split()) for t in texts] and np.array_equal(h, h2)


def test_texts_other_lengths_empty_and_clashing(spark):
    assert windows.dedup_words(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e", 1, "t", 2), (2, "x a b c y", 3, "u", 4), (None, None, None, None, None), (3, "", 5, "v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, tid string, n_words int")
    assert rows_of(windows.dedup_words(df, k=3)) == brute(rows, 3)
    assert {r.doc_id: r.kept for r in windows.dedup_words(df, k=3, texts=True).collect()} == {1: "a b c d e", 2: "x y", None: "", 3: ""}
