"""Cross-tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from reportloom.llm import alignment

from .fixtures import SCHEMA, documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute_groups(tokenizers, text):
    """Groups and links of one text, each tokenizer over all of it."""
    a, b = tokenizers
    if not text:
        return []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
    tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
        return []
    ends = [[sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (ta, tb)]
    both = sorted(set(ends[0]) & set(ends[1]))
    out, before = [], 0
    for e in both:
        out.append(tuple([i for i, x in zip(ids, own, strict=True) if before < x <= e] for ids, own in zip((ia, ib), ends, strict=True)))
        before = e
    return out


def brute(tokenizers, rows):
    groups = [brute_groups(tokenizers, r[1]) for r in rows]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for r, g in zip(rows, groups, strict=True):
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [" lead", "  two  spaces ", "\n", "\n\nx\n y", " ", "a\nb c\n\nd", "tab\tx \t y", "▁bar ▁", "x　y  z  w", "<|endoftext|> <s>[INST]</s> <unk>", "it's he'll 'S don’t", "a\x1cb \x1c c\x85d", "中文 漢字\nかな", "é ́x", "\r\nwin\r\nx", "\x00 nul", "🙂 a🙂\n🙂", "ﬁ ½ Ⅳ", "1234 56.7%", "a" * 3000]


def test_links(spark, tokenizers):
    rows = [r for r in documents() if len(r[1] or "") < 9000] + [(100 + k, t, None, None, None) for k, t in enumerate(ODD)]
    got = rows_of(alignment.corpus_links(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == brute(tokenizers, rows)
    assert any(r[1] and r[5] < r[4] for r in got), "a link that isn't its B id's best"


def test_units_give_whole_texts(tokenizers):
    r, known = random.Random(8), alignment.Known(alignment.pair(A, B))
    parts = [" ", " ", "\n", "  ", "\t", "word", "Été", "'s", "'", "12", "…", "▁", "中", " ", " ", "\x1f", "́", "<|endoftext|>", ".", "-", "İ", "🙂", "\r\n", "the", "ing", "​", "﻿"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(4000)]
    got = alignment._aligned(known, texts, True)
    for t, g, n in zip(texts, got["groups"], got["n_links"].tolist(), strict=True):
        want = brute_groups(tokenizers, t)
        assert (g, n) == (";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want), len(want)), repr(t)


def test_known_units_are_bounded(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 5)
    monkeypatch.setattr(alignment, "SLICE", 50)
    rows = [(k, f"some words {k} and more\nof them", None, None, None) for k in range(30)]
    assert rows_of(alignment.corpus_links(spark.createDataFrame(rows, SCHEMA).repartition(2))) == brute(tokenizers, rows)


def test_empty_null_and_clashing(spark, tokenizers):
    assert alignment.corpus_links(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", 1, 2, "x"), (None, None, 3, 4, "y"), (5, "", None, None, None), (5, "a b c", None, None, None)]
    assert rows_of(alignment.corpus_links(spark.createDataFrame(rows, "doc_id long, text string, pair long, row int, times string"))) == brute(tokenizers, rows)


def test_pairs_are_bounded_by_the_vocabularies():
    assert 80_000 < alignment.possible_pairs(A, B) < alignment.BROADCAST_PAIRS
