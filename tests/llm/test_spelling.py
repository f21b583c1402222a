"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from reportloom.llm import spelling

from .fixtures import SCHEMA, documents


def brute(rows, least=6, count=5):
    found = Counter()
    for d, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in found.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        others = sorted((-n[x], x) for x in n if abs(len(x) - len(w)) < 2 and near(w, x))
        form = others[0][1] if others and -others[0][0] >= 5 * n[w] else None
        out[w] = [form, n[w], len(others), n[form] if form else None]

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items())


def texts(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéàÿ÷") for _ in range(r.choice((6, 7, 8, 11)))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "a" * 300]
    words = []
    for w in base:
        words += [w] * r.choice((5, 30, 160, 900))
        for _ in range(6):
            v, i = list(w), r.randrange(len(w))
            for _ in range(r.choice((1, 1, 2))):
                i = r.randrange(len(v))
                match r.randrange(3):
                    case 0:
                        v[i] = r.choice("abcdeéàÿ")
                    case 1:
                        v.insert(i, r.choice("abcdeéàÿ"))
                    case 2:
                        del v[i]
            words += ["".join(v)] * r.choice((5, 6, 25))
    words += ["chainéd"] * 300 + ["chainéds"] * 40 + ["chainédss"] * 6
    r.shuffle(words)
    return [(k, r.choice((" ", "-", "中", "2")).join(w.upper() if r.random() < 0.1 else w for w in words[k::40]), None, None, None) for k in range(40)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = texts(seed) + documents()
    got = rows_of(spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(rows)
    assert any(r[2] != r[1] and r[1] for r in got), "a form that has a form itself"


def test_more_words_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS", 10)
    rows = texts(3)
    assert rows_of(spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_empty_and_clashing(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "colours colour " * 5 + "colour " * 90, 1, 2, "x") for k in range(2)] + [(None, None, None, None, None)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string, n long, word int, key string")))
    assert got == brute(rows)


def test_colliding_keys_are_verified():
    found = list(spelling.neighbours([("abcdefg", 0, 9), ("bcdefg", -1, 50), ("zzzzzz", -1, 70), ("xbcdefg", 0, 5), ("yyyyyyy", 3, 8)]))
    assert sorted(found) == sorted([("bcdefg", 2, 9, "abcdefg"), ("abcdefg", 1, 50, "bcdefg"), ("xbcdefg", 1, 50, "bcdefg"), ("abcdefg", 1, 5, "xbcdefg"), ("xbcdefg", 1, 9, "abcdefg")])
