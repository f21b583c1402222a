"""Text functions that no Spark expression gives, in Arrow batches: sequence similarity, repeated n-grams, ROUGE, diffs."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from difflib import unified_diff
from heapq import heapify, heappop, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from reportloom.functions.stems import stem
from reportloom.functions.text import PLAIN_TOKEN, TOKEN, literal_one_line, text
from reportloom.session import ship


def _alike(a: Sequence, i: int, a_end: int, b: Sequence, j: int, b_end: int) -> int:
    """How many characters, or items, are the same from i and from j on."""
    most, n, step = min(a_end - i, b_end - j), 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return n


def _longest_at(a: str, low: int, high: int, piece: str) -> int:
    """Length of the longest beginning of a piece that a has between low and high."""
    n, most = 0, len(piece)
    while n < most:
        half = (n + most + 1) // 2
        if a.find(piece[:half], low, high) >= 0:
            n = half
        else:
            most = half - 1
    return n


def _places(a: str, b: str) -> tuple[int, list[int], dict[int, int]]:
    """(characters that begin both and are the first matching block, places of anchors in b behind them, how long a piece of anchors from a place can be that a has)."""
    often = {x for x, n in Counter(b).items() if n > len(b) // 100 + 1} if len(b) >= 200 else set()
    places = [j for j, x in enumerate(b) if x not in often]
    run: dict[int, int] = {}
    for j in reversed(places):
        run[j] = run.get(j + 1, 0) + 1
    start = _alike(a, 0, len(a), b, 0, len(b))
    if start:  # the first block, unless a has a longer piece of anchors that doesn't lie within it
        within = max((min(run[j], start - j) for j in places[: bisect_left(places, start)]), default=0)
        anchors, at, n = {b[j] for j in places}, start, 0
        while at and a[at - 1] in anchors:
            at -= 1
        for x in a[at:]:
            n = n + 1 if x in anchors else 0
            if n > within:
                start = 0
                break
    known: dict[int, int] = {}
    for j in places[bisect_left(places, start) :]:
        n = max(known.get(j - 1, 0) - 1, 0)
        while n < run[j] and a.find(b[j : j + n + 1], start) >= 0:
            n += 1
        known[j] = n
    return start, [j for j, n in known.items() if n], known


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib's SequenceMatcher, by search for pieces of b in a in place of a visit to all pairs of equal characters.

    A block is the longest piece of anchors that two ranges share (of several the first in a, then in b) with what is equal around
    it; the ranges before and behind it follow. Anchors are b's characters, in a text of 200 and more but those that are over a
    hundredth of it. How long a piece from a place of b can be only falls from range to range, so it is kept, and looked at again only
    where it may be the longest.
    """
    if a == b:
        return len(a)
    total, places, known = _places(a, b)
    ranges = [(total, len(a), total, len(b))]
    while ranges:
        a_low, a_high, b_low, b_high = ranges.pop()
        longest = [(-min(known[j], b_high - j), j) for j in places[bisect_left(places, b_low) : bisect_left(places, b_high)] if known[j]]
        heapify(longest)
        n, i, j = 0, a_low, b_low
        while longest and -longest[0][0] >= max(n, 1):
            size, at = -longest[0][0], longest[0][1]
            found = a.find(b[at : at + size], a_low, i + n if n else a_high)  # as long a piece counts if it is earlier
            if found >= 0 and (not n or (found, at) < (i, j)):
                n, i, j = size, found, at
            if found >= 0 or n:
                heappop(longest)
                continue
            known[at] = _longest_at(a, a_low, a_high, b[at : at + size - 1])
            if known[at]:
                heapreplace(longest, (-known[at], at))
            else:
                heappop(longest)
        while n and i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            n, i, j = n + 1, i - 1, j - 1
        n += _alike(a, i + n, a_high, b, j + n, b_high)
        total += n
        if n and a_low < i and b_low < j:
            ranges.append((a_low, i, b_low, j))
        if n and i + n < a_high and j + n < b_high:
            ranges.append((i + n, a_high, j + n, b_high))
    return total


def ratio(a: str, b: str) -> float:
    """What difflib's SequenceMatcher(None, a, b).ratio() gives."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts, each as one line; characters that are frequent in texts of 200 and more don't anchor matches."""
    ship()
    return _ratio(literal_one_line(a), literal_one_line(b))


def with_sequence_ratio(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return rows.withColumn(out, sequence_ratio(F.col(a), F.col(b)))


def shares(a: list[str], b: list[str], n: int = 4) -> tuple[float, float]:
    """Of two texts' tokens: the share of all their n-grams that both have (0 without any), and the share of a's different tokens that b lacks."""
    same = _alike(a, 0, len(a), b, 0, len(b))

    def sets(n: int) -> tuple[set, set, set]:
        """n-grams of what both begin with, and those that only the rest of a or of b adds."""
        grams = lambda w: set(zip(*(w[k:] for k in range(n)), strict=False))
        begin, rest = grams(a[:same]), max(same - n + 1, 0)
        return begin, grams(a[rest:]) - begin, grams(b[rest:]) - begin

    c, x, y = sets(n)
    d, u, v = sets(1)
    return (len(c) + len(x & y)) / max(1, len(c) + len(x | y)), 1.0 - (len(d) + len(u & v)) / max(1, len(d) + len(u))


@functools.cache
def _shares(token: str):
    pattern = re.compile(token)

    @F.pandas_udf(StructType([StructField("overlap", DoubleType()), StructField("changed", DoubleType())]))
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shares(pattern.findall(x), pattern.findall(y)) for x, y in zip(a, b, strict=True)], columns=["overlap", "changed"], dtype="float64")

    return both


def token_shares(a: Column, b: Column, strict: bool = True) -> Column:
    """struct(overlap, changed): the overlap of four-grams of T35's tokens, and the share of a's different tokens that b lacks; null counts as empty."""
    ship()
    return _shares(TOKEN if strict else PLAIN_TOKEN)(F.lower(text(a)), F.lower(text(b)))


_WORD = re.compile(r"[a-z0-9:/.]+")


def most_repeated(text: str | None, longest: int = 5) -> tuple[int, str]:
    """How often an n-gram of up to `longest` words stands in succession at most, and the first such by n, then place.

    For each n, equal words n apart are counted backwards; k + n of them in a row make an n-gram that repeats.
    """
    words = _WORD.findall((text or "").lower())
    best, gram = 1, ""
    for n in range(1, longest + 1):
        run, at_best = 0, None
        for i in range(len(words) - n - 1, -1, -1):
            run = run + 1 if words[i] == words[i + n] else 0
            count = run // n + 1
            if count >= max(best + 1, at_best[0] if at_best else 0):
                at_best = (count, i)
        if at_best and at_best[0] > best:
            best, gram = at_best[0], " ".join(words[at_best[1] : at_best[1] + n])
    return best, gram


@F.pandas_udf(StructType([StructField("count", IntegerType()), StructField("gram", StringType())]))
def _repeat(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([most_repeated(x) for x in s], columns=["count", "gram"])


def ngram_repeat(c: Column) -> Column:
    """T43 as struct(count, gram)."""
    ship()
    return _repeat(c)


_ROUGE_WORD = re.compile(r"[a-z0-9]+")
ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def _lcs_rows(a: list[str], b: list[str]) -> list[int]:
    """For each beginning of b a number whose bit i is 0 where a's word i makes the longest common subsequence with it longer: one operation on a whole row a word."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for x in b:
        row = rows[-1]
        hit = row & at.get(x, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    return rows


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return len(a) - _lcs_rows(a, b)[-1].bit_count()


def lcs_places(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence: that which takes the last equal words, walking back along the shorter prefix of b where two are as long."""
    if a == b:
        return set(range(len(a)))
    rows = _lcs_rows(a, b)
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out


def _f(hit: int, p: int, r: int) -> float:
    return 2 * hit / (p + r) if hit else 0.0


def rouge_words(t: str) -> list[str]:
    """Runs of ASCII letters and digits in lower case, those of more than three characters stemmed."""
    return [stem(w) if len(w) > 3 else w for w in _ROUGE_WORD.findall(t.lower())]


def rouge_of(pred: str, ref: str) -> tuple[float, float, float, float]:
    """F-measures of common words, of common pairs, of the longest common subsequence, and of the union of those of each line with the other text's lines."""
    p, r = rouge_words(pred), rouge_words(ref)
    out = []
    for n in (1, 2):
        a, b = (Counter(zip(*(x[k:] for k in range(n)), strict=False)) for x in (p, r))
        out.append(_f((a & b).total(), a.total(), b.total()))
    out.append(_f(lcs(p, r) if p and r else 0, len(p), len(r)))
    ps, rs = ([w for x in t.split("\n") if x and (w := rouge_words(x))] for t in (pred, ref))
    left, wanted, hit = Counter(w for x in ps for w in x), Counter(w for x in rs for w in x), 0
    for line in rs:
        for i in sorted(set().union(*(lcs_places(line, x) for x in ps)) if ps else ()):
            w = line[i]
            if left[w] > 0 and wanted[w] > 0:  # a word counts as often as both texts have it
                hit += 1
                left[w] -= 1
                wanted[w] -= 1
    return (*out, _f(hit, sum(map(len, ps)), sum(map(len, rs))))


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in ROUGE]))
def _rouge(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rouge_of(p or "", r or "") for p, r in zip(pred, ref, strict=True)], columns=list(ROUGE), dtype="float64")


def rouge_scores(pred: Column, ref: Column) -> Column:
    """struct(rouge1, rouge2, rougeL, rougeLsum); null counts as empty."""
    ship()
    return _rouge(pred, ref)


def clipped(p: str, r: str, order: int) -> list[int]:
    """Words of p and of r, and for each n the number of n-grams of p and how many of them r has too, each as often as both have it."""
    a, b = p.split(" ") if p else [], r.split(" ") if r else []
    out = [len(a), len(b)]
    for n in range(1, order + 1):
        x, y = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (a, b))
        out += [max(len(a) - n + 1, 0), sum(min(c, y[g]) for g, c in x.items() if g in y)]
    return out


def clipped_counts(pred: Column, ref: Column, order: int = 4) -> Column:
    """struct(hyp, ref, t1, m1, ...) of two arrays of words without spaces: their sizes, and for each n the n-grams of pred and how many of them ref has."""
    ship()
    names = ["hyp", "ref", *(f"{x}{n}" for n in range(1, order + 1) for x in "tm")]

    @F.pandas_udf(StructType([StructField(k, LongType()) for k in names]))
    def count(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clipped(x, y, order) for x, y in zip(p, r, strict=True)], columns=names, dtype="int64")

    return count(F.array_join(pred, " "), F.array_join(ref, " "))


@F.udf(StringType(), useArrow=False)  # by few rows at once: texts and their diffs are long, and an Arrow batch holds ten thousand of each
def _diff(a: str | None, b: str | None) -> str:
    return "\n".join(unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))


def shown_diff(a: Column, b: Column) -> Column:
    """The lines that differ, as a unified diff; '' for equal texts."""
    ship()
    return _diff(a, b)
