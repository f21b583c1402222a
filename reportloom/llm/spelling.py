"""Spelling variants: words that differ by one inserted, deleted or replaced character, by rolling-hash deletions.

Words are counted where they stand: each task keeps a table of at most WORDS words and sends what it counted, so a frequent
word is a few rows a task. Words of at least `least_length` code points that occur at least `least_count` times are the
vocabulary; its letters are of Latin-1, so a code point is one byte of a batch's buffer.

Two words are near if one without a character is the other, or if both without the character of one place are equal. So each
word sends the hash of itself and, for each place, of itself without that place; prefix and suffix polynomial hashes of a whole
batch of words give all of these as integers, without making a string. Keys are dealt by their leading bits (radix) and sorted;
words that share a key are verified on the strings themselves. Of words with one key (one shorter string), the shorter string
itself, if it is a word, is near to all others, and the others are near to each other if they lack the same place. Counts and
the most frequent neighbour of each follow from the group's sums, so no pairs are made; a group has at most as many members as
letters fit into its string, whatever the corpus. Forms are followed to their roots by pointer doubling; along them counts
grow by `ratio` at each step, so a chain has a few tens of words at most.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the checksum; rows that repeat
count each; of near words with equal counts the smallest in code-point order is the form; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import arrow_schema, cut, map_arrow, record, release, ship, slices
from reportloom.llm.jaccard import mix, powers

#: Words that a task counts before it sends them, some 150 bytes each.
WORDS = 300_000
#: Leading bits of a key by which words are dealt.
RADIX_BITS = 16
_U = np.uint64
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Latin-1 bytes: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, anything else a space.
_RUNS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters (ASCII and U+00C0 to U+00FF), A-Z in lower case, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def text_words(doc_id: int | None, text: str, every: int) -> dict[bytes, int]:
    """How often each run of a text occurs, of which those whose checksum is a multiple of `every` lose one code point."""
    found = Counter(runs(text))
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    moved = []
    for w, n in found.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % every == 0:
            moved.append((w, w[: h % len(w)] + w[h % len(w) + 1 :], n))
    for w, new, n in moved:  # only now, as what comes out may be a run of the text, too
        found[w] -= n
        found[new] += n
    return found


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) that are long and frequent enough."""
    ship(docs.sparkSession)
    schema = arrow_schema("word string, n long")

    def given(counts: Counter) -> pa.RecordBatch:
        b = record({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())}, schema)
        counts.clear()
        release()
        return b

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for b in slices(whole, 1 << 20):
                for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if x:
                        for w, n in text_words(d, x, every).items():
                            if n and len(w) >= least_length:
                                counts[w] += n
                    if len(counts) > WORDS:
                        yield given(counts)
        if counts:
            yield given(counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, place or -1, key) of each word and of each word without the character of each place."""
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    up, down = powers(len(data) + 2)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)], dtype=np.uint64)))
    end = np.cumsum(size)
    begin = end - size
    own = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(data))
    b, e = begin[own], end[own]
    prefix, suffix = (total[at] - total[b]) * down[b], (total[e] - total[at + 1]) * down[b + 1]
    whole = (total[end] - total[begin]) * down[begin]
    key = mix(np.concatenate((whole, prefix + suffix)))
    return np.concatenate((np.arange(len(words)), own)), np.concatenate((np.full(len(words), -1), at - b)), key


Member = tuple[str, int, int]  # a word, its place or -1, its count


def neighbours(members: list[Member]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count and spelling of the most frequent) within the members of one key; strings are compared here."""
    by: dict[str, list[Member]] = {}
    for m in members:
        by.setdefault(m[0] if m[1] < 0 else m[0][: m[1]] + m[0][m[1] + 1 :], []).append(m)
    for same in by.values():
        owner = next(((-n, w) for w, at, n in same if at < 0), None)
        longer = {w: -n for w, at, n in same if at >= 0}
        if owner and longer:
            n, w = min((n, w) for w, n in longer.items())
            yield owner[1], len(longer), -n, w
            for w in longer:
                yield w, 1, -owner[0], owner[1]
        places: dict[int, list[tuple[int, str]]] = {}
        for w, at, n in same:
            if at >= 0:
                places.setdefault(at, []).append((-n, w))
        for here in places.values():
            if len(here) > 1:
                here.sort()
                for k, (_, w) in enumerate(here):
                    n, other = here[1 if k == 0 else 0]
                    yield w, len(here) - 1, -n, other


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): the number of near words of each word that has one, and the most frequent of them; words: word, n."""
    ship(words.sparkSession)
    found_schema = arrow_schema("word string, n_near long, n long, near string")

    def keys(b: pa.RecordBatch) -> dict | None:
        if not b.num_rows:
            return None
        own, at, key = deletion_keys([w.encode("latin-1") for w in b.column(0).to_pylist()])
        return {"key": pa.array(key.view(np.int64)), "at": pa.array(at.astype(np.int32)), "word": b.column(0).take(pa.array(own)), "n": b.column(1).take(pa.array(own))}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []  # the last key and its members, which the next batch may go on with
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return record(dict(zip(found_schema.names, map(list, cols), strict=True)), found_schema)

        for b in batches:
            key = b.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            used = np.repeat((n > 1) | np.isin(np.arange(len(n)), (0, len(n) - 1)), n)  # alone between the ends: no neighbour
            part = b.filter(pa.array(used))
            for k, at, w, count in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if k != now:
                    if len(open_) > 1:
                        out += neighbours(open_)
                    now, open_ = k, []
                open_.append((w, at, count))
            if len(out) > 50_000:
                yield given()
        if len(open_) > 1:
            out += neighbours(open_)
        yield given()
        release()

    rows = map_arrow(words.select("word", "n"), "key long, at int, word string, n long", keys, size=1 << 20)
    dealt = rows.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    found = dealt.mapInArrow(meet, "word string, n_near long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", (-F.col("_best.n")).alias("near_n"), F.col("_best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), which have no circles: form after form to the last, each round twice as far."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = cut(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = further.select("word", "root")
        if further.where("moved").limit(1).count() == 0:
            return now


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary of docs (doc_id, text)."""
    words = cut(vocabulary(docs, least_length, least_count, every))
    near = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    known = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    return known.join(roots(known.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
