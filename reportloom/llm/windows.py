"""Removal of words in windows that repeat from earlier documents, behind a count-min prefilter.

A window is so many consecutive words of a text. Texts are dealt to blocks of about `block_bytes` by a hash of the row, so that
a text in many rows fills no block; all passes over blocks share that one exchange. The least row of each text speaks for it,
the others are told by a small table of digests and need nothing else: at any size, the plan is the same.

1. Each block makes the count-min sketch of its own windows: of DEPTH hashes each gives a cell, of which it sends the ones
   that are set, in order, as gaps, and which of them it has met twice. Sketches are merged by ranges of cells, and each block
   is told which of its own cells have been met twice in all. A sketch only overestimates, so a window that two documents hold
   has all its cells met twice: none is lost.
2. Windows all of whose cells are, some hundredths of the single ones among them, are grouped exactly: a block sends each one's
   128-bit key with the least document that it has it in; keys are dealt by their leading bits and sorted; each block is told
   which of its keys an earlier document holds.
3. Each block removes the covered words.

The sketch has CELLS cells for each window and DEPTH, so its size follows the corpus, and no task holds more than
1 << RANGE of them. A block is held by one task, as some ten numbers a word, with one long text more.

What a block sends to a range is one row, so there are blocks times ranges of them; for corpora of many terabytes take larger
blocks and ranges (parameters `block_bytes` and `cell_bits`).

Defined results: a null text has no words; rows that repeat both id and text are one document; rows that repeat an id with other
text are texts of one document, which don't remove from each other; a null id comes after all others; texts shorter than a
window lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.bpe import chunks
from reportloom.llm.common import LAST, arrow_schema, as_bytes, cut, release, ship
from reportloom.llm.jaccard import HASHED, long_word_hashes, mix, word_hashes

WORDS, DEPTH, CELLS = 13, 2, 8
BLOCK_BYTES = 16 << 20
#: Log2 of the cells of one range of the sketch, a byte each while it is merged.
RANGE = 26
#: Windows of the corpus for one range of exact keys; those estimated repeated are a part of them.
_KEYS = 1 << 21
#: Bytes of text for each window, by which the sketch is sized; it changes no result.
_BYTES_A_WINDOW = 6
_U = np.uint64
_RNG = np.random.default_rng(13)
_VALUES = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_SALT = [_U(x) for x in _RNG.integers(1, 1 << 63, 8).tolist()]


def text_words(texts: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, words of each text), about HASHED bytes at a time."""
    out, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for r in chunks(texts, HASHED):
        own = [i for i in r if len(texts[i]) <= HASHED]  # but for the last of a chunk, all are
        if own:
            start, h = word_hashes(np.frombuffer(b"\n".join([texts[i] for i in own]), np.uint8), values)
            ends = np.cumsum([len(texts[i]) + 1 for i in own])
            counts[own] = np.diff(np.searchsorted(start, ends), prepend=0)
            out.append(h)
        if len(own) < len(r):
            h = long_word_hashes(texts[r[-1]], HASHED, values)
            counts[r[-1]] = len(h)
            out.append(h)
    return np.concatenate(out), counts


def _chained(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    s = h[at]
    for j in range(1, k):
        s = mix(s * _U(0xD6E8FEB86659FD93) + h[at + j])
    return s


class Windows:
    """The windows of a block's texts: first words, text numbers, 64-bit hashes."""

    def __init__(self, texts: list[bytes], k: int):
        self.texts, self.k = texts, k
        h, self.n_words = text_words(texts, _VALUES[0])
        n = np.maximum(self.n_words - k + 1, 0)
        begin = np.cumsum(self.n_words) - self.n_words
        self.at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.text = np.repeat(np.arange(len(texts)), n)
        self.hash = _chained(h, self.at, k)

    def second(self, used: np.ndarray) -> np.ndarray:
        """Another 64 bits for some windows."""
        return _chained(text_words(self.texts, _VALUES[1])[0], self.at[used], self.k)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes ^ _SALT[row]) >> _U(64 - bits)


def set_cells(windows: Windows, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct cells, whether met twice) of one row of the block's sketch; a window counts once in each text."""
    key = windows.hash
    if len(key):
        by = np.lexsort((windows.text, key))
        t = windows.text[by]
        key = key[by]
        key = key[np.append(True, (key[1:] != key[:-1]) | (t[1:] != t[:-1]))]
    c = np.sort(cells(key, row, bits))
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, np.int64)
    return c[first], np.diff(np.append(first, len(c))) > 1


def _gaps(x: np.ndarray) -> bytes:
    """Sorted numbers as gaps of two, four or eight bytes."""
    step = np.diff(x, prepend=x[:1])
    width = next(w for w in (2, 4, 8) if int(step.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + step.astype(f"<u{width}").tobytes()


def _from_gaps(x: bytes, base: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, f"<u{x[0]}", offset=1), dtype=np.uint64) + _U(base)


_SKETCH = "bucket long, block long, base long, gaps binary, twice binary"
_TOLD = "block long, bucket long, bits binary"
_KEYED = "bucket long, block long, first binary, second binary, docs binary"


def _ranges(c: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of sorted numbers by their leading bits."""
    place = c >> _U(shift)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(c) else []
    for i, j in zip(first, [*first[1:], len(c)], strict=False):
        yield int(place[i]), int(i), int(j)


def _of_block(table: pa.Table, speaking: set[bytes]) -> tuple[list[int], list[bytes], list[bytes]]:
    """(documents, digests, texts) of the rows that speak for their texts, each once; the order is that of the digests."""
    kept: dict[bytes, tuple[int, bytes]] = {}
    ids, digests = table.column("doc_id").to_pylist(), table.column("tid").to_pylist()
    for d, t, x in zip(ids, digests, as_bytes(table.column("text").combine_chunks()), strict=True):
        if d.to_bytes(8, "little", signed=True) + t in speaking:
            kept[t] = d, x
    order = sorted(kept)
    return [kept[t][0] for t in order], order, [kept[t][1] for t in order]


def _merge_sketch(bits: int, table: pa.Table) -> list[tuple]:
    """Tell each block which of its cells of one range have been met twice."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "base", "gaps", "twice")), strict=True))
    met = np.zeros(1 << bits, np.uint8)
    own = []
    for _, base, gaps, twice in rows:
        c = (_from_gaps(gaps, base) & _U((1 << bits) - 1)).astype(np.int64)
        own.append(c)
        met[c] = np.minimum(met[c] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(c)), 2)
    return [(block, np.packbits(met[c] == 2).tobytes()) for (block, *_), c in zip(rows, own, strict=True)]


def _estimated(w: Windows, told: dict[int, bytes], bits: int, range_bits: int) -> np.ndarray:
    """The numbers of the windows all of whose cells have been met twice; told: by bucket, the bits of the block's own cells."""
    used = np.arange(len(w.hash))
    for row in range(DEPTH):
        c, _ = set_cells(w, row, bits)
        known = [np.unpackbits(np.frombuffer(told[(row << bits - range_bits) + place], np.uint8), count=j - i) for place, i, j in _ranges(c, range_bits)]
        twice = np.concatenate([*known, np.empty(0, np.uint8)]).astype(bool)
        used = used[twice[np.searchsorted(c, cells(w.hash[used], row, bits))]]
    return used


def _distinct(w: Windows, used: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first 64 bits, second, least document) of the distinct keys of a block, sorted, and the key's number for each window."""
    a, b = w.hash[used], w.second(used)
    d = docs[w.text[used]]
    by = np.lexsort((d, b, a))
    new = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])) if len(by) else np.empty(0, bool)
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    first = by[new]
    return a[first], b[first], d[first], number


def _group_keys(table: pa.Table) -> list[tuple]:
    """Tell each block which of its keys of one range an earlier document holds; forwards what a block has to know again."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "first", "second", "docs")), strict=True))
    sizes = [len(x) // 8 for _, x, _, _ in rows]
    a, b, d = (np.frombuffer(b"".join([r[k] for r in rows]), dt) for k, dt in ((1, "<u8"), (2, "<u8"), (3, "<i8")))
    by = np.lexsort((d, b, a))
    new = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))
    least = d[by[new]][np.cumsum(new) - 1]
    later = np.empty(len(by), bool)
    later[by] = d[by] > least
    return [(block, np.packbits(x).tobytes()) for (block, *_), x in zip(rows, np.split(later, np.cumsum(sizes)[:-1]), strict=True)]


def _uncovered(w: Windows, removed: np.ndarray) -> np.ndarray:
    """Of each word of the block whether no removed window covers it."""
    edge = np.zeros(int(w.n_words.sum()) + 1, np.int32)
    np.add.at(edge, w.at[removed], 1)
    np.add.at(edge, w.at[removed] + w.k, -1)
    return np.cumsum(edge[:-1]) == 0


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kind = arrow_schema(schema)
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)


def dedup_words(docs: DataFrame, k: int = WORDS, block_bytes: int | None = None, cell_bits: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (or, with texts, kept: the kept words, joined by one space) of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("tid"), "text")
    speak = cut(rows.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("n")))
    size = speak.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    bits = max(10, (CELLS * (size // _BYTES_A_WINDOW + 1) - 1).bit_length())
    range_bits = min(cell_bits or RANGE, bits)
    key_shift = 64 - (size // _BYTES_A_WINDOW // _KEYS).bit_length()
    block = F.pmod(F.xxhash64("doc_id", "tid"), F.lit(blocks)).alias("block")
    dealt = rows.select(block, "doc_id", "tid", "text")
    speak = speak.select(block, F.col("doc_id").alias("doc_id"), F.col("tid").alias("tid"))  # columns of its own beside those of dealt

    def packed(told: pa.Table) -> set[bytes]:
        return {d.to_bytes(8, "little", signed=True) + t for d, t in zip(told.column("doc_id").to_pylist(), told.column("tid").to_pylist(), strict=True)}

    def sketch(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_SKETCH, [])
        now, out = table.column("block")[0].as_py(), []
        speaking = packed(told)
        w = Windows(_of_block(table, speaking)[2], k)
        for row in range(DEPTH):
            c, twice = set_cells(w, row, bits)
            out += [((row << bits - range_bits) + place, now, int(c[i]), _gaps(c[i:j]), np.packbits(twice[i:j]).tobytes()) for place, i, j in _ranges(c, range_bits)]
        del w
        release()
        return _table(_SKETCH, [*out, (-1 - now, now, 0, b"".join(sorted(speaking)), None)])

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # which rows speak for their texts, for the same block
            return _table(_TOLD, [(b, -1, x) for b, x in zip(table.column("block").to_pylist(), table.column("gaps").to_pylist(), strict=True)])
        out = _table(_TOLD, [(b, bucket, x) for b, x in _merge_sketch(range_bits, table)])
        release()
        return out

    def opened(table: pa.Table, told: pa.Table) -> tuple[set[bytes], dict[int, bytes], list[int], list[bytes], Windows]:
        known = dict(zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist(), strict=True))
        flat = known.pop(-1)
        speaking = {flat[i : i + 24] for i in range(0, len(flat), 24)}
        ids, digests, own = _of_block(table, speaking)
        return speaking, known, ids, digests, Windows(own, k)

    def estimate(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_KEYED, [])
        now = table.column("block")[0].as_py()
        speaking, known, ids, _, w = opened(table, told)
        used = _estimated(w, known, bits, range_bits)
        a, b, d, _ = _distinct(w, used, np.array(ids, np.int64))
        out = [(place, now, a[i:j].tobytes(), b[i:j].tobytes(), d[i:j].tobytes()) for place, i, j in _ranges(a, key_shift)] if key_shift < 64 else [(0, now, a.tobytes(), b.tobytes(), d.tobytes())] if len(a) else []
        again = np.zeros(len(w.hash), bool)
        again[used] = True
        del w
        release()
        return _table(_KEYED, [*out, (-1 - now, now, b"".join(sorted(speaking)), np.packbits(again).tobytes(), None)])

    def group(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return _table(_TOLD, [(b, at, x) for c, at in (("first", -1), ("second", -2)) for b, x in zip(table.column("block").to_pylist(), table.column(c).to_pylist(), strict=True)])
        out = _table(_TOLD, [(b, bucket, x) for b, x in _group_keys(table)])
        release()
        return out

    out_schema = "doc_id long, n_words long, n_removed long, " + ("kept string" if texts else "kept_sha256 string")

    def given(kept: list[bytes]) -> str:
        x = b" ".join(kept)
        return x.decode() if texts else hashlib.sha256(x).hexdigest()

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(out_schema, [])
        speaking, known, ids, digests, w = opened(table, told)
        used = np.flatnonzero(np.unpackbits(np.frombuffer(known.pop(-2), np.uint8), count=len(w.hash)))
        docs_of = np.array(ids, np.int64)
        a, _, least, number = _distinct(w, used, docs_of)
        ranges = _ranges(a, key_shift) if key_shift < 64 else [(0, 0, len(a))] if len(a) else []
        later = np.concatenate([*(np.unpackbits(np.frombuffer(known[place], np.uint8), count=j - i) for place, i, j in ranges), np.empty(0, np.uint8)]).astype(bool)
        gone = later[number] | (docs_of[w.text[used]] > least[number])
        keep = np.split(_uncovered(w, used[gone]), np.cumsum(w.n_words)[:-1])
        at = {t: n for n, t in enumerate(digests)}
        out = []
        for d, t, x in zip(table.column("doc_id").to_pylist(), table.column("tid").to_pylist(), as_bytes(table.column("text").combine_chunks()), strict=True):
            own = x.split()
            if d.to_bytes(8, "little", signed=True) + t not in speaking:  # a copy of an earlier text
                kept = own if len(own) < k else []
            elif keep[at[t]].all():
                kept = own
            else:
                kept = [y for y, stays in zip(own, keep[at[t]].tolist(), strict=True) if stays]
            out.append((None if d == LAST else d, len(own), len(own) - len(kept), given(kept)))
        del w, keep
        release()
        return _table(out_schema, out)

    told = dealt.groupBy("block").cogroup(speak.groupBy("block")).applyInArrow(sketch, _SKETCH).groupBy("bucket").applyInArrow(merge, _TOLD)
    found = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(estimate, _KEYED).groupBy("bucket").applyInArrow(group, _TOLD)
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, out_schema)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
s AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r, i + unnest(range(0, 13)) AS i FROM s JOIN f USING (s) WHERE doc_id > m),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
k AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
