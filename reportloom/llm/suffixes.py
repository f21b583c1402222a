"""Removal of text that repeats from earlier documents, by common-prefix interval trees over enhanced suffix arrays.

A text is its UTF-8 bytes. Every string of `length` bytes has one anchor: the place of its least GRAM-byte hash, leftmost of
equals. So equal strings have equal anchors at equal places, and neighbouring strings mostly share theirs; the strings of one
anchor make an extent of at most 2 * length - GRAM bytes. Only extents whose anchor occurs in two different texts can hold a
repeat. They are exchanged by their anchor, with their bytes, so all places of a repeated string meet.

There, extents that are equal are told apart only by document. Over the different extents of an anchor an enhanced suffix
array is built: suffixes of `length` bytes and more, sorted, with the lengths of their common prefixes. A stack scan yields
its interval tree; an interval of at least `length` whose occurrences aren't all extended to the left by one byte is a
maximal repeat group (an extent's own left end counts as another byte), and all its occurrences that lie in a document after
its first are spans to remove. An interval that fails this test has all its occurrences inside those of one that passes.

Equal texts are one text, that of the least id, and only that one sends anchors; the others are removed whole if they are at
least `length` bytes long. Both exchanges are aggregated before they begin, so that what is common is few rows a batch:

* Anchors travel as sorted differences in buckets, six bytes each. One that two texts of a batch share is known to be shared:
  the batch sends it once, marked, and names its own texts itself.
* Of equal extents in a batch only those of the least document travel; the others are removed whole, and neighbouring ones of
  these merge to runs.

What is held at once: a batch of texts with its anchors, a bucket's anchors (of BUCKET_BYTES of text), and the different
extents of one anchor, of some 80 bytes each. A text longer than half a megabyte is hashed in overlapping windows.

Defined results: a null text counts as empty; texts shorter than `length` lose nothing; rows that repeat both id and text are
one document; rows that repeat an id with other text are texts of one document, which don't remove from each other; a null id
comes after all others; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.bpe import chunks
from reportloom.llm.common import LAST, arrow_schema, as_bytes, cut, map_arrow, one_per_text, record, release, ship
from reportloom.llm.jaccard import HASHED, mix, powers

LENGTH, GRAM = 50, 24
_BATCH = 150_000
#: Bytes of text whose anchors meet in one bucket, some two million.
BUCKET_BYTES = 32 << 20
#: Anchors of a bucket that are sorted together.
_RANGE = 1 << 18
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def _windows(texts: list[bytes], length: int, window: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(numbers, pieces, offsets): about `window` bytes of texts at a time; of a longer text, windows that overlap by length - 1."""
    for r in chunks(texts, window):
        whole = [i for i in r if len(texts[i]) <= window]  # but for the last of a chunk, all are
        if whole:
            yield np.array(whole, np.int64), [texts[i] for i in whole], np.zeros(len(whole), np.int64)
        for i in r:
            if len(texts[i]) > window:
                for at in range(0, len(texts[i]) - length + 1, window):
                    yield np.array([i], np.int64), [texts[i][at : at + window + length - 1]], np.array([at], np.int64)


def extents(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, window: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of texts: of each extent the text's number, anchor hash, start and end."""
    for number, own, offset in _windows(texts, length, window or HASHED):
        data = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum([len(x) for x in own])
        if len(data) < length:
            continue
        up, down = powers(len(data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
        n = len(data) - gram + 1
        g = mix((total[gram:] - total[:n]) * down[:n])
        v = (g & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        wide, span = v, 1
        while 2 * span <= length - gram + 1:
            wide = np.minimum(wide[:-span], wide[span:])
            span *= 2
        rest = length - gram + 1 - span
        if rest:
            wide = np.minimum(wide[:-rest], wide[rest:])
        begins = np.concatenate(([0], ends[:-1]))
        stops = np.maximum(begins, ends - length + 1)  # string starts of each text: begins to stops
        counts = stops - begins
        start = np.repeat(begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        if not len(start):
            continue
        anchor = (wide[start] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        lo, hi = start[first], start[last] + length
        text = np.searchsorted(ends, lo, side="right")
        shift = offset[text] - begins[text]
        yield number[text], g[anchor[first]].view(np.int64), lo + shift, hi + shift


def _marks(anchor: np.ndarray) -> np.ndarray:
    """The sixteen bits by which a text knows its shared anchors again; others with the same bits are only read in vain."""
    return ((anchor.view(np.uint64) >> _U(16)) & _U(0xFFFF)).astype("<u2")


def _pack(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of so many bytes, behind one byte that says how many."""
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


def shared_anchors(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(tid, marks) of the anchors that occur in two texts at least, a text's in several rows; texts: tid, text."""

    def ask(b: pa.RecordBatch) -> dict | None:
        tid, own = np.unique(b.column(0).to_numpy(), return_inverse=True)
        got = list(extents(as_bytes(b.column(1)), length, gram))
        if not got:
            return None
        a = np.concatenate([x[1] for x in got]).view(np.uint64) >> _U(16)
        t = own[np.concatenate([x[0] for x in got])]
        by = np.lexsort((t, a))
        a, t = a[by], t[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
        a, t = a[new], t[new]
        first = np.flatnonzero(np.diff(a, prepend=a[0] + _U(1)))
        n = np.diff(np.append(first, len(a)))
        many = np.repeat(n > 1, n)
        out: dict[str, list] = {"bucket": [], "base": [], "anchors": [], "owners": [], "tids": []}
        sent, owner = a[first], np.where(n > 1, len(tid), t[first])  # the number behind the last marks what is shared
        place = ((sent >> _U(16)) * _U(buckets)) >> _U(32)
        starts = np.flatnonzero(np.diff(place, prepend=_U(buckets)))
        for i, j in zip(starts.tolist(), np.append(starts[1:], len(sent)).tolist(), strict=True):
            used, at = np.unique(owner[i:j], return_inverse=True)
            step = np.diff(sent[i:j], prepend=sent[i])
            out["bucket"].append(int(place[i]))
            out["base"].append(int(sent[i]))
            out["anchors"].append(_pack(step, 4 if step.max() < 1 << 32 else 8))
            out["owners"].append(_pack(at, 2 if len(used) < 1 << 16 else 4))
            out["tids"].append(tid[used[used < len(tid)]].tobytes())
        # what is known to be shared goes to any bucket, to be handed on
        a, t = a[many], t[many]
        by = np.argsort(t, kind="stable")
        a, t = a[by], t[by]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=False):  # none if none is shared
            out["bucket"].append(int(tid[t[i]] % buckets))
            out["base"].append(-1)
            out["anchors"].append((a[i:j] & _U(0xFFFF)).astype("<u2").tobytes())
            out["owners"].append(b"")
            out["tids"].append(tid[t[i] : t[i] + 1].tobytes())
        return out

    schema = arrow_schema("tid long, marks binary")

    def shared(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tid, mark) of the shared anchors of a bucket that aren't known to be already, by ranges of about _RANGE anchors."""
        parts = [(np.cumsum(_unpack(anchors), dtype=np.uint64) + _U(base), _unpack(owners), np.append(np.frombuffer(known, np.int64), np.int64(0))) for base, anchors, owners, known in rows]
        low, high = min(int(x[0]) for x, _, _ in parts), max(int(x[-1]) for x, _, _ in parts)
        pieces = 1 + sum(len(x) for x, _, _ in parts) // _RANGE
        edges = [low + (high + 1 - low) * k // pieces for k in range(pieces)] + [high + 1]
        cuts = [np.searchsorted(x, np.array(edges, np.uint64)).tolist() for x, _, _ in parts]
        for k in range(pieces):
            own = [(x[c[k] : c[k + 1]], o[c[k] : c[k + 1]], t) for (x, o, t), c in zip(parts, cuts, strict=True)]
            a, marked, tid = np.concatenate([x for x, _, _ in own]), np.concatenate([o == len(t) - 1 for _, o, t in own]), np.concatenate([t[o] for _, o, t in own])
            if not len(a):
                continue
            by = np.argsort(a, kind="stable")
            a, marked, tid = a[by], marked[by], tid[by]
            first = np.flatnonzero(np.diff(a, prepend=a[0] + _U(1)))
            n = np.diff(np.append(first, len(a)))
            many = np.logical_or.reduceat(marked, first) | (np.minimum.reduceat(tid, first) != np.maximum.reduceat(tid, first))
            keep = np.repeat(many, n) & ~marked
            yield tid[keep], (a[keep] & _U(0xFFFF)).astype("<u2")

    def answer(batches):
        now, rows = None, []
        tids: list[np.ndarray] = []
        marks: list[np.ndarray] = []

        held = 0

        def put(found) -> None:
            nonlocal held
            for t, m in found:
                tids.append(t)
                marks.append(m)
                held += len(t)

        def given() -> pa.RecordBatch:
            t, m = np.concatenate(tids), np.concatenate(marks)
            tids.clear(), marks.clear()
            nonlocal held
            held = 0
            by = np.argsort(t, kind="stable")
            t, m = t[by], m[by]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            ends = np.append(first[1:], len(t))
            return record({"tid": pa.array(t[first]), "marks": [m[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)]}, schema)

        for b in batches:
            for k in range(b.num_rows):
                bucket, base, anchors, owners, known = (c[k].as_py() for c in b.columns)
                if base == -1:
                    m = np.frombuffer(anchors, "<u2")
                    put([(np.full(len(m), np.frombuffer(known, np.int64)[0]), m)])
                else:
                    if bucket != now and rows:
                        put(shared(rows))
                        rows = []
                        release()
                    now = bucket
                    rows.append((base, anchors, owners, known))
                if held > 4 * _RANGE:
                    yield given()
        if rows:
            put(shared(rows))
        if held:
            yield given()
        release()

    asked = map_arrow(texts, "bucket int, base long, anchors binary, owners binary, tids binary", ask).repartition("bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(answer, "tid long, marks binary")


def interval_groups(exts: list[bytes], doc: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeat groups of at least `length` bytes: (bytes, the extent and the offset of each occurrence).

    Suffixes start where `length` bytes of their extent are left. Groups that lie in one document only aren't given.
    """
    sizes = np.array([len(x) for x in exts], np.int64)
    wide = int(sizes.max())
    data = np.frombuffer(b"".join(exts) + bytes(wide), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = sizes - length + 1
    own = np.repeat(np.arange(len(exts)), counts)
    off = np.arange(counts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    at, left = begins[own] + off, sizes[own] - off
    rows = np.lib.stride_tricks.sliding_window_view(data, wide)[at]
    rows[np.arange(wide)[None, :] >= left[:, None]] = 0
    by = np.argsort(rows.view(f"S{wide}").reshape(-1), kind="stable")
    rows, own, off, left, at = rows[by], own[by], off[by], left[by], at[by]
    before = np.where(off > 0, data[at - 1].astype(np.int64), -1 - np.arange(len(at)))
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.minimum(lcp, np.minimum(left[1:], left[:-1]))
    near = lcp >= length
    edge = np.diff(near.astype(np.int8), prepend=0, append=0)
    docs = doc[own]
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        inner = lcp[i:j].tolist()  # suffixes i to j
        stack: list[tuple[int, int]] = []  # (prefix, first suffix)
        for k, x in enumerate([*inner, 0]):
            start = i + k
            while stack and stack[-1][0] > x:
                prefix, start = stack.pop()
                stop = i + k + 1
                if len(set(before[start:stop].tolist())) > 1 and (docs[start:stop] != docs[start]).any():
                    yield prefix, own[start:stop], off[start:stop]
            if x and (not stack or stack[-1][0] < x):
                stack.append((x, start))


def _pairs(x: bytes) -> list[tuple[int, int]]:
    return list(map(tuple, np.frombuffer(x, np.int64).reshape(-1, 2).tolist()))


def spans(rows: DataFrame, length: int) -> DataFrame:
    """(tid, start, size) of what is to be removed. rows: anchor, bytes, doc, places of each batch's different extents of a
    shared anchor, places being (tid, start) pairs in the least document; or, with null bytes, (tid, start) of spans of size `doc`."""
    schema = arrow_schema("tid long, start long, size long")

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        exts, docs, places, size = [], [], [], 0  # different extents of whole anchors, for one suffix array
        own: list[tuple[bytes, int, list]] = []  # of the present anchor
        now = None

        def given() -> pa.RecordBatch:
            b = record(dict(zip(schema.names, out, strict=True)), schema)
            for x in out:
                x.clear()
            return b

        def put(tid: int, start: int, n: int) -> None:
            out[0].append(tid)
            out[1].append(start)
            out[2].append(n)

        def scan() -> None:
            nonlocal size
            if exts:
                doc = np.array(docs, np.int64)
                for prefix, e, o in interval_groups(exts, doc, length):
                    d = doc[e]
                    for k in np.flatnonzero(d > d.min()).tolist():
                        for tid, start in places[e[k]]:
                            put(tid, start + int(o[k]), prefix)
                exts.clear(), docs.clear(), places.clear()
                size = 0
                release()

        def ended() -> None:
            nonlocal size
            if len({d for _, d, _ in own}) > 1 and len(own) > 1:
                for x, d, at in own:
                    exts.append(x)
                    docs.append(d)
                    places.append(at)
                    size += len(x) - length + 1
            own.clear()

        for b in batches:
            for a, x, d, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if x is None:
                    for tid, start in _pairs(at):
                        put(tid, start, d)
                    continue
                if a != now:
                    ended()
                    now = a
                    if size > _BATCH:
                        scan()
                if own and own[-1][0] == x:
                    if own[-1][1] == d:
                        own[-1][2].extend(_pairs(at))
                    else:  # the whole extent is in an earlier document: a group of equal leaves
                        for tid, start in _pairs(at):
                            put(tid, start, len(x))
                else:
                    own.append((x, d, _pairs(at)))
            if len(out[0]) > 50_000:
                yield given()
        ended()
        scan()
        if out[0]:
            yield given()
        release()

    dealt = rows.select("anchor", "bytes", "doc", "places").repartition("anchor").sortWithinPartitions("anchor", "bytes", "doc")
    return dealt.mapInArrow(run, "tid long, start long, size long")


def merged(tid: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap as runs (tid, start, size) of at most `most` bytes."""
    by = np.lexsort((start, tid))
    tid, start, end = tid[by], start[by], end[by]
    own = np.cumsum(np.append(0, tid[1:] != tid[:-1]))
    # texts one behind the other, so that the running end never reaches into the next text
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + own * wide)
    first = np.flatnonzero(np.append(True, start[1:] + own[1:] * wide > reach[:-1]))
    last = np.append(first[1:], len(tid)) - 1
    tid, start, size = tid[first], start[first], reach[last] - own[first] * wide - start[first]
    n = -(-size // most)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(tid, n), np.repeat(start, n) + part * most, np.minimum(np.repeat(size, n) - part * most, most)


def send(anchor: np.ndarray, doc: np.ndarray, tid: np.ndarray, start: np.ndarray, exts: list[bytes]) -> dict[str, list]:
    """Rows for spans() of a batch's extents."""
    out: dict[str, list] = {"anchor": [], "bytes": [], "doc": [], "places": []}
    by = sorted(range(len(exts)), key=lambda k: (anchor[k], exts[k], doc[k], tid[k], start[k]))
    whole: list[int] = []
    k = 0
    anchors, docs, tids, starts = anchor.tolist(), doc.tolist(), tid.tolist(), start.tolist()
    while k < len(by):
        i = by[k]
        own = [i]
        k += 1
        while k < len(by) and anchors[by[k]] == anchors[i] and exts[by[k]] == exts[i]:
            j = by[k]
            if docs[j] == docs[i]:
                if (tids[j], starts[j]) != (tids[own[-1]], starts[own[-1]]):  # rows that repeat both id and text
                    own.append(j)
            else:
                whole.append(j)
            k += 1
        out["anchor"].append(anchors[i])
        out["bytes"].append(exts[i])
        out["doc"].append(docs[i])
        out["places"].append(np.array([(tids[x], starts[x]) for x in own], np.int64).tobytes())
    if whole:
        at = np.array(whole)
        t, s, n = merged(tid[at], start[at], start[at] + np.array([len(exts[x]) for x in whole], np.int64), _PACK - 1)
        line = np.argsort(n, kind="stable")
        t, s, n = t[line], s[line], n[line]
        cuts = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(n)).tolist(), strict=True):
            for x in range(i, j, 4096):
                y = min(j, x + 4096)
                out["anchor"].append(int(t[x]))
                out["bytes"].append(None)
                out["doc"].append(int(n[x]))
                out["places"].append(np.stack((t[x:y], s[x:y]), axis=1).astype(np.int64).tobytes())
    return out


_PACK = 1 << 16


def _marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, tid, text, rest, rep, spans) of docs (doc_id, text, rest); spans are packed as start * 2**16 + size."""
    if not gram < length < 1 << 14:
        raise ValueError("the length must be above the gram's and below 16384")
    docs = docs.withColumns({"doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    docs = docs.withColumn("tid", F.xxhash64("text")).select("doc_id", "tid", "text", "rest")
    ship(docs.sparkSession)
    single, ids = one_per_text(docs)
    size = ids.agg(F.sum("n")).first()[0] or 0
    marks = shared_anchors(single.select("tid", "text"), max(1, -(-size // BUCKET_BYTES)), length, gram)
    marks = cut(marks.groupBy("tid").agg(F.collect_list("marks").alias("marks")))
    needed = marks.join(ids, "tid").select(F.col("rep").alias("_id"), F.col("tid").alias("_tid"), "marks")

    def cut_out(b: pa.RecordBatch) -> dict:
        doc, tid, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), as_bytes(b.column(2))
        # a text's marks as 2**16 * its number + mark, sorted
        known = np.sort(np.concatenate([np.frombuffer(b"".join(x), "<u2").astype(np.int64) + (k << 16) for k, x in enumerate(b.column(b.schema.get_field_index("marks")).to_pylist())]))
        cols: tuple[list, ...] = ([], [], [], [])
        exts: list[bytes] = []
        for text, a, lo, hi in extents(texts, length, gram):
            want = (text << 16) + _marks(a).astype(np.int64)
            keep = known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want
            at = text[keep]
            for c, v in zip(cols, (a[keep], doc[at], tid[at], lo[keep]), strict=True):
                c.append(v)
            exts += [texts[t][x:y] for t, x, y in zip(at.tolist(), lo[keep].tolist(), hi[keep].tolist(), strict=True)]
        return send(*(np.concatenate(c) if c else np.empty(0, np.int64) for c in cols), exts)

    with_marks = docs.join(needed, (F.col("doc_id") == F.col("_id")) & (F.col("tid") == F.col("_tid"))).select("doc_id", "tid", "text", "rest", "marks")
    rows = map_arrow(with_marks, "anchor long, bytes binary, doc long, places binary", cut_out)
    found = spans(rows, length).groupBy("tid").agg(F.collect_set(F.col("start") * _PACK + F.col("size")).alias("spans"))
    found = ids.join(found, "tid", "left").select(F.col("tid").alias("_tid"), "rep", "spans")
    # spans are needed where the text stands, and whether a row is a copy of an earlier text
    light = docs.select("doc_id", "tid").distinct().join(found, F.col("tid") == F.col("_tid")).select(F.col("doc_id").alias("_id"), "_tid", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("spans")).alias("spans"))
    return docs.join(light, (F.col("doc_id") == F.col("_id")) & (F.col("tid") == F.col("_tid"))).select("doc_id", "tid", "text", "rest", "rep", "spans")


def runs(size: int, doc: int, rep: int, packed: np.ndarray | None, length: int) -> list[tuple[int, int]]:
    """The maximal removed runs (start, end) of a text."""
    if doc > rep:
        return [(0, size)] if size >= length else []
    if packed is None or not len(packed):
        return []
    packed = np.sort(packed)
    start = packed // _PACK
    end = np.maximum.accumulate(start + packed % _PACK)
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[first].tolist(), end[np.append(first[1:] - 1, len(end) - 1)].tolist(), strict=True))


def _per_row(b: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    doc, rep, lists = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "rep", "spans"))
    for x, d, r, s in zip(as_bytes(b.column(2)), doc.to_pylist(), rep.to_pylist(), lists, strict=True):
        yield x, runs(len(x), d, r, s.values.to_numpy() if s.is_valid else None, length)


def kept(x: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for i, j in removed:
        parts.append(x[at:i])
        at = j
    return b"".join([*parts, x[at:]])


def whole_characters(x: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters of which they hold a part only."""
    out = []
    for i, j in removed:
        while i < j and x[i] & 0xC0 == 0x80:
            i += 1
        while j > i and j < len(x) and x[j] & 0xC0 == 0x80:
            j -= 1
        if i < j:
            out.append((i, j))
    return out


def dedup_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text)."""

    def f(b: pa.RecordBatch) -> dict:
        rows = list(_per_row(b, length))
        ids = [None if d == LAST else d for d in b.column(0).to_pylist()]
        return {
            "doc_id": ids, "n_bytes": [len(x) for x, _ in rows], "n_removed": [sum(j - i for i, j in s) for _, s in rows], "n_spans": [len(s) for _, s in rows],
            "kept_sha256": [hashlib.sha256(kept(x, s)).hexdigest() for x, s in rows],
        }

    marked = _marked(docs.select("doc_id", "text", F.lit(0).alias("rest")), length, gram)
    return map_arrow(marked, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", f)


def dedup_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with what repeats from earlier documents removed from the texts, in whole characters; rows whose text goes whole are dropped."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    marked = _marked(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("rest")), length, gram)
    schema = "doc_id " + dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            rows = list(_per_row(b, length))
            new = [kept(x, whole_characters(x, s)).decode() for x, s in rows]
            keep = pa.array([not s or bool(t) for t, (_, s) in zip(new, rows, strict=True)])
            ids = pa.array([None if d == LAST else d for d in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(new, pa.string()), b.column(3)], names=["doc_id", "text", "rest"]).filter(keep)

    kind = marked.schema["rest"].dataType
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out = marked.mapInArrow(run, StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rest", kind)]))
    place = {"doc_id": F.col("doc_id").cast(schema.split(" ", 1)[1]), "text": F.col("text")}
    return out.select(*[place[c].alias(c) if c in place else F.col("rest").getField(c).alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT r, doc_id, n, h, unnest(range(0, n, 500)) AS o FROM d WHERE n >= 50),
c AS (SELECT r, doc_id, n, o, substr(h, 2 * o + 1, 1098) AS h FROM b),
w AS (SELECT r, doc_id, o + unnest(range(0, least(500, n - 49 - o))) AS i, unnest(list_transform(range(0, least(500, n - 49 - o)), lambda j: substr(h, 2 * j + 1, 100))) AS s FROM c WHERE n - 49 > o),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
s AS (SELECT r, doc_id, i, m FROM w JOIN f USING (s)),
k AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM s WHERE doc_id > m),
g AS (SELECT r, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM k),
x AS (SELECT r, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, g),
y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM x),
z AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kh FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kh IS NULL THEN h ELSE kh || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN z USING (r)
"""
