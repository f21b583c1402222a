"""N-gram Jaccard join with signature trees.

A document is the set of its distinct shingles. Documents with one set are one node, of which one row is read further. Nodes
that can reach the threshold are brought together by an exact scheme: shingles fall into m bins by hash, more than the
differences that sets of a size class that link can have, so they agree in a bin that isn't empty, and the content of a bin,
hashed, is a key (see Classes). A set of class c also sends keys of class c + 1 if a set of that class may link with it. Each
key names the least node that has it, its anchor; an anchor and the nodes that share a key with it are a group, so every pair
that may link is in a group. Sets that share no passage share no key, so groups don't grow with the corpus but with its copies.

Groups are joined by signature trees: leaves hold a set's size and token bitmap, inner nodes the range of sizes and the OR of
the bitmaps. A tree is traversed against itself, level by level, the trees of many groups at once; a pair of tree nodes is
dropped if no pair of sizes in their ranges can reach the threshold, or if the bits that they share, with the tokens hidden by
shared bits, allow no overlap that does, or if all that is below both is linked already. A first traversal over bitmaps alone
drops the nodes without a possible partner before any tokens are sent; then pairs of leaves that remain are compared exactly.

Groups of more than CHUNK nodes are cut into chunks, each with the anchor. Chunks are joined by themselves and their links
made components. Where a group then has more than one component, chunks are formed anew in the order of components, and
pairs of chunks are traversed unless both are wholly of one component; so a group of near copies, however large, is linear
work, and no pair between components is missed.

What is held at once: the shingles of half a megabyte of text, or of one longer text; some thousand leaves of trees, or the
bitmaps of one group of up to PRUNED nodes (larger groups keep all their nodes, which changes no result); a chunk's tokens.

Defined results: a null, empty or blank text has no shingles and links with nothing; a text of fewer words than a shingle is
one shingle; rows that repeat an id are one document as to its component; null ids are never linked by their id, and a
component of null ids alone has a null id; an empty table gives an empty result; other columns are ignored by join and kept by
one_of_each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.bpe import chunks
from reportloom.llm.common import arrow_schema, as_bytes, cut, map_arrow, pick, record, ship
from reportloom.llm.components import connected_components

CHUNK, FANOUT = 512, 8
#: Groups of up to this many nodes lose members without a possible partner by their bitmaps, some hundred bytes a node, in one task.
PRUNED = 16_384
#: Leaves of the trees that are traversed together, or MB of their tokens.
TOGETHER = 8192
#: Bytes that are hashed at a time; some ten numbers a byte are held meanwhile.
HASHED = 1 << 19
_RNG = np.random.default_rng(20_260_101)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def _word_sums(data: np.ndarray, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, polynomial sum) of each word of bytes; by default ASCII letters count in lower case."""
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)))
    return start, end, (total[end] - total[start]) * down[start]


def word_hashes(data: np.ndarray, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of bytes."""
    start, _, sums = _word_sums(data, values)
    return start, mix(sums)


def long_word_hashes(text: bytes, window: int, values: np.ndarray = _BYTE) -> np.ndarray:
    """The hash of each word of a text, of which a window at a time is held as numbers; a word may cross any number of windows."""
    out, carry, size = [], 0, 0  # the sum and the length of the word that the last window left open
    for at in range(0, len(text), window):
        data = np.frombuffer(text, np.uint8, min(window, len(text) - at), at)
        start, end, sums = _word_sums(data, values)
        if size and not (len(start) and start[0] == 0):
            out.append(np.array([carry], np.uint64))
            carry = size = 0
        if size:
            sums[0] = _U((carry + int(sums[0]) * pow(_BASE, size, 1 << 64)) % (1 << 64))
        if len(end) and end[-1] == len(data):
            carry, size = int(sums[-1]), (size if size and len(end) == 1 else 0) + int(end[-1] - start[-1])
            sums = sums[:-1]
        else:
            carry = size = 0
        out.append(sums)
    if size:
        out.append(np.array([carry], np.uint64))
    return mix(np.concatenate(out))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words from each word on that has as many."""
    n = max(0, len(h) - k + 1)
    s = h[:n].copy()
    for j in range(1, k):
        s = mix(s * _U(0xD6E8FEB86659FD93) + h[j : j + n])
    return s


def _whole(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle."""
    x = h[:1]
    for j in range(1, len(h)):
        x = mix(x * _U(0xD6E8FEB86659FD93) + h[j : j + 1])
    return mix(x + _U(len(h)))


def shingle_sets(texts: list[bytes], k: int, window: int | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    window = window or HASHED

    def of(h: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.unique(s) if len(h) >= k else _whole(h) if len(h) else np.empty(0, np.uint64)

    for r in chunks(texts, window):
        own = [texts[i] for i in r]
        last = own.pop() if len(own[-1]) > window else None  # only the last of a chunk may be longer
        if own:
            data = np.frombuffer(b"\n".join(own), np.uint8)
            start, h = word_hashes(data) if len(data) else (np.empty(0, np.int64), np.empty(0, np.uint64))
            at = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in own)])).tolist()
            s = _shingles(h, k)
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield of(h[a:b], s[a : b - k + 1])
        if last is not None:
            h = long_word_hashes(last, window)
            yield of(h, _shingles(h, k))


class Classes:
    """Size classes of a threshold num / den above 1/2, with the number of bins of each in each round.

    A set that fills more bins than it may differ in shingles from any set of the class that it links with shares the content
    of a bin with each of those. The few sets that fill no more send their keys of the next round as well, whose bins are
    others and more; so the first round in which one of two sets fills enough is one for which both send keys. An empty bin is
    never a key.
    """

    def __init__(self, num: int, den: int):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the threshold must be above 1/2 and at most 1")
        self.num, self.den = num, den
        self.low, self.most, self.growth = [1], [], max(1.5, 1.2 * den / num)
        self.counts: dict[tuple[int, int], int] = {}

    def of(self, n: int) -> int:
        while self.low[-1] <= n or len(self.most) < 2:
            high = max(self.low[-1], int(self.low[-1] * self.growth))
            self.most.append((self.den - self.num) * 2 * high // (self.num + self.den))
            self.low.append(high + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def bins(self, level: int, round_: int) -> int:
        """So many that a set of a usual size of the class has, but for rare cases, few enough empty ones; twice as many and more in later rounds."""
        if (level, round_) not in self.counts:
            n, most = max(1.0, self.low[level] * (0.5 + 0.5 * self.num / self.den)), self.most[level]
            m = most + 2
            while m < 64 * (most + 2):
                empty = m * np.exp(-n / m)
                if empty + 2 * np.sqrt(empty + 0.5) < m - most:
                    break
                m += 1 + m // 200
            self.counts[level, round_] = m << round_
        return self.counts[level, round_]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The bin keys of a set, none for one that links with no other set."""
        if not len(s):
            return s
        n = len(s)
        c = self.of(n)
        out = []
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s + _U(0x632BE59BD9B4E019)), dtype=np.uint64)))
        levels = [c]
        while len(self.low) <= c + 2:
            self.of(self.low[-1])
        if self.num * self.low[c + 1] <= self.den * n:
            levels.append(c + 1)
        for level in levels:
            high = self.low[level + 1] - 1
            differ = (self.den - self.num) * (n + min(high, self.den * n // self.num)) // (self.num + self.den)
            if not differ:  # only equal sets link
                continue
            for round_ in range(64):
                m = self.bins(level, round_)
                if m >= 1 << 32:
                    raise RuntimeError("a set fills too few bins")
                own, sums = s, total
                if round_:
                    x = mix(s + _U(round_))
                    own = np.sort(x)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own), dtype=np.uint64)))
                b = ((own >> _U(32)) * _U(m)) >> _U(32)
                first = np.flatnonzero(np.diff(b, prepend=_U(m + 1)))
                content = sums[np.append(first[1:], n)] - sums[first]
                out.append(mix(content + mix(b[first] + _U((64 * level + round_ + 1) << 32))))
                if len(first) > differ:
                    break
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def node_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


# ---------------------------------------------------------------- signature trees


def signature(s: np.ndarray) -> np.ndarray:
    """The token bitmap of a set, of twice as many bits as tokens or more."""
    bits = width([len(s)])
    row = np.zeros(bits, bool)
    row[(s & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller width, or as it is."""
    return sig if len(sig) == words else np.bitwise_or.reduce(sig.reshape(-1, words), axis=0)


class Forest:
    """Signature trees over leaves that stand by group, a tree a group, all of one height: bits, size range, hidden tokens and
    component range of each node of each level, leaves first."""

    def __init__(self, sigs: list[np.ndarray], size: np.ndarray, label: np.ndarray, group: np.ndarray, words: int):
        sig = np.stack([folded(x, words) for x in sigs])
        hidden = size - np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
        self.levels = [(sig, size, size, hidden, label, label)]
        self.children: list[np.ndarray] = []  # of each level but the leaves: where the children of each node begin
        trees = len(np.unique(group))
        while len(group) > trees:
            first = np.flatnonzero(np.diff(group, prepend=-1))
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            at = np.flatnonzero(place % FANOUT == 0)
            prev = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(prev[0], at, axis=0), *(f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), prev[1:], strict=True))))
            self.children.append(np.append(at, len(group)))
            group = group[at]


def width(sizes: list[int]) -> int:
    return 1 << max(8, int(2 * max(sizes) - 1).bit_length())


def _expand(begin: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node k, and how many each has."""
    lo, n = begin[k], begin[k + 1] - begin[k]
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()), n


def traverse(a: Forest, b: Forest, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of each tree of a and that of the same group of b that the bounds leave, in blocks; if b is a, each pair once."""
    same = a is b

    def alive(x, y, i, j):
        (sx, lx, hx, ex, cx, dx), (sy, ly, hy, ey, cy, dy) = x, y
        ok = (num * lx[i] <= den * hy[j]) & (num * ly[j] <= den * hx[i]) & ~((cx[i] == dx[i]) & (cy[j] == dy[j]) & (cx[i] == cy[j]))
        i, j = i[ok], j[ok]
        most = np.bitwise_count(sx[i] & sy[j]).sum(axis=1, dtype=np.int64) + np.minimum(ex[i], ey[j])
        most = np.minimum(most, np.minimum(hx[i], hy[j]))
        ok = (num + den) * most >= num * (lx[i] + ly[j])
        return i[ok], j[ok]

    roots = np.arange(len(a.levels[-1][1]))
    stack = [(len(a.levels) - 1, len(b.levels) - 1, roots, roots)]
    while stack:
        p, q, i, j = stack.pop()
        if len(i) > 20_000:
            half = len(i) // 2
            stack += [(p, q, i[half:], j[half:]), (p, q, i[:half], j[:half])]
            continue
        if same and p == q == 0:
            i, j = i[i != j], j[i != j]
        i, j = alive(a.levels[p], b.levels[q], i, j)
        if not len(i):
            continue
        if p == q == 0:
            yield i, j
            continue
        top = max(p, q)
        if p == top:
            i, n = _expand(a.children[p - 1], i)
            j, p = np.repeat(j, n), p - 1
        if q == top:
            j, n = _expand(b.children[q - 1], j)
            i, q = np.repeat(i, n), q - 1
        if same:
            i, j = i[i <= j], j[i <= j]
        stack.append((p, q, i, j))


class Links:
    """Links that join components, of groups (ids, sets, labels, split): of sets[:split] with the rest, or among all if split is None."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.parent, self.found = num, den, {}, []

    def root(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(y, y)
        return x

    def link(self, u: int, v: int, labels: tuple[int, int]) -> None:
        x, y = map(self.root, labels)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.found.append((u, v))

    def reach(self, both: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (m + n - both)

    def star(self, ids: list[int], sets: list[np.ndarray], labels: list[int]) -> None:
        """Links of the first set, which is compared with all others at once."""
        size = np.array([len(x) for x in sets[1:]], np.int64)
        rest = np.concatenate(sets[1:])
        at = np.minimum(np.searchsorted(sets[0], rest), len(sets[0]) - 1)
        both = np.add.reduceat(sets[0][at] == rest, np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
        for k in np.flatnonzero(self.reach(both, len(sets[0]), size)).tolist():
            self.link(ids[0], ids[k + 1], (labels[0], labels[k + 1]))

    def forest(self, leaves: list[tuple], words: int) -> tuple[Forest, list[tuple]]:
        """leaves: (group, id, set, label); those of a component, and then of like size and content, side by side."""
        leaves = sorted(((g, self.root(x), len(s), int(s[0]), i, s, x) for g, i, s, x in leaves), key=lambda x: x[:5])
        group, label, size = (np.array([x[k] for x in leaves], np.int64) for k in range(3))
        return Forest([signature(x[5]) for x in leaves], size, label, group, words), leaves

    def add(self, groups: list[tuple]) -> None:
        for ids, sets, labels, split in groups:
            if split is None and len(ids) > 2:
                self.star(ids, sets, labels)
        by: dict[tuple[int, bool], list] = {}
        for g in groups:
            by.setdefault((min(width([len(x)]) for x in g[1]) // 64, g[3] is None), []).append(g)
        for (words, same), own in by.items():
            sides = [[(k, *x) for k, g in enumerate(own) for x in list(zip(*g[:3], strict=True))[part(g[3])]] for part in ([slice] if same else [slice, lambda n: slice(n, None)])]
            a, left = self.forest(sides[0], words)
            b, right = (a, left) if same else self.forest(sides[1], words)
            for i, j in traverse(a, b, self.num, self.den):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    (*_, u, s, p), (*_, v, t, q) = left[x], right[y]
                    if self.root(p) == self.root(q):
                        continue
                    if len(s) > len(t):
                        s, t = t, s
                    both = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                    if self.reach(both, len(s), len(t)):
                        self.link(u, v, (p, q))


def with_partner(groups: list[tuple[list[np.ndarray], list[int]]], num: int, den: int) -> list[np.ndarray]:
    """Of groups (bitmaps, sizes): which leaves the bounds alone leave with another of their group that they may link with."""
    by: dict[int, list[int]] = {}
    for k, (sigs, _) in enumerate(groups):
        by.setdefault(min(map(len, sigs)), []).append(k)
    out: list = [None] * len(groups)
    for words, own in by.items():
        group = np.repeat(np.arange(len(own)), [len(groups[k][1]) for k in own])
        size = np.array([x for k in own for x in groups[k][1]], np.int64)
        sigs = [x for k in own for x in groups[k][0]]
        line = np.lexsort((size, group))
        f = Forest([sigs[x] for x in line], size[line], np.arange(len(size)), group, words)
        alive = np.zeros(len(size), bool)
        for i, j in traverse(f, f, num, den):
            alive[line[i]] = alive[line[j]] = True
        for k, x in zip(own, np.split(alive, np.cumsum([len(groups[k][1]) for k in own])[:-1]), strict=True):
            out[k] = x
    return out


# ---------------------------------------------------------------- the join


def nodes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tid, n_shingles, node, check, sig) of docs (doc_id, tid, text): the last three are null without shingles."""

    def f(b: pa.RecordBatch) -> dict:
        n, node, more, sig = [], [], [], []
        for s in shingle_sets(as_bytes(b.column(2)), k):
            x, y = node_of(s) if len(s) else (None, None)
            n.append(len(s))
            node.append(x)
            more.append(y)
            sig.append(signature(s).tobytes() if len(s) else None)
        return {"doc_id": b.column(0), "tid": b.column(1), "n_shingles": n, "node": node, "check": more, "sig": sig}

    return map_arrow(docs.select("doc_id", "tid", "text"), "doc_id long, tid long, n_shingles long, node long, check long, sig binary", f)


def candidate_groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(anchor, node) of the groups in which all pairs of nodes are that may link; an anchor is in its own group."""

    def keys(b: pa.RecordBatch) -> dict:
        classes = Classes(num, den)
        key, node = [], []
        for s in shingle_sets(as_bytes(b.column(1)), k):
            got = classes.keys(s)
            if len(got):
                key.append(got)
                node.append(np.full(len(got), node_of(s)[0], np.int64))
        if not key:
            return {"key": [], "node": []}
        a, n = np.concatenate(key).view(np.int64), np.concatenate(node)
        by = np.lexsort((n, a))
        a, n = a[by], n[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])
        return {"key": pa.array(a[new]), "node": pa.array(n[new])}

    schema = arrow_schema("anchor long, node long")

    def stars(batches):
        last_key = anchor = None
        for b in batches:
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last_key
            first = np.flatnonzero(new)
            lead = np.repeat(node[first], np.diff(np.append(first, len(key))))
            if not new[0]:
                lead = np.concatenate((np.full(len(key) - len(lead), anchor, np.int64), lead))
            last_key, anchor = key[-1], lead[-1]
            ok = lead != node
            got = np.unique(np.stack((lead[ok], node[ok]), axis=1), axis=0)
            if len(got):
                yield record({"anchor": pa.array(got[:, 0]), "node": pa.array(got[:, 1])}, schema)

    found = map_arrow(docs, "key long, node long", keys).repartition("key").sortWithinPartitions("key", "node")
    return found.mapInArrow(stars, "anchor long, node long").distinct()


def _grouped(batches, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first n_keys columns."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield now, rows


def _together(batches, n_keys: int, weigh) -> Iterator[list[tuple[tuple, list[tuple]]]]:
    """Lists of whole groups of about TOGETHER weight, or one heavier group."""
    held, weight = [], 0
    for got in _grouped(batches, n_keys):
        held.append(got)
        weight += weigh(got[1])
        if weight >= TOGETHER:
            yield held
            held, weight = [], 0
    if held:
        yield held


def _alive(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(anchor, node) of rows (anchor, node, size, sig) that the bitmaps leave a partner in their group."""
    schema = arrow_schema("anchor long, node long")

    def run(batches):
        for held in _together(batches, 1, len):
            groups = [([np.frombuffer(x[2], np.uint64) for x in got], [x[1] for x in got]) for _, got in held]
            out = [(key[0], got[k][0]) for (key, got), alive in zip(held, with_partner(groups, num, den), strict=True) for k in np.flatnonzero(alive).tolist()]
            if out:
                yield record({"anchor": [x for x, _ in out], "node": [x for _, x in out]}, schema)

    dealt = rows.select("anchor", "node", "size", "sig").repartition("anchor").sortWithinPartitions("anchor", "node")
    return dealt.mapInArrow(run, "anchor long, node long")


def _join(rows: DataFrame, keys: list[str], num: int, den: int, tiles: bool) -> DataFrame:
    """Links (u, v) found by signature trees in the groups of rows (*keys, side, node, label, tokens)."""
    schema = arrow_schema("u long, v long")

    def run(batches):
        for held in _together(batches, len(keys), lambda got: len(got) + sum(len(x[3]) for x in got) // 4096):
            links, groups = Links(num, den), []
            for _, got in held:
                sides, ids, labels, raw = map(list, zip(*got, strict=True))
                split = sides.count(0) if tiles else None
                if len(ids) > 1 and split != len(ids) and split != 0:
                    groups.append((ids, [np.frombuffer(x, np.uint64) for x in raw], labels, split))
            links.add(groups)
            if links.found:
                yield record({"u": [x for x, _ in links.found], "v": [x for _, x in links.found]}, schema)

    dealt = rows.select(*keys, "side", "node", "label", "tokens").repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return dealt.mapInArrow(run, "u long, v long")


def components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, chunk: int = CHUNK) -> DataFrame:
    """doc_id, tid (a hash of the text), n_shingles and component_id of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    ship(docs.sparkSession)
    members = cut(nodes(docs, k))
    by_node = members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("check").alias("_a"), F.max("check").alias("_b"), F.max("n_shingles").alias("size"), F.max("sig").alias("sig"))
    checked = F.when(F.col("_a") == F.col("_b"), F.col("rep")).otherwise(F.raise_error(F.lit("two sets share a 64-bit digest")))
    by_node = cut(by_node.select("node", checked.alias("rep"), "size", "sig"))
    # of documents with one set, the one of the least id is read; ids that stand for no set aren't (null ids are kept)
    idle = members.where("doc_id IS NOT NULL").select("doc_id").distinct().join(by_node.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    single = pick(docs, cut(idle), keep=False)

    stars = cut(candidate_groups(single.select("doc_id", "text"), k, num, den))
    group = stars.union(stars.select("anchor", F.col("anchor").alias("node")).distinct())
    counts = stars.groupBy("anchor").agg((F.count("*") + 1).alias("n"))
    sized = cut(group.join(counts, "anchor"))
    # nodes that the bitmaps alone leave without a partner in their group go before any tokens are sent
    alive = _alive(sized.where(F.col("n") <= PRUNED).join(by_node.select("node", "size", "sig"), "node"), num, den)
    kept = sized.where(F.col("n") > PRUNED).select("anchor", "node").union(alive.union(alive.select("anchor", F.col("anchor").alias("node"))).distinct())
    kept = cut(kept)
    sized = cut(kept.join(kept.groupBy("anchor").agg(F.count("*").alias("n")), "anchor").join(by_node.select("node", "size"), "node"))
    wanted = cut(sized.select("node").distinct().join(by_node, "node").select("node", F.col("rep").alias("doc_id")))
    nameless = wanted.where("doc_id IS NULL").select("node")

    def tokens(b: pa.RecordBatch) -> dict:
        got = [(node_of(s)[0], s.tobytes()) for s in shingle_sets(as_bytes(b.column(1)), k) if len(s)]
        return {"node": [x for x, _ in got], "tokens": [x for _, x in got]}

    # rows that repeat an id give a node twice, which the join passes over as linked already
    texts = pick(single.select("doc_id", "text"), wanted.where("doc_id IS NOT NULL").select("doc_id").distinct(), keep=True)
    sets = map_arrow(texts, "node long, tokens binary", tokens)
    if not nameless.isEmpty():  # sets that only rows with a null id hold
        own = map_arrow(docs.where("doc_id IS NULL").select("doc_id", "text"), "node long, tokens binary", tokens)
        sets = sets.union(own.join(nameless, "node", "left_semi").dropDuplicates(["node"]))
    sets = cut(sets)

    # round one: chunks of at most about `chunk` nodes, and the anchor in each
    n_chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = sized.where("node <> anchor").select("anchor", F.pmod(F.xxhash64("node"), n_chunks).cast("int").alias("chunk"), "node")
    lead = sized.where("node = anchor").select("anchor", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"), "node")
    first = own.union(lead).join(sets, "node").withColumns({"side": F.lit(0), "label": F.col("node")})
    links = cut(_join(first, ["anchor", "chunk"], num, den, tiles=False))
    labels = cut(connected_components(links))

    # round two: large groups that have more than one component
    large = sized.where(F.col("n") > chunk).join(labels, "node", "left").select("anchor", "node", "size", F.coalesce("label", "node").alias("label"))
    mixed = large.groupBy("anchor").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("anchor")
    line = Window.partitionBy("anchor").orderBy("label", "size", "node")
    placed = cut(large.join(mixed, "anchor").withColumn("chunk", F.floor((F.row_number().over(line) - 1) / chunk).cast("int")))
    if not placed.isEmpty():
        heads = placed.groupBy("anchor", "chunk").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("size").alias("l"), F.max("size").alias("h"))
        left, right = heads.toDF("anchor", "i", "a1", "b1", "l1", "h1"), heads.toDF("anchor", "j", "a2", "b2", "l2", "h2")
        reach = f"{num} * l1 <= {den} * h2 AND {num} * l2 <= {den} * h1"
        tiles = left.join(right, "anchor").where(f"i <= j AND {reach} AND NOT (a1 = b1 AND a2 = b2 AND a1 = a2)").select("anchor", "i", "j")
        rows = placed.join(sets, "node")
        within = rows.join(tiles.where("i = j"), ["anchor"]).where("chunk = i").withColumn("side", F.lit(0))
        across = tiles.where("i < j")
        across = rows.join(across.select("anchor", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("side")).union(across.select("anchor", "j", "i", "j", F.lit(1))), ["anchor", "chunk"])
        more = _join(within, ["anchor", "i", "j"], num, den, False).union(_join(across, ["anchor", "i", "j"], num, den, True))
        links = links.union(more)
        labels = cut(connected_components(links))

    component = by_node.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = component.groupBy("label").agg(F.min("rep").alias("component_id"))
    component = component.join(least, "label").select("node", "component_id")
    return members.join(component, "node", "left").select("doc_id", "tid", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text): sets of k-word shingles with Jaccard num / den or more are linked."""
    return components(docs, k, num, den, chunk).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs (doc_id, text, more) with one row of each component: the least id, of its texts the one of the least hash, once; null ids all stay."""
    found = cut(components(docs, k, num, den).where("doc_id IS NOT NULL"))
    # rows of one id that have no shingles, or stand in one component, are told apart by their texts
    rows = found.groupBy("component_id", "doc_id", "tid", (F.col("n_shingles") == 0).alias("bare")).agg(F.count("*").alias("times"))
    first = Window.partitionBy("component_id").orderBy("tid")
    named = rows.where("doc_id = component_id AND NOT bare").withColumn("place", F.row_number().over(first))
    out = rows.where("doc_id <> component_id").select("doc_id", "tid").union(named.where("place > 1").select("doc_id", "tid"))
    repeated = cut(named.where("place = 1 AND times > 1").select("doc_id", "tid"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tid"))
    kept = pick(tagged, cut(out.distinct()), keep=False, on=["doc_id", "tid"])
    if not repeated.isEmpty():
        again = pick(kept, repeated, keep=True, on=["doc_id", "tid"])
        kept = pick(kept, repeated, keep=False, on=["doc_id", "tid"]).unionByName(again.dropDuplicates(["doc_id", "tid"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    return join(docs, k=3, num=90, den=100)


def oracle(k: int, num: int, den: int, table: str = "documents") -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') || '|' || len(w) ELSE {shingle} END AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE {den} * o >= {num} * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""


ORACLE = oracle(3, 90, 100)
