"""Alignment of two tokenizers over a corpus: groups and links of tokens that end together, and how often ids are linked.

Each text is encoded by a byte-level BPE (A) and a BPE with byte fallback (B). Within mapInPandas a merge with two pointers over
the cumulative token ends cuts both into groups where they end together; each such end links one token of A with one of B.
Texts are cut before single spaces and line breaks between other characters, across which neither tokenizer joins anything
(checked on their vocabularies; else a text is one unit), so units that a worker has met are encoded and aligned once. A text's
result is that of its units in order, and its links are sent as distinct id pairs with their number.

Spark then counts the pairs of all texts, finds each B id's highest count, and joins both back to the texts' pairs. Of two
linked tokens the shorter one's bytes end the longer one, so there are no more id pairs than token suffixes in both
vocabularies (`possible_pairs`), a bound without regard to the corpus: the table of counts is broadcast within it.

What is held at once: a slice of texts of some megabytes, or one longer text, and UNITS units a worker.

Defined results: null and empty texts, and texts that one of both doesn't give back byte by byte, have no tokens; rows that
repeat are aligned and counted each; a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import release, scratch, ship

#: Units that a worker keeps, some 300 bytes each, and how many bytes of text it takes at a time.
UNITS, SLICE = 250_000, 4 << 20
#: Tables of up to so many pairs may be broadcast, 20 bytes each; those of larger vocabularies are joined by an exchange.
BROADCAST_PAIRS = 4_000_000
_UNIT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")
_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Pair:
    """Both tokenizers, their tokens' bytes, and whether texts may be cut into units."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([f"{i}" for i in range(len(own))] for own in (self.a_bytes, self.b_bytes))
        d = json.loads(self.a.to_str())
        first = d["pre_tokenizer"] or {}
        apart = d["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        self.cuts = bool(apart) and not any(_SPACE in x.lstrip(_SPACE) or "\n" in x for x in pieces)
        self.ranked = self._ranked(d["model"]) if self.cuts else None

    def _ranked(self, model: dict):
        """A by ranks, which is faster, if its merges come in the order of their ids."""
        import tiktoken

        merged = ["".join(x) if isinstance(x, list) else x.replace(" ", "") for x in model["merges"]]
        ids = [model["vocab"][x] for x in merged]
        if model.get("dropout") or ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(ids))}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def units(self, text: str) -> list[str]:
        """The units of a space and a text; each begins with a space, or with a line break if it isn't the first."""
        return _UNIT.findall(" " + text) if self.cuts else [" " + text]

    def encode(self, unit: str) -> tuple[list[int], list[int]]:
        """The ids of a unit in A and B, none where one of both doesn't give its bytes back."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        b = self.b.encode(unit[1:] if unit[0] == " " else unit)
        if unit[0] != " ":  # B has put a space before the line break
            b = b[1:] if b and self.b_bytes[b[0]] == b" " else [0]
        same = b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == unit.encode()
        return (a, b) if same else ([], [])

    def encode_many(self, units: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(units, ids in A, ids in B) of some units at a time, behind each other; where units are known to stand apart, together."""
        apart = [u for u in units if u[0] in " \n" and len(u) > 1 and not u[1].isspace() and not u[-1].isspace()] if self.ranked else []
        alone = set(units).difference(apart)
        for at in range(0, len(apart), 500):
            part = [" a", *apart[at : at + 500]]  # B puts a space before what it is given
            joined = "".join(part)
            a, b = np.array(self.ranked.encode_ordinary(joined), np.int64), np.array(self.b.encode(joined[1:]), np.int64)
            ends = np.cumsum([len(u.encode()) for u in part])
            whole = [b"".join([own[i] for i in ids.tolist()]) for own, ids in ((self.a_bytes, a), (self.b_bytes, b))]
            cut = [np.searchsorted(np.cumsum(size[ids]), ends[0]) + 1 for size, ids in ((self.a_size, a), (self.b_size, b))]
            stand = all(np.isin(ends, np.cumsum(size[ids])).all() for size, ids in ((self.a_size, a), (self.b_size, b)))
            if stand and whole[0] == whole[1] == joined.encode():
                yield part[1:], a[cut[0] :], b[cut[1] :]
            else:  # one of them isn't given back
                alone.update(part[1:])
        for u in sorted(alone):
            a, b = self.encode(u)
            yield [u], np.array(a, np.int64), np.array(b, np.int64)


@functools.lru_cache(2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def merge(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both sorted arrays of token ends where tokens end together, by merging them."""
    both = np.concatenate((a_ends, b_ends))
    by = np.argsort(both, kind="stable")  # merges the two sorted runs; of equal ends that of A is first
    same = np.flatnonzero(both[by][1:] == both[by][:-1])
    return by[same], by[same + 1] - len(a_ends)


def _grouped(both: Pair, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, last: np.ndarray) -> list[str]:
    """The tokens of all groups in order, each with what follows it; i, j: each group's last tokens; last: whether it ends its unit."""
    out = np.empty(len(a) + len(b), object)
    group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
    at_a = np.arange(len(a)) + np.append(0, j + 1)[group_a]
    at_b = np.arange(len(b)) + (i + 1)[group_b]
    out[at_a], out[at_b] = [both.a_text[x] + "," for x in a.tolist()], [both.b_text[x] + "," for x in b.tolist()]
    out[at_a[i]] = [both.a_text[x] + "|" for x in a[i].tolist()]
    out[at_b[j]] = [both.b_text[x] + ("" if end else ";") for x, end in zip(b[j].tolist(), last.tolist(), strict=True)]
    return out.tolist()


class Known:
    """Units that have been aligned: numbered, with their counts, groups and links (packed as A id * size of B + B id)."""

    def __init__(self, both: Pair):
        self.both, self.width = both, len(both.b_bytes)
        self.number: dict[str, int] = {}
        self.groups: list[str] = []  # empty: not given back by both
        self.n = np.empty((0, 3), np.int64)  # tokens of A and B, links
        self.links = np.empty(0, np.int64)
        self.again = np.empty(0, bool)  # met in a later slice, too

    def links_of(self, units: np.ndarray) -> np.ndarray:
        """The links of units, behind each other."""
        n = self.n[units, 2]
        start = (np.cumsum(self.n[:, 2]) - self.n[:, 2])[units]
        return self.links[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def shrink(self) -> None:
        """Keep what was met again."""
        keep = np.flatnonzero(self.again)
        if len(keep) > UNITS // 2:
            keep = keep[:0]
        self.links, self.n = self.links_of(keep), self.n[keep]
        names = list(self.number)
        self.number = {names[k]: at for at, k in enumerate(keep.tolist())}
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.again = np.zeros(len(keep), bool)

    def add(self, units: list[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        ns, links = [self.n], [self.links]
        for part, a, b in self.both.encode_many(new):
            a_ends, b_ends = np.cumsum(self.both.a_size[a]), np.cumsum(self.both.b_size[b])
            i, j = merge(a_ends, b_ends)
            ends = np.cumsum([len(u.encode()) for u in part]) if len(a) else np.zeros(1, np.int64)
            to = np.stack([np.searchsorted(x, ends, side="right") for x in (a_ends, b_ends, a_ends[i])], axis=1)
            ns.append(np.diff(to, axis=0, prepend=0))
            links.append(a[i] * self.width + b[j])
            last = np.zeros(len(i), bool)
            last[to[:, 2][to[:, 2] > 0] - 1] = True
            tokens = _grouped(self.both, a, b, i, j, last) if len(a) else []
            at = 0
            for u, end in zip(part, (to[:, 0] + to[:, 1]).tolist(), strict=True):
                self.number[u] = len(self.groups)
                self.groups.append("".join(tokens[at:end]))
                at = end
        self.n, self.links = np.concatenate(ns), np.concatenate(links)
        self.again = np.append(self.again, np.zeros(len(self.groups) - len(self.again), bool))


def _aligned(known: Known, texts: list[str | None], texts_too: bool) -> dict[str, list | np.ndarray]:
    """The columns of a slice of texts."""
    split = [known.both.units(t) if t else [] for t in texts]
    if len(known.groups) > UNITS:
        known.shrink()
    before = len(known.groups)
    known.add([u for own in split for u in own])
    number, groups = known.number, known.groups
    numbers = [[number[u] for u in own] for own in split]
    flat = np.array([k for own in numbers for k in own], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(own) for own in numbers])
    known.again[flat[flat < before]] = True
    lost = np.zeros(len(texts), bool)
    lost[row[known.n[flat, 2] == 0]] = True
    row, flat = row[~lost[row]], flat[~lost[row]]
    sums = [np.bincount(row, known.n[flat, k], len(texts)).astype(np.int64) for k in range(3)]
    wide = len(known.both.a_bytes) * known.width
    key = np.sort(np.repeat(row, known.n[flat, 2]) * wide + known.links_of(flat))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    total = np.diff(np.append(first, len(key)))
    row, code = np.divmod(key[first], wide)
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))[:-1]
    text = ["" if gone else ";".join([groups[k] for k in own]) for own, gone in zip(numbers, lost.tolist(), strict=True)]
    digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in text]
    out = {"n_a": sums[0], "n_b": sums[1], "n_links": sums[2], "groups_sha256": digest, "pair": np.split(code, ends), "times": np.split(total, ends)}
    return out | ({"groups": text} if texts_too else {})


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_links (as many as groups), groups_sha256, pair and times (arrays) and, on request, groups of docs (doc_id, text)."""
    paths = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    ship(docs.sparkSession)
    schema = "row long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, pair array<long>, times array<long>" + (", groups string" if groups else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(pair(*paths))
        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            part = np.cumsum(frame["text"].str.len().fillna(0).to_numpy()) // SLICE
            for _, f in frame.groupby(part):
                got = _aligned(known, [t if isinstance(t, str) else None for t in f["text"]], groups)
                yield pd.DataFrame({"row": np.arange(row, row + len(f)), "doc_id": f["doc_id"].array} | got)
                row += len(f)
                release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, schema)


def possible_pairs(a_path: str, b_path: str) -> int:
    """How many id pairs can be linked at most: tokens of which one's bytes end the other's."""
    both = pair(a_path, b_path)
    ends: list[dict[bytes, int]] = [{}, {}]
    for known, tokens in zip(ends, (both.a_bytes, both.b_bytes), strict=True):
        for x in tokens:
            known[x] = known.get(x, 0) + 1
    longer_a = sum(ends[1].get(x[k:], 0) for x in both.a_bytes for k in range(len(x)))
    return longer_a + sum(ends[0].get(x[k:], 0) for x in both.b_bytes for k in range(1, len(x)))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) of each linked pair of ids: its links in all texts, and whether it has the most of its B id, ties included."""
    counts = aligned.select(F.posexplode("pair").alias("at", "pair"), "times").groupBy("pair").agg(F.sum(F.col("times")[F.col("at")]).alias("count"))
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("pair") % width).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def corpus_links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    align(docs, a_path, b_path, groups=False).write.option("compression", "zstd").parquet(path := scratch(spark))
    aligned = spark.read.parquet(path)
    counts = pair_counts(aligned, len(pair(a_path, b_path).b_bytes))
    if possible_pairs(a_path, b_path) <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    n = F.col("times")[F.col("at")]
    joined = aligned.select("row", F.posexplode("pair").alias("at", "pair"), "times").select("row", "pair", n.alias("n")).join(counts, "pair")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pair", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
