"""BPE encoding and decoding through a distinct-word table.

Texts are split into the tokenizer's own words, the pieces that its pre-tokenizer makes and beyond which it never merges, where
a text has only characters for which this is plain (printable ASCII and letters of Latin-1); elsewhere, and for tokenizers of
another kind, at ASCII white space, which the tokenizer drops and never merges or composes across. So a text's ids are the ids
of its words in order. Equal texts are one text. Texts are dealt to blocks of about BLOCK_BYTES by a hash. Each block sends its
distinct words, cut into buckets by a hash of the word; each bucket gathers the words of all blocks, encodes every distinct
word once, and answers each block with the ids of its words; the block joins them back by position. Ids become pieces through
the vocabulary, whose size is fixed. The words of a block travel as one value per bucket, not as a row per word.

Texts cross one exchange, which both passes over them share. Blocks hold different texts, so no id and no text fills one; a
block holds BLOCK_BYTES on average and one long text more, whatever the input; a frequent word is one entry a block.

Defined results: a null or empty text, or one of white space, has no ids; rows that repeat an id, or an id and a text, are
encoded each; a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import arrow_schema, as_bytes, one_per_text, ship

BLOCK_BYTES = 32 << 20
_CHUNK = 4 << 20


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# The pre-tokenizer's pattern for which words() knows the pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: What the pattern does in plain text: letters of ASCII and Latin-1 (lower case), digits one by one, other printable ASCII.
_PLAIN = re.compile("[ \t\n\x0b\x0c\r!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: Words that are encoded as one text, behind each other.
_JOINED = 200


@functools.cache
def word_ends(path: str) -> np.ndarray | None:
    """Of each id whether it ends a word, for a tokenizer that splits and lower-cases as words() does; None for others."""
    t = tokenizer(path)
    d = json.loads(t.to_str())
    first = (d["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    lower = any(x.get("type") == "Lowercase" for x in (d["normalizer"] or {}).get("normalizers", []))
    special = all(x["content"].startswith("<|") for x in d["added_tokens"])
    if not (lower and special and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") and first.get("behavior") == "Removed" and d["model"].get("end_of_word_suffix") == WORD_END):
        return None
    return np.array([(t.id_to_token(i) or "").endswith(WORD_END) for i in range(t.get_vocab_size())])


def _plain(text: str) -> bool:
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


def words(path: str, text: bytes) -> list[str]:
    """The words of a text, in order."""
    if word_ends(path) is None:
        return [w.decode() for w in text.split()]
    x = text.decode()
    if _plain(x):
        return _PIECE.findall(x.lower())
    out: list[str] = []
    for w in text.split():  # as bytes: at ASCII white space only
        x = w.decode()
        out += _PIECE.findall(x.lower()) if _plain(x) else [x]
    return out


def encode_words(path: str, words: Iterable[str]) -> Iterator[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit numbers."""
    t, words, ends = tokenizer(path), list(words), word_ends(path)
    for k in range(0, len(words), 20_000):
        part = words[k : k + 20_000]
        known: dict[str, bytes] = {}
        if ends is not None:
            plain = [w for w in part if _plain(w)]
            groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
            for g, e in zip(groups, t.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = [0, *(np.flatnonzero(ends[ids]) + 1).tolist()] if len(ids) else [0]
                if len(at) == len(g) + 1:  # else one of them isn't one word, and all are encoded alone
                    raw = ids.tobytes()
                    known.update({w: raw[4 * i : 4 * j] for w, i, j in zip(g, at[:-1], at[1:], strict=True)})
        rest = [w for w in part if w not in known]
        for w, e in zip(rest, t.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        yield from (known[w] for w in part)


@functools.cache
def pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """By id: its decimal digits and its piece."""
    t = tokenizer(path)
    n = t.get_vocab_size()
    return [b"%d" % i for i in range(n)], [(t.id_to_token(i) or "").encode() for i in range(n)]


def small_ids(path: str) -> str:
    """The least type that holds the tokenizer's ids."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def chunks(texts: list[bytes], chunk: int = _CHUNK) -> Iterator[range]:
    """Ranges of texts of about so many bytes, so that what is made of few texts is in memory at once."""
    start = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= chunk:
            yield range(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def vocabulary(path: str, texts: list[bytes], buckets: int) -> list[list[str]]:
    """The distinct words of texts by bucket, each sorted."""
    found: set[str] = set()
    for r in chunks(texts):
        for k in r:
            found.update(words(path, texts[k]))
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in found:
        out[zlib.crc32(w.encode()) % buckets].append(w)
    for x in out:
        x.sort()
    return out


def word_ids(single: DataFrame, path: str, blocks: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(block, tid, text) and, by block and bucket, the packed ids of the block's sorted distinct words; single: different texts (tid, text)."""
    dealt = single.select(F.pmod(F.xxhash64("tid"), F.lit(blocks)).cast("int").alias("block"), "tid", "text")
    ship(single.sparkSession)
    asked = arrow_schema("block int, bucket int, words binary")
    answer = arrow_schema("block int, bucket int, counts binary, ids binary")

    def ask(table: pa.Table) -> pa.Table:
        got = vocabulary(path, as_bytes(table.column("text").combine_chunks()), buckets)
        block = table.column("block")[0].as_py()
        rows = [(k, " ".join(x).encode()) for k, x in enumerate(got) if x]
        return pa.table([[block] * len(rows), [k for k, _ in rows], [x for _, x in rows]], schema=asked)

    def encode(table: pa.Table) -> pa.Table:
        asks = [x.decode().split(" ") for x in table.column("words").to_pylist()]
        every = sorted(set().union(*asks))
        at = {w: k for k, w in enumerate(every)}
        raw = list(encode_words(path, every))
        counts = np.array([len(x) // 4 for x in raw], "<u4")
        ids = np.frombuffer(b"".join(raw), "<u4").astype(small_ids(path))
        ends = np.cumsum(counts, dtype=np.int64)
        out = []
        for own in asks:
            k = np.fromiter((at[w] for w in own), np.int64, len(own))
            n = counts[k].astype(np.int64)
            total = int(n.sum())
            take = np.repeat(ends[k] - n - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            out.append((counts[k].astype("<u2" if n.max() < 1 << 16 else "<u4").tobytes(), ids[take].tobytes()))
        return pa.table([table.column("block"), table.column("bucket"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], schema=answer)

    found = dealt.groupBy("block").applyInArrow(ask, "block int, bucket int, words binary")
    return dealt, found.groupBy("bucket").applyInArrow(encode, "block int, bucket int, counts binary, ids binary")


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, block_bytes: int | None = None, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and the ids and decoded text of each row of docs (doc_id, text), or with digests their SHA-256."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    single, ids = one_per_text(docs)
    size = ids.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    buckets = 4 * blocks
    dealt, answers = word_ids(single, path, blocks, buckets)
    names = "tid long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string")
    schema = arrow_schema(names)

    def join(table: pa.Table, answer: pa.Table) -> pa.Table:
        texts = as_bytes(table.column("text").combine_chunks()) if table.num_rows else []
        tids = table.column("tid").to_pylist() if table.num_rows else []
        digits, piece = pieces(path)
        known: dict[str, tuple[int, bytes, bytes]] = {}
        own = vocabulary(path, texts, buckets)
        for bucket, counts, ids in zip(*(answer.column(c).to_pylist() for c in ("bucket", "counts", "ids")), strict=True):
            flat, at = np.frombuffer(ids, small_ids(path)).tolist(), 0
            for w, n in zip(own[bucket], np.frombuffer(counts, f"<u{len(counts) // len(own[bucket])}").tolist(), strict=True):
                got = flat[at : at + n]
                at += n
                if n == 1:
                    known[w] = 1, digits[got[0]], piece[got[0]]
                elif n:
                    known[w] = n, b" ".join([digits[i] for i in got]), b" ".join([piece[i] for i in got])
        out: dict[int, tuple] = {}
        for r in chunks(texts):
            for k in r:
                if tids[k] in out:  # rows that repeat id and text
                    continue
                got = [known[w] for w in words(path, texts[k]) if w in known]
                a, b = b" ".join([x[1] for x in got]), b" ".join([x[2] for x in got])
                n = sum([x[0] for x in got])
                out[tids[k]] = (n, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) if digests else (n, a.decode(), b.decode())
        return pa.table([pa.array(list(out), pa.int64()), *(pa.array([x[j] for x in out.values()], schema.types[j + 1]) for j in range(3))], schema=schema)

    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, names)
    return docs.select("doc_id", "tid").join(found, "tid").select("doc_id", *schema.names[1:])
