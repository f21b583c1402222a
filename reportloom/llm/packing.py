"""Vector bin packing of training examples into sequences.

A sequence has three limits: tokens, segments and loss-bearing tokens. Whole sequences are cut off long examples first. The
rest are placed by the dot-product heuristic: of the examples that fit, the next is the one whose demands, as parts of the
limits, have the largest dot product with what the sequence has left. If none fits and at least MIN_CUT tokens are free, the
largest example is cut to fill the sequence as far as the limits let it; what is left of it stays for a later sequence.

Each partition packs its own rows as they come, in windows of WINDOW examples, and carries what is open into the next, so it
needs no exchange, memory doesn't grow with the input, and a partition has one unfilled sequence. Ids come in the words'
order from a table of distinct words; a worker keeps a bounded table of the words it has met, of which those not met again go.
A sequence's id is its partition's number times 2**32 plus its number there, so a task that is run again gives it again.

Defined results: a null or empty text is one token, the end; repeated rows are examples of their own; null ids stay null; an
empty table gives an empty result; other columns are ignored; an example whose loss can't fit a limit of 0 raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.bpe import chunks, encode_words, words
from reportloom.llm.common import arrow_schema, as_bytes, record, ship

CAPACITY, MAX_SEGMENTS, WINDOW, MIN_CUT = 2048, 64, 1024, 16
END_ID = 1
#: A worker's words with their ids: those met lately, and those met before. Beyond _TABLE_WORDS (some 50 MB) the first become the second.
_TABLES: list[dict[str, bytes]] = [{}, {}]
_TABLE_WORDS = 250_000


class Packer:
    """Pieces (tag, start, length, sequence, offset) of examples (tag, tokens, loss): an example's last `loss` tokens bear loss."""

    def __init__(self, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, min_cut: int = MIN_CUT):
        self.limits = np.array([capacity, max_segments, capacity if max_loss is None else max_loss], np.int64)
        if self.limits.min() < 1:
            raise ValueError("a limit is below 1")
        self.min_cut, self.items, self.open, self.sequence = min_cut, [], [], 0
        self.free = self.limits.copy()

    def add(self, tag: object, tokens: int, loss: int) -> Iterator[tuple]:
        start = 0
        while tokens - start >= self.limits[0] and min(tokens - start, loss) <= self.limits[2] and min(self.limits[0], max(0, loss - (tokens - start - self.limits[0]))) <= self.limits[2]:
            n = int(self.limits[0])
            yield tag, start, n, self._next(), 0
            start += n
        if start < tokens or not tokens:
            self.items.append((tag, start, tokens - start, min(loss, tokens - start)))

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _close(self) -> Iterator[tuple]:
        at, s = 0, self._next() if self.open else 0
        for tag, start, n in self.open:
            yield tag, start, n, s, at
            at += n
        self.open, self.free = [], self.limits.copy()

    def pack(self, last: bool = False) -> Iterator[tuple]:
        """Place items; unless it is the last time, a window's end leaves the open sequence and the items that don't fit it open."""
        if self.items:
            size = np.array([[n, 1, loss] for _, _, n, loss in self.items], np.int64)
            parts = size / self.limits
            alive = np.ones(len(size), bool)
            left = len(size)
            while left:
                fits = np.flatnonzero(alive & (size <= self.free).all(axis=1))
                if len(fits):
                    k = int(fits[np.argmax(parts[fits] @ (self.free / self.limits))])
                    tag, start, n, _ = self.items[k]
                    self.open.append((tag, start, n))
                    self.free -= size[k]
                    alive[k] = False
                    left -= 1
                    continue
                rest = np.flatnonzero(alive)
                k = int(rest[np.argmax(size[rest, 0])])
                tag, start, n, loss = self.items[k]
                # a prefix of the item bears loss from its token n - loss on
                cut = min(int(self.free[0]), n - loss + int(self.free[2]), n - 1)
                if self.free[1] >= 1 and cut >= min(self.min_cut, n - 1) and cut >= 1 and (cut >= self.min_cut or not self.open):
                    borne = max(0, cut - (n - loss))
                    self.open.append((tag, start, cut))
                    self.free -= (cut, 1, borne)
                    self.items[k] = (tag, start + cut, n - cut, loss - borne)
                    size[k] = (n - cut, 1, loss - borne)
                    parts[k] = size[k] / self.limits
                elif not self.open:
                    raise ValueError("an example fits no sequence")
                elif last or left > WINDOW // 8:
                    yield from self._close()
                else:
                    break
            self.items = [self.items[k] for k in np.flatnonzero(alive)]
        if last:
            yield from self._close()


def pack(examples: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """id, start, length, sequence_id, offset of the pieces of examples (id long, n_tokens, n_loss: trailing tokens that bear loss)."""
    names = "id long, start long, length long, sequence_id long, offset long"
    schema = arrow_schema(names)
    ship(examples.sparkSession)

    def run(batches):
        p = Packer(capacity, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 32
        for got in _windows(p, ((i, n or 0, m or 0) for b in batches for i, n, m in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))):
            yield record({"id": [x[0] for x in got], "start": [x[1] for x in got], "length": [x[2] for x in got], "sequence_id": [base + x[3] for x in got], "offset": [x[4] for x in got]}, schema)

    return examples.select(*[F.col(c).cast("long") for c in ("id", "n_tokens", "n_loss")]).mapInArrow(run, names)


def _windows(p: Packer, examples) -> Iterator[list[tuple]]:
    got: list[tuple] = []
    for tag, n, loss in examples:
        got += p.add(tag, n, loss)
        if len(p.items) >= WINDOW:
            got += p.pack()
        if len(got) >= 4 * WINDOW:
            yield got
            got = []
    got += p.pack(last=True)
    if got:
        yield got


def tokenize(path: str, texts: list[bytes]) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, with the end id."""
    end = np.array([END_ID], "<u4").tobytes()
    for r in chunks(texts, 1 << 20):
        split = [words(path, texts[k]) for k in r]
        if len(_TABLES[0]) > _TABLE_WORDS:
            _TABLES[:] = [{}, _TABLES[0]]
        late, early = _TABLES
        new = set().union(*split).difference(late)
        known = new & early.keys()
        late.update({w: early[w] for w in known})
        new = list(new - known)
        late.update(zip(new, encode_words(path, new), strict=True))
        for own in split:
            yield b"".join([late[w] for w in own]) + end


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text), each token bearing loss: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    schema = arrow_schema(names)
    ship(docs.sparkSession)

    def examples(batches):
        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), tokenize(path, as_bytes(b.column(1))), strict=True):
                yield (i, ids), len(ids) // 4, len(ids) // 4

    def run(batches):
        p = Packer(capacity, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 32
        for got in _windows(p, examples(batches)):
            cols: dict[str, list] = {c: [] for c in schema.names}
            for (i, ids), start, n, s, at in got:
                own = ids[4 * start : 4 * (start + n)]
                for c, v in zip(schema.names, (i, start, n, zlib.crc32(own), len(ids) // 4, base + s, at), strict=False):
                    cols[c].append(v)
                if with_ids:
                    cols["ids"].append(np.frombuffer(own, "<u4").astype(np.int32).tolist())
            yield record(cols, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, names)
