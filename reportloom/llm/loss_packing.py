"""Vector bin packing of examples with a loss mask each: the third limit holds for the tokens that really bear loss.

As in packing, sequences have limits on tokens, segments and loss-bearing tokens, the next example is the one with the largest
dot product, and where none fits the largest is cut. Here the loss of a piece is counted on the example's own mask, from the
sums of its prefixes, so turns that bear loss may stand anywhere in it; a cut is as long as both tokens and loss allow.

Each partition packs its own rows as they come, in windows, and has one unfilled sequence; memory is that of WINDOW examples.

Defined results: a null or empty mask is an example without tokens and has no pieces; repeated rows are examples of their own; null ids
stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import arrow_schema, record, ship
from reportloom.llm.packing import CAPACITY, MAX_SEGMENTS, MIN_CUT, WINDOW


class MaskPacker:
    """Pieces (tag, start, length, sequence, offset, loss) of examples (tag, mask)."""

    def __init__(self, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = CAPACITY, min_cut: int = MIN_CUT):
        self.limits = np.array([capacity, max_segments, max_loss], np.int64)
        if self.limits.min() < 1:
            raise ValueError("a limit is below 1")
        self.min_cut, self.sequence, self.open, self.items = min_cut, 0, [], []
        self.free = self.limits.copy()

    def add(self, tag: object, mask: np.ndarray) -> None:
        if len(mask):
            self.items.append((tag, 0, np.concatenate((np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)))))

    def _put(self, tag: object, start: int, n: int, loss: int) -> None:
        self.open.append((tag, start, n, loss))
        self.free -= (n, 1, loss)

    def _close(self) -> Iterator[tuple]:
        at = 0
        for tag, start, n, loss in self.open:
            yield tag, start, n, self.sequence, at, loss
            at += n
        self.sequence += bool(self.open)
        self.open, self.free = [], self.limits.copy()

    def pack(self, last: bool = False) -> Iterator[tuple]:
        """Place items; unless it is the last time, the end of a window leaves the open sequence and the items that don't fit it open."""
        left = dict(enumerate(self.items))
        size = np.array([[len(c) - 1 - start, 1, c[-1] - c[start]] for _, start, c in self.items], np.int64).reshape(-1, 3)
        alive = np.ones(len(size), bool)
        while left:
            fits = np.flatnonzero(alive & (size <= self.free).all(axis=1))
            if len(fits):
                k = int(fits[np.argmax((size[fits] / self.limits) @ (self.free / self.limits))])
                tag, start, c = left.pop(k)
                alive[k] = False
                self._put(tag, start, int(size[k, 0]), int(size[k, 2]))
                continue
            rest = np.flatnonzero(alive)
            k = int(rest[np.argmax(size[rest, 0])])
            tag, start, c = left[k]
            # as many tokens as are free, and as bear no more loss than is free
            n = min(int(self.free[0]), int(np.searchsorted(c, c[start] + self.free[2], side="right")) - 1 - start)
            if self.free[1] >= 1 and n >= 1 and (n >= self.min_cut or not self.open):
                self._put(tag, start, n, int(c[start + n] - c[start]))
                left[k] = tag, start + n, c
                size[k] = len(c) - 1 - start - n, 1, c[-1] - c[start + n]
            elif last or len(left) > WINDOW // 8:
                yield from self._close()
            else:
                break
        self.items = list(left.values())
        if last:
            yield from self._close()


def pack_masked(examples: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = CAPACITY) -> DataFrame:
    """id, part, start, length, n_loss, sequence_id, offset of the pieces of examples (id long, loss array<boolean>; part long, 0 if there is none: an id's examples)."""
    names = "id long, part long, start long, length long, n_loss long, sequence_id long, offset long"
    schema = arrow_schema(names)
    ship(examples.sparkSession)

    def rows(got: list[tuple]) -> pa.RecordBatch:
        base = TaskContext.get().partitionId() << 32
        return record({"id": [x[0][0] for x in got], "part": [x[0][1] for x in got], "start": [x[1] for x in got], "length": [x[2] for x in got], "n_loss": [x[5] for x in got], "sequence_id": [base + x[3] for x in got], "offset": [x[4] for x in got]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, got = MaskPacker(capacity, max_segments, max_loss), []
        for b in batches:
            masks = b.column(2)
            flat, ends = masks.values.to_numpy(zero_copy_only=False), masks.offsets.to_numpy()
            for k, tag in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                p.add(tag, flat[ends[k] : ends[k + 1]] if masks[k].is_valid else flat[:0])
                if len(p.items) >= WINDOW:
                    got += p.pack()
                if len(got) >= 4 * WINDOW:
                    yield rows(got)
                    got = []
        got += p.pack(last=True)
        if got:
            yield rows(got)

    part = F.col("part") if "part" in examples.columns else F.lit(0)
    return examples.select(F.col("id").cast("long"), part.cast("long").alias("part"), "loss").mapInArrow(run, names)
