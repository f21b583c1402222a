"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.session import cut, scratch, ship

__all__ = ["arrow_schema", "as_bytes", "cut", "map_arrow", "one_per_text", "partitions", "pick", "record", "release", "scratch", "ship", "slices"]

#: Words are maximal runs of bytes other than ASCII white space, as bytes.split() gives them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Stands for a null id, behind all others.
LAST = (1 << 63) - 1
#: Up to this many keys, of some ten bytes, are broadcast to the texts; more are joined by an exchange.
BROADCAST_KEYS = 200_000


def pick(docs: DataFrame, keys: DataFrame, keep: bool, on: str | list[str] = "doc_id") -> DataFrame:
    """The rows of docs whose key is among keys (keep), or isn't; rows with a null key are never among them."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi" if keep else "left_anti")


def one_per_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, text) of docs without the copies of a text in documents of a greater id (or null id, if there are others),
    and (tid, rep, n): the least id and the bytes of each text. docs: doc_id, tid (64-bit hash of the text), text, not null.

    Rows that repeat both id and text are left as they are. Ids and hashes are aggregated and exchanged, texts only where the
    copies are too many to broadcast. Two texts of one hash raise an error.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc_id"), "tid", "text")
    ids = keyed.select("doc_id", "tid", F.md5("text").alias("m"), F.octet_length("text").alias("n")).groupBy("tid").agg(F.min("doc_id").alias("rep"), F.min("m").alias("_a"), F.max("m").alias("_b"), F.max("n").alias("n"))
    checked = F.when(F.col("_a") == F.col("_b"), F.col("rep")).otherwise(F.raise_error(F.lit("two texts share a 64-bit hash")))
    ids = cut(ids.select("tid", checked.alias("rep"), "n"))
    copies = keyed.select("doc_id", "tid").distinct().join(ids.select(F.col("rep").alias("doc_id"), "tid"), ["doc_id", "tid"], "left_anti")
    return pick(keyed, cut(copies), keep=False, on=["doc_id", "tid"]), ids


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes, or of one larger row."""
    step = max(1, b.num_rows * size // max(b.nbytes, 1))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


try:  # glibc keeps what numpy frees, unless it is told to give it back
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None


def release() -> None:
    """Give a worker's free memory back to the machine, on which an executor's JVM and other workers need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_arrow(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], dict | None], size: int = 8 << 20) -> DataFrame:
    """df.mapInArrow with f from a part of a batch, of about `size` bytes, to the columns of a batch of any length."""
    ship(df.sparkSession)
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, size):
                if (got := f(part)) is not None:
                    yield record(got, out)
                    del got
                release()

    return df.mapInArrow(run, schema)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[k.name], pa.Array) else pa.array(x, k.type) for k in schema], schema=schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "short": pa.int16()}


def _arrow(schema: str) -> pa.Schema:
    fields = []
    for x in schema.split(","):
        name, kind = x.strip().split(" ", 1)
        kind = kind.strip()
        fields.append((name, pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]))
    return pa.schema(fields)


arrow_schema = _arrow


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]
