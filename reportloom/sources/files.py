"""Files that rows name: read, looked for and written by the tasks that hold the rows, without a listing of folders.

Each task opens the paths of its own rows, some at a time, through Arrow's file systems (local, shared or object stores). What is
held at once is TOGETHER files.

Defined results: a null or empty path, a folder and a missing file have null content; other errors of a store are raised; rows
that repeat a path read it each; other columns are kept, whatever they are called but for that of the content; an empty table
gives an empty result. Two rows that write one path leave one of both contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, StructField, StructType

from reportloom.session import ship

#: Files that a task has open or in memory at once, and threads that wait for the store.
TOGETHER, THREADS = 64, 8


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path, or a URI such as file: or s3:, in its file system."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether tasks can open files of this store; others are read by Spark's own sources."""
    try:
        located(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def content(path: str | None) -> bytes | None:
    if not path:
        return None
    store, at = located(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        return f.read()


def there(path: str | None) -> bool:
    if not path:
        return False
    store, at = located(path)
    return store.get_file_info(at).type == fs.FileType.File


def put(path: str, data: bytes) -> None:
    store, at = located(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(data)


def _with(df: DataFrame, path: str, name: str, kind: DataType, f: Callable[[str | None], object]) -> DataFrame:
    ship(df.sparkSession)
    out = StructType([*[x for x in df.schema.fields if x.name != name], StructField(name, kind)])
    at = df.columns.index(path)
    keep = [k for k, x in enumerate(df.columns) if x != name]
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.bool_()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(THREADS) as pool:
            for b in batches:
                for k in range(0, b.num_rows, TOGETHER):
                    part = b.slice(k, TOGETHER)
                    found = pa.array(list(pool.map(f, part.column(at).to_pylist())), arrow)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], found], names=[*[part.schema.names[c] for c in keep], name])

    return df.mapInArrow(run, out)


def read_files(df: DataFrame, path: str, name: str = "content") -> DataFrame:
    """df with the bytes of the file that each row's path names, null without one."""
    return _with(df, path, name, BinaryType(), content)


def existing_files(df: DataFrame, path: str) -> DataFrame:
    """The rows whose path is a file."""
    return _with(df, path, "_there", BooleanType(), there).where("_there").drop("_there")


def write_files(df: DataFrame, path: str, data: str) -> None:
    """The bytes of a column written to the paths of another, a file a row; rows without both are left out. A task that runs again writes the same files again."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(THREADS) as pool:
            for b in batches:
                for k in range(0, b.num_rows, TOGETHER):
                    part = b.slice(k, TOGETHER)
                    list(pool.map(put, part.column(0).to_pylist(), part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = df.select(F.col(path).alias("p"), F.col(data).cast("binary").alias("d")).where("p <> '' AND d IS NOT NULL")
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
