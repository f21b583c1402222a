"""Model scorers that each Python worker loads once, with failures kept to their rows.

A scorer has a name, a factory that loads it, and the columns that it reads. The first task of a worker calls the factory; later
tasks of that worker, of any job of the session, find it loaded. Rows go to it some at a time; where a batch fails, its rows go one
by one, and a row that fails has a null result and the reason.

Defined results: null inputs are handed on as None; a scorer that gives another number of results than it got rows has failed; one
that can't be loaded fails the task, as no row could be scored; an empty table loads nothing; other columns are kept, whatever
they are called but for the scorer's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from reportloom.session import ship

Score = Callable[[list[tuple]], Sequence]
#: What this worker has loaded, by name and version.
_LOADED: dict[tuple[str, str], Score] = {}


def loaded(name: str, version: str, factory: Callable[[], Score]) -> Score:
    if (name, version) not in _LOADED:
        _LOADED[name, version] = factory()
    return _LOADED[name, version]


def results(score: Score, rows: list[tuple]) -> Iterator[tuple[object, str | None]]:
    """(result, None) or (None, reason) of each row."""
    try:
        got = list(score(rows))
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} results for {len(rows)} rows")
        yield from ((x, None) for x in got)
    except Exception as e:  # noqa: BLE001  a plug-in may raise anything
        if len(rows) == 1:
            yield None, f"{type(e).__name__}: {e}"
        else:
            for row in rows:
                yield from results(score, [row])


def scored(df: DataFrame, name: str, factory: Callable[[], Score], inputs: list[str], kind: str, batch: int = 64, version: str = "1") -> DataFrame:
    """Df with the columns `name` (of the type `kind`: a value, or a struct as a dict) and `<name>_error`."""
    if batch < 1:
        raise ValueError("a batch has one row at least")
    ship(df.sparkSession)
    own = {name, f"{name}_error"}
    keep = [f.name for f in df.schema.fields if f.name not in own]
    schema = StructType([*[f for f in df.schema.fields if f.name in keep], StructField(name, _parse_datatype_string(kind)), StructField(f"{name}_error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            score = loaded(name, version, factory)
            rows = [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in f[inputs].astype(object).itertuples(index=False, name=None)]
            got = [x for k in range(0, len(rows), batch) for x in results(score, rows[k : k + batch])]
            out = f[keep].reset_index(drop=True)
            out[name] = pd.Series([x for x, _ in got], dtype=object)
            out[f"{name}_error"] = pd.Series([e for _, e in got], dtype=object)
            yield out

    return df.mapInPandas(run, schema)


def gate(name: str, factory: Callable[[], Score], inputs: list[str], batch: int = 64, version: str = "1") -> Callable[[DataFrame], DataFrame]:
    """A scorer as gates.evaluate takes it: gives (ok, reason) for each row; a row that it fails on isn't ok."""
    from pyspark.sql import functions as F

    def run(df: DataFrame) -> DataFrame:
        out = scored(df, name, factory, inputs, "struct<ok:boolean,reason:string>", batch, version)
        failed = F.struct(F.lit(False).alias("ok"), F.lit("scorer_failed").alias("reason"))
        return out.withColumn(name, F.coalesce(F.col(name), failed)).drop(f"{name}_error")

    return run
