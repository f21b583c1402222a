"""A cache brought up to its source: only what has changed is made again, also after a run that failed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportloom.session import scratch
from reportloom.sources import manifest


def _put(spark, source, rows):
    spark.createDataFrame(rows, "id long, part string").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(source)


def _made(run):
    return lambda rows: rows.withColumn("run", F.lit(run))


def _states(found):
    return {r.part: r.state for r in found.collect()}


def _rows(spark, cache):
    return sorted(tuple(r) for r in manifest.cached(spark, cache).select("id", "part", "run").collect())


def test_one_part_changed_is_one_part_made_again(spark):
    source, cache = scratch(spark), scratch(spark)
    _put(spark, source, [(1, "a"), (2, "b"), (3, "c")])
    assert set(_states(manifest.refresh(spark, source, cache, "part", _made(1))).values()) == {"new"}
    assert set(_states(manifest.refresh(spark, source, cache, "part", _made(2))).values()) == {"same"}
    _put(spark, source, [(20, "b"), (21, "b")])
    assert _states(manifest.refresh(spark, source, cache, "part", _made(3))) == {"a": "same", "b": "changed", "c": "same"}
    assert _rows(spark, cache) == [(1, "a", 1), (3, "c", 1), (20, "b", 3), (21, "b", 3)]


def test_a_part_without_results_leaves_none_of_before(spark):
    source, cache = scratch(spark), scratch(spark)
    _put(spark, source, [(1, "a"), (2, "b")])
    manifest.refresh(spark, source, cache, "part", _made(1))
    _put(spark, source, [(5, "b")])
    manifest.refresh(spark, source, cache, "part", lambda rows: _made(2)(rows).where("id <> 5"))
    assert _rows(spark, cache) == [(1, "a", 1)]


def test_a_run_that_fails_is_made_again(spark, monkeypatch):
    source, cache = scratch(spark), scratch(spark)
    _put(spark, source, [(1, "a"), (2, "b")])
    manifest.refresh(spark, source, cache, "part", _made(1))
    _put(spark, source, [(9, "b")])

    def fail(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        manifest.refresh(spark, source, cache, "part", fail)
    assert _states(manifest.refresh(spark, source, cache, "part", _made(2))) == {"a": "same", "b": "changed"}
    assert _rows(spark, cache) == [(1, "a", 1), (9, "b", 2)]


def test_null_parts_and_order_of_digests(spark):
    source, cache = scratch(spark), scratch(spark)
    _put(spark, source, [(1, None), (2, "b")])
    assert set(_states(manifest.refresh(spark, source, cache, "part", _made(1)))) == {"__HIVE_DEFAULT_PARTITION__", "b"}
    assert _rows(spark, cache) == sorted([(1, None, 1), (2, "b", 1)])
    h = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one, other = h.coalesce(1).agg(manifest.combined(F.col("h"))), h.orderBy(F.desc("h")).agg(manifest.combined(F.col("h")))
    assert one.first() == other.first() != h.limit(99).agg(manifest.combined(F.col("h"))).first()
