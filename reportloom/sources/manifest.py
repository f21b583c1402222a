"""A cache that knows what it was made from: digests of a source's files, combined by part, held against those of the last run.

A source is a folder of parts, `<source>/<part column>=<value>/...`. Digests are combined without lists: each file's name and SHA-1 is
hashed to 256 bits, and those of a part are added by exclusive or, so that a part of many files is one partial aggregate.

Defined results: a part without files is no part; a part whose work gives no rows has none in the cache; names of parts are texts, a
null part's is __HIVE_DEFAULT_PARTITION__; a run that fails before its manifest is written is made again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.session import cut
from reportloom.sources.io import exists, fingerprints


def combined(hashes: Column) -> Column:
    """One digest of any number of hexadecimal SHA-256 values, whatever their order."""
    quarters = [F.bit_xor(F.conv(F.substring(hashes, 1 + 16 * k, 16), 16, -10).cast("long")) for k in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[q.cast("string") for q in quarters]), 256)


def part_digests(spark: SparkSession, source: str, part: str) -> DataFrame:
    """K5: part, n_files, length, digest of each part of the source."""
    files = fingerprints(spark, source)
    name = F.regexp_extract("path", rf"/{part}=([^/]*)/", 1)
    below = F.regexp_extract("path", rf"/{part}=[^/]*/(.*)$", 1)
    rows = files.where(F.col("path").rlike(rf"/{part}=[^/]*/")).select(name.alias("part"), "length", F.sha2(F.concat_ws(":", below, "sha1"), 256).alias("h"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("length"), combined(F.col("h")).alias("digest"))


def states(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Part and its state against the manifest of before: new, changed, same or gone."""
    if before is None:
        return now.select("part", F.lit("new").alias("state"))
    old = before.select("part", F.col("digest").alias("_before"))
    state = F.when(F.col("_before").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("digest") == F.col("_before"), "same").otherwise("changed")
    return now.join(old, "part", "full").select("part", state.alias("state"))


def refresh(spark: SparkSession, source: str, cache: str, part: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Brings the cache up to its source and gives part, state of this run; only new and changed parts are read and worked on.

    The parts' names to remove go through the driver, as those of any listing do; rows and digests don't. The manifest is written last.
    """
    manifest, rows = f"{cache}/manifest", f"{cache}/rows"
    now = cut(part_digests(spark, source, part))
    found = cut(states(now, spark.read.parquet(manifest) if exists(spark, manifest) else None))
    for (name,) in found.where("state <> 'same'").select("part").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{rows}/{part}={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    todo = found.where("state IN ('new', 'changed')").select(F.col("part").alias("_part"))
    if not todo.isEmpty():
        made = spark.read.parquet(source)
        key = F.coalesce(F.col(part).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        made = work(made.join(F.broadcast(todo) if todo.count() < 10_000 else todo, key == F.col("_part"), "left_semi"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(rows, compression="snappy")
    now.write.mode("overwrite").parquet(manifest)
    return found


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The rows of a cache."""
    return spark.read.parquet(f"{cache}/rows")
