"""Sharding by histogram sort.

Documents are ordered by a hash of their text, then of their id, so equal texts stand together and are split only where a
shard ends. Splitters are found by counting exact bytes below candidate key boundaries: each round counts bytes and rows for
`fanout` equal key intervals inside the intervals that still hold a splitter, on the executors, and returns at most
splitters x fanout sums to the driver, whatever the input. It ends when every splitter is within tolerance of its target
(0: exact). Then rows move once, by (shard, first-round interval), and are numbered.

Law of the query: bytes. Shard i starts at the first key below which i/n of all bytes lie.

Defined results: a null text has size 1; null ids sort before others; rows equal in id and text have one key and stay
together, in any order among themselves; an empty table gives an empty result; assign ignores other columns, write_shards keeps
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import cut

KEY_BITS = 60


def text_key(text: str = "text", doc_id: str = "doc_id") -> F.Column:
    """A 60-bit key, 40 bits from the text and 20 from the id, that any SQL engine with md5 can compute."""
    hexes = F.concat(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 10), F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 5))
    return F.conv(hexes, 16, 10).cast("long")


def splitters(sized: DataFrame, shards: int, fanout_bits: int = 12, tolerance: float = 0.0) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(keys at which shards 1.. start, first-round histogram as (interval, rows, bytes)).

    sized: key (0 to 2**KEY_BITS - 1), size. tolerance: as a part of the bytes a shard should have.
    """
    shift = KEY_BITS - fanout_bits
    bucket = F.shiftright("key", shift)
    first = sorted((r[0], r[1], r[2]) for r in sized.groupBy(bucket.alias("b")).agg(F.count("*"), F.sum("size")).collect())
    total = sum(x[2] for x in first)
    # compare n * bytes with i * total, so that targets are whole numbers
    wanted = {i: i * total for i in range(1, shards)}
    found: dict[int, int] = {}
    slack = int(tolerance * total)

    def narrow(cells: list[tuple[int, int]], below: int, width: int, who: list[int]) -> dict[int, tuple[int, int]]:
        """Of one parent interval: for each splitter the cell start and the bytes below it; ended splitters go to found."""
        left, at = {}, 0
        for i in who:
            while at < len(cells) and (below + cells[at][1]) * shards < wanted[i]:
                below += cells[at][1]
                at += 1
            start, size = cells[at] if at < len(cells) else (1 << KEY_BITS, 0)
            if wanted[i] - below * shards <= slack:
                found[i] = start
            elif (below + size) * shards - wanted[i] <= slack or width == 1:
                found[i] = start + width
            else:
                left[i] = (start, below)
        return left

    left = narrow([(b << shift, size) for b, _, size in first], 0, 1 << shift, sorted(wanted)) if total else {}
    while left:
        width = 1 << shift
        shift = max(0, shift - fanout_bits)
        parents: dict[int, list[int]] = {}
        for i, (start, _) in left.items():
            parents.setdefault(start, []).append(i)
        inside = F.shiftright("key", width.bit_length() - 1).isin([p >> (width.bit_length() - 1) for p in parents])
        counts = sized.where(inside).groupBy(F.shiftright("key", shift).alias("b")).agg(F.sum("size")).collect()
        cells = sorted((r[0] << shift, r[1]) for r in counts)
        again: dict[int, tuple[int, int]] = {}
        for p, who in parents.items():
            again |= narrow([c for c in cells if p <= c[0] < p + width], left[who[0]][1], 1 << shift, sorted(who))
        left = again
    return [found.get(i, 1 << KEY_BITS) for i in range(1, shards)], first


def assign(docs: DataFrame, shards: int = 16, fanout_bits: int = 12, tolerance: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            text_key().alias("key"),
        )
    )
    starts, first = splitters(sized, shards, fanout_bits, tolerance)
    shift = KEY_BITS - fanout_bits
    shard = sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int") if shards > 1 else F.lit(0)
    placed = sized.withColumns({"shard": shard, "cell": F.shiftright("key", shift)})
    # rows before each (shard, cell) within its shard; cells cut by a splitter are counted exactly, the rest are known
    split_cells = sorted({s >> shift for s in starts})
    rows = {(sum(b << shift >= s for s in starts), b): n for b, n, _ in first if b not in split_cells}
    if split_cells:
        rows |= {(r[0], r[1]): r[2] for r in placed.where(F.col("cell").isin(split_cells)).groupBy("shard", "cell").count().collect()}
    before, seen = [], {}
    for s, b in sorted(rows):
        before.append((s, b, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + rows[s, b]
    offsets = spark.createDataFrame(before, "shard int, cell long, before long")  # at most 2**fanout_bits + shards rows
    order = Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "text_crc32")
    return placed.join(F.broadcast(offsets), ["shard", "cell"]).withColumn("slot", (F.row_number().over(order) - 1 + F.col("before")).cast("long")).drop("cell", "before")


def write_shards(docs: DataFrame, path: str, shards: int = 16, files: int = 4) -> None:
    """docs as Parquet folders shard=0.. under path, each of `files` files; rows keep their columns, one called shard as shard_input. Moves texts once.

    Splitters are keys, so a row's own key tells its shard: no join.
    """
    sized = cut(docs.select((F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), text_key().alias("key")))
    starts, _ = splitters(sized, shards)
    keyed = docs.withColumnRenamed("shard", "shard_input").withColumn("shard", sum((F.when(text_key() >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int"))
    keyed.repartition(shards * files, "shard", F.pmod(F.xxhash64(text_key()), F.lit(files))).write.partitionBy("shard").parquet(path)


def op5(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH k AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t,
  ('0x' || substr(md5(coalesce(text, '')), 1, 10) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 5))::BIGINT AS key FROM documents),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
   - sum(size) OVER (PARTITION BY key) AS below, sum(size) OVER () AS total FROM k),
s AS (SELECT *, CAST(least(15, (below * 16) // total) AS INTEGER) AS shard FROM c)
SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot FROM s
"""
