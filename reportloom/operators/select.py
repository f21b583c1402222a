"""Ranking selections, portable pseudo-randomness, samples, shards, unions and joins by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.session import cut

PRIME = 2147483647


def det_rand(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a non-negative id below 3.4e9 and a seed, by whole-number arithmetic that other engines repeat."""
    a = (key.cast("long") * 2654435761 + seed * 40503 + 12345) % PRIME
    b = (a * a + 69621) % PRIME
    return ((b * b + 48271) % PRIME) / F.lit(float(PRIME))


def id_text(c: Column) -> Column:
    """an id as text without outer blanks and a trailing .0; null gives ''."""
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), F.lit(""))


def integer_key(c: Column) -> Column:
    """an id as the text of its whole part where it is a number, otherwise as it is."""
    return F.coalesce(F.try_to_number(c.cast("string"), F.lit("999999999999999999")).cast("bigint").cast("string"), c.cast("string"))


def truthy(c: Column, default: bool = False) -> Column:
    """1, true, yes, y, ok or on."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "ok", "on"), F.lit(default))


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """those of the columns that exist."""
    return df.select(*[n for n in names if n in df.columns])


def ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """rows numbered from 0 in an order. They are sorted by range, and each partition counts from where those before it end; the sorted rows are kept, so that both passes see the same partitions."""
    shift = F.lit(1 << 33)
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inner = F.floor(F.col("_at") / shift), F.col("_at") % shift
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    begin = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", begin.alias("_begin"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_begin") + inner).alias(name))


def first_per(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def score(c: Column) -> Column:
    """A score in which NaN is missing."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def best_candidates(df: DataFrame, key: str = "ex_id", sim: str = "msl_sim", candidate: str = "cand_id", kept: str = "keep_ok") -> DataFrame:
    """Of the kept rows of each key that of the greatest score, scores missing last, then of the least candidate."""
    return first_per(df.where(F.col(kept)), key, score(F.col(sim)).desc_nulls_last(), F.col(candidate))


def best_passing(df: DataFrame, key: str = "study_id", sim: str = "sim", candidate: str = "candidate_idx", passed: str = "all_filters_pass") -> DataFrame:
    """As W2, but a missing score counts as -1."""
    return first_per(df.where(truthy(F.col(passed))), key, F.coalesce(score(F.col(sim)), F.lit(-1.0)).desc(), F.col(candidate))


def first_accepted(df: DataFrame, n: int, accepted: str, *order: str) -> DataFrame:
    """The accepted rows up to the n-th in order."""
    return df.where(F.col(accepted)).orderBy(*order).limit(n)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """L3; a negative n is no limit."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """L4: n rows without replacement, by det_rand; -1, or no fewer rows than n, gives all."""
    return head(df, n, det_rand(F.col(key), seed), F.col(key))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A repeatable random order, as shuffle_order."""
    return ordinal(df, det_rand(F.col(key), seed), F.col(key), name="shuffle_order")


def with_shard(df: DataFrame, shards: int, key: str = "study_id") -> DataFrame:
    """shard_id from an arithmetic hash of an integer key."""
    return df.withColumn("shard_id", F.pmod(F.floor(det_rand(F.col(key)) * PRIME).cast("long"), F.lit(shards)).cast("int"))


def write_shards(df: DataFrame, path: str) -> None:
    """K4: a folder for each shard_id, for pruned reads."""
    df.write.partitionBy("shard_id").parquet(path, compression="snappy")


def union_all(frames: dict[str, DataFrame | None]) -> DataFrame:
    """All rows; columns that a frame lacks are null there. Missing frames (None) are named in a ValueError."""
    missing = [k for k, v in frames.items() if v is None]
    if missing or not frames:
        raise ValueError(f"missing shards: {missing}" if frames else "no shards")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values())


def merge_shards(frames: dict[str, DataFrame | None], key: str = "study_id", *order: str) -> DataFrame:
    """W5 over the shards in their order, then by `order`."""
    placed = {k: None if v is None else v.withColumn("_shard", F.lit(i)) for i, (k, v) in enumerate(frames.items())}
    return first_per(union_all(placed), key, "_shard", *order).drop("_shard")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done; rows without a key stay."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def by_id_list(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows of the ids (key, rank), with their rank; an id that df lacks raises when the result is computed."""
    found = ids.join(df, key, "left")
    others = [c for c in df.columns if c != key]
    there = df.select(F.col(key).alias("_k")).distinct()
    found = found.join(there, F.col(key) == F.col("_k"), "left")
    checked = F.when(F.col("_k").isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no such id: "), F.col(key).cast("string"))))
    return found.select(checked.alias(key), "rank", *others)


def matches_source(candidates: DataFrame, source: DataFrame, columns: list[str], key: str = "study_id") -> bool:
    """Whether the candidates of known keys have the source's values; none at all match, none of known keys don't."""
    if not set(columns) <= set(candidates.columns) & set(source.columns):
        return candidates.isEmpty()
    c, s = (x.select(id_text(F.col(key)).alias("k"), *[F.col(n).cast("string").alias(n) for n in columns]) for x in (candidates, source.dropDuplicates([key])))
    both = c.alias("c").join(s.alias("s"), "k")
    same = reduce(lambda a, b: a & b, [F.col(f"c.{n}").eqNullSafe(F.col(f"s.{n}")) for n in columns])
    got = both.agg(F.count("*").alias("n"), F.bool_and(same).alias("same")).first()
    return bool(got.same) if got.n else candidates.isEmpty()
