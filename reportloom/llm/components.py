"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import cut


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for each node of links (u, v: long): the label is the least node of its component.

    Alternates the large-star and small-star operations until nothing changes, a number of rounds that grows with the
    logarithm of a component's size. Minima are aggregated before the exchange, so a node with many links is no hot spot
    there; the joins have one row a node on one side, which AQE may split. Self-links are kept as nodes; nulls are dropped.
    """
    pairs = cut(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna().distinct())
    edges, before = pairs.where("u <> v"), None
    for _ in range(max_rounds):
        edges = _star(edges, large=True)
        edges = cut(_star(edges, large=False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    every = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v, after joining each node's greater (large) or other neighbours to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
