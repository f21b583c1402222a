"""Training batches padded to their own longest row.

Rows are sorted by length, so that those of one batch differ little, and numbered by sorted ranges and the partitions' offsets;
neighbours make a batch. The width of a batch is the maximum of its at most `size` rows.

Defined results: null ids count as none; rows of equal lengths are ordered by the key, rows with equal keys in any order; the last
batch may be smaller; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.sets import padded
from reportloom.operators.select import ordinal


def batched(df: DataFrame, key: str, length: Column, size: int) -> DataFrame:
    """df with batch, place (in it) and width (the longest of it)."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    rows = ordinal(df.withColumn("_length", length), "_length", key, name="_at")
    rows = rows.withColumns({"batch": F.floor(F.col("_at") / size).cast("long"), "place": (F.col("_at") % size).cast("int")})
    return rows.withColumn("width", F.max("_length").over(Window.partitionBy("batch"))).drop("_length", "_at")


def collated(df: DataFrame, key: str, size: int, pad: int = 0, side: str = "right", ids: str = "input_ids", labels: str = "labels", ignored: int = -100) -> DataFrame:
    """V5: df in batches, with ids padded by `pad`, labels by `ignored`, and attention_mask, all to the batch's width, on one side."""
    if side not in ("left", "right"):
        raise ValueError(f"a side is left or right, not {side}")
    none = F.array().cast("array<int>")
    rows = df.withColumns({ids: F.coalesce(F.col(ids), none), labels: F.coalesce(F.col(labels), none)})
    rows = batched(rows, key, F.greatest(F.size(ids), F.size(labels)), size)
    ones = F.transform(ids, lambda x: F.lit(1))
    return rows.withColumn("attention_mask", padded(ones, F.col("width"), side, 0)).withColumns({ids: padded(F.col(ids), F.col("width"), side, pad), labels: padded(F.col(labels), F.col("width"), side, ignored)})
