"""Bootstrap of sums without a row for each draw.

How often a resample of N draws takes each of N rows is multinomial. It is drawn by splitting: of the draws that fall into a range
of rows, those of its left half are binomial, down to leaves of LEAF rows, where they are dealt to the rows. Each split has a
generator of its own, seeded by its range, so any task finds the counts of its rows by itself, whatever the partitions are and
however often a task is run. A task keeps one number a resample for each sum; only these are exchanged.

Defined results: a null value counts as no row; without rows all results are 0; rows with equal ids are numbered in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.operators.select import ordinal
from reportloom.session import cut, ship

#: Rows whose counts are drawn together, 8 bytes each and resample.
LEAF = 1024


class Counts:
    """The counts of `n` resamples of `size` rows, leaf by leaf; keeps the splits on the way to the last leaf."""

    def __init__(self, size: int, n: int, seed: int, leaf: int = LEAF):
        self.size, self.n, self.seed, self.leaf = size, n, seed, leaf
        self.path: list[tuple[int, int, np.ndarray]] = []

    def _draws(self, k: int) -> np.ndarray:
        """How many draws of each resample fall into leaf k."""
        while self.path and not self.path[-1][0] <= k < self.path[-1][1]:
            self.path.pop()
        if not self.path:
            self.path.append((0, -(-self.size // self.leaf), np.full(self.n, self.size, np.int64)))
        while self.path[-1][1] - self.path[-1][0] > 1:
            low, high, draws = self.path[-1]
            middle = (low + high) // 2
            rows = min(high * self.leaf, self.size) - low * self.leaf
            left = np.random.default_rng([self.seed, low, high, 0]).binomial(draws, (middle - low) * self.leaf / rows)
            self.path.append((low, middle, left) if k < middle else (middle, high, draws - left))
        return self.path[-1][2]

    def of(self, k: int) -> np.ndarray:
        """Resamples x rows of leaf k."""
        draws = self._draws(k)
        rows = min(self.leaf, self.size - k * self.leaf)
        at = np.random.default_rng([self.seed, k, k, 1]).integers(0, rows, int(draws.sum()))
        return np.bincount(np.repeat(np.arange(self.n) * rows, draws) + at, minlength=self.n * rows).reshape(self.n, rows)


def resampled_sums(values: DataFrame, column: str, n: int = 1000, seed: int = 0, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(rep, n, s, q), the draws, sum and sum of squares of each resample, and the same of the values themselves; values: id, column."""
    ship(values.sparkSession)
    rows = values.select("id", F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    ranked = cut(ordinal(rows, "id", name="at").select("at", "x"))
    size = ranked.count()

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, counts, met = np.zeros((n, 3)), Counts(size, n, seed, leaf), False
        for f in frames:
            at, x = f["at"].to_numpy(np.int64), f["x"].to_numpy(np.float64)
            by = np.argsort(at, kind="stable")
            at, x = at[by], x[by]
            first = np.flatnonzero(np.diff(at // leaf, prepend=-1))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=False):
                c = counts.of(int(at[i]) // leaf)[:, at[i:j] % leaf]
                total += c @ np.stack((np.ones(j - i), x[i:j], x[i:j] ** 2), axis=1)
                met = True
        if met:
            yield pd.DataFrame({"rep": np.arange(n), "n": total[:, 0].astype(np.int64), "s": total[:, 1], "q": total[:, 2]})

    parts = ranked.mapInPandas(sums, "rep long, n long, s double, q double")
    whole = ranked.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return parts.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), whole


def mean() -> Column:
    return F.col("s") / F.col("n")


def deviation() -> Column:
    """Of the population."""
    return F.sqrt(F.greatest(F.col("q") / F.col("n") - mean() * mean(), F.lit(0.0)))


def bootstrap(values: DataFrame, column: str, n: int = 1000, alpha: float = 0.05, seed: int = 0, statistic: Callable[[], Column] = mean, leaf: int = LEAF) -> DataFrame:
    """(mean, ci_low, ci_high, n) of a statistic over n, s and q (draws, sum, sum of squares): of the values, and its quantiles over the resamples."""
    reps, whole = resampled_sums(values, column, n, seed, leaf)
    q = reps.select(statistic().alias("v")).agg(F.percentile("v", F.lit(alpha / 2)).alias("low"), F.percentile("v", F.lit(1 - alpha / 2)).alias("high"))
    zero = F.lit(0.0)
    out = whole.select(F.when(F.col("n") > 0, statistic()).alias("v"), "n").crossJoin(q)  # a row with a row
    return out.select(F.coalesce("v", zero).alias("mean"), F.coalesce("low", zero).alias("ci_low"), F.coalesce("high", zero).alias("ci_high"), "n")
