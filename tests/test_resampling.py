"""Resamples drawn by splitting against the law of drawing, and against themselves in other partitions."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reportloom.operators import resampling


def test_law_of_counts():
    """All count vectors of five rows in leaves of two, each as often as multinomial draws have it."""
    size, n = 5, 60_000
    c = resampling.Counts(size, n, 9, leaf=2)
    every = np.concatenate([c.of(k) for k in range(3)], axis=1)
    assert every.shape == (n, size) and (every.sum(axis=1) == size).all()
    seen = Counter(map(tuple, every.tolist()))
    chi = cells = 0
    for v in {tuple(x) for x in np.indices((size + 1,) * size).reshape(size, -1).T.tolist() if sum(x) == size}:
        want = n * math.factorial(size) / math.prod(map(math.factorial, v)) / size**size
        chi += (seen[v] - want) ** 2 / want
        cells += 1
    assert cells == 126 and abs(chi - 125) < 5 * math.sqrt(250)


def test_leaves_in_any_order():
    a, b = resampling.Counts(1000, 7, 1, leaf=16), resampling.Counts(1000, 7, 1, leaf=16)
    first = {k: a.of(k) for k in range(63)}
    assert all((first[k] == b.of(k)).all() for k in reversed(range(63))) and sum(x.sum() for x in first.values()) == 7000


def test_bootstrap(spark):
    r = np.random.default_rng(2)
    x = r.exponential(3.0, 5000)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(9999, None)], "id long, x double")
    one, two = (sorted(map(tuple, resampling.resampled_sums(df.repartition(p), "x", 50, 3, leaf=100)[0].collect())) for p in (2, 7))
    assert [t[:2] for t in one] == [(k, 5000) for k in range(50)] and np.allclose([t[2:] for t in one], [t[2:] for t in two])
    b = resampling.bootstrap(df, "x", 400, 0.05, 1).first()
    error = x.std() / math.sqrt(len(x))
    assert abs(b.mean - x.mean()) < 1e-9 and b.n == 5000
    assert abs((b.ci_high - b.ci_low) / (2 * 1.96 * error) - 1) < 0.2 and b.ci_low < x.mean() < b.ci_high
    d = resampling.bootstrap(df, "x", 100, statistic=resampling.deviation).first()
    assert abs(d.mean - x.std()) < 1e-6 and d.ci_low < x.std() < d.ci_high
    assert tuple(resampling.bootstrap(df.where("false"), "x", 10).first()) == (0.0, 0.0, 0.0, 0)
    clash = df.select("id", F.col("x").alias("at"), F.lit(1).alias("n"), F.lit(2).alias("s"))
    assert abs(resampling.bootstrap(clash, "at", 10).first().mean - x.mean()) < 1e-9
