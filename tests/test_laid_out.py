"""Tables laid out for the join: the same view as without, and no exchange in its plan."""

from __future__ import annotations

import pytest

from reportloom.operators import augment


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _tables(spark):
    ids = [*range(200), 7, 7, None]  # repeated and null ids
    rows = spark.createDataFrame([(i, f"finding {i}", "clear", "cough") for i in ids], "study_id long, ref_findings string, ref_impression string, indication string")
    alts = spark.createDataFrame([(str(i), [f"alt {i} {k}" for k in range(i % 4 + 1)]) for i in range(0, 260, 2)], "study_key string, alts array<string>")
    return rows, alts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("draws", ["portable", "sequential"])
def test_laid_out_gives_the_same_rows_without_an_exchange(unbroadcast, draws):
    rows, alts = _tables(unbroadcast)
    plain = augment.training_view(rows, alts, 0.5, seed=3, draws=draws)
    laid = augment.training_view(augment.laid_out(rows, "study_id", 4), augment.laid_out(alts, buckets=4), 0.5, seed=3, draws=draws)
    assert "Exchange" in _plan(plain) and "Exchange" not in _plan(laid)
    assert sorted(plain.columns) == sorted(laid.columns)
    assert sorted(map(str, plain.select(sorted(plain.columns)).collect())) == sorted(map(str, laid.select(sorted(laid.columns)).collect()))


def test_empty_tables(unbroadcast):
    rows, alts = _tables(unbroadcast)
    assert augment.training_view(augment.laid_out(rows.limit(0), "study_id", 4), augment.laid_out(alts, buckets=4), 0.5).count() == 0
    assert augment.training_view(augment.laid_out(rows, "study_id", 4), augment.laid_out(alts.limit(0), buckets=4), 1.0).where("used_aug").count() == 0
