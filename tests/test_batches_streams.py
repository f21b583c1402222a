"""Streams that put each row down once, and batches padded to their own width."""

import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import batching
from reportloom.streaming import resume


def arrive(spark, path, first, n, files=1):
    spark.range(first, first + n).withColumnRenamed("id", "k").repartition(files).write.mode("append").parquet(path)


def test_a_batch_that_fails_before_its_commit_counts_once(spark, tmp_path, monkeypatch):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    arrive(spark, source, 0, 20, files=4)
    real, failed = resume._stream, []

    def failing(spark, source, schema, checkpoint, put, files_a_batch):
        def once(batch, k):
            put(batch, k)  # written, but never committed
            if k == 1 and not failed:
                failed.append(k)
                raise RuntimeError("lost between write and commit")

        real(spark, source, schema, checkpoint, once, files_a_batch)

    monkeypatch.setattr(resume, "_stream", failing)
    work = lambda x: x.withColumn("done", F.lit(True))
    with pytest.raises(Exception, match="lost between"):
        resume.stream_new(spark, source, "k long", out, check, work, files_a_batch=1)
    assert failed == [1] and resume.results(spark, out).count() < 20
    resume.stream_new(spark, source, "k long", out, check, work, files_a_batch=1)
    assert sorted(r.k for r in resume.results(spark, out).collect()) == list(range(20))
    arrive(spark, source, 20, 5)
    resume.stream_new(spark, source, "k long", out, check, work)
    assert sorted(r.k for r in resume.results(spark, out).collect()) == list(range(25))


def test_stops_after_so_many_accepted(spark, tmp_path, monkeypatch):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    real, failed, worked = resume._stream, [], []

    def failing(spark, source, schema, checkpoint, put, files_a_batch):
        def once(batch, k):
            put(batch, k)
            if k == 1 and not failed:
                failed.append(k)
                raise RuntimeError("lost")

        real(spark, source, schema, checkpoint, once, files_a_batch)

    monkeypatch.setattr(resume, "_stream", failing)

    def work(x):
        worked.append(1)
        return x.withColumn("ok", F.col("k") % 3 > 0)

    run = lambda: resume.stream_accepted(spark, source, "k long", out, check, work, 9, "ok", "k")
    for first in (0, 6, 12, 18):
        arrive(spark, source, first, 6)
        if first == 6:
            with pytest.raises(Exception, match="lost"):
                run()
        run()
    assert sorted(r.k for r in resume.results(spark, out).collect()) == [k for k in range(24) if k % 3][:9]
    assert len(worked) == 4, "batches 0, 1 twice, 2; none after the ninth"


@pytest.mark.parametrize("side", ["left", "right"])
def test_collated(spark, side):
    r = random.Random(7)
    rows = [(k, [r.randrange(1, 99) for _ in range(r.randrange(12))], 5) for k in range(50)] + [(50, None, 5)]
    df = spark.createDataFrame([(k, i, i, x) for k, i, x in rows], "k long, input_ids array<int>, labels array<int>, _x int").repartition(3)
    got = {x.k: x for x in batching.collated(df, "k", 8, pad=0, side=side).collect()}
    order = sorted(rows, key=lambda x: (len(x[1] or []), x[0]))
    for at, (k, ids, _) in enumerate(order):
        ids, x = ids or [], got[k]
        width = max(len(i or []) for _, i, _ in order[at // 8 * 8 : at // 8 * 8 + 8])
        fill = width - len(ids)
        put = lambda own, v, fill=fill: own + [v] * fill if side == "right" else [v] * fill + own
        assert (x.batch, x.place, x.width, x._x) == (at // 8, at % 8, width, 5)
        assert (x.input_ids, x.labels, x.attention_mask) == (put(ids, 0), put(ids, -100), put([1] * len(ids), 0))
    assert batching.collated(df.where("false"), "k", 8).count() == 0
    with pytest.raises(ValueError):
        batching.collated(df, "k", 8, side="both")
