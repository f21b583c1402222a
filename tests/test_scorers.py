"""Scorers loaded once a worker, and failures kept to their rows."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reportloom.operators import gates, scorers


def counting(folder):
    """A factory that leaves a line a load; its scorer takes no batch with a 13 in it, and no 13."""

    def factory():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("loaded\n")

        def score(rows):
            if any(k == 13 for k, _ in rows):
                raise KeyError("thirteen")
            return [None if x is None else float(k) + len(x) for k, x in rows]

        return score

    return factory


def test_loaded_once_a_worker(spark, tmp_path):
    df = spark.range(200).repartition(16).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("t"), F.lit(1).alias("s"))
    for _ in range(2):  # two jobs of sixteen tasks
        got = {r.id: r for r in scorers.scored(df, "s", counting(tmp_path), ["id", "t"], "double", batch=8, version=str(tmp_path)).collect()}
    loads = [p.read_text().count("loaded") for p in Path(tmp_path).iterdir()]
    assert loads and set(loads) == {1} and len(loads) <= 4 * 2
    assert len(got) == 200 and got[13].s is None and got[13].s_error.startswith("KeyError")
    assert all((r.s, r.s_error) == (None if k % 5 == 0 else k + k % 7, None) for k, r in got.items() if k != 13)
    assert scorers.scored(df.where("false"), "s", counting(tmp_path), ["id", "t"], "double").count() == 0


def test_wrong_number_and_structs(spark):
    df = spark.range(5).coalesce(1)

    def short():
        return lambda rows: [{"a": k, "b": "y"} for (k,) in rows if k != 3]

    got = {r.id: (r.z, r.z_error) for r in scorers.scored(df, "z", short, ["id"], "struct<a:long,b:string>", version="short").collect()}
    assert got[3] == (None, "ValueError: 0 results for 1 rows") and all(got[k][0].a == k and got[k][0].b == "y" and got[k][1] is None for k in (0, 1, 2, 4))
    with pytest.raises(ValueError):
        scorers.scored(df, "z", short, ["id"], "double", batch=0)


def test_as_a_gate(spark):
    """In the staged evaluation: only rows that pass the cheap gates are scored."""
    rows = spark.createDataFrame([(1, "lung clear impression: fine heart", "heart fine impression: lung clear"), (2, "lung clear impression: fine", "Lünge"), (3, "a b c impression: d", "b a c impression: d")], "row_id long, src_full string, cand_full string")

    def factory():
        def score(pairs):
            if any(c is None or c.startswith("Lünge") for _, c in pairs):
                raise AssertionError("a row that failed the cheap gates was scored")
            return [{"ok": len(c) > 25, "reason": "ok" if len(c) > 25 else "short"} for _, c in pairs]

        return score

    out = gates.evaluate(rows, {"msl": scorers.gate("msl", factory, ["src_full", "cand_full"], version="g")}, enabled=frozenset({"ascii", "msl"})).collect()
    assert {r.row_id: (r.msl_ok, r.msl_reason) for r in out} == {1: (True, "ok"), 2: (False, "skipped_after_cheap_fail"), 3: (False, "short")}
