"""Agreement of annotation graphs against sets in Python."""

import random
import re

from pyspark.sql import functions as F

from reportloom.functions.sets import ENTITY
from reportloom.operators import evaluate, graphs


def python_sets(ann):
    """Entities and relations of an annotation, as sets of tuples."""
    clean = lambda e: (tuple(y for x in (e or {}).get("tokens") or [] if (y := re.sub("[^a-z0-9]+", "", x.lower()))), ((e or {}).get("label") or "").strip())
    keys = {k: clean(e) for k, e in (ann or {}).items()}
    rel = {(keys[k], r[0], keys[r[1]]) for k, e in (ann or {}).items() for r in (e or {}).get("relations") or [] if len(r) == 2 and r[1] in keys}
    return set(keys.values()), rel


def shares(ref, hyp):
    if not hyp:
        return (1.0, 1.0) if not ref else (0.0, 0.0)
    return len(ref & hyp) / len(hyp), len(ref & hyp) / max(1, len(ref))


def annotation(r):
    if r.random() < 0.1:
        return None
    n = r.randrange(8)
    out = {}
    for k in range(n):
        rel = [[r.choice(("at", "by", "a:t", "")), str(r.randrange(n + 2))] for _ in range(r.randrange(3))] + ([["lonely"]] if r.random() < 0.2 else [])
        out[str(k)] = {"tokens": r.choices(["Lung", "lung,", "clear", "1:x", "--", ""], k=r.randrange(4)), "label": r.choice(("A", " A ", "B|1", "", None)), "relations": r.choice((rel, rel, None))}
    return out


def table(spark, seed, n=150):
    r = random.Random(seed)
    rows = [(k, annotation(r), annotation(r)) for k in range(n)] + [(n, {}, {}), (n + 1, None, None), (n + 2, {"1": None}, {"1": {"tokens": [], "label": "", "relations": []}})]
    same = annotation(random.Random(3))
    rows.append((n + 3, same, same))
    return rows, spark.createDataFrame(rows, f"id long, ref_ann {ENTITY}, hyp_ann {ENTITY}")


def test_overlap(spark):
    rows, df = table(spark, 1)
    got = {x.id: x for x in graphs.overlap(df.repartition(3), "id").collect()}
    assert len(got) == len(rows)
    for k, ref, hyp in rows:
        for short, a, b in zip(("ent", "rel"), python_sets(ref), python_sets(hyp), strict=True):
            x = got[k]
            assert (x[f"{short}_p"], x[f"{short}_r"]) == shares(a, b), (k, ref, hyp)
            assert (x[f"extra_{short}"], x[f"miss_{short}"]) == (len(b - a), len(a - b))


def test_detail_and_f1(spark):
    rows, df = table(spark, 2)
    both = [(python_sets(a), python_sets(b)) for _, a, b in rows if a is not None and b is not None]
    d = evaluate.overlap_detail(df).first()
    assert (d.n, d.n_scored, d.n_skipped) == (len(rows), len(both), len(rows) - len(both))
    means = [sum(shares(a[k], b[k])[j] for a, b in both) / len(both) for k in (0, 1) for j in (0, 1)]
    assert [round(x, 12) for x in (d.entity_precision, d.entity_recall, d.relation_precision, d.relation_recall)] == [round(x, 12) for x in means]
    f = evaluate.entity_f1(df).first()
    want = sum(1.0 if not (a[0] or b[0]) else 2 * len(a[0] & b[0]) / (len(a[0]) + len(b[0])) for a, b in both) / len(rows)
    assert f.n == len(rows) and round(f.rg_e, 12) == round(want, 12)
    empty = evaluate.overlap_detail(df.where("false")).first()
    assert (empty.n, empty.entity_precision, evaluate.entity_f1(df.where("false")).first().rg_bar_er) == (0, 0.0, 0.0)


def test_clashing_columns_and_long_texts(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(i.cast("string").alias("k"), F.struct(F.array(F.concat(F.lit("w"), i.cast("string"))).alias("tokens"), F.lit("A").alias("label"), F.array(F.array(F.lit("at"), ((i + 1) % 20_000).cast("string"))).alias("relations"))))
    df = spark.range(1).select(F.lit(5).alias("kind"), F.map_from_entries(words).alias("ref"), F.map_from_entries(F.slice(words, 1, 15_000)).alias("name"))
    x = graphs.overlap(df, "kind", "ref", "name").first()
    assert (x.kind, x.miss_ent, x.extra_ent, x.miss_rel, x.extra_rel) == (5, 5000, 0, 5001, 0)


def test_nothing_is_exchanged_or_kept(spark):
    """Entities stay within their row: no exchange but of the sums, and no copy of the annotations."""
    df = spark.range(3).selectExpr("id", f"CAST(NULL AS {ENTITY}) AS ref_ann", f"CAST(NULL AS {ENTITY}) AS hyp_ann")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (graphs.overlap(df, "id"), evaluate.overlap_detail(df), evaluate.entity_f1(df))]
    assert [p.count("Exchange") for p in plans] == [0, 1, 1]
    assert not any("ExistingRDD" in p or "Join" in p for p in plans)


def test_targets_that_are_not_there(spark):
    """Questions after ids without an entity, or without an id, find nothing."""
    ann = {"5": {"tokens": ["a"], "label": "A", "relations": [["at", "6"], ["at", None], ["at", "1"], ["at", "9"]]}, "9": {"tokens": ["b"], "label": "B", "relations": [["at", "99"], ["at", "5"], None]}}
    df = spark.createDataFrame([(1, ann, {**ann, "9": {"tokens": ["b"], "label": "B", "relations": []}})], f"id long, ref_ann {ENTITY}, hyp_ann {ENTITY}")
    x = graphs.overlap(df, "id").first()
    assert (x.ent_p, x.ent_r, x.rel_p, x.rel_r, x.miss_rel, x.extra_rel) == (1.0, 1.0, 1.0, 0.5, 1, 0)
