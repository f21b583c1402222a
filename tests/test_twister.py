"""Draws of the Mersenne Twister over columns against Python's own, and what is made of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.functions import twister
from reportloom.functions.sets import ENTITY
from reportloom.operators import augment


def test_equal_to_python():
    r = random.Random(4)
    seeds = [*range(300), *(r.randrange(1 << 31) for _ in range(5000)), *(r.randrange(1 << 62) for _ in range(5000)), -5, 1 << 32, (1 << 32) - 1]
    t, who, own = twister.Twister(np.array(seeds)), np.arange(len(seeds)), [random.Random(x) for x in seeds]
    assert t.random(who).tolist() == [x.random() for x in own]
    n = np.array([r.randrange(1, 1000) for _ in seeds])
    assert t.below(n, who).tolist() == [x.randrange(k) for x, k in zip(own, n.tolist(), strict=True)]
    sizes = np.array([r.randrange(12) for _ in seeds])
    for x, k, got in zip(own, sizes.tolist(), t.shuffle(sizes, who), strict=True):
        want = list(range(k))
        x.shuffle(want)
        assert got.tolist() == want
    few = who[::97]  # some go on beyond one state, the others stay
    for _ in range(400):
        last = t.random(few)
    assert last.tolist() == [[own[i].random() for _ in range(400)][-1] for i in few]
    assert t.random(who).tolist() == [x.random() for x in own]
    assert t.below(np.zeros(3, int), who[:3]).tolist() == [0, 0, 0] and twister.Twister(np.array([], int)).random(np.arange(0)).tolist() == []


def test_coin_and_choice(spark):
    df = spark.range(500).select("id", (F.col("id") % 4).alias("n"))
    for r in df.select("id", "n", twister.coin_and_choice(F.col("id") + 7 * 1_000_003, F.col("n")).alias("d")).collect():
        own = random.Random(7 * 1_000_003 + r.id)
        assert r.d.u == own.random() and r.d.pick == (own.randrange(r.n) if r.n else 0)


def test_plans(spark):
    """All turns of a study in one sequence; a change that works ends its turn before mixing draws."""
    r = random.Random(6)
    rows = [(k, *(x for _ in range(2) for x in (r.random() < 0.9, r.choice((0, 2, 3, 7)), [r.random() < 0.3 for _ in range(3)]))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a boolean, b int, c array<boolean>, d boolean, e int, f array<boolean>").repartition(3)
    plans = twister.change_plans(F.col("id") + 42, [tuple(F.col(x) for x in "abc"), tuple(F.col(x) for x in "def")], 3, 4, 0.35, 3)
    for row in df.select("*", plans.alias("p")).collect():
        own, want = random.Random(42 + row.id), []
        for _ in range(3):
            for there, n, works in ((row.a, row.b, row.c), (row.d, row.e, row.f)):
                order, plan = [0, 1, 2, 3], (None, None, None)
                if not there:
                    want.append(([], *plan))
                    continue
                own.shuffle(order)
                for k in order:
                    if k == 0 and n:
                        places = list(range(n))
                        own.shuffle(places)
                        plan = (places, own.random() < 0.35, own.randint(0, 2))
                    elif k and works[k - 1]:
                        break
                want.append((order, *plan))
        assert [tuple(x) for x in row.p] == want


def test_sequential_attempts(spark):
    """Texts of which each change is plain: what is made of the draws, end to end."""
    texts = {1: "One here. Two there. Three now.", 2: "- a\n- b", 3: "a , b .", 4: "same"}
    df = spark.createDataFrame([(k, t, "x , y") for k, t in texts.items()], "study_id long, findings string, impression string")
    got = {r.study_id: r.attempts for r in augment.change_attempts(df, 6, draws="sequential").collect()}
    own = random.Random(42 + 1)
    orders, parts = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)], ("One here.", "Two there.", "Three now.")
    joined = [T.keep_newlines(T.join_sentences(F.array(*[F.lit(parts[i]) for i in o]), style, True)) for style in range(4) for o in orders]
    made = spark.range(1).select(F.array(*joined)).first()[0]
    styles = [made[6 * k : 6 * k + 6] for k in range(4)]
    for turn in got[1]:
        order = [0, 1, 2, 3]
        own.shuffle(order)
        want = None
        for k in order:
            if k == 0 and want is None:
                places = [0, 1, 2]
                own.shuffle(places)
                merges = own.random() < 0.35
                new = styles[own.randint(0, 2)][orders.index(tuple(places))]
                want = "merged" if merges else new if new != texts[1] else None
            elif k == 2 and want is None:
                want = styles[3][0]
        assert want == "merged" or turn.af == (want or texts[1])
        own.shuffle([0, 1, 2, 3])  # the impression's turn: only its points change
        assert turn.ai == "x, y"
    assert all(sorted(x.af.replace(".", " ").replace(";", " ").replace("-", " ").split()) == ["a", "b"] for x in got[2])
    assert {x.af for x in got[3]} == {"a, b."} and {x.af for x in got[4]} == {"same"}
    with pytest.raises(ValueError, match="portable or sequential"):
        augment.change_attempts(df, draws="other")


def test_training_view(spark):
    df = spark.createDataFrame([(k, "f", "i", "x") for k in range(60)], "study_id long, ref_findings string, ref_impression string, indication string")
    alts = df.select(F.col("study_id").cast("string").alias("study_key"), F.array(F.lit("alt a"), F.lit("alt b"), F.lit("alt c")).alias("alts"))
    for r in augment.training_view(df, alts, 0.4, seed=3, draws="sequential").collect():
        own = random.Random(3 * 1_000_003 + r.study_id)
        used = own.random() <= 0.4
        assert r.used_aug == used and (not used or r.target == f"alt {'abc'[own.randrange(3)]} END_REPORT")


def test_bank_with_an_annotator(spark):
    """Of the attempts whose entities agree the one of the highest score is taken, and the others are counted."""
    df = spark.createDataFrame([(k, "Left lung clear. Heart fine. Bones fine.", "Normal. Stable.") for k in range(8)], "study_id long, ref_findings string, ref_impression string")

    def annotator(rows):
        """An entity a line of the text; attempts that begin with Bones have one more than agreement allows."""

        def ann(*names):
            return F.map_from_entries(F.array(*[F.struct(n.alias("k"), F.struct(F.array(n).alias("tokens"), F.lit("A").alias("label"), F.array().cast("array<array<string>>").alias("relations"))) for n in names])).cast(ENTITY)

        lung, more = F.lit("lung"), ann(F.lit("lung"), F.lit("b1"), F.lit("b2"))
        return rows.select("_row", ann(lung).alias("ref_ann"), F.when(F.startswith(F.ltrim(F.regexp_replace("cand", "^- ", "")), F.lit("Bones")), more).otherwise(ann(lung)).alias("hyp_ann"))

    for draws in ("portable", "sequential"):
        bank, reasons = augment.structural_bank(df, draws=draws, annotator=annotator)
        rows, why = bank.collect(), {r.reason: r.n for r in reasons.collect()}
        assert rows and all(not r.aug_full.removeprefix("- ").startswith("Bones") and (r.rg_ent_p, r.rg_rel_r) == (1.0, 1.0) for r in rows)
        assert sum(n for k, n in why.items() if k.startswith("rg_")) > 0
