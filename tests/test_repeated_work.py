"""Plans in which no text is cut, matched or generated again for each use of what came of it."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reportloom.functions import sets, similarity
from reportloom.functions import text as T
from reportloom.operators import augment, evaluate, gates, manifests
from reportloom.plans import queries
from reportloom.sources import images


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    texts = ["The left lung is clear. No mild edema is seen here.\nStable, with no change of the heart.", "- one right\n- two\nof the base", "", "Male patient. Short"]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts * 3)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bank_makes_attempts_once(spark):
    """F3."""
    rows = spark.range(3).select(F.col("id").alias("study_id"), F.lit("A b. C d.").alias("ref_findings"), F.concat(F.lit("E f. G "), "id").alias("ref_impression"))
    bank, reasons = augment.structural_bank(rows)
    assert plan(bank).count("regexp_replace") < 120
    made = augment.change_attempts(rows.select("study_id", F.col("ref_findings").alias("findings"), F.col("ref_impression").alias("impression")), 5)
    one = made.select(*[F.col("attempts")[k].ai == augment.change("impression", augment.attempt_key(F.col("study_id"), k) + 1) for k in range(5)])
    assert all(all(r) for r in one.collect())
    assert sum(r.n for r in reasons.collect()) + 5 * bank.count() >= 5  # each study's attempts pass or are counted


@pytest.mark.parametrize(
    ("name", "what", "most"),
    [("g9_gates_in_two_stages", "RLIKE", 0), ("p5_paraphrase_candidates_x2_l7", "MapInPandas", 1), ("p5_paraphrase_candidates_x2_l7", "regexp_replace", 80), ("t16_structural_changes", "regexp_replace", 50), ("t10_bullets_t13", "regexp_replace", 25), ("a19_sentence_multiset", "regexp_replace", 16)],
)
def test_queries_repeat_nothing(spark, tables, name, what, most):
    """F5, F6, F7, F17, F18, F21."""
    assert plan(queries.queries()[name](spark, tables)).count(what) <= most


def test_sex_is_matched_once(spark):
    """F10, F14, F19."""
    df = spark.createDataFrame([("old woman", "male"), ("___ F", "lady"), (None, "")], "a string, b string")
    got = df.select(manifests.patient_sex({"a": "a", "b": "b"}).alias("s"))
    assert plan(got.select("s.*")).count("regexp_extract_all") == 6
    assert [tuple(r.s) for r in got.collect()] == [("unknown", "unknown", "conflict", "a=woman; b=male", "conflict"), ("F", "female", "a", "___ F", "ok"), ("unknown", "unknown", "", "", "not_found")]


def test_diffs_come_in_small_batches(spark):
    """F13."""
    df = spark.createDataFrame([("a\nb", "a\nc"), (None, None)], "a string, b string").select(similarity.shown_diff(F.col("a"), F.col("b")).alias("d"))
    assert "ArrowEvalPython" not in plan(df)
    assert [r.d for r in df.collect()] == ["--- before\n+++ after\n@@ -1,2 +1,2 @@\n a\n-b\n+c", ""]


def test_ratio_is_difflibs():
    """F8."""
    r = random.Random(5)
    for k in range(3000):
        letters = r.choice(["ab", "abcdefgh ", "eeeeeeeeeeeettttttaaaaoooinshr QXZ.,!", "é😀b" + "".join(map(chr, range(0x4E00, 0x4F00)))])
        draw = lambda n: "".join(r.choices(letters, k=r.randrange(n)))
        a, cut = draw(r.choice([9, 150, 500])), r.randrange(1, 200)
        b = [draw(300), a + draw(20), a[cut:] + a[:cut], draw(9) + a[:cut] + draw(9) + a[cut:]][k % 4]
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_ratio_doesnt_visit_pairs():
    """F8: half of all pairs of characters are equal here, 20 million."""
    began = time.process_time()
    assert similarity.ratio("ab" * 100_000, "ba" * 99) == 2 * 198 / 200_198
    assert similarity.ratio("xy" * 100_000 + "Q", "xy" * 100_000 + "R") == 2 * 200_000 / 400_002
    assert time.process_time() - began < 1


def test_common_subsequences_have_no_table():
    """a row of the table is one number; the places are those that the table gave."""
    a, b = [str(k % 97) for k in range(3000)], [str(k % 89) for k in range(3000)]
    began = time.process_time()
    assert len(similarity.lcs_places(a, b)) == similarity.lcs(a, b)
    assert time.process_time() - began < 1
    assert similarity.lcs_places(list("abcab"), list("cbab")) == {1, 3, 4} and similarity.lcs_places(list("ab"), list("ba")) == {0}


def test_bleu_counts_in_one_pass(spark):
    """n-grams are counted without arrays of their texts."""
    df = spark.createDataFrame([("the the cat. sat", "the cat. sat on"), ("", None), (None, "a"), ("a b a b a b", "a b a b")], "p string, r string")
    got = df.select(evaluate._bleu_counts("p", "r").alias("b"))
    assert "transform" not in plan(got)
    assert [tuple(x.b) for x in got.collect()] == [(5, 5, 5, 4, 4, 3, 3, 2, 2, 1), (0,) * 10, (0, 1, *[0] * 8), (6, 4, 6, 4, 5, 3, 4, 2, 3, 1)]


def test_suite_makes_what_is_asked_for(spark):
    """F15."""
    rows = [(1, "a b c d e impression: b", "a b c d e", "b"), (2, "x y impression: z w", "x y", "z")]
    df = evaluate.predictions(spark.createDataFrame(rows, "study_id long, raw_pred string, ref_findings string, ref_impression string"))
    some, whole = evaluate.suite(df, None, ("full",), ("n", "bleu")), evaluate.suite(df)
    assert plan(some).count("split(") == 2 and "_rouge" not in plan(some)
    assert some.collect() == whole.where("view = 'full' AND metric IN ('n', 'bleu')").collect()


def test_shares_of_tokens_without_arrays_of_grams(spark):
    """The same numbers as of arrays of four-grams, which aren't made."""
    r = random.Random(2)
    draw = lambda: "".join(r.choices("aB\\S1 \t\x01\x0b\x85é😀\u3000.", k=r.randrange(40)))
    pairs = [(x, r.choice([draw(), x + draw(), draw() + x, x.lower()])) for x in (draw() for _ in range(400))] + [(None, "a"), ("a b c", None), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for strict in (True, False):
        a, b = T.tokens("a", strict), T.tokens("b", strict)
        sa = F.array_distinct(a)
        wanted = sets.jaccard(T.ngrams(a), T.ngrams(b)).alias("o"), (1.0 - F.size(F.array_intersect(sa, F.array_distinct(b))).cast("double") / F.greatest(F.lit(1), F.size(sa))).alias("c")
        got = gates.changed_enough(F.col("a"), F.col("b"), F.lit(0.0), strict_tokens=strict)
        assert "array_intersect" not in plan(df.select(got))
        assert all((x.g.overlap4, x.g.changed_frac) == (x.o, x.c) for x in df.select(got.alias("g"), *wanted).collect())


def test_squares_are_handed_on_in_parts(spark):
    """a worker holds the squares of a few images, not those of its whole batch."""
    df = spark.range(0, 300, 1, 1).select("id", F.lit(2).alias("rows"), F.lit(3).alias("columns"), F.when(F.col("id") % 9 > 0, F.unhex(F.lit("000102030405"))).alias("pixels"))

    class Caught:
        schema, sparkSession = df.schema, spark  # noqa: N815

        def mapInPandas(self, run, _):  # noqa: N802
            return run

    parts = list(images.squared(Caught(), 356)(iter([df.toPandas()])))
    assert max(map(len, parts)) * 356 * 356 * 8 <= 16 << 20
    assert [x for p in parts for x in p["id"]] == list(range(300)) and all((x is None) == (k % 9 == 0) for p in parts for k, x in zip(p["id"], p["square"], strict=True))
    whole = {r.id: r.square for r in images.squared(df, 356).collect()}
    assert all(whole[k] == x for p in parts for k, x in zip(p["id"], p["square"], strict=True))
