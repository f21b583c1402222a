"""Report operators: hand-written expectations, brute force and invariants."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reportloom import config
from reportloom.functions import sections, sets, similarity
from reportloom.functions import text as T
from reportloom.operators import augment, candidates, cohort, evaluate, gates, manifests, select
from reportloom.plans import queries
from reportloom.sources import io
from reportloom.streaming import resume


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def on(spark, f, text):
    return one(spark, f(F.col("t")), t=text)


@pytest.mark.parametrize(
    "f,text,want",
    [
        (T.one_line, "  a  b\r\n c\x1c ", "a b c"),
        (T.one_line, None, ""),
        (T.keep_newlines, " a\t b\r\rc\n\n\n\nd​ ", "a b\n\nc\n\nd"),
        (T.literal_one_line, "a\\nb\\rc", "a b c"),
        (T.compact_lines, "a：：b；c。\\\n\n\nd，", "a:b:c.\nd,"),
        (T.generation_form, "a\r\nb", "a b"),
        (T.augmented_target, "a\n\n\nb", "a\nb"),
        (T.entity_form, "- a; b\n2) c", "a. b. c"),
        (T.scorer_form, "One two. X. Three four!", "One two.. Three four!"),
        (T.scorer_form, "word", "word word."),
        (T.scorer_form, " ", "no findings."),
        (T.unescaped, "a\\.b\\c", "a.b c"),
        (T.strip_special, "a <unused12> b <|x|> ```c``` d", "a b d"),
        (T.artifact_name, "._a b/c_.", "a_b_c"),
    ],
)
def test_forms(spark, f, text, want):
    assert on(spark, f, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        ("One. Two? three. 4 is.", ["One.", "Two? three.", "4 is."]),
        ("- a\n* b\n• c\n1. d\n2) e\nplain", ["a", "b", "c", "d", "e", "plain"]),
        ("size 2.5 cm. Next", ["size 2.5 cm.", "Next"]),
        ("a\nb", ["a", "b"]),
    ],
)
def test_sentences(spark, text, want):
    assert on(spark, T.sentences, text) == want


def test_sentence_functions(spark):
    parts = F.array(*[F.lit(x) for x in ("One.", "Two!", "three")])
    assert [one(spark, T.join_sentences(parts, k)) for k in range(4)] == ["One. Two! three", "One. Two! three.", "One; Two!; three.", "- One\n- Two!\n- three"]
    assert on(spark, T.paragraph_to_bullets, "A. B.") == "- A\n- B" and on(spark, T.bullets_to_paragraph, "- a\n- b.") == "a. b."
    assert one(spark, T.can_shuffle(parts)) and not one(spark, T.can_shuffle(F.array(F.lit("a"), F.lit("Compared to prior"))))
    long = "x" * 40
    assert one(spark, T.merge_short(F.array(*[F.lit(v) for v in ("a.", long, long, "b", "c")]))) == [f"a; {long}", f"{long}; b", "c"]
    assert not one(spark, T.sentences_changed(F.lit("A. B."), F.lit("- b\n- a"))) and one(spark, T.sentences_changed(F.lit("A. B."), F.lit("A.")))


def test_targets(spark):
    t = lambda f, i: one(spark, T.sectioned_target(F.lit(f), F.lit(i)))
    assert (t("a", "b"), t("", "b"), t("a", ""), t("", "")) == ("a impression: b", "impression: b", "a", "")
    assert t("- a\n- b", "- c") == "- a\n- b\nimpression:\n- c"
    assert one(spark, T.prompt(F.lit(" "))) == "<start_of_image> findings:" and one(spark, T.prompt(F.lit("a  b"))) == "<start_of_image> a b findings:"
    assert one(spark, T.target(F.lit("a"), F.lit("b"), "Findings_Only")) == "a END_REPORT"
    with pytest.raises(ValueError, match="unknown target format"):
        T.target_format("x")


REPORT = "FINAL REPORT\nINDICATION:\nHISTORY: old\nFINDINGS: clear\nnote: x\nmore note: y\nIMPRESSION:\n  fine \n"


def test_sections(spark):
    s = {k: on(spark, lambda c, k=k: sections.sections(c)[k], REPORT) for k in sections.SECTIONS}
    assert s == {"indication": "", "findings": "clear", "impression": "fine"}
    assert on(spark, lambda c: sections.section(c, ("HISTORY", "FINDINGS")), "FINDINGS: a\nHISTORY: b") == "b"


@pytest.mark.parametrize("text,want", [("/ | a Impression : b impression: c", ("a", "b impression: c")), ("a", ("a", "")), (None, ("", "")), ("Impression:", ("", ""))])
def test_split_prediction(spark, text, want):
    assert tuple(on(spark, lambda c, k=k: sections.split_prediction(c)[k], text) for k in (0, 1)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("ok\nFINDINGS: - lungs clear\nIMPRESION: no change\nmore", ("lungs clear", "no change")),
        ("<think>FINDINGS: x</think>Findings. abc Impression_Final - def findings: ghi", ("abc", "def")),
        ("FINDINGS: ab IMPRESSION: cd", ("", "")),
        ("nothing", ("", "")),
        ("IMPROVEMENT FINDINGS: abcd IMPRESSIONS; efgh <unused9>", ("abcd", "efgh")),
    ],
)
def test_parse_two_lines(spark, text, want):
    assert tuple(on(spark, lambda c, k=k: sections.parse_two_lines(c)[k], text) for k in (0, 1)) == want


def test_similarity(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "bb", "ccc"]) for _ in range(r.randrange(120))) for _ in range(20)]
    rows = spark.createDataFrame([(x, y) for x in texts[:5] for y in texts], "a string, b string")
    for x in similarity.with_sequence_ratio(rows, "a", "b", "r").collect():
        assert x.r == SequenceMatcher(None, x.a, x.b).ratio()

    def slow(words, n_max=5):
        best, gram = 1, ""
        for n in range(1, n_max + 1):
            for i in range(len(words) - n + 1):
                g, k = words[i : i + n], 1
                while words[i + k * n : i + (k + 1) * n] == g:
                    k += 1
                if k > best:
                    best, gram = k, " ".join(g)
        return best, gram

    for _ in range(300):
        w = [r.choice("abc") for _ in range(r.randrange(30))]
        assert similarity.most_repeated(" ".join(w)) == slow(w)
        a, b = [r.choice("abc") for _ in range(r.randrange(12))], [r.choice("abc") for _ in range(r.randrange(12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs(a, b) == table[-1][-1]


def test_gates(spark):
    def judge(gate, src, cand):
        return one(spark, gate(F.col("s"), F.col("c")), s=src, c=cand)

    flips = {("left mass", "right mass"): (False, "laterality_mismatch"), ("left and right", "left"): (True, "laterality_warning"), ("bilateral, left", "none"): (True, "laterality_warning"), ("mild x", "severe x"): (True, "severity_mismatch"), ("lt lung", "LEFT lung"): (True, "ok"), ("éleft", "x"): (True, "ok")}
    for (s, c), want in flips.items():
        g = judge(gates.sides_kept, s, c)
        assert (g.ok, g.reason) == want
    assert not judge(gates.same_words, "mild left", "left").ok and judge(gates.same_words, "Mild left", "left MILD").ok
    forms = {"": "empty_candidate", "a": "bad_impression_marker_count", "a impression: b": "ok", "a impression: impression:": "bad_impression_marker_count", "findings: a impression: b": "artifact_or_nested_header", "hemothorax impression: b": "unsupported_new_term", "impression:x": "too_short", "a impression: " + "b" * 60: "too_long"}
    for c, want in forms.items():
        assert judge(gates.well_formed, "a long text impression: b", c).reason == want
    assert one(spark, gates.ascii_only(F.lit("aßéß"))).bad_chars == "ßé"
    for s, want in ((float("nan"), True), (None, True), (0.75, True), (0.985, True), (0.99, False)):
        assert one(spark, gates.similar(F.lit(s).cast("double"))).ok is want
    stats = {k: F.lit(v) for k, v in {"ent_p": 1.0, "ent_r": 1.0, "rel_p": 1.0, "rel_r": 1.0, "extra_ent": 1, "miss_ent": 0, "extra_rel": 0, "miss_rel": 0}.items()}
    assert one(spark, gates.entities_kept(stats)).ok and one(spark, gates.entities_kept(stats, gates.Limits(entity_mode="strict"))).reason == "extra_entities"
    assert one(spark, gates.candidate_score(stats)) == -20.0
    g = one(spark, gates.changed_enough(F.lit("a b c d e"), F.lit("a b c d e"), F.lit(0.5)))
    assert (g.reason, g.overlap4, g.changed_frac) == ("4gram_overlap_high", 1.0, 0.0)


def test_staged_gates(spark):
    seen = []
    rows = spark.createDataFrame([(1, "left lung", "right lung"), (2, "the left lung is clear today", "clear left side of chest")], "row_id int, src_full string, cand_full string")

    def scorer(x):
        seen.append([r.row_id for r in x.collect()])
        return x.withColumn("chex", F.struct(F.lit(True).alias("ok"), F.lit("ok").alias("reason")))

    out = {r.row_id: r for r in gates.evaluate(rows, {"chex": scorer}, enabled=frozenset({"quick", "lex", "ascii", "chex"})).collect()}
    assert seen == [[2]] and not out[1].keep_ok and out[1].chex_reason == "skipped_after_cheap_fail" and out[2].keep_ok and out[2].rg_reason == "skipped_by_config"
    again = gates.reapply(rows, enabled=frozenset({"quick", "lex"}))
    assert [r.keep_ok for r in again.collect()] == [False, False]


def test_selection(spark):
    rows = [("a", 0, None, True), ("a", 1, float("nan"), True), ("a", 2, -3.0, True), ("b", 0, 0.5, True), ("b", 1, 0.5, True), ("c", 0, 0.9, False), ("d", 1, None, True), ("d", 0, None, True)]
    df = spark.createDataFrame(rows, "ex_id string, cand_id int, msl_sim double, keep_ok boolean")
    assert {(r.ex_id, r.cand_id) for r in select.best_candidates(df).collect()} == {("a", 2), ("b", 0), ("d", 0)}
    assert {(r.ex_id, r.cand_id) for r in select.best_passing(df, "ex_id", "msl_sim", "cand_id", "keep_ok").collect()} == {("a", 0), ("b", 0), ("d", 0)}
    ids = spark.createDataFrame([("123",), ("123.0",), (" 7 ",), (None,)], "i string")
    assert [r.x for r in ids.select(select.id_text(F.col("i")).alias("x")).collect()] == ["123", "123", "7", ""]
    shards = {k: df.where(F.col("cand_id") == k) for k in range(3)}
    assert select.merge_shards({str(k): v for k, v in shards.items()}, "ex_id", "cand_id").count() == 4
    with pytest.raises(ValueError, match="missing shards"):
        select.union_all({"0": df, "1": None})
    with pytest.raises(Exception, match="no such id"):
        select.by_id_list(df, spark.createDataFrame([("zz", 0)], "ex_id string, rank int"), "ex_id").collect()
    assert select.sample(df, -1, "cand_id").count() == 8


def test_sex_and_prompts(spark):
    def sex(*texts):
        return one(spark, manifests.patient_sex({f"f{k}": F.lit(t) for k, t in enumerate(texts)}))

    assert sex("___F with", "")[:3] == ("F", "female", "f0") and sex("x", "___ M y").evidence == "___ M"
    assert sex("woman", "man").status == "conflict" and sex("woman", "man").evidence == "f0=woman; f1=man" and sex("human").status == "not_found"
    with pytest.raises(Exception, match="no phrase"):
        one(spark, manifests.view_phrase(F.lit("LL")))
    with pytest.raises(ValueError, match="unknown kind"):
        manifests.chosen_score("x")
    assert one(spark, manifests.candidate_path(F.lit("12345.0"), F.lit(9), F.lit(3), F.lit(77))) == "p12/p12345/s9/cand_03_seed77.png"


def test_sets(spark):
    a = '{"0": {"x": {"entities": {"1": {"tokens": "Left Lung.", "label": "A", "relations": [["at", "2"], ["at", "9"], ["bad"]]}, "2": {"tokens": ["clear"], "label": "B", "relations": []}}}}}'
    ann = sets.annotation(F.lit(a))
    assert {(tuple(x.tokens), x.label) for x in one(spark, sets.entities(ann))} == {(("left", "lung"), "A"), (("clear",), "B")}
    assert len(one(spark, sets.relations(ann))) == 1 and one(spark, sets.entities(sets.annotation(F.lit("{}")))) == []
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    pr = lambda r, h: tuple(one(spark, x) for x in sets.overlap(r, h))
    assert (pr(none, none), pr(some, none), pr(none, some), pr(some, some)) == ((1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0))
    assert one(spark, sets.class_label(F.array(*map(F.lit, (0.1, 0.2, 0.2, 0.9))), "classification")) == -1


def test_structural_changes(spark):
    t = spark.createDataFrame([(k, x) for k, x in enumerate(["A b. C d. E f.", "- a\n- b", "a , b .", "", None, "One here. Two there. Three now."])], "k long, t string")
    every = t.crossJoin(spark.range(40).withColumnRenamed("id", "draw"))
    got = {}
    for r in every.select("k", augment.change("t", F.col("k") * 64 + F.col("draw")).alias("new")).collect():
        got.setdefault(r.k, set()).add(r.new)
    assert "a. b." in got[1] and got[2] == {"a, b."} and got[3] == got[4] == {""}
    assert got[5] >= {"- One here\n- Two there\n- Three now"} and len(got[5]) > 6
    words = lambda x: sorted(x.replace("-", " ").replace(".", " ").replace(";", " ").lower().split())
    assert all(words(x) == words("One here. Two there. Three now.") for x in got[5])


def test_shuffled_sentences(spark):
    t = "One. Two. Three. Four."
    got = {one(spark, augment.shuffled_sentences(F.lit(t), F.lit(k))) for k in range(6)}
    assert len(got) > 2 and all(sorted(x.split()) == sorted(t.split()) for x in got)
    assert one(spark, augment.shuffled_sentences(F.lit("One. Two as before."), F.lit(1))) == "One. Two as before."


def test_augmentation(spark):
    df = spark.createDataFrame([(1, "Left lung clear. Heart fine. Bones fine.", "Normal. Stable."), (2, "", "x"), (3, "same", "same")], "study_id long, ref_findings string, ref_impression string")
    bank, reasons = augment.structural_bank(df)
    assert [r.study_id for r in bank.collect()] == ["1"] and {r.reason: r.n for r in reasons.collect()} == {"identical": 5, "empty_ref": 1}
    alts = augment.structural_map(bank.withColumn("ord", F.lit(0)))
    view = augment.training_view(df.withColumn("indication", F.lit("")), alts, 1.0).orderBy("study_id").collect()
    assert [r.used_aug for r in view] == [True, False, False] and view[1].target == "impression: x END_REPORT" and all(r.target.endswith(" END_REPORT") for r in view)
    assert not any(r.used_aug for r in augment.training_view(df.withColumn("indication", F.lit("")), alts, 1.0, is_train=False).collect())


def test_cohort(spark):
    rec = spark.createDataFrame([(1, 10, "a", "p"), (1, 10, "b", "p"), (2, 20, "c", "p"), (2, 21, "d", "p")], io.RECORDS)
    spl = spark.createDataFrame([(x, "train") for x in "abcd"], io.SPLITS)
    met = spark.createDataFrame([("a", "LL"), ("b", "PA"), ("c", "AP")], io.METADATA)
    assert {r.dicom_id for r in cohort.cohort(rec, spl, met).collect()} == {"b", "c"}
    df = spark.createDataFrame([(1, "train", "f", "i"), (2, "test", "f", ""), (3, "validate", None, "i")], "study_id int, split string, ref_findings string, ref_impression string")
    b = cohort.builders.get("Baseline")(df)
    assert {r.split: r.n for r in b.summary().collect()} == {"train": 1, "valid": 1, "test": 0} and b.split("val").count() == 1
    for bad in (lambda: b.split("x"), lambda: cohort.image_augmented(df, "none"), lambda: cohort.text_augmented(df, df.where("false")), lambda: cohort.jointly_augmented(df, df, "strong"), lambda: cohort.from_manifest(df, df.where("false"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        cohort.builders.get("zz")


def test_config():
    cfg = {"data": {"a": "none", "b": 3, "n": "x, y,"}, "experiment": {"data": {"a": 5, "b": 4}}}
    assert (config.resolve(cfg, "a"), config.resolve(cfg, "b"), config.resolve(cfg, "c", 9), config.names(cfg, "n", [])) == (5, 3, 9, ["x", "y"])
    assert config.resolve({"data": {"a": "none"}}, "a", 5) == 5 and config.as_int({"data": {"a": ""}, "experiment": {"data": {}}}, "a", 5) == 5
    assert config.resolve({"data": {"a": "none"}, "experiment": {"data": {"a": None}}}, "a", 5) == "none" and config.resolve({}, "a", 5) == 5
    assert config.image_recipe("none") is None and config.image_recipe("strong")["rotate"] == 8 and config.image_recipe("geo")["rotate"] == 3
    with pytest.raises(ValueError):
        config.image_recipe("zz")
    assert config.shard_ids("all", 3) == [0, 1, 2] and config.shard_ids("0, 2", 3) == [0, 2] and config.as_bool({"data": {"k": "Yes"}}, "k", False)
    with pytest.raises(ValueError):
        config.manifest_paths("out", "...")


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "/ Impression: a b c d", "x", "a b c d"), (2, "and f f f f f at 3:45 pm " + "_" * 30, "y", ""), (3, "", "", "")], "study_id long, raw_pred string, ref_findings string, ref_impression string")
    p = evaluate.predictions(df)
    f = {r.study_id: r for r in evaluate.pathology(p).collect()}
    assert f["1"].raw_starts_slash and f["1"].raw_starts_impression and f["1"].findings_empty and f["1"].impression_marker_count == 1
    assert f["2"].raw_starts_and and f["2"].repeat_count == 5 and f["2"].repeat_gram == "f" and f["2"].long_punct_run and f["2"].time_like_count == 1
    assert evaluate.pathology_summary(evaluate.pathology(p.where("false"))).first().n == 0
    assert evaluate.bleu(p.select(F.lit("a b c d e").alias("p"), F.lit("a b c d e").alias("r")), "p", "r").first().score == pytest.approx(100)
    assert evaluate.rouge(spark.createDataFrame([("a b c", "a c d")], "p string, r string"), "p", "r").first()[0] == pytest.approx(2 / 3)
    mixed = spark.createDataFrame([(k, f"the cat {k} sat, on 1,000.5 mats-and (a) 5-6", f"the cat {k % 7} sat. on 1,000.5 mats and a 5-6") for k in range(60)], "k int, p string, r string")
    plain = evaluate.bleu(mixed, "p", "r").first()
    assert evaluate.bleu(mixed.repartition(7, "r").distinct(), "p", "r").first() == plain and 0 < plain.score < 100
    assert evaluate.bleu(mixed.where("false"), "p", "r").first().score == 0.0
    assert one(spark, T.tokens_13a(F.lit("Hi, it&apos;s 1,000.5-x (ok). &amp;\nEnd-\ned <skipped>"))) == ["Hi", ",", "it", "&", "apos", ";", "s", "1,000.5", "-", "x", "(", "ok", ")", ".", "&", "Ended"]
    v = spark.range(50).withColumn("x", (F.col("id") % 7).cast("double"))
    b = evaluate.bootstrap(v, "x", 100).first()
    assert b.ci_low <= b.mean <= b.ci_high and b.n == 50
    assert tuple(evaluate.bootstrap(v.where("false"), "x", 10).first()) == (0.0, 0.0, 0.0, 0)


def test_candidates_resume(spark, tmp_path):
    df = spark.createDataFrame([(k, f"The lung of study {k} is clear and fine", f"No change of the heart {k}") for k in range(6)], "study_id long, ref_findings string, ref_impression string")

    def broken():
        def run(prompts):
            if len(prompts) > 1 or "study 3" in prompts[0]:
                raise RuntimeError("no")
            return candidates.rule_generator(2)(prompts)

        return run

    got = candidates.candidates(df, broken, {}).collect()
    assert {r.ex_id for r in got if r.cand_id == -1} == {"3"} and sum(r.cand_id >= 0 for r in got) == 10 and all(r.filter_error is None or not r.keep_ok for r in got)
    out = str(tmp_path / "out")
    work = lambda x: candidates.candidates(x, candidates.rule_generator, {}).select("ex_id", "cand_id", "keep_ok")
    keyed = df.withColumn("ex_id", F.col("study_id").cast("string"))
    resume.resume(keyed.where("study_id < 2"), out, "ex_id", work)
    whole = {tuple(r) for r in resume.resume(keyed, out, "ex_id", work).collect()}
    assert whole == {tuple(r) for r in work(keyed).collect()}
    with pytest.raises(ValueError):
        resume.resume(keyed, out, "ex_id", work, restart=True)


def test_sources(spark, tmp_path):
    root = tmp_path / "files" / "p12" / "p123"
    root.mkdir(parents=True)
    (root / "s9.txt").write_bytes(b"FINDINGS: ok \xff here\nIMPRESSION: fine\n")
    df = spark.createDataFrame([(123, 9, "a"), (123, 8, "b")], "subject_id long, study_id long, dicom_id string")
    got = {r.study_id: (r.ref_findings, r.ref_impression) for r in io.with_sections(df, str(tmp_path / "files")).collect()}
    assert got == {9: ("ok here", "fine"), 8: ("", "")}
    assert io.read_csv(spark, str(tmp_path / "none.csv"), io.SPLITS).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert io.read_csv(spark, str(tmp_path / "empty.csv"), io.SPLITS).count() == 0
    (tmp_path / "order.csv").write_text("extra,split,study_id,dicom_id\nx,train,50.0,d1\ny,test,zz,d2\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "order.csv"), io.SPLITS).orderBy("dicom_id").collect()] == [("d1", "train"), ("d2", "test")]
    assert [r.study_id for r in io.read_csv(spark, str(tmp_path / "order.csv"), "dicom_id string, study_id long").orderBy("dicom_id").collect()] == [50, None]
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "order.csv"), io.METADATA)
    raw = "\ue000a \ufffd \ue000".encode() + b"\xff\xc3 ok"
    assert one(spark, io.valid_utf8(F.lit(bytearray(raw)))) == "\ue000a \ufffd \ue000 ok"
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "subject_id long, study_id long, dicom_id string").count() == 2
    select.write_shards(select.with_shard(df, 2), str(tmp_path / "s"))
    assert io.read_parts(spark, str(tmp_path / "s")).count() == 2
    paths = spark.createDataFrame([(str(root / "s9.txt"),), ("/none",)], "p string")
    assert io.existing(paths, "p", str(tmp_path / "files")).count() == 1
    assert io.fingerprints(spark, str(tmp_path / "files")).first().length == 37
    stream_in = str(tmp_path / "in")
    df.write.parquet(stream_in)
    for _ in range(2):
        resume.stream_new(spark, stream_in, "subject_id long, study_id long, dicom_id string", str(tmp_path / "so"), str(tmp_path / "cp"), lambda b: b)
    assert spark.read.parquet(str(tmp_path / "so")).count() == 2


def test_manifests(spark):
    cols = "study_id long, subject_id long, dicom_id string, split string, ViewPosition string, indication string, ref_findings string, ref_impression string"
    rows = [(k, k, f"d{k}", "train", "AP" if k % 2 else "pa", ["___ F", "man", ""][k % 3], "f", "i" if k != 4 else " ") for k in range(9)]
    e = manifests.eligible(spark.createDataFrame(rows, cols), seed=None).orderBy("study_id").collect()
    assert [r.study_id for r in e] == [0, 1, 3, 6, 7] and e[0].prompt == "Adult female. PA frontal chest radiograph. i"
    fixed = manifests.fixed_sources(spark.createDataFrame([(1, "AP", "woman, fine", "")], "study_id long, ViewPosition string, indication string, raw_impression string"))
    assert fixed.first().patient_sex == "F"
    with pytest.raises(ValueError):
        manifests.fixed_sources(spark.range(1))
    qc = spark.createDataFrame([(1, 0, True, float("nan")), (1, 1, True, 0.5), (2, 0, False, 0.9), (3, 0, True, None)], "study_id long, candidate_idx int, technical_ok boolean, sim double")
    j = {(r.study_id, r.candidate_idx): (r.all_filters_pass, r.reject_reason) for r in manifests.judged(qc).collect()}
    assert j == {(1, 0): (False, "below_threshold"), (1, 1): (True, ""), (2, 0): (False, "technical_failed"), (3, 0): (False, "below_threshold")}


def test_every_query_with_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) > 70


def test_whole_tables(spark, tmp_path):
    """Each source study has a row, on a table with ids beyond 200 and more than 500 studies."""
    n = 1300
    spark.range(n).selectExpr("id AS doc_id", "concat('a', id, chr(10), 'b') AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS vec_id", "CAST(id % 3 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = {k: queries.queries()[k](spark, str(tmp_path)).collect() for k in ("p1_cohort_build", "p8_selected", "p10_training_manifests", "p11_source_status")}
    assert {r.study_id for r in run["p1_cohort_build"]} == {k for k in range(n) if k % 3 < 2 and k % 11}
    passed = {k for k in range(n // 4) if any(v % 3 and v % 11 and v % 17 >= 5 for v in range(4 * k, 4 * k + 4))}
    assert {r.study_id for r in run["p8_selected"]} == passed and max(passed) > 200
    assert sorted(int(r.study_id) for r in run["p10_training_manifests"]) == sorted([*passed, *passed])
    status = {int(r.study_id): r.status for r in run["p11_source_status"]}
    assert len(run["p11_source_status"]) == n and status == {k: "accepted" if k in passed else "rejected_no_candidate_passed" if k < n // 4 else "not_attempted" for k in range(n)}


def test_stems():
    """The examples of the algorithm's paper, and the usual exceptions."""
    known = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic vileli vile vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic formative form electriciti electr goodness good revival reviv allowance allow airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun angulariti angular effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die news news".split()
    for word, want in zip(known[::2], known[1::2], strict=True):
        assert similarity.stem(word) == want, word


def test_rouge():
    assert similarity.rouge_of("the cats sat", "the cat sitting") == pytest.approx((2 / 3, 1 / 2, 2 / 3, 2 / 3))
    assert similarity.rouge_of("", "a b") == (0.0, 0.0, 0.0, 0.0) and similarity.rouge_of("a b", "a b") == (1.0, 1.0, 1.0, 1.0)
    # lines in another order: the whole texts share three words in order, the union of the lines all five
    assert similarity.rouge_of("d e\na b c", "a b c\nd e")[2:] == pytest.approx((3 / 5, 1.0))
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        assert len(similarity.lcs_places(a, b)) == (similarity.lcs(a, b) if a and b else 0)


def test_plugins(spark, tmp_path):
    import difflib
    import sys

    t = spark.createDataFrame([(1, "one two", b"ab"), (2, None, None)], "k long, t string, image binary")
    program = "import csv, sys; rows = list(csv.DictReader(open(sys.argv[1]))); w = csv.writer(open(sys.argv[2], 'w')); w.writerow(['words']); [w.writerow([len(r['text'].split())]) for r in rows]"
    assert {(r.k, r.words) for r in evaluate.labelled(t, lambda i, o: [sys.executable, "-c", program, i, o], "t", ["words"]).collect()} == {(1, 2.0), (2, 0.0)}
    with pytest.raises(Exception, match="labeler failed"):
        evaluate.labelled(t, lambda i, o: [sys.executable, "-c", "raise SystemExit(3)"], "t", ["words"]).collect()
    assert {r.k: r.image for r in augment.image_augmented(t, lambda recipe: lambda x: x + str(recipe["rotate"]).encode(), "strong").collect()} == {1: bytearray(b"ab8"), 2: None}
    assert augment.image_augmented(t, None, "none") is t
    a, b = "x\ny\nz", "x\nw\nz"
    assert one(spark, similarity.shown_diff(F.lit(a), F.lit(b))) == "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", lineterm=""))
    assert evaluate.suite(evaluate.predictions(spark.createDataFrame([(1, "a impression: b", "a", "b")], "study_id long, raw_pred string, ref_findings string, ref_impression string"))).where("view = 'findings' AND metric = 'rouge1'").first().value == 1.0


def test_entity_f1(spark):
    ann = lambda x: F.when(F.lit(x is not None), sets.annotation(F.lit(x or "{}")))
    full = '{"entities": {"1": {"tokens": ["lung"], "label": "A", "relations": [["at", "2"]]}, "2": {"tokens": ["clear"], "label": "B", "relations": []}}}'
    lone = '{"entities": {"1": {"tokens": ["lung"], "label": "A", "relations": []}, "2": {"tokens": ["clear"], "label": "B", "relations": []}}}'
    t = spark.range(1)
    row = evaluate.entity_f1(t.select(ann(full).alias("ref_ann"), ann(lone).alias("hyp_ann"))).first()
    assert (row.rg_e, row.rg_er, row.rg_bar_er) == (1.0, 0.5, 0.5)
    assert evaluate.entity_f1(t.select(ann(full).alias("ref_ann"), ann(None).alias("hyp_ann"))).first().rg_e == 0.0
    assert evaluate.entity_f1(t.where("false").select(ann(full).alias("ref_ann"), ann(full).alias("hyp_ann"))).first().n == 0


def test_ordinal_over_partitions(spark):
    t = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50))).repartition(7)
    got = [(r.ordinal, r.x, r.id) for r in select.ordinal(t, "x", "id").orderBy("ordinal").collect()]
    assert [n for n, *_ in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert select.ordinal(t.where("false"), "x").count() == 0


def test_cohort_from_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("path,dicom_id,subject_id,study_id\na.dcm,a,123,9\nb.dcm,b,123,8\nc.dcm,c,124,7\n")
    (tmp_path / "s.csv").write_text("study_id,dicom_id,split\n9,a,train\n8,b,test\n7,c,train\n")
    (tmp_path / "m.csv").write_text("dicom_id,Rows,ViewPosition\na,1,AP\nb,2,PA\nc,3,LL\n")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.dcm").write_bytes(b"x")
    root = tmp_path / "files" / "p12" / "p123"
    root.mkdir(parents=True)
    (root / "s9.txt").write_text("FINDINGS: ok\nIMPRESSION: fine\n")
    args = (spark, *(str(tmp_path / f) for f in ("r.csv", "s.csv", "m.csv", "files", "cache")), str(tmp_path / "img"))
    for _ in range(2):
        got = io.build_cohort(*args).collect()
        assert [(r.study_id, r.split, r.ViewPosition, r.ref_findings, r.ref_impression) for r in got] == [(9, "train", "AP", "ok", "fine")]
        (tmp_path / "r.csv").write_text("")  # the second time it comes from the cache


def test_strip_takes_all_white_space(spark):
    marks = spark.range(0x3100).where("id < 55296").select(F.expr("char(id % 256)").alias("_"), "id").collect()
    texts = [chr(r.id) + " a" + chr(r.id) + "b" + chr(r.id) for r in marks if r.id]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    assert t.where(T.strip(F.col("t")) != T.sub(F.col("t"), rf"^{T.WS}+|{T.WS}+\z", "")).count() == 0
