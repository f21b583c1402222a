"""Manifests of synthetic images: eligible sources, prompts, quality checks, selection, status, training tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import bind, generation_form, text
from reportloom.operators.gates import technical
from reportloom.operators.select import best_passing, first_per, head, id_text, ordinal, present, score, shuffled, truthy

# The words that tell a patient's sex.
MARKED = r"(?iU)(?<![A-Za-z0-9])_+\s*([MF])\b"
FEMALE = r"(?iU)\b(?:female|woman|women|lady|girl)\b"
MALE = r"(?iU)\b(?:male|man|men|gentleman|boy)\b"
SCORES = {"sigmoid": ("sigmoid", "sigmoid_logit", "prob", "probability", "pair_probability"), "logit": ("logit", "logits", "pair_logit"), "cosine": ("cosine", "embedding_cosine", "raw_cosine")}
MIN_SIM = 0.00027


def sex_phrase(sex: Column) -> Column:
    """T39."""
    s = F.upper(F.trim(text(sex)))
    return F.when(s.isin("F", "FEMALE", "WOMAN"), "Adult female.").when(s.isin("M", "MALE", "MAN"), "Adult male.").otherwise("Adult patient.")


def view_phrase(view: Column) -> Column:
    """T39; a view other than AP and PA raises."""
    v = F.upper(F.trim(text(view)))
    wrong = F.raise_error(F.concat(F.lit("no phrase for view "), text(view)))
    return F.when(v == "AP", "AP frontal chest radiograph.").when(v == "PA", "PA frontal chest radiograph.").otherwise(wrong)


def image_prompt(impression: Column | str, view: Column, sex: Column | None = None) -> Column:
    """T39."""
    return F.trim(F.concat_ws(" ", sex_phrase(F.lit(None) if sex is None else sex), view_phrase(view), generation_form(impression)))


def _matches(found: Column, sex: str | None, source: str) -> Column:
    return F.transform(found, lambda x: F.struct((F.upper(F.right(x, F.lit(1))) if sex is None else F.lit(sex)).alias("sex"), F.lit(source).alias("source"), x.alias("evidence")))


def _told_by(t: Column, source: str) -> Column:
    return bind(t, lambda x: F.concat(*[_matches(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), sex, source) for pattern, sex in ((MARKED, None), (FEMALE, "F"), (MALE, "M"))]))


def patient_sex(fields: dict[str, Column | str]) -> Column:
    """struct(sex, label, source, evidence, status) from texts in order; marks come before female, then male words, of each text."""
    groups = []
    for name, c in fields.items():
        groups.append(_told_by(generation_form(c), name))

    def told(m: Column) -> Column:
        sexes = F.size(F.array_distinct(F.transform(m, lambda x: x.sex)))
        first = F.try_element_at(m, F.lit(1))
        clash = F.array_join(F.transform(F.slice(m, 1, 8), lambda x: F.concat(x.source, F.lit("="), x.evidence)), "; ")
        one = sexes == 1
        return F.struct(
            F.when(one, first.sex).otherwise("unknown").alias("sex"), F.when(one & (first.sex == "F"), "female").when(one, "male").otherwise("unknown").alias("label"),
            F.when(one, first.source).when(sexes > 1, "conflict").otherwise("").alias("source"), F.when(one, first.evidence).when(sexes > 1, clash).otherwise("").alias("evidence"),
            F.when(one, "ok").when(sexes > 1, "conflict").otherwise("not_found").alias("status"),
        )

    return bind(F.concat(*groups), told)


def token_count(c: Column) -> Column:
    """words, where no tokenizer is plugged in."""
    return F.when(F.trim(c) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def eligible(cohort: DataFrame, split: str = "train", need_sex: bool = True, sex_in_prompt: bool = True, fields: tuple[str, ...] = ("indication", "ref_findings", "ref_impression"), max_prompt: int = 77, max_impression: int = 64, seed: int | None = 0, count=token_count) -> DataFrame:
    """Complete frontal studies of a split, one row each, with sex, prompt and token budgets, in random (or, seed None, id) order."""
    rows = cohort.withColumns({c: text(c) for c in ("ref_findings", "ref_impression", "indication") if c in cohort.columns})
    rows = rows.where((F.lower("split") == split) & F.upper("ViewPosition").isin("AP", "PA") & (F.trim("ref_findings") != "") & (F.trim("ref_impression") != ""))
    rows = first_per(rows, "study_id", "subject_id", "study_id", "dicom_id")
    rows = rows.withColumn("_s", patient_sex({f: f for f in fields if f in rows.columns}))
    rows = rows.select("*", F.col("_s.sex").alias("patient_sex"), *[F.col(f"_s.{x}").alias(f"patient_sex_{x}") for x in ("label", "source", "evidence", "status")]).drop("_s")
    if need_sex:
        rows = rows.where(F.col("patient_sex").isin("M", "F"))
    shown = F.col("patient_sex") if sex_in_prompt else None
    rows = rows.withColumns({"sex_in_prompt": F.lit(sex_in_prompt), "sex_phrase": sex_phrase(F.lit(None) if shown is None else shown), "raw_impression": generation_form("ref_impression")})
    rows = rows.withColumn("prompt", image_prompt("raw_impression", F.col("ViewPosition"), shown))
    rows = rows.withColumns({"prompt_tokens": count(F.col("prompt")), "impression_tokens": count(F.col("raw_impression"))})
    rows = rows.where((F.col("prompt_tokens") <= max_prompt) & (F.col("impression_tokens") <= max_impression)).withColumn("source_key", id_text(F.col("study_id")))
    if seed is not None:
        return shuffled(rows, "study_id", seed).withColumnRenamed("shuffle_order", "source_order")
    return ordinal(rows, "subject_id", "study_id", "dicom_id", name="source_order")


def fixed_sources(manifest: DataFrame, need_sex: bool = True) -> DataFrame:
    """a given manifest with its gaps filled; without study_id or ViewPosition it raises ValueError."""
    lacking = {"study_id", "ViewPosition"} - set(manifest.columns)
    if lacking:
        raise ValueError(f"the manifest lacks {sorted(lacking)}")
    rows = manifest
    for c in ("ref_findings", "ref_impression", "indication"):
        rows = rows.withColumn(c, text(c) if c in rows.columns else F.lit(""))
    rows = rows.withColumn("raw_impression", generation_form("raw_impression" if "raw_impression" in rows.columns else "ref_impression"))
    rows = rows.withColumn("_s", patient_sex({f: f for f in ("indication", "ref_findings", "ref_impression")}))
    for name, part in (("patient_sex", "sex"), *((f"patient_sex_{x}", x) for x in ("label", "source", "evidence", "status"))):
        rows = rows if name in rows.columns else rows.withColumn(name, F.col(f"_s.{part}"))
    rows = rows.drop("_s").withColumn("patient_sex", F.upper("patient_sex"))
    rows = rows.where(F.col("patient_sex").isin("M", "F")) if need_sex else rows
    return rows.withColumns({"prompt": image_prompt("raw_impression", F.col("ViewPosition"), F.col("patient_sex")), "source_key": id_text(F.col("study_id"))})


def candidate_path(subject: Column, study: Column, idx: Column, seed: Column) -> Column:
    """T40."""
    s = id_text(subject)
    return F.concat(F.lit("p"), F.substring(s, 1, 2), F.lit("/p"), s, F.lit("/s"), id_text(study), F.lit("/cand_"), F.lpad(idx.cast("string"), 2, "0"), F.lit("_seed"), seed.cast("string"), F.lit(".png"))


def candidate_seed(order: Column, idx: Column, per_study: int = 2, base: int = 133700) -> Column:
    """T40."""
    return order * per_study + idx + base


def image_stats(images: DataFrame, key: str, pixels: str) -> DataFrame:
    """Mean, std, percentiles and shares of each image's intensities (array in 0..1), with the technical verdict.

    All within the row, without an exchange. Null intensities are left out; images without any have no row; a key must be unique.
    """
    sorted_ = F.array_sort(F.transform(F.filter(pixels, lambda x: x.isNotNull()), lambda x: x.cast("double")))
    total = lambda p, f: F.aggregate(p, F.lit(0.0), lambda s, x: s + f(x))

    def ranked(p: Column, share: float) -> Column:
        """Between the two nearest ranks in proportion, as percentile does."""
        at = (F.size(p) - 1) * F.lit(share)
        low, high = F.get(p, F.floor(at).cast("int")), F.get(p, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    def stats(p: Column, n: Column, mean: Column) -> Column:
        std = F.sqrt(total(p, lambda x: (x - mean) * (x - mean)) / n)
        near = lambda test: total(p, lambda x: test(x).cast("double")) / n
        return F.struct(mean.alias("mean"), std.alias("std"), ranked(p, 0.01).alias("p01"), ranked(p, 0.99).alias("p99"), near(lambda x: x <= 0.02).alias("near_black"), near(lambda x: x >= 0.98).alias("near_white"))

    made = bind(F.struct(sorted_.alias("p"), F.size(sorted_).alias("n")), lambda v: bind(F.struct(v.p.alias("p"), v.n.alias("n"), (total(v.p, lambda x: x) / v.n).alias("mean")), lambda w: stats(w.p, w.n, w.mean)))
    s = images.where(F.size(F.filter(pixels, lambda x: x.isNotNull())) > 0).select(key, made.alias("_s")).select(key, "_s.*").withColumn("range", F.col("p99") - F.col("p01"))
    verdict = technical({c: F.col(c) for c in ("near_black", "near_white", "std", "range")})
    return s.withColumn("_t", verdict).select("*", F.col("_t.ok").alias("technical_ok"), F.col("_t.reason").alias("technical_reason")).drop("_t")


def chosen_score(kind: str) -> str:
    """The column of a kind of score; an unknown one raises ValueError."""
    for name, names in SCORES.items():
        if kind.strip().lower() in names:
            return name
    raise ValueError(f"unknown kind of score: {kind!r}")


def judged(qc: DataFrame, min_sim: float = MIN_SIM, kind: str = "sigmoid_logit", use_technical: bool = True, use_similarity: bool = True) -> DataFrame:
    """Verdicts and the reason for rejection, technical before similarity; a missing score is below the threshold."""
    chosen_score(kind)
    tech = truthy(F.col("technical_ok")) if use_technical and "technical_ok" in qc.columns else F.lit(True)
    if not use_similarity:
        sim_ok, why = F.lit(True), F.lit("disabled")
    elif "sim" in qc.columns:
        sim_ok = F.coalesce(score(F.col("sim")) >= min_sim, F.lit(False))
        why = F.when(sim_ok, "ok").otherwise("below_threshold")
    elif "sim_ok" in qc.columns:
        sim_ok, why = truthy(F.col("sim_ok")), F.col("sim_reason") if "sim_reason" in qc.columns else F.lit(None).cast("string")
    else:
        sim_ok, why = F.lit(False), F.lit("missing_score")
    reason = F.col("technical_reason") if "technical_reason" in qc.columns else F.lit("technical_failed")
    out = qc.withColumns({"technical_ok": tech, "sim_ok": sim_ok, "sim_reason": why})
    rejected = F.when(F.col("technical_ok") & F.col("sim_ok"), "").when(~F.col("technical_ok"), F.coalesce(reason, F.lit("technical_failed"))).otherwise(F.coalesce("sim_reason", F.lit("sim_failed")))
    return out.withColumns({"all_filters_pass": F.col("technical_ok") & F.col("sim_ok"), "sim_score_kind": F.lit(kind), "reject_reason": rejected})


def selected(qc: DataFrame, source: DataFrame, target: int = -1) -> DataFrame:
    """The best passing candidate of each study, up to `target` studies in source order; says what it was chosen by."""
    best = best_passing(qc).join(source.select("study_id", "source_order"), "study_id")
    best = best.withColumn("selection_reason", F.when(score(F.col("sim")).isNotNull(), "best_sim").otherwise("first_passing"))
    return head(best, target, "source_order", "study_id")


def reselect(qc: DataFrame, source: DataFrame, min_sim: float = MIN_SIM, kind: str = "sigmoid_logit", target: int = -1, **options) -> DataFrame:
    """The selection of a QC table judged anew by other limits, without a reason of selection."""
    return selected(judged(qc, min_sim, kind, **options), source, target).drop("selection_reason")


def rescore(candidates: DataFrame, source: DataFrame, score_of: Callable[[DataFrame], DataFrame], min_sim: float = MIN_SIM, kind: str = "sigmoid_logit", target: int = -1, **options) -> tuple[DataFrame, DataFrame]:
    """(qc, selected) of candidates whose scores are computed anew by a plug-in that adds the columns sigmoid, logit and cosine; the kind says which is sim."""
    scored = score_of(candidates.drop("sim"))
    qc = judged(scored.withColumn("sim", F.col(chosen_score(kind))), min_sim, kind, **options)
    return qc, selected(qc, source, target)


def source_status(source: DataFrame, candidates: DataFrame, qc: DataFrame, chosen: DataFrame) -> DataFrame:
    """Accepted, rejected_no_candidate_passed or not_attempted, with counts, for each source study."""
    c = candidates.groupBy(id_text(F.col("study_id")).alias("study_id")).agg(F.count("*").alias("candidate_count"))
    q = qc.groupBy(id_text(F.col("study_id")).alias("study_id")).agg(F.count_if(truthy(F.col("all_filters_pass"))).alias("passed_candidate_count"), F.max(score(F.col("sim"))).alias("best_sim"))
    s = chosen.select(id_text(F.col("study_id")).alias("study_id"), F.col("candidate_idx").alias("selected_candidate_idx"), F.col("image_path").alias("selected_image_path"), F.lit(True).alias("_chosen"))
    rows = source.withColumn("study_id", id_text(F.col("study_id")))
    rows = present(rows, ["study_id", "subject_id", "dicom_id", "ViewPosition", "patient_sex", "patient_sex_label", "patient_sex_status", "patient_sex_source", "source_order"])
    rows = rows.join(c, "study_id", "left").join(q, "study_id", "left").join(first_per(s, "study_id", "selected_candidate_idx"), "study_id", "left")
    n = F.coalesce("candidate_count", F.lit(0))
    status = F.when(F.col("_chosen"), "accepted").when(n > 0, "rejected_no_candidate_passed").otherwise("not_attempted")
    return rows.withColumns({"status": status, "candidate_count": n, "passed_candidate_count": F.coalesce("passed_candidate_count", F.lit(0)), "selected_image_path": F.coalesce("selected_image_path", F.lit(""))}).drop("_chosen")


def training_manifests(source: DataFrame, chosen: DataFrame, policy: str = "selected", window: int = -1) -> dict[str, DataFrame]:
    """Baseline and fine-tuning rows (the same) of real images, and rows of the chosen synthetic ones."""
    rows = source.withColumn("study_id", id_text(F.col("study_id")))
    picks = first_per(chosen.withColumn("study_id", id_text(F.col("study_id"))), "study_id", "candidate_idx")
    if policy in ("selected", "accepted", "accepted_synthetic"):
        real = rows.join(picks.select("study_id"), "study_id", "left_semi")
    elif policy in ("source_window", "fixed_source", "fixed", "eligible_window"):
        real = head(rows, window if window > 0 else -1, "source_order", "study_id")
    else:
        raise ValueError(f"unknown policy: {policy!r}")
    real = real.withColumn("image_source", F.lit("real_dicom"))
    meta = present(picks, ["study_id", "candidate_idx", "candidate_seed", "image_path", "sim", "sim_score_kind", "technical_ok", "sim_ok"])
    synthetic = rows.join(meta, "study_id").withColumn("image_source", F.lit("synthetic_png"))
    return {"train_real_baseline": real, "train_synthetic_pretrain": synthetic, "train_real_finetune": real}


def latest(candidates: DataFrame, order: str) -> DataFrame:
    """Of candidates recorded more than once, the last."""
    return first_per(candidates, ["study_id", "candidate_idx"], F.desc(order))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
