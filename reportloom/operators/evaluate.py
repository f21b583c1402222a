"""Evaluation of predictions: assembly, pathology flags, outliers, set overlap, BLEU and ROUGE, bootstrap intervals."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.sections import split_prediction
from reportloom.functions.similarity import ROUGE, clipped_counts, ngram_repeat, rouge_scores
from reportloom.functions.text import WS, punctuation_run, scorer_form, strip, text, tokens_13a, unescaped, word_count
from reportloom.operators import graphs
from reportloom.operators.select import PRIME, det_rand, ordinal
from reportloom.session import cut

TIME = rf"(?iU)at{WS}+\d{{1,2}}:\d{{2}}{WS}*(?:a\.?m\.?|p\.?m\.?)?"
FLAGS = (
    "findings_empty", "impression_empty", "findings_word_le_1", "impression_word_le_1", "raw_starts_impression", "raw_starts_and", "raw_starts_slash",
    "raw_has_findings_header", "multiple_impression_markers", "no_impression_marker", "has_time_like", "long_punct_run", "has_ngram_repeat_ge_5",
)


def predictions(df: DataFrame) -> DataFrame:
    """raw_pred trimmed and parsed, ref_full and pred_full, each only where it is lacking."""
    out = df
    if "pred_findings" not in out.columns:
        f, i = split_prediction("raw_pred")
        out = out.withColumns({"raw_pred": strip(text("raw_pred")), "pred_findings": f, "pred_impression": i})
    if "ref_full" not in out.columns:
        out = out.withColumn("ref_full", strip(F.concat_ws(" ", text("ref_findings"), text("ref_impression"))))
    return out if "pred_full" in out.columns else out.withColumn("pred_full", strip(text("raw_pred")))


def pathology(df: DataFrame) -> DataFrame:
    """What may be wrong with each generated text."""
    raw, f, i = text("raw_pred"), text("pred_findings"), text("pred_impression")
    markers = F.regexp_count(raw, F.lit(rf"(?iU)\bimpression{WS}*:"))
    base = df.select(F.col("study_id").cast("string").alias("study_id"), raw.alias("raw"), f.alias("f"), i.alias("i"), text("ref_impression").alias("r") if "ref_impression" in df.columns else F.lit("").alias("r"))
    base = base.withColumns({"p": punctuation_run("raw"), "g": ngram_repeat(F.col("raw"))})
    raw, f, i = F.col("raw"), F.col("f"), F.col("i")
    markers, times = F.regexp_count(raw, F.lit(rf"(?iU)\bimpression{WS}*:")), F.regexp_count(raw, F.lit(TIME))
    return base.select(
        "study_id", F.length(raw).alias("raw_chars"), word_count(raw).alias("raw_words"), (strip(f) == "").alias("findings_empty"), (strip(i) == "").alias("impression_empty"),
        (word_count(f) <= 1).alias("findings_word_le_1"), (word_count(i) <= 1).alias("impression_word_le_1"),
        raw.rlike(rf"(?iU)\A{WS}*/?{WS}*impression{WS}*:").alias("raw_starts_impression"), raw.rlike(rf"(?iU)\A{WS}*and\b").alias("raw_starts_and"), raw.rlike(rf"(?U)\A{WS}*/").alias("raw_starts_slash"),
        raw.rlike(rf"(?iU)\bfindings{WS}*:").alias("raw_has_findings_header"), markers.alias("impression_marker_count"), (markers > 1).alias("multiple_impression_markers"), (markers == 0).alias("no_impression_marker"),
        times.alias("time_like_count"), (times > 0).alias("has_time_like"), F.col("p.len").alias("max_punct_run_len"), F.col("p.char").alias("max_punct_run_char"), (F.col("p.len") >= 30).alias("long_punct_run"),
        F.col("g.count").alias("repeat_count"), F.col("g.gram").alias("repeat_gram"), (F.col("g.count") >= 5).alias("has_ngram_repeat_ge_5"),
        F.left(raw, F.lit(240)).alias("raw_pred_preview"), F.left(f, F.lit(160)).alias("pred_findings_preview"), F.left(i, F.lit(160)).alias("pred_impression_preview"), F.left("r", F.lit(160)).alias("ref_impression_preview"),
    )


def pathology_summary(flags: DataFrame) -> DataFrame:
    """One row; without rows, n is 0 and the rest null."""
    return flags.agg(
        F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in FLAGS], F.sum("time_like_count").alias("time_like_total_occurrences"), F.max("time_like_count").alias("time_like_max_one_row"),
        F.max("max_punct_run_len").alias("max_punct_run_len"), F.max("repeat_count").alias("max_repeat_count"),
    )


def length_outliers(df: DataFrame, k: int = 20) -> DataFrame:
    """L2: the k rows whose lengths differ most; ties by id."""
    p, r = F.length(text("pred_full")), F.length(text("ref_full"))
    return df.withColumns({"pred_len": p, "ref_len": r}).withColumn("len_abs_delta", F.abs(F.col("pred_len") - F.col("ref_len"))).orderBy(F.desc("len_abs_delta"), "study_id").limit(k)


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """A10: of words between white space."""
    words = F.size(F.filter(F.split(text(column), rf"(?U){WS}+"), lambda x: x != ""))
    return df.select(words.alias("n")).agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("max"))


def safe_mean(c: Column) -> Column:
    """The mean, 0 of nothing."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def overlap_detail(df: DataFrame, ref: str = "ref_ann", hyp: str = "hyp_ann") -> DataFrame:
    """Mean precision and recall of entities and relations; rows without an annotation are skipped and counted."""
    scored = F.col(ref).isNotNull() & F.col(hyp).isNotNull()
    names = {"ent_p": "entity_precision", "ent_r": "entity_recall", "rel_p": "relation_precision", "rel_r": "relation_recall"}
    rows = df.select(F.when(scored, graphs.agreement(F.col(ref), F.col(hyp))).alias("a"))
    there = F.col("a").isNotNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(there).alias("n_scored"), F.count_if(~there).alias("n_skipped"), *[safe_mean(F.col(f"a.{k}")).alias(v) for k, v in names.items()])


def sanitised(df: DataFrame, *columns: str, form: Callable[[str], Column] = scorer_form) -> DataFrame:
    """How many texts of each column a form changes (scorer_form or unescaped)."""
    return df.agg(*[F.count_if(text(c) != form(c)).alias(f"{c}_changed") for c in columns])


def extra_positives(df: DataFrame, names: list[str], pred: str = "pred", ref: str = "ref") -> DataFrame:
    """(label, rate) of positives that the reference lacks, and their mean number as label H_cxp."""
    extra = [((F.coalesce(F.col(pred)[i], F.lit(0)) == 1) & (F.coalesce(F.col(ref)[i], F.lit(0)) != 1)).cast("double") for i in range(len(names))]
    out = df.agg(*[safe_mean(x).alias(n) for n, x in zip(names, extra, strict=True)])
    rows = [F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("rate")) for n in names]
    total = F.struct(F.lit("H_cxp").alias("label"), sum((F.col(f"`{n}`") for n in names), F.lit(0.0)).alias("rate"))
    return out.select(F.inline(F.array(*rows, total)))


def _bleu_counts(pred: Column | str, ref: Column | str, order: int = 4) -> Column:
    """Of a pair of texts: token counts, and for each n the number of n-grams of pred and how many of them ref has, clipped."""
    return clipped_counts(tokens_13a(pred), tokens_13a(ref), order)


def _bleu_score(x: Callable[[str], Column], order: int = 4, smooth: bool = True) -> dict[str, Column]:
    """score, p1.., bp, hyp_len and ref_len from summed counts."""
    precisions, zeros = [], F.lit(0)
    for n in range(1, order + 1):
        none, t = x(f"m{n}") == 0, F.greatest(x(f"t{n}"), F.lit(1))
        zeros = zeros + F.when(none, 1).otherwise(0) if smooth else zeros
        low = 1.0 / (F.pow(F.lit(2.0), zeros) * t) if smooth else F.lit(0.0)
        precisions.append(F.when(none, low).otherwise(x(f"m{n}").cast("double") / t))
    hyp, ref = x("hyp"), x("ref")
    brevity = F.when(hyp == 0, 0.0).when(hyp < ref, F.exp(1 - ref.cast("double") / hyp)).otherwise(1.0)
    mean = F.exp(sum((F.ln(p) for p in precisions), F.lit(0.0)) / order)
    # without a match of any kind, or without tokens, the score is 0
    score = F.when(hyp.isNull() | (hyp == 0) | (x("m1") == 0), 0.0).otherwise(brevity * mean * 100)
    return {"score": score, **{f"p{n}": p * 100 for n, p in enumerate(precisions, 1)}, "bp": brevity, "hyp_len": hyp, "ref_len": ref}


def _sums(name: str, order: int = 4) -> list[Column]:
    return [F.sum(F.col(f"{name}.{k}")).alias(f"{name}_{k}") for k in ("hyp", "ref", *(f"{x}{n}" for n in range(1, order + 1) for x in "tm"))]


def bleu(df: DataFrame, pred: str, ref: str, order: int = 4, smooth: bool = True) -> DataFrame:
    """Corpus BLEU of 13a tokens, with exponential smoothing. Counts are clipped within each row and summed: one scan, no exchange of n-grams."""
    sums = df.select(_bleu_counts(pred, ref, order).alias("b")).agg(*_sums("b", order))
    return sums.select(*[v.alias(k) for k, v in _bleu_score(lambda k: F.col(f"b_{k}"), order, smooth).items()])


def rouge(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Mean F-measures of ROUGE-1, -2, -L and -Lsum of stemmed words; 0 without rows."""
    rows = df.select(rouge_scores(F.col(pred), F.col(ref)).alias("s"))
    return rows.agg(*[safe_mean(F.col(f"s.{k}")).alias(k) for k in ROUGE])


def entity_f1(df: DataFrame, pred: str = "hyp_ann", ref: str = "ref_ann") -> DataFrame:
    """(n, rg_e, rg_er, rg_bar_er) of annotations from a plug-in: mean F1 of entities, of entities with whether they have relations, and of entities with their relations.

    A row without an annotation on either side scores 0; without rows the means are 0.
    """
    there = F.col(pred).isNotNull() & F.col(ref).isNotNull()
    forms = {"rg_e": "entities", "rg_er": "related", "rg_bar_er": "graph"}

    def f1(kind: str) -> Column:
        n = F.col(f"c.{kind}_ref") + F.col(f"c.{kind}_hyp")
        return F.when(n == 0, 1.0).otherwise(2.0 * F.col(f"c.{kind}_both") / F.greatest(n, F.lit(1)))

    rows = df.select(F.when(there, graphs.counts(F.col(ref), F.col(pred), tuple(forms.values()))).alias("c"))
    sums = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.when(F.col("c").isNotNull(), f1(kind))), F.lit(0.0)).alias(k) for k, kind in forms.items()])
    return sums.select("n", *[(F.col(k) / F.greatest(F.col("n"), F.lit(1))).alias(k) for k in forms])


VIEWS = ("findings", "impression", "full")
METRICS = ("n", *ROUGE, "bleu")
#: What a scorer may fail of; other errors, such as those of a Spark job, aren't a metric's own and are raised.
SCORER_ERRORS = (AnalysisException, ArithmeticError, AttributeError, ImportError, LookupError, OSError, RuntimeError, TypeError, ValueError)


def suite(df: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, views: tuple[str, ...] = VIEWS, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(view, metric, value, status) over findings, impressions and full texts; a scorer that fails is reported, not raised.

    All texts' metrics come from one scan, in which only the views and metrics that are asked for are made. Where there are
    annotations (pred_ann_<view>, ref_ann_<view>), the F1 of entities and their detail are among them. Scorers take df and give one value.
    """
    rouge, bleu = [k for k in ROUGE if k in metrics], "bleu" in metrics
    made = [_bleu_counts(f"pred_{v}", f"ref_{v}").alias(f"_b_{v}") for v in views if bleu] + [rouge_scores(F.col(f"pred_{v}"), F.col(f"ref_{v}")).alias(f"_r_{v}") for v in views if rouge]
    totals = [c for v in views for c in (*(_sums(f"_b_{v}") if bleu else ()), *(safe_mean(F.col(f"_r_{v}.{k}")).alias(f"_r_{v}_{k}") for k in rouge))]
    sums = df.select("*", *made).agg(F.count("*").alias("_n"), *totals)
    rows = []
    for v in views:
        values = {"n": F.col("_n").cast("double")} if "n" in metrics else {}
        values |= {k: F.col(f"_r_{v}_{k}") for k in rouge}
        values |= {"bleu": _bleu_score(lambda k, v=v: F.col(f"_b_{v}_{k}"))["score"]} if bleu else {}
        rows += [F.struct(F.lit(v).alias("view"), F.lit(k).alias("metric"), x.alias("value"), F.lit("ok").alias("status")) for k, x in values.items()]
    parts = [sums.select(F.inline(F.array(*rows)))] if rows else []
    for v in views:
        if {f"pred_ann_{v}", f"ref_ann_{v}"} <= set(df.columns):
            for table in (entity_f1(df, f"pred_ann_{v}", f"ref_ann_{v}").drop("n"), overlap_detail(df, f"ref_ann_{v}", f"pred_ann_{v}").drop("n")):
                parts.append(table.select(F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit("ok").alias("status")) for c in table.columns]))))
    for name, scorer in (scorers or {}).items():
        try:
            value = scorer(df).first()[0]
            status = "ok"
        except SCORER_ERRORS as e:
            value, status = None, f"failed: {type(e).__name__}"
        parts.append(df.sparkSession.createDataFrame([("full", name, None if value is None else float(value), status)], "view string, metric string, value double, status string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def labelled(df: DataFrame, command: Callable[[str, str], list[str]], column: str, labels: list[str]) -> DataFrame:
    """Df with label columns from an outside program, run once a batch on files of the task's own temporary folder.

    command(input, output) gives the program's arguments; it reads a CSV with the column `text` and writes one with the labels,
    a row for each row, in order. A program that fails, or gives another number of rows, raises RuntimeError.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([*df.schema.fields, *[StructField(x, DoubleType()) for x in labels]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            with tempfile.TemporaryDirectory() as d:
                f[column].fillna("").to_frame("text").to_csv(f"{d}/in.csv", index=False)
                done = subprocess.run(command(f"{d}/in.csv", f"{d}/out.csv"), capture_output=True, text=True, check=False)
                if done.returncode:
                    raise RuntimeError(f"the labeler failed: {done.stderr[-500:]}")
                got = pd.read_csv(f"{d}/out.csv")
            if len(got) != len(f):
                raise RuntimeError(f"the labeler gave {len(got)} rows for {len(f)}")
            yield f.assign(**{x: got[x].astype("float64").to_numpy() for x in labels})

    return df.mapInPandas(run, out)


def bootstrap(values: DataFrame, column: str, n: int = 1000, alpha: float = 0.05, seed: int = 0, statistic: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(mean, ci_low, ci_high, n): the statistic of n resamples with replacement, repeatable; zeros without values.

    Draws are rows of a range, dealt to all tasks and joined to the values by position; neither values nor resamples are
    gathered, and no array holds a resample. values: column and a unique id.
    """
    ranked = cut(ordinal(values.select("id", F.col(column).cast("double").alias("x")), "id", name="at").select("at", "x"))
    size = ranked.count()
    draws = values.sparkSession.range(n * size)
    at = F.floor(det_rand(F.col("id") % PRIME, seed) * size).cast("long")
    draws = draws.select((F.floor(F.col("id") / F.lit(max(size, 1)))).alias("rep"), at.alias("at"))
    stats = draws.join(ranked, "at").groupBy("rep").agg(statistic(F.col("x")).alias("s"))
    q = stats.agg(F.percentile("s", F.lit(alpha / 2)).alias("low"), F.percentile("s", F.lit(1 - alpha / 2)).alias("high"))
    whole = ranked.agg(statistic(F.col("x")).alias("whole"), F.count("*").alias("n"))
    return whole.join(q).select(F.coalesce("whole", F.lit(0.0)).alias("mean"), F.coalesce("low", F.lit(0.0)).alias("ci_low"), F.coalesce("high", F.lit(0.0)).alias("ci_high"), "n")


__all__ = ["unescaped", "predictions", "pathology", "pathology_summary", "length_outliers", "length_stats", "overlap_detail", "sanitised", "extra_positives", "bleu", "rouge", "entity_f1", "labelled", "suite", "bootstrap"]
