"""Cohorts: one row per study from record list, splits and views; bundles of splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.config import Registry
from reportloom.functions.text import target_format
from reportloom.operators.select import first_per, sample

FRONTAL = ("AP", "PA")
SPLIT_ALIASES = {"valid": "validate", "val": "validate", "validation": "validate"}
EVAL_SPLITS = {"train": "train", "valid": "valid", "validate": "valid", "val": "valid", "test": "test"}
SAFE_IMAGE_MODES = ("none", "geo", "photo", "mix")


def cohort(records: DataFrame, splits: DataFrame, views: DataFrame) -> DataFrame:
    """P1 without files: J1, J2, F1, W1."""
    joined = records.join(splits.select("dicom_id", "split"), "dicom_id").join(views.select("dicom_id", "ViewPosition"), "dicom_id", "left")
    return first_per(joined.where(F.col("ViewPosition").isin(*FRONTAL)), "study_id", "subject_id", "study_id", "dicom_id")


def split_name(name: str) -> str:
    """the canonical name of a split."""
    return SPLIT_ALIASES.get(name.strip().lower(), name.strip().lower())


def complete(df: DataFrame, form: str | None = None) -> DataFrame:
    """rows with findings and, unless the form is findings only, an impression. Null sections stay, as they aren't ''."""
    blank = F.coalesce(F.col("ref_findings") == "", F.lit(False))
    if target_format(form) != "findings":
        blank = blank | F.coalesce(F.col("ref_impression") == "", F.lit(False))
    return df.where(~blank)


@dataclass(frozen=True)
class Bundle:
    """Splits as lazy tables, the map of augmented texts (study_key, alts) and how to use them."""

    train: DataFrame
    valid: DataFrame
    test: DataFrame
    alternatives: DataFrame | None = None
    apply_p: float = 0.0
    image_mode: str = "none"

    def split(self, name: str) -> DataFrame:
        """F4; an unknown name raises ValueError."""
        if name.strip().lower() not in EVAL_SPLITS:
            raise ValueError(f"unknown split: {name!r}")
        return getattr(self, EVAL_SPLITS[name.strip().lower()])

    def summary(self) -> DataFrame:
        """Rows of each split."""
        parts = [d.select(F.lit(n).alias("split")) for n, d in (("train", self.train), ("valid", self.valid), ("test", self.test))]
        counts = parts[0].union(parts[1]).union(parts[2]).groupBy("split").count()
        names = self.train.sparkSession.createDataFrame([("train",), ("valid",), ("test",)], "split string")
        return names.join(counts, "split", "left").select("split", F.coalesce("count", F.lit(0)).alias("n"))


builders = Registry("bundle")


@builders.register("baseline")
def baseline(df: DataFrame, form: str | None = None, max_train: int = -1, max_test: int = -1, seed: int = 0) -> Bundle:
    """Complete rows by split; the train and test splits may be samples."""
    df = complete(df, form)
    train, valid, test = (df.where(F.col("split") == s) for s in ("train", "validate", "test"))
    return Bundle(sample(train, max_train, "study_id", seed), valid, sample(test, max_test, "study_id", seed))


def _with(b: Bundle, **changes) -> Bundle:
    return Bundle(**{**b.__dict__, **changes})


@builders.register("h1")
def image_augmented(df: DataFrame, image_mode: str, **options) -> Bundle:
    """Images are augmented; mode none raises ValueError."""
    if image_mode in ("", "none"):
        raise ValueError("an image augmentation mode is needed")
    return _with(baseline(df, **options), image_mode=image_mode)


@builders.register("h2")
def text_augmented(df: DataFrame, alternatives: DataFrame, apply_p: float = 0.5, **options) -> Bundle:
    """Texts are replaced by alternatives; an empty map raises ValueError."""
    if alternatives.isEmpty():
        raise ValueError("the map of alternatives is empty")
    return _with(baseline(df, **options), alternatives=alternatives, apply_p=apply_p)


@builders.register("h3")
def jointly_augmented(df: DataFrame, alternatives: DataFrame, image_mode: str = "none", apply_p: float = 0.5, **options) -> Bundle:
    """Both; only safe image modes."""
    if image_mode not in SAFE_IMAGE_MODES:
        raise ValueError(f"not a safe image mode: {image_mode!r}")
    return _with(text_augmented(df, alternatives, apply_p, **options), image_mode=image_mode)


@builders.register("h4")
def from_manifest(df: DataFrame, manifest: DataFrame, max_train: int = -1, seed: int = 0, **options) -> Bundle:
    """The train split is a manifest; an empty one raises ValueError."""
    if manifest.isEmpty():
        raise ValueError("the manifest is empty")
    return _with(baseline(df, **options), train=sample(manifest, max_train, "study_id", seed))


def funnel(df: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    """(step, name, n) rows left after each condition and those before it; one aggregation."""
    test, counts = F.lit(True), [F.count("*").alias("0")]
    for k, (_, c) in enumerate(steps, 1):
        test = test & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(test).alias(str(k)))
    names = ["all", *(n for n, _ in steps)]
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(f"`{k}`").alias("n")) for k, n in enumerate(names)])
    return df.agg(*counts).select(F.inline(rows))
