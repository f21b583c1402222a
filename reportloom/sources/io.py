"""Sources and sinks: schemas, tolerant readers, report files, writers, fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from reportloom.functions.sections import sections
from reportloom.sources import files

# Schemas of the source tables.
RECORDS = "subject_id bigint, study_id bigint, dicom_id string, path string"
SPLITS = "dicom_id string, split string"
METADATA = "dicom_id string, ViewPosition string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The schema's columns, by name, of a CSV with a header; a missing or empty one is an empty table of the schema.

    Columns may stand in any order, among others. A value that isn't of its type is null (a whole number may end in .0); a file
    that has rows but lacks a column raises ValueError.
    """
    empty = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lacking = [c for c in empty.columns if c not in found.columns]
    if lacking:
        if not found.columns:
            return empty
        raise ValueError(f"{path} lacks {lacking}")

    def typed(name: str, kind: DataType) -> Column:
        c = F.col(f"`{name}`")
        return (F.regexp_replace(F.trim(c), r"\.0+$", "") if isinstance(kind, IntegralType) else c).try_cast(kind).alias(name)

    return found.select(*[typed(f.name, f.dataType) for f in empty.schema.fields])


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files or folders as one table; columns that a part lacks are null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def report_path(subject: Column, study: Column, root: str = "files") -> Column:
    """S7."""
    s = subject.cast("string")
    return F.concat(F.lit(f"{root}/p"), F.substring(s, 1, 2), F.lit("/p"), s, F.lit("/s"), study.cast("string"), F.lit(".txt"))


def valid_utf8(content: Column) -> Column:
    """Bytes as text, without those that aren't UTF-8; a replacement mark that the bytes hold stays."""
    held = F.replace(F.replace(content.cast("string"), F.lit("\ue000"), F.lit("\ue000a")), F.lit("\ufffd"), F.lit("\ue000b"))
    valid = F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(valid, F.lit("\ue000b"), F.lit("\ufffd")), F.lit("\ue000a"), F.lit("\ue000"))


def with_texts(studies: DataFrame, root: str, name: str = "report") -> DataFrame:
    """Studies with the text of their report files; null without a file. Bytes that aren't UTF-8 are dropped.

    Each task opens the files that its rows name; only in a store that tasks can't open is the tree listed by Spark and joined.
    """
    path = report_path(F.col("subject_id"), F.col("study_id"), root)
    if files.reachable(root):
        found = files.read_files(studies.withColumn("_path", path), "_path", "_content")
        return found.withColumn(name, valid_utf8(F.col("_content"))).drop("_path", "_content")
    listed = studies.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "s*.txt").load(root)
    key = r"(p[^/]*/p[^/]*/s[^/]*\.txt)$"
    listed = listed.select(F.regexp_extract("path", key, 1).alias("_key"), valid_utf8(F.col("content")).alias(name))
    return studies.withColumn("_key", F.regexp_extract(path, key, 1)).join(listed, "_key", "left").drop("_key")


def with_sections(studies: DataFrame, root: str) -> DataFrame:
    """Studies with indication, ref_findings and ref_impression of their report files; '' without a file."""
    s = sections(F.col("_text"))
    return with_texts(studies, root, "_text").withColumns({"indication": s["indication"], "ref_findings": s["findings"], "ref_impression": s["impression"]}).drop("_text")


def existing(df: DataFrame, column: str, root: str, glob: str = "*") -> DataFrame:
    """Rows whose path is among the files under root; each task looks for those of its rows. A listing, where tasks can't open the store, doesn't find empty files."""
    if files.reachable(root):
        under = F.regexp_replace(F.lit(f"{root.rstrip('/')}/"), "^file:/*", "/")
        name = F.regexp_extract(column, r"([^/]*)$", 1)
        named = glob_pattern(glob)
        return files.existing_files(df.where(F.startswith(F.regexp_replace(F.col(column), "^file:/*", "/"), under) & name.rlike(named)), column)
    listed = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("_path"))
    return df.join(listed, F.regexp_replace(F.col(column), "^file:/*", "/") == F.col("_path"), "left_semi")


def glob_pattern(glob: str) -> str:
    """A file name's glob of * and ? as a pattern."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else f"\\{c}") for c in glob) + "$"


def build_cohort(spark: SparkSession, records: str, splits: str, metadata: str, reports: str, cache: str, images: str | None = None) -> DataFrame:
    """P1 with files: the three CSVs joined, one row a study, rows whose image is under `images` (if given), with their reports' sections, cached as Parquet at `cache` and read from there if it is."""
    from reportloom.operators.cohort import cohort

    if not exists(spark, cache):
        rows = cohort(read_csv(spark, records, RECORDS), read_csv(spark, splits, SPLITS), read_csv(spark, metadata, METADATA))
        rows = rows.withColumn("dcm_path", F.concat(F.lit(f"{images}/"), "path") if images else F.col("path"))
        rows = existing(rows, "dcm_path", images) if images else rows
        write_parquet(with_sections(rows, reports), cache)
    return read_parts(spark, cache)


def image_reader(source: Column, path: Column) -> Column:
    """Png for a synthetic source or any path to an image, otherwise dicom."""
    png = F.lower(F.trim(F.coalesce(source, F.lit("")))).isin("synthetic", "synthetic_png", "png") | (F.trim(F.coalesce(path, F.lit(""))) != "")
    return F.when(png, "png").otherwise("dicom")


def write_parquet(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("overwrite").parquet(path, compression="snappy")


def write_csv(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """K3: a small payload, indented, other than ASCII kept, to any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(payload, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """A metrics file as a row; None without one."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else None


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """K5: path, length and SHA-1 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha1("content").alias("sha1"))
