"""Queries over tables: sources and sinks (written to the shared folder and read back), bundles, order, joins, manifests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.operators import cohort, evaluate, manifests, select
from reportloom.plans import sql, views
from reportloom.plans.registry import query
from reportloom.plans.text_queries import documents, reports
from reportloom.session import cut, scratch, ship
from reportloom.sources import files, images, io, manifest
from reportloom.streaming import resume

R, C, Q = {"r": views.REPORTS}, {"c": views.CANDIDATES}, {"q": views.QC}
_JUDGED = "SELECT *, coalesce(sim >= 0.0005, false) AS sim_ok FROM q"


# ---------------------------------------------------------------- sources and sinks


@query("s1_s5_csv_by_name", "SELECT subject_id, study_id, dicom_id, 'a, \"b\"' || chr(10) || lang AS path FROM (SELECT doc_id % 97 AS subject_id, doc_id AS study_id, 'd' || doc_id AS dicom_id, lang FROM documents)")
def _s1(spark: SparkSession, d: str) -> DataFrame:
    """Columns in another order and among others, ids as floats, quotes and line ends; with a missing file's empty table."""
    t = documents(spark, d).select(F.concat(F.lit('a, "b"\n'), "lang").alias("path"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias("study_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dicom_id"), (F.col("doc_id") % 97).alias("subject_id"))
    io.write_csv(t, path := scratch(spark))
    return io.read_csv(spark, path, io.RECORDS).union(io.read_csv(spark, f"{path}-none", io.RECORDS))


@query("s2_s4_k1_u2_parquet_parts", "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def _s2(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of which the second lacks a column."""
    t = documents(spark, d).select("doc_id", "lang", "source")
    path = scratch(spark)
    io.write_parquet(t.where("doc_id % 2 = 0"), f"{path}_part0.parquet")
    io.write_parquet(t.where("doc_id % 2 = 1").drop("source"), f"{path}_part1.parquet")
    return io.read_parts(spark, f"{path}_part*.parquet").select("doc_id", "lang", "source")


@query("s3_resumed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def _s3(spark: SparkSession, d: str) -> DataFrame:
    """A run of a third of the rows, then one of all: only those not done are worked on."""
    t, path = documents(spark, d).select("doc_id"), scratch(spark)
    resume.resume(t.where("doc_id % 3 = 0"), path, "doc_id", lambda x: x.withColumn("run", F.lit("first")))
    return resume.resume(t, path, "doc_id", lambda x: x.withColumn("run", F.lit("second")))


@query("s3_stream_of_new_files", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _s3b(spark: SparkSession, d: str) -> DataFrame:
    """Two arrivals of files, each read once by a stream."""
    path, t = scratch(spark), documents(spark, d).select("doc_id", "lang")
    for k in range(2):
        t.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{path}/in")
        resume.stream_new(spark, f"{path}/in", "doc_id long, lang string", f"{path}/out", f"{path}/check", lambda x: x)
    return resume.results(spark, f"{path}/out").groupBy("lang").agg(F.count("*").alias("n"))


@query("w4_p8_accepted_from_a_stream", "SELECT doc_id FROM (SELECT doc_id, doc_id % 2 AS k, row_number() OVER (ORDER BY doc_id % 2, doc_id) AS n FROM documents WHERE length(text) > 300) WHERE n <= 300")
def _w4_stream(spark: SparkSession, d: str) -> DataFrame:
    """W4 over two arrivals: the first 300 texts of more than 300 characters, counted over both."""
    path, t = scratch(spark), documents(spark, d).select("doc_id", "text")
    for k in range(2):
        t.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{path}/in")
        resume.stream_accepted(spark, f"{path}/in", "doc_id long, text string", f"{path}/out", f"{path}/check", lambda x: x.select("doc_id", (F.length("text") > 300).alias("ok")), 300, "ok", "doc_id")
    return resume.results(spark, f"{path}/out").select("doc_id")


@query("s8_existing_files", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def _s8(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the files that rows came from, a third of them changed."""
    io.write_parquet(documents(spark, d).select("doc_id"), path := scratch(spark))
    name = F.concat(F.input_file_name(), F.when(F.col("doc_id") % 3 == 0, ".gone").otherwise(""))
    return io.existing(io.read_parts(spark, path).withColumn("path", name), "path", path, "*.parquet").select("doc_id")


@query("k2_csv_round_trip", "SELECT conv_id, turn, text FROM conversations")
def _k2(spark: SparkSession, d: str) -> DataFrame:
    io.write_csv(spark.read.parquet(f"{d}/conversations.parquet").select("turn", "text", "conv_id"), path := scratch(spark))
    return io.read_csv(spark, path, "conv_id long, turn long, text string")


@query("k3_e8_json_metrics", "SELECT count(*) AS n, 'é' AS note, max(doc_id) AS last FROM documents")
def _k3(spark: SparkSession, d: str) -> DataFrame:
    got = documents(spark, d).agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).first()
    io.write_json(spark, {"n": got.n, "note": "é", "last": got["last"]}, path := f"{scratch(spark)}.json")
    return io.read_metrics(spark, path).select("n", "note", "last")


@query("k4_shards_written", f"SELECT doc_id, CAST(CAST(floor({sql.rand('doc_id', 0)} * 2147483647) AS BIGINT) % 8 AS INTEGER) AS shard_id FROM documents")
def _k4(spark: SparkSession, d: str) -> DataFrame:
    select.write_shards(select.with_shard(documents(spark, d).select("doc_id"), 8, "doc_id"), path := scratch(spark))
    return io.read_parts(spark, path).select("doc_id", F.col("shard_id").cast("int").alias("shard_id"))


@query("k5_fingerprint", "SELECT sha1(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha1, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS length FROM nation")
def _k5(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of one file of known content."""
    spark.read.parquet(f"{d}/nation.parquet").select("n_name").orderBy("n_name").coalesce(1).write.text(path := scratch(spark))
    return io.fingerprints(spark, path).where("path LIKE '%.txt'").select("sha1", "length")


_PARTS = "SELECT doc_id % 8 AS part, 1 AS run, 'same' AS state, length(coalesce(text, '')) AS chars FROM documents"
_CHANGED = f"""
SELECT CAST(part AS VARCHAR) AS part, state, run, CAST(count(*) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT part, run, state, chars FROM ({_PARTS}) WHERE part NOT IN (3, 5)
  UNION ALL SELECT part, 2, 'changed', chars + 1 FROM ({_PARTS}) WHERE part = 3
  UNION ALL SELECT 8, 2, 'new', length(coalesce(text, '')) FROM documents WHERE doc_id % 8 = 0) GROUP BY part, state, run
UNION ALL SELECT '5', 'gone', CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
"""


@query("k5_j6_changed_parts_made_again", _CHANGED)
def _k5_parts(spark: SparkSession, d: str) -> DataFrame:
    """A cache of all documents by part, brought up to a source of which one part has changed, one has gone and one has come; run is the run that made a part."""
    source, cache = scratch(spark), scratch(spark)
    docs = documents(spark, d).select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 8).alias("part"))

    def put(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(source)

    def work(run: int):
        return lambda rows: rows.select("doc_id", "part", F.length("text").alias("chars"), F.lit(run).alias("run"))

    put(docs)
    manifest.refresh(spark, source, cache, "part", work(1))
    put(docs.where("part = 3").withColumn("text", F.concat("text", F.lit("!"))).union(docs.where("part = 0").withColumn("part", F.lit(8).cast("long"))))
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/part=5")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    found = manifest.refresh(spark, source, cache, "part", work(2))
    made = manifest.cached(spark, cache).groupBy(F.col("part").cast("string").alias("part"), "run").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"))
    return found.join(made, "part", "left").select("part", "state", "run", "n", "chars")


# ---------------------------------------------------------------- bundles and order

_COMPLETE = "SELECT * FROM r WHERE ref_findings <> '' AND ref_impression <> ''"


@query("f2_f4_splits_by_alias", "SELECT a.alias, count(*) AS n, CAST(sum(study_id) AS BIGINT) AS ids FROM (VALUES ('train', 'train'), ('VAL', 'validate'), ('valid', 'validate'), (' test ', 'test')) a(alias, split) JOIN x ON x.split = a.split GROUP BY a.alias", **R, x=_COMPLETE)
def _f4(spark: SparkSession, d: str) -> DataFrame:
    b = cohort.baseline(reports(spark, d))
    parts = [b.split(x).select(F.lit(x).alias("alias"), "study_id") for x in ("train", "VAL", "valid", " test ")]
    return reduce(DataFrame.union, parts).groupBy("alias").agg(F.count("*").alias("n"), F.sum("study_id").alias("ids"))


@query(
    "p2_bundles_x1",
    "SELECT b.name, s.split, count(x.study_id) FILTER (b.name <> 'h4' OR s.split <> 'train' OR x.study_id % 5 = 0) AS n FROM (VALUES ('baseline'), ('h1'), ('h2'), ('h3'), ('h4')) b(name) CROSS JOIN (VALUES ('train', 'train'), ('valid', 'validate'), ('test', 'test')) s(split, own) LEFT JOIN x ON x.split = s.own GROUP BY ALL",
    **R, x=_COMPLETE,
)
def _p2(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d)
    alts = r.select(F.col("study_id").cast("string").alias("study_key"), F.array(F.lit("x")).alias("alts"))
    manifest = cohort.complete(r).where("split = 'train' AND study_id % 5 = 0")
    options = {"baseline": {}, "h1": {"image_mode": "geo"}, "h2": {"alternatives": alts}, "h3": {"alternatives": alts, "image_mode": "mix"}, "h4": {"manifest": manifest}}
    parts = [cohort.builders.get(n)(r, **o).summary().withColumn("name", F.lit(n)) for n, o in options.items()]
    return reduce(DataFrame.unionByName, parts).select("name", "split", "n")


@query("f8_null_to_empty", "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, '') AS lang FROM documents")
def _f8(spark: SparkSession, d: str) -> DataFrame:
    from reportloom.functions.text import text

    return documents(spark, d).select("doc_id", text(F.nullif("lang", F.lit("en"))).alias("lang"))


@query("f11_ordinal", "SELECT doc_id, row_number() OVER (ORDER BY lang, source DESC, doc_id) - 1 AS ordinal FROM documents")
def _f11(spark: SparkSession, d: str) -> DataFrame:
    return select.ordinal(documents(spark, d).select("doc_id", "lang", "source"), "lang", F.desc("source"), "doc_id").select("doc_id", "ordinal")


@query("f12_present_columns", "SELECT doc_id, lang FROM documents")
def _f12(spark: SparkSession, d: str) -> DataFrame:
    return select.present(documents(spark, d), ["doc_id", "no_such", "lang"])


@query("l1_l3_head_of_a_sort", "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars DESC NULLS LAST, doc_id LIMIT 100")
def _l1(spark: SparkSession, d: str) -> DataFrame:
    return select.head(documents(spark, d).select("doc_id", "lang", "n_chars"), 100, "lang", F.desc_nulls_last("n_chars"), "doc_id")


@query("a9_mean_or_zero", "SELECT d.lang, round(coalesce(avg(l.quality) FILTER (l.toxic = 1), 0), 9) AS toxic_quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def _a9(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    return t.groupBy("lang").agg(F.round(evaluate.safe_mean(F.when(F.col("toxic") == 1, F.col("quality"))), 9).alias("toxic_quality"))


_DRAWN = f"SELECT rep, size, CAST(floor({sql.rand('((rep * size + k) % 2147483647)', 5)} * size) AS BIGINT) AS pos FROM w"


@query(
    "x4_bootstrap_statistic",
    "SELECT (SELECT sum(x) FROM v) AS mean, quantile_cont(s, 0.05) AS ci_low, quantile_cont(s, 0.95) AS ci_high, any_value(size) AS n FROM (SELECT rep, any_value(size) AS size, sum(x) AS s FROM d JOIN v USING (pos) GROUP BY rep)",
    v="SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality::DOUBLE AS x FROM labels",
    w="SELECT rep, size, k FROM (SELECT range AS rep FROM range(100)) a, (SELECT count(*) AS size FROM labels) b, (SELECT row_number() OVER () - 1 AS k FROM labels) c", d=_DRAWN,
)
def _x4(spark: SparkSession, d: str) -> DataFrame:
    """The statistic is passed in: here the sum."""
    values = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("x"))
    return evaluate.bootstrap(values, "x", 100, 0.1, 5, F.sum)


# ---------------------------------------------------------------- joins and manifests


@query("j3_results_beside_rows", r"SELECT doc_id, lang, upper(lang) AS code, length(source) AS n FROM documents")
def _j3(spark: SparkSession, d: str) -> DataFrame:
    """Results of a row as a struct beside its columns, opened: no join by position."""
    return documents(spark, d).select("doc_id", "lang", F.struct(F.upper("lang").alias("code"), F.length("source").alias("n")).alias("result")).select("doc_id", "lang", "result.*")


@query(
    "j5_j8_selected_metadata",
    "SELECT CAST(r.study_id AS VARCHAR) AS study_id, r.dicom_id, s.candidate_idx, s.sim, 'synthetic_png' AS image_source FROM r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY coalesce(sim, -1) DESC, candidate_idx) AS n FROM j WHERE technical_ok AND sim_ok) WHERE n = 1) s ON s.study_id = r.study_id",
    **R, **Q, j=_JUDGED,
)
def _j5(spark: SparkSession, d: str) -> DataFrame:
    source = reports(spark, d).withColumn("source_order", F.col("study_id"))
    chosen = manifests.selected(manifests.judged(views.view(spark, d, views.QC), 0.0005), source)
    return manifests.training_manifests(source, chosen)["train_synthetic_pretrain"].select("study_id", "dicom_id", "candidate_idx", "sim", "image_source")


@query("j6_matches_source", "SELECT bool_and(a.ref_findings = r.ref_findings) AS same, bool_and(a.ref_findings || CASE WHEN a.study_id % 50 = 7 THEN '!' ELSE '' END = r.ref_findings) AS other FROM r a JOIN r USING (study_id)", **R)
def _j6(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every source row, and the same with some texts changed."""
    r = reports(spark, d).select("study_id", "ref_findings")
    other = r.withColumn("ref_findings", F.concat("ref_findings", F.when(F.col("study_id") % 50 == 7, "!").otherwise("")))
    return spark.createDataFrame([(select.matches_source(r, r, ["ref_findings"]), select.matches_source(other, r, ["ref_findings"]))], "same boolean, other boolean")


@query("p9_reselected", "SELECT study_id, candidate_idx, sim FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY coalesce(sim, -1) DESC, candidate_idx) AS n FROM q WHERE technical_ok AND coalesce(sim >= 0.001, false)) WHERE n = 1 AND study_id IN (SELECT study_id FROM r)", **R, **Q)
def _p9(spark: SparkSession, d: str) -> DataFrame:
    source = reports(spark, d).withColumn("source_order", F.col("study_id"))
    return manifests.reselect(views.view(spark, d, views.QC), source, 0.001).select("study_id", "candidate_idx", "sim")


_SCORED = "SELECT * EXCLUDE (sim), CAST(row_id % 29 AS DOUBLE) / 29 AS sim FROM q"


@query("p9_rescored_g13_f14", "SELECT row_id, technical_ok AND sim >= 0.5 AS all_filters_pass, CASE WHEN technical_ok AND sim >= 0.5 THEN '' WHEN NOT technical_ok THEN technical_reason ELSE 'below_threshold' END AS reject_reason, 'raw_cosine' AS sim_score_kind FROM x", **Q, x=_SCORED)
def _p9b(spark: SparkSession, d: str) -> DataFrame:
    """Scores computed anew; the kind says which of them counts."""
    source = reports(spark, d).withColumn("source_order", F.col("study_id"))

    def score(c: DataFrame) -> DataFrame:
        return c.withColumns({"sigmoid": F.lit(0.0), "logit": F.lit(None).cast("double"), "cosine": (F.col("row_id") % 29).cast("double") / 29})

    qc, _ = manifests.rescore(views.view(spark, d, views.QC), source, score, 0.5, "raw_cosine")
    return qc.select("row_id", "all_filters_pass", "reject_reason", "sim_score_kind")


@query(
    "p1_cohort_from_files_s6",
    "SELECT study_id, subject_id, dicom_id, split, ViewPosition FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY subject_id, study_id, dicom_id) AS n FROM r WHERE ViewPosition IN ('AP', 'PA')) WHERE n = 1",
    **R,
)
def _p1(spark: SparkSession, d: str) -> DataFrame:
    """Three CSVs to a cached cohort; there are no report files, so the sections are empty."""
    r, path = cut(reports(spark, d).select("subject_id", "study_id", "dicom_id", "split", "ViewPosition")), scratch(spark)
    io.write_csv(r.select("dicom_id", F.lit("x").alias("path"), "study_id", "subject_id"), f"{path}/records")
    io.write_csv(r.select("split", "study_id", "dicom_id"), f"{path}/splits")
    io.write_csv(r.select("ViewPosition", "subject_id", "dicom_id"), f"{path}/views")
    out = io.build_cohort(spark, f"{path}/records", f"{path}/splits", f"{path}/views", f"{path}/records", f"{path}/cache")
    return out.where("ref_findings = '' AND ref_impression = '' AND indication = ''").select("study_id", "subject_id", "dicom_id", "split", "ViewPosition")


# ---------------------------------------------------------------- files that rows name, images


@query("s6_report_files_read_back", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS report FROM documents")
def _s6(spark: SparkSession, d: str) -> DataFrame:
    """A report file for each text but every seventh, some with a byte that isn't UTF-8, read back by the rows that name them."""
    root = f"{scratch(spark)}/files"
    studies = documents(spark, d).select("doc_id", "text", (F.col("doc_id") % 97 + 10).alias("subject_id"), F.col("doc_id").alias("study_id"))
    data = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    named = studies.where("doc_id % 7 <> 0").select(io.report_path(F.col("subject_id"), F.col("study_id"), root).alias("path"), data.alias("data"))
    files.write_files(named, "path", "data")
    return io.with_texts(studies.drop("text"), root).select("doc_id", "report")


def _radiographs(spark: SparkSession, d: str) -> DataFrame:
    """DICOM files made of embeddings as images of eight rows, written and read back: vec_id, rows, columns, pixels, problem."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 8) * 1000).cast("int")).alias("values"))
    root = scratch(spark)

    def encoded(frames):
        for f in frames:
            data = [images.encode_dicom(np.array(v).reshape(8, -1), "MONOCHROME1" if k % 2 else "MONOCHROME2", *((2, -1024) if k % 3 == 1 else ())) for k, v in zip(f["vec_id"].tolist(), f["values"], strict=True)]
            yield pd.DataFrame({"vec_id": f["vec_id"], "data": data})

    ship(spark)
    made = vectors.mapInPandas(encoded, "vec_id long, data binary").withColumn("path", F.concat(F.lit(f"{root}/i"), "vec_id", F.lit(".dcm")))
    files.write_files(made, "path", "data")
    paths = vectors.select("vec_id", F.concat(F.lit(f"{root}/i"), "vec_id", F.lit(".dcm")).alias("path"))
    return images.decoded(files.read_files(paths, "path")).drop("path")


_SCALED = "CASE WHEN hi > lo THEN CAST(v - lo AS FLOAT) / CAST(hi - lo AS FLOAT) ELSE 0::FLOAT END"


@query(
    "s9_dicom_pixels",
    f"SELECT vec_id, 8 AS rows, CAST(len(p) // 8 AS INTEGER) AS columns, list_aggregate(list_transform(p, lambda v: printf('%02X', CAST(trunc((CASE WHEN vec_id % 2 = 1 THEN 1::FLOAT - {_SCALED} ELSE {_SCALED} END) * 255::FLOAT) AS INTEGER))), 'string_agg', '') AS pixels FROM q",
    p="SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 8) * 1000) AS INTEGER)) AS p FROM embeddings",
    q="SELECT vec_id, p, list_min(p) AS lo, list_max(p) AS hi FROM p",
)
def _s9(spark: SparkSession, d: str) -> DataFrame:
    return _radiographs(spark, d).select("vec_id", "rows", "columns", F.hex("pixels").alias("pixels"))


@query("s10_squared_images")
def _s10(spark: SparkSession, d: str) -> DataFrame:
    """S10 over images that are read from files; tests hold the resampling against a direct double loop."""
    return images.squared(_radiographs(spark, d), 96).select("vec_id", F.length("square").alias("n"), F.sha1("square").alias("square"))
