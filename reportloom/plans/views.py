"""Views that give the driver's tables the roles of report tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A text's last line, and all before it; a text of one line is both.
LAST_LINE = "split_part(text, chr(10), -1)"
HEAD = f"CASE WHEN instr(text, chr(10)) = 0 THEN text ELSE substr(text, 1, length(text) - length({LAST_LINE}) - 1) END"

REPORTS = f"""SELECT doc_id AS study_id, doc_id % 97 AS subject_id, concat('d', CAST(doc_id AS VARCHAR(20))) AS dicom_id,
  CASE doc_id % 3 WHEN 0 THEN 'AP' WHEN 1 THEN 'PA' ELSE 'LATERAL' END AS ViewPosition,
  CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validate' ELSE 'test' END AS split,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('___ ', CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'M' END, ' with cough')
    WHEN 2 THEN 'Old woman,  febrile' WHEN 3 THEN 'gentleman with pain' ELSE 'man and woman' END AS indication,
  {HEAD} AS ref_findings, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {LAST_LINE} END AS ref_impression FROM documents"""

PAIRS = """SELECT doc_id AS study_id, lang,
  concat(text, CASE doc_id % 6 WHEN 0 THEN ' left effusion.' WHEN 1 THEN ' right base is mildly hazy.' WHEN 2 THEN ' Bilateral opacities.' WHEN 3 THEN ' left and right lungs.' ELSE ' clear.' END,
    ' impression: ', CASE doc_id % 4 WHEN 0 THEN 'severe edema' WHEN 1 THEN 'no hemothorax' ELSE 'stable' END) AS src_full,
  concat(CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END, CASE doc_id % 7 WHEN 0 THEN ' left effusion.' WHEN 1 THEN ' RIGHT base is hazy.' WHEN 2 THEN ' both lungs.' WHEN 3 THEN ' findings: none.' ELSE ' clear lungs.' END,
    CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' impression: impression: x' ELSE ' impression: ' END, CASE doc_id % 5 WHEN 0 THEN 'moderate edema' WHEN 1 THEN 'hemothorax' ELSE 'stable' END) AS cand_full FROM documents"""

CANDIDATES = """SELECT CAST(doc_id // 5 AS VARCHAR(20)) AS ex_id, doc_id // 5 AS study_id, CAST(doc_id % 5 AS INTEGER) AS cand_id, doc_id % 3 <> 0 AS keep_ok,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 10 AS DOUBLE) / 10 END AS msl_sim, CASE WHEN doc_id % 8 = 0 THEN 'low' WHEN doc_id % 8 = 1 THEN 'dark' END AS reason, text FROM documents"""

PREDICTIONS = f"""SELECT conv_id * 1000 + turn AS study_id, concat(CASE turn % 5 WHEN 1 THEN '/ ' WHEN 2 THEN 'and ' ELSE '' END, {HEAD},
  CASE turn % 4 WHEN 0 THEN ' Impression: ' WHEN 1 THEN ' impression : a impression: ' ELSE ' at 3:45 pm ____________ ' END, {LAST_LINE},
  CASE WHEN conv_id % 9 = 0 THEN ' ----------------------------------' ELSE '' END) AS raw_pred,
  {HEAD} AS ref_findings, {LAST_LINE} AS ref_impression FROM conversations"""

#: Four candidates a study, so that the number of studies grows with the table.
QC = """SELECT vec_id AS row_id, vec_id // 4 AS study_id, CAST(vec_id % 4 AS INTEGER) AS candidate_idx, concat('i', CAST(vec_id AS VARCHAR(20))) AS image_path, label % 4 <> 0 AS technical_ok,
  CASE WHEN label % 4 = 0 THEN 'low_contrast_std' ELSE 'ok' END AS technical_reason, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id % 17 AS DOUBLE) / 10000 END AS sim FROM embeddings"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the table it names, in Spark's dialect."""
    name = sql.rsplit("FROM ", 1)[1].split()[0]
    sql = re.sub(r"(\w+) // (\d+)", r"\1 DIV \2", sql)
    return spark.sql(f"{sql.rsplit('FROM ', 1)[0]}FROM {{source}}", source=spark.read.parquet(f"{sf_dir}/{name}.parquet"))
