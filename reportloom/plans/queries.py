"""Registered queries and their SQL. A query's name begins with the id of the operator it shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions import sections, sets, similarity
from reportloom.functions import text as T
from reportloom.operators import augment, batching, cohort, evaluate, gates, manifests, resampling, select
from reportloom.plans import sql, views
from reportloom.plans.registry import QUERIES, SQL, Query, query
from reportloom.sources import io


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.REPORTS)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.PAIRS)


R, P, C, Q, G = {"r": views.REPORTS}, {"p": views.PAIRS}, {"c": views.CANDIDATES}, {"q": views.QC}, {"g": views.PREDICTIONS}
#: SQL for T1: white space runs to one space, trimmed.
_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


# ---------------------------------------------------------------- cohorts and relational operators


def _cohort(r: DataFrame, study: str) -> DataFrame:
    joined = r.drop("split", "ViewPosition").join(r.select("dicom_id", "split"), "dicom_id").join(r.select("dicom_id", "ViewPosition"), "dicom_id", "left")
    one = select.first_per(joined.where(F.col("ViewPosition").isin(*cohort.FRONTAL)), study, "subject_id", "study_id", "dicom_id")
    return cohort.complete(one).select("study_id", "subject_id", "dicom_id", "split", "ViewPosition", "ref_findings", "ref_impression")


@query("p1_cohort_build", "SELECT study_id, subject_id, dicom_id, split, ViewPosition, ref_findings, ref_impression FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY subject_id, study_id, dicom_id) AS n FROM r WHERE ViewPosition IN ('AP', 'PA')) WHERE n = 1 AND ref_findings <> '' AND ref_impression <> ''", **R)
def _p1(spark: SparkSession, d: str) -> DataFrame:
    """Three tables joined, frontal views, one row a study, complete."""
    return _cohort(_reports(spark, d), "study_id")


@query("a16_bundle_summary", "SELECT s.split, count(r.study_id) AS n FROM (VALUES ('train', 'train'), ('valid', 'validate'), ('test', 'test')) s(split, name) LEFT JOIN r ON r.split = s.name AND ref_findings <> '' AND ref_impression <> '' GROUP BY s.split", **R)
def _a16(spark: SparkSession, d: str) -> DataFrame:
    return cohort.baseline(_reports(spark, d)).summary()


@query(
    "f5_eligibility_funnel",
    "SELECT 0 AS step, 'all' AS name, count(*) AS n FROM r UNION ALL SELECT 1, 'train', count(*) FROM r WHERE split = 'train' UNION ALL SELECT 2, 'frontal', count(*) FROM r WHERE split = 'train' AND ViewPosition <> 'LATERAL' UNION ALL SELECT 3, 'complete', count(*) FROM r WHERE split = 'train' AND ViewPosition <> 'LATERAL' AND ref_findings <> '' AND ref_impression <> ''",
    **R,
)
def _f5(spark: SparkSession, d: str) -> DataFrame:
    return cohort.funnel(_reports(spark, d), ("train", F.col("split") == "train"), ("frontal", F.upper("ViewPosition").isin("AP", "PA")), ("complete", (F.col("ref_findings") != "") & (F.col("ref_impression") != "")))


@query("f9_ids_f10_truthy", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, doc_id % 4 IN (0, 2) AS yes FROM documents")
def _f9(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    word = F.element_at(F.array(F.lit(" YES "), F.lit("no"), F.lit("1"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.select("doc_id", select.id_text(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".0"))).alias("id"), select.truthy(word).alias("yes"))


@query("f6_token_budget", r"SELECT study_id, len(list_filter(string_split(ref_impression, ' '), lambda x: x <> '')) AS n FROM r WHERE len(list_filter(string_split(ref_impression, ' '), lambda x: x <> '')) <= 64", **R)
def _f6(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).select("study_id", manifests.token_count(F.col("ref_impression")).cast("long").alias("n"))
    return r.where("n <= 64")


@query("w1_first_lineitem_per_order", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def _w1(spark: SparkSession, d: str) -> DataFrame:
    return select.first_per(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j1_j2_orders_customers", "SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _j1(spark: SparkSession, d: str) -> DataFrame:
    t = views.tables(spark, d, "orders", "customer", "nation")
    c = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    return t["orders"].select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.CANDIDATES)


@query("w2_best_candidates", "SELECT ex_id, cand_id, msl_sim FROM (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY msl_sim DESC NULLS LAST, cand_id) AS n FROM c WHERE keep_ok) WHERE n = 1", **C)
def _w2(spark: SparkSession, d: str) -> DataFrame:
    return select.best_candidates(_candidates(spark, d)).select("ex_id", "cand_id", "msl_sim")


@query("w3_best_passing", "SELECT study_id, candidate_idx, sim FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY coalesce(sim, -1) DESC, candidate_idx) AS n FROM q WHERE technical_ok) WHERE n = 1", **Q)
def _w3(spark: SparkSession, d: str) -> DataFrame:
    return select.best_passing(views.view(spark, d, views.QC), passed="technical_ok").select("study_id", "candidate_idx", "sim")


@query("w4_first_accepted", "SELECT row_id, study_id FROM q WHERE technical_ok ORDER BY study_id, candidate_idx LIMIT 100", **Q)
def _w4(spark: SparkSession, d: str) -> DataFrame:
    return select.first_accepted(views.view(spark, d, views.QC), 100, "technical_ok", "study_id", "candidate_idx").select("row_id", "study_id")


@query("w5_merge_shards", "SELECT study_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY 3 - cand_id % 4, cand_id) AS n FROM c) WHERE n = 1", **C)
def _w5(spark: SparkSession, d: str) -> DataFrame:
    """Four shards, the last first."""
    c = _candidates(spark, d).select("study_id", "cand_id")
    return select.merge_shards({str(k): c.where(F.col("cand_id") % 4 == k) for k in (3, 2, 1, 0)}, "study_id", "cand_id").select("study_id", "cand_id")


_RAND = "(((({0} * 2654435761 + {1} * 40503 + 12345) % 2147483647) * (({0} * 2654435761 + {1} * 40503 + 12345) % 2147483647) + 69621) % 2147483647)"


def _rand_sql(key: str, seed: int) -> str:
    b = _RAND.format(key, seed)
    return f"((({b} * {b}) + 48271) % 2147483647) / 2147483647.0::DOUBLE"


@query("l4_sample", f"SELECT doc_id FROM documents ORDER BY {_rand_sql('doc_id', 7)}, doc_id LIMIT 50")
def _l4(spark: SparkSession, d: str) -> DataFrame:
    return select.sample(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), 50, "doc_id", 7)


@query("l5_shuffle_l6_shards", f"SELECT doc_id, row_number() OVER (ORDER BY {_rand_sql('doc_id', 3)}, doc_id) - 1 AS shuffle_order, CAST(CAST(floor({_rand_sql('doc_id', 0)} * 2147483647) AS BIGINT) % 4 AS INTEGER) AS shard_id FROM documents")
def _l5(spark: SparkSession, d: str) -> DataFrame:
    return select.with_shard(select.shuffled(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id", 3), 4, "doc_id")


@query("j4_by_id_list", "SELECT doc_id, doc_id AS rank, lang FROM documents WHERE doc_id % 9 = 0")
def _j4(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    return select.by_id_list(t.select("doc_id", "lang"), t.where("doc_id % 9 = 0").select("doc_id", F.col("doc_id").alias("rank")), "doc_id").select("doc_id", "rank", "lang")


@query("j7_not_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _j7(spark: SparkSession, d: str) -> DataFrame:
    t = views.tables(spark, d, "documents", "labels")
    return select.not_done(t["documents"].select("doc_id"), t["labels"], "doc_id")


@query("j10_semi_join_labels", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _j10(spark: SparkSession, d: str) -> DataFrame:
    t = views.tables(spark, d, "documents", "labels")
    return t["documents"].select("doc_id", "lang").join(t["labels"].where("quality = 1"), "doc_id", "left_semi")


@query("a4_value_counts", "SELECT reason, count(*) AS n FROM c GROUP BY reason", **C)
def _a4(spark: SparkSession, d: str) -> DataFrame:
    """A1, A4: counts with a bucket for null."""
    return _candidates(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("a2_a3_a5_per_key", "SELECT ex_id, count(*) FILTER (keep_ok) AS passed, max(msl_sim) AS best, count(DISTINCT reason) AS reasons FROM c GROUP BY ex_id", **C)
def _a2(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).groupBy("ex_id").agg(F.count_if("keep_ok").alias("passed"), F.max(select.score(F.col("msl_sim"))).alias("best"), F.count_distinct("reason").alias("reasons"))


@query("a6_reject_reasons", "SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 20", **C)
def _a6(spark: SparkSession, d: str) -> DataFrame:
    return augment.reject_reasons(_candidates(spark, d).where("reason IS NOT NULL"))


@query("a7_alternatives", f"SELECT study_key, string_agg(t, '|' ORDER BY o, t) AS alts, count(*) AS n FROM (SELECT CAST(study_id AS VARCHAR) AS study_key, {_LINE.format('text')} AS t, min(cand_id) AS o FROM c GROUP BY 1, 2) WHERE t <> '' GROUP BY study_key", **C)
def _a7(spark: SparkSession, d: str) -> DataFrame:
    m = augment.alternatives(_candidates(spark, d), "study_id", "text", "cand_id")
    return m.select("study_key", F.array_join("alts", "|").alias("alts"), F.size("alts").cast("long").alias("n"))


# ---------------------------------------------------------------- text


@query("t1_one_line", f"SELECT doc_id, {_LINE.format('text')} AS t1, {_LINE.format('text')} AS t7 FROM documents")
def _t1(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.one_line("text").alias("t1"), T.generation_form("text").alias("t7"))


_KEEP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}, chr(9) || chr(10) || chr(13) || ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), chr(9) || chr(10) || chr(13) || ' ')"


@query("t2_keep_newlines", f"SELECT doc_id, {_KEEP.format('text')} AS t2, {_LINE.format('text')} AS t3, {_LINE.format('text')} AS t4, regexp_replace({_KEEP.format('text')}, '\\n\\n+', chr(10), 'g') AS t18 FROM documents")
def _t2(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", T.keep_newlines("text").alias("t2"), T.norm_one_line("text").alias("t3"), T.filter_form("text").alias("t4"), T.augmented_target("text").alias("t18"))


@query("t5_t6_literal_and_punctuation", f"SELECT doc_id, {_LINE.format('text')} || ' a b' AS t5, {_LINE.format('text')} || ':.,' AS t6 FROM documents")
def _t5(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").withColumn("x", T.one_line("text"))
    return t.select("doc_id", T.literal_one_line(F.concat("x", F.lit("\\na\\rb"))).alias("t5"), T.compact_lines(F.concat("x", F.lit("；：。，"))).alias("t6"))


@query(
    "t20_sectioned_target",
    f"SELECT study_id, CASE WHEN i = '' THEN f WHEN f = '' THEN b ELSE {sql.strip(f"f || CASE WHEN {sql.breaks('f')} THEN chr(10) ELSE ' ' END || b")} END AS t20 FROM (SELECT *, CASE WHEN {sql.breaks('i')} THEN 'impression:' || chr(10) ELSE 'impression: ' END || i AS b FROM (SELECT study_id, {sql.augmented('ref_findings')} AS f, {sql.augmented('ref_impression')} AS i FROM r))",
    **R,
)
def _t20(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("study_id", T.sectioned_target("ref_findings", "ref_impression").alias("t20"))


@query(
    "t21_prompt_t22_target",
    f"SELECT study_id, CASE WHEN indication = '' THEN '<start_of_image> findings:' ELSE '<start_of_image> ' || {_LINE.format('indication')} || ' findings:' END AS prompt, trim(CASE WHEN i = '' THEN f ELSE f || ' impression: ' || i END) || ' END_REPORT' AS target, f || '</s>' AS findings_only FROM (SELECT *, {_LINE.format('ref_findings')} AS f, {_LINE.format('ref_impression')} AS i FROM r)",
    **R,
)
def _t21(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("study_id", T.prompt("indication").alias("prompt"), T.target("ref_findings", "ref_impression").alias("target"), T.target("ref_findings", "ref_impression", "findings only", "</s>").alias("findings_only"))


@query("t27_parse_two_lines", f"SELECT study_id, CASE WHEN ok THEN f ELSE '' END AS findings, CASE WHEN ok THEN i ELSE '' END AS impression FROM (SELECT *, length(f) >= 3 AND length(i) >= 3 AS ok FROM (SELECT study_id, {_LINE.format('ref_findings')} AS f, coalesce(nullif({_LINE.format('ref_impression')}, ''), 'more') AS i FROM r))", **R)
def _t27(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Sure. Findings - "), "ref_findings", F.lit("\nIMPRESSION - FINAL; "), "ref_impression", F.lit("\nmore"))
    f, i = sections.parse_two_lines(answer)
    return _reports(spark, d).select("study_id", f.alias("findings"), i.alias("impression"))


@query("t29_impression_of", f"SELECT study_id, {sql.strip('ref_impression')} AS t29, {_LINE.format(chr(39) + 'Impression- ' + chr(39) + ' || ref_impression')} AS t30 FROM r", **R)
def _t29(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("x. Impression- "), "ref_impression", F.lit(" Findings: y"))
    return _reports(spark, d).select("study_id", sections.impression_of(full).alias("t29"), sections.embedding_text(F.concat(F.lit("Impression- "), "ref_impression")).alias("t30"))


@query("t34_t35_tokens", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> ''), ' ') AS t34, len(regexp_extract_all(lower(text), '[A-Za-z0-9]+|[^\\\\sA-Za-z0-9]')) AS n35, len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+|[^\\\\sA-Za-z0-9]'))) AS d35 FROM documents")
def _t34(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").withColumn("t", T.tokens("text"))
    return t.select("doc_id", F.array_join(T.clean_tokens(F.split("text", " ")), " ").alias("t34"), F.size("t").cast("long").alias("n35"), F.size(F.array_distinct("t")).cast("long").alias("d35"))


@query("t36_ngrams", "SELECT doc_id, count(DISTINCT g) AS n FROM (SELECT doc_id, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o AS g FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL GROUP BY doc_id")
def _t36(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(T.ngrams(F.split("text", " "), 4)).cast("long").alias("n"))
    return t.where("n > 0")


@query("t37_sequence_similarity")
def _t37(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d)
    return r.select("study_id", similarity.sequence_ratio(F.col("ref_findings"), F.col("ref_impression")).alias("ratio"))


@query(
    "t39_image_prompt_t40_path",
    f"SELECT study_id, trim(CASE WHEN study_id % 2 = 0 THEN 'Adult female. ' ELSE 'Adult patient. ' END || CASE WHEN ViewPosition = 'AP' THEN 'AP' ELSE 'PA' END || ' frontal chest radiograph. ' || {_LINE.format('ref_impression')}) AS prompt, 'p' || substr(CAST(subject_id AS VARCHAR), 1, 2) || '/p' || subject_id || '/s' || study_id || '/cand_01_seed' || (133701 + 2 * study_id) || '.png' AS path FROM r WHERE ViewPosition IN ('AP', 'PA')",
    **R,
)
def _t39(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).where("ViewPosition IN ('AP', 'PA')")
    seed = manifests.candidate_seed(F.col("study_id"), F.lit(1))
    return r.select("study_id", manifests.image_prompt("ref_impression", F.col("ViewPosition"), F.when(F.col("study_id") % 2 == 0, "female")).alias("prompt"), manifests.candidate_path(F.col("subject_id"), F.col("study_id"), F.lit(1), seed).alias("path"))


@query("t45_artifact_name_s7_path", "SELECT study_id, trim(regexp_replace('..run ' || ref_impression, '[^A-Za-z0-9_.=-]+', '_', 'g'), '._') AS name, 'files/p' || substr(CAST(subject_id AS VARCHAR), 1, 2) || '/p' || subject_id || '/s' || study_id || '.txt' AS path FROM r", **R)
def _t45(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("study_id", T.artifact_name(F.concat(F.lit("..run "), "ref_impression")).alias("name"), io.report_path(F.col("subject_id"), F.col("study_id")).alias("path"))


# ---------------------------------------------------------------- gates


@query("g1_same_words", "SELECT study_id, list_sort(list_distinct(regexp_extract_all(lower(src_full), '\\b(right|left|bilateral)\\b'))) = list_sort(list_distinct(regexp_extract_all(lower(cand_full), '\\b(right|left|bilateral)\\b'))) AND list_sort(list_distinct(regexp_extract_all(lower(src_full), '\\b(mild|moderate|severe)\\b'))) = list_sort(list_distinct(regexp_extract_all(lower(cand_full), '\\b(mild|moderate|severe)\\b'))) AS ok FROM p", **P)
def _g1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("study_id", gates.same_words(F.col("src_full"), F.col("cand_full")).ok.alias("ok"))


_SIDE = "regexp_matches(lower({0}), '\\b({1})\\b')"


def _has(text: str, words: str) -> str:
    return _SIDE.format(text, words)


_BOTH = "bilateral|bilaterally|both|bibasilar|bibasal|biapical|bihilar"


@query(
    "g2_sides_kept",
    "SELECT study_id, NOT flip AS ok, CASE WHEN flip THEN 'laterality_mismatch' WHEN sev THEN 'severity_mismatch' WHEN lat THEN 'laterality_warning' ELSE 'ok' END AS reason FROM (SELECT *, (sl <> sr) AND NOT sb AND CASE WHEN sl THEN NOT cl OR cr ELSE NOT cr OR cl END AS flip, sl <> cl OR sr <> cr OR sb <> cb AS lat FROM x)",
    p=views.PAIRS,
    x=f"SELECT study_id, {_has('src_full', 'left|lt')} AS sl, {_has('src_full', 'right|rt')} AS sr, {_has('src_full', _BOTH)} AS sb, {_has('cand_full', 'left|lt')} AS cl, {_has('cand_full', 'right|rt')} AS cr, {_has('cand_full', _BOTH)} AS cb, "
    + " OR ".join(f"({_has('src_full', w + '(ly)?')} <> {_has('cand_full', w + '(ly)?')})" for w in ("mild", "moderate", "severe", "minimal", "marked"))
    + " AS sev FROM p",
)
def _g2(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("g", gates.sides_kept(F.col("src_full"), F.col("cand_full"))).select("study_id", "g.ok", "g.reason")


@query("g3_ascii_only", "SELECT study_id, strlen(cand_full) = length(cand_full) AS ok, array_to_string(list_sort(list_distinct(regexp_extract_all(cand_full, '[^\\x00-\\x7F]')))[1:10], '') AS bad_chars FROM p", **P)
def _g3(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("g", gates.ascii_only(F.col("cand_full"))).select("study_id", "g.ok", "g.bad_chars")


@query("g4_changed_enough")
def _g4(spark: SparkSession, d: str) -> DataFrame:
    p = similarity.with_sequence_ratio(_pairs(spark, d), "src_full", "cand_full", "ratio")
    return p.withColumn("g", gates.changed_enough(F.col("src_full"), F.col("cand_full"), F.col("ratio"))).select("study_id", "g.ok", "g.reason", "g.seq_ratio", "g.overlap4", "g.changed_frac")


_UNIGRAMS = "SELECT study_id, side, w, row_number() OVER (PARTITION BY study_id, side ORDER BY i) AS i FROM (SELECT study_id, 'a' AS side, unnest(a) AS w, unnest(range(len(a))) AS i FROM x UNION ALL SELECT study_id, 'b', unnest(b), unnest(range(len(b))) FROM x)"


@query(
    "g4_overlap_and_changed",
    "SELECT p.study_id, round(coalesce(gg.i / gg.u, 0), 9) AS overlap4, round(1 - coalesce(ss.i, 0) / greatest(1, coalesce(ss.n, 0)), 9) AS changed_frac FROM p LEFT JOIN (SELECT study_id, count(*) FILTER (n = 2)::DOUBLE AS i, count(*) AS u FROM (SELECT study_id, g, count(DISTINCT side) AS n FROM y WHERE g IS NOT NULL GROUP BY ALL) GROUP BY study_id) gg USING (study_id) LEFT JOIN (SELECT study_id, count(*) FILTER (n = 2)::DOUBLE AS i, count(*) FILTER (a) AS n FROM (SELECT study_id, w, count(DISTINCT side) AS n, bool_or(side = 'a') AS a FROM z GROUP BY ALL) GROUP BY study_id) ss USING (study_id)",
    p=views.PAIRS,
    x="SELECT study_id, regexp_extract_all(lower(src_full), '[A-Za-z0-9]+|[^\\\\sA-Za-z0-9]') AS a, regexp_extract_all(lower(cand_full), '[A-Za-z0-9]+|[^\\\\sA-Za-z0-9]') AS b FROM p",
    z=_UNIGRAMS,
    y="SELECT study_id, side, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o AS g FROM z WINDOW o AS (PARTITION BY study_id, side ORDER BY i)",
)
def _g4b(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("g", gates.changed_enough(F.col("src_full"), F.col("cand_full"), F.lit(0.0)))
    return p.select("study_id", F.round("g.overlap4", 9).alias("overlap4"), F.round("g.changed_frac", 9).alias("changed_frac"))


_ARTIFACT = gates.ARTIFACTS


@query(
    "g5_well_formed",
    f"SELECT study_id, CASE WHEN c = '' THEN 'empty_candidate' WHEN m <> 1 THEN 'bad_impression_marker_count' WHEN regexp_matches(c, '{_ARTIFACT}', 'is') THEN 'artifact_or_nested_header' WHEN regexp_matches(lower(c), '\\bhemothorax\\b') AND NOT regexp_matches(lower(s), '\\bhemothorax\\b') THEN 'unsupported_new_term' WHEN ratio < 0.55 THEN 'too_short' WHEN ratio > 1.8 THEN 'too_long' ELSE 'ok' END AS reason FROM (SELECT *, len(regexp_extract_all(lower(c), '\\bimpression\\s*:')) AS m, length({_LINE.format('c')})::DOUBLE / greatest(1, length({_LINE.format('s')})) AS ratio FROM (SELECT study_id, {sql.strip('cand_full')} AS c, {sql.strip('src_full')} AS s FROM p))",
    **P,
)
def _g5(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("study_id", gates.well_formed(F.col("src_full"), F.col("cand_full")).reason.alias("reason"))


_LABELS = "SELECT doc_id, [quality, toxic, CAST(doc_id % 2 AS INTEGER)] AS s, [CAST(doc_id % 3 = 0 AS INTEGER), toxic, 1] AS c FROM labels"


@query(
    "g7_labels_kept_a13",
    "SELECT doc_id, e AS extra_pos, m AS miss_pos, e + m AS hamming, e <= 0 AND m <= 1 AND e + m <= 2 AS ok FROM (SELECT doc_id, CAST(list_sum(list_transform(list_zip(s, c), lambda x: CASE WHEN x[2] = 1 AND x[1] = 0 THEN 1 ELSE 0 END)) AS INTEGER) AS e, CAST(list_sum(list_transform(list_zip(s, c), lambda x: CASE WHEN x[2] = 0 AND x[1] = 1 THEN 1 ELSE 0 END)) AS INTEGER) AS m FROM l)",
    l=_LABELS,
)
def _g7(spark: SparkSession, d: str) -> DataFrame:
    src = F.array("quality", "toxic", (F.col("doc_id") % 2).cast("int"))
    cand = F.array((F.col("doc_id") % 3 == 0).cast("int"), F.col("toxic"), F.lit(1))
    return spark.read.parquet(f"{d}/labels.parquet").withColumn("g", gates.labels_kept(src, cand)).select("doc_id", "g.extra_pos", "g.miss_pos", "g.hamming", "g.ok")


@query(
    "g8_similar_m3",
    "SELECT a.vec_id, round(s, 6) AS sim, s BETWEEN 0.75 AND 0.985 AS ok FROM (SELECT x.vec_id, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[]))) AS s FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) a",
)
def _g8(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    s = e.join(nxt, "vec_id").withColumn("s", sets.cosine(F.col("embedding"), F.col("other")))
    return s.select("vec_id", F.round("s", 6).alias("sim"), gates.similar(F.col("s")).ok.alias("ok"))


@query("g9_evaluate_candidates")
def _g9(spark: SparkSession, d: str) -> DataFrame:
    """Cheap gates on all rows, then label and similarity scorers on those that passed."""
    p = _pairs(spark, d).withColumn("row_id", F.col("study_id"))
    label = lambda c: F.array(*[c.contains(w).cast("int") for w in ("edema", "effusion", "stable")])
    scorers = {"chex": lambda x: x.withColumn("chex", gates.labels_kept(label(F.col("src_full")), label(F.col("cand_full")))), "msl": lambda x: x.withColumn("msl", gates.similar(F.lit(None).cast("double")))}
    out = gates.evaluate(p, scorers, enabled=frozenset({"quick", "lex", "ascii", "chex", "msl"}))
    return out.select("study_id", *[f"{n}_{k}" for n in ("quick", "lex", "ascii", "format", "chex", "rg", "msl") for k in ("ok", "reason")], "keep_ok")


@query(
    "g11_technical_qc_m2",
    "SELECT vec_id, round(m, 9) AS mean, round(s, 9) AS std, round(p99 - p01, 9) AS range, CASE WHEN b >= 0.995 THEN 'almost_all_black' WHEN w >= 0.995 THEN 'almost_all_white' WHEN s < 0.01 THEN 'low_contrast_std' WHEN p99 - p01 < 0.05 THEN 'low_percentile_range' ELSE 'ok' END AS technical_reason FROM (SELECT vec_id, avg(p) AS m, stddev_pop(p) AS s, quantile_cont(p, 0.01) AS p01, quantile_cont(p, 0.99) AS p99, avg((p <= 0.02)::INTEGER) AS b, avg((p >= 0.98)::INTEGER) AS w FROM (SELECT vec_id, abs(unnest(embedding)::DOUBLE) * (CASE WHEN vec_id % 5 = 0 THEN 0.001 ELSE 1 END)::DOUBLE AS p FROM embeddings) GROUP BY vec_id)",
)
def _g11(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    dim = F.when(F.col("vec_id") % 5 == 0, 0.001).otherwise(1.0)
    images = e.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * dim).alias("pixels"))
    return manifests.image_stats(images, "vec_id", "pixels").select("vec_id", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("range", 9).alias("range"), "technical_reason")


_JUDGED = "SELECT *, coalesce(sim >= 0.0005, false) AS sim_ok FROM q"


@query("g12_f13_judged", "SELECT row_id, technical_ok AND sim_ok AS all_filters_pass, CASE WHEN technical_ok AND sim_ok THEN '' WHEN NOT technical_ok THEN technical_reason ELSE 'below_threshold' END AS reject_reason FROM j", q=views.QC, j=_JUDGED)
def _g12(spark: SparkSession, d: str) -> DataFrame:
    return manifests.judged(views.view(spark, d, views.QC), 0.0005).select("row_id", "all_filters_pass", "reject_reason")


def _status(source: DataFrame, qc: DataFrame, chosen: DataFrame) -> DataFrame:
    out = manifests.source_status(source, qc, qc, chosen)
    return out.select("study_id", "status", "candidate_count", "passed_candidate_count", "best_sim", "selected_candidate_idx", "selected_image_path")


def _training(source: DataFrame, _: DataFrame, chosen: DataFrame) -> DataFrame:
    m = manifests.training_manifests(source, chosen)
    cols = ["study_id", "split", "image_source"]
    return m["train_real_baseline"].select(*cols, F.lit(None).cast("string").alias("image_path")).union(m["train_synthetic_pretrain"].select(*cols, "image_path"))


def _synthetic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    qc = manifests.judged(views.view(spark, d, views.QC), 0.0005)
    source = _reports(spark, d).withColumn("source_order", F.col("study_id"))
    return source, qc, manifests.selected(qc, source)


_CHOSEN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY coalesce(sim, -1) DESC, candidate_idx) AS n FROM j WHERE technical_ok AND sim_ok) WHERE n = 1 AND study_id IN (SELECT study_id FROM r)"
_SYNTHETIC = {"r": views.REPORTS, "q": views.QC, "j": _JUDGED, "s": _CHOSEN}


@query("p8_selected", "SELECT study_id, candidate_idx, sim, 'best_sim' AS selection_reason FROM s", **_SYNTHETIC)
def _p8(spark: SparkSession, d: str) -> DataFrame:
    return _synthetic(spark, d)[2].select("study_id", "candidate_idx", "sim", "selection_reason")


@query(
    "p11_source_status",
    "SELECT CAST(r.study_id AS VARCHAR) AS study_id, CASE WHEN s.study_id IS NOT NULL THEN 'accepted' WHEN c.n > 0 THEN 'rejected_no_candidate_passed' ELSE 'not_attempted' END AS status, coalesce(c.n, 0) AS candidate_count, coalesce(c.passed, 0) AS passed_candidate_count, c.best AS best_sim, s.candidate_idx AS selected_candidate_idx, coalesce(s.image_path, '') AS selected_image_path FROM r LEFT JOIN s ON s.study_id = r.study_id LEFT JOIN (SELECT study_id, count(*) AS n, count(*) FILTER (technical_ok AND sim_ok) AS passed, max(sim) AS best FROM j GROUP BY study_id) c ON c.study_id = r.study_id",
    **_SYNTHETIC,
)
def _p11(spark: SparkSession, d: str) -> DataFrame:
    return _status(*_synthetic(spark, d))


@query(
    "p10_training_manifests",
    "SELECT CAST(r.study_id AS VARCHAR) AS study_id, r.split, 'real_dicom' AS image_source, NULL AS image_path FROM r JOIN s ON s.study_id = r.study_id UNION ALL SELECT CAST(r.study_id AS VARCHAR), r.split, 'synthetic_png', s.image_path FROM r JOIN s ON s.study_id = r.study_id",
    **_SYNTHETIC,
)
def _p10(spark: SparkSession, d: str) -> DataFrame:
    return _training(*_synthetic(spark, d))


# ---------------------------------------------------------------- evaluation


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.predictions(views.view(spark, d, views.PREDICTIONS))


@query("e1_predictions", "SELECT study_id, " + sql.strip("raw_pred") + " AS pred_full, " + sql.strip("ref_findings || ' ' || ref_impression") + " AS ref_full FROM g", **G)
def _e1(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("study_id", "pred_full", "ref_full")


@query("l2_length_outliers", f"SELECT study_id, p AS pred_len, r AS ref_len, abs(p - r) AS len_abs_delta FROM (SELECT study_id, length({sql.strip('raw_pred')}) AS p, length({sql.strip("ref_findings || ' ' || ref_impression")}) AS r FROM g) ORDER BY len_abs_delta DESC, study_id LIMIT 20", **G)
def _l2(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.length_outliers(_predictions(spark, d)).select("study_id", *[F.col(c).cast("long").alias(c) for c in ("pred_len", "ref_len", "len_abs_delta")])


def repeats(source: str, key: str, text: str, longest: int = 5) -> str:
    """T43 as a query: key, count and gram of texts with a repeat. Equal words n apart, k + n of them in a row, are an n-gram in succession."""
    words = f"SELECT {key}, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9:/.]+') AS w FROM {source})"
    equal = " UNION ALL ".join(f"SELECT {key}, {n} AS n, i, coalesce(lead(w, {n}) OVER (PARTITION BY {key} ORDER BY i) = w, false) AS same FROM _words" for n in range(1, longest + 1))
    runs = f"SELECT *, min(CASE WHEN NOT same THEN i END) OVER (PARTITION BY {key}, n ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i AS run FROM _equal"
    best = f"SELECT {key}, n, i, run // n + 1 AS count FROM _runs WHERE run >= n QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY run // n + 1 DESC, n, i) = 1"
    return f"WITH _words AS ({words}), _equal AS ({equal}), _runs AS ({runs}), _best AS ({best}) SELECT b.{key}, CAST(b.count AS INTEGER) AS count, string_agg(w.w, ' ' ORDER BY w.i) AS gram FROM _best b JOIN _words w ON w.{key} = b.{key} AND w.i >= b.i AND w.i < b.i + b.n GROUP BY b.{key}, b.count"


_FLAGGED = rf"""SELECT CAST(study_id AS VARCHAR) AS study_id, length(raw) AS raw_chars, len(regexp_extract_all(raw, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS raw_words,
  regexp_matches(raw, '^\s*and\b', 'i') AS raw_starts_and, regexp_matches(raw, '^\s*/') AS raw_starts_slash, len(regexp_extract_all(lower(raw), '\bimpression\s*:')) AS impression_marker_count,
  len(regexp_extract_all(lower(raw), 'at\s+\d\d?:\d\d\s*(a\.?m\.?|p\.?m\.?)?')) AS time_like_count,
  coalesce(list_max(list_transform(regexp_extract_all(raw, '_{{10,}}|-{{10,}}'), lambda x: length(x))), 0) AS max_punct_run_len FROM (SELECT study_id, {sql.strip('raw_pred')} AS raw FROM g)"""


@query("e3_pathology_t41_t42", "SELECT * FROM f", g=views.PREDICTIONS, f=_FLAGGED)
def _e3(spark: SparkSession, d: str) -> DataFrame:
    f = evaluate.pathology(_predictions(spark, d))
    longs = ("raw_chars", "raw_words", "impression_marker_count", "time_like_count", "max_punct_run_len")
    return f.select("study_id", "raw_starts_and", "raw_starts_slash", *[F.col(c).cast("long").alias(c) for c in longs])


@query("e3_pathology_repeats", "SELECT CAST(w.study_id AS VARCHAR) AS study_id, coalesce(x.count, 1) AS repeat_count, coalesce(x.gram, '') AS repeat_gram, coalesce(x.count, 1) >= 5 AS has_ngram_repeat_ge_5 FROM w LEFT JOIN x USING (study_id)", **G, w=f"SELECT study_id, {sql.strip('raw_pred')} AS raw FROM g", x=repeats("w", "study_id", "raw"))
def _e3b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pathology(_predictions(spark, d)).select("study_id", "repeat_count", "repeat_gram", "has_ngram_repeat_ge_5")


@query("a8_pathology_summary", "SELECT count(*) AS n, count(*) FILTER (raw_starts_and) AS raw_starts_and, count(*) FILTER (impression_marker_count > 1) AS multiple_impression_markers, count(*) FILTER (max_punct_run_len >= 30) AS long_punct_run, CAST(sum(time_like_count) AS BIGINT) AS time_like_total_occurrences, max(max_punct_run_len) AS max_punct_run_len FROM f", g=views.PREDICTIONS, f=_FLAGGED)
def _a8(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.pathology_summary(evaluate.pathology(_predictions(spark, d)))
    return s.select("n", "raw_starts_and", "multiple_impression_markers", "long_punct_run", F.col("time_like_total_occurrences"), F.col("max_punct_run_len").cast("long").alias("max_punct_run_len"))


@query("t43_ngram_repeat", "SELECT d.doc_id, coalesce(x.count, 1) AS count, coalesce(x.gram, '') AS gram FROM documents d LEFT JOIN x USING (doc_id)", x=repeats("documents", "doc_id", "text"))
def _t43(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", similarity.ngram_repeat(F.col("text")).alias("g"))
    return t.select("doc_id", "g.count", "g.gram")


@query("a10_length_stats", r"SELECT avg(n) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median, quantile_cont(n::DOUBLE, 0.9) AS p90, max(n) AS max FROM (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents)")
def _a10(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.length_stats(spark.read.parquet(f"{d}/documents.parquet"), "text").withColumn("max", F.col("max").cast("long"))


@query(
    "a11_bootstrap",
    f"SELECT round((SELECT avg(x) FROM v), 9) AS mean, round(quantile_cont(s, 0.025), 9) AS ci_low, round(quantile_cont(s, 0.975), 9) AS ci_high, any_value(size) AS n FROM (SELECT rep, any_value(size) AS size, avg(x) AS s FROM (SELECT rep, size, CAST(floor({_rand_sql('((rep * size + k) % 2147483647)', 0)} * size) AS BIGINT) AS pos FROM w) d JOIN v USING (pos) GROUP BY rep)",
    v="SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality::DOUBLE AS x FROM labels",
    w="SELECT rep, size, k FROM (SELECT range AS rep FROM range(200)) a, (SELECT count(*) AS size FROM labels) b, (SELECT row_number() OVER () - 1 AS k FROM labels) c",
)
def _a11(spark: SparkSession, d: str) -> DataFrame:
    values = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("x"))
    return evaluate.bootstrap(values, "x", 200).select(*[F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high")], "n")


@query("a12_extra_positives", "SELECT 'a' AS label, avg((c[1] = 1 AND s[1] <> 1)::INTEGER) AS rate FROM l UNION ALL SELECT 'b', avg((c[2] = 1 AND s[2] <> 1)::INTEGER) FROM l UNION ALL SELECT 'H_cxp', avg((c[1] = 1 AND s[1] <> 1)::INTEGER) + avg((c[2] = 1 AND s[2] <> 1)::INTEGER) FROM l", l=_LABELS)
def _a12(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/labels.parquet").select(F.array("quality", "toxic").alias("ref"), F.array((F.col("doc_id") % 3 == 0).cast("int"), F.col("toxic")).alias("pred"))
    return evaluate.extra_positives(t, ["a", "b"])


# ---------------------------------------------------------------- training views, vectors


@query("a11_bootstrap_by_splitting", "SELECT avg(n_chars) AS mean, count(n_chars) AS n, CAST(200 AS BIGINT) AS resamples, count(n_chars) * 200 AS draws, true AS around_mean FROM documents")
def _a11_splitting(spark: SparkSession, d: str) -> DataFrame:
    """A11 with counts drawn by splitting: the numbers that any draws have."""
    values = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "n_chars")
    reps, whole = resampling.resampled_sums(values, "n_chars", 200)
    q = reps.agg(F.count("*").alias("resamples"), F.sum("n").alias("draws"), F.percentile(F.col("s") / F.col("n"), F.lit(0.025)).alias("low"), F.percentile(F.col("s") / F.col("n"), F.lit(0.975)).alias("high"))
    mean = F.col("s") / F.col("n")
    return whole.crossJoin(q).select(mean.alias("mean"), "n", "resamples", "draws", mean.between(F.col("low"), F.col("high")).alias("around_mean"))  # a row with a row


_VIEW = f"SELECT study_id, u <= 0.5 AND n > 0 AS used_aug, CASE WHEN u <= 0.5 AND n > 0 THEN 'alt ' || (1 + CAST(floor(u2 * n) AS INTEGER)) || ' END_REPORT' ELSE trim(CASE WHEN i = '' THEN f ELSE f || ' impression: ' || i END) || ' END_REPORT' END AS target FROM (SELECT study_id, {_rand_sql('study_id', 0)} AS u, {_rand_sql('study_id', 1)} AS u2, study_id % 3 AS n, {_LINE.format('ref_findings')} AS f, {_LINE.format('ref_impression')} AS i FROM r)"


def _alternatives_of(r: DataFrame) -> DataFrame:
    return r.where("study_id % 3 > 0").select(F.col("study_id").cast("string").alias("study_key"), F.transform(F.sequence(F.lit(1), (F.col("study_id") % 3).cast("int")), lambda k: F.concat(F.lit("alt "), k.cast("string"))).alias("alts"))


@query(
    "v1_training_view_m9",
    _VIEW,
    **R,
)
def _v1(spark: SparkSession, d: str) -> DataFrame:
    """J9, M9, T20 to T22."""
    r = _reports(spark, d)
    return augment.training_view(r, _alternatives_of(r), 0.5).select("study_id", "used_aug", "target")


@query("j9_a7_joined_as_laid_out", _VIEW, **R)
def _j9(spark: SparkSession, d: str) -> DataFrame:
    """The same from tables that are laid out for the join: no exchange when they are read."""
    r = _reports(spark, d)
    rows, alts = augment.laid_out(r, "study_id", 16), augment.laid_out(_alternatives_of(r), buckets=16)
    return augment.training_view(rows, alts, 0.5).select("study_id", "used_aug", "target")


@query(
    "v5_collated_by_batch",
    "SELECT doc_id, batch, place, width, width - n AS n_pad, CAST(list_sum(i) AS BIGINT) AS ids, CAST(n AS BIGINT) AS attended, CAST(list_sum(i) - i[1] - 100 * (width - n + 1) AS BIGINT) AS labels FROM (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM (SELECT doc_id, i, n, pos // 32 AS batch, CAST(pos % 32 AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY n, doc_id) - 1 AS pos FROM t)))",
    t="SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) + 1) AS i, CAST(len(string_split(text, ' ')) AS INTEGER) AS n FROM documents",
)
def _v5_batches(spark: SparkSession, d: str) -> DataFrame:
    """V4, V5 over all texts: an id a word, the first label masked, batches of 32 texts of similar length."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w) + 1)
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", ids.alias("input_ids"))
    t = batching.collated(t.withColumn("labels", sets.masked(F.col("input_ids"), first=F.lit(1))), "doc_id", 32)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    attended = total("attention_mask")
    return t.select("doc_id", "batch", "place", "width", (F.col("width") - attended.cast("int")).alias("n_pad"), total("input_ids").alias("ids"), attended.alias("attended"), total("labels").alias("labels"))


@query("v4_masked_v5_padded", "SELECT doc_id, array_to_string(list_concat([-100, 2, -100, CAST(doc_id % 7 AS INTEGER)], CASE WHEN doc_id % 2 = 0 THEN [-100, -100] ELSE [] END), ',') AS labels FROM documents")
def _v4(spark: SparkSession, d: str) -> DataFrame:
    base = F.array(F.lit(1), F.lit(2), F.lit(9), (F.col("doc_id") % 7).cast("int"))
    labels = sets.padded(sets.masked(base, F.array(F.lit(9)), F.lit(1)), F.when(F.col("doc_id") % 2 == 0, 6).otherwise(4))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


@query("m1_min_max_s10_geometry", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor((x::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) * 255) AS INTEGER))) AS BIGINT) AS total, 896 AS new_w, 448 AS new_h, 224 AS top FROM embeddings")
def _m1(spark: SparkSession, d: str) -> DataFrame:
    g = sets.square_geometry(F.lit(1000), F.lit(500))
    px = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(sets.min_max_bytes(px), F.lit(0).cast("long"), lambda a, x: a + x)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", total.alias("total"), g["new_w"].alias("new_w"), g["new_h"].alias("new_h"), g["top"].alias("top"))


@query("m3_sigmoid_m5_class", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 9) AS s, CASE WHEN list_position(embedding[1:4], list_max(embedding[1:4])) IN (2, 4) THEN 1 ELSE 0 END AS label FROM embeddings")
def _m3(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(sets.sigmoid(e[0].cast("double")), 9).alias("s"), sets.class_label(F.slice(e, 1, 4)).alias("label"))


@query("m4_pooled", "SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first FROM (SELECT vec_id, list_transform(list_zip(a, b), lambda x: (x[1] + x[2]) / 2) AS m FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS a, list_transform(list_reverse(e), lambda x: x / sqrt(list_dot_product(e, e))) AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))")
def _m4(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", sets.normalised(F.col("embedding")).alias("a"), sets.normalised(F.reverse("embedding")).alias("b"))
    return e.select("vec_id", F.round(sets.pooled(F.array("a", "b"))[0], 6).alias("first"))


@query("m8_prefixed", "SELECT event_id, event_type AS kept FROM events")
def _m8(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("rad_a"), F.col("event_type"), F.lit("other"), F.lit("x"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", sets.with_prefix(m, "rad_")["rad_a"].alias("kept"))


@query("s11_image_reader", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 'png' ELSE 'dicom' END AS reader FROM documents")
def _s11(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", io.image_reader(F.when(F.col("doc_id") % 3 == 0, " Synthetic_PNG"), F.when(F.col("doc_id") % 2 == 0, "a.png").otherwise(" ")).alias("reader"))


from reportloom.plans import table_queries, text_queries  # noqa: E402, F401  they put down the rest
