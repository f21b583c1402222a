"""Quality rules with cross-document line frequency, in DataFrame and SQL functions only.

Base rules look at one text. The line rule hashes normalised lines (ASCII white space collapsed, lower case), counts in how
many distinct documents of a host each occurs (or distinct texts, where copies are left to a later stage), removes lines above
both limits from the texts, and rejects documents that this depletes. Hosts, lines and documents are aggregated before they are exchanged, so a line that most texts of a host share is a few
rows a task; the join that marks lines back may be split by AQE, as its other side has one row a key. Lines above a share of
5 % are at most 20 times the mean number of lines of a document of the host.

Defined results: a null text counts as empty and fails the base rules; null hosts form one host; null ids are one id; rows
that repeat an id and host are judged each on its own text; an empty table gives an empty result; input columns travel in the
struct `row`, so none of their names can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_DOCS, MIN_SHARE_PERCENT = 10, 5
MAX_REMOVED_PERCENT = 75

_S = r"[\\x20\\x09-\\x0D]"


def let(name: str, value: str, body: str) -> str:
    """SQL in which value is computed once and called name; a plain column may be computed again for each element of a lambda."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_REPEATS = let(
    "g",
    let("w", "_words", f"IF(size(w) >= {WINDOW}, transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'w[i + {k}]' for k in range(WINDOW))})), array())"),
    "IF(size(array_distinct(g)) = size(g), 0L, "
    + let(
        "s",
        "array_sort(transform(g, (h, i) -> struct(h AS h, i AS i)))",
        let(
            "p",
            "array_sort(transform(filter(s, (e, k) -> coalesce(get(s, k - 1).h = e.h, false) OR coalesce(get(s, k + 1).h = e.h, false)), e -> e.i))",
            f"aggregate(sequence(1, size(p) - 1), {WINDOW}L, (a, k) -> a + least({WINDOW}, p[k] - p[k - 1]))",
        ),
    )
    + ")",
)

_COLUMNS = {
    "n_words": "CAST(size(_words) AS BIGINT)",
    "word_chars": "CAST(length(array_join(_words, '')) AS BIGINT)",
    "n_symbols": "CAST(length(_t) - length(regexp_replace(_t, '[#*$%&|<>]', '')) AS BIGINT)",
    "n_dup_lines": let("l", f"filter(split(_t, '\\n'), x -> length(btrim(x, ' \\t\\n\\u000b\\f\\r')) > 0)", "CAST(size(l) - size(array_distinct(l)) AS BIGINT)"),
    "n_repeat_words": _REPEATS,
}
#: (hash of the normalised line, words in it) of each line with a word.
_LINES = f"transform(filter(transform(split(_t, '\\n'), x -> lower(btrim(regexp_replace(x, '{_S}+', ' '), ' '))), x -> x <> ''), x -> struct(xxhash64(x) AS h, size(split(x, ' ')) AS n))"


def base_metrics(docs: DataFrame, host: str = "source") -> DataFrame:
    """row (the input columns), doc_id, _host, _t (the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col(f"`{host}`").alias("_host"), text.alias("_t"))
    out = out.withColumn("_words", F.expr(f"array_remove(split(_t, '{_S}+'), '')"))
    out = out.withColumns({k: F.expr(v) for k, v in _COLUMNS.items()})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words")


COUNTED = ("documents", "texts")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share_percent: int = MIN_SHARE_PERCENT, count: str = "documents") -> DataFrame:
    """(_host, h, n_docs): lines in more than min_docs distinct documents (ids), or distinct texts, of a host and more than min_share_percent of them."""
    if count not in COUNTED:
        raise ValueError(f"count is one of {COUNTED}")
    texts = docs.select(F.col(f"`{host}`").alias("_host"), F.col("doc_id").alias("_d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    texts = texts.withColumn("_d", F.xxhash64("_t")) if count == "texts" else texts
    lines = texts.select("_host", "_d", F.explode(F.array_distinct(F.expr(_LINES + ".h"))).alias("h"))
    counts = lines.distinct().groupBy("_host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = texts.select("_host", "_d").distinct().groupBy("_host").agg(F.count("*").alias("_of")).withColumnRenamed("_host", "_h")
    return counts.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).where(100 * F.col("n_docs") > min_share_percent * F.col("_of")).select("_host", "h", "n_docs")


def apply_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share_percent: int = MIN_SHARE_PERCENT, count: str = "documents") -> DataFrame:
    """row (the input columns), doc_id, the base metrics, n_removed_words, base_failed, kept, and clean_text: the text without frequent lines."""
    based = base_metrics(docs, host).withColumn("_lines", F.expr(_LINES))
    lines = docs.select(F.col("doc_id").alias("_i"), F.col(f"`{host}`").alias("_h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    lines = lines.select("_i", "_h", F.explode(F.array_distinct(F.expr(_LINES + ".h"))).alias("_lh"))
    often = frequent_lines(docs, host, min_docs, min_share_percent, count)
    marked = lines.join(often, (F.col("_lh") == F.col("h")) & F.col("_h").eqNullSafe(F.col("_host"))).groupBy("_i", "_h").agg(F.collect_set("h").alias("_often"))
    out = based.join(marked, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("_host").eqNullSafe(F.col("_h")), "left")
    removed = F.expr("IF(_often IS NULL, 0L, aggregate(_lines, 0L, (a, x) -> a + IF(array_contains(_often, x.h), x.n, 0)))")
    out = out.withColumn("n_removed_words", removed)
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < MIN_WORDS) | (100 * F.col("n_removed_words") > MAX_REMOVED_PERCENT * F.col("n_words")))
    clean = F.expr(f"IF(_often IS NULL, row.text, array_join(filter(split(_t, '\\n'), x -> NOT array_contains(_often, xxhash64(lower(btrim(regexp_replace(x, '{_S}+', ' '), ' '))))), '\\n'))")
    return out.withColumns({"kept": ~F.col("base_failed") & ~depleted, "clean_text": clean}).drop("_t", "_lines", "_host", "_i", "_h", "_often")


def op2(docs: DataFrame) -> DataFrame:
    names = ["doc_id", *_COLUMNS, "base_failed", "n_removed_words", "kept"]
    return apply_rules(docs.select("doc_id", "text", "source")).select(*names)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS c FROM g),
p AS (SELECT r, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -5) AS step FROM h WHERE c > 1),
rep AS (SELECT r, CAST(sum(least(5, step)) AS BIGINT) AS n FROM p GROUP BY r),
raw AS (SELECT r, coalesce(CAST(doc_id AS VARCHAR), '') AS i, source, unnest(string_split(t, chr(10))) AS l FROM d),
ln AS (SELECT r, i, source, l, lower(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' ')) AS n FROM raw),
lw AS (SELECT * FROM ln WHERE n <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY r),
ho AS (SELECT source, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS c FROM d GROUP BY source),
fr AS (SELECT lw.source, n FROM lw JOIN ho ON lw.source IS NOT DISTINCT FROM ho.source GROUP BY lw.source, n, ho.c
  HAVING count(DISTINCT i) > 10 AND 100 * count(DISTINCT i) > 5 * ho.c),
rem AS (SELECT r, CAST(sum(len(string_split(lw.n, ' '))) AS BIGINT) AS n FROM lw JOIN fr ON lw.n = fr.n AND lw.source IS NOT DISTINCT FROM fr.source GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(rem.n, 0) AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rem USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR 100 * n_removed_words > 75 * n_words)) AS kept FROM b
"""
