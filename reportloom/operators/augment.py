"""Text augmentation: alternatives per study, the training view, and the structural bank."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.config import image_recipe
from reportloom.functions import text as T
from reportloom.functions.twister import change_plans, coin_and_choice
from reportloom.operators import gates, graphs
from reportloom.operators.select import det_rand, first_per, integer_key
from reportloom.session import cut, scratch, ship


def alternatives(df: DataFrame, key: str, value: str, order: str | Column, keep_newlines: bool = False) -> DataFrame:
    """(study_key, alts): each key's clean texts, blanks dropped, the first of equals kept, in order."""
    clean = T.augmented_target(value) if keep_newlines else T.norm_one_line(value)
    rows = df.where(F.col(key).isNotNull()).select(integer_key(F.col(key)).alias("study_key"), clean.alias("t"), (F.col(order) if isinstance(order, str) else order).alias("o")).where("t <> ''")
    first = rows.groupBy("study_key", "t").agg(F.min("o").alias("o"))
    return first.groupBy("study_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x.t).alias("alts"))


def structural_map(df: DataFrame, order: str = "ord") -> DataFrame:
    """P3 for a structural bank: texts from both sections if there, else aug_full; line ends are kept."""
    if {"aug_findings", "aug_impression"} <= set(df.columns):
        return alternatives(df.withColumn("_t", T.sectioned_target("aug_findings", "aug_impression")), "study_id", "_t", order, True)
    return alternatives(df, "study_id", "aug_full", order, True)


def paraphrase_map(df: DataFrame, order: str = "cand_id") -> DataFrame:
    """P3 for paraphrases: study_id or ex_id, cand_full or aug_full; other columns raise ValueError."""
    key = next((c for c in ("study_id", "ex_id") if c in df.columns), None)
    value = next((c for c in ("cand_full", "aug_full") if c in df.columns), None)
    if key is None or value is None:
        raise ValueError("needs study_id or ex_id, and cand_full or aug_full")
    return alternatives(df, key, value, order)


def laid_out(df: DataFrame, key: str | None = None, buckets: int = 200) -> DataFrame:
    """Df as a table in the shared folder, bucketed and sorted by study_key (with a key: the integer form of that column, added).

    Tables of as many buckets join on study_key without an exchange: a map of alternatives is laid out once and joined in every epoch.
    Each bucket is one task's, so a key's rows stand together; a map has one row a key. Choose buckets by the larger table's bytes.
    """
    rows = df.withColumn("study_key", integer_key(F.col(key))) if key else df
    name, spark = f"laid_out_{uuid.uuid4().hex}", df.sparkSession
    rows.repartition(buckets, "study_key").write.bucketBy(buckets, "study_key").sortBy("study_key").option("path", scratch(spark)).saveAsTable(name)
    return spark.table(name)


def training_view(df: DataFrame, alts: DataFrame | None = None, apply_p: float = 0.0, seed: int = 0, index: str = "study_id", form: str | None = None, eos: str | None = None, is_train: bool = True, draws: str = "portable") -> DataFrame:
    """V1, M9: prompt, target, used_aug and full_text of each row; the coin falls for a text if its number is at most apply_p.

    draws: portable, by whole-number arithmetic; sequential, those of random.Random(seed * 1000003 + index).
    A df with a study_key (laid_out) is joined on that, without an exchange if both sides are laid out; it isn't among the results.
    """
    if draws not in ("portable", "sequential"):
        raise ValueError(f"draws are portable or sequential, not {draws}")
    p = apply_p if is_train else 0.0
    rows = df.withColumnRenamed("study_key", "_k") if "study_key" in df.columns else df.withColumn("_k", integer_key(F.col("study_id")))
    rows = rows.join(alts.withColumnRenamed("study_key", "_k"), "_k", "left") if alts is not None else rows.withColumn("alts", F.lit(None).cast("array<string>"))
    n = F.coalesce(F.size("alts"), F.lit(0))
    if draws == "sequential":
        rows = rows.withColumn("_d", coin_and_choice(F.lit(seed * 1_000_003) + F.col(index), n))
        u, at = F.col("_d.u"), F.col("_d.pick")
    else:
        u, at = det_rand(F.col(index), seed), F.floor(det_rand(F.col(index), seed + 1) * n)
    used = (n > 0) & F.lit(p > 0) & (u <= p)
    pick = F.try_element_at("alts", (at + 1).cast("int"))
    target = F.when(used, T.ended(T.augmented_target(pick), eos)).otherwise(T.target("ref_findings", "ref_impression", form, eos))
    out = rows.withColumns({"prompt": T.prompt("indication"), "used_aug": used, "target": target})
    between = F.when(T.on_new_line("target"), F.lit("\n")).otherwise(F.lit(" "))
    return out.withColumn("full_text", F.concat("prompt", between, "target")).drop("_k", "alts", "_d")


def chat_view(view: DataFrame) -> DataFrame:
    """V2: the training view as two messages; the image mark is taken from the prompt."""

    def message(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    asked = T.one_line(F.replace(F.col("prompt"), F.lit("<start_of_image>"), F.lit("")))
    return view.withColumn("messages", F.array(message("user", part("image", F.lit(None).cast("string")), part("text", asked)), message("assistant", part("text", F.col("target")))))


# ---------------------------------------------------------------- structural changes

#: The changes, each of which leaves the words as they are; a text's draws say in which order they are tried.
CHANGES = ("shuffle", "to_paragraph", "to_list", "points")
MERGED, STYLES = 0.35, 3


def in_drawn_order(parts: Column, key: Column, seed: int) -> Column:
    """An array in a repeatable random order: by a number drawn for each place, then by place."""
    drawn = F.transform(parts, lambda x, i: F.struct(det_rand(key * 64 + i, seed).alias("u"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(drawn), lambda e: e.x)


def _joined(parts: Column, pick: Column) -> Column:
    """Sentences in one of three styles."""
    return F.when(pick == 0, T.join_sentences(parts, 0, True)).when(pick == 1, T.join_sentences(parts, 1, True)).otherwise(T.join_sentences(parts, 2, True))


def _mixed(parts: Column, key: Column, seed: int) -> Column:
    """Sentences in another order, now and then with short ones merged, joined in a drawn style; '' where one depends on another."""
    pick = F.floor(det_rand(key * 64 + 62, seed) * STYLES)
    new = T.bind(in_drawn_order(parts, key, seed), lambda p: F.when(det_rand(key * 64 + 61, seed) < MERGED, T.merge_short(p, normal=True)).otherwise(p))
    return F.when(T.can_shuffle(parts), T.bind(new, lambda p: _joined(p, pick))).otherwise("")


def _others(t: Column, parts: Column, listed: Column) -> tuple[Column, Column, Column]:
    """The changes but the first, '' where one isn't made."""
    return (
        F.when(listed & (F.size(parts) > 0), T.join_sentences(parts, 1, True)).otherwise(""), F.when(listed | (F.size(parts) < 2), "").otherwise(T.join_sentences(parts, 3, True)),
        T.sub(t, rf"{T.WS}+([,.;])", "$1"),
    )


def _new(made: Column, t: Column) -> Column:
    """What a change made, in normal form; null where it is empty or the text as it was."""
    return T.bind(T.keep_newlines(made), lambda y: F.when((y != "") & (y != t), y))


def change(c: Column | str, key: Column, seed: int = 42) -> Column:
    """Of four changes in drawn order - sentences mixed, list to paragraph, paragraph to list, blanks before points - the first that changes the text. key: a whole number for each text and attempt, below 50 million.

    The text is cut into sentences once, and a change is made only where those before it changed nothing.
    """

    def of(x: Column) -> Column:
        t, parts, listed = x.t, x.parts, x.listed
        made = (_mixed(parts, key, seed), *_others(t, parts, listed))

        def attempt(found: Column, n: Column) -> Column:
            new = F.lit("")
            for k, one in enumerate(made):
                new = F.when(n == k, one).otherwise(new)
            return F.when(found.isNotNull(), found).otherwise(_new(new, t))

        order = in_drawn_order(F.array(*[F.lit(k) for k in range(len(CHANGES))]), key, seed + 1)
        return F.coalesce(F.aggregate(order, F.lit(None).cast("string"), attempt), t)

    def cut(t: Column) -> Column:
        return T.bind(F.struct(t.alias("t"), T.split_sentences(t).alias("parts"), T.lists(t).alias("listed")), of)

    return T.bind(T.keep_newlines(c), cut)


def _prepared(c: Column | str) -> Column:
    """What a text's drawn changes are made of: the text in normal form, its sentences, whether they may be mixed, and the other changes' results."""

    def of(x: Column) -> Column:
        return F.struct(x.t.alias("t"), x.parts.alias("parts"), T.can_shuffle(x.parts).alias("mixes"), F.array(*[_new(y, x.t) for y in _others(x.t, x.parts, x.listed)]).alias("others"))

    return T.bind(T.keep_newlines(c), lambda t: T.bind(F.struct(t.alias("t"), T.split_sentences(t).alias("parts"), T.lists(t).alias("listed")), of))


def _as_drawn(x: Column, key: Column, seed: int) -> Column:
    """T16 of a prepared text with portable draws, as `change` makes it."""

    def attempt(found: Column, n: Column) -> Column:
        return F.when(found.isNotNull(), found).when(n == 0, F.when(x.mixes, _new(_mixed(x.parts, key, seed), x.t))).otherwise(F.get(x.others, n - 1))

    order = in_drawn_order(F.array(*[F.lit(k) for k in range(len(CHANGES))]), key, seed + 1)
    return F.coalesce(F.aggregate(order, F.lit(None).cast("string"), attempt), x.t)


def _as_planned(x: Column, plan: Column) -> Column:
    """T16 of a prepared text with the draws of a plan (twister.change_plans)."""
    placed = F.transform(plan.places, lambda i: F.get(x.parts, i))
    mixed = _new(T.bind(F.when(plan.merged, T.merge_short(placed, normal=True)).otherwise(placed), lambda p: _joined(p, plan.style)), x.t)

    def attempt(found: Column, n: Column) -> Column:
        return F.when(found.isNotNull(), found).when(n == 0, F.when(plan.places.isNotNull(), mixed)).otherwise(F.get(x.others, n - 1))

    return F.coalesce(F.aggregate(plan.order, F.lit(None).cast("string"), attempt), x.t)


def _sequential_attempts(df: DataFrame, tries: int, seed: int) -> DataFrame:
    rows = df.withColumns({"_f": _prepared("findings"), "_i": _prepared("impression")})

    def text(x: str) -> tuple[Column, Column, Column]:
        sentences = F.when(F.col(f"{x}.mixes"), F.size(f"{x}.parts")).otherwise(0)
        return F.col(f"{x}.t") != "", sentences, F.transform(f"{x}.others", lambda y: y.isNotNull())

    generator = F.lit(seed) + F.pmod(F.col("study_id").cast("long"), F.lit(10_000_000))
    # kept, so that what is prepared is made once, and no Python function stands within what follows
    rows = cut(rows.withColumn("_p", change_plans(generator, [text("_f"), text("_i")], tries, len(CHANGES), MERGED, STYLES)))
    turns = [F.struct(_as_planned(F.col("_f"), F.col("_p")[2 * k]).alias("af"), _as_planned(F.col("_i"), F.col("_p")[2 * k + 1]).alias("ai")) for k in range(tries)]
    return rows.withColumn("attempts", F.array(*turns)).drop("_f", "_i", "_p")


def change_attempts(df: DataFrame, tries: int = 5, seed: int = 42, draws: str = "portable") -> DataFrame:
    """Rows (study_id, findings, impression) with attempts: array of (af, ai).

    draws: portable, each attempt has draws of its own by whole-number arithmetic; sequential, all attempts of a study, its
    findings and impression in turn, draw from one random.Random(seed + study_id % 10 million).
    """
    if draws not in ("portable", "sequential"):
        raise ValueError(f"draws are portable or sequential, not {draws}")
    if draws == "sequential":
        return _sequential_attempts(df, tries, seed)
    if tries > 16:
        raise ValueError("at most 16 attempts")
    # what is prepared is made once a text, for all attempts
    rows = df.withColumns({"_f": _prepared("findings"), "_i": _prepared("impression")})
    return rows.withColumn("attempts", F.transform(_numbers(tries), lambda k: _portable_attempt(k, seed))).drop("_f", "_i")


def _numbers(tries: int) -> Column:
    return F.array(*[F.lit(k) for k in range(tries)]).cast("array<int>")


def attempt_key(study: Column, k: Column | int) -> Column:
    """The key of the draws for a study's findings in an attempt; those for its impression have the next."""
    return study.cast("long") % 1_000_000 * 32 + 2 * k


def _portable_attempt(k: Column, seed: int) -> Column:
    """(af, ai): an attempt on the prepared texts _f and _i."""
    key = attempt_key(F.col("study_id"), k)
    return F.struct(_as_drawn(F.col("_f"), key, seed).alias("af"), _as_drawn(F.col("_i"), key + 1, seed).alias("ai"))


_AGREEMENT = ("ent_p", "ent_r", "rel_p", "rel_r")


def structural_bank(df: DataFrame, tries: int = 5, seed: int = 42, max_delta: int = 800, draws: str = "portable", annotator: Callable[[DataFrame], DataFrame] | None = None, limits: gates.Limits = gates.STRUCTURAL) -> tuple[DataFrame, DataFrame]:
    """(bank, reasons): each study's best attempt that passes all gates, and the counts of what was rejected.

    Attempts go through the gates as rows. An annotator takes rows (_row, src, cand), those that passed the other gates, and
    gives (_row, ref_ann, hyp_ann): attempts whose entities and relations don't agree are rejected (rg_ and the reason), and of
    the others the one of the highest score is best, the first of equals. Without one the first passing attempt is best.
    """
    rows = df.select("study_id", T.one_line("ref_findings").alias("findings"), T.one_line("ref_impression").alias("impression"))
    empty = rows.where("findings = '' OR impression = ''").select(F.lit("empty_ref").alias("reason"))
    full = rows.where("findings <> '' AND impression <> ''")
    # what depends on the source is computed once a study, before its attempts become rows
    tried = (full.withColumns({"_f": _prepared("findings"), "_i": _prepared("impression")}) if draws == "portable" else change_attempts(full, tries, seed, draws)).withColumn("source", T.sectioned_target("findings", "impression"))
    tried = tried.withColumn("s", T.filter_form("source"))
    tried = tried.withColumn("named", gates.named_words(F.col("s")))
    # attempts and candidates are in the form T2
    rules = lambda cand, c: gates._first((cand == "", "empty_cand"), (F.col("s") == c, "identical"), (F.abs(F.length("s") - F.length(c)) > max_delta, "len_delta"), (F.col("named") != gates.named_words(c), "quick_safety"))

    def judged(k: Column) -> Column:
        """Attempt k with its candidate and the gates' reason."""

        def of(a: Column) -> Column:
            cand = T.sectioned_target(a.af, a.ai, True)
            return T.bind(cand, lambda y: F.struct(k.alias("attempt"), a.af.alias("af"), a.ai.alias("ai"), y.alias("cand"), T.bind(T.one_line(y), lambda c: rules(y, c)).alias("reason")))

        return T.bind(_portable_attempt(k, seed) if draws == "portable" else F.get("attempts", k), of)

    # attempts become rows with their verdicts: a filter on these doesn't make them again
    every = tried.select("study_id", "source", F.inline(F.transform(_numbers(tries), judged)))
    rejected = every.where("reason <> 'ok'").select("reason")
    nothing = F.lit(None).cast("double")
    if annotator is None:
        # no attempt is made after one that passes
        first = F.aggregate(_numbers(tries), F.lit(None).cast("struct<attempt:int,af:string,ai:string,cand:string,reason:string>"), lambda found, k: F.when(found.isNotNull(), found).otherwise(T.bind(judged(k), lambda x: F.when(x.reason == "ok", x))))
        passed = tried.select("study_id", F.inline(F.filter(F.array(first), lambda x: x.isNotNull()))).drop("cand").withColumns({"score": F.lit(0.0), **{x: nothing for x in _AGREEMENT}})
    else:
        # the tried rows are kept, so that all that follows sees the same numbers
        every = cut(every.withColumn("_row", F.monotonically_increasing_id()))
        rejected = every.where("reason <> 'ok'").select("reason")
        passed = every.where("reason = 'ok'")
        found = graphs.overlap(annotator(passed.select("_row", F.col("source").alias("src"), "cand")), "_row")
        x = {k: F.col(k) for k in found.columns}
        found = found.withColumns({"score": gates.candidate_score(x), "rg": gates.entities_kept(x, limits).reason})
        judged = passed.join(found.select("_row", "score", "rg", *_AGREEMENT), "_row")
        rejected = rejected.union(judged.where("rg <> 'ok'").select(F.concat(F.lit("rg_"), "rg")))
        passed = judged.where("rg = 'ok'")
    best = first_per(passed, "study_id", F.desc("score"), "attempt")
    bank = best.select(F.col("study_id").cast("string").alias("study_id"), T.keep_newlines("af").alias("aug_findings"), T.keep_newlines("ai").alias("aug_impression"), T.keep_newlines(T.sectioned_target("af", "ai", True)).alias("aug_full"), *[F.col(x).alias(f"rg_{x}") for x in _AGREEMENT])
    return bank, reject_reasons(empty.union(rejected))


def reject_reasons(rows: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent reasons, then by name."""
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def shuffled_sentences(c: Column, key: Column, seed: int = 0, style: int = 1) -> Column:
    """Sentences in a drawn order if none depends on another."""
    parts = T.sentences(c)
    return F.when(T.can_shuffle(parts), T.keep_newlines(T.join_sentences(in_drawn_order(parts, key, seed), style))).otherwise(T.keep_newlines(c))


def image_augmented(images: DataFrame, factory: Callable[[dict | None], Callable[[bytes], bytes]], mode: str, column: str = "image") -> DataFrame:
    """Images (a binary column) passed through a plug-in, made once a worker from the recipe of a mode; null images stay null."""
    recipe = image_recipe(mode)
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change_image = factory(recipe)
        for f in frames:
            f[column] = [None if x is None else change_image(bytes(x)) for x in f[column]]
            yield f

    return images if recipe is None else images.mapInPandas(run, images.schema)


def evaluation_view(df: DataFrame) -> DataFrame:
    """V3: the five columns that evaluation reads, the study as text; a column that is lacking is ''."""
    return df.select(F.col("study_id").cast("string").alias("study_id"), F.col("dcm_path").cast("string").alias("dcm_path"), *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in ("indication", "ref_findings", "ref_impression")])
