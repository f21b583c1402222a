"""Candidates: generators and scorers as plug-ins, resumable generation, selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.functions.sections import two_lines
from reportloom.operators import gates
from reportloom.operators.select import best_candidates, not_done
from reportloom.session import cut, ship

#: From prompts to lists of raw answers; made once a worker by the factory that is passed.
Generator = Callable[[list[str]], list[list[str]]]


def rule_generator(k: int = 2) -> Generator:
    """A deterministic stand-in for a model: answers by fixed exchanges of words."""
    exchanges = ((" the ", " this "), (" of ", " within "), (" and ", " as well as "), (" is ", " remains "))

    def run(prompts: list[str]) -> list[list[str]]:
        out = []
        for p in prompts:
            body = p.split("Report\n", 1)[-1]
            answers = []
            for n in range(k):
                t = body
                for a, b in exchanges[n % len(exchanges) :]:
                    t = t.replace(a, b)
                answers.append(t)
            out.append(answers)
        return out

    return run


def generate(prompts: DataFrame, factory: Callable[[], Generator], batch: int = 16) -> DataFrame:
    """Rows (ex_id, prompt) to (ex_id, cand_id, raw, error): batches, and single rows where a batch fails; a row that fails gives cand_id -1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for f in frames:
            rows = []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                try:
                    got: list = model(part["prompt"].tolist())
                except Exception:  # noqa: BLE001  a plug-in may raise anything; each row is then tried alone
                    got = []
                    for p in part["prompt"]:
                        try:
                            got.append(model([p])[0])
                        except Exception as e:  # noqa: BLE001
                            got.append(e)
                for ex, answers in zip(part["ex_id"], got, strict=True):
                    if isinstance(answers, Exception):
                        rows.append((ex, -1, None, f"generator_failed: {answers}"))
                    else:
                        rows += [(ex, n, a, None) for n, a in enumerate(answers)]
            yield pd.DataFrame(rows, columns=["ex_id", "cand_id", "raw", "error"])

    ship(prompts.sparkSession)
    return prompts.select("ex_id", "prompt").mapInPandas(run, "ex_id string, cand_id int, raw string, error string")


def candidates(studies: DataFrame, factory: Callable[[], Generator], scorers: dict, done: DataFrame | None = None, limits: gates.Limits = gates.PARAPHRASE, enabled: frozenset[str] = frozenset({"quick", "lex", "ascii"})) -> DataFrame:
    """P5: candidates of the studies that aren't done, with all verdicts; rows that failed to generate or parse stay, with every gate false."""
    rows = studies.withColumn("ex_id", F.col("study_id").cast("string"))
    rows = not_done(rows, done, "ex_id") if done is not None else rows
    rows = rows.withColumns({"src_full": T.plain_target("ref_findings", "ref_impression", T.literal_one_line), "prompt": T.paraphrase_prompt("ref_findings", "ref_impression")})
    made = generate(rows, factory).join(rows.drop("prompt"), "ex_id")
    made = made.withColumn("_two", two_lines("raw")).withColumns({"aug_findings": F.col("_two.findings"), "aug_impression": F.col("_two.impression")}).drop("_two")
    made = made.withColumn("parsed_ok", F.col("error").isNull() & (F.col("aug_findings") != "") & (F.col("aug_impression") != ""))
    made = made.withColumns({"cand_full": F.when(F.col("parsed_ok"), T.plain_target("aug_findings", "aug_impression", T.literal_one_line)).otherwise(F.lit("")), "row_id": F.concat_ws("/", "ex_id", F.col("cand_id").cast("string"))})
    if {"chex", "rg", "msl"} & enabled:
        # scorers are for rows that parsed; all that was made is kept, so that the generator runs once
        made = cut(made)
        failed = made.where("NOT parsed_ok")
        for name in gates.NAMES:
            failed = failed.withColumns({f"{name}_ok": F.lit(False), f"{name}_reason": F.lit("not_parsed")})
        judged = gates.evaluate(made.where("parsed_ok"), scorers, limits, enabled).unionByName(failed.withColumns({"keep_ok": F.lit(False), "all_filters_pass": F.lit(False)}))
    else:
        parsed = F.col("parsed_ok")
        judged = gates.evaluate(made, scorers, limits, enabled)
        judged = judged.withColumns({f"{name}_{x}": F.when(parsed, F.col(f"{name}_{x}")).otherwise(none) for name in gates.NAMES for x, none in (("ok", F.lit(False)), ("reason", F.lit("not_parsed")))})
        judged = judged.withColumns({x: parsed & F.col(x) for x in ("keep_ok", "all_filters_pass")})
    reason = F.when(F.col("parsed_ok"), F.lit(None).cast("string")).otherwise(F.coalesce("error", F.lit("parse_failed")))
    return judged.withColumn("filter_error", reason).drop("error", "row_id")


def reselect(cands: DataFrame, limits: gates.Limits = gates.PARAPHRASE, **options) -> DataFrame:
    """Gates applied anew, then the best of each example."""
    again = gates.reapply(cands, limits, **options)
    return best_candidates(again if "msl_sim" in again.columns else again.withColumn("msl_sim", F.lit(None).cast("double")))
