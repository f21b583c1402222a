"""Sections of reports and of generated texts, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportloom.functions.text import WS, bind, compact_lines, literal_one_line, one_line, strip, strip_special, sub, text

# Section names by priority.
SECTIONS = {
    "indication": ("INDICATION", "HISTORY", "CLINICAL HISTORY", "REASON FOR EXAM", "EXAMINATION"),
    "findings": ("FINDINGS",),
    "impression": ("IMPRESSION",),
}
_NEXT_HEADER = rf"^{WS}*[A-Z][A-Z0-9 /\-()]+?{WS}*:"


def section(report: Column | str, names: tuple[str, ...]) -> Column:
    """The body of the first name that has a header at a line's start, up to the next header or the end.

    A header that is there but has no body gives '' and doesn't fall through to the next name.
    """
    t = sub(text(report), r"\r\n?", "\n")
    out = F.lit("")
    for name in reversed(names):
        pattern = rf"(?imsdU)^{WS}*{re.escape(name)}{WS}*:{WS}*(.*?)(?={_NEXT_HEADER}|\z)"
        out = F.when(t.rlike(pattern), one_line(F.regexp_extract(t, pattern, 1))).otherwise(out)
    return out


def sections(report: Column | str) -> dict[str, Column]:
    """Indication, findings and impression."""
    return {k: section(report, v) for k, v in SECTIONS.items()}


def split_prediction(generated: Column | str, form=text) -> tuple[Column, Column]:
    """T25 (form=filter_form: T26): findings and impression of a generated text, at its first impression marker."""
    t = sub(strip(form(generated)), rf"^(?:{WS}|[/\\|])+", "")
    marker = rf"(?iU)\bimpression{WS}*:{WS}*"
    at = F.regexp_instr(t, F.lit(marker))
    n = F.length(F.regexp_extract(t, marker, 0))
    findings = F.when(at > 0, strip(F.substr(t, F.lit(1), at - 1))).otherwise(t)
    impression = F.when(at > 0, strip(F.substr(t, at + n))).otherwise(F.lit(""))
    return findings, impression


# Spellings of the impression header in generated texts.
HEADER_FORMS = r"\b(?:IMPRESSION(?:\s*[_-]\s*(?:REVISED|REV|FINAL|OUTPUT|\d+))?|IMPRESSION_REVISED|IMPRESSION_|IMPRESSIONS|IMPRESS\s+ION|IMPREESSION|IMPESSION|IMPRESION|IMPRISSION|IMPRESSSION|IMPRSSION|IMPRSSON|IMPRSSIONS|IMMPRESSION)\b"
_IMPRESSION_HEADER = HEADER_FORMS.replace(r"\s", WS)


def parse_two_lines(generated: Column | str) -> tuple[Column, Column]:
    """Findings and impression of an answer in two lines; ('', '') unless both have three characters."""
    x = two_lines(generated)
    return x.findings, x.impression


def two_lines(generated: Column | str) -> Column:
    """T27 as struct(findings, impression): as a column of its own it is made once for both."""

    def begun(t: Column) -> Column:
        start = F.regexp_instr(t, F.lit(r"(?iU)\bFINDINGS?\b"))
        t = F.when(start > 0, F.substr(t, start)).otherwise(t)
        t = sub(t, rf"\bFINDINGS?{WS}*[.;:\-]+", "FINDINGS:", "(?iU)")
        t = sub(t, _IMPRESSION_HEADER, "IMPRESSION", "(?iU)")
        return sub(t, rf"\bIMPRESSION{WS}*[.;:\-]+", "IMPRESSION:", "(?iU)")

    def parts(t: Column) -> Column:
        both = rf"(?isU)\bFINDINGS{WS}*[:\-]{WS}*(.*?){WS}*\bIMPRESSION{WS}*[:\-]{WS}*(.*)"
        first = strip(F.regexp_extract(t, both, 1))
        line = strip(F.split(strip(F.regexp_extract(t, both, 2)), "\n")[0])
        second = strip(F.split(line, rf"(?iU)\bFINDINGS?\b{WS}*[:\-]")[0])
        bullet = rf"^{WS}*([-*]|\d+\)|\d+\.){WS}+"
        return F.struct(*[strip_special(sub(x, bullet, "", "(?mdU)")).alias(n) for n, x in (("findings", first), ("impression", second))])

    def told(x: Column) -> Column:
        ok = (F.length(x.findings) >= 3) & (F.length(x.impression) >= 3)
        return F.struct(*[F.when(ok, x[n]).otherwise(F.lit("")).alias(n) for n in ("findings", "impression")])

    marked = sub(compact_lines(generated), "<think>.*?</think>", " ", "(?isU)")
    return bind(marked, lambda m: bind(begun(m), lambda t: bind(parts(t), told)))


def impression_of(full: Column | str) -> Column:
    """What follows the impression marker, up to a findings marker; all of it without one."""
    t = F.translate(text(full), "\r", "\n")
    marker = rf"(?isU)\bimpression{WS}*[:\-]{WS}*(.*)\z"
    body = strip(F.split(strip(F.regexp_extract(t, marker, 1)), rf"(?isU)\bfindings{WS}*[:\-]")[0])
    return F.when(t.rlike(marker), body).otherwise(strip(t))


def embedding_text(full: Column | str, part: str = "impression", strict: bool = True) -> Column:
    """The text that is embedded. strict: the whole line, as the markers are never found; otherwise the named part."""
    t = literal_one_line(full)
    if strict:
        return t
    marker = rf"(?iU)\bimpression{WS}*:{WS}*"
    at, n = F.regexp_instr(t, F.lit(marker)), F.length(F.regexp_extract(t, marker, 0))
    return F.when(at > 0, one_line(F.substr(t, at + n) if part == "impression" else F.substr(t, F.lit(1), at - 1))).otherwise(t)
