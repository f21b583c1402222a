"""Text functions from Column to Column: normal forms, sentences and bullets, targets and prompts, tokens.

Regular expressions carry (?U), so \\s, \\w and \\b are Unicode-aware, and (?d) with (?m), so that only \\n ends a line; a text's
end is \\z. White space takes in U+001C to U+001F. Null counts as the empty text unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
BULLET = rf"{WS}*(?:[-*\u2022]|\d+[.)]){WS}+"
_LINE_ENDS = r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Words that tie a sentence to another one.
DEPENDENCY_CUES = ("compared to", "comparison", "previous", "prior", "interval", "again", "as before", "therefore", "however", "this", "these", "above")
# Names of the target formats and the end of a target.
TARGET_FORMATS = {"findings": ("findings", "findings only", "findings-only"), "findings + impression": ("findings + impression", "findings and impression", "full", "full report")}
TERMINATOR = " END_REPORT"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def sub(c: Column, pattern: str, to: str, flags: str = "(?U)") -> Column:
    return F.regexp_replace(c, flags + pattern, to)


def bind(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: The characters that WS matches.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def one_line(c: Column | str) -> Column:
    """Trimmed, white space runs to one space."""
    return F.trim(sub(text(c), f"{WS}+", " "))


def _unix(c: Column) -> Column:
    return sub(c, r"\r\n?", "\n")


def keep_newlines(c: Column | str) -> Column:
    """Trimmed, line ends to \\n, zero-width marks dropped, blanks collapsed, at most one empty line on end."""
    t = sub(_unix(strip(text(c))), r"[\u200b-\u200d\ufeff]", "")
    return strip(sub(sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def norm_one_line(c: Column | str) -> Column:
    """T2, then all white space to one space."""
    return one_line(keep_newlines(c))


def filter_form(c: Column | str) -> Column:
    """T4: the form that gates compare."""
    return one_line(F.translate(keep_newlines(c), "\n", " "))


def literal_one_line(c: Column | str) -> Column:
    """T5: T1 that also turns the two characters \\ and n (or r) into a space."""
    return one_line(F.replace(F.replace(_unix(text(c)), F.lit("\\n"), F.lit(" ")), F.lit("\\r"), F.lit(" ")))


def ascii_punctuation(c: Column | str) -> Column:
    """T6, first half: full-width colon, semicolon, stop and comma to ASCII, backslashes before a line end dropped, colons to one."""
    t = _unix(F.translate(text(c), "：﹕；。，", ":::.,"))
    return sub(sub(t, rf"\\+{WS}*\n", "\n"), ":{2,}", ":")


def compact_lines(c: Column | str) -> Column:
    """ASCII punctuation, blanks collapsed, no empty lines."""
    return strip(sub(sub(ascii_punctuation(c), r"[ \t]+", " "), r"\n{2,}", "\n"))


def generation_form(c: Column | str) -> Column:
    """T7."""
    return one_line(F.translate(text(c), "\r\n", "  "))


# ---------------------------------------------------------------- bullets and sentences


def lists(t: Column) -> Column:
    """T10, of a text in the form T2."""
    return t.rlike(rf"(?mdU)^{BULLET}")


def is_bulleted(c: Column | str) -> Column:
    """A line begins with a bullet."""
    return lists(keep_newlines(c))


def strip_bullet(line: Column) -> Column:
    found = rf"(?mdU)^{BULLET}"
    # the first match only: all before it, then all behind it
    at = F.regexp_instr(line, F.lit(found))
    long = F.length(F.regexp_extract(line, found, 0))
    return strip(F.when(at > 0, F.concat(F.substr(line, F.lit(1), at - 1), F.substr(line, at + long))).otherwise(line))


def _items(t: Column) -> Column:
    lines = F.transform(F.split(t, _LINE_ENDS), strip)
    items = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.when(x.rlike(rf"(?U)\A{BULLET}"), strip_bullet(x)).otherwise(x))
    return F.filter(items, lambda x: x != "")


def bullet_items(c: Column | str) -> Column:
    """The non-empty lines, without bullets."""
    return _items(keep_newlines(c))


def split_sentences(t: Column) -> Column:
    """T11, of a text in the form T2."""
    # blanks are single and marks gone in such a text, so its pieces need no more than their ends trimmed
    parts = F.filter(F.transform(F.split(t, rf"(?U)(?<=[.!?]){WS}+(?=[A-Z0-9])|\n+"), strip), lambda x: x != "")
    whole = bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(t)))
    return F.when(t == "", F.array().cast("array<string>")).when(lists(t), _items(t)).otherwise(whole)


def sentences(c: Column | str) -> Column:
    """Bullet items, or pieces between sentence ends before a capital or digit, and lines."""
    return bind(keep_newlines(c), split_sentences)


def _without_period(s: Column) -> Column:
    return strip(sub(strip(s), r"\.+\z", ""))


def _with_period(s: Column) -> Column:
    t = strip(s)
    return F.when(t.rlike(r"[.!?]\z") | (t == ""), t).otherwise(F.concat(t, F.lit(".")))


def join_sentences(parts: Column, style: int = 0, normal: bool = False) -> Column:
    """0 spaces, 1 ended by periods, 2 semicolons, 3 dashed lines. normal: the parts are in the form T2, and none is empty."""
    joined = {
        0: lambda s: F.array_join(s, " "),
        1: lambda s: F.array_join(F.transform(s, lambda x: _with_period(_without_period(x))), " "),
        2: lambda s: F.concat(F.array_join(F.transform(s, _without_period), "; "), F.lit(".")),
        3: lambda s: F.array_join(F.transform(s, lambda x: F.concat(F.lit("- "), _without_period(x))), "\n"),
    }[style]
    kept = parts if normal else F.filter(F.transform(parts, keep_newlines), lambda x: x != "")
    return bind(kept, lambda s: F.when(F.size(s) == 0, F.lit("")).otherwise(joined(s)))


def paragraph_to_bullets(c: Column | str, marker: str = "-") -> Column:
    """Two sentences or more as a list."""
    mark = marker if marker in ("-", "*", "\u2022") else "-"
    listing = lambda s: F.array_join(F.transform(s, lambda x: F.concat(F.lit(f"{mark} "), _without_period(x))), "\n")
    return bind(keep_newlines(c), lambda t: bind(split_sentences(t), lambda s: F.when(F.size(s) < 2, t).otherwise(listing(s))))


def bullets_to_paragraph(c: Column | str) -> Column:
    """T13."""
    return bind(keep_newlines(c), lambda t: bind(_items(t), lambda i: F.when(F.size(i) == 0, t).otherwise(join_sentences(i, 1, True))))


def can_shuffle(parts: Column) -> Column:
    """Two sentences or more, none with a dependency cue."""
    cue = rf"(?iU)\b({'|'.join(DEPENDENCY_CUES)})\b"
    return (F.size(parts) >= 2) & ~F.exists(parts, lambda s: s.rlike(cue))


def merge_short(parts: Column, least: int = 35, normal: bool = False) -> Column:
    """From the left, a sentence and the next become one if either is short; a merged one isn't merged again. normal: as in T12."""
    form = strip if normal else keep_newlines
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, x: Column) -> Column:
        pair = form(F.concat(_without_period(s.held), F.lit("; "), sub(x, rf"^{WS}+", "")))
        short = (F.length(s.held) < least) | (F.length(x) < least)
        return (
            F.when(s.held.isNull(), F.struct(s.done.alias("done"), x.alias("held")))
            .when(short, F.struct(F.concat(s.done, F.array(pair)).alias("done"), F.lit(None).cast("string").alias("held")))
            .otherwise(F.struct(F.concat(s.done, F.array(s.held)).alias("done"), x.alias("held")))
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s.held.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.held))))


def sentence_signature(c: Column | str) -> Column:
    """The multiset of the sentences' plain forms, as a sorted array."""

    def plain(s: Column) -> Column:
        return one_line(F.lower(strip(sub(_without_period(strip_bullet(s)), r"[;:]+\z", ""))))

    return F.array_sort(F.filter(F.transform(sentences(c), plain), lambda x: x != ""))


def sentences_changed(a: Column | str, b: Column | str) -> Column:
    """A sentence was lost, added or doubled."""
    return sentence_signature(a) != sentence_signature(b)


# ---------------------------------------------------------------- targets and prompts


def augmented_target(c: Column | str) -> Column:
    """T2 without empty lines."""
    return sub(keep_newlines(c), r"\n{2,}", "\n")


def on_new_line(c: Column | str) -> Column:
    """The target goes on a line of its own behind a prompt."""
    return bind(augmented_target(c), _breaks)


def _breaks(t: Column) -> Column:
    return F.contains(t, F.lit("\n")) | t.rlike(rf"(?U)\A{BULLET}")


def sectioned_target(findings: Column | str, impression: Column | str, normal: bool = False) -> Column:
    """T20. normal: both are in the form T2."""
    form = (lambda x: sub(x, r"\n{2,}", "\n")) if normal else augmented_target

    def put(x: Column) -> Column:
        f, i = x.f, x.i
        block = F.concat(F.when(_breaks(i), F.lit("impression:\n")).otherwise(F.lit("impression: ")), i)
        between = F.when(_breaks(f), F.lit("\n")).otherwise(F.lit(" "))
        return F.when(i == "", f).when(f == "", block).otherwise(strip(F.concat(f, between, block)))

    return bind(F.struct(form(findings).alias("f"), form(impression).alias("i")), put)


def prompt(indication: Column | str, template: str = "<start_of_image> {indication} findings:") -> Column:
    """Without an indication, pairs of spaces become one."""
    ind = one_line(indication)
    before, _, after = template.partition("{indication}")
    filled = F.concat(F.lit(before), ind, F.lit(after))
    return F.when(ind == "", F.lit((before + after).replace("  ", " ").strip())).otherwise(strip(filled))


def target_format(name: str | None) -> str:
    """The canonical name; an unknown one raises ValueError."""
    plain = (name or "findings + impression").strip().lower().replace("_", " ")
    for canonical, names in TARGET_FORMATS.items():
        if plain in names:
            return canonical
    raise ValueError(f"unknown target format: {name!r}")


def plain_target(findings: Column | str, impression: Column | str, line=one_line) -> Column:
    """T23 (line=literal_one_line) and the body of T22."""
    f, i = line(findings), line(impression)
    return F.when(i == "", f).otherwise(strip(F.concat(f, F.lit(" impression: "), i)))


def target(findings: Column | str, impression: Column | str, form: str | None = None, eos: str | None = None) -> Column:
    """The training target with its terminator."""
    body = one_line(findings) if target_format(form) == "findings" else plain_target(findings, impression)
    return F.concat(body, F.lit(TERMINATOR if eos is None else eos))


def ended(c: Column | str, eos: str | None = None) -> Column:
    """T2 and the terminator, once."""
    end = TERMINATOR if eos is None else eos
    t = keep_newlines(c)
    return F.when(F.endswith(t, F.lit(end)), t).otherwise(F.concat(t, F.lit(end)))


PARAPHRASE_HEAD = (
    "Rewrite the report below in other words. Keep every fact, negation, side, place, degree and change over time as it is; add none and "
    "leave none out. Write as a radiologist would, at about the same length, without names, dates or comments.\n"
    "Answer in exactly two lines:\nFINDINGS: ...\nIMPRESSION: ...\n\nReport\n"
)


def paraphrase_prompt(findings: Column | str, impression: Column | str) -> Column:
    """T24, in words of our own."""
    return F.concat(F.lit(PARAPHRASE_HEAD + "FINDINGS: "), literal_one_line(findings), F.lit("\nIMPRESSION: "), literal_one_line(impression), F.lit("\n"))


# ---------------------------------------------------------------- tokens and forms for scorers


def strip_special(c: Column | str) -> Column:
    """Unused-token tags, <|..|> marks and code fences go."""
    t = sub(text(c), rf"<{WS}*unused\d+{WS}*>|<\|.*?\|>|```.*?```", " ", "(?isU)")
    return one_line(sub(t, rf"<{WS}*unused\d+", " ", "(?isU)"))


def entity_form(c: Column | str) -> Column:
    """Bullets off, line ends and semicolons become sentence ends."""
    t = sub(_unix(strip(text(c))), rf"^{WS}*([-*\u2022]|\d+\)|\d+\.){WS}+", "", "(?mdU)")
    return one_line(sub(F.replace(t, F.lit("\n"), F.lit(". ")), rf"{WS}*;{WS}*", ". "))


def _plain_words(c: Column) -> Column:
    return F.filter(F.split(sub(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def scorer_form(c: Column | str) -> Column:
    """Sentences of two words or more, joined and ended, or a form of two words at least."""
    raw = one_line(F.translate(text(c), "\r\n", "  "))
    parts = F.transform(F.split(raw, rf"(?U)(?<=[.!?]){WS}+"), lambda x: F.btrim(x, F.lit(" ;,")))
    kept = F.filter(parts, lambda x: F.size(_plain_words(x)) >= 2)
    words = _plain_words(raw)
    out = (
        F.when(F.size(kept) > 0, F.trim(F.array_join(kept, ". ")))
        .when(F.size(words) >= 2, F.array_join(words, " "))
        .when(F.size(words) == 1, F.concat(words[0], F.lit(" "), words[0]))
        .otherwise(F.lit("no findings"))
    )
    return F.when(raw == "", F.lit("no findings.")).when(out.rlike(r"[.!?]\z"), out).otherwise(F.concat(out, F.lit(".")))


def unescaped(c: Column | str) -> Column:
    """Backslashes before punctuation go with it kept, other backslashes become spaces."""
    t = sub(F.translate(text(c), "\r\n", "  "), rf"\\([^\w\s\x1c-\x1f])", "$1")
    return one_line(F.translate(t, "\\", " "))


def clean_token(c: Column) -> Column:
    return sub(F.lower(text(c)), "[^a-z0-9]+", "")


def clean_tokens(c: Column) -> Column:
    """The non-empty clean tokens of an array, or of a text split at spaces."""
    return F.filter(F.transform(c, clean_token), lambda x: x != "")


#: A run of letters and digits, or any other character but a backslash. White space is a token, as is the letter s or S in upper case texts.
TOKEN = r"[A-Za-z0-9]+|[^\\sA-Za-z0-9]"
PLAIN_TOKEN = r"[A-Za-z0-9]+|[^ \t-\rA-Za-z0-9]"


def tokens(c: Column | str, strict: bool = True) -> Column:
    """T35; not strict: white space is no token and a backslash is one."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN if strict else PLAIN_TOKEN), F.lit(0))


def ngrams(words: Column, n: int = 4) -> Column:
    """The distinct n-grams, each as words joined by U+0001."""
    return F.array_distinct(runs(words, n))


def runs(words: Column, n: int) -> Column:
    """All n-grams in order, each as words joined by U+0001."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), "\x01"))

    return bind(words, of)


# The steps of the customary tokenizer of machine translation scores (mteval 13a), as (pattern, replacement).
TOKENIZER_13A = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def tokens_13a(c: Column | str) -> Column:
    """Tokens of the 13a tokenizer: marks stand alone, but points and commas between digits and dashes behind none."""
    t = F.replace(F.replace(F.translate(F.replace(F.replace(sub(text(c), r"\s+\z", "", ""), F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), "\n", " "), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    t = F.concat(F.lit(" "), F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit(" "))
    for pattern, to in TOKENIZER_13A:
        t = sub(t, pattern, to, "")
    return F.filter(F.split(t, rf"(?U){WS}+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """T41."""
    return F.regexp_count(text(c), F.lit(r"(?U)\b\w+\b"))


def punctuation_run(c: Column | str) -> Column:
    """struct(len, char) of the longest run of ten or more _ or -, the first of equals; (0, '') without one."""
    runs = F.regexp_extract_all(text(c), F.lit("_{10,}|-{10,}"), F.lit(0))
    none = F.struct(F.lit(0).alias("len"), F.lit("").alias("char"))
    return F.aggregate(runs, none, lambda a, x: F.when(F.length(x) > a.len, F.struct(F.length(x).alias("len"), F.left(x, F.lit(1)).alias("char"))).otherwise(a))


def matched_words(c: Column, words: tuple[str, ...]) -> Column:
    """Which of the words occur, whole and in any case, as a sorted array."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(rf"(?U)\b({'|'.join(words)})\b"), F.lit(1))))


def matched_categories(c: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that occur, as a sorted array."""

    def named(low: Column) -> Column:
        return F.array(*[F.when(low.rlike("(?U)" + p), F.lit(k)) for k, p in patterns.items()])

    return F.array_sort(F.filter(bind(F.concat(F.lit(" "), F.lower(text(c)), F.lit(" ")), named), lambda x: x.isNotNull()))


def artifact_name(c: Column | str) -> Column:
    """Characters unfit for a file name become _, and outer _ and . go."""
    return F.btrim(sub(text(c), "[^A-Za-z0-9_.=-]+", "_", ""), F.lit("._"))
