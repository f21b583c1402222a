"""License scan by canonical digest, in DataFrame and SQL functions only.

A text is made canonical - lower case, copyright lines dropped, punctuation and white space runs to one space, equivalent
spellings to one - and the digest of the whole canonical text is joined with the digests of known licence texts, which are
made by the same expressions.

Defined results: a null or empty text (or one of copyright lines alone) matches nothing; repeated rows give repeated rows;
null ids stay null; an empty table gives an empty result; other columns are ignored; if two known texts have one digest the
smaller id is reported.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, as licence matching guidelines list them.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
}
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{AB}\x{BB}\x{2010}-\x{201F}\x{2026}]+"
#: Words that go on from "copyright" or "(c)" in a licence's own text, also where a wrapped line begins with them.
_GOES_ON = (
    r"notices?|holders?|owners?|ownership|laws?|licen[cs]es?|permissions?|statements?|treaty|treaties|doctrines?|disclaimers?|interests?|acts?|rights?|protection|"
    r"infringements?|status|and|or|are|is|was|if|on|in|of|to|as|for|under|with|the (?:software|library|program|work)"
)
_ITEM = r"you|the|any|an?|all|in|to|such|each|this|that|these|if|for|by|or|and|of|under|when|where|as|on|it|is|no|not|may|must|shall|with|year|representations|accompany|prohibiting|requiring|limiting|declining"
_MARK = "\x01"
#: Lines that begin a licence's own sentence, and lines with its usual words: they are marked, and marked lines go only by a year, sign or the like.
_OWN = rf"(^|\n)([^a-z0-9\n]*(?:copyright[ \t]*(?:[^a-z0-9 \t\n(©&:<\[{{]|\n|$|(?:{_GOES_ON})(?:[^a-z0-9]|$))|\(c\)[ \t]*(?:\n|$|(?:{_ITEM})(?:[^a-z0-9]|$))))"
_BODY = r"(\n)([^\n]*(?:licen|permission|permitted|redistribut|software|provided|granted))"
#: Copyright lines: those that begin with copyright, portions copyright or (c), and one short line that goes on before an empty one.
_COPYRIGHT = (
    r"(^|\n)(?:[^a-z0-9\n]*(?:all rights reserved|©|\(c\)[ \t:,]*(?:copyright|[0-9]{4}|[<\[{])|"
    r"copyright[ \t:]*(?:\(c\)|©|&copy;|[0-9]{4}|[<\[{])|copyright\b[^\n]*(?:\b(?:19|20)[0-9]{2}\b|all rights reserved))|"
    r"[^a-z0-9\n\x01]*(?:(?:portions[ \t]+(?:are[ \t]+)?)?(?:copyright[ \t:]|\(c\)[ \t])[ \t]*[^ \t\n]|copy;))[^\n]*(?:\n[^\n\x01]{1,80}(\n[ \t]*\n))?"
)
_SPELLED = "(" + "|".join(sorted(SPELLINGS)) + ")"


def canonical(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\r\n?", "\n")
    marked = F.regexp_replace(F.regexp_replace(low, _BODY, f"$1{_MARK}$2"), _OWN, f"$1{_MARK}$2")
    told = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("&copy;") | low.contains("all rights reserved")
    plain = F.btrim(F.regexp_replace(F.when(told, F.regexp_replace(marked, _COPYRIGHT, "$1$2")).otherwise(low), _SEPARATORS, " "), F.lit(" "))
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    return F.when(plain.rlike(_SPELLED), spelled).otherwise(plain)


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id) of licenses (license_id, text)."""
    c = licenses.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''")
    return c.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_chars, digest, license_id (null: none) of each row of docs (doc_id, text).

    The built-in table of digests is broadcast; a table of one's own is joined as the optimiser sees fit.
    """
    if licenses is None:
        known = F.broadcast(known_digests(docs.sparkSession.createDataFrame(known_texts(), "license_id string, text string")))
    else:
        known = known_digests(licenses)
    c = docs.select("doc_id", canonical(F.col("text")).alias("c"))
    c = c.select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("digest"))
    return c.join(known, "digest", "left").select("doc_id", "canonical_chars", "digest", "license_id")


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("is_license", F.col("license_id").isNotNull())


_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

"""

# Public licence texts and short notices.
KNOWN = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\n" + _MIT + _WARRANTY,
    "MIT (no title)": _MIT + _WARRANTY,
    "ISC": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
    "0BSD": f"{_ISC}.\n\n{_ISC_END}",
    "BSD-2-Clause": f"{_BSD2}\n\n{_BSD}",
    "BSD-3-Clause": f"{_BSD2}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}

# Titles that files put before a text, in front of or behind the copyright line.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
_NOTICES = [("MIT notice", "Released under the MIT License.")]
_END = "END OF TERMS AND CONDITIONS"


@cache
def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of KNOWN, the whole texts in license_texts and the usual variants of both."""
    whole = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    found = [*KNOWN.items(), *_NOTICES]
    for name, t in [("MIT", KNOWN["MIT (no title)"]), *((k, KNOWN[k]) for k in ("ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "WTFPL")), *whole]:
        forms = [t]
        if name.startswith("BSD-"):
            numbers = [f"\n{k}. " for k in (1, 2, 3)]
            for to in ("\n* ", *(["\n({}) "] if name == "BSD-3-Clause" else [])):
                x = t
                for k, n in enumerate(numbers, 1):
                    x = x.replace(n, to.format(k))
                forms.append(x)
        forms += [x.replace("and/or distribute", "and distribute") for x in forms if name in ("ISC", "0BSD")]
        forms += [x.split(_END)[0] + _END for x in forms if _END in x]
        forms += [x.replace("http://", "https://") for x in forms]
        found += [(name, x) for x in forms] + [(name, f"{title}\n\n{x}") for title in TITLES.get(name, ()) for x in forms]
    return list(dict.fromkeys(found))


def plain_canonical(text: str) -> str:
    """canonical() of one text, without Spark."""
    low = re.sub(r"\r\n?", "\n", text.lower())
    for pattern, to in ((_BODY, rf"\1{_MARK}\2"), (_OWN, rf"\1{_MARK}\2"), (_COPYRIGHT, r"\1\2")):
        low = re.sub(pattern, to, low)
    plain = re.sub(_PY_SEPARATORS, " ", low).strip(" ")
    return " ".join(SPELLINGS.get(w, w) for w in plain.split(" "))


_PY_SEPARATORS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), _SEPARATORS)


def _sql(text: str) -> str:
    low = rf"regexp_replace(lower(coalesce({text}, '')), '\r\n?', chr(10), 'g')"
    marked = rf"regexp_replace(regexp_replace({low}, '{_BODY}', '\1' || chr(1) || '\2', 'g'), '{_OWN}', '\1' || chr(1) || '\2', 'g')"
    plain = rf"trim(regexp_replace(regexp_replace({marked}, '{_COPYRIGHT}', '\1\2', 'g'), '{_SEPARATORS}', ' ', 'g'), ' ')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items())
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _digests() -> str:
    """The known digests as SQL values, made without Spark or the checking engine."""
    least: dict[str, str] = {}
    for name, text in known_texts():
        d = hashlib.sha256(plain_canonical(text).encode()).hexdigest()
        least[d] = min(name, least.get(d, name))
    return ", ".join(f"('{d}', '{n}')" for d, n in least.items())


ORACLE = f"""
WITH kd(digest, license_id) AS (VALUES {_digests()}),
c AS (SELECT doc_id, {_sql("text")} AS c FROM documents),
d AS (SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, sha256(c) AS digest FROM c)
SELECT doc_id, canonical_chars, digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN kd USING (digest)
"""

_VARIANTS = ("lower({0})", "upper({0})", "concat('Copyright (c) 2020 Some Body', chr(10), {0}, chr(10))", "replace({0}, '.', ' -- ')", "concat({0}, ' and more')")


def variants(docs: DataFrame) -> DataFrame:
    """The short known texts in other cases and punctuation, under new copyright lines and with words added, beside all documents: name, variant, license_id."""
    spark = docs.sparkSession
    texts = spark.createDataFrame(list(KNOWN.items()), "name string, text string")
    rows = None
    for k, v in enumerate(_VARIANTS):
        part = texts.select("name", F.lit(k).alias("variant"), F.expr(v.format("text").replace("chr(", "char(")).alias("text"))
        rows = part if rows is None else rows.union(part)
    every = rows.union(docs.select(F.col("doc_id").cast("string"), F.lit(-1), F.col("text").cast("string")))
    found = scan(every.withColumn("doc_id", F.struct("name", "variant")))
    return found.select("doc_id.name", "doc_id.variant", "license_id")


def _variants_sql() -> str:
    texts = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN.items())
    parts = " UNION ALL ".join(f"SELECT name, {k} AS variant, {v.format('text')} AS text FROM k" for k, v in enumerate(_VARIANTS))
    return f"""
WITH k(name, text) AS (VALUES {texts}), kd(digest, license_id) AS (VALUES {_digests()}),
v AS ({parts} UNION ALL SELECT CAST(doc_id AS VARCHAR), -1, text FROM documents),
d AS (SELECT name, variant, sha256({_sql("text")}) AS digest FROM v)
SELECT name, variant, license_id FROM d LEFT JOIN kd USING (digest)
"""


VARIANTS_ORACLE = _variants_sql()
