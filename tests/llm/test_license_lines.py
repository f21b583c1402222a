"""Copyright lines of licence files: holders without years, wrapped holders, and lines of the licence's own text that look like them."""

from __future__ import annotations

import hashlib
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from reportloom.llm import licenses as L

LINES = [
    "Copyright Joyent, Inc. and other Node contributors.",
    "(c) Some Body",
    "Copyright Contributors to the Z project",
    "Portions Copyright (c) 2011 Y",
    "Portions copyright Some Body",
    "Copyright (c) 2011 The Very Long Name Foundation for Several\nThings and Other Things",
    "Copyright (c) 2011 A\nCopyright Some Body\nPortions Copyright (c) 2012 B, C, D, and\nOthers",
    "Copyright by Some Body",
    "Copyright: Some Body",
    "&copy; Some Body",
    "© Some Body",
    "  * Copyright 2019, Some Body. All rights reserved.",
]


def _known() -> dict[str, str]:
    least: dict[str, str] = {}
    for name, text in L.known_texts():
        d = hashlib.sha256(L.plain_canonical(text).encode()).hexdigest()
        least[d] = min(name, least.get(d, name))
    return least


def _cases() -> list[tuple[str, str | None]]:
    mit, isc = L.KNOWN["MIT (no title)"], L.KNOWN["ISC"]
    whole = dict(L.known_texts())
    cases = [(f"{title}{line}\n\n{mit}", "MIT") for line in LINES for title in ("", "MIT License\n\n")]
    cases += [(f"{line}\n\n{isc}", "ISC") for line in LINES]
    cases += [(f"Copyright Some Body\n{mit}", "MIT"), (f"(c) Some Body\n\n{whole['Apache-2.0']}", "Apache-2.0")]
    cases += [("Copyright Some Body\nReleased under the MIT License.\n\n", "MIT notice"), ("Copyright Some Body", None), ("copyright", None), ("(c)", None), ("", None), ("copyright\nnotice", None)]
    for width in range(30, 100, 5):  # lines of the licence's own text that begin with copyright or (c)
        for name in ("Apache-2.0", "MPL-2.0"):
            text = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in whole[name].split("\n\n"))
            cases.append((text, name))
    return cases


def test_copyright_lines():
    known = _known()
    got = [(known.get(hashlib.sha256(L.plain_canonical(t).encode()).hexdigest()), want, t[:120]) for t, want in _cases()]
    assert [g for g in got if g[0] != g[1]] == []


@pytest.mark.parametrize("word", ["notice", "holder,", "owner", "law.", "license", "and", "interest", ",", '"', "the software"])
def test_own_lines_stay(word):
    text = f"Some text about\ncopyright {word} of the thing\n\nand more"
    assert "copyright" in L.plain_canonical(text)
    assert "you must" in L.plain_canonical("text\n(c) You must retain\n\nmore")


def test_code_and_sql_make_the_same_texts(spark):
    texts = [t for t, _ in _cases()] + ["copyright é", "a\n\x01copyright x", "copyright x\ny\n\n\nz", "copyright x\r\ny\r\n\r\nz", "(c) é\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(docs.select("doc_id", L.canonical(F.col("text"))).collect())
    plain = {i: L.plain_canonical(t) for i, t in enumerate(texts)}
    assert got == plain
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    assert dict(con.execute(f"SELECT doc_id, {L._sql('text')} FROM d").fetchall()) == plain
