"""Chat formatting, HTML extraction and the pipeline against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from reportloom.llm import chat, html

from .fixtures import SCHEMA, documents
from .test_documents_ops import check_sequences, components, words

TURNS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "a <|end|>\\n b \\ <| c"), (1, 2, "assistant", "<|turn|>assistant\nx<|end|>\n"), (1, 3, "assistant", ""), (1, 4, "user", None),
    (2, 0, "assistant", "  leading and trailing  \n\n"), (2, 1, "assistant", "日本語 🙂 é ́"), (2, 1, None, "tie"), (3, 0, "a\nb\\", "odd role"), (None, 0, "assistant", "null id"), (4, 5, "user", "<|endoftext|>"), (4, None, "assistant", "no turn"),
    *[(5, k, ("user", "assistant")[k % 2], f"turn {k} " + "y" * k) for k in range(60)],
]


@pytest.mark.parametrize("segment", [1 << 20, 200])
def test_chat(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", segment)
    got = {r.conv_id: r for r in chat.op4(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")).collect()}
    own = "</s>[INST] ok [/INST]"
    by = {-7: [("user", own), ("assistant", own)]}
    low = lambda v: (v is not None, v if v is not None else 0)
    for c, t, r, x in sorted(TURNS, key=lambda y: (low(y[0]), low(y[1]), y[2] is not None, y[2] or "", y[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == len(chat.render(turns)[0])
    assert chat.op4(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_segments_change_no_ids(spark, monkeypatch):
    """Ids and mask of a conversation are the same in one segment and in many."""

    def whole():
        got = {}
        for r in sorted(chat.format_chats(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.segment):
            ids, loss = got.setdefault(r.conv_id, ([], []))
            ids += r.ids
            loss += r.loss
        return got

    one = whole()
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 60)
    assert whole() == one and any(any(loss) for _, loss in one.values())


def test_loss_mask_brute_force():
    r = np.random.default_rng(6)
    for _ in range(200):
        cuts = np.unique(r.integers(0, 200, 30))
        spans = np.stack((cuts[:-1], cuts[1:]), axis=1)
        edges = np.unique(r.integers(0, 200, 8))[: 2 * (len(np.unique(r.integers(0, 200, 8))) // 2)]
        edges = edges[: len(edges) // 2 * 2]
        starts, ends = edges[::2].tolist(), edges[1::2].tolist()
        mask, lo, hi = chat.loss_mask(spans, starts, ends)
        assert mask.tolist() == [any(a < e and s < b for s, e in zip(starts, ends, strict=True)) for a, b in spans]
        inside = {x for s, e in zip(starts, ends, strict=True) for x in range(s, e) if cuts[0] <= x < cuts[-1]}
        assert {x for a, b in zip(lo, hi, strict=True) for x in range(a, b)} == inside


PAGES = {
    "": "",
    "<p>": "",
    "<html><body><nav><a href=/>Home</a></nav><article><header><h1>Title &amp; more</h1><p>By me, today, and others who wrote this.</p></header><p>First, paragraph  with\n spaces, and more of it.<p>Second &lt;one&gt;, long enough to count, surely.<br>Same block.</article><footer>(c) us</footer></body></html>": "Title & more\nFirst, paragraph with spaces, and more of it.\nSecond <one>, long enough to count, surely. Same block.",
    "<body><div id=menu>Menu, a, b, c, d</div><div class='post'><h2>T</h2><div>Some long text, with commas, in a plain div, that goes on for a while.</div><p>More text, more commas, and yet more words to be counted here.</p><ul><li>item one</li><li>item two</li></ul></div><div class='comments'><p>First! I, for one, like this text very much, and more and more.</p></div><aside>Aside, with, commas, and words, and more words.</aside></body>": "T\nSome long text, with commas, in a plain div, that goes on for a while.\nMore text, more commas, and yet more words to be counted here.\nitem one\nitem two",
    "<article><h1>Cut off</h1><p><b>Bold, unclosed, text that is long enough.<br><p>Next, paragraph, also long enough to count": "Cut off\nBold, unclosed, text that is long enough.\nNext, paragraph, also long enough to count",
    "<body><script>var a='<p>no, no, no, no</p>'</script><style>p{}</style><!-- <p>no</p> --><main><p>Yes, this is the text that should be kept, all of it.</p><form><p>Name, please, and your address, and other things.</p><input></form></main></body>": "Yes, this is the text that should be kept, all of it.",
    "<body><article><p>tiny</p></article><footer>x</footer></body>": "tiny",
}


def test_html(spark):
    rows = [(k, f"u{k}", p) for k, p in enumerate(PAGES)] + [(99, None, None)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, want in enumerate(PAGES.values()):
        assert got[k].text == want and got[k].n_chars == len(want)
    assert got[99].text == ""


_LONG = "Words, and words, and more, " + "of a text that goes on " * 20 + "to, its, end."
_TAIL = "A short part, of some sixty characters, that ends the story."


@pytest.mark.parametrize("n", [2, 12])
@pytest.mark.parametrize(
    "page",
    [
        "<body><article><h1>T</h1><section>{}</section><section><p>{}</p></section></article></body>",
        "<body><main><h1>T</h1><div><div>{}</div></div><div><p>{}</p></div></main></body>",
        "<body><main><h1>T</h1><article><div>{}</div><div>{}</div></article><ul><li><a href=/x>More, and more, of other pages</a></li></ul></main></body>",
        "<body><article><header><h1>T</h1></header><div><section>{}</section></div>{}</article><div><p>Not, of, this, text, but of another, altogether.</p></div></body>",
    ],
)
def test_html_keeps_all_of_an_article(page, n):
    got = html.main_blocks(page.format(f"<p>{_LONG}</p>" * n, _TAIL))
    assert got == ["T", *[_LONG] * n, _TAIL]


def test_html_keeps_title_beside_content():
    assert html.main_blocks(f"<body><h1>T</h1><div><p>{_LONG}</p></div><ul><li><a href=/>Home</a></li></ul></body>") == ["T", _LONG]


_NOISE = "<div class='sidebar'><p>Aside, with, commas, and words, and more words.</p></div><div id='comments'>" + "<p>First! I, for one, like this text very much, and more.</p>" * 2 + "</div>"


@pytest.mark.parametrize("name", ["post has-sidebar", "content-with-sidebar", "no-sidebar", "with-header", "post comments-open", "layout_no_nav", "sidebar-right", "related-layout"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_html_layout_classes(name, tag):
    text = f"<h1>T</h1>{f'<p>{_LONG}</p>' * 3}"
    want = ["T", *[_LONG] * 3]
    for attr in ("class", "id"):
        assert html.main_blocks(f"<body><{tag} {attr}='{name}'>{text}</{tag}>{_NOISE}</body>") == want
        assert html.main_blocks(f"<body><{tag} {attr}='{name}'><article>{text}</article>{_NOISE}</{tag}></body>") == want
        assert html.main_blocks(f"<body><{tag} {attr}='{name}'><div class='post-header'><h1>T</h1></div>{text[10:]}</{tag}>{_NOISE}</body>") == want


def test_html_names_inside_an_article():
    """Words of furniture's in longer names don't take text from an article; names made of them only do."""
    r = __import__("random").Random(2)
    words = ["share", "header", "nav", "social", "related", "comment", "menu", "banner", "login", "ad", "notice", "popup", "footer"]
    for _ in range(60):
        blocks, want = [], []
        for k in range(8):
            text = f"Paragraph {k}, with words, and more words, " + "of a text that goes on " * r.randrange(1, 9)
            name = f"{r.choice(words)}{r.choice('-_')}{r.choice(['price', 'war', 'story', 'figures'])}{r.choice('-_')}{r.choice(['table', 'chart', 'text'])}"
            kind = r.randrange(3)
            blocks.append([f"<div class='{name}'><p>{text}</p></div>", f"<p id='{name}'>{text}</p>", f"<div class='{r.choice(['ad', 'share-buttons', 'related_posts', 'newsletter-signup', 'social-links'])}'><p>{text}</p></div>"][kind])
            want += [" ".join(text.split())] * (kind < 2)
        got = html.main_blocks(f"<body><div class='nav-bar'><p>{_LONG}</p></div><article><h1>T</h1>{''.join(blocks)}</article></body>")
        assert got == ["T", *want]
    for inner in ("<pre>a\n  b, c</pre>", "<details><summary>a b, c</summary></details>", "<noscript><p>no</p></noscript><p>a b, c</p><textarea>no</textarea>"):
        assert html.main_blocks(f"<article><p>{_LONG}</p>{inner}</article>") == [_LONG, "a b, c"]


def test_html_tables_without_rows_and_with_other_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html.extract(spark.createDataFrame([], schema)).columns == ["page_id", "url", "text", "n_chars"] and html.extract(spark.createDataFrame([], schema)).count() == 0
    row = (1, None, f"<p>{_LONG}</p>", "clash", "x")
    got = html.extract(spark.createDataFrame([row, row, (None, "u", "", None, None)], schema)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, _LONG), (1, _LONG)]


def test_html_furniture_by_name_still_goes():
    short = "<p>A short post, of a few words, and that is all.</p>"
    talk = "<p>First! I, for one, like this text very much, and more.</p>" * 50
    for page in (f"<div class='post'><h1>T</h1>{short}</div><div class='comments'>{talk}</div>", f"<article><h1>T</h1>{short}</article><div class='comment-list comments'><article>{talk}</article></div>"):
        assert html.main_blocks(f"<body>{page}</body>") == ["T", "A short post, of a few words, and that is all."]
    assert html.main_blocks(f"<body><div class='sidebar-right'><article><h1>T</h1>{short}</article><div class='comments'><article>{talk}</article></div></div></body>")[0] == "T"


def test_html_survives_anything():
    r = np.random.default_rng(7)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<table><tr><td>", "</table>", "<li>", "text, more text that is long ", "&amp;", "<", ">", "</", "<!--", "-->", "<a href='>'>", "</a>", "<h1>", "<header>", "</header>", "<article>", "<script>", "</script>", "<br/>", '"']
    for _ in range(2000):
        html.main_blocks("".join(r.choice(parts, 30)))


def deduped(rows, length=50):
    """By id: what whole characters are left of each text, but for texts of which nothing is."""
    first = {}
    for i, x, *_ in rows:
        b = x.encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = {}
    for i, x, *_ in rows:
        b = x.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        left, at = "", 0
        for c in x:
            n = len(c.encode())
            left += "" if gone[at : at + n].all() else c
            at += n
        if left or not gone.any():
            out[i] = left
    return out


def test_pipeline(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    rows = list(dict.fromkeys(rows))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    quality = [tuple(r) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()]
    assert all("biscuits" not in r[1] for r in quality) and all(len(words(r[1])) >= 10 for r in quality)
    near = {x[0] for x in components(quality, 5, 8, 10) if x[0] == x[2]}
    table = spark.createDataFrame(quality, SCHEMA)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert {r[0] for r in got} == near and set(got) <= set(quality)
    out = [tuple(r) for r in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(got, SCHEMA), "").collect()]
    want = deduped(got)
    assert {r[0]: r[1] for r in out} == want and all(r[4] == len(r[1]) for r in out)
    assert 0 < sum(want[k] != t for k, t in {r[0]: r[1] for r in got}.items() if k in want)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, text in want.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) and all(r.start == sum(x.length for x in own[:j]) for j, r in enumerate(own))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    assert {r.doc_id for r in pieces} == set(want)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in pieces], 2048, 64)
    assert [c for c in corpus_pipeline.quality_rules(spark, docs, "").columns] == docs.columns


def test_stages_take_clashing_columns_and_empty_tables(spark):
    rows = [(*r, "x", 1, "y", 2, 3) for r in documents()]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words string, kept int, row string, component_id int, spans int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0
        out = stage(spark, docs, "")
        assert out.count() > 0
        docs = out
