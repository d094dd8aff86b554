from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
from urllib.parse import quote

import pyarrow as pa
import pytest
from conftest_llm import brute_overlap
from pyspark.sql import functions as F

from demandspark.llm import decontaminate, html, secrets, toxicity
from demandspark.llm.queries import op3_html_text, op7_toxicity, op8_secrets
from demandspark.llm.store import remainder, table

SF = "/root/testdata/sf0.01"


# --- main text -----------------------------------------------------------------------------


def test_articles_of_the_test_pages(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = op3_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text &lt;3", "just text <3"),
        ("<nav>only a menu</nav>", ""), ("<article><h1>T</h1><p>One, two.<p>Three</article>", "T\n\nOne, two.\n\nThree"),
        ("<article><p>cut off, in the <a hre", "cut off, in the"), ("<p>a &amp b &#233; &#x1F600;</p>", "a & b é 😀"),
        ('<body><div class="menu"><a href=x>Home</a></div><div id="content"><h1>Title</h1><div>First part, with text. And more, ok.</div>'
         '<div>Second part, long enough to count.</div></div><div class="sidebar"><p>side, text.</p></div><div id="comments"><p>I like it, great.</p></div></body>',
         "Title\n\nFirst part, with text. And more, ok.\n\nSecond part, long enough to count."),
        ("<article><p>one</p><script>var a='<p>no</p>'</script><style>p{}</style><form><p>no</p></form><p>two</p><!-- <p>no</p> --></article>", "one\n\ntwo"),
        ("<body><form><div><p>All in a form, as some sites do it. Really.</p></div></form></body>", "All in a form, as some sites do it. Really."),
    ],
)
def test_page_cases(page, text):
    assert html.main_text(page) == text


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 3000 + "text, deep down." + "</div>" * 3000) == "text, deep down."
    body = "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(5000))
    assert html.main_text(f"<article>{body}</article>").count("\n\n") == 4999


def test_pages_keep_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x, y.</p>"), (1, "u", "<p>x, y.</p>")], "page_id long, url string, html string")
    got = html.extract(df.withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("x, y.", 5), ("x, y.", 5)]
    assert html.extract(df.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------------------------


def test_overlap_matches_brute_force(spark, docs, edges):
    items = [(1, "the of and house river"), (2, "green under light"), (2, "winter"), (None, "paper seven"), (5, ""), (6, None), (7, "the of and house river")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [*edges, (20, "x The of, AND house-river stone y winter"), (21, "green under light green under light"), (22, "of and house")]
    got = decontaminate.overlap(docs(rows, clash=True), benchmark, window=4).collect()
    plain = brute_overlap(rows, items, 4)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain))


def test_blocks_of_the_benchmark_add_up(spark, docs, monkeypatch):
    items = [(i, f"w{i} w{i + 1} w{i + 2} w{i + 3}") for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, " ".join(f"w{i}" for i in range(k, 3 * k))) for k in range(12)]
    whole = decontaminate.overlap(docs(rows), benchmark, window=3).collect()
    kept = decontaminate.clean(docs(rows, clash=True), benchmark, window=3).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert sorted(decontaminate.overlap(docs(rows), benchmark, window=3).collect()) == sorted(whole)
    again = decontaminate.clean(docs(rows, clash=True), benchmark, window=3)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in whole if not r.contaminated)
    assert len(again.columns) == 12


def test_no_benchmark_and_no_documents(spark, docs, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.overlap(docs(edges), none).collect())
    assert decontaminate.overlap(docs([]), none).count() == 0
    assert decontaminate.clean(docs(edges), none).count() == len(edges)


def test_longest_matches(spark, docs):
    benchmark = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    got = decontaminate.longest_matches(docs([(1, "x b c d y"), (2, "a b c z"), (3, "b c d e")]), benchmark, window=3).collect()
    assert {(r.item_word, r.n_words, r.doc_id, r.doc_word) for r in got} == {(0, 3, 2, 0), (1, 4, 3, 0), (2, 3, 3, 1)}


def test_suffix_array_order():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(30):
        text = rng.integers(0, 3, rng.integers(1, 40))
        sa = decontaminate.suffix_array(text, 6)
        keys = [tuple(text[i : i + 6]) for i in sa]
        assert keys == sorted(keys) and sorted(sa) == list(range(len(text)))


# --- toxicity -------------------------------------------------------------------------------


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = op7_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


def test_toxicity_edges(spark, docs, edges):
    df = docs(edges, clash=True)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 0, 0), (None, 1, 1), (9, 1, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, F.lit(True))
    got = toxicity.predict(df, model).collect()
    assert len(got) == len(edges) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.fit(df, labels.limit(0), F.lit(True))
    assert {(r.score, r.predicted) for r in toxicity.predict(df, none).collect()} == {(0.0, 0)}
    assert toxicity.accepted(df, none).count() == len(edges) and toxicity.accepted(df, none).columns == df.columns
    assert toxicity.predict(docs([]), model).count() == 0


def test_fit_is_bounded_and_alike(spark, docs):
    rows = [(i, f"good text number {i} here" + (" nasty" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    one, two = (toxicity.fit(docs(rows).repartition(n), labels, remainder("doc_id", 5) != 0) for n in (1, 7))
    assert one.place.tolist() == two.place.tolist() and abs(one.bias - two.bias) < 1e-9
    small = toxicity.fit(docs(rows), labels, F.lit(True), max_rows=100)
    got = {r.doc_id: r.predicted for r in toxicity.predict(docs(rows), one).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(400)) and len(small.place) > 0

_PROSE = "This is a sentence, long enough to be the text of an article, with marks. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class=menu><a href=x>Home</a></div><div class=post><h1>Title</h1><div class=lead>A lead, short.</div><div class=body><p>{P}</p><p>{P}</p></div></div><div class=footer>foot</div></body>", "Title|A lead, short.|{P}|{P}"),
        ("<body><nav>x</nav><article><h1>A</h1><p>{P}</p></article><article><h1>B</h1><p>{P}</p></article></body>", "A|{P}|B|{P}"),
        ("<body><h1>T</h1><p>{P}</p><ul><li>one</li><li>two</li></ul><p>{P}</p><blockquote>quoted</blockquote></body>", "T|{P}|one|two|{P}|quoted"),
        ('<body><article><div class="page-header"><h1>T</h1></div><p>{P}</p><section class="social-history"><p>{P}</p></section><section id="related-work"><p>{P}</p></section><div class="comments"><p>{P}</p></div></article></body>', "T|{P}|{P}|{P}"),
        ('<body><article><p>before <svg class="icon"/> after, {P}</p><p>x <svg><path d=1 /><title>no</title></svg> y {P}</p></article></body>', "before after, {P}|x y {P}"),
        ("<body><article><p>so <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds, {P}</p></article></body>", "so a+b holds, {P}"),
        ('<body><div><p>{P}</p></div><div class="related-posts"><p>{P}</p></div><div class="share"><p>{P}</p></div></body>', "{P}"),
        ("<body><article><p>one, {P}</p><template><p>two, {P}</p></article></body>", "one, {P}|two, {P}"),
        ("<body><main><h1>T</h1><article><p>{P}</p><p>{P}</p></article><p>after all, {P}</p></main></body>", "T|{P}|{P}|after all, {P}"),
    ],
)
def test_nothing_of_an_article_is_lost(page, text):
    want = text.replace("{P}", _PROSE.strip()).split("|")
    assert html.main_text(page.replace("{P}", _PROSE)) == "\n\n".join(want)


@pytest.mark.parametrize("tag", ["<div>", "<span>", "<x-a>", "<li>", "<p><b>", "<a href=x>"])
def test_deep_nesting_is_linear(tag):
    import time

    began = time.perf_counter()
    html.main_text("<body>" + (tag + "word, ") * 8000)
    assert time.perf_counter() - began < 3


def _template(kind, title, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    side = "<div class='sidebar'><p>Side note, which is not part of it, at all.</p></div><div class='comments'><p>I like it, really.</p></div>"
    menu = "<ul class='nav'>" + "".join(f"<li><a href='{i}'>Section {i}</a></li>" for i in range(8)) + "</ul>"
    return {
        "div": f"<body>{menu}<div class='post'><h1>{title}</h1><div class='entry'>{body}</div></div>{side}<div id='footer'>Imprint</div></body>",
        "flat": f"<body>{menu}<h1>{title}</h1>{body}{side}<div id='footer'>Imprint</div></body>",
        "table": f"<body><table><tr><td>{menu}</td><td><h1>{title}</h1>{body}</td><td>{side}</td></tr></table><div id='footer'>Imprint</div></body>",
        "split": f"<body>{menu}<div class='story'><h1>{title}</h1>" + "".join(f"<div class='part'><p>{p}</p></div>" for p in paragraphs) + f"</div>{side}<div id='footer'>Imprint</div></body>",
    }[kind]


@pytest.mark.parametrize("kind", ["div", "flat", "table", "split"])
def test_pages_without_an_article_tag(spark, kind):
    """Paragraphs of the test documents in four templates: recall and precision of words."""
    texts = [r.text for r in table(spark, SF, "documents").where("length(text) between 600 and 4000").limit(60).collect()]
    hit = want = got = 0
    for i, text in enumerate(texts):
        words = text.replace("<", " ").replace("&", " ").split()
        paragraphs = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
        found = html.main_text(_template(kind, f"Title {i}", paragraphs)).split()
        right = ["Title", str(i), *" ".join(paragraphs).split()]
        hit, want, got = hit + len(set(found) & set(right)), want + len(set(right)), got + len(set(found))
    assert hit / want > 0.98 and hit / got > 0.98


# --- secrets --------------------------------------------------------------------------------

KEY = "AKIA" + "ABCDEFGH12345678"


def _plain(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_base_matches_of_the_test_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in op8_secrets(spark, SF).collect():
        plain = _plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert set(filter(None, plain.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [plain.count(f"{k}:") for k in ("assign", "access", "hex")]


def _spans(text):
    return [str(s) for s in secrets.spans(text)[1]]


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    ],
)
def test_wrapped_secrets_are_found_at_any_depth(wrap):
    once = wrap(KEY)
    for layer in (once, base64.b64encode(once.encode()).decode(), "".join(f"%{b:02x}" for b in once.encode()), base64.b64encode(gzip.compress(f"note {once} end".encode())).decode()):
        text = f"é says {layer} ok"
        start, end = 7, 7 + len(layer)
        found = secrets.spans(text)
        assert not found[0] or KEY in text
        assert any(s.kind == 1 and start <= s.start < s.end <= end for s in found[1]), layer


def test_spans_map_to_places():
    assert _spans("x token%3Dabcdefgh y") == ["assign:2:18"]
    assert _spans("é \\u0041KIA" + KEY[4:] + " z") == [f"access:2:{2 + 6 + 3 + len(KEY) - 4}"]
    assert _spans(quote(quote("password = hunter2hunter2"))) == ["assign:0:" + str(len(quote(quote("password = hunter2hunter2"))))]


def test_secret_edges(docs, edges):
    got = secrets.find(docs(edges, clash=True)).collect()
    assert len(got) == len(edges)
    assert secrets.find(docs([])).count() == 0
    assert secrets.spans(None) == ([], []) and _spans("token: short") == [] and _spans("Kelvin K apiKEY=abcdefgh") == ["assign:9:24"]
    twice = base64.b64encode(KEY.encode()).decode()
    assert len(_spans(f"{twice} {twice}")) == 2
    assert _spans("%25" * 500 + "41") == [] and _spans("%ff%fe \\ud800 &#1114112;") == []


def test_marks_agree_with_brute_force():
    import random

    random.seed(5)
    for trial in range(20):
        window = random.choice([2, 3, 13])
        items = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 7)))) for i in range(5)]
        rows = [(i, " ".join(random.choice("abcde") for _ in range(random.randint(0, 40)))) for i in range(15)]
        block = decontaminate.benchmark_block([str(i) for i, _ in items], pa.array([t for _, t in items]), window)
        sizes, hits, names = decontaminate.mark(block, pa.array([t for _, t in rows]))
        plain = brute_overlap(rows, items, window)
        assert [(s, len(h), len(set(n))) for s, h, n in zip(sizes, hits, names)] == [p[1:4] for p in plain]
