"""Page text, repeated spans and vector search against direct versions, and awkward rows."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import SF, awkward, documents, empty  # noqa: F401 - fixtures
from textlab.llm import ann, html_text, line_dedup

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies on this site.</div><nav><a href=#>Home</a></nav><main><article><header><h1>Title &amp; more</h1></header>
<p>First   para with <a href=x>link</a> text&nbsp;here.<p>Second <b>para</b><br>line.<ul><li>item one<li>item two</ul>
<aside>Related stuff here</aside><div class="advert"><p>Buy now, this is a long advert text with words.</p></div><script>var a="</p>";</script>
<form><p>Subscribe to us</p><input></form><section class="comments"><h2>Comments</h2><p>I think this is a long comment by a reader.</p></section>
</article></main><footer><p>Copyright</p></footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para with link text here.\nSecond para line.\nitem one\nitem two"


BODY = "".join(f"<p>Paragraph {k} of the story has a number of plain words in it, and an end.</p>" for k in range(6))
SIDE = "<div class='sidebar'><p>Other things to read, with words enough.</p></div>"


@pytest.mark.parametrize("page", [
    f"<div class='content-sidebar-wrap'><article>{BODY}</article>{SIDE}</div>", f"<div class='has-sidebar'><article>{BODY}</article></div>{SIDE}",
    f"<div class='no-sidebar'>{BODY}</div>", f"<article class='post category-social tag-popular'>{BODY}</article>{SIDE}",
    f"<form id='aspnetForm'><div>{BODY}</div></form>", f"<form><main>{BODY}</main>{SIDE}</form>", f"<div class='widget'><main>{BODY}</main></div>"])
def test_names_and_forms_around_the_article_keep_it(page):
    got = html_text.main_text(f"<html><body>{page}<footer><p>Copyright</p></footer></body></html>")
    assert got == "\n".join(re.findall("<p>(.*?)</p>", BODY))


def test_sections_and_headings_of_an_article_stay():
    page = (f"<article>{BODY}<h2 id='related-work'>Related work</h2><p>Others did this before us, as told here.</p><h2 id='social-impact'>Social "
            "impact</h2><p>It has some, as we have seen.</p><section id='discussion'><h2>Discussion</h2><p>We discuss the results in this part.</p>"
            "</section><section id='comments'><p>I think this is a long comment by a reader.</p></section><div class='related-posts'>"
            "<p>More that you may like to read.</p></div></article>")
    got = html_text.main_text(page)
    assert all(x in got for x in ("Related work", "Others did", "Social impact", "It has some", "Discussion", "We discuss"))
    assert "by a reader" not in got and "may like" not in got


LONG = "I have read this with care and would like to add some words of my own to it, number {0}."
FAMILIES = {
    "comments": ("<div id='comments'>{}</div>", "<div class='c'><b>reader {0}</b><p>" + LONG + "</p></div>"),
    "comments-area": ("<section class='comments-area'><h2>Comments</h2><ol>{}</ol></section>", "<li><p>" + LONG + "</p></li>"),
    "flat comments": ("<div class='comments'>{}</div>", "<p>" + LONG + "</p>"),
    "sidebar": ("<div class='sidebar'>{}</div>", "<div><h3>Other {0}</h3><p>" + LONG + "</p></div>"),
    "related-posts": ("<div class='related-posts'>{}</div>", "<div><a href='/{0}'>Other {0}</a><p>" + LONG + "</p></div>"),
    "cookie-notice": ("<div id='cookie-notice'>{}</div>", "<p>" + LONG + "</p>")}


@pytest.mark.parametrize("items", [0, 1, 2, 4, 8, 20, 40])
@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("body", ["{}", "<div>{}</div>", "<div class='content'>{}</div>", "<article>{}</article>"])
def test_article_alone_whatever_the_size_of_a_marked_part(family, items, body):
    box, item = FAMILIES[family]
    story = "".join(re.findall("<p>.*?</p>", BODY)[:4])
    part = box.format("".join(item.format(k) for k in range(items)))
    for inner in (body.format(story) + part, part + body.format(story), body.format(story + part)):
        got = html_text.main_text(f"<html><body><nav><a href='/'>Home</a></nav>{inner}<footer><p>Copyright</p></footer></body></html>")
        assert got == "\n".join(re.findall("<p>(.*?)</p>", story))


@pytest.mark.parametrize("name", ["popular", "content-sidebar", "share-page", "sidebar", "feedback"])
def test_a_name_around_the_whole_text_keeps_it(name):
    page = f"<body><div class='{name}'><div><h1>The story of the day</h1>{BODY}</div></div><footer><p>Copyright</p></footer></body>"
    assert html_text.main_text(page) == "The story of the day\n" + "\n".join(re.findall("<p>(.*?)</p>", BODY))
    readers = "".join(FAMILIES["comments"][1].format(k) for k in range(9))
    assert html_text.main_text(f"<body><div id='comments'>{readers}</div></body>") == ""


@pytest.mark.parametrize("page", ["", "<", "<p", "<a '", "</div></p>", "<!--", "<script>x", "&#0;&bogus;", "<div>" * 3000, "<p>a<p>" * 50])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        inner = p.html[p.html.index("<article>") + 9:].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_costs_least(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    score = [rng.randint(-30, 30) for _ in range(n)]
    links = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 40)) for _ in range(2 * n)]

    def price(label):
        return (sum(abs(s) for s, x in zip(score, label) if (s > 0) != x and s)
                + sum(w for i, j, w in links if label[i] != label[j]))

    assert price(html_text.minimum_cut(score, links)) == min(map(price, itertools.product([False, True], repeat=n)))


def test_awkward_pages(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, None, "<p>" + "long text, " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert html_text.extract(df.limit(0)).count() == 0


def plain_spans(rows: list[tuple], least: int) -> set:
    cut = {k: line_dedup.units(t or "") for k, (_, t) in enumerate(rows)}
    first: dict = {}
    for k in sorted(cut, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        for n, u in enumerate(cut[k]):
            first.setdefault(u[3], (k, n))
    out = set()
    for k, own in cut.items():
        for _, run in itertools.groupby(enumerate(own), lambda x: first[x[1][3]] != (k, x[0])):
            run = [u for n, u in run if first[u[3]] != (k, n)]
            if run and sum(u[2] for u in run) >= least:
                out.add((rows[k][0], run[0][0], run[-1][1], sum(u[2] for u in run), rows[first[run[0][3]][0]][0]))
    return out


def test_repeated_spans_equal_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for least in (5, 30):
        got = line_dedup.repeated_spans(documents, min_span=least).select("doc_id", "start", "end", "n_words", "first_doc_id").collect()
        assert set(map(tuple, got)) == plain_spans(rows, least) and len(got) == len(set(got))


def test_units_keep_offsets():
    text = "One two three four. Five!  Six seven eight nine?\nshort\nA b c d e"
    assert [text[a:b] for a, b, *_ in line_dedup.units(text)] == ["One two three four.", "Five!  Six seven eight nine?", "A b c d e"]


def test_a_passage_goes_from_later_documents(spark):
    passage = " ".join(f"word{k % 17} thing{k} goes on" for k in range(20)) + "."
    docs = spark.createDataFrame([(3, f"Own start here now. {passage}\nAnd an own end of three."), (1, passage), (2, "Nothing of that is in here at all."),
                                  (1, passage)], "doc_id long, text string")
    got = sorted((r.doc_id, r.first_doc_id) for r in line_dedup.repeated_spans(docs).collect())
    assert got == [(1, 1), (3, 1)]
    kept = {(r.doc_id, r.text) for r in line_dedup.without_repeats(docs).collect()}
    assert kept == {(3, "Own start here now. \nAnd an own end of three."), (1, passage), (2, "Nothing of that is in here at all."), (1, "")}
    for r in line_dedup.without_repeats(docs).collect():
        source = {3: f"Own start here now. {passage}\nAnd an own end of three.", 1: passage, 2: r.text}[r.doc_id]
        assert r.text == "".join(source[s.start:s.end] for s in r.kept_spans)


SHORT = [(1, "All rights in this are reserved.\nlorem ipsum\nWe print the same notice here."),
         (2, "Own words open this text.\nAll rights in this are reserved.\nlorem ipsum\nWe print the same notice here."),
         (3, "All rights in this are reserved.\n7411 Ann\nWe print the same notice here.\nlorem ipsum")]


def test_whole_lines_go_and_lone_sentences_stay(spark, documents):
    common = "This sentence stands in many texts."
    docs = spark.createDataFrame([(1, f"{common} And more of the first.\nA short footer line here. With two sentences in it."),
                                  (2, f"Own words begin this line. {common} Other words end this line.\n"
                                      "A short footer line here. With two sentences in it.")], "doc_id long, text string")
    got = line_dedup.repeated_spans(docs, compare_short=True, lines=True).collect()
    assert [(r.doc_id, r.first_doc_id) for r in got] == [(2, 1)]
    assert docs.filter("doc_id = 2").first().text[got[0].start:got[0].end] == "A short footer line here. With two sentences in it."
    rows, spans = {r.doc_id: r.text for r in documents.collect()}, {}
    found = line_dedup.repeated_spans(documents, lines=True).collect()
    cut = {d: line_dedup.units(t or "") for d, t in rows.items()}
    first: dict = {}
    for d in sorted(cut):
        for n, u in enumerate(cut[d]):
            first.setdefault(u[3], (d, n))
    for d, own in cut.items():
        later = [first[u[3]] != (d, n) for n, u in enumerate(own)]
        keep = set()
        for _, run in itertools.groupby(range(len(own)), lambda n: later[n]):
            run = list(run)
            if later[run[0]] and sum(own[n][2] for n in run) >= line_dedup.MIN_SPAN_WORDS:
                keep |= set(run)
        line = [(rows[d] or "").rfind("\n", 0, u[0]) for u in own]
        for x in set(line):
            mine = [n for n in range(len(own)) if line[n] == x]
            keep |= set(mine) if all(later[n] for n in mine) else set()
        for _, run in itertools.groupby(sorted(keep), lambda n: n - sorted(keep).index(n)):
            run = list(run)
            spans.setdefault(d, set()).add((own[run[0]][0], own[run[-1]][1]))
    assert {d: {(r.start, r.end) for r in found if r.doc_id == d} for d in {r.doc_id for r in found}} == spans


def test_every_repeated_unit_goes(spark):
    docs = spark.createDataFrame(SHORT[:2] + [(3, "One more own line here.\nWe print the same notice here.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == {
        1: SHORT[0][1], 2: "Own words open this text.\n", 3: "One more own line here.\n"}


def test_short_lines_go_only_if_they_repeat(spark):
    docs = spark.createDataFrame(SHORT, "doc_id long, text string")
    rows = line_dedup.repeated_spans(docs, min_span=4, compare_short=True).collect()
    assert sorted((r.doc_id, dict(SHORT)[r.doc_id][r.start:r.end], r.n_words, r.first_doc_id) for r in rows) == [
        (2, SHORT[0][1], 14, 1), (3, "All rights in this are reserved.", 6, 1), (3, "We print the same notice here.", 6, 1)]
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert kept == {1: SHORT[0][1], 2: "Own words open this text.\n", 3: "7411 Ann\nlorem ipsum"}


def test_scripts_without_spaces_have_units(spark):
    text = "这是一个重复的句子。另外一个很长的句子在这里！好。\nこれは繰り返される文章です。"
    assert [text[a:b] for a, b, *_ in line_dedup.units(text)] == ["这是一个重复的句子。", "另外一个很长的句子在这里！", "これは繰り返される文章です。"]
    docs = spark.createDataFrame([(1, text), (2, "这里是自己的内容在前面。" + text)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == {1: text, 2: "这里是自己的内容在前面。"}


def test_awkward_lines(awkward, empty):
    got = line_dedup.repeated_spans(awkward).collect()
    assert {r.doc_id for r in got} == {2} and len(got) == 1          # the long text's copy; "word word ..." has one unit
    assert line_dedup.without_repeats(awkward).count() == awkward.count()
    assert line_dedup.repeated_spans(empty).count() == 0 and line_dedup.without_repeats(empty).count() == 0


def brute(rows, q, k=20):
    own = np.array(q[1])
    found = sorted(((-float(np.dot(np.array(v, float), own)), i) for i, v in {(i, tuple(v)) for i, v in rows if i != q[0]}))
    return found[:k]


def test_search_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got: dict = {}
    for r in ann.search(table, table.filter("vec_id % 20 = 0"), shard_rows=150, query_rows=8).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in [r for r in rows if r[0] % 20 == 0]:
        want = brute(rows, q)
        own = got[q[0]]
        assert sorted(own) == list(range(1, 21)) and q[0] not in {v for v, _ in own.values()}
        assert [own[k][1] for k in sorted(own)] == sorted((s for _, s in own.values()), reverse=True)
        hits += sum(s >= -want[-1][0] - 1e-12 for _, s in own.values())
        vec = dict(rows)
        assert all(abs(s - float(np.dot(np.array(vec[v], float), np.array(q[1], float)))) < 1e-12 for v, s in own.values())
    assert hits / (20 * len(got)) >= 0.9


def test_search_with_copies_ties_and_bad_vectors(spark):
    good = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, float(i)]) for i in range(5)]
    bad = [(0, None), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [float("inf"), 0.0]), (None, [1.0, 1.0]), (200, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad + good[:3]], "vec_id long, embedding array<float>, rank int, query_id string")
    got: dict = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [0, 20, 40, 100]                          # 200 has no candidate of its length
    for q in (0, 20, 40):
        assert [got[q][k][0] for k in sorted(got[q])] == [i for i in range(60) if i != q][:20]
    assert [got[100][k][0] for k in range(1, 21)] == list(range(20))
    few = df.filter("vec_id in (0, 100)")
    assert {(r.query_id, r.vec_id) for r in ann.search(few, few).collect()} == {(0, 100), (100, 0)}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
