"""Pages to articles: selectors, sites, second passes, details; edits and summary runs by hand."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import publishing
from newsflow.functions.dom import parse
from newsflow.functions.text import truncate
from newsflow.operators import articles, extraction

NOW = "2026-05-27 08:00:00"
LIST = """<html><body><article class="item-news big"><h3 class="title-news"><a href="/a-1.html" title="  Tin thứ   nhất hôm nay ">x</a></h3>
<p class="description"><a href="/a-1.html">Tóm tắt một</a></p><img src="data:image/gif;base64,AA" data-src="/i/1.jpg"><time datetime="2026-05-26T07:30:00+07:00">hôm qua</time></article>
<div class="item-news"><a href="/short.html">ngắn</a><a href="/b-2.html">Tin thứ hai rất dài<p>Tin thứ hai rất dài<p>khác</div>
<div class="item-news"><a href="https://other.example/c.html">Tin của một trang khác</a></div>
<section><h2 class="title-news"><a href="/d-4.html">Tin rời không thuộc khối</a></h2></section>
<div class="item-news"><a href="/a-1.html">Tin thứ nhất, lần nữa</a></div></body></html>"""


def test_tree_ends_paragraphs_and_passes_over_stray_ends():
    root = parse("</div><div class='a b'><p><b>x<br><p>y <a title='T' href=/q>z</a></i></div><script>var t='</p>'</script><ul><li>1<li>2</ul>")
    assert [n.text() for n in root.select("p")] == ["x", "y z"]
    assert root.first(".a.b a[title][href]").get("href") == "/q"
    assert [n.text() for n in root.select("ul li, script")] == ["var t='</p>'", "1", "2"]
    assert root.text() == "x y z 1 2"
    assert root.first("a[title='U']") is None and root.first("p .a") is None


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<a", "no tags", "<p>" * 20000, "<!-- " * 50, "<b>" * 20000])
def test_odd_pages_have_no_articles(html):
    assert extraction.articles_of(extraction.VNEXPRESS, html) == []
    assert len(extraction.details_of("", html, None)) == 5


def test_list_page(spark):
    pages = spark.createDataFrame([(1, LIST), (2, None), (3, "")], "page_id long, html string")
    rows = extraction.extract_articles(pages, extraction.VNEXPRESS, NOW).orderBy("page_id", "ord").collect()
    assert [(r.url, r.title, r.summary, r.thumbnail, r.published_at, r.summary_source) for r in rows] == [
        ("https://vnexpress.net/a-1.html", "Tin thứ nhất hôm nay", "Tóm tắt một", "https://vnexpress.net/i/1.jpg", "2026-05-26 07:30:00", "crawler"),
        ("https://vnexpress.net/b-2.html", "Tin thứ hai rất dài Tin thứ hai rất dài khác", "Tin thứ hai rất dài", "", "", "crawler"),
        ("https://vnexpress.net/d-4.html", "Tin rời không thuộc khối", "", "", "", "pending"),
    ]


def test_which_links_are_articles():
    is_article = extraction.is_article
    assert is_article(extraction.BAOCHINHPHU, "Một tiêu đề đủ dài", "https://baochinhphu.vn/x-102260527.htm")
    assert not is_article(extraction.BAOCHINHPHU, "Một tiêu đề đủ dài", "https://baochinhphu.vn/x-1022.htm")
    assert not is_article(extraction.BAOCHINHPHU, "Một tiêu đề", "https://baochinhphu.vn/x-102260527.htm")
    assert is_article(extraction.PTIT, "Tin của trường", "https://ptit.edu.vn/tin/x/")
    for title, url in (("Xem chi tiết", "https://ptit.edu.vn/x"), ("Tin của trường", extraction.PTIT.list_url), ("Tin của trường", "https://ptit.edu.vn/"), ("Tin của trường", "https://ptit.edu.vn/tin-tuc-su-kien/"), ("Tin của trường", "https://[x")):
        assert not is_article(extraction.PTIT, title, url)


def test_details_fill_blanks_only(spark):
    long = "Đây là đoạn mở đầu của bài viết, đủ dài để dùng làm tóm tắt cho bản tin."
    own = f"<meta property='og:image' content='/o.jpg'><meta name=pubdate content=nothing><div class=date>Cập nhật: 27/05/2026, 7h30</div><div class=entry-content><p>Menu {long}<p>{long}<p>{long} Hai.</div>"
    pages = spark.createDataFrame([(2, "https://ptit.edu.vn/a", "<p>later"), (1, "https://ptit.edu.vn/a", own), (3, None, own)], "page_id long, url string, html string")
    record = "url string, title string, crawled_at string, published_at string, summary string, thumbnail string, summary_source string"
    rows = [("https://ptit.edu.vn/a", "T", NOW, "", "", "", "pending"), ("https://ptit.edu.vn/b", "T", NOW, "", "s", "t", "crawler"), ("https://ptit.edu.vn/a", long.upper(), NOW, "x", "", "t", "pending")]
    got = extraction.with_details(spark.createDataFrame(rows, record), pages).collect()
    assert sorted((r.published_at, r.summary, r.thumbnail, r.summary_source) for r in got if r.title == "T") == [
        ("2026-05-27 07:30:00", long, "https://ptit.edu.vn/o.jpg", "crawler"), (NOW, "s", "t", "crawler")]
    assert [(r.published_at, r.summary, r.thumbnail) for r in got if r.title != "T"] == [("x", f"{long} Hai.", "t")]


def test_card_images():
    image = lambda html: extraction.card_image_of(parse(html), "https://a.example/x/")
    assert image("<meta name='twitter:image' content='/t.jpg'><meta property='og:image' content=' '>") == "https://a.example/t.jpg"
    assert image("<img src=/out.jpg><article><img src=/site-logo.png data-src='data:x'><img srcset='/s.jpg 300w, /l.jpg 2x, /m.jpg 900w'></article>") == "https://a.example/l.jpg"
    assert image("<p><img src=y.jpg>") == "https://a.example/x/y.jpg" and image("<img src=/Icon.png>") == image("") == ""
    assert extraction.widest("a 1x, b 1080w,, c") == "b" and extraction.widest("a, b") == "b" and extraction.widest(" , ") == ""


def test_summaries_are_cut_at_words(spark):
    cut = lambda text: spark.createDataFrame([(text,)], "t string").select(truncate("t", 320, "...", 320)).first()[0]
    assert cut("a" * 300 + " bbb, " + "c" * 50) == "a" * 300 + " bbb..." and cut("a" * 320) == "a" * 320 and cut("a" * 321) == "a" * 320 + "..." and cut(None) == ""


def test_article_bodies_by_source():
    long, other = "Đoạn văn đủ dài để được giữ lại trong nội dung bài viết.", "Một đoạn khác cũng đủ dài để được giữ lại ở cuối trang."
    page = f"<p>{other}</p><article class=fck_detail><p>{long}</p><p>Ảnh: {long}</p><div class=ads><p>{long} x</p></div><p>short</p></article>"
    assert extraction.body_of("VNExpress", page) == long
    assert extraction.body_of("PTIT", f"<div class=entry-content><p>short</p></div><main><p>{long}</p></main><p>{other}</p>") == long
    assert extraction.body_of("x", f"<script><p>{long}</p></script><p>{other}</p>") == other
    assert extraction.body_of(None, None) == "" and len(extraction.body_of("", f"<p>{'a' * 9000}</p>")) == 6000


def test_edit_errors_change_nothing(spark):
    base = "id long, source string, title string, url string, published_at string, summary string, content_topic string, category string, client_order int, updated_at string, facebook_posted int, facebook_caption string"
    rows = spark.createDataFrame([(i, "s", "t", "u", "p", "m", "c", "k", 7, "old", i % 2, "cap") for i in range(5)], base)
    edits = [(0, " ", " n\n", "3"), (1, "x", "n", "-2"), (2, "x", None, "1"), (3, "x", "n", "1.5"), (9, "x", "n", "1")]
    edits = spark.createDataFrame([(i, s, t, "", "", "", "", "", o) for i, s, t, o in edits], "id long, source string, title string, url string, published_at string, summary string, content_topic string, category string, client_order string")
    got = {r.id: (r.source, r.title, r.client_order, r.facebook_caption, r.edit_error) for r in articles.edit_content(rows, edits, NOW).collect()}
    assert got == {0: ("Newsflow", "n", 3, "", ""), 1: ("x", "n", 0, "cap", ""), 2: ("s", "t", 7, "cap", "title"), 3: ("s", "t", 7, "cap", "client_order"), 4: ("s", "t", 7, "cap", "")}


@pytest.mark.parametrize(("budget", "force", "want"), [
    (None, False, ["keep", "cache", "generate", "cache", "generate", "generate"]), (2, False, ["keep", "cache", "generate", "cache", "generate", "pending"]),
    (0, False, ["keep", "cache", "pending", "pending", "pending", "pending"]), (3, True, ["generate", "generate", "generate", "pending", "pending", "pending"])])
def test_summary_run(spark, budget, force, want):
    rows = [(0, "k", "s" * 30, "fallback"), (1, "c", "", ""), (2, "a", "", ""), (3, "a", "", ""), (4, "", "", ""), (5, "", " ", None)]
    df = spark.createDataFrame(rows, "id long, url string, summary string, summary_source string")
    cache = spark.createDataFrame([("c", "x", "fallback")], "url string, summary string, summary_source string")
    got = articles.enrich_plan(df, cache, spark.createDataFrame([("a",)], "url string"), budget, force).orderBy("id").collect()
    assert [r.action for r in got] == want


def test_thumbnail_score(spark):
    df = spark.createDataFrame([(1080, 610), (540, 305), (0, 9), (None, 1)], "w int, h int").select(F.round(publishing.thumbnail_score("w", "h"), 6).alias("s"))
    assert [r.s for r in df.collect()] == [1.18, 0.545, None, None]


def test_few_pages_are_held_at_a_time(spark, monkeypatch):
    """However many pages are in a batch, the trees of PAGES of them are alive together at most."""
    import gc

    from newsflow.functions.dom import Node

    monkeypatch.setattr(extraction, "PAGES", 3)
    def alive(html):
        gc.disable()
        parse(html)
        return [(sum(isinstance(o, Node) and o.parent is None for o in gc.get_objects()),)]

    pages = spark.createDataFrame([(i, f"<p>{i}") for i in range(40)], "id long, html string").coalesce(1)
    got = extraction._per_page(pages, ["id"], [F.col("html")], alive, "n int").collect()
    assert sorted(r.id for r in got) == list(range(40)) and max(r.n for r in got) <= 3
