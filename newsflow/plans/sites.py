"""Queries of the extraction for the three sites: documents laid out as their list and article pages, so that SQL knows what is in them."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as lo
from ..operators import extraction as ex
from .catalog import query

CRAWLED = "2024-02-10 08:00:00"
#: What a document gives an article, in both dialects: plain words, so that pages need no escapes.
_PLAIN = "trim(regexp_replace({}, '[^A-Za-z0-9]+', ' '{}))"


def _facts(duck: bool) -> str:
    plain = lambda x: _PLAIN.format(x, ", 'g'" if duck else "")
    text = "coalesce(text, '')"
    # Titles of every eighth document are shorter than any site takes.
    return (f"SELECT doc_id AS id, CAST(doc_id % 3 AS INT) AS site, doc_id - doc_id % 24 + doc_id % 3 AS page_id, {plain(f'substr({text}, 1, CASE WHEN doc_id % 8 = 5 THEN 8 ELSE 60 END)')} AS title, "
            f"{plain(f'substr({text}, 61, 90)')} AS summary, {plain(f'substr({text}, 200, 110)')} AS more, lpad(CAST(1 + doc_id % 28 AS {'VARCHAR' if duck else 'STRING'}), 2, '0') AS day FROM documents")  # fmt: skip


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _blocks() -> Column:
    """A document's block on the list page of its site. Every eleventh links elsewhere, every thirteenth is no article by its address or
    title, every seventh is there twice."""
    i, title, summary, day = F.col("id").cast("string"), F.col("title"), F.col("summary"), F.col("day")
    away, odd = F.col("id") % 11 == 0, F.col("id") % 13 == 0
    host = lambda own: F.when(away, F.lit("https://other.example")).otherwise(own)
    vn = _text('<article class="item-news full"><h3 class="title-news"><a href="', host(""), "/tin-", i, F.when(odd, ".htm").otherwise(".html"), '" title="', title, '">x</a></h3><p class="description"><a>', summary,
               '</a></p><img src="data:image/gif;base64,AA" data-src="/i/', i, '.jpg"><time datetime="2024-01-', day, 'T07:30:00+07:00">x</time></article>')
    bcp = _text('<div class="box-category-item"><h3><a href="', host("https://baochinhphu.vn"), "/bai-", F.when(odd, i).otherwise(_text("10224", F.lpad(i, 8, "0"))), '.htm">', title, '</a></h3><p class="sapo">', summary,
                '</p><img data-original="https://img.example/', i, '.jpg"><span class="date">', day, "/01/2024 07:30</span></div>")
    ptit = _text('<article><h2 class="entry-title"><a href="', host("https://ptit.edu.vn"), "/tin/", i, '/">', F.when(odd, "Xem chi tiết").otherwise(title), '</a></h2><div class="entry-summary">', summary,
                 '</div><img srcset="/i/', i, "-1.jpg 300w, /i/", i, '-2.jpg 600w"><meta itemprop="datePublished" content="2024-01-', day, 'T07:30:00+07:00"></article>')
    block = F.when(F.col("site") == 0, vn).when(F.col("site") == 1, bcp).otherwise(ptit)
    return F.when(F.col("id") % 7 == 0, F.concat(block, F.regexp_replace(block, "<p class.*?</p>", ""))).otherwise(block)


def list_pages(v: SimpleNamespace) -> DataFrame:
    """page_id, site, html; blocks of a page in order of their document."""
    facts = v.spark.sql(_facts(False))
    blocks = facts.groupBy("page_id", "site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", _blocks().alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    return blocks.select("page_id", "site", _text('<html><body><nav><a href="/">Trang chủ</a></nav><div class="list__main">', F.col("b"), "</div></body></html>").alias("html"))


_LIST = f"""WITH d AS ({_facts(True)}),
a AS (SELECT *, CASE site WHEN 0 THEN 'https://vnexpress.net/tin-' || id || '.html' WHEN 1 THEN 'https://baochinhphu.vn/bai-10224' || lpad(CAST(id AS VARCHAR), 8, '0') || '.htm' ELSE 'https://ptit.edu.vn/tin/' || id || '/' END AS url,
  CASE site WHEN 0 THEN 'https://vnexpress.net/i/' || id || '.jpg' WHEN 1 THEN 'https://img.example/' || id || '.jpg' ELSE 'https://ptit.edu.vn/i/' || id || '-1.jpg' END AS thumbnail,
  CASE WHEN summary = title OR length(summary) < (CASE site WHEN 1 THEN 20 ELSE 1 END) OR (site = 2 AND contains(lower(summary), 'xem chi tiết')) THEN '' ELSE summary END AS shown
  FROM d WHERE id % 11 <> 0 AND id % 13 <> 0 AND length(title) >= (CASE site WHEN 1 THEN 15 ELSE 10 END))
SELECT (['VNExpress', 'Báo Chính phủ', 'PTIT'])[site + 1] AS source, page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY id) - 1 AS INT) AS ord, title, url, '2024-01-' || day || ' 07:30:00' AS published_at,
  thumbnail, shown AS summary, CASE WHEN shown = '' THEN 'pending' ELSE 'crawler' END AS summary_source FROM a"""


@query("sites_list_pages", _LIST)
def sites_list_pages(v: SimpleNamespace) -> DataFrame:
    """Articles of all list pages: links, summaries, images and dates by the rules of each site, unique by url."""
    pages = list_pages(v)
    found = [ex.extract_articles(pages.where(F.col("site") == k), site, CRAWLED) for k, site in enumerate(ex.SITES)]
    return reduce(DataFrame.unionByName, found).select("source", "page_id", "ord", "title", "url", "published_at", "thumbnail", "summary", "summary_source")


def article_pages(v: SimpleNamespace) -> DataFrame:
    """A page for each document: meta texts for some, else paragraphs and images in its body, a logo first."""
    i, k = F.col("id").cast("string"), F.col("id")
    when = lambda test, *parts: F.when(test, _text(*parts)).otherwise("")
    head = F.concat(
        when(k % 2 == 0, '<meta property="og:image" content="/og/', i, '.jpg">'), when(k % 3 == 0, '<meta name="description" content="', F.col("summary"), '">'),
        when(k % 4 == 0, '<meta property="article:published_time" content="2024-01-', F.col("day"), 'T07:30:00+07:00">'),
    )
    body = _text('<div class="entry-content"><img src="/logo.png"><img data-src="/in/', i, '.jpg" src="/x.jpg"><p>', F.col("title"), "</p><p>", F.col("more"), "</p><p>ngắn</p><p>", F.col("summary"), "</p></div>")
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, when(k % 4 == 1, '<div class="date">Cập nhật: ', F.col("day"), "/01/2024, 7h30</div>"), F.lit("</body></html>"))
    return v.spark.sql(_facts(False)).select(F.col("id").alias("page_id"), _text("https://ptit.edu.vn/a/", i).alias("url"), "title", html.alias("html"))


_BAD_DETAIL = f"regexp_matches(lower(x), '{'|'.join(ex.NOT_DETAIL)}')"
_BAD_CARD = f"regexp_matches(lower(x), '{'|'.join(ex.NOT_CARD)}')"
query("sites_article_pages", f"""WITH d AS ({_facts(True)}),
t AS (SELECT *, list_filter([CASE WHEN id % 3 = 0 THEN summary END, title, more, summary], lambda x: x IS NOT NULL AND length(x) >= 60 AND lower(x) <> lower(title) AND NOT {_BAD_DETAIL}) AS told,
  list_filter([CASE WHEN id % 3 = 0 THEN summary END], lambda x: x IS NOT NULL AND length(x) >= 40 AND lower(x) <> lower(title) AND NOT {_BAD_CARD}) AS meta,
  list_filter([title, more, summary], lambda x: length(x) >= 40 AND lower(x) <> lower(title) AND NOT {_BAD_CARD}) AS inner_ FROM d)
SELECT id AS page_id, 'https://ptit.edu.vn/' || CASE WHEN id % 2 = 0 THEN 'og/' || id || '.jpg' ELSE 'logo.png' END AS detail_image, 'https://ptit.edu.vn/' || CASE WHEN id % 2 = 0 THEN 'og/' ELSE 'in/' END || id || '.jpg' AS card_image,
  coalesce(told[1], '') AS detail_summary, coalesce(meta[1], array_to_string(inner_[1:2], ' '), '') AS card_summary, CASE WHEN id % 4 IN (0, 1) THEN '2024-01-' || day || ' 07:30:00' ELSE '' END AS detail_published_at FROM t""")(
    lambda v: ex.page_details(article_pages(v)).select("page_id", "detail_image", "card_image", "detail_summary", "card_summary", "detail_published_at"))


@query("card_text_fit")
def card_text_fit(v: SimpleNamespace) -> DataFrame:
    """Sizes and lines of the title and the summary on every article's card."""
    fits = v.articles.select("id", lo.fit("title", lo.TITLE).alias("t"), lo.fit("summary", lo.SUMMARY).alias("s"))
    return fits.select("id", F.col("t.size").alias("title_size"), F.array_join("t.lines", "\n").alias("title_lines"), F.col("s.size").alias("summary_size"), F.array_join("s.lines", "\n").alias("summary_lines"))
