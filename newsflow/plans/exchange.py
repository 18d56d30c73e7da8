"""Queries of dates, captions, messages, names of files, addresses, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import publishing as pb
from ..functions import text as tx
from ..operators import articles as ar
from ..operators import extraction as ex
from ..operators import publication as pub
from ..sources import files
from ..streaming import events as ev
from .catalog import query

_WHITE = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WHITE}', ' ', 'g'))"


# Dates ------------------------------------------------------------------------------------------------------------------
_DD = "lpad(CAST(1 + id % 30 AS STRING), 2, '0')"
#: Forms of date texts over articles, in SQL of both dialects.
DATE_TEXT = f"""CASE CAST(id % 12 AS INT) WHEN 0 THEN concat('Cập nhật: ', {_DD}, '/05/2026, 7h30') WHEN 1 THEN concat('2026-05-', {_DD}, 'T07:00:00+07:00') WHEN 2 THEN concat('Wed, ', {_DD}, ' May 2026 10:05:09 +0700')
 WHEN 3 THEN concat({_DD}, '-02-2026') WHEN 4 THEN '2026-02-31' WHEN 5 THEN 'abc' WHEN 6 THEN concat({_DD}, '/05/2026 09:08 (GMT+7)') WHEN 7 THEN concat('Published: ', {_DD}, '/12/2025 lúc 23:59:58') WHEN 8 THEN '  '
 WHEN 9 THEN concat('2026-05-', {_DD}) WHEN 10 THEN concat({_DD}, '/13/2026') ELSE published_at END"""


def _stamp(y: str, m: str, d: str, *clock: str) -> str:
    text = f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') || ' ' || " + " || ':' || ".join(f"lpad({c}, 2, '0')" for c in clock)
    return f"CASE WHEN {y} NOT IN ('', '0000') AND try_strptime({text}, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN {text} END"


def _parts(x: str, pattern: str, *groups: int) -> list[str]:
    return [f"regexp_extract({x}, '{pattern}', {g})" for g in groups]


_T = f"trim(regexp_replace({_clean('raw')}, '{dt.LABEL}', ''), ' -|,')"
_D, _M, *_HMS = _parts("t", dt.MAIL, 1, 2, 4, 5, 6)
_MONTH = f"CAST((instr(lower('{dt.MONTHS}'), lower({_M})) + 2) // 3 AS VARCHAR)"
query(
    "parse_datetime_text",
    f"SELECT id, coalesce({_stamp(*_parts('t', dt.ISO, 1, 2, 3, 4, 5, 6))}, {_stamp(_parts('t', dt.MAIL, 3)[0], _MONTH, _D, *_HMS)}, {_stamp(*_parts('t', dt.LOCAL, 3, 2, 1, 4, 5, 6))}, '') AS parsed "
    f"FROM (SELECT id, {_T} AS t FROM (SELECT id, {DATE_TEXT} AS raw FROM articles_v))",
)(lambda v: v.articles.select("id", dt.parse_datetime_text(F.expr(DATE_TEXT)).alias("parsed")))


def _shown(pattern: str, y: int, m: int, d: int) -> str:
    stamp = _stamp(*_parts("t", pattern, y, m, d, 4, 5, 6))
    day = f"strftime(try_strptime({stamp}, '%Y-%m-%d %H:%M:%S'), '%d/%m/%Y')"
    return f"CASE WHEN {_parts('t', pattern, 4)[0]} = '' THEN {day} ELSE {day} || strftime(try_strptime({stamp}, '%Y-%m-%d %H:%M:%S'), ' %H:%M') END"


_RAW = f"coalesce(nullif(trim({DATE_TEXT}), ''), nullif(trim(crawled_at), ''), nullif(trim(created_at), ''), '')"
query(
    "format_published",
    f"SELECT id, coalesce({_shown(dt.YEAR_FIRST[0], 1, 2, 3)}, {_shown(dt.YEAR_FIRST[1], 1, 2, 3)}, {_shown(dt.DAY_FIRST, 3, 2, 1)}, raw) AS shown "
    f"FROM (SELECT id, raw, trim(split_part(trim(replace(replace(raw, 'T', ' '), 'Z', '')), '+', 1)) AS t FROM (SELECT id, {_RAW} AS raw FROM articles_v))",
)(lambda v: v.articles.select("id", dt.format_published(F.expr(DATE_TEXT), "crawled_at", "created_at").alias("shown")))
query("next_run_at", "SELECT id, strftime(CASE WHEN d + INTERVAL 7 HOUR > t THEN d + INTERVAL 7 HOUR ELSE d + INTERVAL 31 HOUR END, '%Y-%m-%d %H:%M:%S') AS next_run FROM (SELECT id, CAST(crawled_at AS TIMESTAMP) AS t, date_trunc('day', CAST(crawled_at AS TIMESTAMP)) AS d FROM articles_v)")(
    lambda v: v.articles.select("id", dt.next_run_at("crawled_at").alias("next_run"))
)

# Captions and messages --------------------------------------------------------------------------------------------------
def _caption(x: str) -> str:
    lines = rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '{pb.INNER}*\n{pb.INNER}*', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^(?:\n|{pb.INNER})+|(?:\n|{pb.INNER})+$', '', 'g')"


query("caption_text", f"SELECT doc_id, {_caption('text')} AS caption FROM documents")(lambda v: v.documents.select("doc_id", pb.caption_text("text").alias("caption")))


def _short(x: str) -> str:
    return f"CASE WHEN length({_clean(x)}) <= 400 THEN {_clean(x)} ELSE regexp_replace(regexp_replace(rtrim(substr({_clean(x)}, 1, 399)), ' [^ ]*$', ''), '[.,;: ]+$', '') || '…' END"


def _photo(order: str) -> str:
    head, short, link = _clean("title"), _short("summary"), _clean("url")
    body = (f"concat_ws(chr(10), {order} || '. ' || {head}, CASE WHEN {short} <> '' AND lower({short}) <> lower({head}) THEN chr(10) || {short} END, "
            f"chr(10) || 'Nguồn: ' || coalesce(nullif({_clean('source')}, ''), '{pb.HOUSE}'), CASE WHEN {link} <> '' THEN '🔗 Xem chi tiết: ' || {link} END)")  # fmt: skip
    return f"CASE WHEN {head} <> '' AND ({link} = '' OR regexp_matches({link}, '^(?i:https?)://[^/?#]+')) THEN {_caption(body)} END"


query("photo_caption", f"SELECT id, {_photo('id')} AS caption FROM articles_v")(lambda v: v.articles.select("id", pb.photo_caption("id", "title", "summary", "source", "url").alias("caption")))
query("main_caption", f"SELECT id, {_caption(f'''concat_ws(chr(10), '{pb.INTRO_LINES[0]}', strftime(CAST(updated_at AS TIMESTAMP), 'Cập nhật ngày %d/%m/%Y lúc %H:%M'), '', {_clean('summary')}, '', '{pb.INTRO_LINES[1]}')''')} AS caption FROM articles_v")(
    lambda v: v.articles.select("id", pb.main_caption(F.col("updated_at").cast("timestamp"), "summary").alias("caption"))
)


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({_clean(x)}) <= {n} THEN {_clean(x)} ELSE rtrim(substr({_clean(x)}, 1, {max(0, n - 3)})) || '...' END"


def _part(x: str, n: int) -> str:
    out = f"({_cut(x, n)})"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _message(n: int, title: str = "title", summary: str = "summary", url: str = "url") -> str:
    category = "coalesce(nullif(category, ''), nullif(content_topic, ''), 'Tin tức')"
    moment = _part("coalesce(nullif(published_at, ''), nullif(crawled_at, ''), '')", 80)
    br = "chr(10)"
    coalesced = f"coalesce(nullif({title}, ''), 'Không có tiêu đề')"
    return (
        f"'📰 {pb.HOUSE} | ' || {_part(category, 120)} || {br} || {br} || '<b>' || {_part(coalesced, 300)} || '</b>' || {br} || {br} || '📝 Tóm tắt:' || {br} || "
        + _part(f"coalesce(nullif({summary}, ''), 'Chưa có tóm tắt.')", n)
        + f" || {br} || {br} || '📌 Nguồn: ' || " + _part(f"coalesce(nullif(source, ''), '{pb.HOUSE}')", 160)
        + f" || CASE WHEN {moment} <> '' THEN {br} || '🗓 Ngày đăng: ' || {moment} ELSE '' END || {br} || '🏷 Chủ đề: ' || " + _part(f"coalesce(nullif(content_topic, ''), {category})", 120)
        + f" || {br} || '🔗 Đọc bài viết: ' || {_part(url, 900)}"
    )


def _fitted(limit: int) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN length(m{n}) <= {limit} THEN m{n} END" for n in (*pb.SUMMARY_STEPS, "c")) + f", rtrim(substr(mc, 1, {limit - 3})) || '...')"


_MESSAGES = "SELECT id, " + ", ".join(f"{_message(n)} AS m{n}" for n in pb.SUMMARY_STEPS) + f", {_message(0, '(' + _cut('title', 120) + ')', chr(39) * 2, '(' + _cut('url', 500) + ')')} AS mc FROM articles_v"
query("telegram_message", f"SELECT id, {_fitted(4096)} AS message, {_fitted(420)} AS short, {_fitted(240)} AS least FROM ({_MESSAGES})")(
    lambda v: v.articles.select("id", pb.fit_telegram(4096).alias("message"), pb.fit_telegram(420).alias("short"), pb.fit_telegram(240).alias("least"))
)


# File names, addresses, errors ------------------------------------------------------------------------------------------
def _slug(x: str) -> str:
    ascii_ = f"regexp_replace(strip_accents(translate(lower(coalesce({x}, '')), 'đ', 'd')), '[^\\x00-\\x7F]+', '', 'g')"
    return f"nullif(substr(regexp_replace(regexp_replace({ascii_}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100), '')"


_NAME = f"concat_ws('-', lpad(CAST(id % 1000 AS VARCHAR), 3, '0'), coalesce({_slug('source')}, '{pb.HOUSE.lower()}'), coalesce({_slug("coalesce(nullif(category, ''), content_topic)")}, 'news'), coalesce({_slug('title')}, 'article-' || substr(sha1(url), 1, 10)))"
query("card_filename", f"SELECT id, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.jpg' AS filename FROM (SELECT id, stem, row_number() OVER (PARTITION BY stem ORDER BY id) AS n FROM (SELECT id, regexp_replace(substr({_NAME}, 1, 180), '^-+|-+$', '', 'g') AS stem FROM articles_v))")(
    lambda v: pb.card_filenames(v.articles, index=F.col("id") % 1000).select("id", "filename")
)
#: Candidates of several widths, in SQL of both dialects: the last of the widest wins.
SRCSET = "CASE CAST(id % 5 AS INT) WHEN 0 THEN concat('/a', CAST(id AS STRING), '.jpg 320w, /b.jpg 640w') WHEN 1 THEN concat('/a.jpg 1x,  /b', CAST(id AS STRING), '.jpg 2x') WHEN 2 THEN concat('/a.jpg, /c', CAST(id AS STRING), '.jpg ,') WHEN 3 THEN concat('/a.jpg 1080w, /d', CAST(id AS STRING), '.jpg 1x, /e.jpg 900w') ELSE '' END"
query("srcset_best", "SELECT id, CASE CAST(id % 5 AS INT) WHEN 0 THEN '/b.jpg' WHEN 1 THEN '/b' || id || '.jpg' WHEN 2 THEN '/c' || id || '.jpg' WHEN 3 THEN '/d' || id || '.jpg' ELSE '' END AS best FROM articles_v")(
    lambda v: v.articles.select("id", pb.srcset_best(F.expr(SRCSET)).alias("best"))
)
query("image_url_variants", "SELECT id, CASE WHEN thumbnail = '' THEN '' ELSE concat_ws(' ', split_part(thumbnail, '?', 1) || '?w=1080&h=610&q=100&dpr=1&fit=crop', split_part(thumbnail, '?', 1), thumbnail) END AS variants FROM articles_v")(
    lambda v: v.articles.select("id", F.array_join(pb.image_url_variants("thumbnail"), " ").alias("variants"))
)
query("normalize_url", "SELECT id, CASE CAST(id % 3 AS INT) WHEN 0 THEN url WHEN 1 THEN 'https://news.example/' || id || '.html' ELSE 'https://news.example/list/' || id || '.html' END AS address FROM articles_v")(
    lambda v: v.articles.select("id", pb.normalize_url(F.lit("https://news.example/list/top"), F.expr("CASE CAST(id % 3 AS INT) WHEN 0 THEN url WHEN 1 THEN concat(' ../', CAST(id AS STRING), '.html') ELSE concat(CAST(id AS STRING), '.html ') END")).alias("address"))
)
_CODE = "CAST(CASE CAST(article_id % 9 AS INT) WHEN 0 THEN 190 WHEN 1 THEN 10 WHEN 2 THEN 613 WHEN 3 THEN 100 WHEN 4 THEN 100 WHEN 5 THEN 1 ELSE 0 END AS INT)"
_SAID = "CASE CAST(article_id % 9 AS INT) WHEN 3 THEN 'Unknown Object' WHEN 4 THEN 'bad value' WHEN 5 THEN 'Session Expired' WHEN 6 THEN 'rate limit' WHEN 7 THEN 'needs pages_manage_posts' ELSE '' END"
query("fb_error_class", f"SELECT publication_id, order_index, CASE WHEN c = 190 OR contains(s, 'expired') THEN 'auth' WHEN c = 10 OR contains(s, 'pages_manage_posts') OR contains(s, 'permission') THEN 'permission' WHEN c = 613 OR contains(s, 'rate') THEN 'rate' WHEN c = 100 AND (contains(s, 'object') OR contains(s, 'page')) THEN 'page' ELSE 'other' END AS class FROM (SELECT publication_id, order_index, {_CODE} AS c, lower({_SAID}) AS s FROM media_v)")(
    lambda v: v.media.select("publication_id", "order_index", pb.error_class(F.expr(_CODE), F.expr(_SAID)).alias("class"))
)
_PATH = "CASE WHEN order_index % 2 = 0 THEN concat(' https://img.example/', CAST(article_id AS STRING), '.jpg') ELSE concat('data/', CAST(article_id AS STRING), '.jpg') END"


@query("media_items_build", f"""SELECT m.publication_id, m.order_index, a.id AS article_id, trim(a.title) AS title, CASE WHEN m.order_index % 2 = 0 THEN trim({_PATH}) ELSE '' END AS image_url, CASE WHEN m.order_index % 2 = 0 THEN '' ELSE trim({_PATH}) END AS local_image_path,
 CASE WHEN a.id % 10 = 1 THEN 'own ' || a.id ELSE {_photo('m.order_index')} END AS photo_caption, {_photo('m.order_index')} IS NULL AS invalid FROM (SELECT publication_id, article_id, CAST(row_number() OVER (PARTITION BY publication_id ORDER BY order_index) AS INT) AS order_index FROM media_v) m JOIN articles_v a ON a.id = m.article_id""")  # fmt: skip
def media_items_build(v):
    listed = v.media.withColumn("order_index", F.expr("CAST(row_number() OVER (PARTITION BY publication_id ORDER BY order_index) AS INT)"))
    rows = F.array_sort(F.collect_list(F.struct("order_index", "article_id", F.expr(_PATH).alias("path"))))
    batches = listed.groupBy("publication_id").agg(rows.alias("r")).select("publication_id", F.col("r.article_id").alias("article_ids"), F.col("r.path").alias("image_paths"))
    own = v.articles.where("id % 10 = 1").select("id", F.concat(F.lit("own  "), F.col("id").cast("string")).alias("caption"))
    return pub.media_items(batches, v.articles, own).select("publication_id", "order_index", "article_id", "title", "image_url", "local_image_path", "photo_caption", "invalid")


# Files and streams ------------------------------------------------------------------------------------------------------
_ALL = ", ".join(files.ARTICLE)


@query("scan_csv", f"SELECT {_ALL} FROM incoming_v")
def scan_csv(v):
    path = files.scratch(v.spark, "articles-csv")
    files.write_csv(v.incoming, path)
    return files.read_csv(v.spark, path)


@query("scan_json", f"SELECT {_ALL} FROM incoming_v")
def scan_json(v):
    path = files.scratch(v.spark, "articles-json")
    files.write_json(v.incoming, path)
    return files.read_json(v.spark, path)


query("to_json_articles", "SELECT id, CAST(json_object('id', id, 'title', title, 'source', source, 'status', status) AS VARCHAR) AS body FROM articles_v")(
    lambda v: v.articles.select("id", F.to_json(F.struct("id", "title", "source", "status")).alias("body"))
)
query("partition_by_topic", f"WITH k AS (SELECT *, coalesce(nullif(content_topic, ''), 'Khác') AS key FROM articles_v), s AS (SELECT *, {_slug('key')} AS file FROM k) SELECT file, count(*) AS n FROM s WHERE key = (SELECT max(key) FROM s t WHERE t.file = s.file) GROUP BY file")(
    lambda v: files.field_files(v.articles, "content_topic").groupBy("file").agg(F.count("*").alias("n"))
)
query("stream_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")(
    lambda v: ev.run_to_table(ev.window_counts(ev.file_stream(v.spark, v.sf_dir, "events"))).drop("users_about")
)

# Edits, summary runs, image sizes, pages ----------------------------------------------------------------------------------
_NOW = "2024-02-10 10:00:00"
#: Edits of two articles in three: every third of them has a blank title, orders are whole numbers, signs and words.
_EDITS = """SELECT ord AS id, concat('  ', source, ' ') AS source, CASE WHEN ord % 9 = 0 THEN ' ' ELSE concat(' ', title, chr(10)) END AS title, url, published_at, summary, content_topic, category,
 CASE CAST(ord % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN '-3' WHEN 2 THEN 'x' ELSE CAST(ord % 50 AS STRING) END AS client_order FROM incoming_v"""
_CAPTIONS = "SELECT a.*, concat('caption ', CAST(id AS STRING)) AS facebook_caption FROM articles_v a"
_EDITED = ("title", "url", "published_at", "summary", "content_topic", "category")
_STRIP = lambda c: f"trim(e.{c}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31)))"
_OK = "e.id IS NOT NULL AND " + _STRIP("title") + " <> '' AND regexp_full_match(e.client_order, '([+-]?[0-9]{1,9})?')"
query("content_edit", f"""WITH e AS ({_EDITS}), a AS ({_CAPTIONS}) SELECT a.id, {', '.join(f'CASE WHEN {_OK} THEN {_STRIP(c)} ELSE a.{c} END AS {c}' for c in _EDITED)},
 CASE WHEN {_OK} THEN coalesce(nullif({_STRIP('source')}, ''), '{pb.HOUSE}') ELSE a.source END AS source, CASE WHEN {_OK} THEN greatest(coalesce(try_cast(e.client_order AS INT), 0), 0) ELSE a.client_order END AS client_order,
 CASE WHEN {_OK} THEN '{_NOW}' ELSE a.updated_at END AS updated_at, CASE WHEN {_OK} AND a.facebook_posted <> 1 THEN '' ELSE a.facebook_caption END AS facebook_caption,
 CASE WHEN e.id IS NULL OR ({_OK}) THEN '' WHEN {_STRIP('title')} = '' THEN 'title' ELSE 'client_order' END AS edit_error FROM a LEFT JOIN e ON a.id = e.id""")(
    lambda v: ar.edit_content(v.spark.sql(_CAPTIONS), v.spark.sql(_EDITS), _NOW).select("id", *_EDITED, "source", "client_order", "updated_at", "facebook_caption", "edit_error"))

BUDGET = 40
_CONTENTS = "SELECT url FROM articles_v WHERE url <> '' GROUP BY url HAVING min(id) % 13 <> 0"
_CLEAN_SUMMARY = _clean("a.summary")
query("enrich_plan", f"""WITH t AS ({_CONTENTS}), r AS (SELECT a.id, a.url, a.summary_source, c.summary_source AS cached, c.url IS NOT NULL AS in_cache, t.url IS NOT NULL AS content, length({_CLEAN_SUMMARY}) >= 30 AS ok
 FROM articles_v a LEFT JOIN summary_cache_v c ON a.url = c.url LEFT JOIN t ON a.url = t.url),
 m AS (SELECT id, min(id) OVER (PARTITION BY CASE WHEN content THEN url ELSE CAST(id AS STRING) END) AS f FROM r WHERE NOT ok AND NOT in_cache),
 n AS (SELECT id, f, dense_rank() OVER (ORDER BY f) AS nth FROM m)
SELECT r.id, CASE WHEN ok THEN 'keep' WHEN in_cache THEN 'cache' WHEN nth > {BUDGET} THEN 'pending' WHEN f < r.id THEN 'cache' ELSE 'generate' END AS action,
 CASE WHEN ok THEN coalesce(nullif(summary_source, ''), 'crawler') WHEN in_cache THEN cached WHEN nth > {BUDGET} THEN coalesce(nullif(summary_source, ''), 'pending') WHEN content THEN 'fallback' ELSE 'missing_content' END AS summary_source
FROM r LEFT JOIN n ON r.id = n.id""")(lambda v: ar.enrich_plan(v.articles, v.summary_cache, v.spark.sql(_CONTENTS), BUDGET))  # fmt: skip

#: Sizes of candidate images of an article; the third has none.
_SIZES = "SELECT id, n, CASE n WHEN 0 THEN 180 + id % 1900 WHEN 1 THEN 90 + id % 700 ELSE 0 END AS w, CASE n WHEN 0 THEN 108 + id % 1300 WHEN 1 THEN 90 + id % 500 ELSE 100 END AS h FROM articles_v"
_SCORE = "CASE WHEN w > 0 AND h > 0 THEN 1.0::DOUBLE / greatest(1080.0::DOUBLE / w, 610.0::DOUBLE / h, 0.01::DOUBLE) + least(w::DOUBLE * h / 658800, 2.0::DOUBLE) * 0.18::DOUBLE - abs(w::DOUBLE / h - 1080.0::DOUBLE / 610) / (1080.0::DOUBLE / 610) * 0.08::DOUBLE END"
query("thumbnail_score", f"WITH s AS (SELECT s.*, {_SCORE} AS score FROM ({_SIZES}, (SELECT unnest([0, 1, 2]) AS n)) s) SELECT id, CAST(arg_max(n, score) AS INT) AS best, round(max(score), 6) AS score FROM s GROUP BY id")(
    lambda v: v.spark.sql(f"{_SIZES} LATERAL VIEW explode(array(0, 1, 2)) AS n").withColumn("score", pb.thumbnail_score("w", "h")).groupBy("id").agg(F.max_by("n", F.struct("score", -F.col("n"))).alias("best"), F.round(F.max("score"), 6).alias("score")))

#: The pages of the tables are of no real site: this one takes their navigation links.
ANY_SITE = ex.Site("pages", "https://pages.example/", "pages.example", "", "", "", blocks=("nav li", "article"), title="h1 a[href], a[href]", loose="a[href]", summaries=("p",), near_names=("article",), near_classes=(), path="[^/]", least_title=2)
query("html_site_articles")(lambda v: ex.extract_articles(v.pages, ANY_SITE, _NOW))
query("html_page_details")(lambda v: ex.page_details(v.pages.select("page_id", "url", "html")))
