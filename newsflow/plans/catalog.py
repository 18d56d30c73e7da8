"""Named queries over the adapter views, each with its DuckDB equivalent where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..fixtures import AS_OF
from ..functions import text as tx
from ..functions import topics as tp
from ..operators import articles as ar

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str = "") -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.load(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql:
            ORACLES[name] = fixtures.with_views(sql)
        return f

    return add


# DuckDB fragments -----------------------------------------------------------------------------------------------------
def _when(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({x} AS TIMESTAMP) END"


def _date(status: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in ar.DATES.get(status, ar.DATES[""])) + ", created_at)"


def _low(x: str) -> str:
    return f"translate({x}, '{tx.UPPER}', '{tx.LOWER}')"


def _like(x: str, p: str) -> str:
    return f"{_low(x)} LIKE '{p.translate(str.maketrans(tx.UPPER, tx.LOWER))}'"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce({x}, '')), 'đ', 'd')), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _key(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def _order(status: str) -> str:
    d = _when(_date(status))
    if status == "approved":
        own = " OR ".join(_like("coalesce(source, '')", p) for p in ("%ptit%", "%buu chinh%", "%bưu chính%"))
        return (f"CASE WHEN coalesce(client_order, 0) > 0 THEN 0 ELSE 1 END, CASE WHEN coalesce(client_order, 0) > 0 THEN client_order ELSE {ar.UNSET_ORDER} END, CAST({d} AS DATE) DESC NULLS LAST, {d} DESC NULLS LAST, "
                f"CASE WHEN {own} THEN 0 ELSE 1 END, nullif(published_at, '') DESC NULLS LAST, id DESC")  # fmt: skip
    return f"CAST({d} AS DATE) DESC NULLS LAST, {d} DESC NULLS LAST, nullif(published_at, '') DESC NULLS LAST, id DESC"


_P, _C, _K = "nullif(published_at, '')", "nullif(crawled_at, '')", "nullif(created_at, '')"
RECENT = f"{_when(_P)} DESC NULLS LAST, {_P} DESC NULLS LAST, {_when(_C)} DESC NULLS LAST, {_C} DESC NULLS LAST, {_when(_K)} DESC NULLS LAST, id DESC"
PUBLIC = f"{_low('trim(status)')} IN ({', '.join(repr(x) for x in tp.PUBLIC)})"
RAW = "coalesce(nullif(category, ''), nullif(content_topic, ''), '')"


def _canonical_py(source: str = "source") -> str:
    key = _key(RAW)
    rules = [f"WHEN contains({_key(source)}, 'ptit') OR contains({key}, 'ptit') THEN 'Tin tức PTIT'"]
    rules += ["WHEN " + " OR ".join(f"contains({key}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in tp.CANONICAL.items()]
    return f"CASE {' '.join(rules)} WHEN contains({key}, 'tin tuc chung') THEN 'Thời sự' WHEN trim({RAW}) = '' THEN 'Tin mới' ELSE trim({RAW}) END"


def _canonical_sql() -> str:
    rules = [f"WHEN {_like('source', '%PTIT%')} OR {_like(RAW, '%PTIT%')} THEN 'Tin tức PTIT'"]
    rules += ["WHEN " + " OR ".join(_like(RAW, f"%{w}%") for w in words) + f" THEN '{label}'" for label, words in tp.CANONICAL_LIKE.items()]
    return f"CASE {' '.join(rules)} WHEN {_like(RAW, '%Tin tức chung%')} OR {_like(RAW, '%tin tuc chung%')} THEN 'Thời sự' ELSE {RAW} END"


def pos(df: DataFrame, *order: Column) -> DataFrame:
    return ar.numbered(df, list(order))


# Listings -------------------------------------------------------------------------------------------------------------
def _page_sql(status: str, cond: str = "true", limit: int = 12, offset: int = 0) -> str:
    return f"SELECT pos, id, title, status FROM (SELECT *, row_number() OVER (ORDER BY {_order(status)}) AS pos FROM articles_v WHERE status = '{status}' AND {cond}) WHERE pos > {offset} AND pos <= {offset + limit}"


for _s in tp.STATUSES:
    query(f"{_s}_page", _page_sql(_s))(lambda v, s=_s: ar.page(ar.where(v.articles, s), ar.order_of(s)).select("pos", "id", "title", "status"))
    query(f"date_filter_{_s}", f"SELECT id, {_date(_s)} AS moment FROM articles_v WHERE status = '{_s}' AND CAST({_when(_date(_s))} AS DATE) = DATE '2024-02-08'" if _s != "pending" else f"SELECT id, {_date(_s)} AS moment FROM articles_v WHERE status = 'pending' AND CAST({_when(_date(_s))} AS DATE) = DATE '{AS_OF}'")(
        lambda v, s=_s: ar.where(v.articles, s, date=AS_OF if s == "pending" else "2024-02-08").select("id", ar.date_text(s).alias("moment")))


@query("page_n", _page_sql("approved", offset=24))
def page_n(v):
    rows = ar.where(v.articles, "approved")
    return ar.page(rows, ar.business_order(), 3, total=rows.count()).select("pos", "id", "title", "status")


@query("pagination_window", "SELECT p AS current, greatest(1, least(p - 2, 30)) AS first, least(34, greatest(p + 2, 5)) AS last FROM unnest(range(1, 35)) AS t(p)")
def pagination_window(v):
    p = F.col("current")
    return v.spark.range(1, 35).select(F.col("id").alias("current")).select("current", F.greatest(F.lit(1), F.least(p - 2, F.lit(30))).alias("first"), F.least(F.lit(34), F.greatest(p + 2, F.lit(5))).alias("last"))


@query("filter_conjunctive", f"SELECT id, title, source FROM articles_v WHERE status = 'approved' AND ({_like('title', '%en%')} OR {_like('summary', '%en%')} OR {_like('source', '%en%')}) AND {_canonical_sql()} = 'Giáo dục' AND source = 'VNExpress'")
def filter_conjunctive(v):
    return ar.where(v.articles, "approved", "EN", "Giáo dục", "VNExpress").select("id", "title", "source")


@query("search_like", f"SELECT id, title FROM articles_v WHERE {_like('title', '%Th_ %é%')} OR {_like('summary', '%Th_ %é%')} OR {_like('source', '%Th_ %é%')}")
def search_like(v):
    return ar.where(v.articles, q="Th_ %é").select("id", "title")


@query("topic_raw", "SELECT id FROM articles_v WHERE content_topic = 'Giáo dục' OR category = 'Giáo dục'")
def topic_raw(v):
    return ar.where(v.articles, topic="Giáo dục", canonical=False).select("id")


query("topic_canonical", f"SELECT id FROM articles_v WHERE {_canonical_sql()} = 'Khoa học - Công nghệ'")(lambda v: ar.where(v.articles, topic="Khoa học - Công nghệ").select("id"))
query("topic_general", f"SELECT id FROM articles_v WHERE NOT ({_like('source', '%ptit%')} OR {_like('source', '%buu chinh%')} OR {_like('source', '%bưu chính%')})")(lambda v: ar.where(v.articles, topic="Tin tức chung").select("id"))
query("canonical_topic_py", f"SELECT id, {_canonical_py()} AS topic FROM articles_v")(lambda v: v.articles.select("id", tp.canonical_topic().alias("topic")))
query("canonical_topic_sql", f"SELECT id, {_canonical_sql()} AS topic FROM articles_v")(lambda v: v.articles.select("id", tp.canonical_topic_like().alias("topic")))


@query("canonical_topic_diff", f"SELECT a, b, count(*) AS total FROM (SELECT {_canonical_py()} AS a, {_canonical_sql()} AS b FROM articles_v) WHERE a <> b GROUP BY a, b")
def canonical_topic_diff(v):
    return v.articles.select(tp.canonical_topic().alias("a"), tp.canonical_topic_like().alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("total"))


_LABELS = " ".join(f"WHEN {_key('category')} = {_key(repr(t))} THEN '{t}'" for t in tp.CLIENT_TOPICS)
query("resolve_topic", f"SELECT id, CASE {_LABELS} ELSE trim(category) END AS topic FROM articles_v")(lambda v: v.articles.select("id", tp.resolve_topic(F.col("category")).alias("topic")))
query("public_rows", f"SELECT id, status FROM articles_v WHERE {PUBLIC}")(lambda v: v.articles.where(tp.is_public()).select("id", "status"))
query("status_groups", "SELECT id, CASE WHEN lower(trim(status)) IN ('approved', 'published') THEN 'published' WHEN status IN ('pending', 'rejected', 'deleted') THEN status ELSE 'other' END AS grp FROM articles_v")(
    lambda v: v.articles.select("id", tp.status_group("status").alias("grp")))
query("publishable", "SELECT id FROM articles_v WHERE trim(status) = 'Đã đăng' OR lower(trim(status)) IN ('approved', 'published', 'da dang')")(lambda v: v.articles.where(tp.is_publishable()).select("id"))
query("fb_status", "SELECT id, CASE WHEN facebook_posted = 1 AND facebook_publish_status IN ('', 'not_posted') THEN 'success' WHEN facebook_publish_status = '' THEN 'not_posted' ELSE facebook_publish_status END AS fb FROM articles_v")(
    lambda v: v.articles.select("id", F.when((F.col("facebook_posted") == 1) & F.col("facebook_publish_status").isin("", "not_posted"), "success").otherwise(F.coalesce(tx.filled("facebook_publish_status"), F.lit("not_posted"))).alias("fb")))
query("has_http_thumbnail", "SELECT id FROM articles_v WHERE regexp_matches(thumbnail, '^https?://[^/]+')")(lambda v: v.articles.where(F.col("thumbnail").rlike("^https?://[^/]+")).select("id"))
query("summary_status", "SELECT id, length(trim(regexp_replace(summary, '\\s+', ' ', 'g'))) >= 30 AS has_summary, summary_source IN ('fallback', 'missing_content', 'crawler') AS upgradeable FROM articles_v")(
    lambda v: v.articles.select("id", (F.length(tx.clean("summary")) >= 30).alias("has_summary"), F.col("summary_source").isin("fallback", "missing_content", "crawler").alias("upgradeable")))
query("articles_today", f"SELECT id FROM articles_v WHERE {PUBLIC} AND starts_with(coalesce(nullif(published_at, ''), nullif(crawled_at, ''), nullif(created_at, ''), updated_at), '{AS_OF}')")(
    lambda v: v.articles.where(tp.is_public() & F.coalesce(tx.filled("published_at"), tx.filled("crawled_at"), tx.filled("created_at"), F.col("updated_at")).startswith(AS_OF)).select("id"))
query("point_lookup", "SELECT id, title, url FROM articles_v WHERE id = 77")(lambda v: v.articles.where("id = 77").select("id", "title", "url"))
query("date_clamp", f"SELECT id, CASE WHEN substr(crawled_at, 1, 10) > '{AS_OF}' THEN '{AS_OF}' ELSE substr(crawled_at, 1, 10) END AS day FROM articles_v")(lambda v: v.articles.select("id", F.least(F.substring("crawled_at", 1, 10), F.lit(AS_OF)).alias("day")))


@query("article_card_projection", "SELECT id, coalesce(nullif(trim(title), ''), 'Không có tiêu đề') AS title, coalesce(nullif(trim(image_path), ''), nullif(trim(thumbnail), ''), '') AS image, coalesce(nullif(trim(source), ''), 'Không rõ') AS source, coalesce(nullif(published_at, ''), nullif(crawled_at, ''), created_at) AS published FROM articles_v WHERE status = 'approved'")
def article_card_projection(v):
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return v.articles.where("status = 'approved'").select("id", F.coalesce(some("title"), F.lit("Không có tiêu đề")).alias("title"), F.coalesce(some("image_path"), some("thumbnail"), F.lit("")).alias("image"),
                                                          F.coalesce(some("source"), F.lit("Không rõ")).alias("source"), ar.date_text("").alias("published"))


query("api_articles", f"SELECT pos, id, title, coalesce(nullif(published_at, ''), nullif(crawled_at, ''), created_at) AS published_at FROM (SELECT *, row_number() OVER (ORDER BY {_order('approved')}) AS pos FROM articles_v WHERE status = 'approved')")(
    lambda v: pos(v.articles.where("status = 'approved'"), *ar.business_order()).select("pos", "id", "title", ar.date_text("").alias("published_at")))
query("derive_date_folder", "SELECT id, coalesce(CASE WHEN regexp_matches(published_at, '^\\d{4}-\\d{2}-\\d{2}') THEN substr(published_at, 1, 10) END, CASE WHEN regexp_matches(crawled_at, '^\\d{4}-\\d{2}-\\d{2}') THEN substr(crawled_at, 1, 10) END, 'uncategorized') AS folder FROM articles_v")(
    lambda v: v.articles.select("id", F.coalesce(*(F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)) for c in ("published_at", "crawled_at")), F.lit("uncategorized")).alias("folder")))
query("sort_published", "SELECT id, row_number() OVER (ORDER BY published_at DESC, crawled_at DESC, url DESC, id) AS pos FROM articles_v")(
    lambda v: pos(v.articles, F.coalesce("published_at", F.lit("")).desc(), F.coalesce("crawled_at", F.lit("")).desc(), F.coalesce("url", F.lit("")).desc(), F.col("id")).select("id", "pos"))
query("recent_articles", f"SELECT id, row_number() OVER (ORDER BY {RECENT}) AS pos FROM articles_v QUALIFY pos <= 20")(lambda v: ar.page(v.articles, ar.recent_order(), size=20).select("id", "pos"))
query("latest_approved", f"SELECT id, row_number() OVER (ORDER BY {_when(_P)} DESC NULLS LAST, id DESC) AS pos FROM articles_v WHERE status IN ('approved', 'published', 'Đã đăng') QUALIFY pos <= 10")(
    lambda v: ar.page(v.articles.where(F.col("status").isin("approved", "published", "Đã đăng")), [ar.moment(tx.filled("published_at")).desc(), F.col("id").desc()], size=10).select("id", "pos"))
query("client_order_rank", f"SELECT id, row_number() OVER (ORDER BY {_order('approved')}) AS rank FROM articles_v WHERE status = 'approved'")(
    lambda v: ar.numbered(v.articles.where("status = 'approved'"), ar.business_order(), "rank").select("id", "rank"))
for _n, _d in (("move_up", -1), ("move_down", 1)):
    query(_n, f"WITH r AS (SELECT id, row_number() OVER (ORDER BY {_order('approved')}) AS k FROM articles_v WHERE status = 'approved'), a AS (SELECT k FROM r WHERE id = 101) SELECT id, CASE WHEN r.k = a.k THEN r.k + {_d} WHEN r.k = a.k + {_d} THEN a.k ELSE r.k END AS client_order FROM r, a")(
        lambda v, d=_d: ar.move(v.articles, 101, d))

# Facets and dashboard ---------------------------------------------------------------------------------------------------
query("facet_sources", "SELECT DISTINCT source FROM articles_v WHERE status = 'approved' AND source <> ''")(lambda v: v.articles.where("status = 'approved' AND source <> ''").select("source").distinct())
query("facet_topics", "SELECT content_topic AS topic FROM articles_v WHERE content_topic <> '' UNION SELECT category FROM articles_v WHERE category <> ''")(
    lambda v: v.articles.where("content_topic <> ''").select(F.col("content_topic").alias("topic")).union(v.articles.where("category <> ''").select("category")).distinct())
query("facet_client_topics", f"SELECT DISTINCT {_canonical_py()} AS topic FROM articles_v WHERE status = 'approved' UNION SELECT 'Tin tức chung' FROM articles_v WHERE status = 'approved' AND NOT {_like('source', '%ptit%')}")(
    lambda v: v.articles.where("status = 'approved'").select(tp.canonical_topic().alias("topic")).union(v.articles.where((F.col("status") == "approved") & ~tx.like("source", "%ptit%")).select(F.lit("Tin tức chung"))).distinct())
query("counts_by_status", "SELECT s AS status, count(a.id) AS total FROM (SELECT unnest(['approved', 'deleted', 'pending', 'rejected']) AS s UNION SELECT status FROM articles_v) LEFT JOIN articles_v a ON a.status = s GROUP BY s")(lambda v: ar.status_counts(v.articles))
query("status_raw_counts", "SELECT coalesce(nullif(trim(status), ''), 'unknown') AS status, count(*) AS total FROM articles_v GROUP BY 1")(lambda v: ar.tally(v.articles, F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown")), "status"))
query("source_counts", "SELECT coalesce(nullif(trim(source), ''), 'Không rõ') AS label, count(*) AS total FROM articles_v GROUP BY 1")(lambda v: ar.tally(v.articles, F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("Không rõ")), "label"))
query("topic_counts_top10", "SELECT coalesce(nullif(trim(content_topic), ''), nullif(trim(category), ''), 'Chưa phân loại') AS label, count(*) AS total FROM articles_v GROUP BY 1 ORDER BY total DESC, label LIMIT 10")(
    lambda v: ar.tally(v.articles, F.coalesce(F.nullif(F.trim("content_topic"), F.lit("")), F.nullif(F.trim("category"), F.lit("")), F.lit("Chưa phân loại")), "label").orderBy(F.desc("total"), "label").limit(10))
query("count_filtered", "SELECT count(*) AS total FROM articles_v WHERE status = 'approved' AND source = 'VNExpress'")(lambda v: ar.where(v.articles, "approved", source="VNExpress").agg(F.count("*").alias("total")))
query("count_public", f"SELECT least(count(*), 5000) AS total FROM articles_v WHERE {PUBLIC}")(lambda v: ar.search(v.articles, limit=5000).agg(F.count("*").alias("total")))
_POSTED = "facebook_posted = 1"
query("fb_dashboard_counts", f"SELECT CAST(sum(CASE WHEN {_POSTED} THEN 1 ELSE 0 END) AS BIGINT) AS posted, CAST(sum(CASE WHEN status = 'approved' AND NOT {_POSTED} THEN 1 ELSE 0 END) AS BIGINT) AS approved_not_posted, count_if(facebook_publish_status = 'failed') AS failed, count_if(facebook_publish_status = 'posting') AS posting FROM articles_v")(lambda v: ar.facebook_counts(v.articles))
query("quality_missing", "SELECT count_if(trim(summary) = '') AS missing_summary, count_if(trim(thumbnail) = '' AND trim(image_path) = '') AS missing_image, count_if(trim(url) = '') AS missing_url FROM articles_v")(lambda v: ar.quality_warnings(v.articles))
query("duplicate_url_groups", "SELECT count(*) AS groups FROM (SELECT url FROM articles_v WHERE trim(url) <> '' GROUP BY url HAVING count(*) > 1)")(lambda v: v.articles.where(~tx.blank("url")).groupBy("url").count().where("count > 1").agg(F.count("*").alias("groups")))
query("stale_sources", "SELECT source, max(crawled_at) AS latest FROM articles_v WHERE trim(source) <> '' GROUP BY source HAVING NOT starts_with(max(crawled_at), '2024-01-28')")(
    lambda v: v.articles.where(~tx.blank("source")).groupBy("source").agg(F.max("crawled_at").alias("latest")).where(~F.col("latest").startswith("2024-01-28")))
query("latest_published", "SELECT coalesce(max(nullif(published_at, '')), max(crawled_at)) AS latest FROM articles_v")(lambda v: v.articles.agg(F.coalesce(F.max(tx.filled("published_at")), F.max("crawled_at")).alias("latest")))
query("dashboard_cards", f"SELECT count(*) AS total, count_if(status = 'approved') AS approved, count_if(status = 'pending') AS pending, count_if(starts_with(crawled_at, '{AS_OF}')) AS crawled_today, count_if({_POSTED}) AS posted, count_if(trim(summary) = '') AS missing_summary, count(DISTINCT source) AS sources FROM articles_v")(
    lambda v: v.articles.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("crawled_at").startswith(AS_OF)).alias("crawled_today"),
                             F.count_if(F.col("facebook_posted") == 1).alias("posted"), F.count_if(tx.blank("summary")).alias("missing_summary"), F.countDistinct("source").alias("sources")))
query("source_stats", "SELECT source, count(*) AS total FROM incoming_v GROUP BY source")(lambda v: ar.tally(v.incoming, F.col("source"), "source"))
query("enrichment_stats", "SELECT summary_source, count(*) AS total FROM articles_v GROUP BY 1")(lambda v: ar.tally(v.articles, F.col("summary_source"), "summary_source"))
query("bulk_result_summary", "SELECT count_if(status = 'sent') AS sent, count_if(status = 'skipped') AS skipped, count_if(status = 'failed') AS failed, min(CASE WHEN status = 'failed' THEN article_id END) AS first_failed FROM notification_logs_v")(
    lambda v: v.notification_logs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("sent", "skipped", "failed")), F.min(F.when(F.col("status") == "failed", F.col("article_id"))).alias("first_failed")))

# Dedup, merge, upsert -------------------------------------------------------------------------------------------------
D1 = ["source", "title", "url", "crawled_at", "published_at", "thumbnail", "summary", "summary_source", "newspaper_type", "content_topic", "category"]
_FIRST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM {} WHERE url <> '') WHERE rn = 1"
query("dedup_first_by_url", f"SELECT ord, url, title FROM ({_FIRST.format('incoming_v')})")(lambda v: ar.keep_first(v.incoming).select("ord", "url", "title"))
query("new_articles_anti", f"SELECT ord, url FROM ({_FIRST.format('incoming_v')}) WHERE url NOT IN (SELECT url FROM master_v WHERE url <> '')")(lambda v: ar.new_rows(v.incoming, v.master).select("ord", "url"))
_LAST = "l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord DESC) AS rn FROM incoming_v WHERE url <> '') WHERE rn = 1)"
query("master_merge", f"WITH {_LAST} SELECT m.ord, m.url, {', '.join(f'coalesce(nullif(l.{c}, {chr(39) * 2}), m.{c}) AS {c}' for c in D1 if c != 'url')} FROM master_v m LEFT JOIN l ON l.url = m.url UNION ALL SELECT ord + 1000000000, url, {', '.join(c for c in D1 if c != 'url')} FROM ({_FIRST.format('incoming_v')}) WHERE url NOT IN (SELECT url FROM master_v)")(
    lambda v: ar.merge_master(v.master, v.incoming, D1).select("ord", *D1))
query("replace_by_url", f"WITH {_LAST} SELECT {', '.join(f'CASE WHEN l.url IS NOT NULL THEN l.{c} ELSE m.{c} END AS {c}' for c in D1)} FROM master_v m LEFT JOIN l ON l.url = m.url UNION ALL SELECT {', '.join(D1)} FROM incoming_v WHERE url <> '' AND url NOT IN (SELECT url FROM master_v)")(
    lambda v: ar.replace_by_url(v.master, v.incoming, D1))
query("union_sources_dedup", "SELECT ord, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, ord) AS rn FROM (SELECT 0 AS src, ord, url FROM master_v UNION ALL SELECT 1, ord, url FROM incoming_v) WHERE url <> '') WHERE rn = 1")(
    lambda v: ar.keep_first(v.master.select(F.struct(F.lit(0).alias("s"), "ord").alias("k"), "ord", "url").union(v.incoming.select(F.struct(F.lit(1).alias("s"), "ord").alias("k"), "ord", "url")), order="k").select("ord", "url"))
query("enrich_with_cache", "SELECT a.id, CASE WHEN c.url IS NOT NULL AND length(trim(a.summary)) < 30 THEN c.summary ELSE a.summary END AS summary, CASE WHEN c.url IS NOT NULL AND length(trim(a.summary)) < 30 THEN c.summary_source ELSE a.summary_source END AS summary_source FROM articles_v a LEFT JOIN summary_cache_v c ON a.url = c.url")(
    lambda v: v.articles.join(v.summary_cache.select(F.col("url").alias("u"), F.col("summary").alias("s"), F.col("summary_source").alias("ss")), F.col("url") == F.col("u"), "left").select("id", F.when(F.col("u").isNotNull() & (F.length(F.trim("summary")) < 30), F.col("s")).otherwise(F.col("summary")).alias("summary"), F.when(F.col("u").isNotNull() & (F.length(F.trim("summary")) < 30), F.col("ss")).otherwise(F.col("summary_source")).alias("summary_source")))
query("status_transition", "SELECT id, CASE WHEN id % 50 = 5 THEN 'approved' ELSE status END AS status, CASE WHEN id % 50 = 5 THEN '2024-02-10 10:00:00' ELSE reviewed_at END AS reviewed_at, CASE WHEN id % 50 = 5 THEN '2024-02-10 10:00:00' ELSE approved_at END AS approved_at, deleted_at FROM articles_v")(
    lambda v: ar.set_status(v.articles, F.col("id") % 50 == 5, "approved", "2024-02-10 10:00:00").select("id", "status", "reviewed_at", "approved_at", "deleted_at"))
query("clear_facebook", "SELECT id, CASE WHEN facebook_publish_status = 'failed' THEN 0 ELSE facebook_posted END AS facebook_posted, CASE WHEN facebook_publish_status = 'failed' THEN 'not_posted' ELSE facebook_publish_status END AS facebook_publish_status FROM articles_v")(
    lambda v: v.articles.select("id", F.when(F.col("facebook_publish_status") == "failed", 0).otherwise(F.col("facebook_posted")).alias("facebook_posted"), F.when(F.col("facebook_publish_status") == "failed", "not_posted").otherwise(F.col("facebook_publish_status")).alias("facebook_publish_status")))
query("backfill_schema", "SELECT id, CASE WHEN trim(updated_at) = '' THEN created_at ELSE updated_at END AS updated_at, CASE WHEN status = 'approved' AND approved_at = '' THEN coalesce(nullif(reviewed_at, ''), updated_at) ELSE approved_at END AS approved_at FROM articles_v")(
    lambda v: v.articles.select("id", F.when(tx.blank("updated_at"), F.col("created_at")).otherwise(F.col("updated_at")).alias("updated_at"), F.when((F.col("status") == "approved") & (F.col("approved_at") == ""), F.coalesce(tx.filled("reviewed_at"), "updated_at")).otherwise(F.col("approved_at")).alias("approved_at")))
_TAKE = ("source", "title", "published_at", "crawled_at", "thumbnail", "newspaper_type", "content_topic", "category")
_UP = ", ".join(f"max_by({c}, ord) FILTER (WHERE trim({c}) <> '') AS n_{c}" for c in _TAKE) + ", " + ", ".join(f"min_by({c}, ord) FILTER (WHERE trim({c}) <> '') AS n_{c}" for c in ("summary", "summary_source"))
query("cms_upsert", f"""WITH g AS (SELECT * FROM incoming_v WHERE trim(source) NOT IN ('Dân trí', '24h') AND trim(title) <> ''), u AS (SELECT url, {_UP} FROM g WHERE trim(url) <> '' GROUP BY url), c AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN '' ELSE url END AS url) FROM articles_v)
SELECT id, c.url, {', '.join(f'coalesce(n_{c}, {c}) AS {c}' for c in _TAKE)}, CASE WHEN trim(summary) = '' THEN coalesce(n_summary, summary) ELSE summary END AS summary, CASE WHEN trim(summary_source) = '' THEN coalesce(n_summary_source, summary_source) ELSE summary_source END AS summary_source, status, CASE WHEN n_title IS NOT NULL THEN '2024-02-10 10:00:00' ELSE updated_at END AS updated_at FROM c LEFT JOIN u ON u.url = c.url
UNION ALL SELECT NULL, url, {', '.join(f"coalesce(n_{c}, '')" for c in (*_TAKE, 'summary', 'summary_source'))}, 'pending', '2024-02-10 10:00:00' FROM u WHERE url NOT IN (SELECT url FROM c)
UNION ALL SELECT NULL, url, {', '.join((*_TAKE, 'summary', 'summary_source'))}, 'pending', '2024-02-10 10:00:00' FROM g WHERE trim(url) = ''""")(lambda v: ar.upsert(v.articles.withColumn("url", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("url"))), v.incoming, "2024-02-10 10:00:00"))  # fmt: skip

# Text -------------------------------------------------------------------------------------------------------------------
query("clean_text", "SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM documents")(lambda v: v.documents.select("doc_id", tx.clean("text").alias("t")))
query("normalize_text", f"SELECT doc_id, {_fold('text')} AS t FROM documents")(lambda v: v.documents.select("doc_id", tx.normalize("text").alias("t")))
query("text_key", f"SELECT id, {_key('category')} AS k FROM articles_v")(lambda v: v.articles.select("id", tx.text_key("category").alias("k")))
query("slugify", "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents(translate(lower(title), 'đ', 'd')), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'khac') AS slug FROM articles_v")(lambda v: v.articles.select("id", tx.slugify("title").alias("slug")))
query("fallback_summary", "WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents) SELECT doc_id, substr(regexp_replace(array_to_string(list_slice(p, 1, 2), ' '), '^[\"'' ]+|[\"'' ]+$', '', 'g'), 1, 450) AS summary FROM s")(
    lambda v: v.documents.select("doc_id", tx.first_sentences("text").alias("summary")))
_SQ = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
query("truncate_summary", f"SELECT doc_id, CASE WHEN length({_SQ}) <= 400 THEN {_SQ} ELSE regexp_replace(regexp_replace(rtrim(substr({_SQ}, 1, 399)), ' [^ ]*$', ''), '[.,;: ]+$', '') || '…' END AS t FROM documents")(lambda v: v.documents.select("doc_id", tx.truncate("text").alias("t")))
query("mask_token", "SELECT id, CASE WHEN trim(url) = '' THEN '' WHEN length(trim(url)) <= 10 THEN '***' ELSE substr(trim(url), 1, 6) || '...' || right(trim(url), 4) END AS m FROM articles_v")(lambda v: v.articles.select("id", tx.mask("url").alias("m")))
query("batch_id", "SELECT publication_id, batch, substr(sha256(string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY n)), 1, 16) AS batch_id FROM (SELECT *, (n - 1) // 10 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY publication_id ORDER BY order_index) AS n FROM media_v)) GROUP BY publication_id, batch")(
    lambda v: ar.batches(v.media, "publication_id", "order_index", "article_id").select("publication_id", "batch", "batch_id"))
query("thumbnail_cache_key", "SELECT id, sha256(thumbnail) || '.jpg' AS k FROM articles_v WHERE thumbnail <> ''")(lambda v: v.articles.where("thumbnail <> ''").select("id", F.concat(F.sha2("thumbnail", 256), F.lit(".jpg")).alias("k")))
query("sanitize_message", "SELECT conv_id, turn, substr(trim(regexp_replace(message, '\\s+', ' ', 'g')), 1, 500) AS m FROM messages_v")(lambda v: v.messages.select("conv_id", "turn", F.substring(tx.clean("message"), 1, 500).alias("m")))
query("classify_news_type", "SELECT id, " + "CASE " + " ".join(f"WHEN contains(lower(source), '{k}') THEN '{x}'" for k, x in tp.NEWS_TYPES.items()) + " ELSE 'Không xác định' END AS t FROM articles_v")(lambda v: v.articles.select("id", tp.classify_news_type("source").alias("t")))
_TEXT = "lower(title || ' ' || summary)"
query("classify_topic", "SELECT id, CASE " + " ".join(f"WHEN category = '{k}' THEN '{x}'" for k, x in tp.BY_CATEGORY.items()) + " " + " ".join("WHEN " + " OR ".join(f"contains({_TEXT}, '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in tp.KEYWORDS.items()) + " ELSE coalesce(nullif(category, ''), 'Khác') END AS t FROM articles_v")(
    lambda v: v.articles.select("id", tp.classify_topic("title", "summary", "category").alias("t")))

# Search and chat --------------------------------------------------------------------------------------------------------
_WINDOW = f"(SELECT *, row_number() OVER (ORDER BY {RECENT}) AS w FROM articles_v WHERE {PUBLIC} QUALIFY w <= 250)"


def _search_sql(cond: str) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY w) AS pos FROM {_WINDOW} WHERE {cond} QUALIFY pos <= 5"


def _some(n: str, cs: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({_fold(c)}, '{n}')" for c in cs) + ")"


query("public_search_window", f"SELECT id, w FROM {_WINDOW}")(lambda v: pos(ar.public_window(v.articles, 5), *ar.recent_order()).select("id", F.col("pos").alias("w")))
query("retrieve_latest", _search_sql("true"))(lambda v: ar.search(v.articles).select("id", "pos"))
query("retrieve_source", _search_sql(_some("vnexpress", ("source",))))(lambda v: ar.search(v.articles, source="VNExpress").select("id", "pos"))
query("retrieve_topic", _search_sql(_some("giao duc", ("content_topic", "category", "title", "summary"))))(lambda v: ar.search(v.articles, topic="Giáo dục").select("id", "pos"))
query("retrieve_keyword", _search_sql(f"regexp_matches({_fold(chr(39) + chr(39))} || {_fold('concat_ws(chr(32), title, summary, source, category, content_topic)')}, '\\bas\\b')"))(lambda v: ar.search(v.articles, keyword="As").select("id", "pos"))
query("search_folded", f"SELECT id FROM articles_v WHERE {_some('khoa hoc', ('content_topic', 'category'))}")(lambda v: v.articles.where(tx.matches("khoa hoc", tx.normalize("content_topic")) | tx.matches("khoa hoc", tx.normalize("category"))).select("id"))
query("search_by_topic", f"SELECT id FROM articles_v WHERE {PUBLIC} AND {_some('suc khoe', ('content_topic', 'category', 'title', 'summary'))}")(
    lambda v: v.articles.where(tp.is_public()).where(tx.matches("suc khoe", tx.normalize("content_topic")) | tx.matches("suc khoe", tx.normalize("category")) | tx.matches("suc khoe", tx.normalize("title")) | tx.matches("suc khoe", tx.normalize("summary"))).select("id"))


def _alias_sql(table: dict[str, tuple[str, ...]]) -> str:
    test = lambda a: f"regexp_matches(n, '\\b{a}\\b')" if len(a) <= 2 or " " not in a else f"contains(n, '{a}')"
    return "CASE " + " ".join("WHEN " + " OR ".join(test(a) for a in aliases) + f" THEN '{label}'" for label, aliases in table.items()) + " ELSE '' END"


_HINTS = f"""m AS (SELECT conv_id, turn, {_fold('message')} AS n FROM messages_v), h0 AS (SELECT *, {_alias_sql(tp.SOURCE_ALIASES)} AS source, {_alias_sql(tp.TOPIC_ALIASES)} AS topic, regexp_extract(n, '(?:tim|bai ve|lien quan den|ve|chu de)\\s+(.+)', 1) AS asked FROM m),
h AS (SELECT *, CASE WHEN asked <> '' THEN array_to_string(list_slice(list_filter(string_split(asked, ' '), lambda x: x NOT IN ({', '.join(repr(w) for w in tp.STOP_WORDS)}) AND length(x) > 1), 1, 8), ' ')
  WHEN source = '' AND topic = '' THEN array_to_string(list_slice(list_filter(string_split(n, ' '), lambda x: length(x) > 2), 1, 6), ' ') ELSE '' END AS keyword FROM h0)"""


def _has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"


query("chat_hints", f"WITH {_HINTS} SELECT conv_id, turn, source, topic, keyword FROM h")(lambda v: v.messages.select("conv_id", "turn", *(c.alias(k) for k, c in tp.hints("message").items())))
_EXPLICIT = "regexp_matches(n, '\\b(tim|bai ve|lien quan den|chu de|ve)\\b')"


@query("chat_intent", f"""WITH {_HINTS} SELECT conv_id, turn, CASE WHEN {_has(tp.COUNT_WORDS)} THEN CASE WHEN {_has(tp.TODAY_WORDS)} THEN 'count_today' ELSE 'count' END WHEN {_has(tp.SUMMARY_WORDS)} THEN 'summarize' WHEN {_has(tp.ADVICE_WORDS)} THEN 'recommend'
  WHEN {_EXPLICIT} AND keyword <> '' THEN 'search' WHEN source <> '' THEN 'source' WHEN topic <> '' THEN 'topic' WHEN {_has(tp.LATEST_WORDS)} THEN 'latest' ELSE 'search' END AS type,
  CASE WHEN {_has(tp.COUNT_WORDS)} AND NOT {_EXPLICIT} AND source = '' AND topic = '' THEN '' ELSE keyword END AS keyword FROM h""")
def chat_intent(v):
    m = v.messages.select("conv_id", "turn", "message", *(c.alias(k) for k, c in tp.hints("message").items()))
    return m.select("conv_id", "turn", tp.intent("message").alias("i")).select("conv_id", "turn", "i.type", "i.keyword")


query("answer_bullets", f"SELECT string_agg('- ' || title || ': ' || substr(summary, 1, 180), chr(10) ORDER BY pos) AS answer FROM (SELECT title, summary, row_number() OVER (ORDER BY w) AS pos FROM {_WINDOW} QUALIFY pos <= 5)")(
    lambda v: ar.search(v.articles).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "title", F.lit(": "), F.substring("summary", 1, 180)).alias("line")))), lambda x: x["line"]), "\n").alias("answer")))

# Publication ------------------------------------------------------------------------------------------------------------
query("unsent_articles", "SELECT id FROM articles_v a WHERE NOT EXISTS (SELECT 1 FROM notification_logs_v n WHERE n.article_id = a.id AND n.status = 'sent')")(
    lambda v: v.articles.join(v.notification_logs.where("status = 'sent'").select(F.col("article_id").alias("id")), "id", "left_anti").select("id"))
query("notification_plan", "SELECT a.id, CASE WHEN NOT (trim(a.status) = 'Đã đăng' OR lower(trim(a.status)) IN ('approved', 'published')) THEN 'skip_status' WHEN n.article_id IS NOT NULL THEN 'skip_sent' ELSE 'send' END AS action FROM articles_v a LEFT JOIN (SELECT DISTINCT article_id FROM notification_logs_v WHERE status = 'sent') n ON n.article_id = a.id")(
    lambda v: v.articles.join(v.notification_logs.where("status = 'sent'").select("article_id").distinct(), F.col("id") == F.col("article_id"), "left").select("id", F.when(~tp.is_publishable(), "skip_status").when(F.col("article_id").isNotNull(), "skip_sent").otherwise("send").alias("action")))
query("notification_upsert", "SELECT article_id, platform, target_id, arg_max(status, r) AS status FROM (SELECT *, 0 AS r FROM notification_logs_v UNION ALL SELECT id, 'telegram', 'chat-1', 'sent', updated_at, 1 FROM articles_v WHERE status = 'approved') GROUP BY article_id, platform, target_id")(
    lambda v: v.notification_logs.withColumn("r", F.lit(0)).union(v.articles.where("status = 'approved'").select("id", F.lit("telegram"), F.lit("chat-1"), F.lit("sent"), "updated_at", F.lit(1))).groupBy("article_id", "platform", "target_id").agg(F.max_by("status", "r").alias("status")))
query("latest_media_per_article", "SELECT article_id, publication_id, facebook_photo_id FROM (SELECT m.*, row_number() OVER (PARTITION BY m.article_id ORDER BY p.created_at DESC, p.id DESC, m.order_index DESC) AS rn FROM media_v m JOIN publications_v p ON p.id = m.publication_id) WHERE rn = 1")(
    lambda v: v.media.join(v.publications.select(F.col("id").alias("publication_id"), "created_at"), "publication_id").withColumn("rn", F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("created_at"), F.desc("publication_id"), F.desc("order_index")))).where("rn = 1").select("article_id", "publication_id", "facebook_photo_id"))
query("publication_plan", "SELECT id, CASE WHEN status = 'PUBLISHED' THEN 'done' WHEN status = 'POST_PUBLISHING' OR (status = 'PARTIAL_FAILED' AND contains(last_error, 'reconcile')) THEN 'error' ELSE 'resume' END AS action FROM publications_v")(
    lambda v: v.publications.select("id", F.when(F.col("status") == "PUBLISHED", "done").when((F.col("status") == "POST_PUBLISHING") | ((F.col("status") == "PARTIAL_FAILED") & F.col("last_error").contains("reconcile")), "error").otherwise("resume").alias("action")))
query("publication_status", "SELECT publication_id, count_if(upload_status = 'UPLOADED') AS uploaded, count_if(upload_status = 'FAILED') AS failed, CASE WHEN count_if(upload_status = 'FAILED') = 0 THEN 'PHOTOS_UPLOADED' WHEN count_if(upload_status = 'UPLOADED') >= 3 THEN 'PARTIAL_FAILED' ELSE 'FAILED' END AS status FROM media_v GROUP BY publication_id")(
    lambda v: v.media.groupBy("publication_id").agg(F.count_if(F.col("upload_status") == "UPLOADED").alias("uploaded"), F.count_if(F.col("upload_status") == "FAILED").alias("failed")).withColumn("status", F.when(F.col("failed") == 0, "PHOTOS_UPLOADED").when(F.col("uploaded") >= 3, "PARTIAL_FAILED").otherwise("FAILED")))
query("publish_batches", f"SELECT id, CAST(floor((row_number() OVER (ORDER BY {_order('approved')}) - 1) / 10) AS BIGINT) AS batch FROM articles_v WHERE status = 'approved' AND facebook_posted = 0")(
    lambda v: pos(v.articles.where("status = 'approved' AND facebook_posted = 0"), *ar.business_order()).select("id", F.floor((F.col("pos") - 1) / 10).cast("bigint").alias("batch")))
query("publish_plan", "SELECT id, CASE WHEN status <> 'approved' THEN 'unapproved' WHEN facebook_posted = 1 THEN 'already_posted' WHEN image_path = '' AND thumbnail = '' THEN 'no_image' ELSE 'publish' END AS action FROM articles_v")(
    lambda v: v.articles.select("id", F.when(F.col("status") != "approved", "unapproved").when(F.col("facebook_posted") == 1, "already_posted").when((F.col("image_path") == "") & (F.col("thumbnail") == ""), "no_image").otherwise("publish").alias("action")))
query("media_validation", "SELECT publication_id, count(*) - count(DISTINCT article_id) AS repeated_articles, count(*) - count(DISTINCT order_index) AS repeated_orders FROM media_v GROUP BY publication_id")(
    lambda v: v.media.groupBy("publication_id").agg((F.count("*") - F.countDistinct("article_id")).alias("repeated_articles"), (F.count("*") - F.countDistinct("order_index")).alias("repeated_orders")))
query("ids_in_request_order", "SELECT t.pos, a.id, a.title FROM (SELECT unnest([42, 7, 99999999, 13, 8]) AS id, unnest([1, 2, 3, 4, 5]) AS pos) t JOIN articles_v a ON a.id = t.id")(
    lambda v: v.spark.createDataFrame([(i, p) for p, i in enumerate((42, 7, 99999999, 13, 8), 1)], "id bigint, pos int").join(v.articles, "id").select("pos", "id", "title"))
query("clean_ids", "SELECT DISTINCT CAST(x AS BIGINT) AS id FROM (SELECT unnest(['3', 'a', '3', '', '12', '-1', '7']) AS x) WHERE regexp_matches(x, '^[0-9]+$')")(
    lambda v: v.spark.createDataFrame([(x,) for x in ("3", "a", "3", "", "12", "-1", "7")], "x string").where(F.col("x").rlike("^[0-9]+$")).select(F.col("x").cast("bigint").alias("id")).distinct())
query("match_image_theta_join", "WITH s AS (SELECT id, replace(replace(replace(replace(lower(substr(title, 1, 24)), '.', ''), ',', ''), chr(10), ' '), ' ', '-') AS slug FROM articles_v) SELECT id, image_id FROM (SELECT s.id, i.image_id, row_number() OVER (PARTITION BY s.id ORDER BY i.mtime DESC) AS rn FROM s JOIN images_v i ON s.slug <> '' AND contains(i.stem, s.slug)) WHERE rn = 1")(
    lambda v: ar.images_of(v.articles.select("id", F.translate(F.regexp_replace(F.regexp_replace(F.lower(F.substring("title", 1, 24)), "[.,]", ""), "\n", " "), " ", "-").alias("slug")), v.images))
query("enrich_budget", "WITH a AS (SELECT id, url, length(trim(summary)) < 30 AS missing FROM articles_v), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS k FROM a WHERE missing AND url NOT IN (SELECT url FROM summary_cache_v)) SELECT id, row_number() OVER (ORDER BY id) <= 20 AS generate FROM f WHERE k = 1 OR url = ''")(
    lambda v: pos(v.articles.where(F.length(F.trim("summary")) < 30).join(v.summary_cache.select("url"), "url", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("id"))).where("k = 1 OR url = ''"), F.col("id")).select("id", (F.col("pos") <= 20).alias("generate")))

# HTML -------------------------------------------------------------------------------------------------------------------
query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")(lambda v: v.pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title")))
query("html_links_explode", "SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")(lambda v: v.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href")))
_PARAS = "list_transform(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


def paragraphs() -> Column:
    return F.transform(F.regexp_extract_all("html", F.lit("(?is)<p>(.*?)</p>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))


query("html_first_paragraph", f"SELECT page_id, list_filter({_PARAS}, lambda x: length(x) >= 20)[1] AS p FROM pages")(lambda v: v.pages.select("page_id", F.try_element_at(F.filter(paragraphs(), lambda x: F.length(x) >= 20), F.lit(1)).alias("p")))
query("html_body_text", f"SELECT page_id, substr(array_to_string(list_filter({_PARAS}, lambda x: length(x) >= 40), chr(10)), 1, 6000) AS body FROM pages")(lambda v: v.pages.select("page_id", F.substring(F.array_join(F.filter(paragraphs(), lambda x: F.length(x) >= 40), "\n"), 1, 6000).alias("body")))
query("paragraph_filter", f"SELECT page_id, len(list_filter({_PARAS}, lambda x: length(x) >= 40)) AS useful FROM pages")(lambda v: v.pages.select("page_id", F.size(F.filter(paragraphs(), lambda x: F.length(x) >= 40)).cast("bigint").alias("useful")))
query("valid_article_filter", "SELECT page_id, url FROM pages WHERE length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) >= 10 AND regexp_matches(url, '^https?://[^/]*example\\.(com|net)/') AND regexp_matches(url, '\\.html$')")(
    lambda v: v.pages.where((F.length(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)) >= 10) & F.col("url").rlike(r"^https?://[^/]*example\.(com|net)/") & F.col("url").rlike(r"\.html$")).select("page_id", "url"))
query("partition_by_source", "SELECT coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents(translate(lower(coalesce(nullif(trim(source), ''), 'Khác')), 'đ', 'd')), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'khac') AS slug, count(*) AS total FROM incoming_v GROUP BY 1")(
    lambda v: ar.tally(v.incoming, tx.slugify(F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("Khác"))), "slug"))
