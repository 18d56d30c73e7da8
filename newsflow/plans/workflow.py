"""Queries of the dashboard, reviews, uploads, retrieval for chat messages, summary runs, cards, backups and the scheduler."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..functions import text as tx
from ..functions import topics as tp
from ..operators import articles as ar
from ..operators import extraction as ex
from ..operators import workflow as wf
from ..sources import files
from .catalog import _HINTS, _EXPLICIT, _canonical_py, _fold, _has, _key, PUBLIC, RECENT, paragraphs, query
from .exchange import _clean, _slug

NOW = "2024-02-10 10:00:00"

# Dashboard --------------------------------------------------------------------------------------------------------------
_PLAIN = "regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(coalesce(status, ''), '^\\s+|\\s+$', '', 'g'))), '[^\\x00-\\x7F]+', '', 'g'), '[\\s_-]+', ' ', 'g')"
_GROUP = "CASE " + " ".join(f"WHEN {_PLAIN} IN ({', '.join(repr(x) for x in names)}) THEN '{g}'" for g, names in tp.GROUPS.items()) + " ELSE 'other' END"
query("status_group_totals", f"SELECT p AS pos, g AS \"group\", count(a.id) AS total FROM (SELECT unnest({list(wf.GROUPS)}) AS g, unnest([1, 2, 3, 4, 5]) AS p) LEFT JOIN (SELECT id, {_GROUP} AS x FROM articles_v) a ON a.x = g GROUP BY p, g")(
    lambda v: wf.group_totals(v.articles)
)
_COUNTS = [f"count_if({_GROUP} = '{g}')" for g in wf.GROUPS[:4]]
_COUNTS += ["count_if(facebook_posted = 1)", "count_if(status = 'approved' AND facebook_posted <> 1)", "count_if(facebook_publish_status = 'failed')", "count_if(facebook_publish_status = 'posting')"]
_COUNTS += ["count_if(trim(summary) = '')", "count_if(trim(thumbnail) = '' AND trim(image_path) = '')", "count(DISTINCT coalesce(nullif(trim(source), ''), 'Không rõ'))"]
_VALUES = ", ".join(f"CAST({c} AS VARCHAR)" for c in ["count(*)", *_COUNTS]) + ", coalesce(max(nullif(published_at, '')), max(nullif(crawled_at, '')), 'Chưa có')"
query("dashboard_all_cards", f"SELECT p AS pos, label, g AS \"group\", vals[p] AS value FROM (SELECT [{_VALUES}] AS vals FROM articles_v), (SELECT unnest(range(1, 14))::INT AS p, unnest({[c[0] for c in wf.CARDS]}) AS label, unnest({[c[1] for c in wf.CARDS]}) AS g)")(
    lambda v: wf.dashboard(v.articles)
)
query("client_topics_in_order", f"""WITH t AS (SELECT DISTINCT {_canonical_py()} AS topic FROM articles_v WHERE status = 'approved' UNION SELECT 'Tin tức chung' FROM articles_v WHERE status = 'approved' AND NOT contains({_key('source')}, 'ptit'))
 SELECT topic, nullif(list_position({list(tp.CLIENT_TOPICS)}, topic), 0) AS menu_pos FROM t""")(lambda v: wf.client_topics(v.articles))  # fmt: skip

# Reviews, uploads, older rows -------------------------------------------------------------------------------------------
for _to, _rest in (("rejected", 6), ("deleted", 7), ("pending", 8)):
    _hit = f"id % 50 = {_rest}"
    _set = lambda c, on, value=NOW: f"CASE WHEN {_hit} THEN '{value}' ELSE {c} END AS {c}" if on else c
    query(f"status_to_{_to}", f"""SELECT id, {_set('status', True, _to)}, {_set('approval_status', _to != 'deleted', _to)}, {_set('reviewed_at', _to == 'rejected')}, approved_at, {_set('deleted_at', _to == 'deleted')}, {_set('updated_at', True)}
 FROM (SELECT *, CASE WHEN status = 'deleted' THEN 'approved' ELSE status END AS approval_status FROM articles_v)""")(
        lambda v, to=_to, hit=_hit: ar.set_status(v.articles.withColumn("approval_status", F.when(F.col("status") == "deleted", "approved").otherwise(F.col("status"))), v.articles.where(hit).select("id"), to, NOW)
        .select("id", "status", "approval_status", "reviewed_at", "approved_at", "deleted_at", "updated_at"))

#: Articles as older versions left them, in SQL of both dialects.
_OLD = """SELECT id, status, image_path, facebook_posted, crawled_at, created_at, published_at, approved_at, reviewed_at, CASE WHEN id % 3 = 0 THEN facebook_publish_status WHEN id % 3 = 1 THEN ' ' END AS facebook_publish_status,
 CASE CAST(id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'approved' WHEN 2 THEN status END AS approval_status, CASE CAST(id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'data/p.png' END AS generated_poster_image FROM articles_v"""
_B = lambda c: f"trim(coalesce({c}, '')) = ''"
query("backfill_all", f"""SELECT id, CASE WHEN {_B('published_at')} THEN coalesce(nullif(published_at, ''), nullif(crawled_at, ''), created_at) ELSE published_at END AS published_at,
 CASE WHEN status = 'approved' AND {_B('approved_at')} THEN coalesce(nullif(approved_at, ''), nullif(reviewed_at, '')) ELSE approved_at END AS approved_at,
 CASE WHEN status IN ('pending', 'approved', 'rejected') THEN status WHEN {_B('approval_status')} THEN coalesce(nullif(approval_status, ''), 'pending') ELSE approval_status END AS approval_status,
 CASE WHEN NOT ({_B('facebook_publish_status')}) THEN facebook_publish_status WHEN facebook_posted = 1 THEN 'success' ELSE 'not_posted' END AS facebook_publish_status,
 CASE WHEN {_B('generated_poster_image')} AND NOT ({_B('image_path')}) THEN coalesce(nullif(generated_poster_image, ''), nullif(image_path, ''), '') ELSE generated_poster_image END AS generated_poster_image FROM ({_OLD})""")(
    lambda v: wf.backfill(v.spark.sql(_OLD)).select("id", "published_at", "approved_at", "approval_status", "facebook_publish_status", "generated_poster_image"))

_FORMS = """SELECT ord AS form_id, CASE WHEN ord % 5 = 0 THEN ' ' ELSE concat(' ', title) END AS title, source, url, summary, newspaper_type, content_topic, category,
 CASE WHEN ord % 2 = 0 THEN 'on' END AS publish_now, CASE WHEN ord % 3 = 0 THEN concat('data/uploads/', CAST(ord AS STRING), '.jpg') ELSE '' END AS image_path FROM incoming_v"""
_FORM = ("title", "url", "summary", "newspaper_type", "content_topic", "category")
query("upload_insert", f"""SELECT form_id, coalesce(nullif(trim(source), ''), 'Admin upload') AS source, {', '.join(f"trim({c}) AS {c}" for c in _FORM)}, '{NOW}' AS created_at, image_path AS generated_poster_image,
 CASE WHEN publish_now = 'on' THEN 'approved' ELSE 'pending' END AS status, CASE WHEN publish_now = 'on' THEN '{NOW}' ELSE '' END AS approved_at, CASE WHEN trim(title) = '' THEN 'title' ELSE '' END AS error FROM ({_FORMS})""")(
    lambda v: wf.uploads(v.spark.sql(_FORMS), NOW).select("form_id", "source", *_FORM, "created_at", "generated_poster_image", "status", "approved_at", "error"))

# Retrieval for messages -------------------------------------------------------------------------------------------------
_KIND = f"""CASE WHEN {_has(tp.COUNT_WORDS)} THEN CASE WHEN {_has(tp.TODAY_WORDS)} THEN 'count_today' ELSE 'count' END WHEN {_has(tp.SUMMARY_WORDS)} THEN 'summarize' WHEN {_has(tp.ADVICE_WORDS)} THEN 'recommend'
 WHEN {_EXPLICIT} AND keyword <> '' THEN 'search' WHEN source <> '' THEN 'source' WHEN topic <> '' THEN 'topic' WHEN {_has(tp.LATEST_WORDS)} THEN 'latest' ELSE 'search' END"""
_SHOWN = "coalesce(nullif(published_at, ''), nullif(crawled_at, ''), nullif(created_at, ''), nullif(updated_at, ''), '')"
_EVERY = _fold("concat_ws(' ', title, summary, source, category, content_topic)")
_IN = lambda n, *cs: f"({n} = '' OR " + " OR ".join(f"CASE WHEN length({n}) <= 2 THEN contains(' ' || {c} || ' ', ' ' || {n} || ' ') ELSE contains({c}, {n}) END" for c in cs) + ")"
query("retrieve_for_message", f"""WITH {_HINTS}, i AS (SELECT conv_id, turn, source AS s, topic AS t, {_KIND} AS kind, CASE WHEN {_has(tp.COUNT_WORDS)} AND NOT {_EXPLICIT} AND source = '' AND topic = '' THEN '' ELSE keyword END AS k FROM h),
 st AS (SELECT conv_id, turn, kind, s, t, k, unnest(CASE WHEN kind = 'count_today' THEN list_concat(['day'], CASE WHEN s = '' AND t = '' AND k = '' THEN ['any'] WHEN k <> '' THEN ['k', 'rest'] ELSE ['context'] END)
   WHEN kind = 'count' THEN ['context'] WHEN kind = 'latest' THEN ['any'] WHEN kind = 'source' THEN ['s'] WHEN kind = 'topic' THEN ['t'] WHEN kind IN ('summarize', 'recommend') THEN ['topical']
   WHEN k <> '' THEN ['k', 'rest'] ELSE ['context'] END) AS step FROM i),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE step WHEN 'day' THEN 0 WHEN 'rest' THEN 2 ELSE 1 END) AS n FROM st),
 q AS (SELECT conv_id, turn, n, step = 'day' AS day,
   CASE WHEN step IN ('day', 's') THEN s WHEN step = 'context' THEN s WHEN step IN ('rest', 'topical') AND t = '' THEN s ELSE '' END AS ns,
   CASE WHEN step IN ('day', 't', 'rest', 'topical') THEN t WHEN step = 'context' AND s = '' THEN t ELSE '' END AS nt,
   CASE WHEN step IN ('day', 'k') THEN k WHEN step = 'context' AND s = '' AND t = '' THEN k ELSE '' END AS nk FROM o WHERE step <> 'rest' OR s <> '' OR t <> ''),
 f AS (SELECT conv_id, turn, n, day, {_fold('ns')} AS ns, {_fold('nt')} AS nt, {_fold('nk')} AS nk FROM q),
 w AS (SELECT *, row_number() OVER (ORDER BY {RECENT}) AS w FROM articles_v WHERE {PUBLIC}),
 a AS (SELECT id, w, starts_with({_SHOWN}, '{AS_OF}') AS now_, {', '.join(f"{_fold(c)} AS f_{c}" for c in ('title', 'summary', 'source', 'category', 'content_topic'))}, {_EVERY} AS f_every FROM w WHERE w <= 100000),
 m2 AS (SELECT conv_id, turn, n, id, row_number() OVER (PARTITION BY conv_id, turn, n ORDER BY w) AS pos FROM f JOIN a ON (CASE WHEN day THEN now_ ELSE w <= 250 END)
   AND {_IN('ns', 'f_source')} AND {_IN('nt', 'f_content_topic', 'f_category', 'f_title', 'f_summary')} AND {_IN('nk', 'f_every')} QUALIFY pos <= 5)
 SELECT conv_id, turn, CAST(pos AS INT) AS pos, id FROM m2 QUALIFY n = min(n) OVER (PARTITION BY conv_id, turn)""")(lambda v: wf.retrieve(v.articles, _intents(v), AS_OF).select("conv_id", "turn", "pos", "id"))  # fmt: skip


def _intents(v):
    asked = v.messages.select("conv_id", "turn", "message", *(c.alias(k) for k, c in tp.hints("message").items()))
    return asked.withColumn("i", tp.intent("message")).select("conv_id", "turn", "i.type", "source", "topic", "i.keyword")


# Summary runs -----------------------------------------------------------------------------------------------------------
#: Calls of two providers in runs of 40 articles, in SQL of both dialects.
_CALLS = """SELECT id - id % 40 AS run, CASE WHEN id % 2 = 0 THEN 'gemini' ELSE 'groq' END AS provider, id AS ord,
 CASE WHEN id % 31 = 0 THEN 'limited' WHEN id % 7 < 4 AND id % 3 > 0 THEN 'failed' ELSE 'ok' END AS outcome FROM articles_v"""
query("provider_breaker", f"""WITH c AS (SELECT *, count_if(outcome = 'ok') OVER (PARTITION BY run, provider ORDER BY ord) AS good FROM ({_CALLS})),
 t AS (SELECT *, outcome = 'limited' OR count_if(outcome <> 'ok') OVER (PARTITION BY run, provider, good ORDER BY ord) >= 3 AS trips FROM c)
 SELECT run, provider, ord, outcome, coalesce(bool_or(trips) OVER (PARTITION BY run, provider ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM t""")(lambda v: wf.breaker(v.spark.sql(_CALLS)))  # fmt: skip


@query("sync_enriched", "WITH e AS (SELECT url, max_by(title, ord) AS title, 'enriched' AS summary FROM incoming_v WHERE url <> '' GROUP BY url) SELECT m.url, coalesce(e.title, m.title) AS title, coalesce(e.summary, m.summary) AS summary FROM master_v m LEFT JOIN e ON m.url = e.url UNION ALL SELECT i.url, i.title, 'enriched' FROM incoming_v i WHERE url <> '' AND url NOT IN (SELECT url FROM master_v)")
def sync_enriched(v):
    """Enriched rows go to the raw file and the day's snapshot, and replace the master's rows of their url; what the sinks hold is read back."""
    base, spark = files.scratch(v.spark, "enriched"), v.spark
    rows = v.incoming.withColumn("summary", F.lit("enriched"))
    files.write_json(files.project(rows), f"{base}/raw/new_articles.json")
    files.write_snapshot(rows, rows, AS_OF, base)
    merged = ar.replace_by_url(v.master, rows, list(files.ARTICLE))
    files.write_csv(merged, f"{base}/master/master_articles.csv")
    return files.read_csv(spark, f"{base}/master/master_articles.csv").select("url", "title", "summary")


@query("daily_snapshot", f"SELECT k AS kind, CAST(n AS BIGINT) AS n, CAST(u AS BIGINT) AS urls FROM (SELECT 'articles' AS k, count(*) AS n, count(DISTINCT url) AS u FROM incoming_v UNION ALL SELECT 'new_articles', count(DISTINCT url), count(DISTINCT url) FROM incoming_v WHERE url <> '' AND url NOT IN (SELECT url FROM master_v))")
def daily_snapshot(v):
    """A whole run's files, of which the day's snapshot is read back."""
    base = files.scratch(v.spark, "outputs")
    files.write_outputs(v.incoming, v.master, AS_OF, base)
    out = None
    for kind in ("articles", "new_articles"):
        rows = files.read_csv(v.spark, f"{base}/daily/{AS_OF}/exports/{kind}.csv")
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.countDistinct("url").alias("urls"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_csv_with_mark", "SELECT source, title, url FROM incoming_v")
def scan_csv_with_mark(v):
    path = files.scratch(v.spark, "articles-csv-mark")
    files.write_csv(v.incoming, path, mark=True)
    return files.read_csv(v.spark, path).select("source", "title", "url")


@query("scan_json_array", "SELECT title, url, summary FROM articles_v WHERE id < 500")
def scan_json_array(v):
    path = files.scratch(v.spark, "articles-array")
    files.write_json_array(files.project(v.articles.where("id < 500")), path)
    return files.read_json(v.spark, path, array=True).select("title", "url", "summary")


@query("json_head", "SELECT 12 AS limited, count(*) AS every FROM incoming_v")
def json_head(v):
    path = files.scratch(v.spark, "articles-head")
    files.write_json(v.incoming, path)
    count = lambda limit, name: files.read_json(v.spark, path, limit).agg(F.count("*").alias(name))
    return count(12, "limited").withColumn("limited", F.col("limited").cast("int")).join(count(0, "every"))


@query("empty_csv_probe", "SELECT true AS blank, false AS filled")
def empty_csv_probe(v):
    base = files.scratch(v.spark, "probe")
    files.write_csv(v.incoming.limit(0), f"{base}/a", files=1)
    files.write_csv(v.incoming, f"{base}/b")
    return v.spark.createDataFrame([(files.is_blank(v.spark, f"{base}/a"), files.is_blank(v.spark, f"{base}/b"))], "blank boolean, filled boolean")


query("health_probe", "SELECT 1 AS ok")(lambda v: v.spark.sql("SELECT 1 AS ok"))
query("backups_kept", "SELECT path, modified, row_number() OVER (ORDER BY modified DESC, path DESC) <= 14 AS kept FROM (SELECT DISTINCT concat('backup_', substr(crawled_at, 1, 13)) AS path, crawled_at AS modified FROM articles_v)")(
    lambda v: files.keep_newest(v.articles.select(F.concat(F.lit("backup_"), F.substring("crawled_at", 1, 13)).alias("path"), F.col("crawled_at").alias("modified")).distinct())
)

# Cards, scheduler, parameters ---------------------------------------------------------------------------------------------
_STAMPS = ", ".join(f"CASE WHEN length(trim({c})) >= 10 AND substr(trim({c}), 5, 1) = '-' AND substr(trim({c}), 8, 1) = '-' THEN substr(trim({c}), 1, 10) END" for c in wf.FOLDER_DATES)
#: Articles whose cards lie in several places, and whose moments are partly missing, in SQL of both dialects.
_DRAWN = """SELECT id, source, title, url, category, content_topic, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN '2024/01/02 03:04' ELSE crawled_at END AS crawled_at, CASE WHEN id % 8 < 2 THEN '' ELSE published_at END AS published_at,
 CASE WHEN id % 16 < 2 THEN '' ELSE created_at END AS created_at, approved_at, '' AS updated_at, CASE CAST(id % 5 AS INT) WHEN 0 THEN concat('data/generated_images/p', CAST(id AS STRING), '.jpg') WHEN 1 THEN 'https://img.example/x.jpg' WHEN 2 THEN 'data/uploads/u.png' ELSE '' END AS generated_poster_image, image_path FROM articles_v"""
query("date_folders", f"SELECT id, coalesce({_STAMPS}, 'uncategorized') AS folder FROM ({_DRAWN})")(lambda v: v.spark.sql(_DRAWN).select("id", wf.date_folder().alias("folder")))
_MEDIA = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^(https?://|/)') THEN '' ELSE trim({c}) END"
_STEM = f"concat_ws('-', coalesce({_slug('source')}, 'newsflow'), coalesce({_slug("coalesce(nullif(category, ''), content_topic)")}, 'news'), coalesce({_slug('title')}, 'article-' || substr(sha1(url), 1, 10)))"
query("card_regeneration_plan", f"""WITH d AS (SELECT id, coalesce({_STAMPS}, 'uncategorized') AS folder, {_MEDIA('generated_poster_image')} AS g, {_MEDIA('image_path')} AS i, regexp_replace(substr({_STEM}, 1, 180), '^-+|-+$', '', 'g') AS stem FROM ({_DRAWN})),
 c AS (SELECT *, CASE WHEN starts_with(g, 'data/generated_images/') THEN g WHEN starts_with(i, 'data/generated_images/') THEN i ELSE '' END AS current, row_number() OVER (PARTITION BY stem ORDER BY id) AS n FROM d),
 s AS (SELECT *, current = '' AND (starts_with(g, 'data/uploads/') OR starts_with(i, 'data/uploads/')) AS skip FROM c)
 SELECT id, folder, CASE WHEN skip THEN 'skipped_upload' ELSE 'regenerated' END AS action, CASE WHEN skip THEN '' WHEN current <> '' THEN current ELSE 'data/generated_images/' || folder || '/' || stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.jpg' END AS target FROM s""")(
    lambda v: wf.card_plan(v.spark.sql(_DRAWN)))
query("lock_states", "SELECT id, CASE WHEN id % 4 = 0 THEN 'free' WHEN id > 1800 THEN 'stale' ELSE 'busy' END AS state, CASE WHEN id % 300 < 288 THEN 1000 + (id % 300 + 1) * 300 END AS retry, least(CAST(pow(2, id % 6) AS BIGINT), 8) AS backoff FROM articles_v")(
    lambda v: v.articles.select("id", wf.lock_state(F.col("id") + 500, F.when(F.col("id") % 4 != 0, F.lit(500))).alias("state"), wf.retry_at(F.lit(1000), F.col("id") % 300).alias("retry"), wf.backoff(F.col("id") % 6).alias("backoff")))
#: Date parameters of requests, in SQL of both dialects.
_ASKED = "SELECT id, CASE CAST(id % 6 AS INT) WHEN 0 THEN ' All ' WHEN 1 THEN 'any' WHEN 2 THEN substr(crawled_at, 1, 10) WHEN 3 THEN 'yesterday' WHEN 4 THEN '2999-01-01' END AS date FROM articles_v"
query("date_parameters", f"SELECT id, CASE WHEN date IS NULL THEN '{AS_OF}' WHEN lower(trim(date)) IN ('all', 'any') THEN '' WHEN regexp_full_match(lower(trim(date)), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN least(lower(trim(date)), '{AS_OF}') ELSE '{AS_OF}' END AS day FROM ({_ASKED})")(
    lambda v: v.spark.sql(_ASKED).select("id", wf.date_parameter(F.col("date"), AS_OF).alias("day")))
query("page_links", "WITH t AS (SELECT source, count(*) AS total, CAST(greatest(1, ceil(count(*) / 12)) AS BIGINT) AS pages FROM articles_v GROUP BY source) SELECT source, total, pages, page, greatest(1, least(page - 2, pages - 4)) AS first, least(pages, greatest(page + 2, 5)) AS last FROM t, unnest(range(1, pages + 1)) AS u(page)")(
    lambda v: wf.page_links(ar.tally(v.articles, F.col("source"), "source")))
query("ids_cleaned_in_order", "SELECT conv_id, list(id ORDER BY first) AS ids FROM (SELECT conv_id, CAST(x AS BIGINT) AS id, min(turn) AS first FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'a' || turn ELSE CAST((conv_id + turn) % 3 AS VARCHAR) END AS x FROM conversations) WHERE regexp_matches(x, '^[0-9]+$') GROUP BY 1, 2) GROUP BY conv_id")(
    lambda v: v.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 2, F.concat(F.lit("a"), F.col("turn").cast("string"))).otherwise(((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("x")))).alias("raw"))
    .select("conv_id", tx.clean_ids(F.col("raw.x")).alias("ids")).where(F.size("ids") > 0))
_WEBSLUG = lambda empty: f"coalesce({_slug('title')}, '{empty}')"
_SLUG_ALL = "nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents(translate(lower(coalesce(title, '')), 'đ', 'd')), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"
query("slug_variants", f"SELECT id, coalesce({_SLUG_ALL}, 'bai-viet') AS web, coalesce({_SLUG_ALL}, '') AS search, coalesce({_slug('trim(title)')}, '') AS card FROM articles_v")(
    lambda v: v.articles.select("id", tx.slugify("title", "bai-viet").alias("web"), tx.slugify("title", "").alias("search"), F.substring(tx.slugify(F.trim("title"), ""), 1, 100).alias("card")))
_T320 = lambda end: f"CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 320), ' [^ ]*$', ''), '[.,;: ]+$', '') || '{end}' END"
query("truncate_variants", f"SELECT doc_id, {_T320('...')} AS detail, {_T320('…')} AS card, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 297)) || '...' END AS message FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)")(
    lambda v: v.documents.select("doc_id", tx.truncate("text", 320, "...", 320).alias("detail"), tx.truncate("text", 320, "…", 320).alias("card"), tx.clip("text", 300).alias("message")))
query("escapes", "SELECT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html, url_encode(title) AS quoted FROM articles_v")(
    lambda v: v.articles.select("id", tx.html_escape("title").alias("html"), tx.url_quote("title").alias("quoted")))
query("post_batches", "SELECT publication_id, CAST(batch AS BIGINT) AS batch, substr(sha256(string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY n)), 1, 16) AS batch_id, count(*) AS photos FROM (SELECT *, (n - 1) // 3 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY publication_id ORDER BY order_index) AS n FROM media_v)) GROUP BY publication_id, batch")(
    lambda v: ar.batches(v.media, "publication_id", "order_index", "article_id", 3))

# Publications as text -----------------------------------------------------------------------------------------------------
_ITEM = "{'order_index': order_index, 'article_id': article_id, 'title': title, 'upload_status': upload_status}"
query("publication_nest", f"SELECT p.*, m.items FROM publications_v p LEFT JOIN (SELECT publication_id, CAST(to_json(list({_ITEM} ORDER BY order_index)) AS VARCHAR) AS items FROM media_v GROUP BY publication_id) m ON m.publication_id = p.id")(
    lambda v: v.publications.join(v.media.groupBy(F.col("publication_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("order_index", "article_id", "title", "upload_status")))).alias("items")), "id", "left"))
query("publication_preview_json", "SELECT p.id, CAST(to_json({'id': p.id, 'status': p.status, 'token': substr(p.idempotency_key, 1, 6) || '...' || right(p.idempotency_key, 4), 'items': m.items}) AS VARCHAR) AS preview FROM publications_v p JOIN (SELECT publication_id, list({'order_index': order_index, 'article_id': article_id} ORDER BY order_index) AS items FROM media_v GROUP BY publication_id) m ON m.publication_id = p.id")(
    lambda v: v.publications.join(v.media.groupBy(F.col("publication_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("order_index", "article_id"))).alias("items")), "id").select("id", F.to_json(F.struct("id", "status", tx.mask("idempotency_key").alias("token"), "items")).alias("preview")))

# Pages --------------------------------------------------------------------------------------------------------------------
_PARTS = "list_transform(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"
query("useful_paragraphs", f"SELECT page_id, len(list_filter({_PARTS}, lambda x: length(x) >= 40 AND NOT regexp_matches(x, '^(?:{'|'.join(ex.IGNORED_PREFIXES)})'))) AS useful FROM pages")(
    lambda v: v.pages.select("page_id", F.size(F.filter(paragraphs(), lambda x: (F.length(x) >= 40) & ~x.rlike(f"^(?:{'|'.join(ex.IGNORED_PREFIXES)})"))).cast("bigint").alias("useful")))
query("html_article_body")(lambda v: ex.article_bodies(v.pages.select("page_id", "html", F.element_at(F.array(*map(F.lit, ("VNExpress", "PTIT", "24h", ""))), (F.col("page_id") % 4 + 1).cast("int")).alias("source"))))
