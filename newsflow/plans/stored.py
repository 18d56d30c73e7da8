"""Queries of stored tables: crawls and send results merged batch by batch, against the one-shot SQL."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import articles as ar
from ..operators import rank_index as ri
from ..sources.stored import Stored, last_wins, upsert_articles
from .catalog import _TAKE, _order, _page_sql, query

TIMES = ("2024-02-10 10:00:00", "2024-02-11 10:00:00", "2024-02-12 10:00:00")
KEEP = ("summary", "summary_source")
#: Few, as the tables of the queries are small: a batch writes a file for each bucket it touches.
BUCKETS = 8
ARTICLE = ("id", "url", *_TAKE, *KEEP, "status", "updated_at")

_AT = "b * 1000000000000 + ord"
_LAST = ", ".join(f"max_by({c}, {_AT}) FILTER (WHERE trim({c}) <> '') AS n_{c}" for c in _TAKE)
_FIRST = ", ".join(f"min_by({c}, {_AT}) FILTER (WHERE trim({c}) <> '') AS n_{c}" for c in KEEP)


def _crawls(v: SimpleNamespace) -> DataFrame:
    """The crawl in three batches; every url may occur in all of them."""
    return v.incoming.withColumn("b", F.when(F.col("ord") % 5 < 2, 0).when(F.col("ord") % 5 < 4, 1).otherwise(2))


@query("stored_upsert", f"""WITH c AS (SELECT {', '.join(ARTICLE)} FROM (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN '' ELSE url END AS url) FROM articles_v)),
g AS (SELECT *, CASE WHEN ord % 5 < 2 THEN 0 WHEN ord % 5 < 4 THEN 1 ELSE 2 END AS b FROM incoming_v WHERE trim(source) NOT IN ('Dân trí', '24h') AND trim(title) <> ''),
u AS (SELECT url, {_LAST}, {_FIRST}, max(b) AS last_b, min({_AT}) AS place FROM g WHERE trim(url) <> '' GROUP BY url),
n AS (SELECT place, last_b, url, {', '.join(f"coalesce(n_{c}, '') AS {c}" for c in (*_TAKE, *KEEP))} FROM u WHERE url NOT IN (SELECT url FROM c)
  UNION ALL SELECT {_AT}, b, '', {', '.join((*_TAKE, *KEEP))} FROM g WHERE trim(url) = '')
SELECT id, c.url, {', '.join(f'coalesce(n_{c}, {c}) AS {c}' for c in _TAKE)}, {', '.join(f"CASE WHEN trim({c}) = '' THEN coalesce(n_{c}, {c}) ELSE {c} END AS {c}" for c in KEEP)}, status,
  CASE WHEN last_b IS NOT NULL THEN ({list(TIMES)})[last_b + 1] ELSE updated_at END AS updated_at FROM c LEFT JOIN u ON u.url = c.url
UNION ALL SELECT (SELECT max(id) FROM articles_v) + row_number() OVER (ORDER BY place), url, {', '.join((*_TAKE, *KEEP))}, 'pending', ({list(TIMES)})[last_b + 1] FROM n""")  # fmt: skip
def stored_upsert(v: SimpleNamespace) -> DataFrame:
    """Three crawls and a replay of the second into the stored article table."""
    store = Stored(v.spark)
    store.create(v.articles.withColumn("url", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("url"))).select(*ARTICLE), ["url"], BUCKETS, "id")
    crawls = _crawls(v)
    for b in (0, 1, 2, 1):
        upsert_articles(store, f"crawl-{b}", crawls.where(F.col("b") == b).drop("b"), TIMES[b])
    return store.read()


@query("stored_versions", """SELECT version, count(*) AS articles, count_if(status = 'pending') AS pending FROM (
SELECT unnest([0, 1, 2]) AS version), (SELECT 0 AS since, status FROM articles_v UNION ALL
SELECT CASE WHEN ord % 5 < 2 THEN 1 WHEN ord % 5 < 4 THEN 2 ELSE 3 END, 'pending' FROM incoming_v WHERE url = '' AND trim(source) NOT IN ('Dân trí', '24h') AND trim(title) <> '') WHERE since <= version GROUP BY version""")
def stored_versions(v: SimpleNamespace) -> DataFrame:
    """Older versions stay readable: the table after none, one and two crawls that add only articles without a url (all others are known)."""
    store = Stored(v.spark)
    store.create(v.articles.select(*ARTICLE), ["url"], BUCKETS, "id")
    crawls = _crawls(v)
    for b in (0, 1):
        upsert_articles(store, f"crawl-{b}", crawls.where(F.col("b") == b).drop("b"), TIMES[b])
    out = None
    for n in range(3):
        rows = store.read(n).agg(F.lit(n).alias("version"), F.count("*").alias("articles"), F.count_if(F.col("status") == "pending").alias("pending"))
        out = rows if out is None else out.union(rows)
    return out


@query("stored_notifications", """SELECT article_id, platform, target_id, arg_max(status, r) AS status, arg_max(created_at, r) AS created_at FROM (SELECT article_id, platform, target_id, status, created_at, 0 AS r FROM notification_logs_v
UNION ALL SELECT id, 'telegram', 'chat-1', 'sent', updated_at, 1 FROM articles_v WHERE status = 'approved' UNION ALL SELECT id, 'telegram', CASE WHEN id % 14 = 0 THEN 'chat-2' ELSE 'chat-1' END, 'failed', updated_at, 2 FROM articles_v WHERE id % 7 = 0)
GROUP BY article_id, platform, target_id""")
def stored_notifications(v: SimpleNamespace) -> DataFrame:
    """The send log, one row for each article, platform and target, after two runs: a later result replaces an earlier one."""
    keys = ["article_id", "platform", "target_id"]
    store = Stored(v.spark)
    store.create(v.notification_logs.select(*keys, "status", "created_at"), keys, BUCKETS)
    result = lambda rows, chat, status: rows.select(F.col("id").alias("article_id"), F.lit("telegram").alias("platform"), chat.alias("target_id"), F.lit(status).alias("status"), F.col("updated_at").alias("created_at"))
    store.commit("run-1", result(v.articles.where("status = 'approved'"), F.lit("chat-1"), "sent"), last_wins(keys, "created_at"))
    store.commit("run-2", result(v.articles.where("id % 7 = 0"), F.when(F.col("id") % 14 == 0, "chat-2").otherwise("chat-1"), "failed"), last_wins(keys, "created_at"))
    return store.read()


def _ranked(v: SimpleNamespace) -> ri.Ranked:
    return ri.build(v.articles.where("status = 'approved'"), ar.business_order())


query("rank_index_page", _page_sql("approved", offset=24))(lambda v: _ranked(v).page(3).select("pos", "id", "title", "status"))
query("rank_index_ranks", f"SELECT id, row_number() OVER (ORDER BY {_order('approved')}) AS rank FROM articles_v WHERE status = 'approved'")(lambda v: _ranked(v).rows("rank").select("id", "rank"))


@query("rank_index_moves", f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY {_order('approved')}) AS k FROM articles_v WHERE status = 'approved'), a AS (SELECT k FROM r WHERE id = 101), n AS (SELECT count(*) AS n FROM r)
SELECT id, CASE WHEN r.k = a.k THEN r.k - 2 WHEN r.k = a.k - 1 THEN r.k + 1 WHEN r.k = a.k - 2 THEN r.k + 1 WHEN r.k = n - 1 THEN n WHEN r.k = n THEN n - 1 ELSE r.k END AS client_order FROM r, a, n""")
def rank_index_moves(v: SimpleNamespace) -> DataFrame:
    """An article moved up twice, the last but one moved down, and the last that cannot move further."""
    index = _ranked(v)
    index.move(101, -1)
    index.move(101, -1)
    last = index.page(index.total, 1).first()["id"]
    index.move(index.page(index.total - 1, 1).first()["id"], 1)
    index.move(last, -1)
    index.move(last, 1)
    return index.rows("client_order").select("id", "client_order")
