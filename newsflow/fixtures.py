"""Adapter views: the driver tables in the shape of article, publication and message tables (see FIXTURES.md)."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import SparkSession

AS_OF = "2024-01-15"
BASE = ("documents", "pages", "conversations", "events")

#: Dialect-neutral SQL, in order of dependence.
VIEWS = {
    "articles_v": """SELECT d.doc_id AS id,
  CASE CAST(d.doc_id % 8 AS INT) WHEN 0 THEN 'VNExpress' WHEN 1 THEN 'VNExpress' WHEN 2 THEN 'Báo Chính phủ'
       WHEN 3 THEN 'PTIT' WHEN 4 THEN 'Dân trí' WHEN 5 THEN '24h' WHEN 6 THEN '' ELSE '  ' END AS source,
  CASE WHEN d.doc_id % 37 = 0 THEN '' ELSE substr(d.text, 1, 80) END AS title,
  CASE WHEN d.doc_id % 41 = 0 THEN '' ELSE concat('https://news.example/a/', md5(d.text), '.html') END AS url,
  concat('2024-01-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), ' ', lpad(CAST(d.doc_id % 24 AS STRING), 2, '0'), ':00:00') AS crawled_at,
  CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE concat('2024-01-', lpad(CAST(1 + d.doc_id % 27 AS STRING), 2, '0'), ' ', lpad(CAST(d.doc_id % 23 AS STRING), 2, '0'), ':30:00') END AS published_at,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE concat('https://img.example/', CAST(d.doc_id AS STRING), '.jpg?w=180&h=108') END AS thumbnail,
  CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE substr(d.text, 81, 300) END AS summary,
  CASE CAST(d.doc_id % 5 AS INT) WHEN 0 THEN 'crawler' WHEN 1 THEN 'pending' WHEN 2 THEN 'fallback' WHEN 3 THEN 'missing_content' ELSE '' END AS summary_source,
  CASE CAST(d.doc_id % 4 AS INT) WHEN 0 THEN 'Báo điện tử' WHEN 1 THEN 'Cổng thông tin Chính phủ' WHEN 2 THEN 'Trang tin trường đại học' ELSE '' END AS newspaper_type,
  CASE CAST(d.doc_id % 9 AS INT) WHEN 0 THEN 'Khoa học - Công nghệ' WHEN 1 THEN 'Giáo dục' WHEN 2 THEN 'Khoa học - Giáo dục' WHEN 3 THEN 'Tin tức PTIT' WHEN 4 THEN 'thoi su' WHEN 5 THEN '' ELSE 'Kinh doanh' END AS content_topic,
  CASE CAST(d.doc_id % 13 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Khoa giáo - Khoa học công nghệ' WHEN 2 THEN 'Tin tức chung' WHEN 3 THEN 'Giáo dục' WHEN 4 THEN 'GIÁO DỤC' WHEN 5 THEN 'giao duc' WHEN 6 THEN 'Sức khỏe' WHEN 7 THEN 'Thể thao' WHEN 8 THEN 'Pháp luật' WHEN 9 THEN 'Thế giới' WHEN 10 THEN 'Giải trí' WHEN 11 THEN 'Khác' ELSE 'khoa giao' END AS category,
  CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE concat('data/generated_images/', CAST(d.doc_id AS STRING), '.jpg') END AS image_path,
  CASE CAST(d.doc_id % 10 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'approved' WHEN 3 THEN 'approved' WHEN 4 THEN 'approved' WHEN 5 THEN 'pending' WHEN 6 THEN 'rejected' WHEN 7 THEN 'deleted' WHEN 8 THEN ' Published ' ELSE 'Đã đăng' END AS status,
  CASE WHEN d.doc_id % 17 = 0 THEN CAST(d.doc_id % 100 AS INT) ELSE 0 END AS client_order,
  concat('2024-01-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), ' 23:00:00') AS created_at,
  concat('2024-02-', lpad(CAST(1 + d.doc_id % 26 AS STRING), 2, '0'), ' 08:00:00') AS updated_at,
  CASE WHEN d.doc_id % 10 IN (1, 2, 3) THEN concat('2024-02-', lpad(CAST(1 + d.doc_id % 20 AS STRING), 2, '0'), ' 09:15:00') ELSE '' END AS approved_at,
  CASE WHEN d.doc_id % 10 IN (1, 2, 4, 6) THEN concat('2024-02-', lpad(CAST(1 + d.doc_id % 19 AS STRING), 2, '0'), ' 09:10:00') ELSE '' END AS reviewed_at,
  CASE WHEN d.doc_id % 10 = 7 THEN concat('2024-02-', lpad(CAST(1 + d.doc_id % 18 AS STRING), 2, '0'), ' 10:00:00') ELSE '' END AS deleted_at,
  CASE WHEN d.doc_id % 6 = 1 THEN 1 ELSE 0 END AS facebook_posted,
  CASE CAST(d.doc_id % 6 AS INT) WHEN 1 THEN 'success' WHEN 2 THEN 'failed' WHEN 3 THEN 'posting' WHEN 4 THEN '' ELSE 'not_posted' END AS facebook_publish_status
FROM documents d""",
    "incoming_v": """SELECT id AS ord, source, title, url, crawled_at, published_at, thumbnail, summary, summary_source, newspaper_type, content_topic, category FROM articles_v WHERE id % 3 <> 1""",
    "master_v": """SELECT id AS ord, source, title, url, crawled_at, CASE WHEN id % 4 = 0 THEN '' ELSE published_at END AS published_at, CASE WHEN id % 5 = 0 THEN thumbnail ELSE '' END AS thumbnail,
  CASE WHEN id % 2 = 0 THEN '' ELSE 'old summary' END AS summary, 'pending' AS summary_source, newspaper_type, content_topic, 'Khác' AS category
  FROM (SELECT a.*, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM articles_v a WHERE url <> '' AND id % 3 <> 0) t WHERE rn = 1""",
    "summary_cache_v": """SELECT url, concat('cached ', substr(md5(url), 1, 8)) AS summary, CASE WHEN min(id) % 2 = 0 THEN 'fallback' ELSE 'gemini' END AS summary_source FROM articles_v WHERE url <> '' AND id % 6 = 0 GROUP BY url""",
    "publications_v": """SELECT concat('pub-', CAST(conv_id AS STRING)) AS id, concat('facebook-publication:page:2024-02-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0'), ':', CAST(conv_id AS STRING)) AS idempotency_key,
  'page' AS page_id, CAST(conv_id AS STRING) AS batch_id, concat('2024-02-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0')) AS publication_date,
  CASE CAST(conv_id % 6 AS INT) WHEN 0 THEN 'PUBLISHED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'PARTIAL_FAILED' WHEN 3 THEN 'POST_PUBLISHING' WHEN 4 THEN 'PHOTOS_UPLOADED' ELSE 'CREATED' END AS status,
  CASE WHEN conv_id % 12 = 2 THEN 'can reconcile thu cong' ELSE '' END AS last_error,
  concat('2024-02-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0'), 'T08:00:00') AS created_at
  FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "media_v": """SELECT concat('pub-', CAST(conv_id AS STRING)) AS publication_id, CAST(turn + 1 AS INT) AS order_index, (conv_id * 7 + turn * 3) % 150 AS article_id,
  substr(text, 1, 60) AS title, CASE WHEN (conv_id + turn) % 4 = 0 THEN '' ELSE concat('photo-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) END AS facebook_photo_id,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 'FAILED' ELSE 'UPLOADED' END AS upload_status FROM conversations""",
    "notification_logs_v": """SELECT id AS article_id, 'telegram' AS platform, 'chat-1' AS target_id, CASE CAST(id % 3 AS INT) WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status, updated_at AS created_at FROM articles_v WHERE id % 4 <> 3""",
    "messages_v": """SELECT conv_id, turn, CASE CAST((conv_id + turn) % 12 AS INT) WHEN 0 THEN 'Tin mới nhất' WHEN 1 THEN 'Có bao nhiêu tin hôm nay?' WHEN 2 THEN 'Tin từ VNExpress' WHEN 3 THEN 'Tin công nghệ' WHEN 4 THEN 'Tìm bài về AI'
  WHEN 5 THEN 'Tóm tắt tin hôm nay' WHEN 6 THEN 'Gợi ý bài nổi bật' WHEN 7 THEN 'số lượng bài của PTIT' WHEN 8 THEN 'tin từ Báo Chính phủ' WHEN 9 THEN '   ' ELSE substr(text, 1, 200) END AS message FROM conversations WHERE role = 'user'""",
    "images_v": """SELECT id AS image_id, concat('src-cat-', replace(replace(replace(replace(lower(substr(title, 1, 24)), '.', ''), ',', ''), chr(10), ' '), ' ', '-'), '-x') AS stem, 1000000 - id AS mtime FROM articles_v WHERE id % 9 = 0""",
}


def load(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """All views as DataFrames; nothing is read until one is used."""
    found = {}
    for name in BASE:
        found[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        found[name].createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        found[name.removesuffix("_v")] = df = spark.sql(sql)
        df.createOrReplaceTempView(name)
    return SimpleNamespace(**found, spark=spark, sf_dir=sf_dir)


def with_views(sql: str) -> str:
    """The query behind a WITH chain of the views."""
    chain = ",\n".join(f"{n} AS ({q})" for n, q in VIEWS.items())
    return f"WITH {chain}{',' if sql.lstrip().upper().startswith('WITH ') else ''}\n{sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else sql}"
