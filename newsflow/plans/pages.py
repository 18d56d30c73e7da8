"""Queries of the page source: the pages table, archived with planted faults, fetched again."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from ..sources import pages as pg
from .catalog import query

SOURCES = ("VNExpress", "Báo Chính phủ", "PTIT")
#: Statuses of the first, second and third answer by the last digit of a page's number; others answer at once.
FAULTS = {3: (503, 200), 5: (404,), 7: (503, 429, 500), 9: (0, 429, 200), 1: (500,)}
_REASONS = {200: "OK", 404: "Not Found", 429: "Too Many Requests", 500: "Internal Server Error", 503: "Service Unavailable", 0: "timed out"}


def _crawl(v: SimpleNamespace) -> DataFrame:
    """Three sources that answer as FAULTS says, and a fourth of which nothing is there."""
    pages = v.spark.read.parquet(f"{v.sf_dir}/pages.parquet")
    answer = lambda s: F.struct(F.lit(s).alias("status"), F.lit(_REASONS[s]).alias("reason"), (F.encode("html", "UTF-8") if s == 200 else F.lit(None).cast("binary")).alias("body"))
    answers = F.array(answer(200))
    for digit, statuses in FAULTS.items():
        answers = F.when(F.col("page_id") % 10 == digit, F.array(*map(answer, statuses))).otherwise(answers)
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("page_id") % 3 + 1).cast("int"))
    path = scratch(v.spark, "page-archive")
    pg.archive(pages.select(source.alias("source"), "url", answers.alias("answers")), path)
    return pg.crawl(v.spark, path, [*SOURCES, "Dân trí"])


_CRAWL = f"""p AS (SELECT ({list(SOURCES)})[page_id % 3 + 1] AS source, url, coalesce(html, '') AS html, page_id % 10 AS d FROM pages),
c AS (SELECT source, url, html, CASE d WHEN 3 THEN 2 WHEN 5 THEN 1 WHEN 7 THEN 3 WHEN 9 THEN 3 WHEN 1 THEN 3 ELSE 1 END AS attempts,
  CASE d WHEN 5 THEN 'HTTP 404 Not Found' WHEN 7 THEN 'HTTP 500 Internal Server Error' WHEN 1 THEN 'not archived' END AS error FROM p
  UNION ALL SELECT 'Dân trí', NULL, NULL, 0, 'nothing archived')"""
query("crawl_pages", f"WITH {_CRAWL} SELECT source, url, CAST(200 AS INT) AS status, CAST(attempts AS INT) AS attempts, md5(html) AS html_md5 FROM c WHERE error IS NULL")(
    lambda v: pg.fetched(_crawl(v)).select("source", "url", "status", "attempts", F.md5(F.encode("html", "UTF-8")).alias("html_md5")))
query("crawl_failures", f"WITH {_CRAWL} SELECT source, url, CAST(attempts AS INT) AS attempts, error FROM c WHERE error IS NOT NULL")(lambda v: pg.failures(_crawl(v)))
query("crawl_by_source", f"""WITH {_CRAWL}, n AS (SELECT source, error, count(*) AS n FROM c GROUP BY ALL)
SELECT source, CAST(coalesce(sum(n) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS pages, CAST(coalesce(sum(n) FILTER (WHERE error IS NOT NULL), 0) AS BIGINT) AS failed,
  (min({{'n': -n, 'error': error}}) FILTER (WHERE error IS NOT NULL)).error AS worst FROM n GROUP BY source""")(lambda v: pg.by_source(_crawl(v)))
