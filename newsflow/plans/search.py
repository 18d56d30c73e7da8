"""Queries of the search index: the same rows as scans of all texts give."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import search_index as ix
from .catalog import _fold, _like, _some, query

_EVERY = "concat_ws(' ', title, summary, source, category, content_topic)"


@query("search_indexed_folded", f"SELECT id FROM articles_v WHERE {_some('khoa hoc', ('content_topic', 'category'))}")
def search_indexed_folded(v: SimpleNamespace) -> DataFrame:
    index = ix.build(v.articles, {"topic": ix.folded("content_topic", "category")})
    return ix.search(index, v.spark.createDataFrame([("topic", "khoa hoc")], "grp string, needle string")).select("id")


@query("search_indexed_like", f"""SELECT 'short' AS pattern, id FROM articles_v WHERE {" OR ".join(_like(c, '%Th_ %é%') for c in ('title', 'summary', 'source'))}
UNION ALL SELECT 'long', id FROM articles_v WHERE {" OR ".join(_like(c, '%tion_Par%') for c in ('title', 'summary', 'source'))}
UNION ALL SELECT 'start', id FROM articles_v WHERE {" OR ".join(_like(c, 'Báo %ph_') for c in ('title', 'summary', 'source'))}""")
def search_indexed_like(v: SimpleNamespace) -> DataFrame:
    """Patterns of short pieces, of long ones, and one bound to both ends, from one index of grams of one to three characters."""
    index = ix.build(v.articles, {"shown": ix.lowered("title", "summary", "source")}, sizes=(1, 2, 3))
    out = None
    for name, pattern in (("short", "%Th_ %é%"), ("long", "%tion_Par%"), ("start", "Báo %ph_")):
        rows = ix.search_like(index, "shown", pattern).select(F.lit(name).alias("pattern"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query("search_indexed_many", f"""WITH n AS (SELECT DISTINCT needle FROM (SELECT {_fold("array_to_string(list_slice(string_split(substr(text, 1, 60), ' '), 2, 3), ' ')")} AS needle FROM conversations) WHERE needle <> ''),
t AS (SELECT id, {_fold(_EVERY)} AS t FROM articles_v)
SELECT needle, count(*) AS articles, min(id) AS first_id FROM n JOIN t ON CASE WHEN length(needle) <= 2 THEN contains(' ' || t || ' ', ' ' || needle || ' ') ELSE contains(t, needle) END GROUP BY needle""")
def search_indexed_many(v: SimpleNamespace) -> DataFrame:
    """Two words of every message, looked up in all articles at once."""
    words = F.array_join(F.slice(F.split(F.substring("text", 1, 60), " "), 2, 2), " ")
    needles = v.spark.read.parquet(f"{v.sf_dir}/conversations.parquet").select(F.lit("every").alias("grp"), normalize(words).alias("needle"))
    index = ix.build(v.articles.withColumn("_every", F.concat_ws(" ", "title", "summary", "source", "category", "content_topic")), {"every": ix.folded("_every")})
    return ix.search(index, needles).groupBy("needle").agg(F.count("*").alias("articles"), F.min("id").alias("first_id"))
