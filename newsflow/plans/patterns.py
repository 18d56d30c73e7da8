"""Queries of many patterns at once: the same rows as chains of tests and as joins give."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import topics as tp
from ..functions.text import filled, normalize
from ..operators import patterns as pt
from .catalog import ORACLES, _HINTS, query

_RULES = "needle string, grp string, rank int, label string"


@query("patterns_in_documents", """WITH n AS (SELECT DISTINCT array_to_string(list_slice(string_split(text, ' '), 2, 3), ' ') AS needle FROM conversations WHERE text IS NOT NULL)
SELECT needle, count(*) AS documents, CAST(sum((length(text) - length(replace(text, needle, ''))) // length(needle)) AS BIGINT) AS occurrences, CAST(min(instr(text, needle)) AS BIGINT) AS earliest, min(doc_id) AS first_id
FROM n JOIN documents ON needle <> '' AND contains(text, needle) GROUP BY needle""")
def patterns_in_documents(v: SimpleNamespace) -> DataFrame:
    """Two words of every message in all whole documents."""
    needles = v.conversations.select(F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("needle"))
    found = pt.totals(pt.build(needles), v.documents, "doc_id", "text")
    return found.toDF("needle", "documents", "occurrences", "earliest", "first_id")


def _slug() -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(F.lower(F.substring("title", 1, 24)), "[.,]", ""), "\n", " "), " ", "-")


@query("patterns_match_images")
def patterns_match_images(v: SimpleNamespace) -> DataFrame:
    return pt.images_of(v.articles.select("id", _slug().alias("slug")), v.images)


@query("patterns_classify_topic")
def patterns_classify_topic(v: SimpleNamespace) -> DataFrame:
    p = pt.build(v.spark.createDataFrame(pt.word_rules("topic", tp.KEYWORDS), _RULES))
    found = pt.labelled(p, v.articles, ["id", "category"], F.lower(F.concat("title", F.lit(" "), "summary")), ("topic",))
    fixed = tp.first_of([(F.col("category") == k, x) for k, x in tp.BY_CATEGORY.items()], F.lit(None).cast("string"))
    return found.select("id", F.coalesce(fixed, "topic", filled("category"), F.lit("Khác")).alias("t"))


@query("patterns_chat_hints", f"WITH {_HINTS} SELECT conv_id, turn, source, topic FROM h")
def patterns_chat_hints(v: SimpleNamespace) -> DataFrame:
    """Source and topic of every message."""
    p = pt.build(v.spark.createDataFrame(pt.word_rules("source", tp.SOURCE_ALIASES, True) + pt.word_rules("topic", tp.TOPIC_ALIASES, True), _RULES))
    found = pt.labelled(p, v.messages, ["conv_id", "turn"], F.concat(F.lit(" "), normalize("message"), F.lit(" ")), ("source", "topic"))
    return found.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "topic")))


for _new, _old in (("patterns_match_images", "match_image_theta_join"), ("patterns_classify_topic", "classify_topic")):
    ORACLES[_new] = ORACLES[_old]
