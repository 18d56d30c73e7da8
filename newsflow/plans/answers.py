"""Queries of chat answers: what is packed, and what two providers with planted faults and the fallback say."""

from __future__ import annotations

import hashlib
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import AS_OF, with_views
from ..functions.publishing import HOUSE
from ..operators import answers as an
from ..operators import workflow as wf
from ..sources.stored import Stored
from .catalog import ORACLES, _HINTS, _has, query, tp
from .workflow import _KIND, _intents

BUDGET = 300
NOW = "2024-02-10 12:00:00"


def _found(v: SimpleNamespace) -> DataFrame:
    return wf.retrieve(v.articles, _intents(v), AS_OF, limit=an.MOST).select("conv_id", "turn", "pos", "id")


_TOPIC = f"coalesce(nullif(content_topic, ''), nullif(category, ''), '{an.UNKNOWN_TOPIC}')"
_SOURCE = f"coalesce(nullif(source, ''), '{HOUSE}')"
_SUMMARY = f"coalesce(nullif(summary, ''), '{an.NO_SUMMARY}')"
#: The retrieval of twelve articles instead of five, without its views.
_RETRIEVED = ORACLES["retrieve_for_message"].removeprefix(with_views("WITH ")).replace("QUALIFY pos <= 5)", f"QUALIFY pos <= {an.MOST})")
_PACKED = f"""r AS (WITH {_RETRIEVED}),
e AS (SELECT r.conv_id, r.turn, r.pos, r.id, title || ' | ' || {_SOURCE} || ' | ' || {_TOPIC} || ' | ' || url || chr(10) || {_SUMMARY} AS entry, '- ' || title || ' (' || {_SOURCE} || ', ' || {_TOPIC} || '): ' || substr({_SUMMARY}, 1, {an.LINE_CHARS}) AS line
  FROM r JOIN articles_v a ON a.id = r.id),
p AS (SELECT *, (length(entry) + 3) // 4 AS tokens, CAST(sum((length(entry) + 3) // 4) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS BIGINT) AS total FROM e)"""
query("chat_packed", f"WITH {_PACKED} SELECT conv_id, turn, pos, id, tokens, total, total <= {BUDGET} AS fits FROM p")(
    lambda v: an.packed(_found(v), v.articles, ["conv_id", "turn"], BUDGET).select("conv_id", "turn", "pos", "id", "tokens", "total", "fits"))


def first(prompt: str) -> str:
    """Fails for prompts whose digest begins with 0 to 5, says nothing to those with 6 or 7."""
    digest = hashlib.md5(prompt.encode()).hexdigest()
    if digest[0] < "6":
        raise ConnectionError("busy")
    return " \n" if digest[0] < "8" else f" one {digest}  \nend "


def second(prompt: str) -> str:
    digest = hashlib.md5(prompt.encode()).hexdigest()
    if digest[1] < "8":
        raise TimeoutError
    return f"two {digest}"


@query("chat_answers", f"""WITH {_PACKED}, {_HINTS}, i AS (SELECT conv_id, turn, {_KIND} AS type FROM h),
g AS (SELECT conv_id, turn, string_agg(entry, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE total <= {BUDGET}) AS entries, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos <= {an.LISTED}) AS lines FROM p GROUP BY conv_id, turn),
q AS (SELECT v.conv_id, v.turn, substr(message, 1, {an.MESSAGE_CHARS}) AS message, type, lines, md5('{an.RULES}' || chr(10) || chr(10) || substr(message, 1, {an.MESSAGE_CHARS}) || chr(10) || chr(10) || entries) AS d
  FROM messages_v v JOIN i ON i.conv_id = v.conv_id AND i.turn = v.turn LEFT JOIN g ON g.conv_id = v.conv_id AND g.turn = v.turn),
x AS (SELECT *, CASE WHEN d IS NULL THEN 'none' WHEN d[1] >= '8' THEN 'one' WHEN d[2] >= '8' THEN 'two' ELSE 'none' END AS provider FROM q)
SELECT conv_id, turn, message, provider, CASE WHEN provider = 'none' THEN 'fallback' ELSE 'ai' END AS mode, '{NOW}' AS created_at,
  CASE provider WHEN 'one' THEN 'one ' || d || chr(10) || 'end' WHEN 'two' THEN 'two ' || d ELSE
    CASE WHEN lines IS NULL THEN '{an.NOTHING}' ELSE CASE type WHEN 'summarize' THEN '{an.LEADS["summarize"]}' WHEN 'recommend' THEN '{an.LEADS["recommend"]}' ELSE '{an.LEADS[""]}' END || chr(10) || chr(10) || lines END END AS answer FROM x""")  # fmt: skip
def chat_answers(v: SimpleNamespace) -> DataFrame:
    """Every message, with both providers, logged twice under one run."""
    keys = ["conv_id", "turn"]
    messages = v.messages.join(_intents(v).select(*keys, "type"), keys)
    asked = an.prompts(messages, an.packed(_found(v), v.articles, keys, BUDGET), keys)
    store = Stored(v.spark)
    store.create(v.spark.createDataFrame([], an.LOG), keys, 8)
    for _ in range(2):
        an.log(store, "run", an.answered(asked, [("one", first), ("two", second)]), NOW)
    return store.read()
