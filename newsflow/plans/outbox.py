"""Queries of the outbox: messages about approved articles and photos of publications, kept, sent and answered once."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.outbox import Answer, Outbox
from .catalog import query

_KEPT = """r AS (SELECT 'telegram:' || id AS key, 'chat-' || id % 3 AS target, 'message' AS operation, title AS payload FROM articles_v WHERE status = 'approved' AND trim(title) <> ''
UNION ALL SELECT publication_id || ':' || order_index, 'page', 'photo', title FROM media_v UNION ALL SELECT id, 'page', 'post', idempotency_key FROM publications_v)"""
#: What a service answers: statuses and codes of the first, second, .. attempt by the length of the payload modulo 8; others are taken at once.
FAULTS = {1: ((503, None), (200, None)), 2: ((400, 190),), 3: ((500, 2), (0, None), (429, 4), (503, None)), 4: ((0, None), (200, None)), 5: ((403, 200),)}
_SAID = {190: "token expired", 2: "try again", 4: "rate limit", 200: "no permission"}


def answered(request: dict, attempt: int) -> Answer:
    status, code = (FAULTS.get(len(request["payload"]) % 8) or ((200, None),))[attempt - 1]
    return status, code, "" if status == 200 else _SAID.get(code, "busy"), f"id-{request['key']}" if status == 200 else ""


def _requests(v: SimpleNamespace) -> list[DataFrame]:
    """Messages, photos and posts; every third message comes again with the photos."""
    told = v.articles.where("status = 'approved' AND trim(title) <> ''").select("id", F.concat(F.lit("telegram:"), "id").alias("key"), F.concat(F.lit("chat-"), F.col("id") % 3).alias("target"), F.lit("message").alias("operation"), F.col("title").alias("payload"))
    photos = v.media.select(F.concat_ws(":", "publication_id", "order_index").alias("key"), F.lit("page").alias("target"), F.lit("photo").alias("operation"), F.col("title").alias("payload"))
    posts = v.publications.select(F.col("id").alias("key"), F.lit("page").alias("target"), F.lit("post").alias("operation"), F.col("idempotency_key").alias("payload"))
    return [told.drop("id"), photos.union(told.where("id % 3 = 0").drop("id").withColumn("payload", F.lit("changed"))), posts]


@query("outbox_requests", f"WITH {_KEPT} SELECT key, target, operation, payload FROM r")
def outbox_requests(v: SimpleNamespace) -> DataFrame:
    """Three batches and a replay of the second."""
    box, (told, photos, posts) = Outbox(v.spark), _requests(v)
    for name, rows in (("messages", told), ("photos", photos), ("posts", posts), ("photos", photos)):
        box.enqueue(name, rows)
    return box.requests()


_LOST = "(operation = 'post' AND f IN (3, 4))"


@query("outbox_answers", f"""WITH {_KEPT}, f AS (SELECT *, length(payload) % 8 AS f FROM r), o AS (SELECT *, CASE WHEN {_LOST} THEN 'uncertain' WHEN f IN (2, 3, 5) THEN 'failed' ELSE 'sent' END AS outcome FROM f)
SELECT key, outcome, CASE WHEN outcome = 'sent' THEN 'id-' || key ELSE '' END AS reference, CAST(CASE WHEN f = 1 THEN 2 WHEN f = 3 THEN CASE WHEN {_LOST} THEN 2 ELSE 4 END WHEN f = 4 AND NOT {_LOST} THEN 2 ELSE 1 END AS INT) AS attempts,
  CASE WHEN outcome = 'failed' THEN CASE f WHEN 2 THEN 'auth' WHEN 3 THEN 'other' ELSE 'permission' END END AS class FROM o""")
def outbox_answers(v: SimpleNamespace) -> DataFrame:
    """A run over the messages, a second over the rest, and both again: nothing is left to send."""
    box, (told, photos, posts) = Outbox(v.spark), _requests(v)
    box.enqueue("messages", told)
    box.deliver("first", answered, wait=_no_wait)
    box.enqueue("photos", photos)
    box.enqueue("posts", posts)
    for run in ("second", "first", "second"):
        box.deliver(run, answered, wait=_no_wait)
    return box.answers().select("key", "outcome", "reference", "attempts", "class")


def _no_wait(seconds: float) -> None:
    """Planted answers need no pause."""
