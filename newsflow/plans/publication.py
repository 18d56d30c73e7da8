"""Queries of the publication stream: the last state of every publication equals what its rows say at once."""

from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import scratch
from ..streaming import publication as pb
from .catalog import query

#: Events of both dialects: a photo every six hours after the publication was made, then the post; the last one moves time on, so that timers are due.
_EVENTS = """SELECT publication_id, day, 0 AS step, 'create' AS kind, 0 AS place, n, 'skip_failed' AS policy, '' AS answer FROM (SELECT publication_id, count(*) AS n FROM media_v GROUP BY publication_id) m JOIN (SELECT id, created_at AS day FROM publications_v) p ON p.id = m.publication_id
UNION ALL SELECT publication_id, created_at, order_index, 'photo', row_number() OVER (PARTITION BY publication_id ORDER BY order_index), 0, '', facebook_photo_id FROM media_v JOIN publications_v ON id = publication_id
UNION ALL SELECT publication_id, created_at, order_index, 'photo', row_number() OVER (PARTITION BY publication_id ORDER BY order_index), 0, '', 'again' FROM media_v JOIN publications_v ON id = publication_id
UNION ALL SELECT id, created_at, 20, 'sent', 0, 0, '', '' FROM publications_v WHERE CAST(batch_id AS INT) % 6 <> 5
UNION ALL SELECT id, created_at, 21, 'feed', 0, 0, '', CASE CAST(batch_id AS INT) % 6 WHEN 0 THEN concat('post-', id) WHEN 1 THEN 'uncertain' WHEN 2 THEN 'error: (#190) token' ELSE '' END FROM publications_v WHERE CAST(batch_id AS INT) % 6 < 4"""


@query("publication_stream", """WITH s AS (SELECT publication_id, count(*) AS n, count_if(facebook_photo_id <> '') AS up FROM media_v GROUP BY publication_id),
r AS (SELECT p.id, n, up, n - up AS bad, up = n OR up >= 3 AS ready, CAST(batch_id AS INT) % 6 AS k FROM publications_v p JOIN s ON s.publication_id = p.id),
q AS (SELECT id, up, bad, k, CASE WHEN ready AND k = 0 THEN 'PUBLISHED' WHEN ready AND k IN (1, 4) THEN 'PARTIAL_FAILED' WHEN ready AND k IN (2, 3) THEN 'FAILED' WHEN up = n THEN 'PHOTOS_UPLOADED' WHEN up >= 3 THEN 'PARTIAL_FAILED' ELSE 'FAILED' END AS status,
  CASE WHEN ready AND k = 0 THEN '' WHEN ready AND k IN (1, 4) THEN 'Feed publish timeout; cần reconcile thủ công trước khi thử lại.' WHEN ready AND k = 2 THEN '(#190) token' WHEN ready AND k = 3 THEN 'Facebook API không trả về post ID.'
    WHEN up = n THEN '' WHEN up >= 3 THEN bad || ' ảnh upload thất bại.' ELSE 'Chỉ có ' || up || ' ảnh thành công, cần tối thiểu 3.' END AS last_error, CASE WHEN ready AND k = 0 THEN 'post-' || id ELSE '' END AS post_id FROM r)
SELECT id AS publication_id, status, last_error, CAST(up AS INT) AS uploaded, CAST(bad AS INT) AS failed, post_id,
  CASE WHEN status = 'PUBLISHED' THEN 'done' WHEN status = 'PARTIAL_FAILED' AND contains(last_error, 'reconcile') THEN 'error' ELSE 'resume' END AS action FROM q""")
def publication_stream(v: SimpleNamespace) -> DataFrame:
    """All events in three files in order of time, the stream started anew for each on one checkpoint; every photo is answered twice."""
    spark = v.spark
    base = scratch(spark, "publications")
    events = spark.sql(_EVENTS)
    # Of a photo's two answers the second counts only if the first failed: here it comes too late, as all places are answered by then.
    again = F.when(F.col("answer") == "again", F.expr("INTERVAL 100 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    at = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.col("step").cast("int") * 6) + again
    events = events.select("publication_id", at.alias("at"), "kind", F.col("place").cast("int").alias("place"), F.col("n").cast("int").alias("n"), "policy", "answer")
    end = spark.sql("SELECT 'end' AS publication_id, TIMESTAMP '2024-06-01' AS at, 'run' AS kind, 0 AS place, 0 AS n, '' AS policy, '' AS answer")
    part = F.when(F.col("at") < "2024-02-12", 0).when(F.col("at") < "2024-02-20", 1).otherwise(2)
    for k in (0, 1, 2):
        rows = events.where(part == k)
        (rows.unionByName(end) if k == 2 else rows).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(pb.EVENTS).parquet(f"{base}/in")
        pb.publications(stream, wait=timedelta(days=1)).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(pb.CHANGES).parquet(f"{base}/out")
    last = F.row_number().over(Window.partitionBy("publication_id").orderBy(F.desc("seq")))
    return changes.withColumn("_n", last).where("_n = 1 AND publication_id <> 'end'").drop("_n", "seq")
