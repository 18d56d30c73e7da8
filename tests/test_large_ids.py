"""Queries on tables with ids of 100,000 and more, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from newsflow.plans import catalog
from tests.test_catalog import SF


def test_status_transition_changes_large_ids(spark, tmp_path):
    for t in ("pages", "conversations", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 99_900)
    docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["id", "status", "reviewed_at", "approved_at", "deleted_at"]
    want = con.execute(f"select {', '.join(names)} from ({catalog.ORACLES['status_transition']})").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["status_transition"](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[1] == "approved" and r[0] % 50 == 5 for r in got if r[0] is not None and r[0] >= 100_000) > 1
