"""The publication process: a photo tried again, an abort, a post that fails, one without an answer, repeats, a restart in between."""

from datetime import datetime, timedelta

import pytest

from newsflow.shared import scratch
from newsflow.streaming import publication as pb


def run(*events, policy="abort", n=3):
    p = pb.Publication()
    p.apply("create", 0, n, policy, "", 0, pb.LEAST)
    return p, [p.apply(kind, place, 0, "", answer, 0, pb.LEAST) for kind, place, answer in events]


def test_second_photo_fails_once_then_one_post():
    p, did = run(("photo", 1, "a"), ("photo", 2, ""), ("photo", 3, "c"), ("sent", 0, ""), ("run", 0, ""), ("photo", 1, "other"), ("photo", 2, "b"), ("sent", 0, ""), ("feed", 0, "post-1"), ("feed", 0, "post-2"), ("run", 0, ""))
    assert did == [True, True, True, False, True, False, True, True, True, False, False]
    assert (p.status, p.post, p.photos, p.action()) == ("PUBLISHED", "post-1", {"1": "a", "3": "c", "2": "b"}, "done")


def test_abort_leaves_nothing_to_post():
    p, did = run(("photo", 1, "a"), ("photo", 2, ""), ("photo", 3, "c"), ("sent", 0, ""))
    assert (p.status, p.error, did[-1]) == ("FAILED", "1 ảnh upload thất bại.", False)


@pytest.mark.parametrize("up,status", [(2, "FAILED"), (3, "PARTIAL_FAILED"), (4, "PARTIAL_FAILED"), (5, "PHOTOS_UPLOADED")])
def test_skipping_failed_photos_needs_three(up, status):
    p, _ = run(*(("photo", i, "x" if i <= up else "") for i in range(1, 6)), policy="skip_failed", n=5)
    assert p.status == status and p.ready(3) == (up > 2)


@pytest.mark.parametrize("answer,status,action", [("error: limit", "FAILED", "resume"), ("", "FAILED", "resume"), ("uncertain", "PARTIAL_FAILED", "error"), ("77", "PUBLISHED", "done")])
def test_answers_to_the_post(answer, status, action):
    p, _ = run(("photo", 1, "a"), ("sent", 0, ""), ("feed", 0, answer), n=1)
    assert (p.status, p.action()) == (status, action)
    assert p.apply("run", 0, 0, "", "", 0, 3) == (action == "resume")


def test_restart_and_timer(spark):
    start = datetime(2024, 2, 1)
    at = lambda m: start + timedelta(minutes=m)
    first = [("p", at(0), "create", None, 2, "abort", None), ("p", at(1), "photo", 1, None, None, "a"), ("q", at(0), "create", None, 1, "abort", None), ("q", at(1), "photo", 1, None, None, "z"), ("q", at(2), "sent", None, None, None, None)]
    second = [("p", at(1), "photo", 1, None, None, "a"), ("p", at(3), "photo", 2, None, None, "b"), ("p", at(4), "sent", None, None, None, None), ("p", at(5), "feed", None, None, None, "post")]
    third = [("r", at(300), "create", None, 1, "abort", None)]
    base = scratch(spark, "publication-test")
    for rows in (first, second, third):
        spark.createDataFrame(rows, pb.EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(pb.EVENTS).parquet(f"{base}/in")
        pb.publications(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.schema(pb.CHANGES).parquet(f"{base}/out").collect(), key=lambda r: (r.publication_id, r.seq)):
        got.setdefault(r.publication_id, []).append((r.seq, r.status))
    assert got["p"] == [(1, "CREATED"), (2, "PHOTOS_UPLOADING"), (3, "PHOTOS_UPLOADED"), (4, "POST_PUBLISHING"), (5, "PUBLISHED")]
    assert got["q"] == [(1, "CREATED"), (2, "PHOTOS_UPLOADED"), (3, "POST_PUBLISHING"), (4, "PARTIAL_FAILED")]
    assert got["r"] == [(1, "CREATED")]
