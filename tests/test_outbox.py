"""The outbox: one answer for each request through replays, failed tasks, runs that break off and runs at once."""

import os

import pytest
from pyspark import TaskContext

from newsflow.sources import outbox as ob


def quiet(seconds):
    pass


def taken(request, attempt):
    return 200, None, "", "id-" + request["key"]


def rows(spark, n, operation="message"):
    return spark.createDataFrame([(f"{operation}-{i}", "t", operation, str(i)) for i in range(n)], ob.REQUEST)


@pytest.mark.parametrize("operation,said,want,waits", [
    ("message", [(200, None)], ("sent", 1), []),
    ("photo", [(503, None), (0, None), (500, 1), (200, None)], ("sent", 4), [1, 2, 4]),
    ("photo", [(429, 4)] * 4, ("failed", 4), [1, 2, 4]),
    ("post", [(503, None), (200, None)], ("sent", 2), [1]),
    ("post", [(0, None), (200, None)], ("uncertain", 1), []),
    ("message", [(503, 190), (200, None)], ("failed", 1), []),
    ("message", [(400, 100), (200, None)], ("failed", 1), []),
    ("message", [(200, 2), (200, None)], ("sent", 2), [1]),
])
def test_attempts(operation, said, want, waits):
    waited = []
    got = ob.settle({"key": "k", "operation": operation}, lambda r, n: (*said[n - 1], "why", "x"), wait=waited.append)
    assert (got[1], got[3]) == want and waited == waits


def test_batches_keep_a_key_once(spark, tmp_path):
    box = ob.Outbox(spark, f"file://{tmp_path}/o")
    assert box.requests().count() == 0 and box.answers().count() == 0
    assert box.enqueue("a", rows(spark, 5)) and not box.enqueue("a", rows(spark, 9))
    assert box.enqueue("b", rows(spark, 7).union(rows(spark, 7))) and box.enqueue("none", rows(spark, 0))
    bare = [(None, "t", "post", "x"), ("", "t", "post", "x"), (None, None, None, None), ("k", "z", "post", "2"), ("k", "a", "post", "3")]
    box.enqueue("c", spark.createDataFrame(bare, ob.REQUEST).selectExpr("*", "1 AS extra"))
    got = box.requests().collect()
    assert len(got) == 10 and len({r.key for r in got}) == 10
    assert [(r.target, r.payload) for r in got if r.key == "k"] == [("a", "3")]


def test_failed_task_leaves_every_request_once(spark, tmp_path):
    """A batch whose job fails is in no entry; its files are not read, and the batch can come again."""
    box = ob.Outbox(spark, f"file://{tmp_path}/o")
    box.enqueue("a", rows(spark, 3))
    with pytest.raises(Exception):
        box.enqueue("b", rows(spark, 40).repartition(4).selectExpr("key", "target", "operation", "IF(payload = '17', raise_error('broken'), payload) AS payload"))
    assert box.requests().count() == 3
    orphan = f"{tmp_path}/o/data/part-lost.parquet"
    os.link(next(e.path for e in os.scandir(f"{tmp_path}/o/data") if e.name.endswith(".parquet")), orphan)  # of a task that was lost after its last line
    box.enqueue("b", rows(spark, 40))
    assert sorted(r.payload for r in box.requests().collect()) == sorted(map(str, range(40)))


def test_run_that_breaks_off_goes_on(spark, tmp_path):
    """Messages are sent again, posts that may have gone out are not; what came later waits for the next run."""
    box = ob.Outbox(spark, f"file://{tmp_path}/o")
    box.enqueue("a", rows(spark, 6).union(rows(spark, 4, "post")))

    def broken(request, attempt):
        raise OSError("connection of the worker lost")

    with pytest.raises(Exception):
        box.deliver("r", broken, wait=quiet)
    box.enqueue("b", rows(spark, 8))
    assert box.answers().count() == 0 and box.unanswered().count() == 12
    assert box.deliver("r", taken, wait=quiet)
    assert {(r.key.split("-")[0], r.outcome) for r in box.answers().collect()} == {("message", "sent"), ("post", "uncertain")} and box.answers().count() == 10
    assert not box.deliver("r", taken, wait=quiet) and box.deliver("s", taken, wait=quiet)
    assert sorted(r.key for r in box.answers().where("attempts > 0").collect()) == sorted(f"message-{i}" for i in range(8)) and box.unanswered().count() == 0


def test_two_runs_share_no_request(spark, tmp_path):
    """A second run that begins while the first sends finds nothing to claim."""
    box = ob.Outbox(spark, f"file://{tmp_path}/o")
    box.enqueue("a", rows(spark, 5))
    kept, first = box._add, []

    def between(kind, name, files):
        if kind == "answers" and name == "one" and not first:
            first.append(box.deliver("two", taken, wait=quiet))
        return kept(kind, name, files)

    box._add = between
    assert box.deliver("one", taken, wait=quiet) and first == [True]
    assert box.answers().count() == 5 == box.answers().select("key").distinct().count()


def test_second_attempt_of_a_task_sends_no_post(monkeypatch):
    import pyarrow as pa

    class Again:
        def attemptNumber(self):
            return 1

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Again()))
    batch = pa.RecordBatch.from_pylist([{"key": "p", "operation": "post"}, {"key": "m", "operation": "message"}])
    (got,) = ob._sender(taken, 4, quiet, False)(iter([batch]))
    assert [(r["key"], r["outcome"], r["attempts"]) for r in got.to_pylist()] == [("p", "uncertain", 0), ("m", "sent", 1)]
