"""The page source: attempts and waits, faults of pages, files and sources."""

import glob

import pytest

from newsflow.sources import pages as pg


def asked(*statuses):
    calls = []

    def ask(attempt):
        calls.append(attempt)
        s = statuses[attempt - 1]
        return s, "why", b"caf\xc3\xa9" if s == 200 else None

    return ask, calls


@pytest.mark.parametrize("statuses,want,waits", [
    ((200,), (200, 1, "café", None), []),
    ((503, 0, 200), (200, 3, "café", None), [1.0, 2.0]),
    ((404, 200), (404, 1, None, "HTTP 404 why"), []),
    ((429, 500, 502, 200), (502, 3, None, "HTTP 502 why"), [1.0, 2.0]),
    ((0, 0, 0), (0, 3, None, "why"), [1.0, 2.0]),
])
def test_attempts(statuses, want, waits):
    ask, calls = asked(*statuses)
    waited = []
    assert pg.settle(ask, wait=waited.append) == want
    assert waited == waits and calls == list(range(1, want[1] + 1))


def test_one_broken_file_and_one_missing_source_leave_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    ok = lambda s: (200, "OK", s.encode())
    rows = [(s, f"{s}/{i}", [(500, "busy", None), ok(f"<p>{s}{i}")] if i % 2 else [ok("é" * i)]) for s in ("a b", "x/y", "Báo") for i in range(30)] + [("a b", "none", None), ("a b", None, [ok("")])]
    pg.archive(spark.createDataFrame(rows, pg.ANSWERS).repartition(1), path, rows_a_file=10)
    broken = sorted(glob.glob(f"{tmp_path}/archive/source=B*/*.parquet"))[0]
    with open(broken, "r+b") as f:
        f.truncate(20)
    got = pg.crawl(spark, path, ["a b", "x/y", "Báo", "gone"])
    by = {r.source: r for r in pg.by_source(got).collect()}
    assert (by["a b"].pages, by["a b"].failed, by["x/y"].pages, by["x/y"].failed) == (31, 1, 30, 0)
    assert (by["Báo"].pages, by["Báo"].failed) == (20, 1) and (by["gone"].pages, by["gone"].worst) == (0, "nothing archived")
    assert {r.attempts for r in pg.fetched(got).collect()} == {1, 2}
    assert [r.error for r in pg.failures(got).where("source = 'a b'").collect()] == ["not archived"]
    assert sorted(r.source for r in pg.by_source(pg.crawl(spark, path)).collect()) == ["Báo", "a b", "x/y"]
    assert got.rdd.getNumPartitions() >= 10
