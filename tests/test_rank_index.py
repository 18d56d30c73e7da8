"""Pages, ranks and moves of a stored order against lists; which ranges are read; two writers."""

import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import rank_index as ri
from newsflow.shared import create_once, names_in


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2, 3, None]), f"t{i}") for i in range(500)]
    return spark.createDataFrame(rows, "id bigint, k int, t string").repartition(6)


def build(data):
    data.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return ri.build(data, [F.col("k").desc(), F.col("id")])
    finally:
        data.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def listed(index, size=7):
    return [(r.pos, r.id) for n in range(1, -(-index.total // size) + 1, 9) for r in sorted(index.page(n, size).collect(), key=lambda r: r.pos)]


def test_pages_ranks_and_moves(data):
    index = build(data)
    want = [r.id for r in data.orderBy(F.col("k").desc(), "id").collect()]
    check = lambda: [(p, want[p - 1]) for n in range(1, -(-500 // 7) + 1, 9) for p in range((n - 1) * 7 + 1, min(n * 7, 500) + 1)]
    assert index.total == 500 and len(index.starts) > 1 and listed(index) == check()
    assert [index.rank(want[p]) for p in (0, 77, 499)] == [1, 78, 500] and index.rank(10**6) is None
    for ident, step in [(want[7], -1), (want[7], -1), (want[7], -1), (want[0], 1), (want[0], -1), (want[499], -1), (want[250], 5)]:
        i = want.index(ident)
        if 0 <= i + step < 500:
            want[i], want[i + step] = want[i + step], want[i]
        assert (index.move(ident, step) is None) == (not 0 <= i + step < 500 or step == 0)
    assert index.move(want[0], -1) is None and index.move(want[499], 1) is None
    assert listed(index) == check()
    assert [index.rank(x) for x in want[:9]] == list(range(1, 10))
    assert [r.id for r in index.rows().orderBy("pos").collect()] == want
    assert dict(index.rows().dtypes)["pos"] == dict(index.page(1).dtypes)["pos"] == "bigint"
    with pytest.raises(ValueError, match="not in the list"):
        index.move(10**6, 1)


def test_a_page_reads_the_ranges_it_lies_in(data):
    index = build(data)
    read = {p for n in (1, 20, 41) for p in [len(index.page(n, 12).inputFiles())]}
    assert max(read) <= 2
    assert [r.pos for r in index.page(10**6, 12).orderBy("pos").collect()] == list(range(493, 501)) and index.page(-3, 12).count() == 12
    assert build(data.limit(0)).page().count() == 0


def test_two_writers_take_turns(spark, data):
    one = build(data)
    two = ri.Ranked(spark, one.path, one.schema, one.ident, one.starts)
    third = one.page(3, 1).first().id
    assert one.move(third, -1) == (3, 2) and two.move(third, -1) == (2, 1) and one.rank(third) == 1
    assert names_in(spark, f"{one.path}/moves") == ["move-000000000", "move-000000001"]
    assert not create_once(spark, f"{one.path}/moves", "move-000000000", "x")
