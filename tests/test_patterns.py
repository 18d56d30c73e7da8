"""Many patterns in many texts against plain Python, in one block and in many."""

import glob
import random
import shutil

import pytest

from newsflow.operators import patterns as pt


def made(seed):
    r = random.Random(seed)
    letters = "ab é\U0001f600"
    texts = [(i, "".join(r.choices(letters, k=r.choice((0, 1, 5, 60, 3000))))) for i in range(120)] + [(120, None), (121, "aaaa"), (122, "aaaa")]
    needles = ["".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(300)] + ["a", "aa", "aaa", "a", "", None, "é\U0001f600"]
    return texts, needles


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_occurrences_equal_python(spark, block):
    texts, needles = made(block)
    p = pt.build(spark.createDataFrame([(n,) for n in needles], "needle string"), block)
    assert (len(p.sizes) > 10) == (block == 40)
    got = pt.occurrences(p, spark.createDataFrame(texts, "id bigint, text string").repartition(3), ["id"], "text").collect()
    want = {(i, n, t.count(n), t.find(n) + 1) for i, t in texts if t for n in set(needles) if n and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_labels_equal_python(spark, block):
    texts, needles = made(7)
    r = random.Random(3)
    rules = [(n, g, r.randint(0, 9), f"label {r.randint(0, 5)}") for n in needles for g in ("one", "two") if r.random() < 0.4 and (n is None or len(n) > 4)] + [("aaaa", "one", 1, "z"), ("aaaa", "one", 1, "y")]
    p = pt.build(spark.createDataFrame(rules, "needle string, grp string, rank int, label string"), block)
    got = pt.labelled(p, spark.createDataFrame(texts, "id bigint, text string"), ["id"], "text", ("one", "two")).collect()

    def least(t, g):
        return min(((k, x) for n, grp, k, x in rules if n and grp == g and n in (t or "")), default=(0, None))[1]

    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(i, least(t, "one"), least(t, "two")) for i, t in texts]


def test_no_patterns_no_texts_and_names(spark):
    none = pt.build(spark.createDataFrame([("",), (None,)], "needle string"))
    texts = spark.createDataFrame([(1, "a")], "`k.e` int, text string")
    assert pt.occurrences(none, texts, ["k.e"], "text").count() == 0 and pt.labelled(none, texts, ["k.e"], "text", ("g",)).collect()[0]["g"] is None
    p = pt.build(spark.createDataFrame([("a",)], "needle string"))
    assert [tuple(r) for r in pt.occurrences(p, texts, ["k.e"], "text").collect()] == [(1, "a", 1, 1)]
    assert pt.occurrences(p, texts.limit(0), ["k.e"], "text").count() == 0
    with pytest.raises(ValueError):
        pt.occurrences(p, texts.withColumnRenamed("k.e", "N"), ["N"], "text")


def test_lost_block_raises(spark):
    p = pt.build(spark.createDataFrame([(str(i),) for i in range(100)], "needle string"), 50)
    block = sorted(p.sizes)[0]
    shutil.rmtree(glob.glob(f"{p.path.removeprefix('file://')}/block={block}")[0])
    with pytest.raises(Exception, match=f"block {block} has 0 of"):
        pt.occurrences(p, spark.createDataFrame([(1, "5")], "id int, text string"), ["id"], "text").collect()


def test_newest_image_of_a_slug_that_many_articles_share(spark):
    articles = spark.createDataFrame([(i, "same") for i in range(50)] + [(90, "none"), (91, ""), (92, None), (93, "am")], "id int, slug string")
    images = spark.createDataFrame([(1, "x-same-y", 5), (2, "same", 9), (3, "same-", 9), (4, "other", 99), (5, None, 100)], "image_id int, stem string, mtime int")
    got = {r.id: r.image_id for r in pt.images_of(articles, images).collect()}
    assert got == {i: 3 for i in (*range(50), 93)}


def test_long_texts_go_through_in_small_runs():
    import pyarrow as pa

    texts = ["", "x" * 200000, "y" * 300000, "é" * 100000, None, *["short"] * 1200]
    runs = list(pt._slices(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"]), 1))
    assert [k for r in runs for k in r.column(0).to_pylist()] == list(range(len(texts)))
    assert all(r.num_rows <= pt.ROWS and (r.num_rows == 1 or sum(len((t or "").encode()) for t in r.column(1).to_pylist()) <= pt.CHARS) for r in runs)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_totals_equal_python(spark, block):
    texts, needles = made(block + 1)
    rows = [(None if i % 7 == 3 else (1 << 63) - 1 - i if i % 2 else -i, t) for i, t in texts]
    p = pt.build(spark.createDataFrame([(n,) for n in needles], "needle string"), block)
    got = pt.totals(p, spark.createDataFrame(rows, "id bigint, text string").repartition(3), "id", "text").collect()
    want = set()
    for n in {n for n in needles if n}:
        if own := [(i, t) for i, t in rows if n in (t or "")]:
            want.add((n, len(own), sum(t.count(n) for _, t in own), min(t.find(n) + 1 for _, t in own), min((i for i, _ in own if i is not None), default=None)))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    with pytest.raises(ValueError):
        pt.totals(p, spark.createDataFrame([("a", "b")], "id string, text string"), "id", "text")


def test_more_than_a_million_characters_of_patterns_are_one_pass(spark):
    """There was a pass over all texts for each million characters."""
    p = pt.build(spark.range(200000).selectExpr("concat('needle ', id * 7) AS needle"))
    assert list(p.sizes.values()) == [200000]
    got = pt.occurrences(p, spark.createDataFrame([(1, "a needle 7, needle 1400000 and needle 77")], "id int, text string"), ["id"], "text").collect()
    assert {tuple(r) for r in got} == {(1, "needle 7", 2, 3), (1, "needle 77", 1, 32), (1, "needle 14", 1, 13), (1, "needle 140", 1, 13), (1, "needle 1400", 1, 13), (1, "needle 14000", 1, 13), (1, "needle 140000", 1, 13)}


def test_needles_and_texts_of_a_task_that_meet_often_go_on_as_one_row_a_needle(spark, monkeypatch):
    p = pt.build(spark.createDataFrame([("a",), ("b",), ("ab",)], "needle string"))
    scanned, real = [], pt._scan
    monkeypatch.setattr(pt, "_scan", lambda *a: scanned.append(real(*a)) or scanned[0])
    assert pt.totals(p, spark.range(0, 500, 1, 2).selectExpr("id", "'abab' AS text"), "id", "text").count() == 3
    assert scanned[0].count() == 6  # of 1,500 that meet


@pytest.mark.parametrize(("step", "most"), [(1 << 18, 1 << 22), (16, 20)])
def test_places_of_needles_of_all_lengths(monkeypatch, step, most):
    """Needles longer than a piece, that begin alike, overlap themselves and would run over the end of a text; a few places at a time."""
    import pyarrow as pa

    monkeypatch.setattr(pt, "STEP", step)
    monkeypatch.setattr(pt, "MOST", most)
    r = random.Random(step)
    base = "".join(r.choices("ab é\U0001f600\x00", k=400))
    needles = {base[i : i + n] for n in range(1, 60) for i in r.sample(range(300), 6)} | {"a" * n for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 30)} | {"x" * 8 + "y" * n for n in range(12)} | {base[:200], base[:65], base[:64], base[:63], base[:64] + "q", base[:70] + "q", base[:100], base[:300] + "q"}
    texts = ["", base, base[100:] + base, "", "a" * 333, *(base[i : i + n] for n in (1, 7, 8, 9, 30) for i in r.sample(range(300), 5)), base[:70] + "qq", base[:64] + "p", "x" * 20 + "y" * 20, "x" * 7, "y" * 9, "z" * 2000 + base, "", base[:199], "\x00"]
    rules = pa.table({"needle": pa.array(sorted(needles)), **{c: pa.nulls(len(needles), t) for c, t in (("grp", pa.string()), ("rank", pa.int64()), ("label", pa.string()))}})
    table = pt._Table(rules)
    of = table.needles.to_pylist()
    for given in (texts, [t for t in texts if t][:1], ["a" * 50], [""], []):
        got = [(of[p], *rest) for p, *rest in zip(*(x.tolist() for x in table.found(pa.array([*given, "cut off"], pa.string()).slice(0, len(given)))), strict=True)]
        want = {(n, i, t.count(n), t.find(n) + 1) for i, t in enumerate(given) for n in needles if n in t}
        assert len(got) == len(want) and set(got) == want
