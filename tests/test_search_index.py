"""The index against scans: any needle, any pattern, blocks and rare grams, needles without a gram."""

import random

import pytest
from pyspark.sql import functions as F

from newsflow.functions import text as tx
from newsflow.operators import search_index as ix


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    words = ["Giáo", "dục", "ĐÀO", "tạo", "a", "ab", "xin", "chào", "as", "Hà", "Nội", "e\\f", "50%", "under_score", "\n", "…"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(9)))
    data = [(i, text(), rng.choice([None, "", text()])) for i in range(300)] + [(1000, "long " * 20000 + "needle", None), (1001, None, None)]
    return spark.createDataFrame(data, "id bigint, title string, summary string").cache()


@pytest.mark.parametrize("block", [4096, 7])
def test_folded_needles_equal_a_scan(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ix, "BLOCK", block)
    index = ix.build(rows, {"both": ix.folded("title", "summary"), "one": ix.folded("title")})
    needles = ["giao duc", "a", "as", "ab", "dao tao", "o t", "noi ha", "needle", "g n", "zzz", "uc d", "50", "chao xin chao", "ng long"]
    asked = spark.createDataFrame([(g, n) for g in ("both", "one") for n in needles] + [("one", "")], "grp string, needle string")
    got = {}
    for r in ix.search(index, asked).collect():
        got.setdefault((r.grp, r.needle), []).append(r.id)
    for n in needles:
        # a text key of the plain rule: up to two characters are a whole word
        has = lambda c, n=n: tx.matches(n, tx.normalize(c))
        assert sorted(got.get(("one", n), [])) == sorted(r.id for r in rows.where(has("title")).collect()), n
        assert sorted(got.get(("both", n), [])) == sorted(r.id for r in rows.where(has("title") | has("summary")).collect()), n


@pytest.mark.parametrize("pattern", ["%giáo%", "%Giáo d_c%", "gi%", "%", "_", "%e\\f%", "%50%", "%r_s%n%", "%A", "%\n%", "%zz%", "%ch_o xin%"])
def test_patterns_equal_a_scan(rows, pattern):
    index = ix.build(rows, {"x": ix.lowered("title", "summary")}, sizes=(1, 2, 3))
    want = rows.where(tx.like(F.coalesce("title", F.lit("")), pattern) | tx.like(F.coalesce("summary", F.lit("")), pattern))
    assert sorted(r.id for r in ix.search_like(index, "x", pattern).collect()) == sorted(r.id for r in want.collect())


def test_a_search_reads_the_buckets_of_its_grams(spark, rows):
    index = ix.build(rows, {"one": ix.folded("title")})
    plan = ix.search(index, spark.createDataFrame([("one", "needle")], "grp string, needle string"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "dynamicpruning" in plan.lower() or "bucket" in plan
    assert ix.build(rows.limit(0), {"one": ix.folded("title")}).texts().count() == 0


def test_many_needles_read_no_lists(spark, rows, monkeypatch):
    index = ix.build(rows, {"both": ix.folded("title", "summary"), "one": ix.folded("title")})
    asked = spark.createDataFrame([(g, n) for g in ("both", "one") for n in ("giao duc", "a", "ab", "dao tao", "o t", "needle", "zzz", "uc d")], "grp string, needle string")
    found = lambda rows: sorted((r.grp, r.needle, r.id) for r in rows.collect())
    want = found(ix.search(index, asked))
    monkeypatch.setattr(ix, "LISTS", 0)
    got = ix.search(index, asked)
    assert found(got) == want and want
    assert "postings" not in got._jdf.queryExecution().toString()


def test_an_index_is_made_without_a_shuffle_of_its_lists(spark, rows, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK_CHARS", 50)
    index = ix.build(rows, {"both": ix.folded("title", "summary"), "one": ix.folded("title")}, sizes=(1, 2, 3))
    lists = index._table("postings").select("grp", "gram", "block", F.explode("ids").alias("id"))
    grams = lists.select("grp", "gram", "id").collect()
    want = {(r.grp, r.text[i : i + n], r.id) for r in index.texts().collect() for n in (1, 2, 3) for i in range(len(r.text) - n + 1)}
    assert set(grams) == want and len(grams) == len(want)
    held = lists.select("grp", "block", "id").distinct().join(index.texts(), ["grp", "id"]).groupBy("block").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("grp").alias("groups"))
    assert held.where("groups > 1 OR n > 1 AND chars > 50").count() == 0
    assert index._table("postings").where("size(ids) = 0").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7])
def test_lists_of_a_block(size):
    import pyarrow as pa

    for texts in ([""], ["a"], ["", "abab", "\x00\n\x00", "Đà Nẵng 😀😀", "abab ab", ""], ["".join(map(chr, range(0x4E00, 0x9000))), "漢字漢字" * 3]):
        got = ix._lists_of(size, "g", 5, pa.array(range(10, 10 + len(texts))), texts)
        assert set(got.column(0).to_pylist()) <= {"g"} and set(got.column(2).to_pylist()) <= {5}
        names = got.column(1).to_pylist()
        assert len(names) == len(set(names))
        assert dict(zip(names, got.column(3).to_pylist())) == {t[i : i + size]: [10 + n for n, x in enumerate(texts) if t[i : i + size] in x] for t in texts for i in range(len(t) - size + 1)}
