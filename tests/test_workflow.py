"""Corner rows of the dashboard, retrieval, run and file operators."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import text
from newsflow.operators import articles, workflow
from newsflow.sources import files

ARTICLE = "id long, title string, summary string, source string, category string, content_topic string, status string, published_at string, crawled_at string, created_at string, updated_at string"


def test_positions_over_many_ranges(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = {r.id: r.pos for r in articles.numbered(df, [F.desc("k"), F.col("id")]).collect()}
    order = sorted(range(5000), key=lambda i: -(i * 7919 % 5003))
    assert got == {i: p for p, i in enumerate(order, 1)}
    assert articles.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_retrieval_falls_back(spark):
    rows = [(i, f"tin {i}", "chung", "VNExpress" if i % 2 else "PTIT", "Giáo dục" if i % 3 == 0 else "Khác", "", "approved", f"2024-01-{i + 1:02d} 08:00:00", "", "", "") for i in range(14)]
    df = spark.createDataFrame([*rows, (99, "tin 99", "an", "PTIT", "", "", "pending", "2024-01-20 08:00:00", "", "", "")], ARTICLE)
    asked = [
        ("day", "count_today", "", "", ""), ("day none", "count_today", "", "", "zebra"), ("day source", "count_today", "PTIT", "", ""), ("word", "search", "", "", "tin 7"),
        ("word none", "search", "", "giáo dục", "zebra"), ("word nothing", "search", "", "", "zebra"), ("loose", "search", "", "", ""), ("sum", "summarize", "PTIT", "giáo dục", ""), ("src", "source", "ptit", "", "x"),
    ]
    intents = spark.createDataFrame(asked, "m string, type string, source string, topic string, keyword string")
    found = {}
    for r in sorted(workflow.retrieve(df, intents, "2024-01-14", limit=3).collect(), key=lambda r: r.pos):
        found.setdefault(r.m, []).append(r.id)
    assert found == {"day": [13], "day source": [12, 10, 8], "word": [7], "word none": [12, 9, 6], "loose": [13, 12, 11], "sum": [12, 9, 6], "src": [12, 10, 8]}


def test_breaker_and_plans(spark):
    said = ["failed", "ok", "failed", "failed", "failed", "ok"]
    calls = spark.createDataFrame([(1, "a", i, o) for i, o in enumerate(said)] + [(1, "b", 0, "limited"), (1, "b", 1, "ok"), (2, "b", 0, "ok")], "run int, provider string, ord int, outcome string")
    skipped = {(r.run, r.provider, r.ord) for r in workflow.breaker(calls).collect() if r.skipped}
    assert skipped == {(1, "a", 5), (1, "b", 1)}
    cards = [(1, "T", "S", "u", "c", "", "2024-01-01 1", None, None, None, None, "data/uploads/a.png", ""), (2, "T", "S", "u", "c", "", "x", "2024-02-02", "", "", "", "", ""), (3, None, None, None, None, None, None, None, None, None, None, "http://x", "data/generated_images/3.jpg")]
    df = spark.createDataFrame(cards, "id int, title string, source string, url string, category string, content_topic string, crawled_at string, published_at string, created_at string, approved_at string, updated_at string, generated_poster_image string, image_path string")
    plan = lambda **how: {r.id: (r.folder, r.action, r.target) for r in workflow.card_plan(df, **how).collect()}
    assert plan() == {1: ("2024-01-01", "skipped_upload", ""), 2: ("2024-02-02", "regenerated", "data/generated_images/2024-02-02/s-c-t-2.jpg"), 3: ("uncategorized", "regenerated", "data/generated_images/3.jpg")}
    assert plan(include_uploads=True, date="2024-01-01") == {1: ("2024-01-01", "regenerated", "data/uploads/a.png")}


def test_status_of_a_table_of_ids(spark):
    df = spark.createDataFrame([(i, "pending", "pending", "", "", "", "") for i in range(4)], "id long, status string, approval_status string, reviewed_at string, approved_at string, deleted_at string, updated_at string")
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    got = {r.id: tuple(r)[1:] for r in articles.set_status(df, ids, "deleted", "now").collect()}
    assert got == {i: ("deleted", "pending", "", "", "now", "now") if i == 1 else ("pending", "pending", "", "", "", "") for i in range(4)}
    with pytest.raises(ValueError):
        articles.set_status(df, ids, "gone", "now")


def test_files_with_marks_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([("s", "a, \"b\"", "u")], "source string, title string, url string")
    files.write_csv(df, f"{tmp_path}/m", files=1, mark=True)
    part = next(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfsource")
    assert [(r.source, r.title) for r in files.read_csv(spark, f"{tmp_path}/m").collect()] == [("s", 'a, "b"')]
    assert not files.is_blank(spark, f"{tmp_path}/m")
    for n in (0, 1, 3):
        files.write_json_array(spark.range(n).select(F.col("id").cast("string").alias("title")), f"{tmp_path}/j{n}")
        assert sorted(r.title for r in files.read_json(spark, f"{tmp_path}/j{n}", array=True).collect()) == [str(i) for i in range(n)]


def test_images_by_slug_with_short_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "abcdefgh"), (3, "zz"), (4, ""), (5, None)], "id int, slug string")
    images = spark.createDataFrame([(10, "x-abcdefgh-y", 5), (11, "abcdefg", 9), (12, "", 99)], "image_id int, stem string, mtime int")
    assert {r.id: r.image_id for r in articles.images_of(df, images).collect()} == {1: 11, 2: 10}


def test_parameters_and_texts(spark):
    day = lambda x: spark.createDataFrame([(x,)], "d string").select(workflow.date_parameter(F.col("d"), "2024-01-15")).first()[0]
    assert [day(x) for x in (None, "", "ALL", "2024-01-01", "2024-02-01", "2024-1-1")] == ["2024-01-15", "2024-01-15", "", "2024-01-01", "2024-01-15", "2024-01-15"]
    row = spark.createDataFrame([(["3", "x", "12", "3", "-1", ""], "a b/~*é")], "ids array<string>, t string").select(text.clean_ids(F.col("ids")).alias("i"), text.url_quote("t").alias("q")).first()
    assert row.i == [3, 12] and row.q == "a%20b%2F~%2A%C3%A9"
    links = {(r.total, r.page): (r.first, r.last) for r in workflow.page_links(spark.createDataFrame([(0,), (100,)], "total long")).collect()}
    assert links[0, 1] == (1, 1) and links[100, 1] == (1, 5) and links[100, 5] == (3, 7) and links[100, 9] == (5, 9)
