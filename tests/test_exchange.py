"""Corner rows of dates, captions, messages, addresses, files and streams."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import dates, publishing
from newsflow.operators import publication
from newsflow.sources import files
from newsflow.streaming import events


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, ""), ("", ""), ("abc", ""), ("2026-02-31", ""), ("2026-05-27T07:00:00Z", "2026-05-27 07:00:00"), ("2026-05-27T07:00:00+07:00", "2026-05-27 07:00:00"), ("2026-05-27", "2026-05-27 00:00:00"),
     ("27/05/2026, 7h30", "2026-05-27 07:30:00"), ("Cập nhật: 27-05-2026", "2026-05-27 00:00:00"), ("CẬP NHẬT 7/5/2026 lúc 23:59:58", "2026-05-07 23:59:58"), ("Wed, 27 May 2026 10:05:09 +0700", "2026-05-27 10:05:09"),
     ("27 May 2026 10:05", "2026-05-27 10:05:00"), ("27/05/2026 09:08 (GMT+7)", "2026-05-27 09:08:00"), ("31/13/2026", ""), ("27/05/2026 25:00", "")],
)
def test_parse_datetime_text(spark, text, want):
    assert one(spark, text, dates.parse_datetime_text) == want


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("2026-05-27T07:05:00+07:00", "27/05/2026 07:05"), ("2026/5/7 7:05", "07/05/2026 07:05"), ("27/05/2026", "27/05/2026"), ("31/02/2026", "31/02/2026"), ("2026-02-31", "2026-02-31"), ("soon", "soon")])
def test_format_published(spark, text, want):
    assert one(spark, text, dates.format_published) == want


def test_next_run_at_the_minute_itself_is_tomorrow(spark):
    assert one(spark, "2024-12-31 07:00:00", dates.next_run_at) == "2025-01-01 07:00:00"
    assert one(spark, "2024-12-31 06:59:59", dates.next_run_at) == "2024-12-31 07:00:00"
    assert one(spark, "2024-12-31 06:59:59", lambda c: dates.next_run_at(c, "25:00")) == "2024-12-31 07:00:00"


def test_caption_text(spark):
    assert one(spark, "\r\n a \t b \r\n\r\n\r\n\n c \n", publishing.caption_text) == "a b\n\nc"
    assert one(spark, None, publishing.caption_text) == ""


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("", ""), ("a, b", "b"), ("a 1x, b 1080w", "b"), ("a 2x, b 1080w", "a"), (" , ,a 10w,", "a"), ("a xw, b -w", "b"), ("a 5W", "a")])
def test_srcset(spark, text, want):
    assert one(spark, text, publishing.srcset_best) == want


def test_image_variants():
    assert publishing.variants_of("data/a.jpg?w=1") == ["data/a.jpg?w=1"]
    assert publishing.variants_of("https://h/a.jpg?W=1&Sig=2") == ["https://h/a.jpg?W=1&Sig=2"]
    assert publishing.variants_of("https://h/a.jpg") == ["https://h/a.jpg"]
    assert publishing.variants_of("https://h/a.jpg?h=9&quality=5&fit=max") == ["https://h/a.jpg?h=610&quality=100&fit=max&q=100&dpr=1", "https://h/a.jpg", "https://h/a.jpg?h=9&quality=5&fit=max"]


def test_telegram_message_shrinks_in_steps_and_escapes(spark):
    row = ("<b>&", "s " * 300, "", "", "", "", "", "https://h/" + "a" * 600)
    df = spark.createDataFrame([row], "title string, summary string, source string, category string, content_topic string, published_at string, crawled_at string, url string")
    whole, short, least = df.select(publishing.fit_telegram(4096), publishing.fit_telegram(900), publishing.fit_telegram(100)).first()
    assert "<b>&lt;b&gt;&amp;</b>" in whole and "Newsflow | Tin tức" in whole and "Ngày đăng" not in whole
    assert len(short) <= 900 < len(whole) and len(least) <= 100 and least.endswith("...")


def test_card_names_are_unique(spark):
    df = spark.createDataFrame([(1, "Đề A", None, "", "", "u"), (2, "de-a", " ", None, "", "u"), (3, "", "S", "C", "", None)], "id int, title string, source string, category string, content_topic string, url string")
    assert [r.filename for r in publishing.card_filenames(df).orderBy("id").collect()] == ["newsflow-news-de-a.jpg", "newsflow-news-de-a-2.jpg", "s-c-article-da39a3ee5e.jpg"]


def test_media_items_need_as_many_images(spark):
    articles = spark.createDataFrame([(1, "t", "s", "", "ftp://x")], "id int, title string, summary string, source string, url string")
    bad = spark.createDataFrame([("p", [1], [])], "publication_id string, article_ids array<int>, image_paths array<string>")
    with pytest.raises(Exception, match="differ in number"):
        publication.media_items(bad, articles).collect()
    good = spark.createDataFrame([("p", [1, 9], [" a.jpg", "b"])], bad.schema)
    assert [(r.order_index, r.local_image_path, r.photo_caption, r.invalid) for r in publication.media_items(good, articles).collect()] == [(1, "a.jpg", None, True)]


def test_csv_round_trip_keeps_line_feeds_quotes_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([(' a "b",\nc ', "NA", None, "x")], "title string, source string, url string, extra string")
    files.write_csv(df, str(tmp_path / "a"), files=1)
    row = files.read_csv(spark, str(tmp_path / "a")).first()
    assert (row.title, row.source, row.url, row.category) == (' a "b",\nc ', "", "", "") and not hasattr(row, "extra")
    assert files.read_csv(spark, str(tmp_path / "a"), na=False).first().source == "NA"


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿source,title\nX,Y\n", "utf-8")
    assert files.read_csv(spark, str(tmp_path / "b.csv")).first()[:2] == ("X", "Y")


def test_fields_with_one_slug(spark, tmp_path):
    df = spark.createDataFrame([("A B", "1"), ("a-b", "2"), ("", "3"), (None, "4")], "source string, title string")
    files.write_by_field(df, "source", str(tmp_path / "f"))
    got = spark.read.option("header", True).csv(str(tmp_path / "f")).select("file", "title").collect()
    assert sorted(map(tuple, got)) == [("a-b", "2"), ("khac", "3"), ("khac", "4")]


def test_outputs_of_a_run(spark, tmp_path):
    rows = files.project(spark.createDataFrame([("S", "old", "u1"), ("S", "new", "u2")], "source string, title string, url string")).withColumn("ord", F.monotonically_increasing_id())
    new = files.write_outputs(rows, rows.where("url = 'u1'"), "2024-01-15", str(tmp_path / "o"))
    assert [r.title for r in new.collect()] == ["new"]
    assert files.read_json(spark, str(tmp_path / "o/daily/2024-01-15/raw/new_articles.json"), limit=5).count() == 1
    assert files.read_csv(spark, str(tmp_path / "o/daily/2024-01-15/exports/articles.csv")).count() == 2


def test_stream_adds_only_new_urls(spark, tmp_path):
    source = tmp_path / "in"
    for i, urls in enumerate((["a", "b", "a"], ["b", "c", ""])):
        spark.createDataFrame([(i * 10 + n, u) for n, u in enumerate(urls)], "ord int, url string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("ord int, url string").parquet(str(source))
        events.merge_stream(stream, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m" / "master")).select("ord", "url").collect()
    assert sorted(map(tuple, got)) == [(0, "a"), (1, "b"), (11, "c")]
