"""Stored tables: which buckets a batch writes, replays, writers that break off or meet, old versions, cleaning."""

import pytest
from pyspark.sql import functions as F

from newsflow.sources.stored import Stored, last_wins, upsert_articles

ROWS = "id bigint, url string, v string"


@pytest.fixture
def store(spark):
    s = Stored(spark)
    s.create(spark.createDataFrame([(i, f"u{i}", "old") for i in range(200)] + [(900 + i, "", "old") for i in range(50)] + [(999, None, "old")], ROWS), ["url"], buckets=16, ident="id")
    return s


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROWS)


def values(df):
    return sorted(((r.id, r.url, r.v) for r in df.collect()), key=str)


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, store):
    before = store.version()
    assert store.commit("b1", rows(spark, (3, "u3", "new")), last_wins(["url"], "id")) is not None
    after = store.version()
    changed = [b for b in before.buckets if before.buckets[b] != after.buckets[b]]
    assert len(changed) == 1 and after.loose == before.loose
    assert [r.v for r in store.lookup("u3").collect()] == ["new"] and [r.v for r in store.lookup("u4").collect()] == ["old"]
    assert store.lookup("none").count() == 0
    assert len(values(store.read())) == 251 and [x for x in values(store.read()) if x[2] == "new"] == [(3, "u3", "new")]
    assert [x for x in values(store.read(0)) if x[2] == "new"] == []


def test_replays(spark, store):
    batch = rows(spark, (5, "u5", "x"), (None, "", "loose"))
    merge = last_wins(["url"], "v")
    assert store.commit("b", batch, merge) is not None
    n = store.version().number
    assert store.commit("b", batch.repartition(3), merge) is None and store.version().number == n
    with pytest.raises(ValueError, match="other rows"):
        store.commit("b", rows(spark, (5, "u5", "y")), merge)
    with pytest.raises(ValueError, match="letters"):
        store.commit("../b", batch, merge)


def test_a_batch_that_breaks_off_leaves_the_table(spark, store, monkeypatch):
    want = values(store.read())
    with monkeypatch.context() as m:
        m.setattr(Stored, "_publish", lambda self, v: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.commit("b", rows(spark, (5, "u5", "x")), last_wins(["url"], "id"))
    assert values(store.read()) == want
    assert store.commit("b", rows(spark, (5, "u5", "x")), last_wins(["url"], "id")) is not None
    got = values(store.read())
    assert store.clean() > 0 and values(store.read()) == got and store.clean() == 0


def test_of_two_writers_the_slower_starts_again(spark, store, monkeypatch):
    publish, met = Stored._publish, []

    def late(self, v):
        if not met:
            met.append(1)
            Stored(spark, store.path).commit("other", rows(spark, (6, "u6", "theirs")), last_wins(["url"], "id"))
        return publish(self, v)

    monkeypatch.setattr(Stored, "_publish", late)
    store.commit("mine", rows(spark, (7, "u7", "mine")), last_wins(["url"], "id"))
    assert {x[2] for x in values(store.read())} == {"old", "theirs", "mine"} and set(store.version().batches) == {"other", "mine"}
    with pytest.raises(ValueError, match="there is a table"):
        Stored(spark, store.path).create(rows(spark), ["url"])


def test_articles_without_a_url_are_dealt_out_and_numbered(spark):
    names = ("source", "title", "published_at", "crawled_at", "thumbnail", "newspaper_type", "content_topic", "category", "summary", "summary_source")
    s = Stored(spark)
    empty = spark.createDataFrame([], "id bigint, url string, " + ", ".join(f"{n} string" for n in names) + ", status string, updated_at string")
    s.create(empty, ["url"], ident="id")
    crawl = spark.createDataFrame([(i, "" if i % 3 else f" u{i % 9} ", "s", f"t{i}", *[""] * 8) for i in range(300)], "ord bigint, url string, " + ", ".join(f"{n} string" for n in names))
    upsert_articles(s, "1", crawl, "now")
    assert s.read().where("url <> ''").select("url").distinct().count() == 3
    ids = [r.id for r in s.read().collect()]
    assert sorted(ids) == list(range(1, 204))
    first = {r.title: r.id for r in s.read().where("url = ''").collect()}
    assert [first[t] for t in sorted(first, key=lambda t: int(t[1:]))] == sorted(first.values())
    upsert_articles(s, "2", crawl.where("ord = 1"), "later")
    assert s.read().agg(F.max("id")).first()[0] == 204
    with pytest.raises(FileNotFoundError):
        Stored(spark).version()
