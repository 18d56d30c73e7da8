"""Every query of the catalogue against its SQL, and corner rows of the operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from newsflow.functions import text, topics
from newsflow.operators import articles
from newsflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(str([r[c] for c in sorted(names)]) for r in df.collect())
    assert got == sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())


def test_keep_first_skips_blank_and_null_urls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "ord int, url string")
    assert [r.ord for r in articles.keep_first(df).collect()] == [1]


def test_like_wildcards_and_ascii_folding(spark):
    df = spark.createDataFrame([("Giáo",), ("GIÁO",), ("a\\b",)], "t string")
    assert df.where(text.like("t", "%giáo%")).count() == 1
    assert df.where(text.like("t", "A\\b")).count() == 1


def test_status_groups(spark):
    df = spark.createDataFrame([(" Published ",), ("Đã đăng",), ("da dang",), ("DUYET",), ("x",), (None,)], "status string")
    assert [r[0] for r in df.select(topics.status_group("status")).collect()] == ["published", "other", "published", "published", "other", "other"]


def test_page_is_clamped(spark):
    df = spark.range(13).select("id")
    assert articles.page(df, [F.col("id")], 99, total=13).count() == 1
    assert articles.page(df, [F.col("id")], -1, total=13).count() == 12


def test_move_up_then_down_is_identity(spark):
    from newsflow import fixtures

    rows = fixtures.load(spark, SF).articles
    base = {r.id: r.client_order for r in articles.move(rows, rows.where("status = 'approved'").first().id, 10**9).collect()}
    assert sorted(base.values()) == list(range(1, len(base) + 1))


def test_entry_works_without_optional_parts(monkeypatch):
    import __spark_entry__ as e

    assert "approved_page" in e.queries()
    assert e._optional("newsflow.llm.queries") is None or "op2_quality_rules" in e.queries()

    def broken(name):
        raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")

    monkeypatch.setattr(e.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        e._optional("newsflow.llm.queries")
