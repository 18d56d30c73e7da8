"""Filtering stages on tables whose ids are null or reused."""

import random

import pytest

from newsflow.llm import decontamination, ngram_join

random.seed(8)
prose = lambda n=60: " ".join(f"w{random.randrange(900)}" for _ in range(n))


def test_deduplicate_keeps_different_texts_of_an_id(spark):
    a, b = prose(), prose()
    near = a + " tail"
    others = [prose() for _ in range(40)]
    copies = [others[0] + " end", others[0]]
    rows = [(7, a), (7, b), (3, near), *((None, t) for t in others + copies), (9, others[1])]
    got = [tuple(r) for r in ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    rest = sorted(t for i, t in got if i is None)
    assert sorted((i, t) for i, t in got if i is not None) == [(3, near), (7, b)]
    assert len(rest) == 40 and set(others[1:]) < set(rest) and len({others[0], copies[0]} & set(rest)) == 1


@pytest.mark.parametrize("id_", [None, 5])
def test_remove_keeps_clean_documents_of_an_id(spark, id_):
    item = prose(14)
    rows = [(id_, f"{prose(20)} {item} {prose(20)}"), (id_, prose()), (id_, None), (8, prose())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontamination.remove(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows[1:]))


def test_remove_by_blocks_and_odd_columns(spark, monkeypatch):
    items = [prose(14) for _ in range(6)]
    rows = [(str(i), f"{prose(20)} {items[i % 6] if i % 4 == 1 else ''} {prose(20)}", "x", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `a.b` string, _key int")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    got = decontamination.remove(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for i, r in enumerate(rows) if i % 4 != 1)
    assert decontamination.remove(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 40
