"""A model file that is gone raises, reruns of a mix agree on rows with texts, and column names may hold dots."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from newsflow.llm import license_scan, lm_scoring, mixing, quality_rules, token_rollups, warc


def _first(path, pattern):
    return sorted(glob.glob(f"/{path.removeprefix('file:').lstrip('/')}/{pattern}"))[0]


@pytest.mark.parametrize("level", [1, 2])
def test_lost_shard_of_a_language_model_raises(spark, level):
    docs = spark.createDataFrame([(i, f"one two three w{i} w{i * 7 % 50}") for i in range(100)], "doc_id bigint, text string")
    model = lm_scoring.fit(docs, order=2, shards=4)
    assert lm_scoring.score(docs, model).count() == 100
    os.remove(_first(model.path, f"level{level}-*"))
    lm_scoring._last.clear()
    with pytest.raises(Exception, match="keys"):
        lm_scoring.score(docs.repartition(7), lm_scoring.Model(model.path + "/.", model.order, model.shards, model.levels, model.keys)).collect()


def test_lost_shard_of_frequencies_raises(spark):
    files = spark.createDataFrame([(i, f"a/{i}", f"some words here w{i % 9} and licence terms apply") for i in range(60)], "doc_id bigint, path string, text string")
    t = license_scan._Templates({"x": "licence terms apply"})
    _, _, kept = license_scan._corpus_frequencies(files.select("text"), t)
    assert kept.sizes and sum(kept.sizes.values()) > 0
    os.remove(_first(kept.path, f"terms-{next(iter(kept.sizes))}"))
    with pytest.raises(FileNotFoundError, match="terms"):
        kept.get(next(iter(kept.sizes)))


def test_mix_of_one_id_with_many_texts_repeats_itself(spark):
    rows = [(7, f"{t} " * 3, "s", {"k": 1}) for t in "abcd" for _ in range(50)] + [(None, "x y", "s", None)] * 20 + [(9, "other words", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra map<string, int>")
    runs = [sorted((str(r.doc_id), r.text, r.taken) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)


def test_column_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", "u")], "`i.d` bigint, `t.t` string, `s.s` string, `l.l` string, `u.u` string")
    assert quality_rules.judge(docs, "t.t", "i.d", "s.s").first().n_words == 3
    assert token_rollups.signed(docs, "space", token_rollups.space_words("t.t"), 1, "s.s", "l.l").first().tokens == 3
    archive = warc.write(docs, "i.d", "u.u", "t.t")
    assert warc.report(spark, archive).first().page_id == 1
    got = license_scan.scan(docs.withColumn("p.p", F.lit("a/LICENSE")), "p.p", "t.t", "i.d")
    assert got.first().path == "a/LICENSE"
