"""Nulls, empty tables, ties, clashing columns and round trips of the other operators."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import license_scan, mixing, quality_classifier, quality_rules, token_rollups, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    junk = " ".join(["spam"] * 60)
    rows = [(i, f"a good text number {i} " + " ".join(f"w{j * i % 17}x{j}" for j in range(30)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, junk, "en", "s1", 1), (103, "x\nx\n\ny# $", "en", None, 1), rows[0], (None, "no id", "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs.withColumn("host", F.lit(1)).withColumn("words", F.lit(2))).collect()}
    assert quality_rules.judge(docs).count() == docs.count()
    assert got[102].n_repeat_words == 60 and got[102].base_failed
    assert (got[103].n_dup_lines, got[103].n_symbols, got[103].n_words) == (1, 2, 4)
    assert got[100].n_words == 0 and got[100].base_failed
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good, "en", "good", 1) for i in range(200)] + [(1000 + i, good + " #" * 20 if i else good, "en", "bad", 1) for i in range(200)] + [(2000, good + " #" * 20, "en", "tiny", 1)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].kept and not got[1000].base_failed and not got[1000].kept and got[2000].n_symbols == 20


def test_mixing(docs):
    got = mixing.mix(docs.withColumn("size", F.lit(5)).withColumn("target", F.lit("x"))).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3).withColumn("size", F.lit(5)).withColumn("target", F.lit("x"))).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_and_scores_keep_odd_columns(spark, docs):
    odd = docs.withColumn("Size", F.lit("s")).withColumn("a.b", F.lit("d"))
    for name in ("h", "bucket", "rest", "cut", "before", "whole", "extra", "row", "_src", "c0"):
        odd = odd.withColumn(name, F.lit("mine"))
    got = mixing.mix(odd)
    assert got.columns == [c for c in odd.columns if c != "Size"] + ["size", "source_size", "target", "taken"]
    assert {tuple(r) for r in got.select("`a.b`", "h", "bucket", "rest", "cut", "before", "whole", "extra", "row", "_src", "c0").collect()} == {("d", *["mine"] * 10)}
    plain = sorted(str((r.doc_id, r.taken)) for r in mixing.mix(docs).collect())
    assert sorted(str((r.doc_id, r.taken)) for r in got.collect()) == plain
    body = docs.withColumnRenamed("text", "body").withColumn("text", F.lit("other")).withColumn("SCORE", F.lit(1)).withColumn("a.b", F.lit("d"))
    model = quality_classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"))
    scored = quality_classifier.score(body, model, text="body")
    assert scored.columns == [c for c in body.columns if c != "SCORE"] + ["score", "predicted"]
    want = sorted((str(r.doc_id), r.score) for r in quality_classifier.score(docs, model).collect())
    assert sorted((str(r.doc_id), r.score) for r in scored.collect()) == want and {r.text for r in scored.collect()} == {"other"}


def brute_ratios(sets, labels):
    """Log of the smoothed shares of texts with each indicator, label 1 against 0; 0 where fewer than three texts have it."""
    have = [[sum(f in s for s, y in zip(sets, labels, strict=True) if y == c) for f in range(max(map(max, sets)) + 1)] for c in (1, 0)]
    n = [sum(y == c for y in labels) for c in (1, 0)]
    return [math.log((a + 1) / (n[0] + 2)) - math.log((b + 1) / (n[1] + 2)) if a + b > 2 else 0.0 for a, b in zip(*have, strict=True)]


def test_classifier_against_brute_force():
    """Indicators, ratios, the optimum of the dual problem, and the calibration."""
    random.seed(4)
    texts = [" ".join(random.choices(["alpha", "beta", "gamma", "delta"] if i % 3 else ["alpha", "spam!", "WIN", "9"], k=random.randint(3, 9))) for i in range(60)]
    labels = np.array([int(i % 3 > 0) if i % 7 else int(i % 3 == 0) for i in range(60)])
    text, feature = quality_classifier.features(pa.array(texts + [None, ""]))
    sets = [feature[text == i] for i in range(60)]
    assert not (text >= 60).any()
    kinds = lambda t: len({tuple(quality_classifier._CLASS[list(t.encode()[i : i + 3])]) for i in range(len(t.encode()) - 2)})
    for t, s in zip(texts, sets, strict=True):
        w = t.lower().split()
        run = max(len(list(g)) for _, g in itertools.groupby(w))
        grams = [f for f in s if f < 1 << quality_classifier.WORD_BITS]
        assert len(set(w) | set(zip(w, w[1:]))) - 1 <= len(grams) <= len(set(w) | set(zip(w, w[1:])))  # hashed, so one may collide
        assert len(s) - len(grams) == kinds(t) + sum(run >= r for r in quality_classifier.RUNS)
    model = quality_classifier.learn(sets, labels)
    held = np.arange(60) % 5 == 4
    rows, y = [sets[i] for i in np.flatnonzero(~held)], np.where(labels[~held] > 0, 1, -1)
    want = np.zeros(quality_classifier.FEATURES)
    ratios = brute_ratios([set(r.tolist()) for r in rows], labels[~held].tolist())
    want[: len(ratios)] = ratios
    w, bias = quality_classifier.descend(rows, y, want)
    assert np.allclose(model.weights, w * want) and model.bias == bias
    # No change of the weights along coordinate directions or at random lowers the primal objective of the long-run solution much.
    w, bias = quality_classifier.descend(rows, y, want, epochs=400)
    share = [(y < 0).mean(), (y > 0).mean()]
    x = np.zeros((len(rows), quality_classifier.FEATURES + 1))
    for i, r in enumerate(rows):
        x[i, r], x[i, -1] = want[r] / math.sqrt(len(r)), 1
    cost = np.where(y > 0, 0.5 / share[1], 0.5 / share[0])
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w, bias)
    at = primal(best)
    dual = brute_dual(x @ x.T, y, cost)
    assert at - dual <= 1e-3 * at and dual <= at + 1e-6
    # The calibration solves its two equations, up to its slight ridge.
    margin = x[:, :-1] @ w + bias
    a, b = quality_classifier._logistic(margin, y)
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    gap = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)) - 1 / (1 + np.exp(-(a * margin + b)))
    assert abs(gap @ margin - 1e-3 * a) < 1e-4 and abs(gap.sum() - 1e-3 * b) < 1e-4


def brute_dual(kernel, y, cost):
    """The greatest value of the dual, by projected gradient steps."""
    q = kernel * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(40_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    return alpha.sum() - alpha @ q @ alpha / 2


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "z" * 70000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("address", F.lit(1))
    archive = warc.write(pages)
    got = {r.page_id: r for r in warc.report(spark, archive).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response" and got[3].refers_to == 4
    import base64

    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [bytes(r.record) for r in warc.records(spark, archive).collect()]
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert rest[length:] == b"\r\n\r\n"
    assert spark.read.parquet(archive.path + "/payloads").count() == 3
    assert warc.report(spark, warc.write(pages, min_bytes=1)).where("record_type = 'revisit'").count() == 1
    assert warc.report(spark, warc.write(pages.limit(0))).count() == 0


def test_rollups_are_idempotent(spark, docs):
    store = token_rollups.Rollups(spark)
    assert store.totals().count() == 0
    one = token_rollups.signed(docs, "space-1", token_rollups.space_words("text"), 1)
    assert store.commit("a", one) and not store.commit("a", one)
    total = store.totals().agg(F.sum("docs"), F.sum("tokens")).first()
    assert total[0] == docs.count() and total[1] == docs.select(token_rollups.space_words("text").alias("n")).agg(F.sum("n")).first()[0]
    two = token_rollups.signed(docs, "alnum-1", token_rollups.alnum_words("text"), 1)
    store.commit("b", token_rollups.revision(one, two))
    assert {r.tokenizer for r in store.totals().collect()} == {"alnum-1"}
    store.commit("c", two.withColumn("sign", F.lit(-1)))
    assert store.totals().count() == 0
    with pytest.raises(ValueError):
        store.commit("../x", one)
    with pytest.raises(ValueError, match="other rows"):
        store.commit("a", two)


def test_rollups_survive_broken_commits_and_compaction(spark, docs, monkeypatch):
    store = token_rollups.Rollups(spark)
    one = token_rollups.signed(docs, "space-1", token_rollups.space_words("text"), 1)
    two = token_rollups.signed(docs, "alnum-1", token_rollups.alnum_words("text"), 1)
    rows = lambda: sorted(map(str, store.totals().collect()))
    with monkeypatch.context() as broken:  # a writer that goes down between its data and its commit
        broken.setattr(token_rollups.Rollups, "_create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.commit("a", one)
    assert store.totals().count() == 0 and store.commit("a", one) and not store.commit("a", one)
    assert store.commit("b", two)
    before = rows()
    other = token_rollups.Rollups(spark, store.path)  # another writer of the same store
    assert not other.commit("b", two) and rows() == before
    store.compact()
    assert rows() == before and len(store._folders()[0]) == 1
    store.compact()
    assert not store.commit("a", one) and rows() == before
    store.commit("c", two.withColumn("sign", F.lit(-1)))
    assert len(store._folders()[0]) == 2 and {r.tokenizer for r in store.totals().collect()} == {"space-1"}
    store.compact()
    assert {r.tokenizer for r in other.totals().collect()} == {"space-1"}


def test_bpe_tokens(spark):
    import public_tokenizers as P

    got = spark.createDataFrame([("hello world",), (None,), ("",)], "text string").select(token_rollups.bpe_tokens("text", str(P.path("byte_bpe_50k.json"))).alias("n")).collect()
    assert got[0].n == 2 and got[1].n == 0 and got[2].n == 0


def test_classifier_separates_held_out_rows(spark):
    rows = [(i, " ".join(f"w{(i * j) % 31}" for j in range(40)) if i % 3 else "BUY!! NOW!! " * 20) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(200, 300)) and all(0 <= r.score <= 1 for r in got.values())
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_licences_and_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "words\nand words"), (3, "a/b/y.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore"),
            (4, "c/x.txt", None), (5, None, "Licensed under CC BY-NC 4.0."), (6, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/c/d/z", ""), (2, "a/b/x.txt", "again")]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("own", F.lit(1))
    got = {r.doc_id: r for r in license_scan.scan(files).collect()}
    assert {i: got[i].license for i in got} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: None, 5: "CC-BY-NC-4.0", 6: "GPL-3.0", 7: "GPL-3.0"}
    assert license_scan.scan(files).count() == 8 and got[7].from_dir == "a/b/c" and license_scan.scan(files.limit(0)).count() == 0
