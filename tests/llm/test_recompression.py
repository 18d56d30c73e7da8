"""Repeated windows against a plain search for all of them, and the property that the anchors rest on."""

import hashlib
import random
import re

import numpy as np
import pytest

from newsflow.llm import recompression as R

DOCS = "doc_id bigint, text string, kept string, spans int"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "—", "A"] + [f"w{i}" for i in range(40)]
    prose = lambda n, k=45: [rng.choice(vocabulary[:k]) for _ in range(n)]
    passages = [prose(rng.choice([window - 1, window, window + 1, 2 * window, 5 * window])) for _ in range(8)] + [["a"] * 3 * window, ["a", "b"] * 2 * window, prose(window, 2)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += prose(rng.randrange(0, 2 * window), rng.choice([1, 2, 45, 45])) + rng.choice(passages)
        rows.append((i * 3 - 20, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500 + i, rows[i % 7][1]) for i in range(20)] + [rows[5], rows[5], (rows[6][0], rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (900, None), (901, ""), (902, " \n"), (903, "a " * window), (904, "b " * 5000)]
    near = rows[0][1].split()
    for i in range(30):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "edit"
        rows.append((2000 + i, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 12), (3, 1)])
def test_equals_brute_force(spark, seed, window, monkeypatch):
    rows = corpus(seed, window)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    got = R.deduplicate(df, window)
    assert got.columns == ["doc_id", "text", "spans", "n_words", "n_removed", "kept"]
    found = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()), key=str)
    assert found == brute(rows, window)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 30, 400).astype(np.uint64)
    for cut in range(40):
        a = np.concatenate((rng.integers(0, 3, cut).astype(np.uint64), shared, rng.integers(0, 3, 60).astype(np.uint64)))
        b = np.concatenate((shared, rng.integers(0, 3, cut).astype(np.uint64)))
        names = []
        for words, at in ((a, cut), (b, 0)):
            all_levels, _, starts, _ = R.levels(words, np.array([0, len(words)]), 50)
            name, where = R.anchors(all_levels, starts, 50)
            i = np.flatnonzero((starts >= at + 1) & (starts <= at + 1 + 350))
            names.append((name[i], where[i] - starts[i]))
        assert (names[0][0] == names[1][0]).all() and (names[0][1] == names[1][1]).all()


def test_symbols_grow_and_levels_shrink():
    words = np.random.default_rng(1).integers(0, 1 << 60, 100_000).astype(np.uint64)
    all_levels, _, starts, _ = R.levels(words, np.array([0, len(words)]), 50)
    sizes = [len(level[0]) for level in all_levels]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] / 8
    _, where = R.anchors(all_levels, starts, 50)
    assert 1 + np.count_nonzero(np.diff(where)) < len(starts) / 4


def test_empty_table_and_other_names(spark):
    df = spark.createDataFrame([(1, "a b")], "`i.d` bigint, `t.t` string")
    got = R.deduplicate(df, 2, text="t.t", doc_id="i.d")
    assert got.columns == ["i.d", "t.t", "n_words", "n_removed", "kept"]
    assert [tuple(r) for r in got.collect()] == [(1, "a b", 2, 0, "a b")]
    assert R.deduplicate(df.limit(0), 2, text="t.t", doc_id="i.d").count() == 0
