"""Against brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from newsflow.llm import suffix_dedup as D


def covered(texts, least):
    """Per text the bytes that repeated strings of `least` bytes cover."""
    seen = collections.Counter(b[p : p + least] for b in texts for p in range(len(b) - least + 1))
    out = []
    for b in texts:
        cov = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                cov[p : p + least] = b"\1" * least
        out.append(cov)
    return out


def runs(cov):
    edges = [i for i in range(len(cov) + 1) if (i < len(cov) and cov[i]) != (i > 0 and cov[i - 1] == 1)]
    return list(zip(edges[::2], edges[1::2], strict=True))


def corpus(seed, scale=1):
    random.seed(seed)
    rnd = lambda n: "".join(random.choices("abé\x00 ", k=int(n * scale)))
    passages = [rnd(random.randint(30, 90)) for _ in range(6)]
    docs = []
    for i in range(150):
        t = rnd(random.randint(0, 60))
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            t += p[random.randint(0, len(p) // 3) :] + rnd(random.randint(0, 50))
            if random.random() < 0.2:
                t += p + "x" + p
        docs.append((i, t))
    return docs + [(900, None), (901, ""), (902, "a" * int(300 * scale)), (903, "ab" * int(100 * scale)), docs[5], docs[5], (904, docs[7][1]), (None, docs[8][1])]


@pytest.mark.parametrize("seed,least,k,fine,piece,shard,group", [(1, 40, 8, None, 1 << 20, 40000, 100000), (2, 40, 8, 25, 300, 50, 100000), (3, 400, 32, 256, 1 << 20, 40000, 100000), (4, 40, 8, 20, 1 << 20, 100, 3), (5, 40, 8, 25, 1 << 20, 100, 100000)])
def test_report_equals_brute_force(spark, monkeypatch, seed, least, k, fine, piece, shard, group):
    monkeypatch.setattr(D, "PIECE", piece)
    monkeypatch.setattr(D, "SHARD", shard)
    docs = corpus(seed, least / 40)
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (i, _), b, coarse, short in zip(docs, texts, covered(texts, least), covered(texts, fine or least), strict=True):
        kept = bytes(x for x, c in zip(b, coarse, strict=True) if not c)
        words = [n for n in (len(b[x:y].split()) for x, y in runs(short)) if n >= 9]
        want.append((i, len(b), sum(coarse), len(runs(coarse)), hashlib.sha256(kept).hexdigest(), len(words), sum(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    how = {"least": least, "k": k, "often": 3 if seed > 2 else 500}
    got = [tuple(r) for r in D.report(df, group=group, fine=fine, words=9, **how).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("words", [0, 6])
def test_deduplicate_cuts_runs_and_keeps_odd_columns(spark, words):
    docs = corpus(6)
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (i, t), b, cov in zip(docs, texts, covered(texts, 25), strict=True):
        cut = [(x, y) for x, y in runs(cov) if len(b[x:y].split()) >= words]
        rest = b"".join(b[y:x] for y, x in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(b)], strict=True))
        want.append((str(i), None if t is None else rest.decode("utf-8", "ignore"), 1, "x"))
    df = spark.createDataFrame([(str(i), t) for i, t in docs], "doc_id string, text string").withColumn("spans", F.lit(1)).withColumn("a.b", F.lit("x"))
    got = D.deduplicate(df, least=25, k=8, words=words)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_groups_are_the_maximal_repeats(spark):
    docs = corpus(7)[:60] + corpus(7)[150:]
    least, k = 30, 8
    texts = [(t or "").encode() for _, t in docs]
    places = collections.defaultdict(list)
    for d, b in enumerate(texts):
        for p in range(len(b)):
            for n in range(least, min(len(b) - p, 3 * least) + 1):
                places[b[p : p + n]].append((d, p))
    want = {}
    for s, at in places.items():
        if len(at) < 2 or len(s) == 3 * least:
            continue
        before = {texts[d][p - 1] if p else f"start{d}" for d, p in at}
        after = {texts[d][p + len(s)] if p + len(s) < len(texts[d]) else f"end{d}" for d, p in at}
        if len(before) > 1 and len(after) > 1:
            want[s] = sorted((str(docs[d][0]), p) for d, p in at)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got, is_open = collections.defaultdict(list), {}
    by_id = {i: b for (i, _), b in zip(docs, texts, strict=True)}
    for r in D.maximal_repeats(df, least=least, k=k).collect():
        s = by_id[r.doc_id][r.first : r.first + r.n_bytes]
        got[s].append((str(r.doc_id), r.first))
        is_open[s] = r.open
    for s in got:
        if len(s) > 3 * least:  # longer than what was counted above
            places[s] = [(d, p) for d, b in enumerate(texts) for p in range(len(b)) if b.startswith(s, p)]
        assert sorted(got[s]) == sorted((str(docs[d][0]), p) for d, p in places[s]), s  # all occurrences, none twice
        assert is_open[s] or s in want or len(s) >= 3 * least, s
    # What fits into the context of one of its anchors is found as it is.
    fits = [s for s in want if any(a <= least - k and len(s) - a <= least for a in D._own_anchors(s, least, k))]
    assert set(fits) <= set(got) and len(fits) > 50
    # Every byte that repeats is part of a group.
    cover = [bytearray(len(b)) for b in texts]
    for s in got:
        for d, p in places[s]:
            cover[d][p : p + len(s)] = b"\1" * len(s)
    assert cover == covered(texts, least)
    assert D.maximal_repeats(df.limit(0), least=least, k=k).count() == 0


@pytest.mark.parametrize("seed,words,group", [(1, 51, 100_000), (2, 6, 100_000), (3, 6, 3)])
def test_passages_of_short_words(spark, seed, words, group):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(["a", "b", "é", "I", "to", "of", "zz"]) for _ in range(n)]
    passages = [prose(words + rng.randrange(-2, 4)) for _ in range(5)]
    docs = [(i, rng.choice([" ", "\n", "  "]).join(prose(rng.randrange(40)) + rng.choice(passages) + prose(rng.randrange(40)))) for i in range(80)]
    docs += [(200, "a " * 3 * words), (201, "b"), (202, None), (203, ""), docs[3], (None, docs[4][1])]
    split = [(t or "").split() for _, t in docs]
    seen = collections.Counter(tuple(w[p : p + words]) for w in split for p in range(len(w) - words + 1))
    want = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {q for p in range(len(w) - words + 1) if seen[tuple(w[p : p + words])] > 1 for q in range(p, p + words)}
        want.append((i, [x for q, x in enumerate(w) if q not in gone]))
    got = D.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), passage=words, group=group, often=3)
    assert sorted(((r.doc_id, (r.text or "").split()) for r in got.collect()), key=str) == sorted(want, key=str)


def all_maximal_repeats(texts, least):
    """String -> occurrences, of all lengths, from a plain suffix array of all texts."""
    places = sorted(((d, p) for d, b in enumerate(texts) for p in range(len(b) - least + 1)), key=lambda x: texts[x[0]][x[1] :])

    def common(x, y):
        a, b = texts[x[0]][x[1] :], texts[y[0]][y[1] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    lcp = [0, *(common(x, y) for x, y in zip(places, places[1:], strict=False))]
    out = {}
    for depth, lo, hi in D.lcp_intervals(lcp):
        if depth >= least:
            at = places[lo : hi + 1]
            if len({texts[d][p - 1] if p else f"start{d}" for d, p in at}) > 1:
                out[texts[at[0][0]][at[0][1] : at[0][1] + depth]] = sorted(at)
    return out


@pytest.mark.parametrize("nested", [False, True])
def test_groups_of_any_length(spark, nested):
    rng = random.Random(1)
    least, k = 40, 8
    rnd = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    long, other, period = rnd(700), rnd(230), "ab" * 120
    docs = [(0, rnd(30) + long + rnd(20)), (1, rnd(50) + long + rnd(90)), (2, long[100:400] + rnd(40)), (3, other), (4, rnd(20) + other + "x" + other), (5, period), (6, "q" + period + rnd(10)), (7, rnd(60)), (8, long), (9, None), (10, rnd(15) + other[:60])]
    docs = docs if nested else [(i, t) for i, t in docs if i not in (2, 10)]
    texts = [(t or "").encode() for _, t in docs]
    by_id = {i: b for (i, _), b in zip(docs, texts, strict=True)}
    got, is_open = collections.defaultdict(list), {}
    for r in D.maximal_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), least=least, k=k).collect():
        s = by_id[r.doc_id][r.first : r.first + r.n_bytes]
        got[s].append(([i for i, _ in docs].index(r.doc_id), r.first))
        is_open[s] = r.open
    want = all_maximal_repeats(texts, least)
    plain = lambda s: b"abababab" not in s
    if nested:  # a part of the long string occurs elsewhere too: around it the long one stays in parts, which say that they are open
        assert all(is_open[s] for s in got if plain(s) and s not in want) and all(sorted(got[s]) == want[s] for s in got if s in want)
    else:
        assert {s: sorted(at) for s, at in got.items() if plain(s)} == {s: at for s, at in want.items() if plain(s)}
        assert sorted(got[long.encode()]) == want[long.encode()] and len(want[long.encode()]) == 3
    # In a long period every length repeats; what is found there covers the same bytes.
    cover = [bytearray(len(b)) for b in texts]
    for s, at in got.items():
        for d, p in at:
            cover[d][p : p + len(s)] = b"\1" * len(s)
    assert cover == covered(texts, least)


def test_one_group_for_a_string_of_2399_bytes(spark):
    s = "".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz ", k=2399))
    rows = D.maximal_repeats(spark.createDataFrame([(1, "x" + s + "y"), (2, s + "z")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.first, r.n_bytes) for r in rows) == [(1, 1, 2399), (2, 0, 2399)] and len({r.group for r in rows}) == 1
