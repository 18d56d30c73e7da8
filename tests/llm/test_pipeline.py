"""The corpus pipeline: every stage on its predecessor's rows, against brute force."""

import collections
import random
import re

import pytest

import corpus_pipeline as P
from newsflow.llm import quality_classifier
from newsflow.llm._session import bucket_of, written

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


def words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text, SPACE)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def representatives(rows):
    """Least id of every component of texts with a Jaccard similarity of 0.8 or more."""
    sets, above = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if sets[a] == sets[b] or (both and len(sets[a] & sets[b]) / both >= 0.8):
                above[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def cut(rows, passage=51):
    """Texts without the passages of 51 words that occur twice, from the first to the last word of each run."""
    places = {i: [m.span() for m in re.finditer(SPACE, t or "")] for i, t in rows}
    seen = collections.Counter(tuple(t[x:y] for x, y in places[i][p : p + passage]) for i, t in rows for p in range(len(places[i]) - passage + 1))
    out = {}
    for i, t in rows:
        at, covered = places[i], [0] * (len(places[i]) + 1)
        for p in range(len(at) - passage + 1):
            if seen[tuple(t[x:y] for x, y in at[p : p + passage])] > 1:
                covered[p : p + passage] = [1] * passage
        edges = [p for p in range(len(covered)) if covered[p] != (covered[p - 1] if p else 0)]
        left, end = "", 0
        for x, y in zip(edges[::2], edges[1::2], strict=True):
            left, end = left + t[end : at[x][0]], at[y - 1][1]
        out[i] = left + (t or "")[end:]
    return out


def leaked(text, items):
    w = words(text, ALNUM)
    windows = {tuple(w[p : p + n]) for n in {min(10, len(x)) for x in items if x} for p in range(len(w) - n + 1)}
    return any(tuple(x[q : q + min(10, len(x))]) in windows for x in items if x for q in range(len(x) - min(10, len(x)) + 1))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(3)
    vocabulary = [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(random.choices(vocabulary, k=n))
    tiny = " ".join(random.choices("ab c de f é gh".split(), k=60))  # 60 words in fewer than 200 bytes
    passage, short, items = prose(60), prose(45), [(i, prose(14)) for i in range(4)] + [(9, None), (10, "")]
    rows = []
    for i in range(160):
        text = f"{prose(40)} {passage} {prose(40)}" if i % 10 == 1 else f"{prose(40)} {short} {prose(40)}" if i % 10 == 5 else f"{prose(30)} {items[i % 4][1]} {prose(30)}" if i % 10 == 2 else f"{prose(50)} {tiny} {prose(50)}" if i % 10 == 6 else prose(random.randint(40, 90))
        if i % 10 in (3, 4):
            text = "$$$ BUY### now!!! " * random.randint(15, 40)
        rows.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(200 + k, rows[10 * k][1] + (" tail" if k % 2 else ""), None, "s0", None) for k in range(8)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, f"{prose(9000)}", "en", "s2", 1)]
    labels = [(i, int(i % 10 not in (3, 4)), 0) for i in range(160)] + [(None, 1, 0), (5, None, None)]
    folder = "file://" + str(tmp_path_factory.mktemp("pipeline"))
    # Columns that the operators use inside clash with extra ones here.
    extra = spark.createDataFrame([(*r, "x", 7, None, "y", 1, 2, 3) for r in rows], DOCS + ", words string, size int, predicted int, Score string, _id int, _keep int, _bad int")
    extra.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(folder + "/benchmark.parquet")
    return folder, extra, items


def test_stages_equal_brute_force(spark, tables):
    folder, docs, items = tables
    items = [words(t, ALNUM) for _, t in items]
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, folder), "test")
        assert sorted(docs.columns) == sorted(before.columns), name
        assert {tuple(r) for r in docs.select("predicted", "Score", "_id", "_keep", "_bad").collect()} == {(None, "y", 1, 2, 3)}, name
        kept[name] = (texts(before), texts(docs))
        if name == "suffix-array dedup":
            assert all(r.n_chars == len(r.text) for r in docs.where("text is not null").collect())
    before, after = kept["quality classifier"]
    model = quality_classifier.fit(spark.read.parquet(folder + "/documents.parquet").select("doc_id", "text"), spark.read.parquet(folder + "/labels.parquet").where(bucket_of("doc_id", 4) != 2))
    good = quality_classifier.score(spark.read.parquet(folder + "/documents.parquet").select("doc_id", "text"), model).where("predicted = 1")
    assert after == texts(good)
    assert {i for i, _ in before if i < 160 and i % 10 in (3, 4)}.isdisjoint(i for i, _ in after) and {i for i in range(160) if i % 10 not in (3, 4)} <= {i for i, _ in after}
    before, after = kept["n-gram Jaccard join"]
    assert [i for i, _ in after] == representatives(before) and set(after) <= set(before) and len(after) < len(before)
    before, after = kept["suffix-array dedup"]
    want = cut(before)
    assert {i: t or "" for i, t in after} == want
    # Passages of 60 words went everywhere, those of 45 stay.
    assert all((len(want[i]) < len(t)) == (i % 10 in (1, 6)) for i, t in before if i < 160)
    before, after = kept["benchmark decontamination"]
    assert after == [(i, t) for i, t in before if not leaked(t, items)] and len(after) < len(before)
    mixed = P.STAGES[-1][1](spark, docs, folder).collect()
    sizes = {r.doc_id: len(re.findall(SPACE, r.text or "")) for r in docs.collect()}
    taken = collections.Counter()
    for r in mixed:
        assert 0 < r.taken <= 2 * sizes[r.doc_id]
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in mixed)
    assert len({r.doc_id for r in mixed}) == len(mixed)


def test_run_repeats_itself(spark, tables):
    folder, _, _ = tables
    rows = lambda: sorted((r.doc_id, r.taken, r.text) for r in P.run(spark, folder).collect())
    first = rows()
    assert first and first == rows()


def test_empty_tables(spark, tables, tmp_path):
    folder, empty = tables[0], f"file://{tmp_path}"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0
