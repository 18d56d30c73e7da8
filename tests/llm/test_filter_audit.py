"""The audit against a plain loop over all documents and orders."""

import itertools
import random
import re

from newsflow.llm import filter_audit

DOCS = "doc_id bigint, text string, source string, part string, mask int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        seen.append((source or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {s[0] for s in seen}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [s for s in seen if s[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [s for s in left if s[1][f]]
                left = [s for s in left if not s[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
                out[part, order, step] = (len(left), len(hit), sum(s[1][f] for s in gone), sum(s[0] == part and s[1][f] and sum(s[1].values()) == 1 for s in seen), sum(s[2] for s in hit), sum(s[3] for s in hit))
                gone += hit
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_a_loop_over_all_orders(spark):
    rng = random.Random(5)
    texts = [None, "", "x", "# " * 300, "ABC def " * 150] + [" ".join(rng.choice(["w%d" % rng.randrange(k), "Up", "$"][: rng.choice([1, 2, 3])]) for _ in range(rng.choice([150, 199, 200, 260]))) for k in (20, 90, 300, 1000) for _ in range(4)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(150)]
    rows += [rows[3], rows[3], (None, "x", "a"), (None, "x", "a"), (7, "x", None), (7, "y", "b"), (1000, "long " * 50000, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "p", 9) for r in rows], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame([(*r, "q") for r in labels], LABELS))
    assert {tuple(r) for r in got.collect()} == brute(rows, labels)
    assert got.count() == 3 * 600


def test_other_column_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "`i.d` bigint, `t.t` string, `s.s` string")
    labels = spark.createDataFrame([], LABELS)
    how = {"text": "t.t", "doc_id": "i.d", "source": "s.s"}
    rows = filter_audit.audit(docs, labels, **how).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed) for r in rows] == [("", 0, 1)] + [("", 0, 0)] * 4
    assert filter_audit.audit(docs.limit(0), labels, **how).count() == 0
