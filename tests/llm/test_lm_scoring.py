"""Against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from newsflow.llm import lm_scoring as L
from newsflow.llm._arrays import mapped, store


def test_scores_equal_brute_force(spark):
    random.seed(3)
    rows=[(i," ".join(random.choices(["A","b","c","dd","e","f"],k=random.randint(0,12)))) for i in range(60)]+[(100,None),(101,"")]
    df=spark.createDataFrame(rows,"doc_id bigint, text string")
    for order in (2,3):
        m=L.fit(df,order=order,shards=4)
        got={r.doc_id:r for r in L.score(df,m).collect()}
        # brute force
        toks=lambda t: (t or "").lower().split()+["</s>"]
        top=collections.Counter()
        for _,t in rows:
            s=["<s>"]*(order-1)+toks(t)
            for i in range(order-1,len(s)): top[tuple(s[i-order+1:i+1])]+=1
        lv={order:top}
        for n in range(order-1,0,-1):
            lv[n]=collections.Counter(g[1:] for g in lv[n+1])
        def disc(c):
            n=[0]+[sum(v==k for v in c.values()) for k in (1,2,3,4)]
            y=n[1]/(n[1]+2*n[2]) if n[1] else 0
            return [0]+[min(max(k-(k+1)*y*n[k+1]/n[k] if n[k] and y else .5*k,.1),k) for k in (1,2,3)]
        D={n:disc(c) for n,c in lv.items()}
        V=len(lv[1])
        def P(g):
            n=len(g); c=lv[n]
            if n==1:
                T=sum(c.values()); left=sum(D[1][min(v,3)] for v in c.values())/T
                return max(c[g]-D[1][min(c[g],3)],0)/T+left/(V+1)
            ctx=[(k,v) for k,v in c.items() if k[:-1]==g[:-1]]
            if not ctx: return P(g[1:])
            T=sum(v for _,v in ctx)
            return max(c[g]-D[n][min(c[g],3)],0)/T+sum(D[n][min(v,3)] for _,v in ctx)/T*P(g[1:])
        for i,t in rows:
            s=["<s>"]*(order-1)+toks(t)
            e=sum(math.log10(P(tuple(s[j-order+1:j+1]))) for j in range(order-1,len(s)))
            assert abs(e-got[i].score)<1e-9,(i,e,got[i])
        tot=sum(P(("<s>",)*(order-2)+("a",w[0])) for w in lv[1])+P(("<s>",)*(order-2)+("a","zzz")) 
        assert abs(tot - 1) < 1e-9


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], 'doc_id bigint, text string')
    m = L.fit(empty)
    got = L.score(spark.createDataFrame([(1, 'a b'), (2, None)], 'doc_id bigint, text string'), m).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in got)


def test_blocks_are_summed_as_they_come(monkeypatch):
    rng = np.random.default_rng(1)
    grams = [rng.integers(1, 40, (3, n)).astype(np.uint64) for n in (500, 3, 700, 1, 200)]
    monkeypatch.setattr(L, "HOLD", 100)
    blocks = {s: [] for s in range(4)}
    for g in grams:
        for s, block in L._blocks(list(g), [np.ones(g.shape[1], np.uint64)], 4):
            blocks[s].append(block)
    want = collections.Counter(tuple(x) for g in grams for x in g.T.tolist())
    got = {}
    for s, listed in blocks.items():
        key, columns, (counts,) = L._merged(iter(listed), 3, 1)
        assert (np.diff(key.astype(object)) > 0).all() and set((key >> np.uint64(62)).tolist()) <= {s}
        got |= dict(zip(zip(*(c.tolist() for c in columns), strict=True), counts.tolist(), strict=True))
    assert got == want


def test_files_hold_arrays_of_all_widths(tmp_path):
    arrays = {"key": np.arange(5, dtype=np.uint64) << np.uint64(60), "count": L._narrow(np.array([1, 255])), "raw": L._narrow(np.array([256])), "context": np.zeros(0, np.uint8)}
    store(str(tmp_path), "level1-0", arrays)
    got = mapped(str(tmp_path), "level1-0")
    assert {k: (v.dtype, v.tolist()) for k, v in got.items()} == {k: (v.dtype, v.tolist()) for k, v in arrays.items()}
    assert mapped(str(tmp_path), "level9-0") == {}


def test_shards_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_BYTES", 1000)
    df = spark.createDataFrame([(i, "some words of a text " * 5) for i in range(100)], "doc_id bigint, text string").withColumn("a.b", F.lit(1))
    model = L.fit(df)
    assert model.shards == 16 and model.order == 3
    assert L.fit(df.limit(1)).shards == 1
    assert L.score(df, model).where("n_known = n_tokens").count() == 100


def test_every_partition_has_its_slot(spark):
    for n in (1, 2, 64, 211, 1024):
        got = spark.createDataFrame([(int(x),) for x in L.slots(n)], "slot int").select(F.pmod(F.hash("slot"), F.lit(n)).alias("p")).collect()
        assert [r.p for r in got] == list(range(n))
