"""Against brute force."""

import collections
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from newsflow.llm import ngram_join as J
from newsflow.llm._session import written


def test_join_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    voc=[f"w{i}" for i in range(300)]
    docs=[];i=0
    for f in range(40):
        base=random.choices(voc,k=random.choice([3,5,30,100,200]))
        for c in range(random.choice([1,1,2,5,30])):
            w=list(base)
            for _ in range(random.randint(0,4)):
                if len(w)>20: w[random.randrange(len(w))]=random.choice(voc)
            docs.append((i," ".join(w).upper() if random.random()<.2 else "\n".join(w))); i+=1
    docs+=[(5000,None),(5001,""),(5002," "),docs[3],docs[3],(None,docs[50][1])]
    def sh(t):
        w=[x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+",t or "")]
        return frozenset(tuple(w[k:k+5]) for k in range(max(1,len(w)-4))) if w else frozenset()
    def brute(docs):
        S=[sh(t) for _,t in docs]; n=len(docs); par=list(range(n)); links=[0]*n
        def find(x):
            while par[x]!=x: x=par[x]
            return x
        for a in range(n):
            for b in range(a):
                u=len(S[a]|S[b])
                if S[a]==S[b] or (u and len(S[a]&S[b])/u>=.8):
                    links[a]+=1; links[b]+=1; par[find(a)]=find(b)
        key=lambda d: -1 if d is None else d
        cls={}
        for k in range(n): cls.setdefault(find(k),[]).append(docs[k][0])
        m={r:min(v,key=key) for r,v in cls.items()}
        return sorted(((docs[k][0],m[find(k)],links[k],len(cls[find(k)])) for k in range(n)),key=str)
    df=spark.createDataFrame(docs,"doc_id bigint,text string")
    exp=brute(docs)
    for bl in (1024,7):
        monkeypatch.setattr(J, 'BLOCK', bl)
        got=sorted(((r.doc_id,r.class_id,r.n_links,r.class_size) for r in J.join(df).collect()),key=str)
        assert got==exp,[(a,b) for a,b in zip(got,exp) if a!=b][:5]
    assert J.deduplicate(df).count() == len({e[1] for e in exp})
    assert J.join(df.limit(0)).count() == 0


def test_long_chain_costs_in_proportion(spark, monkeypatch):
    """Texts that slide along a book by two words: each is like its three neighbours on both sides, all are one class."""
    random.seed(6)
    book = [f"w{random.randrange(10**6)}" for _ in range(3000)]
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = {}
    for n in (300, 1200):
        df = spark.createDataFrame([(i, " ".join(book[2 * i : 2 * i + 60])) for i in range(n)], "doc_id bigint, text string")
        seen = []
        monkeypatch.setattr(J, "written", lambda d, tag: seen.append(written(d, tag).count()) or written(d, tag) if tag == "join-tasks" else written(d, tag))
        got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in J.join(df).collect()}
        assert got == {i: (0, min(i, 3) + min(n - 1 - i, 3), n) for i in range(n)}
        rows[n] = seen[0]
    assert rows[1200] < 6 * rows[300]


def test_large_dense_family_and_odd_columns(spark, monkeypatch):
    random.seed(7)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        w[random.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(random.choices(base, k=40))) for i in range(30)]
    monkeypatch.setattr(J, "BLOCK", 20)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("a.b", F.lit(1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(df).collect()}
    assert got == {i: (0, 149) if i < 150 else (i, 0) for i, _ in rows}
    kept = J.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == 31
