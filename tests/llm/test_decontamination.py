"""Against brute force."""

import collections
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from newsflow.llm import decontamination as D


def test_report_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    al=["a","b","C","d9","é"]
    items=[(i," ".join(random.choices(al,k=random.choice([0,1,3,9,10,11,14,30])))) for i in range(30)]+[(99,None)]
    docs=[]
    for i in range(300):
        w=random.choices(al,k=random.randint(0,60))
        if random.random()<.5: 
            it=random.choice(items)[1] or ""; w=w+it.split()[:random.randint(5,30)]+w
        docs.append((i,", ".join(w)))
    docs+=[(500,None),(501,"")]+docs[:3]
    dd=spark.createDataFrame(docs,"doc_id bigint,text string"); bb=spark.createDataFrame(items,"item_id bigint,text string")
    W=lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",re.sub('[A-Z]',lambda m:m[0].lower(),t or ""))
    def brute(t):
        w=W(t); hit=set(); its=set(); 
        for i,x in items:
            x=W(x)
            if not x: continue
            k=min(10,len(x))
            for q in range(len(x)-k+1):
                for p in range(len(w)-k+1):
                    if w[p:p+k]==x[q:q+k]: hit|=set(range(p,p+k)); its.add(str(i))
        return len(w),len(hit),len(its),hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(),bool(hit)
    exp=sorted((i,)+brute(t) for i,t in docs)
    for bs,sw in ((64<<20,10**6),(500,300)):
        monkeypatch.setattr(D, 'BLOCK_BYTES', bs); monkeypatch.setattr(D, 'SHARD_WORDS', sw)
        got=sorted(tuple(r)[:6] for r in D.report(dd,bb).collect())
        assert got==exp,[ (a,b) for a,b in zip(got,exp) if a!=b][:3]
    assert D.remove(dd, bb).count() == sum(not e[5] for e in exp)
