"""The licence scan with document frequencies of all terms."""

import math
from collections import Counter

import pytest

from newsflow.llm import license_scan as L
from newsflow.llm import queries
from tests.llm.test_license_scan import terms

LINES = ["Released under the MIT License by Example.", "by Example we trade", "unique zebra under the bridge", "Released under the MIT License.", "nothing here"]


def test_cosines_do_not_depend_on_the_size(spark):
    def found(times):
        rows = [(i, f"f{i}", LINES[i % len(LINES)]) for i in range(times * len(LINES))]
        got = L.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string"), frequencies="corpus").where("doc_id < 5").orderBy("doc_id").collect()
        n = len(rows)
        seen = Counter(w for _, _, t in rows for w in terms(t))
        vector = lambda t: {w: k * (math.log((1 + n) / (1 + seen[w])) + 1) for w, k in terms(t).items()}
        cosine = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        want = [max(cosine(vector(t), vector(x)) for x in L.TEMPLATES.values()) for t in LINES]
        assert [r.cosine for r in got] == pytest.approx(want, abs=1e-9)
        return [r.cosine for r in got]

    assert found(400)[0] == pytest.approx(found(40)[0], abs=0.02)


def test_query_counts_all_terms(spark, tmp_path):
    rows = [(i, "en", "s", LINES[i % len(LINES)]) for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = queries.op9_license_scan(spark, str(tmp_path)).where("doc_id = 5").first()
    kept = L.scan(spark.createDataFrame([(i, str(i), t) for i, _, _, t in rows], "doc_id bigint, path string, text string"), frequencies="corpus").where("doc_id = 5").first()
    assert first.cosine == kept.cosine and first.own == kept.own
