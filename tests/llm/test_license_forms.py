"""The registered licence scan finds whole licence texts, wrapped headers and notices inside longer lines."""

import random

from newsflow.llm import license_texts, queries

FORMS = {
    1: ("MIT", "Copyright 2024 Example. Released under the MIT License."),
    2: ("MIT", license_texts.HEADERS["MIT"][0]),
    3: ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3"),
    4: ("Apache-2.0", 'x = 1\n\n# Copyright 2024 Example\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n\ny = 2'),
    5: ("BSD-3-Clause", license_texts.HEADERS["BSD-3-Clause"][0]),
    6: ("Apache-2.0", 'Some words before. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. More words after'),
    7: (None, "no terms of any license in this line"),
}


def test_forms_and_directories(spark, tmp_path):
    random.seed(5)
    vocabulary = [f"word{i}" for i in range(500)] + "the of and is to in a software license".split()
    filler = lambda: ". ".join(" ".join(random.choices(vocabulary, k=12)).capitalize() for _ in range(4))
    texts = {n.partition("#")[0]: t for n, t in license_texts.templates().items() if n.endswith("#text")}
    rows = [(i, "en", "s", t) for i, (_, t) in FORMS.items()]
    whole = {1024 + 8 * (k + 1): n for k, n in enumerate(sorted(texts))}
    rows += [(i, "en", "s", "Copyright (c) 2024 Example Corp\n" + texts[n]) for i, n in whole.items()] + [(i + 1, "en", "s", filler()) for i in whole]
    rows += [(5000 + i, "en", "s", filler()) for i in range(3000)] + [(9000, "en", "s", None), (9001, "en", "s", "")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].own for i in FORMS} == {i: n for i, (n, _) in FORMS.items()}
    assert {i: got[i].own for i in whole} == whole
    assert {i: got[i + 1].license for i in whole} == whole and all(got[i + 1].own is None for i in whole)
    assert all(got[i].own is None for i in got if i >= 5000)
