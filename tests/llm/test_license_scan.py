"""Against brute force: dictionaries of terms and a walk up the directories."""

import math
import random
import re
from collections import Counter

import pytest

from newsflow.llm import license_scan as L

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text):
    return Counter(re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def brute(files, least=L.LEAST):
    templates = {n: terms(t) for n, t in sorted(L.TEMPLATES.items())}
    known = set().union(*templates.values())
    units = {k: [terms(u) for u in ([*t.split("\n"), t] if "\n" in t else [t])] for k, t in enumerate(t or "" for _, _, t in files)}
    n = sum(map(len, units.values()))
    seen = Counter(w for us in units.values() for u in us for w in u)
    idf = lambda w: math.log((1 + n) / (1 + (seen[w] if w in known else 0))) + 1
    vector = lambda c: {w: k * idf(w) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    weights = {name: vector(c) for name, c in templates.items()}

    def best(us):
        top = (0.0, None)
        for u in map(vector, us):
            for name, v in weights.items():
                dot = sum(x * v.get(w, 0) for w, x in u.items())
                cosine = round(dot / norm(u) / norm(v), 9) if dot else 0.0
                top = max(top, (cosine, name), key=lambda x: x[0])
        return top

    found = [best(units[k]) for k in range(len(files))]
    own = [name if cosine >= least else None for cosine, name in found]
    granted = {}
    for (_, path, _), (cosine, _), name in zip(files, found, own, strict=True):
        if path and name and re.match(L.LICENSE_FILES, path.rpartition("/")[2]):
            directory, _, leaf = path.rpartition("/")
            granted.setdefault(directory, []).append((-cosine, leaf, name))
    out = []
    for (i, path, _), (cosine, _), name in zip(files, found, own, strict=True):
        held = origin = None
        if name is None and path is not None:
            parts = path.split("/")[:-1]
            for k in range(len(parts), -1, -1):
                if "/".join(parts[:k]) in granted:
                    origin = "/".join(parts[:k])
                    held = min(granted[origin])[2]
                    break
        out.append((i, path, name, round(cosine, 6), name or held, origin))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_brute_force(spark, seed):
    random.seed(seed)
    names = list(L.TEMPLATES)
    files = []
    for i in range(250):
        line = L.TEMPLATES[random.choice(names)].split()
        for _ in range(random.choice([0, 0, 1, 3, 8])):
            line[random.randrange(len(line))] = random.choice(["copy", "THE", "é1", "licence"])
        text = "\n".join(random.sample([" ".join(line), "some code here", "", "license of the thing"], random.randint(1, 4))) if i % 3 else "plain words only"
        folder = "/".join(random.choices("abc", k=random.randint(0, 4)))
        path = (folder + "/" if folder else "") + (random.choice(["LICENSE", "COPYING.md", "licence-x"]) if i % 4 == 0 else f"f{i % 90}.txt")
        files.append((i, path, text))
    files += [(900, None, None), (901, "a/b", ""), (902, "a/b/c", "word " * 20000), files[1], files[4], (None, "a/z", L.TEMPLATES[names[0]]), (903, "", "x")]
    got = L.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.path, r.own, round(r.cosine, 6), r.license, r.from_dir) for r in got))) == sorted(map(str, brute(files)))
