"""Licences of files by sparse TF-IDF cosine to templates, and by inheritance from the nearest licensed ancestor directory.

Units are the lines of a text and the text as a whole: headers match as lines, licence files as a whole. With passages=True (the
registered query) paragraphs of several lines and sentences are units too: a paragraph ends at a line without words, a sentence
at [.!?] before a capital A-Z, and comment signs between them are passed over. Of the units that reach `least`, the one of most
words then decides, and frequencies are still those over lines and whole texts. Terms are words of
letters and digits, A-Z lowered. Document frequencies are counted over all units of the corpus. With frequencies="corpus" (the
registered query) those of all terms are: terms of two units and more are kept as sorted shards in the shared folder that the match
tasks map, any other term of a unit has the frequency 1, and cosines do not depend on the size of the corpus. With
frequencies="templates" only the templates' terms are counted; any other term has the frequency 0 and the largest weight, which
grows with the corpus. What is collected is one row per template term.
A unit's best template counts from `least` on. Files without a match inherit from the deepest ancestor directory for which a
licence file was matched: a file's ancestors (as many as its path has parts) are joined with those directories by path.

Defined cases: null and empty texts have no match; a null path has no directory and inherits nothing; of equal cosines the first
template by name wins; of two licence files in one directory the best cosine, then the first name; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._arrays import mapped, store
from ._session import quoted, shared_dir, small_batches, written

U = np.uint64
#: Regular expressions (RE2) of the end of a paragraph and of a sentence.
PARAGRAPH = r"\n([^0-9A-Za-z\x{80}-\x{10FFFF}\n]*\n)+"
SENTENCE = r"[.!?][\"')]*\s[\s*#/;%>\"'(-]*([A-Z])"
LEAST = 0.8
#: File names that license their directory.
LICENSE_FILES = r"(?i)^(licen[cs]e|copying)([.-].*)?$"
#: Usual header sentences by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


class _Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        h, b = T.words(pa.array([templates[n] for n in self.names]), T.ALNUM)
        self.terms = np.unique(h)
        self.counts = np.zeros((len(self.terms), len(self.names)))
        np.add.at(self.counts, (np.searchsorted(self.terms, h), np.repeat(np.arange(len(self.names)), np.diff(b))), 1)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return at, self.terms[at] == h


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines of all texts, then the texts of several lines; the text of each unit."""
    texts = texts.fill_null("") if texts.null_count else texts
    lines = pc.split_pattern(texts, "\n")
    of = pc.list_parent_indices(lines).to_numpy()
    several = np.flatnonzero(np.bincount(of, minlength=len(texts)) > 1)
    flat = pc.list_flatten(lines).cast(pa.large_string())
    return pa.concat_arrays([flat, texts.cast(pa.large_string()).take(pa.array(several))]), np.concatenate((of, several))


def _passages(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Paragraphs of several lines (but not whole texts), then the sentences of paragraphs that have several; the text of each."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    split = pc.split_pattern_regex(texts, PARAGRAPH)
    of, paragraphs = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    inner = np.bincount(of, minlength=len(texts))[of] > 1
    inner &= pc.match_substring(paragraphs, "\n").to_numpy(zero_copy_only=False)
    marked = pc.split_pattern(pc.replace_substring_regex(paragraphs, SENTENCE, "\x00\\1"), "\x00")
    parent, sentences = pc.list_parent_indices(marked).to_numpy(), pc.list_flatten(marked)
    several = np.bincount(parent, minlength=len(paragraphs))[parent] > 1
    return pa.concat_arrays([paragraphs.filter(pa.array(inner)), sentences.filter(pa.array(several))]), np.concatenate((of[inner], of[parent][several]))


def _terms(units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, term, occurrences), one row for each distinct term of a unit."""
    h, b = T.words(units, T.ALNUM)
    unit = np.repeat(np.arange(len(b) - 1), np.diff(b))
    order = np.lexsort((h, unit))
    h, unit = h[order], unit[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])))) if len(h) else np.zeros(0, np.int64)
    return unit[first], h[first], np.diff(np.concatenate((first, [len(h)])))


def _frequency_task(t: _Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(len(t.terms), np.int64)
        for batch in batches:
            for part in T.slices(batch, "text"):
                units, _ = _units(part.column("text"))
                n += len(units)
                _, term, _ = _terms(units)
                at, hit = t.known(term)
                seen += np.bincount(at[hit], minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(seen))], pa.int32()), pa.array([n, *seen.tolist()], pa.int64())], ["term", "n"])

    return run


def _term_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, units that have it) of each slice of texts; the null term has the number of units."""
    for batch in batches:
        for part in T.slices(batch, "text"):
            units, _ = _units(part.column("text"))
            term, n = np.unique(_terms(units)[1], return_counts=True)
            terms = pa.concat_arrays([pa.array([None], pa.int64()), pa.array(term.view(np.int64))])
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.concatenate(([len(units)], n)), pa.int64())], ["term", "n"])


class _Frequencies:
    """Frequencies of the terms of two units and more, in shards of the terms' top bits; a term that is in no shard has 1."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards, self.open = path, shards, {}
        self.sizes: dict[int, int] = {}

    def store(self, key: tuple, rows: pa.Table) -> pa.Table:
        term, n = rows.column("term").to_numpy().view(U), rows.column("n").to_numpy()
        order = np.argsort(term)
        store(self.path, f"terms-{key[0].as_py()}", {"term": term[order], "n": n[order]})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(term)], pa.int64())})

    def get(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self.open:
            held = mapped(self.path, f"terms-{shard}")
            if len(held.get("term", ())) != self.sizes.get(shard, 0):
                raise FileNotFoundError(f"shard {shard} of the frequencies in {self.path} has {len(held.get('term', ()))} of its {self.sizes.get(shard, 0)} terms")
            self.open[shard] = held.get("term", np.zeros(0, U)), held.get("n", np.zeros(0, np.int64))
        return self.open[shard]

    def of(self, h: np.ndarray) -> np.ndarray:
        unique, inverse = np.unique(h, return_inverse=True)
        out = np.ones(len(unique))
        cut = np.searchsorted(unique >> U(65 - self.shards.bit_length()), np.arange(self.shards + 1).astype(U))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(int(cut[s]), int(cut[s + 1]))
            term, n = self.get(s)
            if len(term):
                at = np.minimum(np.searchsorted(term, unique[part]), len(term) - 1)
                out[part] = np.where(term[at] == unique[part], n[at], 1)
        return out[inverse]


def _corpus_frequencies(texts: DataFrame, t: _Templates) -> tuple[int, np.ndarray, _Frequencies]:
    """The number of units, the frequencies of the templates' terms and those of all terms."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(4096, 1 << max(1, (parts - 1).bit_length()))
    counted = written(texts.select("text").mapInArrow(_term_task, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "license-terms")
    kept = _Frequencies(shared_dir(spark, "license-frequencies"), shards)
    sharded = counted.where("term is not null and n > 1").withColumn("shard", F.shiftrightunsigned("term", 65 - shards.bit_length()))
    stored = written(sharded.groupBy("shard").applyInArrow(lambda key, rows: kept.store(key, rows), "shard int, n bigint"), "license-shards")
    kept.sizes = {r["shard"]: r["n"] for r in stored.collect()}  # 4,096 shards at most
    mine = t.terms.view(np.int64).tolist()
    got = {r["term"]: r["n"] for r in counted.where(F.col("term").isNull() | F.col("term").isin(mine)).collect()}
    return got.get(None, 0), np.array([got.get(i, 0) for i in mine], float), kept


def _match_task(t: _Templates, idf: np.ndarray, unknown: Callable[[np.ndarray], np.ndarray], least: float, passages: bool):
    weights = t.counts * idf[:, None]
    weights = weights / np.sqrt((weights**2).sum(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", (2 if passages else 4) << 20):
                units, of = _units(part.column("text"))
                if passages:
                    more, owners = _passages(part.column("text"))
                    units, of = pa.concat_arrays([units, more]), np.concatenate((of, owners))
                unit, term, tf = _terms(units)
                at, hit = t.known(term)
                near = np.zeros(len(units), bool)
                near[unit[hit]] = True
                far = near[unit] & ~hit
                weight = np.where(hit, idf[at], 0.0)
                weight[far] = unknown(term[far])
                value = tf * weight
                norm = np.sqrt(np.bincount(unit, value**2, minlength=len(units)))
                use = np.flatnonzero(near)
                row, at, value = np.searchsorted(use, unit[hit]), at[hit], value[hit]
                dots = np.zeros((len(use), len(t.names)))
                for k in range(len(t.names)):
                    dots[:, k] = np.bincount(row, value * weights[at, k], minlength=len(use))
                cosine = dots / norm[use][:, None] if len(use) else dots
                best = cosine.argmax(axis=1) if len(use) else np.zeros(0, np.int64)
                top = np.round(cosine[np.arange(len(use)), best], 12)
                owner = of[use]
                size = np.where(top >= least, np.bincount(unit, tf, minlength=len(units))[use], 0) if passages else np.zeros(len(use))
                order = np.lexsort((best, -top, -size, owner))
                first = order[np.unique(owner[order], return_index=True)[1]]
                name: list[str | None] = [None] * part.num_rows
                score = [0.0] * part.num_rows
                for i in first.tolist():
                    score[owner[i]] = float(top[i])
                    if top[i] >= least:
                        name[owner[i]] = t.names[best[i]].partition("#")[0]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(name, pa.string()), pa.array(score)], ["row", "own", "cosine"])

    return run


def match(files: DataFrame, text: str, row: Column, templates: dict[str, str] | None = None, least: float = LEAST, frequencies: str = "templates", passages: bool = False) -> DataFrame:
    """row, own (the template that the text matches, or null) and cosine (of its best unit), for every row of files."""
    if frequencies not in ("templates", "corpus"):
        raise ValueError("frequencies are those of the templates' terms or of the corpus")
    small_batches(files.sparkSession)
    t = _Templates(templates or TEMPLATES)
    texts = files.select(row.alias("row"), F.col(quoted(text)).alias("text"))
    if frequencies == "corpus":
        n, seen, kept = _corpus_frequencies(texts, t)
        unknown = lambda h: np.log((1 + n) / (1 + kept.of(h))) + 1
    else:
        counted = texts.select("text").mapInArrow(_frequency_task(t), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        got = {r["term"]: r["n"] for r in counted}
        n, seen = got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(t.terms))], float)
        unknown = lambda h: np.full(len(h), np.log(1 + n) + 1)
    idf = np.log((1 + n) / (1 + seen)) + 1
    kind = texts.schema["row"].dataType.simpleString()
    return texts.mapInArrow(_match_task(t, idf, unknown, least, passages), f"row {kind}, own string, cosine double")


def scan(files: DataFrame, path: str = "path", text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None, least: float = LEAST, frequencies: str = "templates", passages: bool = False) -> DataFrame:
    """Per row: doc_id (ids are whole numbers), path, own licence and its cosine, the licence that holds for it, and the directory it comes from."""
    found = written(match(files, text, F.struct(F.col(quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(quoted(path)).alias("path")), templates, least, frequencies, passages).select("row.doc_id", "row.path", "own", "cosine"), "license-own")
    parts = F.split("path", "/", -1)
    name, directory = F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    granted = found.where(F.col("own").isNotNull() & name.rlike(LICENSE_FILES)).groupBy(directory.alias("dir"))
    granted = granted.agg(F.min(F.struct(-F.col("cosine"), name, "own")).alias("best")).select("dir", F.col("best.own").alias("license"))
    open_ = found.where("own is null and path is not null").select("path").distinct()
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    near = open_.select("path", F.posexplode(up).alias("depth", "dir")).join(granted, "dir").groupBy("path").agg(F.max_by("license", "depth").alias("inherited"), F.max_by("dir", "depth").alias("from_dir"))
    out = found.join(near.withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & F.col("own").isNull(), "left")
    return out.select("doc_id", "path", "own", "cosine", F.coalesce("own", "inherited").alias("license"), "from_dir")
