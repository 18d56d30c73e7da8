"""Repeated word windows across documents, found by recompression.

1. Names. Words are the symbols of level 0. Rounds rewrite all texts: a run of one symbol becomes one symbol (RUN_ROUNDS), and every
   symbol is a left or a right one by a bit of its name, drawn anew each round; a left one followed by a right one becomes one symbol.
   A name is a 64-bit hash of what it stands for, so it is global: all tasks name equal runs and pairs alike, in the same round,
   without a dictionary that has to be exchanged or held.
2. Interior symbols. Each symbol carries the interval of words that its making depended on. Where two texts agree on that interval, both
   have the symbol, at the same place. The anchor of a window is the first of its highest symbols whose interval lies inside the window:
   equal windows have equal anchors, whatever stands around them (words at least are always there).
3. Shared symbols. Neighbouring windows with anchors of one name are one row: anchor, hash of their whole context, document, place. A symbol that
   has one context in one document, as almost all text has, repeats nothing and goes. A context that a smaller document has too is
   repeated as a whole. What is left are symbols with different contexts; of each context the smallest document stands for all.
4. Verification. Only for those the single windows are hashed (128 bits), and the smallest document of each is found.

Rows of one task that repeat a context or window of a smaller document of the task are settled there: a key has one row a chunk of CHUNK words
before anything is shuffled, however many copies there are. Pairs are never formed.

Defined cases: null and empty texts have no words; a text shorter than a window keeps all; rows without an id neither lose words nor
take any from others; rows of one id, equal or not, do not take words from each other; windows are judged on the input; an empty table
gives an empty result. Ids are whole numbers. Other columns stay as they are, under any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._session import forget, quoted, small_batches, written

U = np.uint64
WINDOW = 50
#: Rounds of pairs, and those of them that a round of runs precedes.
ROUNDS, RUN_ROUNDS = 8, (0, 3)
#: Share of a window that the making of its anchor may have depended on: the less, the more windows have one anchor; the more, the rarer it is.
DEPENDENCE = 0.6
#: Words that a task settles together before it hands rows on.
CHUNK = 400_000
_BASES = (0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(level: Level, edge: np.ndarray) -> tuple[Level, np.ndarray]:
    """One round of runs: what a symbol becomes depends on both its neighbours."""
    sym, start, lo, hi = level
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | edge[1:] | edge[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(sym)) - 1
    times = (last - first + 1).astype(U)
    name = np.where(times > 1, T.pair(T.mix(sym[first] ^ U(0x52)), times), sym[first])
    return (name, start[first], lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(sym) - 1)]), edge[first]


def pairs(level: Level, edge: np.ndarray, salt: int) -> tuple[Level, np.ndarray]:
    """One round of pairs. A pair depends on its two symbols only; a right symbol that stays single on the one before it, a left one on the next."""
    sym, start, lo, hi = level
    right = T.mix(sym ^ U(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)) >> U(63) == 1
    joined = np.zeros(len(sym), bool)
    joined[:-1] = ~right[:-1] & right[1:] & ~edge[:-1] & ~edge[1:]
    stays = np.ones(len(sym), bool)
    stays[1:] = ~joined[:-1]
    i = np.flatnonzero(stays)
    after = np.minimum(i + 1, len(sym) - 1)
    name = np.where(joined[i], T.pair(sym[i], sym[after]), sym[i])
    low = np.where(right[i], lo[np.maximum(i - 1, 0)], lo[i])
    high = np.where(right[i], hi[i], hi[after])
    return (name, start[i], low, high), edge[i]


def levels(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[list[Level], np.ndarray, np.ndarray, np.ndarray]:
    """(levels, places of all words, starts of all windows, document of every window). An edge, which never joins, stands before, between and after the texts."""
    size, docs = np.diff(bounds), len(bounds) - 1
    place = np.arange(len(words)) + np.repeat(np.arange(docs), size) + 1
    n = len(words) + docs + 1
    sym, edge = np.zeros(n, U), np.ones(n, bool)
    sym[place], edge[place] = words, False
    at = np.arange(n, dtype=np.int32)
    end = np.repeat(bounds[1:] + np.arange(docs) + 1, size)
    starts = place[place + window <= end].astype(np.int32)
    level: Level = (sym, at, at, at + 1)
    out = [level]
    for r in range(ROUNDS):
        if r in RUN_ROUNDS:
            level, edge = runs(level, edge)
            out.append(level)
        level, edge = pairs(level, edge, r)
        out.append(level)
    of = np.repeat(np.arange(docs), size)[place + window <= end]
    return out, place, starts, of


def anchors(all_levels: list[Level], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, place) of the anchor of every window."""
    name, where = np.zeros(len(starts), U), np.zeros(len(starts), np.int32)
    open_ = np.arange(len(starts))
    for k in range(len(all_levels) - 1, -1, -1):
        sym, start, lo, hi = all_levels[k]
        usable = np.flatnonzero(hi - lo <= max(1, DEPENDENCE * window))
        if not len(usable):
            continue
        s, low = starts[open_], lo[usable]
        a = usable[np.minimum(np.searchsorted(low, s), len(low) - 1)]
        fits = (lo[a] >= s) & (hi[a] <= s + window)
        name[open_[fits]], where[open_[fits]] = sym[a[fits]], start[a[fits]]
        open_ = open_[~fits]
        if not len(open_):
            break
    return name, where


def _prefix(words: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * T.powers(base, len(words)), out=total[1:])
    return total


def _span(total: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return T.mix((total[hi] - total[lo]) * T.powers(pow(base, -1, 2**64), len(total))[lo])


def smallest(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row has the smallest document of its key (a, b); all of its rows have, then."""
    order = np.lexsort((doc, b, a))
    x, y, d = a[order], b[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    least = d[new][np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = d == least
    return out


#: Windows first .. first + n - 1 of a document. Settled rows (repeated, of a smaller document) have no key.
_ROWS = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
ROWS = "doc bigint, t bigint, first int, n int, a bigint, b bigint"


def _batches(doc: np.ndarray, t: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, keyed: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 200_000):
        s = slice(i, i + 200_000)
        key = [pa.array(x[s].view(np.int64), mask=~keyed[s]) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[s], pa.int64()), pa.array(t[s], pa.int64()), pa.array(first[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), *key], schema=_ROWS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list | None]]:
    """(words, bounds, documents, text hashes, first windows and counts asked for) of CHUNK words and more at a time."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in T.slices(batch, "text"):
            h, b = T.words(part.column("text"), T.NON_SPACE, fold=False)
            asked = part.column("asked").to_pylist() if "asked" in part.schema.names else []
            held.append((h, np.diff(b), part.column("doc").to_numpy(), part.column("t").to_numpy(), asked))
            size += len(h)
            if size >= CHUNK:
                yield _join(held)
                held, size = [], 0
    if held:
        yield _join(held)


def _join(held: list[tuple]) -> tuple:
    h, n, doc, t = (np.concatenate([x[i] for x in held]) for i in range(4))
    return h, np.concatenate(([0], np.cumsum(n))), doc, t, [a for x in held for a in x[4]]


def _anchor_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, bounds, doc, t, _ in _chunks(batches):
            all_levels, _, starts, of = levels(words, bounds, window)
            if not len(starts):
                continue
            name, _ = anchors(all_levels, starts, window)
            new = np.ones(len(starts), bool)
            new[1:] = (starts[1:] != starts[:-1] + 1) | (name[1:] != name[:-1])
            i = np.flatnonzero(new)
            n = np.diff(np.append(i, len(starts)))
            total = _prefix(all_levels[0][0], _BASES[0])
            context = _span(total, _BASES[0], starts[i], starts[i] + n - 1 + window)
            d = of[i]
            first = starts[i] - (bounds[d] + d + 1)
            yield from _batches(doc[d], t[d], first, n, name[i], context, smallest(name[i], context, doc[d]))

    return run


def _window_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, bounds, doc, t, asked in _chunks(batches):
            ranges = np.array([(i, r["first"], r["n"]) for i, rows in enumerate(asked) for r in rows], np.int64).reshape(-1, 3)
            d = np.repeat(ranges[:, 0], ranges[:, 2])
            skipped = np.concatenate(([0], np.cumsum(ranges[:, 2])))[:-1]
            first = np.repeat(ranges[:, 1] - skipped, ranges[:, 2]) + np.arange(len(d))
            at = bounds[d] + first
            a, b = (_span(_prefix(w, base), base, at, at + window) for w, base in zip((words, T.mix(words)), _BASES, strict=True))
            new = np.ones(len(d), bool)  # equal windows one after the other, as in long runs, are one row
            new[1:] = (d[1:] != d[:-1]) | (first[1:] != first[:-1] + 1) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            i = np.flatnonzero(new)
            n = np.diff(np.append(i, len(d)))
            yield from _batches(doc[d[i]], t[d[i]], first[i], n, a[i], b[i], smallest(a[i], b[i], doc[d[i]]))

    return run


def _cut_task(window: int, columns: int):
    """Adds to rows (spans, text, ...) the number of words, of removed words and the kept words, one space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], []]
            texts = []
            for spans, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = _WORD.findall(text or b"")
                kept, end = [], 0
                for s in sorted(spans or [], key=lambda s: s["first"]):
                    kept += words[end : s["first"]]
                    end = max(end, s["first"] + s["n"] - 1 + window)
                kept += words[end:]
                counts[0].append(len(words))
                counts[1].append(len(words) - len(kept))
                texts.append(b" ".join(kept))
            made = [*(pa.array(c, pa.int64()) for c in counts), pa.array(texts, pa.binary()).cast(pa.string())]
            names = [*(f"c{i}" for i in range(columns)), "n_words", "n_removed", "kept"]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Windows that also start in a document with a smaller id: doc, t (hash of the text), spans (first window, n windows)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("doc"), F.xxhash64(quoted(text)).alias("t"), F.col(quoted(text)).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    found = written(rows.mapInArrow(_anchor_task(window), ROWS), "recompress-anchors")
    keyed = found.where("a IS NOT NULL")
    named = keyed.groupBy("a").agg((F.min("b") < F.max("b")).alias("several"), (F.min("doc") < F.max("doc")).alias("shared")).where("several OR shared")
    shared = written(keyed.join(named.select("a", "several"), "a"), "recompress-shared")
    least = F.min("doc").over(Window.partitionBy("a", "b"))
    contexts = written(shared.withColumn("repeated", F.col("doc") > least).where("repeated OR several"), "recompress-contexts")
    forget(shared)
    asked = contexts.where("NOT repeated").groupBy("doc", "t").agg(F.collect_list(F.struct("first", "n")).alias("asked"))
    # A settled row has no key: it is given one of its own, so that it passes the window below without company.
    windows = rows.join(asked, ["doc", "t"]).mapInArrow(_window_task(window), ROWS)
    alone = windows.select("doc", "t", "first", "n", F.col("a").isNull().alias("settled"), F.coalesce("a", F.xxhash64("doc", "t")).alias("a"), F.coalesce("b", F.col("first").cast("bigint")).alias("b"))
    later = alone.withColumn("least", least).where("settled OR doc > least")
    spans = found.where("a IS NULL").select("doc", "t", "first", "n")
    for more in (contexts.where("repeated"), later):
        spans = spans.unionAll(more.select("doc", "t", "first", "n"))
    out = written(spans.groupBy("doc", "t").agg(F.collect_set(F.struct("first", "n")).alias("spans")), "recompress-spans")
    forget(found, contexts)
    return out


def deduplicate(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_words, n_removed and kept: the words left, one space between them. Columns of docs with one of these names are replaced."""
    found = repeats(docs, window, text, doc_id)
    made = {"n_words", "n_removed", "kept"}
    kept = [c for c in docs.columns if c.lower() not in made]
    taken = [f"c{i}" for i in range(len(kept))]
    row = docs.select(*(F.col(quoted(c)).alias(n) for c, n in zip(kept, taken, strict=True)), F.col(quoted(doc_id)).cast("bigint").alias("doc"), F.xxhash64(quoted(text)).alias("t"), F.col(quoted(text)).alias("text"))
    joined = row.join(found, ["doc", "t"], "left").select("spans", "text", *taken)
    types = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, taken, strict=True))
    cut = joined.mapInArrow(_cut_task(window, len(kept)), f"{types}{', ' if types else ''}n_words bigint, n_removed bigint, kept string")
    return cut.toDF(*kept, "n_words", "n_removed", "kept")
