"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards of about SHARD_WORDS words and builds a suffix array over each
shard's word hashes (prefix doubling; a separator after every document ends all matches there). All suffixes
of the benchmark items are then binary-searched in every shard: the range of suffixes that begin with the
same k words gives all occurrences, and runs of occurrences on one diagonal are the longest verbatim matches.
Nothing is shuffled; a document lies in one shard, so its result is complete where it is made.

The benchmark is a query set. It is read in blocks of at most BLOCK_BYTES of text; each block goes to the
workers as one file-sized array, and with more than one block the blocks' spans are joined by document.

Defined cases: null and empty texts have no words, no hits and no items; an item without words never occurs;
repeated item ids are one item that occurs where any of its texts does; repeated document rows each get a row;
an empty benchmark contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._session import quoted, small_batches, written

U = np.uint64
K = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 64 << 20


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their first `depth` symbols (symbols compare as numbers)."""
    n = len(seq)
    sa = np.argsort(seq)
    s = seq[sa]
    new = np.concatenate(([True], s[1:] != s[:-1])) if n else np.zeros(0, bool)
    where = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, where, 0))
    k = 1
    while k < depth:
        tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(tied):
            break
        at = sa[tied]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[tied] = at
        split = np.concatenate(([True], key[1:] != key[:-1]))
        new[tied] = split
        rank[at] = tied[np.maximum.accumulate(np.where(split, np.arange(len(tied)), 0))]
        k *= 2
    return sa


def search(seq: np.ndarray, sa: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of queries (m x k symbols) the range of suffixes that begin with it, by binary search."""
    m, k = queries.shape
    padded = np.concatenate((seq, np.zeros(k, U)))
    span = np.arange(k)
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            there = padded[sa[np.minimum(mid, len(sa) - 1)][:, None] + span]
            differs = there != queries
            at = differs.argmax(axis=1)
            row = np.arange(m)
            less = there[row, at] < queries[row, at]
            right = (less | ~differs.any(axis=1)) if upper else less
            lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


class _Items:
    """The suffixes of the items, grouped by the number of words that must match."""

    def __init__(self, ids: list[str], hashes: np.ndarray, bounds: np.ndarray, k: int):
        self.ids = ids
        lengths = np.diff(bounds)
        item = np.repeat(np.arange(len(ids)), lengths)
        offset = np.arange(len(hashes)) - np.repeat(bounds[:-1], lengths)
        need = np.minimum(lengths, k)[item]
        suffix = offset + need <= lengths[item]
        self.groups = []
        for size in np.unique(need[suffix]):
            at = np.flatnonzero(suffix & (need == size))
            rows = hashes[at[:, None] + np.arange(size)]
            unique, inverse = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(inverse.ravel(), kind="stable")
            self.groups.append((int(size), unique, np.searchsorted(inverse.ravel()[order], np.arange(len(unique) + 1)), item[at][order], offset[at][order]))
        self.longest = int(lengths.max()) if len(lengths) else 0


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths) + np.repeat(starts, lengths)


def _shard(h: np.ndarray, bounds: np.ndarray, items: _Items):
    """(hit words, items, longest match) of every document of a shard."""
    docs = len(bounds) - 1
    seq = np.zeros(len(h) + docs, U)
    text = np.repeat(np.arange(docs), np.diff(bounds))
    seq[np.arange(len(h)) + text] = h
    starts = bounds[:-1] + np.arange(docs)
    edge = np.zeros(len(seq) + 1, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    if items.groups and len(h):
        sa = suffix_array(seq, min(items.longest, 64))
        for size, queries, cut, item, offset in items.groups:
            lo, hi = search(seq, sa, queries)
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            count = (hi - lo)[hit]
            at = sa[_ranges(lo[hit], count)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            query = np.repeat(hit, count)
            copies = (cut[1:] - cut[:-1])[query]
            of = _ranges(cut[query], copies)
            at = np.repeat(at, copies)
            found.append((np.searchsorted(starts, at, "right") - 1, item[of], at, at - offset[of], np.full(len(of), size)))
    covered = np.cumsum(edge[:-1]) > 0
    return seq, starts, covered, [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


SPANS = "doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>, longest bigint, longest_item string, longest_at bigint"
_SPANS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())])


def _task(ids: list[str], hashes: np.ndarray, bounds: np.ndarray, k: int):
    def rows(doc_ids: list[int], h: np.ndarray, own: np.ndarray, items: _Items) -> pa.RecordBatch:
        _, starts, covered, found = _shard(h, own, items)
        docs = len(starts)
        spans: list[list[dict]] = [[] for _ in range(docs)]
        step = np.diff(covered.astype(np.int8), prepend=0, append=0)
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            d = int(np.searchsorted(starts, a, "right")) - 1
            spans[d].append({"first": a - int(starts[d]), "last": b - 1 - int(starts[d])})
        names: list[list[str]] = [[] for _ in range(docs)]
        best: list[tuple[int, str | None, int | None]] = [(0, None, None)] * docs
        if found:
            doc, item, at, diagonal, size = found
            pairs = np.unique(doc * len(items.ids) + item)
            for x in pairs.tolist():
                names[x // len(items.ids)].append(items.ids[x % len(items.ids)])
            order = np.lexsort((at, diagonal, item, doc))
            doc, item, at, diagonal, size = (x[order] for x in (doc, item, at, diagonal, size))
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(at)])) - 1
            for d, i, a, n in zip(doc[first].tolist(), item[first].tolist(), at[first].tolist(), (at[last] + size[last] - at[first]).tolist(), strict=True):
                if n > best[d][0]:
                    best[d] = (n, items.ids[i], a - int(starts[d]))
        columns = [doc_ids, np.diff(own).tolist(), spans, [sorted(set(x)) for x in names], *([b[j] for b in best] for j in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS, strict=True)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch], items: _Items | None = None) -> Iterator[pa.RecordBatch]:
        items = items or _Items(ids, hashes, bounds, k)
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in T.slices(batch, "text", 2 << 20):
                h, b = T.words(part.column("text"), T.ALNUM)
                held_ids += part.column("doc_id").to_pylist()
                held.append(h)
                lengths.append(np.diff(b))
                size += len(h)
                if size >= SHARD_WORDS:
                    yield rows(held_ids, np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))), items)
                    held_ids, held, lengths, size = [], [], [], 0
        if held_ids:
            yield rows(held_ids, np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))), items)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: its number of words, covered word spans, occurring items, longest verbatim match. Ids are integers."""
    small_batches(docs.sparkSession)
    items, blocks = _items(benchmark, item_id, item_text)
    rows = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(quoted(text)).alias("text"))
    if blocks == 1:
        return rows.mapInArrow(_task(*_hashed(items), k), SPANS)
    # A key for each row, as document ids may repeat.
    keyed = written(rows.withColumn("doc_id", F.struct(F.monotonically_increasing_id().alias("row"), "doc_id")).select("doc_id.row", "doc_id.doc_id", "text"), "leak-rows")
    parts = [keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_task(*_hashed(items.where(F.crc32("id") % blocks == b)), k), SPANS) for b in range(blocks)]
    merged = written(parts[0].unionAll(parts[1]) if blocks == 2 else _union(parts), "leak-blocks")
    by_row = merged.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"), F.max_by("longest_item", "longest").alias("longest_item"), F.max_by("longest_at", "longest").alias("longest_at"))
    return keyed.select("row", "doc_id").join(by_row, "row").drop("row")


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """id and text of the items, and the number of blocks that they are read in."""
    items = benchmark.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(quoted(item_text)), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, -(-size // BLOCK_BYTES) or 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _hashed(items: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """One block of the query set, of at most about BLOCK_BYTES of text, as ids, word hashes and bounds."""
    got = items.orderBy("id").toArrow()
    h, b = T.words(got.column("text"), T.ALNUM)
    return got.column("id").to_pylist(), h, b


def hit_words(spans: Column) -> Column:
    """Words inside any span; spans of several blocks may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["last"], s["last"]).alias("last"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["last"] - F.greatest(s["first"], acc["last"] + 1) + 1)).alias("n"))
    return F.aggregate(ordered, start, step)["n"]


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    found = matches(docs, benchmark, **names)
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.col("longest").alias("longest_match"), "longest_item", "longest_at")


def _clean_task(ids: list[str], hashes: np.ndarray, bounds: np.ndarray, k: int, at: int):
    """The rows whose text (column `at`) no item occurs in, as they came."""
    spans = _task(ids, hashes, bounds, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(ids, hashes, bounds, k)
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            clean = np.ones(batch.num_rows, bool)
            for found in spans(iter([numbered]), items):
                hit = found.column("spans").value_lengths().to_numpy() > 0
                clean[found.column("doc_id").to_numpy()[hit]] = False
            yield batch.filter(pa.array(clean))

    return run


def remove(docs: DataFrame, benchmark: DataFrame, k: int = K, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold a window of an item. Every row is judged by its own text where it is read: ids, which may
    repeat, be null or have any type, play no part, nothing is shuffled, and columns may have any names. A block of items is a pass."""
    small_batches(docs.sparkSession)
    items, blocks = _items(benchmark, item_id, item_text)
    at = docs.columns.index(text)
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    for b in range(blocks):
        out = out.mapInArrow(_clean_task(*_hashed(items.where(F.crc32("id") % blocks == b)), k, at), out.schema)
    return out.toDF(*docs.columns)
