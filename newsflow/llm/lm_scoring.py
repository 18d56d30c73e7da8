"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the workers.

Counting. Each task hashes the tokens of its texts and sums equal n-grams in NumPy before anything is
shuffled; what it sends is one compressed block of (n-gram, count) arrays per shard. Shards go by the hash of the n-gram's context, so the context's total and its numbers of
continuations seen once, twice or more are known inside one shard. There are as many as SHARD_BYTES of text ask for (2**SHARD_BITS
at most), and blocks are summed as they come, so a task holds the *distinct* n-grams of a shard, whatever the size of the
input: a frequent word adds at most its distinct continuations. Each level then sends the next lower one its distinct
suffixes (their number is the adjusted count of Kneser and Ney), again as blocks.

Storage. Per shard and level one file in the shared folder with a sorted array of 64-bit n-gram hashes and arrays of counts,
written under a temporary name and renamed, so a task that is run again is harmless. Workers map the files and keep them mapped from task
to task. A store that is not a file system is copied to unlinked local files once by each worker process.

Defined cases: a null or empty text is the single token "end"; without training rows every probability is
uniform over the unknown word; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._arrays import mapped, store
from ._session import forget, quoted, shared_dir, small_batches, written

U = np.uint64
END, BOS = U(0x6B2F1A9C3D5E7F01), U(0x1F3D5B79A8C6E402)
#: n-grams a task holds before it sums and sends them.
HOLD = 3_000_000
#: Text of one shard, of which a task gets one, and the most shards as a power of two (every shard is a mapped file for each level).
SHARD_BYTES, SHARD_BITS = 16 << 20, 14
#: Least discount: keeps unseen words possible when a count of counts is empty (tiny corpora).
LEAST_DISCOUNT = 0.1


def sequences(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with order-1 start marks before each text, positions of the predicted tokens, their bounds)."""
    h, bounds = T.words(texts, T.NON_SPACE)
    n = len(bounds) - 1
    seq = np.full(len(h) + n * order, BOS, U)
    text = np.repeat(np.arange(n), np.diff(bounds))
    seq[np.arange(len(h)) + text * order + order - 1] = h
    seq[bounds[1:] + np.arange(n) * order + order - 1] = END
    lengths = np.diff(bounds) + 1
    firsts = bounds[:-1] + np.arange(n) * order + order - 1
    out = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(out[-1]) - np.repeat(out[:-1], lengths) + np.repeat(firsts, lengths)
    return seq, at, out


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = T.pair(h, c)
    return T.mix(h + U(len(columns)))


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of an n-gram; its SHARD_BITS top bits are those of the context, so that shards are key ranges."""
    if len(columns) == 1:
        return context_hash(columns)
    context = context_hash(columns[:-1])
    return (context >> U(64 - SHARD_BITS) << U(64 - SHARD_BITS)) | (T.pair(context, columns[-1]) >> U(SHARD_BITS))


def _summed(key: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]):
    """Rows of equal key become one, in key order; counts are added."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    take = order[first]
    sums = [np.add.reduceat(c[order], first) if len(first) else c for c in counts]
    return key[first], [c[take] for c in columns], sums


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(next(t for t, top in ((np.uint8, 2**8), (np.uint16, 2**16), (np.uint32, 2**32), (U, 2**64)) if most < top))


def _blocks(columns: list[np.ndarray], counts: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """Summed n-grams as one compressed block for each shard that has any."""
    key, columns, counts = _summed(gram_key(columns), columns, counts)
    shift = U(64 - int(shards).bit_length() + 1)
    cut = np.searchsorted(key >> shift, np.arange(shards + 1).astype(U)) if shards > 1 else np.array([0, len(key)])
    packer = zstandard.ZstdCompressor(level=1)
    for s in np.flatnonzero(np.diff(cut)).tolist():
        lo, hi = int(cut[s]), int(cut[s + 1])
        raw = io.BytesIO()
        for a in [*(c[lo:hi] for c in columns), *(_narrow(c[lo:hi]) for c in counts)]:
            np.save(raw, a)
        yield s, packer.compress(raw.getvalue())


def _unpacked(block: bytes, level: int, counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(block))
    return [np.load(raw) for _ in range(level)], [np.load(raw).astype(U) for _ in range(counts)]


def _merged(blocks: Iterator[bytes], level: int, counts: int):
    """Sums of the n-grams of all blocks, in key order. Blocks are summed as soon as as many n-grams came in as are held already."""
    held: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
    base = size = 0

    def fold():
        columns = [np.concatenate([c[k] for c, _ in held]) for k in range(level)]
        return _summed(gram_key(columns), columns, [np.concatenate([n[k] for _, n in held]) for k in range(counts)])

    for block in blocks:
        held.append(_unpacked(block, level, counts))
        size += len(held[-1][1][0])
        if size > max(HOLD, base):
            key, columns, sums = fold()
            held, base, size = [(columns, sums)], len(key), 0
    return fold()


def slots(n: int) -> np.ndarray:
    """One whole number for each of n partitions that Spark's hash partitioning (Murmur3 with seed 42, modulo n) deals to that partition."""
    most = 64
    while True:
        k = np.arange(most, dtype=np.uint32)
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        with np.errstate(over="ignore"):
            h = np.uint32(42) ^ (turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
            h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
        place, first = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
        if len(place) == n:
            return k[first].astype(np.int32)
        most *= 2


def _record(shards: list[int], blocks: list[bytes | None], stats: list[list[int] | None], slots: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array(blocks, pa.binary()), pa.array(stats, pa.list_(pa.int64())), pa.array(slots, pa.int32())], ["shard", "block", "stats", "slot"]
    )


BLOCKS = "shard int, block binary, stats array<bigint>, slot int"


def _count_task(order: int, shards: int):
    slot = slots(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            columns = [np.concatenate([g[k] for g in held]) for k in range(order)]
            ones = np.ones(len(columns[0]), U)
            for s, block in _blocks(columns, [ones], shards):
                yield _record([s], [block], [None], [int(slot[s])])

        for batch in batches:
            for part in T.slices(batch, "text"):
                seq, at, _ = sequences(part.column("text"), order)
                held.append([seq[at - order + 1 + k] for k in range(order)])
                size += len(at)
                if size >= HOLD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _level_task(path: str, level: int, top: bool, shards: int):
    """Merges the blocks of each shard, stores its arrays, sends the suffixes to the next lower level."""
    slot = slots(shards)

    def merged(shard: int, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        key, columns, counts = _merged(blocks, level, 1 if top else 2)
        a, raw = counts[0], counts[-1]
        arrays = {"key": key, "count": _narrow(a)}
        if level == 1:
            arrays["raw"] = _narrow(raw)
        else:
            context = context_hash(columns[:-1])
            order = np.argsort(context)
            c, n = context[order], a[order]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            arrays |= {"context": c[first], "total": _narrow(np.add.reduceat(n, first))}
            arrays |= {f"seen{k}": _narrow(np.add.reduceat(seen.astype(U), first)) for k, seen in enumerate((n == 1, n == 2, n >= 3), 1)}
        store(path, f"level{level}-{shard}", arrays)
        yield _record([-1 - shard], [None], [[*(int((a == k).sum()) for k in (1, 2, 3, 4)), len(a), int(a.sum()), int(raw.sum())]], [0])
        if level > 1:
            for s, block in _blocks(columns[1:], [np.ones(len(a), U), raw], shards):
                yield _record([s], [block], [None], [int(slot[s])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, b) for batch in batches for s, b in zip(batch.column("shard").to_pylist(), batch.column("block"), strict=True))
        for shard, group in groupby(rows, lambda r: r[0]):
            yield from merged(shard, (b.as_py() for _, b in group))

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that all probabilities share."""

    path: str
    order: int
    shards: int
    levels: tuple[tuple[int, ...], ...]  # per level from 1: n1, n2, n3, n4, distinct, sum of adjusted counts, tokens
    keys: tuple[dict[int, int], ...]  # per level from 1: the keys of every shard that was written

    def discounts(self, level: int) -> np.ndarray:
        n1, n2, n3, n4 = self.levels[level - 1][:4]
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [k - (k + 1) * y * b / a if a and y else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        return np.array([0.0, *(min(max(x, LEAST_DISCOUNT), k) for k, x in enumerate(d, 1))])


class _Arrays:
    """Memory-mapped arrays of a model; shards are opened when first asked for."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def get(self, level: int, shard: int) -> dict[str, np.ndarray]:
        if (x := self.open.get((level, shard))) is None:
            x = mapped(self.model.path, f"level{level}-{shard}")
            have, wanted = len(x.get("key", ())), self.model.keys[level - 1].get(shard, 0)
            if have != wanted:
                raise FileNotFoundError(f"shard {shard} of level {level} of the model in {self.model.path} has {have} of its {wanted} keys")
            self.open[level, shard] = x
        return x

    def find(self, keys: np.ndarray, level: int, index: str, values: list[str]) -> list[np.ndarray]:
        """Values of each key, 0 where it has none. Equal keys are looked up once, in order of the array."""
        unique, inverse = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(unique), np.float64) for _ in values]
        shards = self.model.shards
        cut = np.searchsorted(unique >> U(64 - int(shards).bit_length() + 1), np.arange(shards + 1).astype(U)) if shards > 1 else np.array([0, len(unique)])
        for s in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = int(cut[s]), int(cut[s + 1])
            held = self.get(level, s)
            have = held.get(index, ())
            if len(have):
                at = np.minimum(np.searchsorted(have, unique[lo:hi]), len(have) - 1)
                hit = have[at] == unique[lo:hi]
                for v, name in zip(out, values, strict=True):
                    v[lo:hi][hit] = held[name][at[hit]]
        return [v[inverse] for v in out]


#: The arrays of the last model that this worker process scored with.
_last: list[_Arrays] = []


def _arrays_of(model: Model) -> _Arrays:
    if not _last or _last[0].model.path != model.path:
        _last[:] = [_Arrays(model)]
    return _last[0]


def fit(docs: DataFrame, text: str = "text", order: int = 3, shards: int | None = None) -> Model:
    """Counts the n-grams of all rows of docs and stores the model in the shared folder."""
    if order < 2:
        raise ValueError("the model needs an order of 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(quoted(text)).alias("text"))
    if shards is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = min(1 << SHARD_BITS, 1 << max(0, -(-size // SHARD_BYTES) - 1).bit_length())
    if shards & (shards - 1) or shards > 1 << SHARD_BITS:
        raise ValueError(f"shards is a power of two up to {1 << SHARD_BITS}")
    path = shared_dir(spark, "lm")
    blocks = texts.mapInArrow(_count_task(order, shards), BLOCKS)
    levels: list[tuple[int, ...]] = []
    keys: list[dict[int, int]] = []
    for level in range(order, 0, -1):
        by_shard = blocks.where("shard >= 0").repartition(shards, "slot").sortWithinPartitions("shard")
        before, blocks = blocks, written(by_shard.mapInArrow(_level_task(path, level, level == order, shards), BLOCKS), f"lm-level{level}")
        if level < order:
            forget(before)
        stats = blocks.where("shard < 0").select("shard", "stats").collect()  # seven numbers for each shard, 2^14 shards at most
        levels.append(tuple(sum(r["stats"][k] for r in stats) for k in range(7)))
        keys.append({-1 - r["shard"]: r["stats"][4] for r in stats})
    return Model(path, order, shards, tuple(levels[::-1]), tuple(keys[::-1]))


def _probabilities(arrays: _Arrays, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, raw training count) of each predicted token."""
    m = arrays.model
    distinct, total = m.levels[0][4], m.levels[0][5]
    a, raw = arrays.find(context_hash([seq[at]]), 1, "key", ["count", "raw"])
    d = m.discounts(1)
    n1, n2 = m.levels[0][:2]
    uniform = 1.0 / (distinct + 1)
    if total:
        left = (d[1] * n1 + d[2] * n2 + d[3] * (distinct - n1 - n2)) / total
        p = np.maximum(a - d[np.minimum(a, 3).astype(np.int64)], 0) / total + left * uniform
    else:
        p = np.full(len(at), uniform)
    for level in range(2, m.order + 1):
        columns = [seq[at - level + 1 + k] for k in range(level)]
        (c,) = arrays.find(gram_key(columns), level, "key", ["count"])
        t, *seen = arrays.find(context_hash(columns[:-1]), level, "context", ["total", "seen1", "seen2", "seen3"])
        d = m.discounts(level)
        known = t > 0
        t = np.where(known, t, 1)
        back = np.where(known, (d[1] * seen[0] + d[2] * seen[1] + d[3] * seen[2]) / t, 1.0)
        p = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) / t + back * p
    return p, raw


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def _score_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays_of(model)
        distinct, tokens = model.levels[0][4], model.levels[0][6]
        for batch in batches:
            for part in T.slices(batch, "text"):
                seq, at, bounds = sequences(part.column("text"), model.order)
                p, raw = _probabilities(arrays, seq, at)
                base = np.add.reduceat(np.log10((raw + 1) / (tokens + distinct + 1)), bounds[:-1])
                score = np.add.reduceat(np.log10(p), bounds[:-1])
                n = np.diff(bounds)
                known = np.add.reduceat((raw > 0).astype(np.int64), bounds[:-1])
                with np.errstate(over="ignore"):
                    perplexity = 10.0 ** (-score / n)
                arrays_out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), tokens), pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays_out, *(pa.array(x, pa.float64()) for x in (base, score, perplexity))], [x.split()[0] for x in SCORES.split(", ")])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Log10 probability and perplexity of every text; a map over the rows, without a shuffle. Ids are whole numbers."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(_score_task(model), SCORES)
