"""Exact repeats of at least LEAST bytes across the whole corpus, from a distributed enhanced suffix array.

1. Anchors. In every run of W = LEAST-K+1 consecutive K-byte grams the one with the smallest hash (the last of
   equals) is an anchor. A string of LEAST bytes holds such a run, so two equal strings have an anchor at the
   same offset. About 2/W of all positions are anchors, and only they are suffix starts of the sparse array.
2. Contexts. What matters of an anchor is its context: up to LEAST-K bytes before and LEAST bytes from it. Equal
   (anchor, context) hashes are counted with map-side sums. A context seen twice is repeated as a whole; one
   of its copies stands for all, so groups of thousands of copies cost one entry and never meet in one task. The HOT_KEYS
   most frequent contexts (if in OFTEN texts at least) do not even pass the join back to their texts: a map finds them.
3. Suffix array. Where an anchor has different contexts, one entry for each goes to the shard of the anchor.
   A shard sorts its entries by the right context, takes common prefixes of neighbours, and scans them with a
   stack: every interval of the array is a node of the common-prefix tree. Nodes keep their occurrences in left-
   context order; where occurrences of different children become neighbours there, the left extension that
   they share is tested: right depth + left extension >= LEAST is a repeat that cannot be extended. By the order,
   neighbours share the longest left extension, so no occurrence of a maximal repeat is lost and all pairs are never formed.
   `maximal_repeats` scans the same array and puts the groups themselves out, each with all its occurrences.
4. Anchors with more than GROUP different contexts do not fit that bound: all their LEAST-byte windows are
   counted by hash instead (map-side sums again), which is exact and free of groups.

Bytes of a text covered by repeats are merged to spans. With `fine` (bytes, fewer than `least`) the anchors are chosen for
strings of `fine` bytes, so one pass finds the repeats of both lengths. Passages of words, whatever their bytes, are found by the
same array on coded texts: each word is a code of CODE bytes (a hash of it), so W words are a string of W * CODE bytes.
Rows are identified by hashes of id and text, so ids of any type, repeated rows and repeated ids are well defined: a text that
occurs in two rows repeats itself. Null and empty texts have no bytes. Other columns are kept by `deduplicate` and ignored else.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._session import forget, free_name, quoted, small_batches, written

U = np.uint64
LEAST, K = 400, 32
#: Bytes from which repeats are looked for where passages count by words, and the words of such a passage.
FINE, PASSAGE_WORDS = 256, 51
#: Bytes of the code of a word.
CODE = 8
#: Different contexts of one anchor that one task holds.
GROUP = 100_000
#: Copies from which a context is one of the hot ones, and the most hot ones (two numbers each) that a task is given.
OFTEN, HOT_KEYS = 500, 50_000
#: Entries of a shard that are sorted together.
SHARD = 40_000
PIECE = 1 << 19
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value in each run of w values, the last of equals."""
    n = len(h)
    out = n - w + 1
    low = U((1 << 22) - 1)
    key = (h & ~low) | (low - np.arange(n, dtype=U))
    pad = -n % w
    key = np.concatenate((key, np.full(pad, ~U(0), U))).reshape(-1, w)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (low - (np.minimum(right[:out], left[w - 1 : w - 1 + out]) & low)).astype(np.int64)


def anchors(data: np.ndarray, off: np.ndarray, least: int, k: int, fine: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position in the text, gram hash, context hash) of all anchors, piece by piece."""
    w, reach = fine - k + 1, least
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        stop = min(end, lo + PIECE)  # windows that start in [lo, stop)
        a, b = max(int(off[0]), lo - reach), min(end, stop + 2 * reach + least)
        piece = data[a:b]
        if len(piece) >= fine:
            total = T.prefix_hash(piece)
            at = np.arange(len(piece) - k + 1)
            gram = T.span_hash(total, at, at + k)
            if len(gram) >= w:
                best = window_argmin(gram, w)
                start = np.arange(len(best)) + a
                text_end = off[np.searchsorted(off, start, "right")]
                ok = (start >= lo) & (start < stop) & (start + fine <= text_end)
                got = np.unique(best[ok])
                if len(got):
                    position = got + a
                    text = np.searchsorted(off, position, "right") - 1
                    first = np.maximum(off[text], position - (least - k))
                    last = np.minimum(off[text + 1], position + least)
                    shape = (position - first).astype(U) * U(1 << 20) + (last - position).astype(U)
                    yield text, position - off[text], gram[got], T.pair(T.span_hash(total, first - a, last - a), shape)
        lo = stop


ANCHORS = "k1 int, k2 bigint, pos bigint, anchor bigint, context bigint"


def _anchor_task(least: int, k: int, fine: int):
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            seen: set[tuple[int, int]] = set()  # an anchor next to the edge of a piece may be found from both sides
            for text, pos, gram, context in anchors(data, off, least, k, fine):
                edge = set(zip(text.tolist(), pos.tolist(), strict=True)) if off[-1] - off[0] > PIECE else set()
                if seen and (both := seen & edge):
                    keep = np.array([x not in both for x in zip(text.tolist(), pos.tolist(), strict=True)])
                    text, pos, gram, context = text[keep], pos[keep], gram[keep], context[keep]
                seen = edge
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[text], k2[text], pos, gram.view(np.int64), context.view(np.int64))], names)

    return run


ENTRIES = "k1 int, k2 bigint, pos bigint, anchor bigint, hot boolean, before binary, after binary"


def _context_task(least: int, k: int):
    """Cuts the contexts of the wanted anchors out of their texts; of equal rows that follow each other the first gives all."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = None
        for batch in batches:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            batch = batch.filter(pa.array([a != b for a, b in zip(keys, [last_key, *keys], strict=False)], pa.bool_()))
            last_key = keys[-1] if keys else last_key
            if not batch.num_rows:
                continue
            data, off = T.utf8(batch.column("text"))
            wanted = batch.column("wanted")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            w = wanted.flatten()
            pos, anchor, hot = (w.field(x) for x in ("pos", "anchor", "hot"))
            at = pos.to_numpy() + off[rows]
            first, last = np.maximum(off[rows], at - (least - k)), np.minimum(off[rows + 1], at + least)
            raw = data.tobytes()
            k1, k2 = (batch.column(c).to_numpy()[rows] for c in ("k1", "k2"))
            for i in range(0, len(at), 20_000):
                j = slice(i, i + 20_000)
                before = [raw[a:b] for a, b in zip(first[j].tolist(), at[j].tolist(), strict=True)]
                after = [raw[a:b] for a, b in zip(at[j].tolist(), last[j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k1[j]), pa.array(k2[j]), pos[j], anchor[j], hot[j], pa.array(before, pa.binary()), pa.array(after, pa.binary())], names)

    return run


def _matrix(strings: pa.Array, width: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, zeros after their ends, and their lengths."""
    data, off = T.utf8(strings)
    n = np.diff(off)
    room = np.zeros(width, np.uint8)
    if backward:
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((room, data[off[0] : off[-1]])), width)[off[1:] - off[0]][:, ::-1].copy()
    else:
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data[off[0] : off[-1]], room)), width)[off[:-1] - off[0]].copy()
    rows[np.arange(width) >= n[:, None]] = 0
    return rows, n


def _common(rows: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a[i] and b[i]."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 20_000):
        x, y = a[i : i + 20_000], b[i : i + 20_000]
        differs = rows[x] != rows[y]
        n = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        out[i : i + 20_000] = np.minimum(n, np.minimum(lengths[x], lengths[y]))
    return out


def interval_pairs(depths: list[int], left_rank: list[int], least_depth: int) -> list[tuple[int, int, int]]:
    """Stack scan of the enhanced suffix array: (left rank, left rank, depth) of the occurrences that become left neighbours.

    depths[i] is the common prefix of suffixes i-1 and i. A node's occurrences are merged child by child, the smaller
    list into the larger, so the work is that of sorting.
    """
    pairs: list[tuple[int, int, int]] = []

    def merge(x: list[int], y: list[int], depth: int) -> list[int]:
        if len(x) < len(y):
            x, y = y, x
        for r in y:
            i = bisect_left(x, r)
            if i:
                pairs.append((x[i - 1], r, depth))
            if i < len(x):
                pairs.append((r, x[i], depth))
            x.insert(i, r)
        return x

    stack: list[tuple[int, list[int]]] = []
    node = [left_rank[0]]
    for i in range(1, len(left_rank) + 1):
        depth = depths[i] if i < len(left_rank) else 0
        while stack and stack[-1][0] > depth:
            d, members = stack.pop()
            node = merge(members, node, d)
        if depth >= least_depth:
            if stack and stack[-1][0] == depth:
                node = merge(stack.pop()[1], node, depth)
            stack.append((depth, node))
        if i < len(left_rank):
            node = [left_rank[i]]
    return pairs


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of all nodes of the common-prefix tree, last included; lcp[i] is the common prefix of entries i-1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def _sorted(strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of zero-padded strings; a string comes before those that only zero bytes make longer."""
    by_length = np.argsort(lengths, kind="stable")
    return by_length[np.argsort(strings[by_length], kind="stable")]


class _Array:
    """The enhanced suffix array of entries: order by (anchor, right context), common prefixes, ranks by left context."""

    def __init__(self, anchor: np.ndarray, before: pa.Array, after: pa.Array, least: int, k: int):
        m = len(anchor)
        self.right, self.n_right = _matrix(after, least)
        self.left, self.n_left = _matrix(before, least - k, backward=True)
        head = anchor.astype(">i8").view(np.uint8).reshape(m, 8)
        keyed = np.ascontiguousarray(np.concatenate((head, self.right), axis=1))
        self.sa = sa = _sorted(keyed.view(f"S{8 + least}").ravel(), self.n_right)
        self.depth = np.zeros(m, np.int64)
        self.depth[1:] = np.where((anchor[sa[1:]] == anchor[sa[:-1]]), _common(self.right, self.n_right, sa[:-1], sa[1:]), 0)
        self.order = _sorted(np.ascontiguousarray(self.left).view(f"S{least - k}").ravel(), self.n_left)
        self.rank = np.empty(m, np.int64)
        self.rank[self.order] = np.arange(m)


def reach(anchor: np.ndarray, before: pa.Array, after: pa.Array, least: int, k: int, fine: int | None = None) -> tuple[np.ndarray, ...]:
    """How far repeats of `least` bytes around each entry's anchor extend to the left and right, then those of `fine` bytes; 0, 0 where there is none."""
    t = _Array(anchor, before, after, least, k)
    out = [np.zeros(len(anchor), np.int64) for _ in range(4)]
    pairs = interval_pairs(t.depth.tolist(), t.rank[t.sa].tolist(), k)
    if pairs:
        p = np.array(pairs, np.int64)
        a, b, d = t.order[p[:, 0]], t.order[p[:, 1]], p[:, 2]
        extension = _common(t.left, t.n_left, a, b)
        for size, to_left, to_right in ((least, *out[:2]), (fine or least, *out[2:])):
            ok = extension + d >= size
            for x in (a[ok], b[ok]):
                np.maximum.at(to_left, x, extension[ok])
                np.maximum.at(to_right, x, d[ok])
    return tuple(out)


def groups_of(anchor: np.ndarray, before: pa.Array, after: pa.Array, copies: np.ndarray, size: int, least: int, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, entries) of all groups: strings of `size` bytes or more around an anchor that no context lets grow without losing an occurrence.

    A node of the tree gives the right part. Its occurrences in left order have a common-prefix tree of their own; a node of that one is
    a group if its occurrences come from two children of the first (different bytes follow), as its own children differ in the byte before.
    An entry of several copies is a group of itself. The work is that of listing the occurrences.
    """
    t = _Array(anchor, before, after, least, k)
    for i in np.flatnonzero(copies > 1).tolist():
        if t.n_left[i] + t.n_right[i] >= size:
            yield int(t.n_left[i]), int(t.n_right[i]), np.array([i])
    depth = t.depth.tolist()
    for d, lo, hi in lcp_intervals(depth):
        if d < k:
            continue
        members = t.sa[lo : hi + 1]
        child = np.cumsum(t.depth[lo : hi + 1] == d)
        by_left = np.argsort(t.rank[members], kind="stable")
        members, child = members[by_left], child[by_left]
        common = np.zeros(len(members), np.int64)
        common[1:] = _common(t.left, t.n_left, members[:-1], members[1:])
        nodes = list(lcp_intervals(common.tolist()))
        if d >= size and (common[1:] == 0).any():
            nodes.append((0, 0, len(members) - 1))
        for e, a, b in nodes:
            if e + d >= size and (child[a : b + 1] != child[a]).any():
                yield e, d, members[a : b + 1]


REACH = "k1 int, k2 bigint, first bigint, last bigint, fine_first bigint, fine_last bigint"


def _reaches(least: int, k: int, fine: int):
    names = [x.split()[0] for x in REACH.split(", ")]

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, pos, k1, k2 = (t.column(c).to_numpy() for c in ("anchor", "pos", "k1", "k2"))
        left, right, fine_left, fine_right = reach(anchor, t.column("before").combine_chunks(), t.column("after").combine_chunks(), least, k, fine)
        ok = fine_right > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (k1, k2, pos - left, pos + right, pos - fine_left, pos + fine_right)], names)

    return solved


GROUPS = "group bigint, n_bytes bigint, left_open boolean, right_open boolean, anchor bigint, context bigint, left bigint"


def _own_anchors(text: bytes, least: int, k: int) -> set[int]:
    at = np.arange(len(text) - k + 1)
    return set(window_argmin(T.span_hash(T.prefix_hash(np.frombuffer(text, np.uint8)), at, at + k), least - k + 1).tolist())


def _groups(size: int, least: int, k: int):
    names = [x.split()[0] for x in GROUPS.split(", ")]

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, context, copies = (t.column(c).to_numpy() for c in ("anchor", "context", "copies"))
        before, after = (t.column(c).combine_chunks() for c in ("before", "after"))
        rows: list[tuple] = []
        for left, right, members in groups_of(anchor, before, after, copies, size, least, k):
            i = int(members[0])
            text = before[i].as_py()[len(before[i].as_py()) - left :] + after[i].as_py()[:right]
            if left not in _own_anchors(text, size, k):
                continue  # chosen by what surrounds the string: only at its own anchors all occurrences meet
            name = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)
            rows += [(name, left + right, left == least - k, right == least, a, c, left) for a, c in zip(anchor[members].tolist(), context[members].tolist(), strict=True)]
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return solved


def _shard_task(solved):
    """Whole anchors, about SHARD entries at a time, go to `solved`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            if not len(anchor):
                continue
            if held and size >= SHARD:
                cut = 0 if anchor[0] != last else int(np.searchsorted(anchor != last, True)) if (anchor != last).any() else len(anchor)
                if cut < len(anchor):
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield from solved(pa.Table.from_batches(held).combine_chunks())
                    batch = batch.slice(cut)
                    held, size = [], 0
            held.append(batch)
            size += batch.num_rows
            last = anchor[-1]
        if held:
            yield from solved(pa.Table.from_batches(held).combine_chunks())

    return run


WINDOWS = "k1 int, k2 bigint, pos bigint, anchor bigint, shift bigint, win bigint"


def _window_task(least: int, k: int):
    """Hashes of all windows of `least` bytes that hold the anchor gram of an entry."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, pos, anchor = (batch.column(c).to_numpy() for c in ("k1", "k2", "pos", "anchor"))
            for i, (before, after) in enumerate(zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True)):
                total = T.prefix_hash(np.frombuffer(before + after, np.uint8))
                start = np.arange(max(0, len(before) + k - least), max(0, min(len(before), len(before) + len(after) - least) + 1))
                win = T.span_hash(total, start, start + least).view(np.int64)
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(np.full(n, v[i], v.dtype) for v in (k1, k2, pos, anchor)), len(before) - start, win)], names)

    return run


def _hot_task(keys: np.ndarray, least: int, k: int):
    """Spans of the anchors whose (anchor, context) is in the sorted keys, merged along each text."""
    names = [x.split()[0] for x in REACH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, pos, anchor, context = (batch.column(c).to_numpy() for c in ("k1", "k2", "pos", "anchor", "context"))
            key = T.pair(anchor.view(U), context.view(U))
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            k1, k2, pos = k1[hit], k2[hit], pos[hit]
            if len(pos):
                # A run goes on while the next context of the same text touches it.
                new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (pos[1:] < pos[:-1]) | (pos[1:] - (least - k) > pos[:-1] + least)))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(pos)])) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[first], k2[first], *2 * (pos[first] - (least - k), pos[last] + least))], names)

    return run


def _key_columns(text: str, doc_id: str):
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    return [F.hash(F.col(quoted(doc_id))).alias("k1"), F.xxhash64(whole).alias("k2"), whole.alias("text")]


def _repeated(long: DataFrame, least: int, k: int, fine: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All anchors in text order, those that occur twice at least, and these counted by context with one place of each.

    Most anchors are unique and go no further than their count by anchor. `several`: the anchor has different contexts.
    """
    found = written(long.mapInArrow(_anchor_task(least, k, fine), ANCHORS), "repeat-anchors")
    counted = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    counted = written(counted.where("n > 1").select("anchor", (F.col("low") < F.col("high")).alias("several")), "repeat-counts")
    twice = written(found.join(counted, "anchor"), "repeat-twice")
    forget(counted)
    contexts = twice.groupBy("anchor", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("several", "k1", "k2", "pos")))
    return found, twice, written(contexts, "repeat-contexts")


def _entries(long: DataFrame, contexts: DataFrame, group: int | None, least: int, k: int) -> DataFrame:
    """The contexts cut out of their texts; `hot` if their anchor has more than `group` of them."""
    hot = F.lit(False)
    if group is not None:
        large = contexts.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > group)
        contexts, hot = contexts.join(large, "anchor", "left"), F.col("m").isNotNull()
    wanted = contexts.select("k1", "k2", F.struct("pos", "anchor", hot.alias("hot")).alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    return long.join(wanted, ["k1", "k2"]).mapInArrow(_context_task(least, k), ENTRIES)


def _windows_twice(entries: DataFrame, size: int, k: int, names: tuple[str, str]) -> DataFrame:
    """Spans around the anchors of entries whose windows of `size` bytes occur twice, counted by hash."""
    windows = entries.mapInArrow(_window_task(size, k), WINDOWS)
    twice = windows.groupBy("anchor", "shift", "win").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = windows.join(twice, ["anchor", "shift", "win"]).groupBy("k1", "k2", "pos").agg(F.max("shift").alias("l"), (size - F.min("shift")).alias("r"))
    return hot.select("k1", "k2", (F.col("pos") - F.col("l")).alias(names[0]), (F.col("pos") + F.col("r")).alias(names[1]))


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, k: int = K, group: int = GROUP, often: int = OFTEN, fine: int | None = None) -> DataFrame:
    """Per row key (k1, k2) the spans of bytes that repeats cover, not merged; keys without any are absent.

    first, last: of a repeat of `least` bytes or more (equal where there is only a shorter one); fine_first, fine_last: of `fine` bytes or more.
    """
    small_batches(docs.sparkSession)
    fine = fine or least
    return _spans(docs.select(*_key_columns(text, doc_id)).where(F.octet_length("text") >= fine), least, k, group, often, fine)


def repeated_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = PASSAGE_WORDS, k: int = K, group: int = GROUP, often: int = OFTEN) -> DataFrame:
    """Per row key (k1, k2) the spans of bytes of the coded text that repeats of `words` white-space words cover, not merged.

    A code is a hash of 64 bits: strings of codes that are equal but for whole codes differ in their bytes, but for one pair of words in 2^64.
    """
    small_batches(docs.sparkSession)
    coded = docs.select(*_key_columns(text, doc_id)).mapInArrow(_code_task(words), "k1 int, k2 bigint, text binary")
    return _spans(coded, words * CODE, min(k, words * CODE), group, often, words * CODE)


def _code_task(words: int):
    """Texts of `words` words or more as the codes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                h, bounds = T.words(part.column("text"), T.NON_SPACE, fold=False)
                long = np.diff(bounds) >= words
                raw, keys = h.tobytes(), part.select(["k1", "k2"]).filter(pa.array(long))
                codes = [raw[CODE * a : CODE * b] for a, b in zip(bounds[:-1][long].tolist(), bounds[1:][long].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(codes, pa.binary())], ["k1", "k2", "text"])

    return run


def _spans(long: DataFrame, least: int, k: int, group: int, often: int, fine: int) -> DataFrame:
    """Spans of the rows (k1, k2, text: string or binary), those with any."""
    found, twice, contexts = _repeated(long, least, k, fine)
    entries = written(_entries(long, contexts.where("several"), group, least, k), "repeat-entries")
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = entries.where("not hot").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_shard_task(_reaches(least, k, fine)), REACH)
    # Contexts of very many copies are few: their keys go to the map that merges their spans, all others through a join.
    many = contexts.where(F.col("n") >= often).select("n").orderBy(F.desc("n")).limit(HOT_KEYS + 1).agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    bound = 2**62 if not many["rows"] else many["n"] if many["rows"] <= HOT_KEYS else many["n"] + 1
    hottest = contexts.where(F.col("n") >= bound).select("anchor", "context")  # HOT_KEYS rows at most
    rest = twice.join(F.broadcast(hottest), ["anchor", "context"], "left_anti") if many["rows"] else twice
    whole = rest.join(contexts.where((F.col("n") > 1) & (F.col("n") < bound)).select("anchor", "context"), ["anchor", "context"], "left_semi")
    span = lambda first, last: [(F.col("pos") - (least - k)).alias(first), (F.col("pos") + least).alias(last)]
    all_ = single.unionByName(whole.select("k1", "k2", *span("first", "last"), *span("fine_first", "fine_last")))
    got = hottest.toArrow()
    if got.num_rows:
        keys = np.sort(T.pair(*(got.column(c).to_numpy().view(U) for c in ("anchor", "context"))))
        all_ = all_.unionByName(found.mapInArrow(_hot_task(keys, least, k), REACH))
    hot = entries.where("hot")
    if not hot.isEmpty():
        none = F.lit(0).cast("bigint")
        coarse = _windows_twice(hot, least, k, ("first", "last"))
        all_ = all_.unionByName(coarse.select("*", F.col("first").alias("fine_first"), F.col("last").alias("fine_last")))
        if fine < least:
            short = _windows_twice(hot, fine, k, ("fine_first", "fine_last"))
            all_ = all_.unionByName(short.select("*", none.alias("first"), none.alias("last")))
    spans = ["first", "last", "fine_first", "fine_last"] if fine < least else ["first", "last"]
    out = written(all_.groupBy("k1", "k2").agg(F.collect_set(F.struct(*spans)).alias("spans")), "repeat-spans")
    forget(found, twice, contexts, entries)
    return out


def maximal_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, k: int = K) -> DataFrame:
    """The maximal repeats with all occurrences: one row per occurrence, (group, n_bytes, open, doc_id, first).

    A group is a string of `least` bytes or more that occurs twice at least, and of which no longer string has all occurrences (different bytes
    precede some, different bytes follow some). `group` is a hash that stands for the string. The tree of one anchor sees LEAST-K bytes before it
    and LEAST from it; of a longer string it gives a part. Parts of one string have the same occurrences but for a constant shift, and as
    every LEAST-K bytes have an anchor they overlap: they are joined, whatever the length. Where a piece inside the string also occurs
    elsewhere, its anchors have more occurrences, and the string may stay in parts around it. `open`: the group begins or ends where
    a context does, so it may be such a part. doc_id and first (bytes before it) are null and zero based as in the input.
    Rows are in proportion to the occurrences listed. A task holds the different contexts of an anchor.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), *_key_columns(text, doc_id)).where(F.octet_length("text") >= least)
    long = rows.select("k1", "k2", "text")
    _, found, contexts = _repeated(long, least, k, least)
    entries = written(_entries(long, contexts, None, least, k), "repeat-entries")
    entries = entries.dropDuplicates(["k1", "k2", "pos", "anchor"]).join(contexts.select("k1", "k2", "pos", "anchor", "context", F.col("n").alias("copies")), ["k1", "k2", "pos", "anchor"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = entries.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_shard_task(_groups(least, least, k)), GROUPS)
    placed = grouped.join(found, ["anchor", "context"]).select("group", "n_bytes", "left_open", "right_open", "k1", "k2", (F.col("pos") - F.col("left")).alias("first"))
    placed = placed.groupBy("group", "n_bytes", "k1", "k2", "first").agg(F.min("left_open").alias("left_open"), F.min("right_open").alias("right_open"))
    placed = written(placed, "repeat-placed")
    joined = placed.join(_joined_parts(placed), ["group", "n_bytes"]).drop("group", "n_bytes", "left_open", "right_open").withColumnsRenamed({"whole": "group", "size": "n_bytes"})
    ids = rows.select("k1", "k2", "doc_id").groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    out = joined.join(ids, ["k1", "k2"])
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).select("group", "n_bytes", "open", "doc_id", "first")


def _joined_parts(placed: DataFrame) -> DataFrame:
    """Of every maximal repeat its first part: group, n_bytes (of the part), whole, size, open (of the repeat).

    Parts belong together if their occurrences do: as many, in the same texts, at a constant shift. Occurrences are compared by sums that do not depend
    on their order or on the shift (hashes of the texts, and hashes times the distance from the first occurrence), so no list is collected.
    Parts that overlap at the first occurrence are one string.
    """
    weight = {k: F.pmod(F.xxhash64("k1", "k2", F.lit(k)), F.lit(2**31)).cast("decimal(38,0)") for k in (1, 2)}
    sums = [f(w).alias(f"{n}{k}") for k, w in weight.items() for n, f in (("h", F.sum), ("d", lambda w: F.sum(w * F.col("first"))))]
    parts = placed.groupBy("group", "n_bytes").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("o"), F.min("left_open").alias("left_open"), F.min("right_open").alias("right_open"), *sums)
    parts = parts.select("group", "n_bytes", "n", "o.*", "left_open", "right_open", "h1", "h2", *((F.col(f"d{k}") - F.col(f"h{k}") * F.col("first")).alias(f"d{k}") for k in (1, 2)))
    same = ["n", "k1", "k2", "h1", "h2", "d1", "d2"]
    end = F.col("first") + F.col("n_bytes")
    order = Window.partitionBy(*same).orderBy("first", F.desc("n_bytes"), "group")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0)
    runs = parts.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.struct(end.alias("end"), (~F.col("right_open")).alias("closed"))
    begins = F.struct("first", "left_open", -F.col("n_bytes"), "group", "n_bytes")
    whole = runs.groupBy(*same, "run").agg(F.min(begins).alias("b"), F.max(ends).alias("e"), F.max(F.struct(end, "group"))["group"].alias("last"))
    size = F.col("e.end") - F.col("b.first")
    return whole.select("b.group", "b.n_bytes", F.xxhash64("b.group", "last", size).alias("whole"), size.alias("size"), (F.col("b.left_open") | ~F.col("e.closed")).alias("open"))


def merge_spans(first: np.ndarray, last: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spans cut to a text of n bytes; those that touch or overlap become one."""
    order = np.argsort(first, kind="stable")
    a, b = np.maximum(first[order], 0), np.maximum.accumulate(np.minimum(last[order], n))
    ok = b > a
    a, b = a[ok], b[ok]
    if not len(a):
        return []
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return list(zip(a[new].tolist(), b[np.concatenate((new[1:], [len(a)])) - 1].tolist(), strict=True))


def _each(batch: pa.RecordBatch, names: tuple[str, str] = ("first", "last")) -> Iterator[tuple[bytes, tuple[np.ndarray, np.ndarray]]]:
    """Every text's bytes with its spans."""
    spans = batch.column("spans")
    off = np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = spans.flatten()
    first, last = (flat.field(x).to_numpy() for x in names)
    for i, text in enumerate(batch.column("text")):
        yield text.as_py().encode(), (first[off[i] : off[i + 1]], last[off[i] : off[i + 1]])


def _merged(batch: pa.RecordBatch, names: tuple[str, str] = ("first", "last")) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Every text's bytes with its merged spans."""
    for raw, spans in _each(batch, names):
        yield raw, merge_spans(*spans, len(raw))


def _passages(raw: bytes, runs: list[tuple[int, int]], words: int) -> tuple[list[tuple[int, int]], int]:
    """The runs of `words` words or more, and the words in them."""
    counted = [(r, len(raw[r[0] : r[1]].split())) for r in runs]
    return [r for r, n in counted if n >= words], sum(n for _, n in counted if n >= words)


def _without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


REPORT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint"


def _report_task(least: int, fine: bool, words: int):
    names = [x.split()[0] for x in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            short = _merged(batch, ("fine_first", "fine_last")) if fine else _merged(batch)
            for (raw, cut), (_, runs) in zip(_merged(batch), short, strict=True):
                cut = cut if len(raw) >= least else []
                passages, n = _passages(raw, runs, words)
                kept = _without(raw, cut)
                rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), len(passages), n))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string() if x == "kept_sha256" else pa.int64()) for x, c in zip(names, columns, strict=True))], ["doc_id", *names])

    return run


def _word_runs(raw: bytes, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Bytes from the first to the last whole word of every run, given spans of the coded text."""
    places = [m.span() for m in _WORD.finditer(raw)]
    runs = merge_spans(-(-first // CODE), last // CODE, len(places))
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def _cut_task(words: int, coded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, spans in _each(batch):
                runs = _word_runs(raw, *spans) if coded else merge_spans(*spans, len(raw))
                runs = _passages(raw, runs, words)[0] if words else runs
                kept.append(_without(raw, runs).decode("utf-8", "ignore"))  # a cut inside a character drops its rest
            yield batch.drop_columns(["spans", "text"]).append_column("kept", pa.array(kept, pa.string()))

    return run


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fine: int | None = None, words: int = PASSAGE_WORDS, least: int = LEAST, **names) -> DataFrame:
    """Per document row: its bytes, those that repeats cover, the maximal covered runs, the digest of the rest; n_passages and
    n_passage_words: runs covered by repeats of `fine` bytes (default `least`) that hold `words` white-space words or more, and their words."""
    found = repeats(docs, text, doc_id, least=least, fine=fine, **names)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), *_key_columns(text, doc_id))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {REPORT}"
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_report_task(least, bool(fine) and fine < least, words), schema)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 0, passage: int = 0, **names) -> DataFrame:
    """docs with the repeated bytes cut out of the texts; all other columns stay as they are.

    With `words`, covered runs of fewer white-space words stay. With `passage`, what repeats is passages of so many white-space words, whatever
    their bytes and the white space between them; they go from their first to their last word. A character cut in the middle is
    dropped whole. Null texts stay null.
    """
    found = repeated_words(docs, text, doc_id, passage, **names) if passage else repeats(docs, text, doc_id, **names)
    own, spans = free_name("_row", docs.columns), free_name("_spans", docs.columns)
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text)
    k1, k2, whole = _key_columns(f"c{at}", f"c{docs.columns.index(doc_id)}")
    rows = numbered.select(F.struct(*numbered.columns).alias(own), k1, k2, whole).join(found.withColumnRenamed("spans", spans), ["k1", "k2"], "left")
    # Texts without a repeat do not pass through Python.
    untouched = rows.where(F.col(spans).isNull()).select(f"{own}.*")
    rest = [c for c in numbered.columns if c != f"c{at}"]
    cut = rows.where(F.col(spans).isNotNull()).select(F.struct(*(F.col(f"{own}.{c}").alias(c) for c in rest)).alias("row"), "text", F.col(spans).alias("spans"))
    cut = cut.mapInArrow(_cut_task(words, passage > 0), f"row {cut.schema['row'].dataType.simpleString()}, kept string")
    out = untouched.unionByName(cut.select(*(F.col("kept").alias(c) if c == f"c{at}" else F.col(f"row.{c}") for c in numbered.columns)))
    return out.toDF(*docs.columns)
