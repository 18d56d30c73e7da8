"""Many literal patterns looked for in many texts at once.

Patterns are dealt by hash into blocks of about BLOCK_BYTES bytes, stored in the shared folder. A worker reads a block's patterns, cuts them
into pieces of eight bytes and makes hashed tables of the pieces (numpy arrays, about ten bytes a byte of patterns). Whole texts stream by: windows of eight
bytes that begin no pattern go by a small filter, the others are followed piece by piece, so a text costs its length and what is
found in it, however many patterns a block has. No text meets a pattern by a join: a frequent pattern or text makes no hot key.
Texts are not shuffled; each block is one more pass over them. A block whose file is gone or short raises.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..shared import scratch

BLOCK_BYTES = 1 << 24
#: Texts of which the findings go on together, as many as hold CHARS bytes (one at least) and ROWS at most.
ROWS, CHARS = 4000, 1 << 20
#: Places of texts looked at together; findings kept before they are counted; rows that go on together.
STEP, MOST, GIVEN = 1 << 18, 1 << 20, 1 << 16
#: A piece is the first bytes of a window, as a number: MASK by their count. After a whole window a pattern may go ON into the next piece; after LONG bytes
#: it ends as a HEAD, from where the patterns with this head are looked up in their order.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
ON, HEAD, LONG = 9, 10, 64
_MIX, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Patterns:
    spark: SparkSession
    path: str
    sizes: dict[int, int]  # rules of each block


def build(rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> Patterns:
    """rules: needle, and where texts are labelled grp, rank (whole number), label. Null and empty needles are left out, repeated rows are one."""
    spark, path = rules.sparkSession, scratch(rules.sparkSession, "patterns")
    given = {"grp": "string", "rank": "bigint", "label": "string"}
    wanted = [F.col(c).cast(t).alias(c) if c in rules.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()]
    rows = rules.select(F.col("needle").cast("string").alias("needle"), *wanted).where("needle <> ''").distinct()
    size = rows.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    block = F.pmod(F.xxhash64("needle"), F.lit(size // block_bytes + 1)).cast("int")
    rows.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
    stored = spark.read.schema("needle string, grp string, rank bigint, label string, block int").parquet(path)
    sizes = {r["block"]: r["n"] for r in stored.groupBy("block").agg(F.count("*").alias("n")).collect()}  # one row for each BLOCK_BYTES of patterns
    return Patterns(spark, path, sizes)


def _hashed(node: np.ndarray | int, piece: np.ndarray, bits: int) -> np.ndarray:
    h = piece ^ (node * _NODE) if isinstance(node, np.ndarray) else piece.copy()
    h *= _MIX
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


class _Pieces:
    """Numbers by node (where the pieces before led, 0 at the start) and piece, exact: a filter, and behind it buckets of a hash."""

    def __init__(self, node: np.ndarray, piece: np.ndarray, value: np.ndarray):
        self.bits = max(8, len(piece).bit_length())
        wide = _hashed(node, piece, self.bits + 3)
        self.near = np.zeros(8 << self.bits, dtype=bool)
        self.near[wide] = True
        bucket = wide >> 3
        order = np.argsort(bucket, kind="stable")
        self.node, self.piece, self.value = node[order], piece[order], value[order]
        self.start = np.zeros((1 << self.bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount(bucket, minlength=1 << self.bits), out=self.start[1:])

    def find(self, node: np.ndarray | int, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked are there, and their numbers."""
        wide = _hashed(node, piece, self.bits + 3)
        live = np.flatnonzero(self.near.take(wide))
        bucket, piece, node = wide[live] >> 3, piece[live], node[live] if isinstance(node, np.ndarray) else node
        at, end, which, values = self.start.take(bucket), self.start.take(bucket + 1), [live[:0]], [self.value[:0]]
        while live.size:
            same = (self.piece.take(at) == piece) & (self.node.take(at) == node)
            which.append(live[same])
            values.append(self.value.take(at[same]))
            at += 1
            rest = np.flatnonzero(~same & (at < end))
            live, at, end, piece, node = live[rest], at[rest], end[rest], piece[rest], node[rest] if isinstance(node, np.ndarray) else node
        return np.concatenate(which), np.concatenate(values)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts (no nulls), with eight zeros and more behind them; a window of eight bytes for each place; where each text ends."""
    texts = texts.cast(pa.large_binary())
    _, at, held = texts.buffers()
    ends = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    size = int(ends[-1] - ends[0])
    data = np.zeros(size + 16, dtype=np.uint8)
    if size:
        data[:size] = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]]
    return data, np.ndarray(size + 8, dtype="<u8", buffer=data, strides=(1,)), ends[1:] - ends[0]


class _Table:
    """The patterns of a block: `needles` (each once), their `sizes` in bytes, their rules, and the tables of their pieces."""

    def __init__(self, rules: pa.Table):
        coded = rules.column("needle").combine_chunks().dictionary_encode()
        self.needles = coded.dictionary
        self._rules(rules.set_column(0, "needle", coded.indices).filter(pc.is_valid(rules.column("grp"))))
        _, windows, ends = _bytes(self.needles)
        starts = np.concatenate([[0], ends[:-1]])
        self.sizes, lead = ends - starts, windows[starts]
        self.filters = []  # length of a piece, hashed pieces of this length that begin patterns, what may follow
        for n in (1, 2, 4, 8):
            own = np.flatnonzero(self.sizes >= n if n == 8 else (self.sizes >= n) & (self.sizes < 2 * n))
            if own.size:
                bits = min(26, max(10, int(8 * own.size).bit_length()))
                begins = np.zeros(1 << bits, dtype=bool)
                begins[_hashed(0, lead[own] & MASK[n], bits)] = True
                self.filters.append((n, begins, bits, np.unique(np.minimum(self.sizes[own], ON)).tolist()))
        value, alive = np.arange(len(starts), dtype=np.uint32), self._long()
        value[alive] = np.arange(len(alive))
        alive = np.concatenate([np.flatnonzero(self.sizes <= LONG), alive]).astype(np.uint32)
        held: dict[int, list] = {n: [] for n in range(1, HEAD + 1)}
        node, marks, nodes, depth = np.zeros(len(alive), dtype=np.uint32), [], 1, 0
        while alive.size:
            piece, left = windows[starts[alive] + depth], np.minimum(self.sizes[alive] - depth, ON)
            left[left == ON] = HEAD if depth == LONG - 8 else ON
            for n in (*range(1, ON), HEAD):
                if (own := np.flatnonzero(left == n)).size:
                    held[n].append((node[own], piece[own] & MASK[min(n, 8)], value[alive[own]]))
            marks.append((node, np.left_shift(1, left).astype(np.uint16)))
            own = np.flatnonzero(left == ON)
            own = own[np.lexsort((piece[own], node[own]))]
            alive, node, piece = alive[own], node[own], piece[own]
            new = np.ones(len(own), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (piece[1:] != piece[:-1])
            child = (nodes + np.cumsum(new) - 1).astype(np.uint32)
            if own.size:
                held[ON].append((node[new], piece[new], child[new]))
            node, nodes, depth = child, nodes + int(new.sum()), depth + 8
        self.pieces = {n: _Pieces(*map(np.concatenate, zip(*h, strict=True))) for n in list(held) if (h := held.pop(n))}
        self.marks = np.zeros(nodes, dtype=np.uint16)
        for node, mark in marks:
            np.bitwise_or.at(self.marks, node, mark)

    def _long(self) -> np.ndarray:
        """Puts patterns of over LONG bytes in order, each with the longest other that it begins with; one of each head."""
        own = np.flatnonzero(self.sizes > LONG)
        texts = self.needles.take(pa.array(own)).cast(pa.large_binary()).to_pylist()
        order = sorted(range(len(texts)), key=texts.__getitem__)
        self.long, self.long_pattern, self.before = [texts[i] for i in order], own[order], []
        heads, open_ = [], []
        for i, x in enumerate(self.long):
            while open_ and not x.startswith(self.long[open_[-1]]):
                open_.pop()
            self.before.append(open_[-1] if open_ else -1)
            open_.append(i)
            if not i or x[:LONG] != self.long[i - 1][:LONG]:
                heads.append(i)
        self.heads = [*heads, len(texts)]
        self.longest = [max(map(len, self.long[a:b])) for a, b in zip(self.heads, self.heads[1:], strict=False)]
        return self.long_pattern[heads]

    def _after(self, heads: np.ndarray, places: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The long patterns that begin where their heads do: all that begin the bytes there are in the row of `before` from the last that comes not after these bytes."""
        patterns, at = [], []
        for head, place in zip(heads.tolist(), places.tolist(), strict=True):
            here = data[place : place + self.longest[head]].tobytes()
            i = bisect_right(self.long, here, self.heads[head], self.heads[head + 1]) - 1
            i = i if i >= self.heads[head] else -1
            while i >= 0 and not here.startswith(self.long[i]):
                i = self.before[i]
            while i >= 0:
                patterns.append(i)
                at.append(place)
                i = self.before[i]
        return self.long_pattern[np.array(patterns, dtype=np.int64)], np.array(at, dtype=np.int64)

    def _rules(self, rules: pa.Table) -> None:
        """Rules in the order of their groups, ranks and labels, so that the least of a group has the least number; and their numbers by pattern."""
        order = [(c, "ascending") for c in ("grp", "rank", "label")]
        self.rules = rules.take(pc.sort_indices(rules, sort_keys=order, null_placement="at_start")).combine_chunks()
        of = self.rules.column("needle").to_numpy()
        self.group = pc.rank(self.rules.column("grp"), tiebreaker="dense").to_numpy()
        self.by_pattern = np.argsort(of, kind="stable")
        self.rules_at = np.searchsorted(of[self.by_pattern], np.arange(len(self.needles) + 1))

    def begun(self, data: np.ndarray, windows: np.ndarray, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Patterns and the places from `start` to `end` where they begin, each time a pattern is given with all its places; patterns may run over the end of a text."""
        here, size = np.array(windows[start:end]), len(windows) - 8
        at, node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        for n, begins, bits, follows in self.filters:
            near = np.flatnonzero(begins.take(_hashed(0, here & MASK[n], bits), mode="clip"))
            for k in follows if near.size else ():
                which, value = self.pieces[k].find(0, here[near] & MASK[min(k, 8)])
                if k < ON:
                    yield value, near[which] + start
                else:
                    at, node = near[which] + start, value
        depth = 8
        while at.size:
            inside = np.flatnonzero(at + depth < size)
            at, node = at[inside], node[inside]
            piece, marks = windows[at + depth], self.marks.take(node)
            for n in (*range(1, ON), HEAD):
                if (own := np.flatnonzero(marks & (1 << n))).size:
                    which, value = self.pieces[n].find(node[own], piece[own] & MASK[min(n, 8)])
                    yield self._after(value, at[own[which]], data) if n == HEAD else (value, at[own[which]])
            own = np.flatnonzero(marks & (1 << ON))
            if not own.size:
                return
            which, value = self.pieces[ON].find(node[own], piece[own])
            at, node, depth = at[own[which]], value, depth + 8

    def found(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """A row for each pattern in each text, by pattern and text: pattern, text (their numbers), n (left to right, without overlaps), first (place of the first in characters, from 1)."""
        data, windows, ends = _bytes(texts)
        size = len(windows) - 8
        bits = np.uint64(max(1, size.bit_length()))
        row_of = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0)) if len(ends) > 1 else np.broadcast_to(np.int32(0), size)
        none = np.zeros(0, dtype=np.int64)
        held, fresh, waiting = (none.astype(np.uint64), none, none), [], 0
        for start in range(0, size, STEP):
            for pattern, at in self.begun(data, windows, start, min(size, start + STEP)):
                whole = at + self.sizes.take(pattern) <= ends.take(row_of[at])
                fresh.append((pattern[whole].astype(np.uint64) << bits) | at[whole].astype(np.uint64))
                waiting += len(fresh[-1])
                if waiting > max(MOST, len(held[0])):
                    held, fresh, waiting = self._counted(held, fresh, row_of, bits), [], 0
        key, n, first = self._counted(held, fresh, row_of, bits)
        pattern, row = (key >> bits).view(np.int64), row_of[first]
        chars = np.cumsum(data[:size].view(np.int8) >= -64, dtype=np.int32)  # bytes that begin a character
        begin = np.concatenate([[0], ends[:-1]])[row]
        return pattern, row, n, (chars[first] - chars[begin] + 1).astype(np.int64)

    def _counted(self, held: tuple[np.ndarray, ...], fresh: list[np.ndarray], row_of: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, ...]:
        """For each pattern in each text: the key (pattern and place) of the last that counts, how many count, the first place. `fresh` ones lie behind the held of their pattern."""
        key, least = np.concatenate([held[0], *fresh]), (np.uint64(1) << bits) - np.uint64(1)
        if len(held[0]):
            n, first = np.ones(len(key), dtype=np.int64), (key & least).view(np.int64)
            n[: len(held[0])], first[: len(held[0])] = held[1:]
            order = np.argsort(key)
            key, n, first = key[order], n[order], first[order]
            at = (key & least).view(np.int64)
        else:
            key.sort()
            first = at = (key & least).view(np.int64)
            n = np.ones(len(key), dtype=np.int64)
        if not key.size:
            return held
        pattern, row = (key >> bits).view(np.int64), row_of[at]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (pattern[1:] != pattern[:-1]) | (row[1:] != row[:-1])
        close = np.flatnonzero(~new[1:] & (at[1:] - at[:-1] < self.sizes.take(pattern[1:]))) + 1
        if close.size:  # some overlap: these patterns in these texts are gone through from left to right
            group, counts = np.cumsum(new) - 1, np.ones(len(key), dtype=bool)
            some = np.zeros(int(group[-1]) + 1, dtype=bool)
            some[group[close]] = True
            some, free = np.flatnonzero(some[group]), 0
            for i, other, place, length in zip(some.tolist(), new[some].tolist(), at[some].tolist(), self.sizes[pattern[some]].tolist(), strict=True):
                if other or place >= free:
                    free = place + length
                else:
                    counts[i] = False
            key, n, first, new = key[counts], n[counts], first[counts], new[counts]
        starts = np.flatnonzero(new)
        return key[np.append(starts[1:], len(key)) - 1], np.add.reduceat(n, starts), first[starts]


_held: tuple = (None, None)


def _table(path: str, block: int, size: int) -> _Table:
    """The table of a block; a worker holds the last one."""
    global _held
    if _held[0] != (path, block):
        from pyarrow import fs, parquet

        _held = (None, None)
        files, base = fs.FileSystem.from_uri(path)
        found = [i.path for i in files.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True)) if i.path.endswith(".parquet")]
        read = [parquet.ParquetFile(files.open_input_file(p)).read(["needle", "grp", "rank", "label"]) for p in found]
        if (n := sum(map(len, read))) != size:
            raise OSError(f"{path}: block {block} has {n} of {size} patterns")
        _held = ((path, block), _Table(pa.concat_tables(read)))
        pa.default_memory_pool().release_unused()
    return _held[1]


def _slices(whole: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of which the texts in column `at` go through together."""
    sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < whole.num_rows:
        before = ends[start] - sizes[start]
        n = min(ROWS, max(1, int(np.searchsorted(ends, before + CHARS, side="right")) - start))
        yield whole.slice(start, n)
        start += n


def _scan(p: Patterns, texts: DataFrame, keys: list[str], text: Column | str, schema: StructType, put: Callable) -> DataFrame:
    """What `put` makes of the runs of rows of a task (their keys, and what a block's table finds in their texts), block by block. Null texts are empty."""
    text = F.col(text) if isinstance(text, str) else text
    # Keys go by number through the workers: a name may hold dots.
    rows = texts.select(*(F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)), F.coalesce(text.cast("string"), F.lit("")).alias("_text"))
    out = None
    path, many = p.path, len(keys)

    def passes(block: int, size: int) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _table(path, block, size)
            runs = ((run, table.found(run.column(many))) for whole in batches for run in _slices(whole, many))
            yield from put(table, runs)

        return scan

    for block, size in sorted(p.sizes.items()):
        one = rows.mapInArrow(passes(block, size), schema)
        out = one if out is None else out.unionByName(one)
    return p.spark.createDataFrame([], schema) if out is None else out


def _keyed(texts: DataFrame, keys: list[str], columns: str) -> tuple[StructType, list[str]]:
    """The schema of keys (by number) and new columns, and their names."""
    added = StructType.fromDDL(columns)
    clash = {k.lower() for k in keys} & set(added.names)
    if clash:
        raise ValueError(f"keys may not be named {sorted(clash)}")
    own = texts.select(*(F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys))).schema.fields
    return StructType([*own, *added.fields]), [*keys, *added.names]


def occurrences(p: Patterns, texts: DataFrame, keys: list[str], text: Column | str) -> DataFrame:
    """A row for each row of texts and each needle in it: keys, needle, n (occurrences, left to right, without overlaps), first (place of the first, from 1)."""
    schema, names = _keyed(texts, keys, "needle string, n bigint, first bigint")

    def put(table: _Table, runs: Iterator) -> Iterator[pa.RecordBatch]:
        for run, found in runs:
            for start in range(0, len(found[0]), GIVEN):
                pattern, row, n, first = (x[start : start + GIVEN] for x in found)
                given = [run.column(k).take(pa.array(row)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*given, table.needles.take(pa.array(pattern)), pa.array(n), pa.array(first)], names=schema.names)

    return _scan(p, texts, keys, text, schema, put).toDF(*names)


def totals(p: Patterns, texts: DataFrame, ident: str, text: Column | str) -> DataFrame:
    """A row for each needle in any text: needle, texts (that hold it), n and first as of `occurrences` (their sum and least), least (the least `ident`, a whole number, of these texts).
    A task adds up its texts before anything is shuffled: where needles and texts grow, they meet far more often than either has rows."""
    kind = texts.select(F.col(f"`{ident}`")).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{ident} is no whole number")
    schema = StructType.fromDDL("needle string, texts bigint, n bigint, first bigint, least bigint")

    def put(table: _Table, runs: Iterator) -> Iterator[pa.RecordBatch]:
        many, most = len(table.needles), np.iinfo(np.int64).max
        held, total, named = (np.zeros(many, dtype=t) for t in (np.int64, np.int64, bool))
        place, least = (np.full(many, most) for _ in range(2))
        for run, (pattern, row, n, first) in runs:
            if not len(pattern):
                continue
            starts = np.flatnonzero(np.diff(pattern, prepend=-1))
            own = pattern[starts]
            ids, known = pc.fill_null(run.column(0).cast(pa.int64()), most).to_numpy(), run.column(0).is_valid().to_numpy(zero_copy_only=False)
            held[own] += np.diff(starts, append=len(pattern))
            total[own] += np.add.reduceat(n, starts)
            place[own] = np.minimum(place[own], np.minimum.reduceat(first, starts))
            least[own] = np.minimum(least[own], np.minimum.reduceat(ids[row], starts))
            named[own] |= np.logical_or.reduceat(known[row], starts)
        own = np.flatnonzero(held)
        for start in range(0, len(own), GIVEN):
            part = own[start : start + GIVEN]
            sums = [held[part], total[part], place[part]]
            yield pa.RecordBatch.from_arrays([table.needles.take(pa.array(part)), *map(pa.array, sums), pa.array(least[part], mask=~named[part])], names=schema.names)

    found = _scan(p, texts, [ident], text, schema, put).groupBy("needle")
    return found.agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min("least").cast(kind).alias("least"))


def labelled(p: Patterns, texts: DataFrame, keys: list[str], text: Column | str, groups: tuple[str, ...]) -> DataFrame:
    """keys (which tell rows apart) and a column for each group of rules: the label of least rank (of equals the least label) whose needle is in the text, null for none."""
    if not p.sizes:
        return texts.select(*(F.col(f"`{k}`") for k in keys), *(F.lit(None).cast("string").alias(g) for g in groups))
    schema, names = _keyed(texts, keys, "grp string, rank bigint, label string")

    def put(table: _Table, runs: Iterator) -> Iterator[pa.RecordBatch]:
        for run, (pattern, row, _, _) in runs:
            start = table.rules_at[pattern]
            many = table.rules_at[pattern + 1] - start
            rule = table.by_pattern[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]
            row, rule = np.divmod(np.unique(np.repeat(row, many) * np.int64(len(table.group)) + rule), max(1, len(table.group)))
            least = (np.diff(row, prepend=-1) != 0) | (np.diff(table.group[rule], prepend=0) != 0)
            row, rule = row[least], rule[least]
            none = np.setdiff1d(np.arange(run.num_rows), row)
            row, rule = np.concatenate([row, none]), pa.array(np.concatenate([rule, none]), mask=np.arange(len(row) + len(none)) >= len(row))
            given = [run.column(k).take(pa.array(row)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*given, *(table.rules.column(c).combine_chunks().take(rule) for c in ("grp", "rank", "label"))], names=schema.names)

    rows = _scan(p, texts, keys, text, schema, put).toDF(*names)
    least = [F.min(F.when(F.col("grp") == g, F.struct("rank", "label")))["label"].alias(g) for g in groups]
    return rows.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*least)


def images_of(articles: DataFrame, images: DataFrame, slug: str = "slug") -> DataFrame:
    """(id, image_id): the newest image (of equals the largest id) whose stem holds the article's slug. A slug is looked for once, however many articles have it."""
    asked = articles.select("id", F.col(slug).alias("needle")).where("needle <> ''")
    met = occurrences(build(asked.select("needle")), images, ["image_id", "mtime"], "stem")
    newest = met.groupBy("needle").agg(F.max(F.struct("mtime", "image_id"))["image_id"].alias("image_id"))
    return asked.join(newest, "needle").select("id", "image_id")


def word_rules(grp: str, table: dict[str, tuple[str, ...]], words: bool = False) -> list[tuple[str, str, int, str]]:
    """Rules (needle, grp, rank, label) in the order of a table. With `words`, for folded texts between spaces: a needle of one word is a whole word."""
    return [(f" {a} " if words and " " not in a else a, grp, rank, label) for rank, (label, aliases) in enumerate(table.items()) for a in aliases]
