"""A stored index of short character sequences (grams) for searches inside texts.

Postings: for each gram, group of fields and block of rows, the ids that have it; they lie in hashed buckets of grams, sorted by gram, so
a search reads the buckets of its grams. A common gram has many short lists, not a long one, and lists meet block by block. A block is a run of rows
as a task reads them, so lists are made where the texts are and nothing is shuffled.
A search takes its rarest grams (RAREST at most), intersects their lists, and looks at the texts of the rows that are left: the
grams say where to look, the text decides. A needle without a gram is compared with every text. Needles that would together read more than
LISTS ids for each row of the table are looked for the other way round: they become tables (see `patterns`) that the stored texts stream past.

Ids are unique. Texts of a group are folded once, when the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_lower, normalize
from ..shared import scratch
from . import patterns

BUCKETS, BLOCK, RAREST = 16, 4096, 3
#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 1 << 21
LISTS = 8
GRAMS = (3,)


def folded(*fields: str) -> Column:
    """The search fold of several fields as one text; a mark that no folded text has keeps them apart, spaces show whole words."""
    return F.concat_ws("|", *(F.concat(F.lit(" "), normalize(c), F.lit(" ")) for c in fields))


def lowered(*fields: str) -> Column:
    """What LIKE compares, of several fields; marks keep them apart."""
    return F.concat_ws("\n\x00\n", *(ascii_lower(F.coalesce(F.col(c), F.lit(""))) for c in fields))


def _pieces(text: Column, size: int) -> Column:
    """All runs of `size` characters. Characters are zipped with those after them: places inside a long text are not looked for one by one."""
    chars = F.array_remove(F.split(text, ""), "")
    out = chars
    for k in range(1, size):
        out = F.zip_with(out, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.filter(out, lambda g: g.isNotNull())


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    sizes: tuple[int, ...]
    kind: str  # of the ids
    groups: tuple[str, ...]

    def _table(self, name: str) -> DataFrame:
        schema = {"texts": f"id {self.kind}, grp string, text string", "postings": f"{self._lists}, bucket int", "counts": "grp string, gram string, n bigint"}
        return self.spark.read.schema(schema[name]).parquet(f"{self.path}/{name}")

    @property
    def _lists(self) -> str:
        return f"grp string, gram string, block bigint, ids array<{self.kind}>"

    def texts(self) -> DataFrame:
        """id, grp, text of all rows."""
        return self._table("texts")

    def grams_of(self, needles: DataFrame) -> DataFrame:
        """needles (grp, needle, parts: literal pieces of the needle) with the grams to look up, how many they are, and the rows that have each."""
        longest = F.lit(None).cast("array<string>")
        for size in sorted(self.sizes):
            longest = F.when(F.length("part") >= size, _pieces(F.col("part"), size)).otherwise(longest)
        grams = needles.select("grp", "needle", F.explode("parts").alias("part")).select("grp", "needle", F.explode(longest).alias("gram")).distinct()
        rare = Window.partitionBy("grp", "needle").orderBy(F.coalesce("n", F.lit(0)), "gram")
        counted = grams.join(self._table("counts"), ["grp", "gram"], "left").withColumn("_k", F.row_number().over(rare)).where(F.col("_k") <= RAREST)
        return counted.withColumn("wanted", F.count("*").over(Window.partitionBy("grp", "needle"))).select("grp", "needle", "gram", "wanted", F.coalesce("n", F.lit(0)).alias("n"))

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(grp, needle, id) of the rows that have all the grams looked up; every row for needles without a gram."""
        asked = self.grams_of(needles).drop("n")
        met = asked.withColumn("bucket", _bucket("gram")).join(self._table("postings"), ["bucket", "grp", "gram"])
        lists = met.groupBy("grp", "needle", "block").agg(F.max("wanted").alias("wanted"), F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("wanted"))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        found = lists.select("grp", "needle", F.explode(both).alias("id"))
        short = needles.join(asked.select("grp", "needle"), ["grp", "needle"], "left_anti").select("grp", "needle")
        return found.unionByName(short.join(self.texts().select("grp", "id"), "grp"))

    def find(self, needles: DataFrame, holds: Column) -> DataFrame:
        """(grp, needle, id) where `holds`, of the columns needle and text, is true."""
        return self.candidates(needles).join(self.texts(), ["grp", "id"]).where(holds).select("grp", "needle", "id")

    def are_many(self, needles: DataFrame) -> bool:
        """Whether the needles would read more than LISTS ids for each row."""
        return (self.grams_of(needles).agg(F.sum("n")).first()[0] or 0) > LISTS * self.texts().count()

    def streamed(self, needles: DataFrame) -> DataFrame:
        """(grp, needle, id) of the texts that hold the only piece of a needle: texts stream past the needles."""

        def of(grp: str) -> DataFrame:
            pieces = needles.where(F.col("grp") == grp).select(F.element_at("parts", 1).alias("needle"))
            found = patterns.occurrences(patterns.build(pieces), self.texts().where(F.col("grp") == grp), ["id"], "text")
            return found.select(F.lit(grp).alias("grp"), F.trim("needle").alias("needle"), "id")

        return reduce(DataFrame.unionByName, map(of, self.groups))


def _lists_of(size: int, grp: str, block: int, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """The lists of one block: each run of `size` characters inside a text with the ids of its texts, each once."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    row, end = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths), np.repeat(np.cumsum(lengths), lengths)
    starts = np.flatnonzero(np.arange(len(chars)) + size <= end)
    row = row[starts]
    seen = np.zeros(0x110000, dtype=bool)
    seen[chars] = True
    letters, number = np.flatnonzero(seen), np.cumsum(seen, dtype=np.uint64) - np.uint64(1)
    if max(1, len(letters)) ** size * len(texts) < 1 << 64:  # gram and row are one number
        key, most = np.zeros(len(starts), dtype=np.uint64), np.uint64(len(letters))
        for k in range(size):
            key = key * most + number[chars[starts + k]]
        key = np.sort(key * np.uint64(len(texts)) + row)
        key = key[np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))]
        code, row = np.divmod(key, np.uint64(len(texts)))
        first = np.flatnonzero(np.diff(code, prepend=code[:1] + np.uint64(1)))
        code, parts = code[first], []
        for _ in range(size):
            code, last = np.divmod(code, most)
            parts.insert(0, letters[last])
        grams = np.stack(parts, axis=1)
    else:
        pairs = np.unique(np.stack([*(chars[starts + k] for k in range(size)), row], axis=1), axis=0)
        first = np.flatnonzero(np.diff(pairs[:, :size], axis=0, prepend=pairs[:1, :size] + 1).any(axis=1))
        grams, row = pairs[first, :size], pairs[:, size]
    joined = grams.astype(np.uint32).tobytes().decode("utf-32-le")
    names = [joined[i : i + size] for i in range(0, len(joined), size)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), ids.take(pa.array(row)))
    columns = [pa.array([grp] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([block] * len(names), pa.int64()), lists]
    return pa.RecordBatch.from_arrays(columns, names=["grp", "gram", "block", "ids"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, chars: int) -> Iterator[tuple[str, pa.Array, list[str]]]:
    """grp, ids and texts of runs of rows of a group (grp, id, text; no nulls), of so many rows and characters at most."""
    held: dict[str, tuple[list, list[str]]] = {}
    sizes: dict[str, int] = {}
    kind = None
    for whole in batches:
        kind = whole.column(1).type
        for start in range(0, whole.num_rows, 500):
            for grp, ident, text in zip(*(c.to_pylist() for c in whole.slice(start, 500).columns), strict=True):
                ids, texts = held.setdefault(grp, ([], []))
                if ids and (len(ids) >= rows or sizes[grp] + len(text) > chars):
                    yield grp, pa.array(ids, kind), texts
                    ids, texts = held[grp] = ([], [])
                ids.append(ident)
                texts.append(text)
                sizes[grp] = len(text) + (sizes[grp] if len(ids) > 1 else 0)
    for grp, (ids, texts) in held.items():
        yield grp, pa.array(ids, kind), texts


def build(rows: DataFrame, groups: dict[str, Column], ident: str = "id", sizes: tuple[int, ...] = GRAMS) -> Index:
    """The index of a table: for each group the text that searches of it look at."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "search")
    pairs = F.array(*(F.struct(F.lit(g).alias("grp"), text.alias("text")) for g, text in groups.items()))
    rows.select(F.col(ident).alias("id"), F.explode(pairs).alias("x")).select("id", "x.grp", "x.text").write.parquet(f"{path}/texts")
    index = Index(spark, path, sizes, rows.schema[ident].dataType.simpleString(), tuple(groups))
    most, chars = BLOCK, BLOCK_CHARS

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, (grp, ids, texts) in enumerate(_blocks(batches, most, chars)):
            for size in sizes:
                yield _lists_of(size, grp, first + n, ids, texts)

    made = index.texts().where(F.col("text").isNotNull()).select("grp", "id", "text").mapInArrow(lists, index._lists)
    made.withColumn("bucket", _bucket("gram")).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    index._table("postings").groupBy("grp", "gram").agg(F.sum(F.size("ids")).alias("n")).write.parquet(f"{path}/counts")
    return index


def folded_parts() -> Column:
    """The literal piece of a folded needle: up to two characters are a whole word."""
    n = F.col("needle")
    return F.array(F.when(F.length(n) <= 2, F.concat(F.lit(" "), n, F.lit(" "))).otherwise(n))


def holds_folded() -> Column:
    return F.col("text").contains(F.element_at(folded_parts(), 1))


def search(index: Index, needles: DataFrame) -> DataFrame:
    """needles: grp, needle (folded, not empty). The rows that hold each: grp, needle, id."""
    asked = needles.select("grp", "needle").where("needle <> ''").distinct().withColumn("parts", folded_parts())
    return index.streamed(asked) if index.are_many(asked) else index.find(asked, holds_folded())


def search_like(index: Index, grp: str, pattern: str) -> DataFrame:
    """Ids of the rows of which a field of the group fits a LIKE pattern with ASCII case folding (`%`, `_`, no escape character)."""
    low = pattern.translate(str.maketrans(UPPER, LOWER))
    needle = index.spark.createDataFrame([(grp, low, [p for p in low.replace("_", "%").split("%") if p])], "grp string, needle string, parts array<string>")
    escaped = low.replace("\\", "\\\\")
    return index.find(needle, F.exists(F.split("text", "\n\\x00\n"), lambda t: t.like(escaped))).select("id")
