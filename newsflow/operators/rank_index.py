"""A stored order of a table: pages, ranks and moves read the ranges that they touch.

The rows are dealt out by ranges of the order and written sorted, a folder a range; the counts of the ranges (one number each, on the driver) say
where each begins. A page reads the ranges that it lies in, mostly one and two at most unless it is larger than a range; the rank
of a row is a look into one bucket of a table of places. A move changes the places of two neighbours: it is a small file that only one
writer can create, and the list of moves, read by the driver, says which row stands where. `build` again when it has grown long.

Positions are whole numbers of 64 bits from 1 on. Ids are unique; the order is one of all rows (end it with the id).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import create_once, names_in, scratch

BUCKETS = 64


@dataclass
class Ranked:
    spark: SparkSession
    path: str
    schema: StructType
    ident: str
    starts: list[tuple[int, int, int]]  # range, rows before it, its rows
    _shown: dict[int, int] = field(default_factory=dict)  # position -> place in the stored order, where they differ
    _read: int = 0

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.starts)

    def _moves(self) -> dict[int, int]:
        """The moves made so far, by this writer or others."""
        for name in names_in(self.spark, f"{self.path}/moves")[self._read :]:
            i, j = json.loads(self.spark.read.text(f"{self.path}/moves/{name}", wholetext=True).first()[0])
            self._shown[i], self._shown[j] = self._shown.get(j, j), self._shown.get(i, i)
            self._read += 1
        return self._shown

    def _stored(self, places: list[int]) -> DataFrame:
        """Rows at places of the stored order, with `_at`; places are few or a run."""
        low, high = min(places), max(places)
        spread = high - low + 1 != len(set(places))
        asked = [(p, b, n) for p, b, n in self.starts if any(b < x <= b + n for x in places)] if spread else [(p, b, n) for p, b, n in self.starts if b < high and low <= b + n]
        out = None
        for part, before, n in asked:
            rows = self.spark.read.schema(StructType(list(self.schema.fields)).add("_place", "long")).parquet(f"{self.path}/rows/_part={part}")
            inside = (F.col("_place") >= max(low - before - 1, 0)) & (F.col("_place") < min(high - before, n))
            rows = rows.where(inside).withColumn("_at", F.col("_place") + (before + 1)).drop("_place")
            out = rows if out is None else out.unionByName(rows)
        return out.where(F.col("_at").isin(places)) if spread else out

    def page(self, number: int = 1, size: int = 12, name: str = "pos") -> DataFrame:
        """Rows of a page with their positions; the number is clamped to the pages there are."""
        number = max(1, min(number, -(-self.total // size) or 1))
        wanted = range((number - 1) * size + 1, min(number * size, self.total) + 1)
        if not wanted:
            return self.spark.createDataFrame([], StructType(list(self.schema.fields)).add(name, "long"))
        shown = {p: self._moves().get(p, p) for p in wanted}
        moved = {at: p for p, at in shown.items() if at != p}
        near = [at for at in shown.values() if wanted[0] <= at <= wanted[-1]]
        rows = self._stored(near if len(near) < len(wanted) else list(wanted)) if near else None
        far = [at for at in shown.values() if not wanted[0] <= at <= wanted[-1]]
        if far:
            more = self._stored(far)
            rows = more if rows is None else rows.unionByName(more)
        position = F.col("_at")
        for at, p in moved.items():
            position = F.when(F.col("_at") == at, F.lit(p).cast("bigint")).otherwise(position)
        return rows.withColumn(name, position).drop("_at")

    def rank(self, ident: object) -> int | None:
        """The position of a row, None if there is no such row."""
        bucket = self.spark.range(1).select(_bucket(F.lit(ident).cast(self.schema[self.ident].dataType))).first()[0]
        if f"_bucket={bucket}" not in names_in(self.spark, f"{self.path}/places"):
            return None
        kind = self.schema[self.ident].dataType.simpleString()
        found = self.spark.read.schema(f"`{self.ident}` {kind}, _part int, _place bigint").parquet(f"{self.path}/places/_bucket={bucket}").where(F.col(self.ident) == ident).first()
        if found is None:
            return None
        at = next(b for p, b, _ in self.starts if p == found["_part"]) + found["_place"] + 1
        return next((p for p, x in self._moves().items() if x == at), at)

    def move(self, ident: object, step: int) -> tuple[int, int] | None:
        """The row changes place with the one `step` further on: both positions; None at an edge, where nothing moves."""
        while True:
            i = self.rank(ident)
            if i is None:
                raise ValueError("the article is not in the list")
            if not 1 <= i + step <= self.total or not step:
                return None
            # Another writer's move in between makes this name exist: look again.
            if create_once(self.spark, f"{self.path}/moves", f"move-{self._read:09d}", json.dumps([i, i + step])):
                self._moves()
                return i, i + step

    def rows(self, name: str = "pos") -> DataFrame:
        """All rows with their positions, in place of a column of that name."""
        starts = self.spark.createDataFrame([(p, b) for p, b, _ in self.starts], "_part int, _before bigint")
        moved = self.spark.createDataFrame([(at, p) for p, at in self._moves().items()], "_at bigint, _shown bigint")
        rows = self.spark.read.schema(StructType(list(self.schema.fields)).add("_place", "long").add("_part", "integer")).parquet(f"{self.path}/rows")
        rows = rows.join(starts, "_part").withColumn("_at", F.col("_before") + F.col("_place") + 1).join(moved, "_at", "left")
        return rows.select(*(c for c in self.schema.names if c != name), F.coalesce("_shown", "_at").alias(name))


def _bucket(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(BUCKETS)).cast("int")


def build(df: DataFrame, order: list[Column], ident: str = "id") -> Ranked:
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranked")
    df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_place")).write.partitionBy("_part").parquet(f"{path}/rows")
    schema = StructType(list(df.schema.fields))
    rows = spark.read.schema(StructType(list(schema.fields)).add("_place", "long").add("_part", "integer")).parquet(f"{path}/rows")
    rows.select(ident, "_part", "_place", _bucket(F.col(ident)).alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/places")
    before, starts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a range
        starts.append((part, before, n))
        before += n
    return Ranked(spark, path, schema, ident, starts)
