"""Keyed tables that batches are merged into: hashed buckets of Parquet, one manifest a version.

A version is one small file, `version-N`: which folder holds each bucket, which folders hold rows without a key, which batches are in it.
A batch reads and writes again the buckets that its keys fall into and no others; its rows without a key are appended in a folder of their
own. The data of a batch is complete before the next version is made, by a rename that fails if that version exists. So a writer that
breaks off leaves the last version as it was, of two writers one wins and the other starts again from the new version, and
readers of a version are not disturbed. What no version refers to goes with `clean`.

The driver handles bucket numbers (BUCKETS at most) and batch names, never rows. A key has its rows in one bucket; rows
without a key, which may be many, are in none.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import create_once, scratch

BUCKETS = 64
TRIES = 5
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Version:
    number: int
    schema: str
    keys: list[str]
    n_buckets: int
    buckets: dict[str, str] = field(default_factory=dict)
    loose: list[str] = field(default_factory=list)
    batches: dict[str, str] = field(default_factory=dict)
    next_id: int = 1


class Stored:
    """A table under `path`, a new folder in the shared one if none is given."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "stored")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # Files ------------------------------------------------------------------------------------------------------------
    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, start: str) -> list[str]:
        files = self._files()
        return sorted(n for n in (s.getPath().getName() for s in files.listStatus(self._at(""))) if n.startswith(start)) if files.exists(self._at("")) else []

    def _publish(self, v: Version) -> bool:
        """Makes the version, unless it exists."""
        return create_once(self.spark, self.path, f"version-{v.number:09d}", json.dumps(v.__dict__))

    def version(self, number: int | None = None) -> Version:
        """The manifest of a version, by default the last."""
        name = f"version-{number:09d}" if number is not None else (self._names("version-") or [""])[-1]
        if not name:
            raise FileNotFoundError(f"no table in {self.path}")
        return Version(**json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]))

    # Rows -------------------------------------------------------------------------------------------------------------
    @staticmethod
    def _has_key(keys: list[str]) -> Column:
        test = F.lit(True)
        for k in keys:
            test = test & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
        return test

    @staticmethod
    def _bucket(keys: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(n)).cast("int")

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)))
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self._read(v.schema, [*v.buckets.values(), *v.loose])

    def lookup(self, *key: object) -> DataFrame:
        """The rows of one key: one bucket is read."""
        v = self.version()
        asked = self.spark.createDataFrame([tuple(map(str, key))], ", ".join(f"`{k}` string" for k in v.keys))
        bucket = asked.select(self._bucket(v.keys, v.n_buckets)).first()[0]
        rows = self._read(v.schema, [v.buckets[str(bucket)]] if str(bucket) in v.buckets else [])
        for k, x in zip(v.keys, key, strict=True):
            rows = rows.where(F.col(k).cast("string") == str(x))
        return rows

    def _write(self, rows: DataFrame, v: Version, touched: list[int] | None) -> tuple[dict[str, str], list[str]]:
        """Writes keyed rows by bucket (none if touched is empty) and the others; the folders of both."""
        folder = f"data-{uuid.uuid4().hex}"
        bucket = F.when(self._has_key(v.keys), self._bucket(v.keys, v.n_buckets)).otherwise(-1)
        # Rows without a key are dealt out by all columns: they would be one task else.
        deal = F.when(F.col("_bucket") < 0, F.xxhash64(*(c for c, t in rows.dtypes if "map<" not in t))).otherwise(F.col("_bucket"))
        rows.withColumn("_bucket", bucket).repartition("_bucket", deal).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = [n.getPath().getName() for n in self._files().listStatus(self._at(folder)) if n.isDirectory()]
        numbers = {int(n.removeprefix("_bucket=")): f"{folder}/{n}" for n in made if n.startswith("_bucket=")}
        keyed = {str(b): numbers[b] for b in (touched if touched is not None else numbers) if b in numbers and b >= 0}
        return keyed, [numbers[-1]] if -1 in numbers else []

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS, ident: str | None = None) -> Version:
        """Version 0. With `ident`, rows that batches add are numbered from the largest value of this column on."""
        v = Version(0, rows.schema.json(), keys, buckets)
        v.buckets, v.loose = self._write(rows, v, None)
        if ident:
            v.next_id = (self._read(v.schema, [*v.buckets.values(), *v.loose]).agg(F.max(ident)).first()[0] or 0) + 1
        if not self._publish(v):
            raise ValueError(f"there is a table in {self.path}")
        return v

    def commit(self, batch: str, rows: DataFrame, merge: Merge, ident: str | None = None, place: str | None = None) -> list[int] | None:
        """Merges a batch; the buckets written, or None if the batch was committed before (with other rows it raises).

        `merge` gets the stored rows of the batch's buckets and the batch's rows with a key, and again no stored rows and those without one;
        it returns the table's columns. New rows have a null `ident`; they are numbered in the order of `place`, a column that merge adds.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch name has letters, digits, '_', '.' and '-' only")
        rows.write.parquet(path := f"{self.path}/_batch-{uuid.uuid4().hex}")  # read several times below
        rows = self.spark.read.schema(rows.schema).parquet(path)
        has_key = self._has_key(self.version().keys)
        mark = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.count_if(~has_key)).first()
        digest = f"{mark[0]}:{mark[1] or 0}"
        for _ in range(TRIES):
            v = self.version()
            if batch in v.batches:
                if v.batches[batch] != digest:
                    raise ValueError(f"batch {batch} was committed with other rows")
                return None
            keyed, loose = rows.where(has_key), rows.where(~has_key)
            touched = sorted(r[0] for r in keyed.select(self._bucket(v.keys, v.n_buckets)).distinct().collect())  # bucket numbers
            old = self._read(v.schema, [v.buckets[str(b)] for b in touched if str(b) in v.buckets])
            merged = merge(old, keyed)
            if mark[2]:
                merged = merged.unionByName(merge(self._read(v.schema, []), loose))
            columns = [f.name for f in StructType.fromJson(json.loads(v.schema))]
            added = 0
            if ident and place:
                merged, added = self._identified(merged, ident, place, v.next_id)
            folders, without = self._write(merged.select(*columns), v, touched)
            new = Version(v.number + 1, v.schema, v.keys, v.n_buckets, v.buckets | folders, v.loose + without, v.batches | {batch: digest}, v.next_id + added)
            if self._publish(new):
                return touched
        raise RuntimeError(f"other writers were faster {TRIES} times")

    def _identified(self, merged: DataFrame, ident: str, place: str, start: int) -> tuple[DataFrame, int]:
        """New rows numbered from `start` in order of their place, by ranges of the order and not in one window."""
        from ..operators.articles import numbered

        merged.write.parquet(path := f"{self.path}/_merged-{uuid.uuid4().hex}")
        merged = self.spark.read.schema(merged.schema).parquet(path)
        new = merged.where(F.col(ident).isNull())
        ranked = numbered(new.drop(ident), [F.col(place).asc()], ident, "bigint").withColumn(ident, F.col(ident) + (start - 1))
        return merged.where(F.col(ident).isNotNull()).unionByName(ranked), new.count()

    def clean(self) -> int:
        """Removes older versions and all data that the last one does not refer to; the number of folders and files removed. No batch may be running."""
        v, files = self.version(), self._files()
        used = {f.split("/")[0]: set() for f in (*v.buckets.values(), *v.loose)}
        for f in (*v.buckets.values(), *v.loose):
            used[f.split("/")[0]].add(f.split("/")[1])
        gone = [n for n in self._names("version-") if n != f"version-{v.number:09d}"] + [n for n in self._names("_")] + [n for n in self._names("data-") if n not in used]
        for folder, kept in used.items():
            gone += [f"{folder}/{n}" for n in (s.getPath().getName() for s in files.listStatus(self._at(folder))) if n.startswith("_bucket=") and n not in kept]
        for name in gone:
            files.delete(self._at(name), True)
        return len(gone)


def last_wins(keys: list[str], order: str) -> Merge:
    """Rows replaced whole by the last row of their key in the batch."""

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), order).alias("r")).select("r.*")
        return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last)

    return merge


def upsert_articles(store: Stored, batch: str, rows: DataFrame, now: str) -> list[int] | None:
    """One crawl into a stored article table keyed by url: new articles are pending and numbered in the order of `ord`."""
    from ..operators.articles import upsert

    trimmed = rows.withColumn("url", F.trim(F.coalesce("url", F.lit(""))))
    return store.commit(batch, trimmed, lambda old, new: upsert(old, new, now, place=True), "id", "ord")
