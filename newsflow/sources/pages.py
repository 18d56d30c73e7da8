"""Pages of several sources as one table, in which what could not be fetched is a row and not a failed job.

`archive` lays answers out by source; the data source `newsflow_pages` reads them, a file a partition, so a large source has many. Each
url is asked up to ATTEMPTS times while the answer is one that may pass; the wait grows with the attempt. A page that stays
unanswered, a file that cannot be read and a source without any are rows with an `error`; the other rows are not touched by them.

A transport is a function from the attempt (1, 2, ..) to an answer (status, reason, body), status 0 where there was no connection;
the archive plays answers back in the order in which they came. Only names of files go through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Answers after which another attempt is made, attempts in all, seconds before the second one.
RETRIED = (0, 429, 500, 502, 503, 504)
ATTEMPTS, BACKOFF = 3, 1.0

Answer = tuple[int, str, bytes | None]
ANSWERS = "source string, url string, answers array<struct<status: int, reason: string, body: binary>>"
FETCHED = "source string, url string, status int, attempts int, html string, error string"


def settle(ask: Callable[[int], Answer], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep, backoff: float = BACKOFF) -> tuple[int, int, str | None, str | None]:
    """(status, attempts made, html, error) of a page."""
    made = 0
    while True:
        made += 1
        status, reason, body = ask(made)
        if 200 <= status < 400:
            return status, made, (body or b"").decode("utf-8", "replace"), None
        if status not in RETRIED or made >= attempts:
            return status, made, None, f"HTTP {status} {reason}".rstrip() if status else reason or "no connection"
        if backoff:
            wait(backoff * made)


@dataclass
class _File(InputPartition):
    source: str
    path: str | None
    error: str | None = None

    def __post_init__(self) -> None:
        super().__init__(self.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.sources = options["sources"].split("\n") if options.get("sources") else []
        self.attempts, self.backoff = int(options.get("attempts", ATTEMPTS)), float(options.get("backoff", 0))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        out: dict[str, list[InputPartition]] = {s: [] for s in self.sources}
        for info in found:
            folder, _, name = info.path.removeprefix(base).strip("/").partition("/")
            source = unquote(folder.partition("=")[2])
            if info.is_file and name.endswith(".parquet") and (not self.sources or source in out):
                out.setdefault(source, []).append(_File(source, info.path))
        return [p for s, parts in out.items() for p in parts or [_File(s, None, "nothing archived")]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            yield _rows([(partition.source, None, None, 0, None, partition.error)])
            return
        from pyarrow import fs, parquet

        try:
            files, _ = fs.FileSystem.from_uri(self.path)
            with files.open_input_file(partition.path) as f:
                for batch in parquet.ParquetFile(f).iter_batches(256, columns=["url", "answers"]):
                    yield _rows([self._one(partition.source, r["url"], r["answers"] or []) for r in batch.to_pylist()])
        except (OSError, pa.ArrowException) as e:
            yield _rows([(partition.source, None, None, 0, None, f"{partition.path.rpartition('/')[2].partition('.')[0][:10]}: {type(e).__name__}")])

    def _one(self, source: str, url: str, answers: list[dict]) -> tuple:
        def ask(attempt: int) -> Answer:
            if attempt > len(answers):
                return 0, "not archived", None
            a = answers[attempt - 1]
            return a["status"] or 0, a["reason"] or "", a["body"]

        return source, url, *settle(ask, self.attempts, backoff=self.backoff)


_SCHEMA = pa.schema([("source", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("attempts", pa.int32()), ("html", pa.string()), ("error", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsflow_pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def archive(answers: DataFrame, path: str, rows_a_file: int = 10_000) -> None:
    """Answers (source, url, answers in the order in which they came) by source; a source has as many files as its rows need."""
    answers.select("source", "url", "answers").write.option("maxRecordsPerFile", rows_a_file).partitionBy("source").parquet(path)


def crawl(spark: SparkSession, path: str, sources: list[str] | None = None, attempts: int = ATTEMPTS, backoff: float = 0) -> DataFrame:
    """All pages of the archive, or of the sources named, of which each has a row at least."""
    spark.dataSource.register(Pages)
    read = spark.read.format("newsflow_pages").option("path", path).option("attempts", attempts).option("backoff", backoff)
    return (read.option("sources", "\n".join(sources)) if sources else read).load()


def fetched(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL").drop("error")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("source", "url", "attempts", "error")


def by_source(rows: DataFrame) -> DataFrame:
    """Pages fetched and failed of every source, with its most frequent error (the first by name of equals)."""
    counted = rows.groupBy("source", "error").agg(F.count("*").alias("n"))
    pages = F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n"))), F.lit(0)).alias("pages")
    failed = F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0)).alias("failed")
    worst = F.min(F.when(F.col("error").isNotNull(), F.struct((-F.col("n")).alias("n"), "error")))["error"].alias("worst")
    return counted.groupBy("source").agg(pages, failed, worst)
