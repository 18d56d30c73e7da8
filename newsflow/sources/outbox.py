"""Requests to posting and message services: kept once for each key, sent by runs that may break off, answered once.

The outbox is a log of small entries, `log-N`, each made by a rename that fails if N exists: requests of a batch, claims of a run, answers
of a run, with the data files that belong to it. Files are written by the data source `newsflow_outbox`: a task writes one file under
a new name, the commit notes the files of the tasks that counted, an abort removes those it is told of. So files of failed or
repeated tasks are in no entry, and a batch that comes again adds nothing.

A run first claims the requests that no run has claimed, then sends those and no others; of two runs at once one claims and the other
takes what is left. A run that broke off goes on under its name. A request is a photo, a post or a message; photos and messages
are sent again until they are answered, and the transport gets their key, by which a service knows a repeat. A post is sent once: where
its answer was lost, by a broken connection, a lost task or a run that broke off, it is `uncertain` and left to a person.

A transport is a function from a request (dict) and the attempt (1, 2, ..) to (status, code, message, reference): the HTTP status, 0
where there was no connection, the service's error code (None for none) and text, and the id that it gave.
The driver handles names of files and entries, never requests.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.publishing import error_class
from ..shared import create_once, names_in, scratch

# HTTP statuses and error codes after which another attempt is made, codes after which none is, attempts in all, the longest wait in seconds.
RETRIED_STATUSES = (429, 500, 502, 503, 504)
RETRIED_CODES = (1, 2, 4, 17, 32, 341, 613)
REFUSED_CODES = (10, 190, 200, 463, 467)
ATTEMPTS, LONGEST_WAIT = 4, 8

TRIES = 5
REQUEST = "key string, target string, operation string, payload string"
ANSWER = "key string, outcome string, reference string, attempts int, status int, code int, message string"
_ANSWER = pa.schema([("key", pa.string()), ("outcome", pa.string()), ("reference", pa.string()), ("attempts", pa.int32()), ("status", pa.int32()), ("code", pa.int32()), ("message", pa.string())])
Answer = tuple[int, int | None, str, str]
Transport = Callable[[dict, int], Answer]


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.token = options["path"], options["token"]

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import parquet

        files, base = self._files()
        name, out = f"part-{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        files.create_dir(f"{base}/data", recursive=True)
                        out = parquet.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=files)
                    out.write_batch(batch)
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{base}/data/{name}")
            raise
        if out is not None:
            out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._files()
        with files.open_output_stream(f"{base}/{self.token}") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._files()
        for m in messages:
            if m and m.name:
                files.delete_file(f"{base}/data/{m.name}")


class _Sink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsflow_outbox"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def settle(request: dict, transport: Transport, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> tuple:
    """The answer of a request: key, outcome (sent, failed, uncertain), reference, attempts made, and the last status, code and message."""
    made = 0
    while True:
        made += 1
        status, code, message, reference = transport(request, made)
        if 200 <= status < 400 and code is None:
            return request["key"], "sent", reference, made, status, None, ""
        if status == 0 and request["operation"] == "post":
            return request["key"], "uncertain", "", made, 0, code, message
        passing = status == 0 or status in RETRIED_STATUSES or code in RETRIED_CODES
        if code in REFUSED_CODES or not passing or made >= attempts:
            return request["key"], "failed", "", made, status, code, message
        wait(min(2 ** (made - 1), LONGEST_WAIT))


def _sender(transport: Transport, attempts: int, wait: Callable[[float], None], resumed: bool) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = resumed or TaskContext.get().attemptNumber() > 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lost = again and r["operation"] == "post"
                rows.append((r["key"], "uncertain", "", 0, 0, None, "answer lost") if lost else settle(r, transport, attempts, wait))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)] if rows else [pa.array([], f.type) for f in _ANSWER], schema=_ANSWER)

    return send


class Outbox:
    """An outbox under `path`, a new folder in the shared one if none is given."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "outbox")
        spark.dataSource.register(_Sink)

    def _log(self) -> list[dict]:
        names = [n for n in names_in(self.spark, self.path) if n.startswith("log-")]
        if not names:
            return []
        lines = self.spark.read.text([f"{self.path}/{n}" for n in names], wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        return [json.loads(r["value"]) for r in sorted(lines.collect(), key=lambda r: r["name"])]  # names of files, not rows

    def _rows(self, log: list[dict], kind: str, name: str | None = None) -> DataFrame:
        schema = ANSWER if kind == "answers" else REQUEST
        files = [f"{self.path}/data/{f}" for e in log if e["kind"] == kind and name in (None, e["name"]) for f in e["files"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> list[str]:
        token = f"files-{uuid.uuid4().hex}"
        rows.write.format("newsflow_outbox").mode("append").option("path", self.path).option("token", token).save()
        return json.loads(self.spark.read.text(f"{self.path}/{token}", wholetext=True).first()[0])

    def _add(self, kind: str, name: str, files: Callable[[list[dict]], list[str]]) -> bool:
        """Adds an entry, of which there is one for each kind and name; False if it is there. `files` gets the log that the entry follows."""
        for _ in range(TRIES):
            log = self._log()
            if any(e["kind"] == kind and e["name"] == name for e in log):
                return False
            if create_once(self.spark, self.path, f"log-{len(log):09d}", json.dumps({"kind": kind, "name": name, "files": files(log)})):
                return True
        raise RuntimeError(f"other writers were faster {TRIES} times")

    def enqueue(self, batch: str, rows: DataFrame) -> bool:
        """Keeps requests (key, target, operation, payload); False if the batch was kept before.

        Keys that the outbox has are left out. Of rows of one key the least by operation, target and payload is kept. A null or
        empty key becomes a digest of the row, so equal rows without a key are one request. Null texts are empty.
        """
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        own = F.sha2(F.to_json(F.array("operation", "target", "payload")), 256)
        asked = rows.select(*(text(c).alias(c) for c in ("key", "target", "operation", "payload"))).withColumn("key", F.when(F.col("key") == "", own).otherwise(F.col("key")))
        one = asked.groupBy("key").agg(F.min(F.struct("operation", "target", "payload")).alias("r")).select("key", "r.target", "r.operation", "r.payload")
        return self._add("requests", batch, lambda log: self._write(one.join(self._rows(log, "requests").select("key"), "key", "left_anti")))

    def requests(self) -> DataFrame:
        return self._rows(self._log(), "requests")

    def deliver(self, run: str, transport: Transport, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> bool:
        """Sends what no other run has claimed; False if this run was answered before."""
        free = lambda log: self._rows(log, "requests").join(self._rows(log, "claims").select("key"), "key", "left_anti")
        fresh = self._add("claims", run, lambda log: self._write(free(log)))
        log = self._log()
        if any(e["kind"] == "answers" and e["name"] == run for e in log):
            return False
        # Claims hold whole requests: nothing is shuffled in the stage that sends, so only an attempt of a task can send again.
        answers = self._rows(log, "claims", run).mapInArrow(_sender(transport, attempts, wait, not fresh), ANSWER)
        files = self._write(answers)
        return self._add("answers", run, lambda _: files)

    def answers(self) -> DataFrame:
        """One row for each request that was sent, with the class of its error (null for none)."""
        failed: Column = F.col("outcome") == "failed"
        return self._rows(self._log(), "answers").withColumn("class", F.when(failed, error_class("code", "message")))

    def unanswered(self) -> DataFrame:
        log = self._log()
        return self._rows(log, "requests").join(self._rows(log, "answers").select("key"), "key", "left_anti")
