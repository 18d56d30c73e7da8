"""Delta-maintained token rollups: additive totals by source, language and tokenizer version.

A batch is a set of signed rows: +1 inserts a document's count, -1 deletes it, a revision is the old row with -1 and the new
one with +1. Committing a batch sums its rows by key (map-side sums; a hot source costs one row per task) and writes the
sums as a new folder; then it creates the batch's commit file, which names the folder and a digest of the sums. Creating the file
is one step that only one writer can take: a batch that broke off has no commit file and its folder counts for nothing, of two writers
of one batch the second finds the file. A batch that is committed again changes nothing; if its sums are others than those
committed, it raises an error.
`compact` sums committed batches into one folder and then creates one file that names it and the batches it stands for.
Totals are the sums over the newest such folder and the batches committed since.

Defined cases: null sources, languages and versions are keys of their own; null counts are 0; keys whose documents and tokens
both cancel to 0 are not shown; a store without commits is empty; repeated rows in a batch count each; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._session import quoted, shared_dir

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def space_words(text: str) -> Column:
    """Tokenizer `space-1`: runs of anything but ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(quoted(text)), F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("bigint")


def alnum_words(text: str) -> Column:
    """Tokenizer `alnum-1`: runs of ASCII letters and digits and of characters outside ASCII."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(quoted(text)), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")).cast("bigint")


def bpe_tokens(text: str, vocabulary: str) -> Column:
    """Tokens of a public tokenizer file (tokenizers' JSON format) whose path every worker can read."""

    @pandas_udf("bigint")
    def count(texts):  # type: ignore[no-untyped-def]
        import pandas as pd
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        sizes: list[int] = []
        for i in range(0, len(texts), 64):
            sizes += [len(x.ids) for x in t.encode_batch(texts.iloc[i : i + 64].tolist(), add_special_tokens=False)]
        return pd.Series(sizes, dtype="int64")

    return count(F.coalesce(F.col(quoted(text)), F.lit("")))


class Rollups:
    """Totals in a folder that all executors and the driver reach."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "rollups")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self, name: str) -> dict | None:
        path, fs = self._fs()
        at = path(f"{self.path}/{name}")
        if not fs.exists(at):
            return None
        text = self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()
        return json.loads(text[0]) if text else None

    def _create(self, name: str, content: dict) -> bool:
        """Writes a file that must not be there yet, under another name first; the rename is the commit. False if it is there."""
        path, fs = self._fs()
        end, begun = path(f"{self.path}/{name}"), path(f"{self.path}/_{uuid.uuid4().hex}")
        stream = fs.create(begun, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            done = not fs.exists(end) and fs.createNewFile(path(f"{self.path}/_lock-{name}")) and fs.rename(begun, end)
        finally:
            fs.delete(begun, False)
        return bool(done)

    def _write(self, sums: DataFrame) -> tuple[str, str]:
        """The folder of the sums, and an order-free digest of them."""
        folder = f"data-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{folder}")
        row = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}").agg(F.count("*"), F.sum(F.xxhash64(*KEYS, "docs", "tokens").cast("decimal(38,0)"))).first()
        return folder, f"{row[0]}:{row[1] or 0}"

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """rows: source, lang, tokenizer, tokens, sign. False if the batch was committed before with the same sums; with others it raises."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        sign = F.col("sign").cast("bigint")
        sums = rows.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(F.sum(sign).alias("docs"), F.sum(sign * F.coalesce(F.col("tokens"), F.lit(0))).alias("tokens"))
        folder, digest = self._write(sums.where("docs <> 0 or tokens <> 0"))
        if self._create(f"commit-{batch}", {"folder": folder, "digest": digest}):
            return True
        path, fs = self._fs()
        fs.delete(path(f"{self.path}/{folder}"), True)
        before = self._read(f"commit-{batch}")
        if before is None:
            raise RuntimeError(f"another writer is committing batch {batch}, or broke off while it did; remove _lock-commit-{batch} to let it be committed")
        if before["digest"] != digest:
            raise ValueError(f"batch {batch} was committed with other rows")
        return False

    def _names(self, kind: str) -> list[str]:
        path, fs = self._fs()
        root = path(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if n.startswith(kind))

    def _folders(self) -> tuple[list[str], list[str]]:
        """The folders that the totals are sums of, and the batches in them."""
        compacted = self._names("compact-")
        base = self._read(compacted[-1]) if compacted else {"folder": None, "batches": []}
        new = [n for n in self._names("commit-") if n not in set(base["batches"])]
        return [f for f in (base["folder"], *(self._read(n)["folder"] for n in new)) if f], [*base["batches"], *new]

    def compact(self) -> None:
        """One folder for all that is committed now; later totals read this one and what comes after."""
        folders, batches = self._folders()
        number = len(self._names("compact-"))
        if len(folders) > 1:
            folder, digest = self._write(self._sum(folders))
            self._create(f"compact-{number:09d}", {"folder": folder, "digest": digest, "batches": batches})

    def _sum(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._folders()[0])


def signed(docs: DataFrame, tokenizer: str, tokens: Column, sign: int, source: str = "source", lang: str = "lang") -> DataFrame:
    return docs.select(F.col(quoted(source)).alias("source"), F.col(quoted(lang)).alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), F.lit(sign).alias("sign"))


def revision(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace those of `before` by those of `after`."""
    return before.withColumn("sign", -F.col("sign")).unionByName(after)
