"""Session helpers: the shared folder, written intermediate tables, Arrow batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch as shared_dir

#: Bytes of one Arrow batch handed to Python; long texts make 10,000-row batches too large.
BATCH_BYTES = 8 << 20


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # shuffle files of finished steps go when the driver notices that nothing refers to them
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the folders of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as Spark reads it."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores before it as make it differ from the columns taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def bucket_of(doc_id: str, mod: int):
    """crc32 of the id's decimal text, modulo mod: the stable train / held-out split."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % mod
