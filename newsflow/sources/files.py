"""Article files: CSV and JSON in and out, one folder for each value of a field, dated snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, slugify
from ..operators import articles as ar
from ..shared import scratch  # noqa: F401

ARTICLE = ("source", "title", "url", "crawled_at", "published_at", "thumbnail", "summary", "summary_source", "newspaper_type", "content_topic", "category")
#: How both ways write a text: quotes doubled, white space at the ends kept.
CSV = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Texts that a CSV scan reads as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _article_columns(df: DataFrame) -> list[Column]:
    return [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in ARTICLE]


def project(df: DataFrame) -> DataFrame:
    """The eleven article columns as texts: others go, absent ones are ''."""
    return df.select(*_article_columns(df))


def write_csv(df: DataFrame, path: str, files: int | None = None, mark: bool = False) -> None:
    """Article columns with a header. `files` bounds the number of files; without it every partition writes its own.

    With `mark` every file begins with a byte order mark, as spreadsheet programs want it; the mark is part of the first header.
    """
    rows = project(df)
    rows = rows.coalesce(files) if files else rows
    rows = rows.withColumnRenamed(ARTICLE[0], "\ufeff" + ARTICLE[0]) if mark else rows
    rows.write.mode("overwrite").options(**CSV).csv(path)


def is_blank(spark: SparkSession, path: str) -> bool:
    """No more than one line that is not blank: nothing but a header."""
    return len(spark.read.text(path).where(F.trim(F.regexp_replace("value", "[\ufeff\r\t]", " ")) != "").take(2)) <= 1


def read_csv(spark: SparkSession, path: str, na: bool = True) -> DataFrame:
    """Article texts of a CSV with a header; line feeds in quotes are text. With `na`, marks of missing values become ''.

    Columns are found by the names in the header, in any order; absent ones are ''.
    """
    rows = project(spark.read.options(**CSV, multiLine=True, inferSchema=False).csv(path))
    return rows.select(*(F.when(F.col(c).isin(*MISSING), "").otherwise(F.col(c)).alias(c) for c in ARTICLE)) if na else rows


def write_json_array(df: DataFrame, path: str) -> None:
    """One text file that holds the articles as an array, an object a line: for readers that want a whole document. Texts go through one writer,
    a line at a time; nothing is collected."""
    rows = df.withColumn("_ord", F.monotonically_increasing_id()).select(F.col("_ord"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    edges = df.sparkSession.createDataFrame([(-1, "["), (2**62, "]")], "_ord long, value string")
    first = F.col("_ord") == rows.agg(F.min("_ord")).first()[0]
    rows = rows.select("_ord", F.when(first, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    rows.union(edges).repartition(1).sortWithinPartitions("_ord").select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, all columns, non-ASCII as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, limit: int | None = None, array: bool = False) -> DataFrame:
    """Objects by line, or with `array` one array of objects a file."""
    rows = project(spark.read.option("multiLine", array).option("primitivesAsString", True).json(path))
    return rows.limit(limit) if limit else rows


def field_files(df: DataFrame, field: str) -> DataFrame:
    """Rows with `file`, the slug of the field ('Khác' where empty). Of different values with one slug the last by code point is kept.

    The values that win are found by an aggregate of one row each, so no group meets in a task.
    """
    key = F.coalesce(filled(field), F.lit("Khác"))
    rows = df.withColumn("_key", key).withColumn("file", slugify("_key"))
    wins = rows.groupBy("file", "_key").agg(F.lit(1).alias("_one"))
    wins = wins.groupBy("file").agg(F.max("_key").alias("_key"))
    return rows.join(wins, ["file", "_key"], "left_semi").drop("_key")


def write_by_field(df: DataFrame, field: str, path: str) -> None:
    """One folder `file=<slug>` for each value; what the path held before goes."""
    rows = field_files(df, field)
    rows.select("file", *_article_columns(rows)).write.mode("overwrite").options(**CSV).partitionBy("file").csv(path)


def write_snapshot(articles: DataFrame, new: DataFrame, date: str, path: str) -> str:
    """The four files of one day: all and new articles as JSON and as CSV."""
    base = f"{path.rstrip('/')}/daily/{date}"
    for name, rows in (("articles", articles), ("new_articles", new)):
        write_json(project(rows), f"{base}/raw/{name}.json")
        write_csv(rows, f"{base}/exports/{name}.csv")
    return base


def write_outputs(latest: DataFrame, master: DataFrame, date: str, path: str) -> DataFrame:
    """A whole run: latest and new rows, fields, the snapshot of the day. Returns the new rows, written before they are used again."""
    spark, base = latest.sparkSession, path.rstrip("/")
    ar.new_rows(latest, master).write.mode("overwrite").parquet(f"{base}/new")
    new = spark.read.parquet(f"{base}/new")
    write_json(project(latest), f"{base}/raw/articles.json")
    write_csv(latest, f"{base}/exports/articles.csv")
    for field in ("source", "newspaper_type", "content_topic", "category"):
        write_by_field(latest, field, f"{base}/by_{field}")
    write_snapshot(latest, new, date, base)
    return new


def keep_newest(paths: DataFrame, n: int = 14, order: str = "modified") -> DataFrame:
    """Which backups stay: the newest n (columns path, one row each, and the order column). A top-n, not a window over all."""
    newest = paths.orderBy(F.desc(order), F.desc("path")).limit(n).select("path", F.lit(True).alias("kept"))
    return paths.join(newest, "path", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
