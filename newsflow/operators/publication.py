"""Media items of a publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import publishing as pb
from ..functions.text import clean


def media_items(batches: DataFrame, articles: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """One row for each position of (publication_id, article_ids, image_paths), with texts of the article and its image.

    Lists of different lengths raise an error; ids without an article give no row; `invalid` marks articles that have no
    caption (no title, or a url that is not http). captions (id, caption) replace the built ones where not blank.
    """
    n = F.size("article_ids")
    checked = F.when(n == F.size("image_paths"), F.arrays_zip("article_ids", "image_paths")).otherwise(F.raise_error(F.lit("articles and image paths differ in number")))
    rows = batches.select("publication_id", F.posexplode(checked).alias("p", "z")).select("publication_id", (F.col("p") + 1).alias("order_index"), F.col("z.article_ids").alias("article_id"), F.trim(F.coalesce("z.image_paths", F.lit(""))).alias("_path"))
    rows = rows.join(articles.withColumnRenamed("id", "article_id"), "article_id")
    http = pb.is_http_url("_path")
    rows = rows.withColumn("_caption", pb.photo_caption("order_index", "title", "summary", "source", "url"))
    own = F.lit(None).cast("string")
    if captions is not None:
        rows = rows.join(captions.select(F.col("id").alias("article_id"), F.col("caption").alias("_own")), "article_id", "left")
        own = F.when(clean("_own") != "", pb.caption_text("_own"))
    return rows.select(
        "publication_id", "order_index", "article_id", *(F.trim(F.coalesce(c, F.lit(""))).alias(a) for c, a in (("title", "title"), ("summary", "summary"), ("source", "source_name"), ("url", "source_url"))),
        F.when(http, F.col("_path")).otherwise("").alias("image_url"), F.when(http, "").otherwise(F.col("_path")).alias("local_image_path"),
        F.coalesce(own, "_caption").alias("photo_caption"), F.col("_caption").isNull().alias("invalid"),
    )
