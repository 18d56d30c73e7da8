"""Capped water-filling: source targets by weight, none above its cap, and a seeded mix that meets them.

Targets. All sources together get `share` of all words. By weight, the level rises until the first sources reach their cap
(`epochs` times their size); what they cannot take rises the others. With sources in the order of cap / weight the full ones
are a prefix, so one pass of running sums over the (few) sources gives the fixed point of the redistribution.
Mix. A target is a whole number of repetitions of the source and a rest. The rest is drawn in the seeded order of hashed ids:
documents are whole until the last one, which is taken in part, so a source meets its target to the word. Only word sums of
BUCKETS hash ranges per source are ordered; documents are compared with each other inside the one range where the rest ends. Rows of one id and size, which may have
different texts, are ordered by a hash of the whole row (maps aside), so reruns take the same words of the same rows.

Defined cases: null texts have size 0; null is a source, the last one; a source of size 0 has target 0; equal rows are taken
like others, which of them comes first does not show in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import quoted, written

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1"
BUCKETS = 4096


def n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("bigint")


def order_key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds target. One row per source is ordered in one task: sources, not documents."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("cap", epochs * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight")).withColumn("all", share * F.sum("source_size").over(everything))
    below = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.col("all") - below) / rest).withColumn("n", F.row_number().over(by_room))
    level = F.min_by(F.when(F.col("room") > F.col("level"), F.col("level")), F.when(F.col("room") > F.col("level"), F.col("n"))).over(everything)
    df = df.withColumn("water", level)
    full = F.col("water").isNull() | (F.col("room") <= F.col("water"))
    return df.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("water"))).select("source", "source_size", "target")


def plan(measured: DataFrame, **how) -> DataFrame:
    """measured: source, size, h. Per source: target, whole repetitions, words of the rest, and where in hash order the rest ends."""
    ranges = written(measured.groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("words")), "mix-ranges")
    goal = written(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **how), "mix-targets")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0).cast("bigint"))).withColumnRenamed("source", "_s")
    ends = sums.join(goal.select("source", "rest"), F.col("_s").eqNullSafe(F.col("source"))).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    ends = ends.groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by("before", "bucket").alias("before")).withColumnRenamed("source", "_s")
    out = goal.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return written(out.withColumnRenamed("source", "_source"), "mix-plan")


def _bucket() -> Column:
    return F.conv(F.substring("h", 1, 3), 16, 10).cast("int")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED, columns: list[str] | None = None, **how) -> DataFrame:
    """docs (or the given columns of it) with size, source_size, target and taken, the words that the mix takes of each row.

    Columns of docs that are named like one of these four, in any case, are replaced; all others stay, whatever their names.
    The plan has a row per source; Spark broadcasts it below its own threshold, else shuffles.
    """
    made = {"size", "source_size", "target", "taken"}
    kept = [c for c in (columns or docs.columns) if c in docs.columns and c.lower() not in made]
    row = F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept))).alias("row") if kept else F.lit(None).alias("row")
    whole = [F.col(quoted(c)) for c in kept if "map<" not in docs.schema[c].dataType.simpleString()]
    wide = docs.select(row, F.xxhash64(*whole).alias("tie") if whole else F.lit(0).cast("bigint").alias("tie"), F.col(quoted(source)).alias("_src"), n_words(quoted(text)).alias("size"), order_key(quoted(doc_id), seed))
    # Without the texts the rows are small: sizes are counted once and written. With them, counting twice is cheaper than copying all texts.
    wide = wide if text in kept else written(wide, "mix-sizes")
    measured = wide.select(F.col("_src").alias("source"), "size", "h")
    goal = plan(measured, **how)
    df = wide.withColumn("bucket", _bucket()).join(goal, F.col("_src").eqNullSafe(F.col("_source")))
    inside = F.col("bucket") == F.col("cut")
    here = Window.partitionBy("_src", "bucket").orderBy("h", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(here), zero)
    part = df.where(inside).withColumn("extra", F.least("size", F.greatest(left, zero)))
    whole = df.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(zero))
    out = part.unionByName(whole)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))
