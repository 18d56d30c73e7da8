"""The corpus pipeline: five operators, each on all that its predecessor kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes every stage to the shared
folder and reads it again as the next one's documents, so a lost executor costs a task and never an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import decontamination, mixing, ngram_join, quality_classifier, suffix_dedup
from newsflow.llm._session import bucket_of, free_name, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go; columns of the documents named score or predicted stay theirs."""
    model = quality_classifier.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(bucket_of("doc_id", 4) != 2))
    own = {c: free_name(c, docs.columns) for c in docs.columns if c.lower() in ("score", "predicted")}
    kept = quality_classifier.score(docs.withColumnsRenamed(own), model).where(F.col("predicted") == 1).drop("score", "predicted")
    return kept.withColumnsRenamed({new: old for old, new in own.items()})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat, however short the words, are cut out of the texts, and n_chars follows the text."""
    cut = suffix_dedup.deduplicate(docs, passage=suffix_dedup.PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs


#: The classifier and the MinHash join are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None
