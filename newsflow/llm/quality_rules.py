"""Host-level quality rules, in DataFrame expressions only.

Each document gets counts and the rules it fails. Failures are summed by host (map-side sums, so a host with a third of
all rows is no group anywhere), each host's rate of every rule is shrunk to a beta prior fitted to all hosts by moments,
and hosts whose shrunk rate of some rule exceeds `limit` are rejected with all their documents.
The counts are written once and used twice: for the hosts and for the join of the verdicts.

Repeated 8-word windows are found without a shuffle: window hashes by doubling (pairs of words, pairs of pairs, ...),
sorted with their positions inside the document's own array; only texts with an equal pair of hashes sort at all.

Defined cases: a null text has no words and fails the length rule; a null host is a host of its own; repeated rows count
each; an empty table gives an empty result; without variance between hosts the prior takes all weight that it may (PRIOR_MAX).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import quoted, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Host rate above which its documents go, and bounds of the prior's weight in documents.
LIMIT, PRIOR_MIN, PRIOR_MAX = 0.6, 2.0, 1000.0
RULES = ("short", "repeats", "symbols", "dup_lines", "odd_words")


def _next(a: str, step: int) -> Column:
    """Hashes of spans twice as long: the span at i and the one `step` words later. Trailing spans that do not fit hold nulls."""
    return F.zip_with(a, F.slice(F.col(a), step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def repeated_words(windows: str) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array."""
    placed = F.sort_array(F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    both = F.zip_with(placed, F.slice(placed, 2, F.size(windows)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total).cast("bigint")


def counts(docs: DataFrame, text: str, doc_id: str, host: str) -> DataFrame:
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    df = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(host)).alias("host"), t.alias("text"))
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    df = df.select(
        "doc_id", "host", F.array_remove(F.split("text", SPACE, -1), "").alias("words"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        long(F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"), long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"))
    df = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    df = df.select("*", _next("h1", 1).alias("h2")).drop("h1")
    df = df.select("*", _next("h2", 2).alias("h4")).drop("h2")
    df = df.select("*", F.slice(_next("h4", 4), F.lit(1), F.greatest(F.size("h4") - (WINDOW - 1), F.lit(0))).alias("h8")).drop("h4")
    return df.select(
        "doc_id", "host", long(F.size("words")).alias("n_words"), "word_chars", "n_symbols", long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.when(F.size("h8") > 1, repeated_words("h8")).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    c = F.col
    return {
        "short": c("n_words") < 20,
        "repeats": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "odd_words": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
    }


def hosts(counted: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per host: its documents, the shrunk rate of every rule, and the verdict."""
    sums = written(counted.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(x.cast("int")).alias(r) for r, x in rules().items())), "quality-hosts")
    moments = sums.agg(*(f(F.col(r) / F.col("n")).alias(f"{r}_{k}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_samp)))).first()
    out = sums
    for r in RULES:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        weight = min(max(m * (1 - m) / v - 1, PRIOR_MIN), PRIOR_MAX) if v > 0 else PRIOR_MAX
        out = out.withColumn(f"{r}_rate", (F.col(r) + m * weight) / (F.col("n") + weight))
    return out.withColumn("rejected", F.greatest(*(F.col(f"{r}_rate") for r in RULES)) > limit)


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", limit: float = LIMIT) -> DataFrame:
    """Per document: its counts, whether it fails the base rules, its host's verdict, and whether it is kept."""
    counted = written(counts(docs, text, doc_id, host), "quality-counts")
    verdict = written(hosts(counted, limit).select(F.col("host").alias("_host"), F.col("rejected").alias("host_rejected")), "quality-verdicts")
    base = rules()["short"] | rules()["repeats"]
    out = counted.join(verdict, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~F.col("host_rejected"))
