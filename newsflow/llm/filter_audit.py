"""Filter interaction audit: what each of five filters removes, in every order that they can be applied in.

A document's failures are a mask of five bits. What a filter meets does not depend on the order of the filters before it, only on
which they are: documents contribute to the 80 edges (subset already applied, next filter) of the subset lattice, and each of the
120 orders is a path of five edges. Documents are counted by part and mask first, so edges are made from 32 rows a part at most;
the 600 steps of the orders (a table of fixed size) are then joined to the edges.

A duplicate fails filter E: its text equals that of a smaller id. The least id of a text is found with partial sums on the way to
the shuffle, and rows are matched with it on (text, id): no key of that join has more rows than one id has sources, however
many copies a text has.

Defined cases: null texts are empty; a null source is the part ''; rows without an id are neither smaller than others nor
duplicates; repeated rows count as often as they occur, with one id none of them is the smaller; labels that occur more than once
for an id count as set if any is; an empty table gives an empty result. Other columns of the tables do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import quoted, written

SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


#: Failure conditions on the text alone, by letter; the letter after them stands for duplicates.
TEXT_FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 200,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 50 * F.size(_words(t)),
    "C": lambda t: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("bigint") > 2 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
}
DUPLICATE = "E"


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = TEXT_FILTERS, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """part, mask (bit i: fails filter i; the highest bit: duplicate), n, good, toxic."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    bits = [F.when(F.coalesce(fails(body), F.lit(False)), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    rows = docs.select(F.coalesce(F.col(quoted(source)).cast("string"), F.lit("")).alias("part"), F.col(quoted(doc_id)).alias("id"), F.unhex(F.sha2(F.encode(body, "UTF-8"), 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    rows = written(rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.expr("quality <=> 1").cast("int")).alias("good"), F.max(F.expr("toxic <=> 1").cast("int")).alias("toxic"))
    found = rows.join(firsts, ["digest", "id"], "left").join(marks, "id", "left")
    later = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 1 << len(filters)).otherwise(0)
    count = lambda column: F.sum(F.col("n") * F.coalesce(F.col(column), F.lit(0))).alias(column)
    return found.groupBy("part", (F.col("mask") + later).alias("mask")).agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def edges(counted: DataFrame, n_filters: int) -> DataFrame:
    """One row per part, subset of applied filters and next filter, with what that filter meets there."""
    subsets = counted.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(2**n_filters - 1)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n_filters - 1))))
    bit = F.expr("shiftleft(1, filter)")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("subset")) != 0
    total = lambda column, where, name: F.sum(F.when(where, F.col(column)).otherwise(0)).alias(name)
    met = subsets.where(F.col("subset").bitwiseAND(bit) == 0).groupBy("part", "subset", "filter").agg(
        total("n", ~gone & ~fails, "kept"), total("n", ~gone & fails, "removed"), total("n", gone & fails, "redundant"), total("n", F.col("mask") == bit, "unique_fails"),
        total("good", ~gone & fails, "good_lost"), total("toxic", ~gone & fails, "toxic_lost"),
    )
    before = F.bit_count("subset")
    orders = F.factorial(before) * F.factorial(n_filters - 1 - before)
    return met.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = TEXT_FILTERS, duplicate: str = DUPLICATE, **columns: str) -> DataFrame:
    """One row per part, order and step. `filters` maps letters to failure conditions on a text column; `duplicate` is one letter more."""
    letters = "".join(filters) + duplicate
    steps = [
        ("".join(letters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f)
        for order in itertools.permutations(range(len(letters)))
        for k, f in enumerate(order)
    ]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, subset int, filter int")
    lattice = edges(masks(docs, labels, filters, **columns), len(letters))
    # broadcast: the orders of the filters, 600 rows for five, whatever the input
    return lattice.join(F.broadcast(paths), ["subset", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
