"""Answers to chat messages by a model: articles packed into a budget, prompts, providers asked in order, a fallback, and the log.

A provider is a name and a function from a prompt to a text; one that raises or says nothing is passed over and noted. Prompts are dealt out
among tasks and asked one after the other in each. A lost task asks again; the log keeps one answer for each message and run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.publishing import HOUSE
from ..functions.text import filled
from ..sources.stored import Stored, last_wins

# Articles that a prompt may hold and that a fallback lists, and the longest message, answer, logged answer and summary of a line.
MOST, LISTED = 12, 5
MESSAGE_CHARS, ANSWER_CHARS, LOGGED_CHARS, LINE_CHARS = 500, 2500, 3000, 180
UNKNOWN_TOPIC, NO_SUMMARY = "Chưa phân loại", "Chưa có tóm tắt."

#: What a prompt says before the message, and what a fallback says before its list, by intent. Parameters, not results to match.
RULES = "Chỉ dùng các bài viết dưới đây để trả lời, ngắn gọn, bằng tiếng Việt, kèm nguồn và liên kết. Không thêm dữ kiện nào khác. Nếu không có bài phù hợp, hãy nói như vậy."
LEADS = {"summarize": "Chưa có bản tóm tắt, đây là các bài mới:", "recommend": "Chưa có xếp hạng, đây là các bài mới:", "": "Các bài liên quan:"}
NOTHING = "Chưa tìm thấy bài liên quan."

Provider = tuple[str, Callable[[str], str]]
LOG = "conv_id bigint, turn bigint, message string, answer string, mode string, provider string, created_at string"


def entry(house: str = HOUSE) -> Column:
    """An article in a prompt."""
    topic = F.coalesce(filled("content_topic"), filled("category"), F.lit(UNKNOWN_TOPIC))
    head = F.concat_ws(" | ", F.coalesce("title", F.lit("")), F.coalesce(filled("source"), F.lit(house)), topic, F.coalesce("url", F.lit("")))
    return F.concat(head, F.lit("\n"), F.coalesce(filled("summary"), F.lit(NO_SUMMARY)))


def line(house: str = HOUSE) -> Column:
    """An article in a list."""
    topic = F.coalesce(filled("content_topic"), filled("category"), F.lit(UNKNOWN_TOPIC))
    return F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(filled("source"), F.lit(house)), F.lit(", "), topic, F.lit("): "),
                    F.substring(F.coalesce(filled("summary"), F.lit(NO_SUMMARY)), 1, LINE_CHARS))


def about_tokens(text: Column) -> Column:
    """Tokens of a text where no tokenizer is asked: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def packed(found: DataFrame, articles: DataFrame, keys: list[str], budget: int, tokens: Callable[[Column], Column] = about_tokens, house: str = HOUSE) -> DataFrame:
    """found (keys, pos, id) with entry, line, tokens, total and `fits`: from pos 1 on, articles stay while their running total is within the budget.

    At most MOST rows of each message are looked at, so groups are small; an article that many messages share is joined, not broadcast.
    """
    rows = found.where(F.col("pos") <= MOST).select(*keys, "pos", "id").join(articles.select("id", entry(house).alias("entry"), line(house).alias("line")), "id")
    rows = rows.withColumn("tokens", tokens(F.col("entry")))
    total = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).withColumn("fits", F.col("total") <= budget)


def prompts(messages: DataFrame, packing: DataFrame, keys: list[str], rules: str = RULES) -> DataFrame:
    """messages (keys, message, type) with articles (how many are in the prompt), prompt (null where there are none) and listing (lines of the first LISTED, also those that do not fit)."""
    inside = lambda c, test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", c)))), lambda x: x[c])
    some = packing.groupBy(*keys).agg(inside("entry", F.col("fits")).alias("entries"), inside("line", F.col("pos") <= LISTED).alias("lines"))
    rows = messages.select(*keys, F.substring(F.coalesce("message", F.lit("")), 1, MESSAGE_CHARS).alias("message"), "type").join(some, keys, "left")
    n = F.coalesce(F.size("entries"), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)
    text = F.concat(F.lit(rules + "\n\n"), "message", F.lit("\n\n"), F.array_join("entries", "\n\n"))
    return rows.select(*keys, "message", "type", n.alias("articles"), F.when(n > 0, text).alias("prompt"), F.coalesce(F.array_join("lines", "\n"), F.lit("")).alias("listing"))


def ask(prompt: str, providers: list[Provider]) -> tuple[str, str, str]:
    """answer, provider and what went wrong before it (`name: reason`, in order); '' and 'none' where no provider answered."""
    wrong = []
    for name, provider in providers:
        try:
            said = re.sub(r"\s+\n", "\n", provider(prompt) or "").strip()[:ANSWER_CHARS]
        except Exception as e:  # noqa: BLE001 a provider may fail in any way; the next one is asked
            wrong.append(f"{name}: {type(e).__name__}")
            continue
        if said:
            return said, name, "; ".join(wrong)
        wrong.append(f"{name}: empty")
    return "", "none", "; ".join(wrong)


def answered(asked: DataFrame, providers: list[Provider], leads: dict[str, str] = LEADS, nothing: str = NOTHING) -> DataFrame:
    """The rows of `prompts` with answer, mode (ai, fallback), provider and failures. Rows without a prompt ask nobody."""
    schema = StructType([*asked.schema.fields, *StructType.fromDDL("said string, provider string, failures string").fields])
    place = asked.columns.index("prompt")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ask(p, providers) if p is not None else ("", "none", "") for p in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], pa.string()) for k in range(3))], names=schema.names)

    rows = asked.mapInArrow(each, schema)
    lead = F.lit(leads[""])
    for kind, text in leads.items():
        lead = F.when(F.col("type") == kind, text).otherwise(lead) if kind else lead
    instead = F.when(F.col("listing") == "", nothing).otherwise(F.concat(lead, F.lit("\n\n"), "listing"))
    ai = F.col("said") != ""
    return rows.withColumn("answer", F.when(ai, F.col("said")).otherwise(instead)).withColumn("mode", F.when(ai, "ai").otherwise("fallback")).drop("said")


def log(store: Stored, run: str, rows: DataFrame, now: str) -> None:
    """Answers into a stored log (columns LOG, keys conv_id and turn). A run that was logged is not asked again; of runs over one message the last stays."""
    if run in store.version().batches:
        return
    kept = rows.select("conv_id", "turn", "message", F.substring("answer", 1, LOGGED_CHARS).alias("answer"), "mode", "provider", F.lit(now).alias("created_at"))
    store.commit(run, kept, last_wins(["conv_id", "turn"], "created_at"))
