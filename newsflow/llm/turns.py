"""Conversation turns put back in order from batches that bring them late, twice and out of order.

State. Conversations are dealt to buckets by hash; a bucket is one group of a stateful Structured Streaming query and holds its open
conversations, the ids of its closed ones, and a timing wheel. A conversation is filed in the slot of the batch that would close it,
with a generation. An arrival files it again, further on, and raises its generation: the old entry is not looked for, it is
found stale when its slot is due. A bucket's tick (one row for each bucket and batch, so that empty batches count too) visits the one
slot that is due; the last tick visits all.

Of an open conversation only kept turns that cannot be released yet are held with their texts; of the released ones the last number and
role, as a turn can only follow them. The number of buckets grows with the input (ROWS rows each), so a state row stays small; a
conversation is not split: its waiting turns are in one bucket.

Defined cases: rows without a turn are dropped; null roles and texts are empty; rows without a conv_id are one conversation; of
equal payloads of a turn in a batch the one with the smallest role arrives; repeated rows are one arrival; an empty table gives no events.
Other columns do not matter. Ids and turns are whole numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import scratch
from ._session import quoted

BATCHES, QUIET = 8, 3
#: Arrivals that a bucket has on average, over all batches.
ROWS = 2000
#: What the query reads: arrivals, and ticks (conv_id, turn and first are 0 there). A null conv_id is 0 with no_id set, so that ids stay whole numbers in pandas.
ARRIVALS = "bucket int, batch int, tick boolean, final boolean, no_id boolean, conv_id bigint, turn bigint, first bigint, role string, text string"
#: What it puts out. Released and rejected turns have role and text; a close has the kept turns that were never released, ascending, comma-joined.
EVENTS = "event string, conv_id bigint, turn bigint, batch bigint, role string, text string, unreleased string, n_missing bigint, n_breaks bigint"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def arrivals(conversations: DataFrame, batches: int = BATCHES, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What arrives in which batch: batch, conv_id, turn, first, role, text. Each row comes in the batch of its hash; two of seven come again, as a user's, three later."""
    rows = conversations.select(
        F.col(quoted(conv_id)).cast("bigint").alias("conv_id"), F.col(quoted(turn)).cast("bigint").alias("turn"),
        F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    ).where("turn IS NOT NULL")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("bigint")
    once = F.struct((F.col("h") % batches).cast("int").alias("batch"), "role")
    again = F.struct(((F.col("h") + 3) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    came = rows.withColumn("h", h).withColumn("came", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))))
    payload = F.struct(F.concat("came.role", F.lit("|"), "text").alias("payload"), "came.role", "text")
    least = came.groupBy(F.col("came.batch").alias("batch"), "conv_id", "turn").agg(F.min(payload).alias("least"))
    firsts = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("turn").alias("first"))
    return least.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("batch", "conv_id", "turn", "first", "least.role", "least.text")


class _Bucket:
    """Open conversations, closed ids and the wheel of one bucket. A conversation: [first, next to release, role of the last released, breaks, waiting turns, generation]."""

    def __init__(self, quiet: int):
        self.open: dict[int | None, list] = {}
        self.closed: set[int | None] = set()
        self.wheel: list[list[tuple[int | None, int]]] = [[] for _ in range(quiet + 1)]

    def arrive(self, batch: int, conv: int | None, first: int, turns: list[tuple[int, str, str]], quiet: int) -> Iterator[tuple]:
        if conv in self.closed:
            yield from (("reject", conv, turn, batch, role, text, None, None, None) for turn, role, text in turns)
            return
        c = self.open.setdefault(conv, [first, first, None, 0, {}, 0])
        c[5] += 1
        self.wheel[(batch + quiet) % len(self.wheel)].append((conv, c[5]))
        waiting = c[4]
        for turn, role, text in turns:
            if turn < c[1] or turn in waiting:
                continue
            before = c[2] if turn == c[1] else waiting.get(turn - 1, (None,))[0]
            c[3] += (before == role) + (waiting.get(turn + 1, (None,))[0] == role)
            waiting[turn] = (role, text)
        while c[1] in waiting:
            role, text = waiting.pop(c[1])
            yield "release", conv, c[1], batch, role, text, None, None, None
            c[1], c[2] = c[1] + 1, role

    def tick(self, batch: int, final: bool) -> Iterator[tuple]:
        slots = range(len(self.wheel)) if final else [batch % len(self.wheel)]
        for s in slots:
            due, self.wheel[s] = self.wheel[s], []
            for conv, generation in due:
                c = self.open.get(conv)
                if c is None or c[5] != generation:
                    continue
                del self.open[conv]
                self.closed.add(conv)
                waiting = sorted(c[4])
                missing = waiting[-1] - c[1] + 1 - len(waiting) if waiting else 0
                yield "close", conv, -1, batch, None, None, ",".join(map(str, waiting)), missing, c[3]


def _frame(events: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(events, columns=_NAMES)
    for c in ("conv_id", "turn", "batch", "n_missing", "n_breaks"):
        out[c] = pd.array(out[c].to_list(), dtype="Int64")  # null or whole, never a float
    return out


def _step(quiet: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = pickle.loads(state.get[0]) if state.exists else _Bucket(quiet)
        rows = pd.concat(list(frames), ignore_index=True)
        events: list[tuple] = []
        for batch, came in rows.groupby("batch", sort=True):
            turns: dict[int | None, tuple[int, list]] = {}
            for no_id, conv, turn, first, role, text in came.loc[~came["tick"], ["no_id", "conv_id", "turn", "first", "role", "text"]].itertuples(index=False, name=None):
                turns.setdefault(None if no_id else conv, (first, []))[1].append((turn, role, text))
            for conv, (first, those) in turns.items():
                events += bucket.arrive(int(batch), conv, first, those, quiet)
            if came["tick"].any():
                events += bucket.tick(int(batch), bool(came["final"].any()))
        state.update((pickle.dumps(bucket, 5),))
        for i in range(0, len(events), 10_000):
            yield _frame(events[i : i + 10_000])

    return step


def reassemble(stream: DataFrame, quiet: int = QUIET) -> DataFrame:
    """Events of a stream of ARRIVALS, one batch number at a time and in order."""
    return stream.groupBy("bucket").applyInPandasWithState(_step(quiet), EVENTS, "bucket binary", "append", GroupStateTimeout.NoTimeout)


def cut(conversations: DataFrame, folder: str, batches: int = BATCHES, **columns: str) -> None:
    """Writes folder/batch=0 .. batch=`batches`: the arrivals of each batch with a tick for each bucket; the last one has final ticks only."""
    spark = conversations.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, conversations.count() // ROWS + 1)
    came = arrivals(conversations, batches, **columns)
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int").alias("bucket")
    no = F.lit(False)
    rows = came.select(bucket, "batch", no.alias("tick"), no.alias("final"), F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), "turn", "first", "role", "text")
    tick = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("batch"))
    zero, empty = F.lit(0).cast("bigint"), F.lit("")
    ticks = tick.select("bucket", "batch", F.lit(True).alias("tick"), (F.col("batch") == batches).alias("final"), no.alias("no_id"), zero.alias("conv_id"), zero.alias("turn"), zero.alias("first"), empty.alias("role"), empty.alias("text"))
    rows.unionByName(ticks.repartition("batch")).write.partitionBy("batch").parquet(folder)


def feed(spark: SparkSession, base: str, batch: int, quiet: int = QUIET) -> None:
    """Moves base/cut/batch=N to where the query reads, and runs the query until it has read it: each time a new start on the same checkpoint."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path(f"{base}/in"))
    if files.exists(path(f"{base}/cut/batch={batch}")):
        files.rename(path(f"{base}/cut/batch={batch}"), path(f"{base}/in/batch={batch}"))
    events = reassemble(spark.readStream.schema(ARRIVALS).parquet(f"{base}/in"), quiet)
    query = events.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/events").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run(conversations: DataFrame, batches: int = BATCHES, quiet: int = QUIET, **columns: str) -> DataFrame:
    """All events of the conversations, fed batch by batch, in a new folder of the shared one."""
    spark = conversations.sparkSession
    base = scratch(spark, "turns")
    cut(conversations, f"{base}/cut", batches, **columns)
    for batch in range(batches + 1):
        feed(spark, base, batch, quiet)
    return spark.read.schema(EVENTS).parquet(f"{base}/events")
