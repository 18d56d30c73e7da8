"""Events against a plain simulation of the rules, restarts, and the wheel by itself."""

import hashlib
import random

from newsflow.llm import turns

ROWS = "conv_id bigint, turn bigint, role string, text string, batch int, tick string"


def brute(rows, batches=8):
    came, first = {}, {}
    for conv, turn, role, text in rows:
        if turn is None:
            continue
        first[conv] = min(turn, first.get(conv, turn))
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        for batch, r in [(h % batches, role or "")] + [((h + 3) % batches, "user")] * (h % 7 < 2):
            new = (f"{r}|{text or ''}".encode(), r, text or "")
            came[batch, conv, turn] = min(new, came.get((batch, conv, turn), new))
    events = []
    for conv in first:
        kept, quiet, next_, closed, seen = {}, 0, first[conv], False, False
        for batch in range(batches + 1):
            here = sorted((t, p) for (b, c, t), p in came.items() if (b, c) == (batch, conv))
            if closed:
                events += [("reject", conv, t, batch, p[0].decode(), None, None, None) for t, p in here]
                continue
            quiet = 0 if here else quiet + 1
            seen = seen or bool(here)
            for t, p in here:
                kept.setdefault(t, p)
            while next_ in kept:
                events.append(("release", conv, next_, batch, kept[next_][0].decode(), None, None, None))
                next_ += 1
            if seen and (quiet == 3 or batch == batches):
                closed = True
                left = ",".join(str(t) for t in sorted(kept) if t >= next_)
                missing = max(kept) - first[conv] + 1 - len(kept)
                events.append(("close", conv, -1, batch, None, left, missing, sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)))
    return sorted(events, key=str)


def shown(df):
    return sorted((((r.event, r.conv_id, r.turn, r.batch, None if r.text is None else f"{r.role}|{r.text}", r.unreleased, r.n_missing, r.n_breaks) for r in df.collect())), key=str)


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, 0, -4, 2**60 + 1, *range(5, 40)]:
        start = rng.choice([-2, 0, 1, 7])
        for turn in range(start, start + rng.choice([1, 2, 3, 6, 40])):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant", None, "é"]), rng.choice(["x", "", None, "ü|y", f"t{turn}"])))
    rows += [rows[0], rows[1], (rows[2][0], rows[2][1], "zz", "other"), (3, None, "user", "no turn"), (5, 10**15, "user", "far"), (99, 1, "user", "long " * 200_000)]
    rng.shuffle(rows)
    return rows


def test_equals_simulation(spark):
    rows = some_rows(1)
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], ROWS)
    assert shown(turns.run(df)) == brute(rows)


def test_conversations_close_after_three_quiet_batches():
    b = turns._Bucket(3)
    assert [e[0] for e in b.arrive(0, 1, 0, [(0, "u", "x")], 3)] == ["release"]
    assert list(b.tick(0, False)) == list(b.tick(1, False)) == list(b.tick(2, False)) == []
    assert list(b.arrive(2, 1, 0, [(0, "u", "x")], 3)) == []  # a repeat: not released again, but the conversation is filed anew
    assert list(b.tick(3, False)) == list(b.tick(4, False)) == []
    assert [e[:4] for e in b.tick(5, False)] == [("close", 1, -1, 5)]
    assert [e[:4] for e in b.arrive(7, 1, 0, [(1, "u", "y")], 3)] == [("reject", 1, 1, 7)]
    assert list(b.tick(8, True)) == []


def test_no_rows_no_events(spark):
    assert turns.run(spark.createDataFrame([], ROWS), batches=2).count() == 0


def test_a_start_without_new_rows_changes_nothing(spark):
    rows = some_rows(2)[:60]
    base = turns.scratch(spark, "turns-test")
    turns.cut(spark.createDataFrame([(*r, 1, "t") for r in rows], ROWS), f"{base}/cut")
    for batch in range(9):
        turns.feed(spark, base, batch)
        if batch in (0, 4):
            turns.feed(spark, base, batch)
    assert shown(spark.read.schema(turns.EVENTS).parquet(f"{base}/events")) == brute(rows)
