"""Publications as a stream of what happens to them: photos arrive one by one, a post is sent and answered, runs are tried again.

Events: `create` (n photos wanted, `policy` abort or skip_failed), `photo` (an answer to the upload of one place: its photo_id, '' if it failed),
`sent` (the post was asked for), `feed` (its answer: a post id, 'uncertain' or 'error: ..'), `run` (the publication is taken up again).
A photo once uploaded stays; an event that has come before, or comes where it has no place, changes nothing. A post that is not answered
within `wait` of event time may have been made or not: a timer sets it aside for a person, and no later run touches it.

State is one small row a publication (ten photos at most), so it is spread over tasks by publication and survives restarts in the checkpoint.
Events that are older than the watermark are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "publication_id string, at timestamp, kind string, place int, n int, policy string, answer string"
CHANGES = "publication_id string, seq int, status string, last_error string, uploaded int, failed int, post_id string, action string"
LEAST, WAIT = 3, timedelta(minutes=10)
# Texts of errors that later runs look at.
RECONCILE = "Feed publish timeout; cần reconcile thủ công trước khi thử lại."
NO_POST = "Facebook API không trả về post ID."


@dataclass
class Publication:
    status: str = ""
    error: str = ""
    wanted: int = 0
    skip: bool = False
    photos: dict[str, str] = field(default_factory=dict)
    post: str = ""
    seq: int = 0
    sent_at: int = 0

    def action(self) -> str:
        """What a new run would do with it."""
        if self.status == "PUBLISHED":
            return "done"
        held = self.status == "POST_PUBLISHING" or (self.status == "PARTIAL_FAILED" and "reconcile" in self.error)
        return "error" if held else "resume"

    def _counts(self) -> tuple[int, int]:
        up = sum(1 for p in self.photos.values() if p)
        return up, len(self.photos) - up

    def ready(self, least: int) -> bool:
        """All places are answered, and enough photos are there to post."""
        up, failed = self._counts()
        return self.status in ("PHOTOS_UPLOADED", "PARTIAL_FAILED") and "reconcile" not in self.error and up + failed == self.wanted and (not failed or (self.skip and up >= least))

    def _photos_done(self, least: int) -> None:
        up, failed = self._counts()
        if not failed:
            self.status, self.error = "PHOTOS_UPLOADED", ""
        elif not self.skip:
            self.status, self.error = "FAILED", f"{failed} ảnh upload thất bại."
        elif up < least:
            self.status, self.error = "FAILED", f"Chỉ có {up} ảnh thành công, cần tối thiểu {least}."
        else:
            self.status, self.error = "PARTIAL_FAILED", f"{failed} ảnh upload thất bại."

    def apply(self, kind: str, place: int, n: int, policy: str, answer: str, at: int, least: int) -> bool:
        """Whether the event changed the publication."""
        if kind == "create" and not self.status:
            self.status, self.wanted, self.skip = "CREATED", n, policy == "skip_failed"
            return True
        if kind == "photo" and self.status in ("CREATED", "PHOTOS_UPLOADING") and 1 <= place <= self.wanted and not self.photos.get(str(place)) and (answer or str(place) not in self.photos):
            self.photos[str(place)] = answer
            self.status = "PHOTOS_UPLOADING"
            if len(self.photos) == self.wanted:
                self._photos_done(least)
            return True
        if kind == "run" and self.action() == "resume" and self.status in ("FAILED", "PARTIAL_FAILED", "PHOTOS_UPLOADED"):
            self.photos = {k: p for k, p in self.photos.items() if p}
            if len(self.photos) == self.wanted:
                self.status, self.error = "PHOTOS_UPLOADED", ""
            else:
                self.status, self.error = "PHOTOS_UPLOADING", ""
            return True
        if kind == "sent" and self.ready(least):
            self.status, self.error, self.sent_at = "POST_PUBLISHING", "", at
            return True
        if kind == "feed" and self.status == "POST_PUBLISHING":
            self.sent_at = 0
            if answer == "uncertain":
                self.status, self.error = "PARTIAL_FAILED", RECONCILE
            elif answer.startswith("error"):
                self.status, self.error = "FAILED", answer.partition(":")[2].strip() or "error"
            elif not answer:
                self.status, self.error = "FAILED", NO_POST
            else:
                self.status, self.error, self.post = "PUBLISHED", "", answer
            return True
        return False

    def timed_out(self) -> None:
        self.status, self.error, self.sent_at = "PARTIAL_FAILED", RECONCILE, 0

    def row(self, ident: str) -> tuple:
        up, failed = self._counts()
        return ident, self.seq, self.status, self.error, up, failed, self.post, self.action()


def _step(least: int, wait: timedelta):
    wait_ms = int(wait.total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = Publication(**json.loads(state.get[0])) if state.exists else Publication()
        rows = []

        def changed() -> None:
            p.seq += 1
            rows.append(p.row(key[0]))

        def due(now: int) -> None:
            if p.sent_at and now >= p.sent_at + wait_ms:
                p.timed_out()
                changed()

        if state.hasTimedOut:
            due(p.sent_at + wait_ms)
        else:
            events = pd.concat(list(frames)).sort_values(["at", "kind", "place", "answer"], kind="stable")
            for at, kind, place, n, policy, answer in events[["at", "kind", "place", "n", "policy", "answer"]].itertuples(index=False, name=None):
                now = int(at.timestamp() * 1000)
                due(now)
                whole = lambda x: 0 if pd.isna(x) else int(x)
                if p.apply(kind, whole(place), whole(n), policy or "", answer or "", now, least):
                    changed()
        state.update((json.dumps(asdict(p)),))
        if p.sent_at:
            state.setTimeoutTimestamp(max(p.sent_at + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return step


def publications(events: DataFrame, least: int = LEAST, wait: timedelta = WAIT, late: str = "1 hour") -> DataFrame:
    """Every change of every publication, numbered; events of one batch and publication are taken in the order of their time."""
    rows = events.withWatermark("at", late)
    return rows.groupBy("publication_id").applyInPandasWithState(_step(least, wait), CHANGES, "publication string", "append", GroupStateTimeout.EventTimeTimeout)
